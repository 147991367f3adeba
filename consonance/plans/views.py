"""Stand-in inputs built from the given tables.

Each view only reshapes rows of the test tables into the schema a job expects
(answers with embeddings, text answers, personas, task grids, attempt and
request logs). None of them does any of the analysis; the jobs in
``consonance.operators`` must be right on any data of these schemas.

Every view exists twice: as a DataFrame builder for Spark and as SQL text for
the DuckDB oracle. The two describe the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with embeddings: (model, topic, persona_id, experiment, embedding)."""
    e = table(spark, sf_dir, "embeddings")
    ctl = (F.col("vec_id") % 5) == 0
    return e.select(
        F.concat(F.lit("p"), (F.col("label") % 2).cast("string"), F.lit("/m"),
                 (F.col("label") % 5).cast("string")).alias("model"),
        F.when(ctl, F.lit("ctl")).otherwise(
            F.concat(F.lit("t"), (F.col("vec_id") % 4).cast("string"))).alias("topic"),
        F.col("vec_id").cast("string").alias("persona_id"),
        F.when(ctl, F.lit("control")).otherwise(F.lit("main")).alias("experiment"),
        F.col("embedding"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text answers: (model, topic, persona_id, response, success, tokens)."""
    d = table(spark, sf_dir, "documents").alias("d")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality").alias("l")
    return d.join(lab, "doc_id", "left").select(
        F.concat(F.col("lang"), F.lit("/"), F.col("lang"), F.lit("-x")).alias("model"),
        F.col("source").alias("topic"),
        F.col("doc_id").cast("string").alias("persona_id"),
        F.col("text").alias("response"),
        (F.coalesce(F.col("quality"), F.lit(1)) == 1).alias("success"),
        F.floor(F.col("n_chars") / 4).cast("int").alias("tokens"),
    )


def personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned personas with some NULL fields to exercise defaults and filters.

    The table is small in bytes, so it is read in few splits, but every row becomes topics x models tasks: rows are
    dealt out by key before they multiply.
    """
    c = table(spark, sf_dir, "customer")
    c = c.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    k = F.col("c_custkey")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
             .join(r, n.n_regionkey == r.r_regionkey)
             .select(k.cast("string").alias("persona_id"),
                     (F.lit(18) + k % 60).cast("int").alias("age"),
                     F.when(k % 2 == 0, "Female").otherwise("Male").alias("sex"),
                     F.col("n_name").alias("city"),
                     F.col("r_name").alias("state"),
                     F.col("c_mktsegment").alias("occupation"),
                     F.when(k % 7 == 0, F.lit(None).cast("string"))
                      .otherwise(F.lit("high_school")).alias("education_level"),
                     F.col("c_name").alias("persona"),
                     F.when(k % 13 == 0, F.lit(None).cast("string"))
                      .otherwise(F.col("c_mktsegment")).alias("professional_persona")))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("topic"))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "events")
            .select(F.concat(F.lit("vendor/"), F.col("event_type")).alias("model"))
            .distinct())


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected grid, as a stand-in input for coverage jobs."""
    from ..operators.grid import expand
    p = personas(spark, sf_dir).where(F.col("professional_persona").isNotNull())
    g = expand(p.select("persona_id"), topics(spark, sf_dir), "topic")
    return expand(g, models(spark, sf_dir), "model").select("model", "topic", "persona_id")


def done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed answers: the grid minus a rule-chosen tenth."""
    t = tasks(spark, sf_dir)
    keep = ((F.col("persona_id").cast("bigint") * 7 + F.length("topic") * 3
             + F.length("model")) % 11) != 0
    return t.where(keep).select("model", "topic", "persona_id",
                                F.concat(F.lit("answer "), F.col("persona_id")).alias("response"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempt log with several attempts per key; ``seq`` orders them."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("vendor/"), F.col("role")).alias("model"),
        F.concat(F.lit("t"), (F.col("conv_id") % 5).cast("string")).alias("topic"),
        F.col("conv_id").cast("string").alias("persona_id"),
        F.col("turn").cast("bigint").alias("seq"),
        F.col("text").alias("response"),
        (F.length("text") >= 50).alias("success"),
    )


def reqlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log: one row per request with time, outcome and batch."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id"),
        F.concat(F.lit("vendor/u"), (F.col("user_id") % 10).cast("string")).alias("model"),
        F.col("ts"),
        (F.col("event_type") != "error").alias("success"),
        ((F.col("event_type") == "error") & (F.col("value") < 5)).alias("rate_limited"),
        F.floor(F.col("event_id") / 50).cast("bigint").alias("batch"),
        F.floor(F.col("value")).cast("int").alias("tokens"),
    )


# SQL text of the same views for the DuckDB oracle (portable SQL).
VIEW_SQL = {
    "obs": """SELECT concat('p', CAST(label % 2 AS VARCHAR), '/m', CAST(label % 5 AS VARCHAR)) AS model,
  CASE WHEN vec_id % 5 = 0 THEN 'ctl' ELSE concat('t', CAST(vec_id % 4 AS VARCHAR)) END AS topic,
  CAST(vec_id AS VARCHAR) AS persona_id,
  CASE WHEN vec_id % 5 = 0 THEN 'control' ELSE 'main' END AS experiment, embedding
FROM embeddings""",
    "answers": """SELECT concat(d.lang, '/', d.lang, '-x') AS model, d.source AS topic,
  CAST(d.doc_id AS VARCHAR) AS persona_id, d.text AS response,
  coalesce(l.quality, 1) = 1 AS success, CAST(floor(d.n_chars / 4) AS INTEGER) AS tokens
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "personas": """SELECT CAST(c.c_custkey AS VARCHAR) AS persona_id, CAST(18 + c.c_custkey % 60 AS INTEGER) AS age,
  CASE WHEN c.c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS sex, n.n_name AS city, r.r_name AS state,
  c.c_mktsegment AS occupation, CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE 'high_school' END AS education_level,
  c.c_name AS persona, CASE WHEN c.c_custkey % 13 = 0 THEN NULL ELSE c.c_mktsegment END AS professional_persona
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "topics": "SELECT r_name AS topic FROM region",
    "models": "SELECT DISTINCT concat('vendor/', event_type) AS model FROM events",
    "tasks": """SELECT m.model, t.topic, p.persona_id FROM personas p CROSS JOIN topics t CROSS JOIN models m
WHERE p.professional_persona IS NOT NULL""",
    "done": """SELECT model, topic, persona_id, concat('answer ', persona_id) AS response FROM tasks
WHERE (CAST(persona_id AS BIGINT) * 7 + length(topic) * 3 + length(model)) % 11 <> 0""",
    "attempts": """SELECT concat('vendor/', role) AS model, concat('t', CAST(conv_id % 5 AS VARCHAR)) AS topic,
  CAST(conv_id AS VARCHAR) AS persona_id, CAST(turn AS BIGINT) AS seq, text AS response,
  length(text) >= 50 AS success
FROM conversations""",
    "reqlog": """SELECT event_id, concat('vendor/u', CAST(user_id % 10 AS VARCHAR)) AS model, ts,
  event_type <> 'error' AS success, event_type = 'error' AND value < 5 AS rate_limited,
  CAST(floor(event_id / 50) AS BIGINT) AS batch, CAST(floor(value) AS INTEGER) AS tokens
FROM events""",
}

# Which views each view needs, so an oracle query can define them in order.
_VIEW_DEPS = {"tasks": ["personas", "topics", "models"], "done": ["tasks"]}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with a WITH clause that defines the named views."""
    order: list[str] = []

    def add(n: str) -> None:
        for dep in _VIEW_DEPS.get(n, []):
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in order)
    return f"WITH {ctes}\n{body}"

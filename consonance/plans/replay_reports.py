"""Retry rounds, recovery and resume over logged answers (no answer function).

Input: the ``attempts`` view as the answer log, and as task list its keys plus
the keys of a model that never answered (``log_tasks``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.validity import PLACEHOLDER
from ..operators import central, coverage, inference, text_vectors
from ..session import scratch_path
from ..sources import files
from . import views
from .attempt_reports import REASON11
from .registry import oracle, register, sql_text
from .views import with_views

KEYS = coverage.KEYS


def log_tasks(spark, sf_dir):
    """Keys of the log, and those of every ninth persona for a model without answers."""
    a = views.attempts(spark, sf_dir)
    silent = a.where(F.col("persona_id").cast("bigint") % 9 == 0).select(
        F.lit("vendor/silent").alias("model"), "topic", "persona_id")
    return a.select(*KEYS).union(silent).distinct()


_RUN = f"""
, num AS (SELECT *, row_number() OVER (PARTITION BY model, topic, persona_id ORDER BY seq) AS attempt FROM attempts),
 ok AS (SELECT *, CASE WHEN attempt = 1 THEN success AND ({REASON11}) IS NULL ELSE success END AS good
        FROM num WHERE attempt <= 4),
 d AS (SELECT *, min(CASE WHEN good THEN attempt END) OVER (PARTITION BY model, topic, persona_id) AS done FROM ok),
 used AS (SELECT *, CASE WHEN attempt = 1 THEN 'first' ELSE 'retry_' || CAST(attempt - 1 AS VARCHAR) END AS stage,
          attempt = coalesce(done, 1) AS kept FROM d WHERE attempt <= coalesce(done, 4)),
 log_tasks AS (SELECT model, topic, persona_id FROM attempts UNION
   SELECT 'vendor/silent', topic, persona_id FROM attempts WHERE CAST(persona_id AS BIGINT) % 9 = 0)"""


def _final(log, tasks):
    kept = inference.replay(log, 3).withColumn("tokens", F.length("response").cast("int"))
    return inference.final_answers(tasks, kept)


@register("replayed_rounds", oracle(with_views(_RUN + f"""
SELECT t.model, t.topic, t.persona_id, CASE WHEN u.attempt IS NULL THEN {sql_text(PLACEHOLDER)} ELSE u.response END AS response,
  coalesce(u.success, false) AS success, CAST(coalesce(length(u.response), 0) AS INTEGER) AS tokens,
  u.attempt IS NULL AS placeholder
FROM log_tasks t LEFT JOIN (SELECT * FROM used WHERE kept) u
  ON t.model = u.model AND t.topic = u.topic AND t.persona_id = u.persona_id""", "attempts"),
    ["model", "topic", "persona_id", "response", "success", "tokens", "placeholder"]), ["R1", "R2", "R3", "J10"])
def q_replayed_rounds(spark, sf_dir):
    """First answers, three retry rounds and placeholders, from the answer log."""
    return _final(views.attempts(spark, sf_dir), log_tasks(spark, sf_dir))


@register("replayed_round_outcomes", oracle(with_views(_RUN + """
SELECT stage, CAST(count(*) AS BIGINT) AS attempts, CAST(count_if(good) AS BIGINT) AS recovered,
  CAST(count(*) - count_if(coalesce(good, false)) AS BIGINT) AS still_failed FROM used GROUP BY stage""", "attempts"),
    ["stage", "attempts", "recovered", "still_failed"]), ["A18", "R2"])
def q_replayed_round_outcomes(spark, sf_dir):
    """Per round: attempts made, recovered and still failed."""
    a = inference.replay(views.attempts(spark, sf_dir), 3)
    # an attempt that finished its key is the last one made of it, and kept; a kept first answer may be a failed one
    good = F.col("kept") & F.when(F.col("attempt") == 1, F.col("success") & inference.is_valid(F.col("response"))).otherwise(True)
    good = F.coalesce(good, F.lit(False))
    return a.groupBy("stage").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(good).alias("recovered"),
                                  F.count_if(~good).alias("still_failed"))


@register("resume_from_snapshot", oracle(with_views(_RUN + """
, old AS (SELECT model, topic, persona_id, arg_max(response, seq) AS response FROM attempts
          WHERE CAST(persona_id AS BIGINT) % 2 = 0 GROUP BY model, topic, persona_id)
SELECT t.model, t.topic, t.persona_id, coalesce(o.response, u.response, """ + sql_text(PLACEHOLDER) + """) AS response,
  CASE WHEN o.response IS NULL THEN 'new' ELSE 'existing' END AS source
FROM log_tasks t
LEFT JOIN old o ON t.model = o.model AND t.topic = o.topic AND t.persona_id = o.persona_id
LEFT JOIN (SELECT * FROM used WHERE kept) u ON t.model = u.model AND t.topic = u.topic AND t.persona_id = u.persona_id""",
    "attempts"), ["model", "topic", "persona_id", "response", "source"]), ["R4", "S5", "J8"])
def q_resume_from_snapshot(spark, sf_dir):
    """Snapshot documents of half the personas written and read; only the missing tasks are answered; merged."""
    log = views.attempts(spark, sf_dir)
    path = scratch_path(spark, "resume-snapshot")
    files.snapshot_documents(log.where(F.col("persona_id").cast("bigint") % 2 == 0), "batch", 1, 2, 1).write.option(
        "maxRecordsPerFile", 1).text(path)
    _meta, existing = files.read_snapshot(spark, path)

    def answer(missing):
        return _final(log.join(missing.select(*KEYS), KEYS, "left_semi"), missing)

    return inference.resume(log_tasks(spark, sf_dir), existing, answer)


@register("snapshot_metadata", oracle(with_views("""
SELECT 'batch' AS stage, 1 AS batch_number, 2 AS total_batches, 3 AS incremental_counter, 100.0 AS progress_percentage,
  count_if(success) / count(*) AS success_rate, CAST(count(*) AS INTEGER) AS total_requests,
  CAST(count_if(success) AS INTEGER) AS successful_requests FROM attempts""", "attempts"),
    ["stage", "batch_number", "total_batches", "incremental_counter", "progress_percentage", "success_rate",
     "total_requests", "successful_requests"], ["progress_percentage", "success_rate"]), ["S5", "K3"])
def q_snapshot_metadata(spark, sf_dir):
    """Metadata and metrics of snapshot documents, read back (equal in all documents of a snapshot)."""
    path = scratch_path(spark, "snapshot-meta")
    files.snapshot_documents(views.attempts(spark, sf_dir), "batch", 1, 2, 3).write.option("maxRecordsPerFile", 1).text(path)
    meta, _rows = files.read_snapshot(spark, path)
    return meta.select("stage", "batch_number", "total_batches", "incremental_counter", "progress_percentage",
                       "success_rate", "total_requests", "successful_requests").distinct()


def _ranking_sql() -> str:
    from .text_reports import _PAIR_SQL, _tfidf_sql

    logged = with_views(_RUN + f""",
 answers AS (SELECT t.model, t.topic, t.persona_id,
    CASE WHEN u.attempt IS NULL THEN {sql_text(PLACEHOLDER)} ELSE u.response END AS response
  FROM log_tasks t LEFT JOIN (SELECT * FROM used WHERE kept) u
    ON t.model = u.model AND t.topic = u.topic AND t.persona_id = u.persona_id)""", "attempts")
    vectors = _tfidf_sql(", mo AS (" + _PAIR_SQL[len(", "):].join(["WITH ", ")"]) + f"""
SELECT model, sum(mean_similarity * pairs) FILTER ({_COUNTED}) / sum(pairs) FILTER ({_COUNTED}) AS weighted_mean_similarity,
  CAST(count(*) FILTER ({_COUNTED}) AS BIGINT) AS topics_count,
  CAST(coalesce(sum(pairs) FILTER ({_COUNTED}), 0) AS BIGINT) AS total_pairs FROM mo GROUP BY model""")
    return oracle(logged + ",\n" + vectors[vectors.index("tok AS"):],
                  ["model", "weighted_mean_similarity", "topics_count", "total_pairs"], ["weighted_mean_similarity"])


_COUNTED = "mean_similarity IS NOT NULL AND pairs > 0"


@register("replayed_main_ranking", _ranking_sql, ["R6", "A5"])
def q_replayed_main_ranking(spark, sf_dir):
    """The main run on the log: rounds, recovery and placeholders, then TF-IDF, similarity and the models' ranking."""
    ans = _final(views.attempts(spark, sf_dir), log_tasks(spark, sf_dir))
    m = text_vectors.answer_moments(ans, None, force_tfidf=True)
    return central.model_overall_weighted(central.per_model_per_topic(m))


@register("replayed_control", oracle(with_views("""
, f AS (SELECT model, min(struct_pack(t := topic, p := CAST(persona_id AS BIGINT))) AS k FROM attempts
        WHERE topic = (SELECT min(topic) FROM attempts) GROUP BY model)
SELECT a.model, a.topic, a.persona_id || '_rep' || CAST(row_number() OVER (PARTITION BY a.model ORDER BY a.seq) AS VARCHAR) AS persona_id,
  a.response FROM attempts a JOIN f ON a.model = f.model AND a.topic = f.k.t AND CAST(a.persona_id AS BIGINT) = f.k.p
QUALIFY row_number() OVER (PARTITION BY a.model ORDER BY a.seq) <= 10""", "attempts"),
    ["model", "topic", "persona_id", "response"]), ["R5", "P8"])
def q_replayed_control(spark, sf_dir):
    """The control run on the log: each model's answers to its first persona of the first topic are the repetitions."""
    return inference.control_replay(views.attempts(spark, sf_dir), 10).select("model", "topic", "persona_id", "response")

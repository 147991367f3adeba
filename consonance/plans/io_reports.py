"""Round trips through the file formats, checked against the source views.

Each query writes a view to a fresh folder under the session's checkpoint
folder (``spark.checkpoint.dir``), reads it back with the library's readers
and returns the rows read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import central, coverage, moments
from ..session import scratch_path
from ..sources import files, reports
from . import views
from .registry import oracle, register
from .similarity_reports import MOMENTS_SQL, _WEIGHTED_SQL, _sql
from .variance_reports import MOM
from .views import with_views


@register("answers_parquet_roundtrip", oracle(with_views(
    "SELECT model, topic, persona_id, response FROM done", "done"),
    ["model", "topic", "persona_id", "response"]), ["K2", "S12", "U2"])
def q_answers_parquet_roundtrip(spark, sf_dir):
    """Answers written as Parquet partitioned by experiment/model, read back with pruning."""
    path = scratch_path(spark, "answers")
    d = views.done(spark, sf_dir)
    files.write_answers_parquet(d, path, "main")
    files.write_answers_parquet(d.limit(0), path, "control")
    back = files.read_answers_parquet(spark, path).where(F.col("experiment") == "main")
    return back.select("model", "topic", "persona_id", "response")


@register("results_json_roundtrip", oracle(with_views(
    "SELECT model, topic, persona_id, response FROM done", "done"),
    ["model", "topic", "persona_id", "response"]), ["K2", "S4", "S6"])
def q_results_json_roundtrip(spark, sf_dir):
    """Answers as nested results documents and back to rows."""
    path = scratch_path(spark, "results_json")
    files.write_results_json(views.done(spark, sf_dir), path)
    return files.read_results_json(spark, path)


@register("snapshot_roundtrip", oracle(with_views("""
SELECT model, topic, persona_id, arg_max(response, seq) AS response FROM attempts
GROUP BY model, topic, persona_id""", "attempts"), ["model", "topic", "persona_id", "response"]),
    ["K3", "S5", "S6", "A20"])
def q_snapshot_roundtrip(spark, sf_dir):
    """Snapshot documents of the latest answers, read back through the snapshot-aware reader."""
    path = scratch_path(spark, "snapshot")
    docs = files.snapshot_documents(views.attempts(spark, sf_dir), "final", 0, 1, 1)
    docs.write.mode("overwrite").text(path)
    return files.read_results_json(spark, path)


@register("persona_documents_roundtrip", oracle(with_views(
    "SELECT persona_id, persona, professional_persona FROM personas", "personas"),
    ["persona_id", "persona", "professional_persona"]), ["K1", "S1", "S2"])
def q_persona_documents_roundtrip(spark, sf_dir):
    """Personas written as bounded persona documents and read back."""
    path = scratch_path(spark, "personas")
    p = views.personas(spark, sf_dir).withColumnRenamed("persona_id", "uuid")
    files.write_persona_documents(p, path, rows_per_doc=100)
    back = files.read_personas(spark, path, multi_line=False)
    return back.select(F.col("uuid").alias("persona_id"), "persona", "professional_persona")


@register("persona_pages", oracle(with_views("""
, o AS (SELECT row_number() OVER (ORDER BY CAST(persona_id AS BIGINT)) - 1 AS pos, persona_id, persona FROM personas)
SELECT 'first' AS page, pos, persona_id, persona FROM o WHERE pos < 20
UNION ALL SELECT 'across', pos, persona_id, persona FROM o WHERE pos BETWEEN 75 AND 174
UNION ALL SELECT 'last', pos, persona_id, persona FROM o WHERE pos >= (SELECT count(*) FROM o) - 7""", "personas"),
    ["page", "pos", "persona_id", "persona"]), ["S1"])
def q_persona_pages(spark, sf_dir):
    """Pages of all persona documents by offset and length: an index of rows per file tells which files to open."""
    path, index = scratch_path(spark, "persona-pages"), scratch_path(spark, "page-index")
    p = views.personas(spark, sf_dir).withColumnRenamed("persona_id", "uuid")
    files.write_ordered_documents(p, path, "uuid", rows_per_doc=30)
    files.write_page_index(spark, path, index, multi_line=False)
    total = spark.read.parquet(index).agg(F.sum("n")).first()[0]
    pages = {"first": (0, 20), "across": (75, 100), "last": (max(total - 7, 0), 100)}
    out = None
    for name, (offset, length) in pages.items():
        part = files.persona_page(spark, path, offset, length, index, multi_line=False).select(
            F.lit(name).alias("page"), "pos", F.col("row.uuid").alias("persona_id"), F.col("row.persona").alias("persona"))
        out = part if out is None else out.unionByName(part)
    return out


@register("latest_results_file", oracle(with_views(
    "SELECT model, topic, persona_id, response FROM done", "done"),
    ["model", "topic", "persona_id", "response"]), ["S7", "S8", "S9", "S10"])
def q_latest_results_file(spark, sf_dir):
    """Three result tiers written; the tier rule picks results_*.json, whose rows come back."""
    import time

    base = scratch_path(spark, "logs")
    d = views.done(spark, sf_dir)
    tag = time.strftime("%Y%m%d_%H%M%S")
    files.write_results_json(d.withColumn("response", F.concat("response", F.lit(" (incremental)"))),
                             f"{base}/incremental_results_{tag}.json")
    files.write_results_json(d, f"{base}/results_{tag}.json")
    files.write_results_json(d.withColumn("response", F.concat("response", F.lit(" (final)"))),
                             f"{base}/run_final_{tag}.json")
    chosen = files.latest_results_file(spark, base)
    return files.read_results_json(spark, chosen)


@register("central_csv_roundtrip", oracle(_sql(MOMENTS_SQL + """
SELECT model, topic, mean_similarity AS mean_response_similarity, pairs AS pair_count
FROM mom WHERE experiment = 'main'"""),
    ["model", "topic", "mean_response_similarity", "pair_count"], ["mean_response_similarity"]), ["K6"])
def q_central_csv_roundtrip(spark, sf_dir):
    """The per-model/per-topic table written as one CSV file and read back."""
    m = moments.group_moments(views.obs(spark, sf_dir).where(F.col("experiment") == "main"))
    ppt = central.per_model_per_topic(m)
    path = scratch_path(spark, "csv")
    reports.write_csv(ppt, path)
    return spark.read.schema(ppt.schema).option("header", True).csv(path)


_HEAVY = "x IS NOT NULL AND w > 0"
_BENCHMARK_SQL = _sql(_WEIGHTED_SQL + f""",
mw AS (SELECT model, sum(x * w) FILTER ({_HEAVY}) / sum(w) FILTER ({_HEAVY}) AS s, count(*) FILTER ({_HEAVY}) AS c,
         CAST(coalesce(sum(w) FILTER ({_HEAVY}), 0) AS BIGINT) AS p FROM ppt GROUP BY model),
tw AS (SELECT topic, sum(x * w) FILTER ({_HEAVY}) / sum(w) FILTER ({_HEAVY}) AS s, count(*) FILTER ({_HEAVY}) AS c,
         CAST(coalesce(sum(w) FILTER ({_HEAVY}), 0) AS BIGINT) AS p FROM ppt GROUP BY topic)
SELECT '1_benchmark' AS section, 0 AS line_no, printf('Benchmark (mean of models'' weighted means): %.6f', avg(s)) AS text FROM mw
UNION ALL SELECT '2_top_models', CAST(r AS INTEGER), printf('%s  %.6f  topics=%d  pairs=%d', model, s, c, p)
FROM (SELECT *, row_number() OVER (ORDER BY s DESC NULLS LAST, model) AS r FROM mw) WHERE r <= 5
UNION ALL SELECT '3_top_topics', CAST(r AS INTEGER), printf('%s  %.6f  models=%d  pairs=%d', topic, s, c, p)
FROM (SELECT *, row_number() OVER (ORDER BY s DESC NULLS LAST, topic) AS r FROM tw) WHERE r <= 5""")


@register("benchmark_report", oracle(_BENCHMARK_SQL, ["section", "line_no", "text"]), ["K7"])
def q_benchmark_report(spark, sf_dir):
    """Benchmark summary text: benchmark line, top-5 models, top-5 topics."""
    m = moments.group_moments(views.obs(spark, sf_dir).where(F.col("experiment") == "main"))
    ppt = central.per_model_per_topic(m)
    mw = central.model_overall_weighted(ppt)
    lines = reports.benchmark_summary(central.benchmark(mw), mw, central.topic_across_models_weighted(ppt))
    reports.write_report(lines, scratch_path(spark, "report"))
    return lines


@register("resume_merge_roundtrip", oracle(with_views("""
SELECT model, topic, persona_id, response FROM done
UNION ALL
SELECT t.model, t.topic, t.persona_id, 'recovered ' || t.persona_id FROM tasks t ANTI JOIN done d
  ON d.model = t.model AND d.topic = t.topic AND d.persona_id = t.persona_id""", "done"),
    ["model", "topic", "persona_id", "response"]), ["R4", "J8", "S5"])
def q_resume_merge_roundtrip(spark, sf_dir):
    """Resume: read a stored snapshot, answer only the missing tasks, merge (old wins)."""
    path = scratch_path(spark, "resume")
    files.write_results_json(views.done(spark, sf_dir), path)
    existing = files.read_results_json(spark, path)
    todo = coverage.missing_tasks(views.tasks(spark, sf_dir), existing)
    new = todo.select("model", "topic", "persona_id",
                      F.concat(F.lit("recovered "), F.col("persona_id")).alias("response"))
    return coverage.merge_results(existing, new).select("model", "topic", "persona_id", "response")


@register("control_persona_roundtrip", oracle(with_views("""
SELECT persona_id, persona FROM personas ORDER BY CAST(persona_id AS BIGINT) LIMIT 1""", "personas"),
    ["persona_id", "persona"]), ["S3"])
def q_control_persona_roundtrip(spark, sf_dir):
    """The first persona written as a one-persona document and read with the strict reader."""
    p = views.personas(spark, sf_dir)
    first = p.orderBy(F.col("persona_id").cast("bigint")).limit(1).withColumnRenamed("persona_id", "uuid")
    path = scratch_path(spark, "control-persona")
    files.write_persona_documents(first, path, rows_per_doc=100)
    back = files.read_single_persona(spark, path, multi_line=False)
    return back.select(F.col("uuid").alias("persona_id"), "persona")


@register("similarity_bundle_roundtrip", oracle(with_views("""
, u AS (SELECT model, topic, persona_id, CAST(embedding AS DOUBLE[]) AS v FROM obs WHERE experiment = 'main'),
un AS (SELECT *, sqrt(list_dot_product(v, v)) AS nrm FROM u),
ps AS (SELECT a.model, a.topic, CASE WHEN a.nrm = 0 OR b.nrm = 0 THEN 0.0
         ELSE list_dot_product(a.v, b.v) / (a.nrm * b.nrm) END AS s
       FROM un a JOIN un b ON a.model = b.model AND a.topic = b.topic AND a.persona_id < b.persona_id),
g AS (SELECT model, topic, count(*) AS n FROM u GROUP BY model, topic)
SELECT g.model, g.topic, CAST(g.n AS BIGINT) AS n, avg(ps.s) AS mean_similarity FROM g
LEFT JOIN ps ON g.model = ps.model AND g.topic = ps.topic GROUP BY g.model, g.topic, g.n""", "obs"),
    ["model", "topic", "n", "mean_similarity"], ["mean_similarity"]), ["K5", "S11"])
def q_similarity_bundle_roundtrip(spark, sf_dir):
    """Group moments and vectors written as a partitioned bundle, moments read back."""
    o = views.obs(spark, sf_dir).where(F.col("experiment") == "main").drop("experiment")
    m = moments.group_moments(o)
    path = scratch_path(spark, "bundle")
    files.write_similarity_bundle(m, o, path)
    back, _vec = files.read_similarity_bundle(spark, path)
    return back.where(F.col("experiment") == "main").select("model", "topic", "n", "mean_similarity")


_VARIANCE_SQL = _sql(MOM + """
SELECT '1_control' AS section, 0 AS line_no, printf('Control (within-model) similarity across models: mean %.4f, std %.4f, min %.4f, max %.4f',
  avg(mean_similarity), stddev_samp(mean_similarity), min(mean_similarity), max(mean_similarity)) AS text FROM cvar
UNION ALL SELECT '2_persona', 0, printf('Persona (across-persona) similarity across models: mean %.4f, std %.4f, min %.4f, max %.4f',
  avg(mean_similarity), stddev_samp(mean_similarity), min(mean_similarity), max(mean_similarity)) FROM pvar
UNION ALL SELECT '3_most_consistent', CAST(r AS INTEGER), printf('%s: %.4f (std: %.4f)', model, mean_similarity, std_similarity)
FROM (SELECT *, row_number() OVER (ORDER BY mean_similarity DESC, model) AS r FROM cvar) WHERE r <= 5
UNION ALL SELECT '4_persona_minus_control', CAST(r AS INTEGER), printf('%s: Persona=%.4f, Control=%.4f, Diff=%.4f', model,
  mean_similarity_persona, mean_similarity_control, mean_similarity_persona - mean_similarity_control)
FROM (SELECT *, row_number() OVER (ORDER BY mean_similarity_persona - mean_similarity_control DESC, model) AS r FROM merged)
WHERE r <= 5""")


@register("variance_report", oracle(_VARIANCE_SQL, ["section", "line_no", "text"]), ["K7", "A21", "W4"])
def q_variance_report(spark, sf_dir):
    """Variance report text: summary statistics per experiment, top-5 consistent,
    top-5 persona-minus-control."""
    from ..operators import variance

    from ..session import checkpoint_dir

    checkpoint_dir(spark)
    # the report reads the (group-grain) moments five times: materialise once
    m = moments.group_moments(views.obs(spark, sf_dir),
                              keys=("model", "topic", "experiment")).checkpoint(eager=True)
    cv = variance.within_model_variance(m.where(F.col("experiment") == "control"))
    pv = variance.across_persona_variance(m.where(F.col("experiment") == "main"))
    lines = reports.variance_report(cv, pv, variance.merge_variance(cv, pv))
    reports.write_report(lines, scratch_path(spark, "variance-report"))
    return lines


_OUTCOMES_SQL = """,
models AS (SELECT DISTINCT concat('vendor/', event_type) AS model FROM events),
k AS (SELECT o.model, count(DISTINCT e.label) AS k FROM obs o JOIN embeddings e ON o.persona_id = CAST(e.vec_id AS VARCHAR)
      WHERE o.experiment = 'main' GROUP BY o.model),
pm AS (SELECT a.model, count(*) AS c FROM un a JOIN un b ON a.model = b.model AND a.experiment = b.experiment
        AND a.persona_id < b.persona_id
       WHERE a.experiment = 'main' AND list_dot_product(a.v, b.v) < 0 GROUP BY a.model),
res AS (SELECT g.model, CAST(coalesce(k.k, 1) AS BIGINT) AS optimal_clusters, CAST(coalesce(pm.c, 0) AS BIGINT) AS negative_count,
    CASE WHEN k.model IS NULL THEN 'No embeddings available' END AS error
  FROM (SELECT model FROM models WHERE model IS NOT NULL UNION SELECT model FROM obs) g
  LEFT JOIN k ON g.model = k.model LEFT JOIN pm ON g.model = pm.model)
"""


def _outcomes(spark, sf_dir):
    """Given labels as clusters, negative pairs, and the models that have no embeddings at all."""
    from ..operators import clusters, pairs
    from ..sources.tables import table

    o = views.obs(spark, sf_dir).where(F.col("experiment") == "main")
    lab = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("persona_id"), "label")
    k = o.select("model", "persona_id").join(lab, "persona_id").groupBy("model").agg(
        F.countDistinct("label").alias("optimal_clusters"))
    neg = pairs.negative_summary(o, keys=["model"]).select("model", "negative_count", "has_negative")
    every = views.models(spark, sf_dir).where(F.col("model").isNotNull()).union(
        views.obs(spark, sf_dir).select("model")).distinct()
    return clusters.group_outcomes(every, k.join(neg, "model", "left"), ["model"])


@register("cluster_outcomes", oracle(_sql(_OUTCOMES_SQL + "SELECT * FROM res"),
    ["model", "optimal_clusters", "negative_count", "error"]), ["C10"])
def q_cluster_outcomes(spark, sf_dir):
    """One row per model; a model without embeddings has an error and one cluster."""
    return _outcomes(spark, sf_dir).select("model", "optimal_clusters", "negative_count", "error")


@register("analysis_summary", oracle(_sql(_OUTCOMES_SQL + """
SELECT '1_negatives' AS section, 0 AS line_no, printf('groups %d, groups with negative pairs %d, negative pairs %d',
  count(*), count(*) FILTER (negative_count > 0), CAST(sum(negative_count) AS BIGINT)) AS text FROM res
UNION ALL SELECT '2_clusters', 0, printf('groups clustered %d, clusters in total %d', count(*), CAST(sum(optimal_clusters) AS BIGINT))
FROM res WHERE error IS NULL"""), ["section", "line_no", "text"]), ["K7", "A25"])
def q_analysis_summary(spark, sf_dir):
    """Grand totals over models: negative pairs of all, clusters of those without an error."""
    r = _outcomes(spark, sf_dir)
    lines = reports.analysis_summary(r, r.where(F.col("error").isNull()))
    reports.write_report(lines, scratch_path(spark, "analysis-summary"))
    return lines


_TIERS = {  # case: (files to write, preferred word)
    "final_before_incremental": (["run_final_b.json", "incremental_results_z.json", "notes.json"], None),
    "incremental_alone": (["incremental_results_a.json", "notes.json"], None),
    "preferred_word": (["results_a.json", "incremental_results_cleaned.json"], "cleaned"),
    "preferred_word_absent": (["results_a.json", "run_final_b.json"], "cleaned"),
}


@register("results_file_tiers", oracle(with_views("""
, c(tier_case, name) AS (VALUES ('final_before_incremental', 'run_final_b.json'), ('incremental_alone', 'incremental_results_a.json'),
  ('preferred_word', 'incremental_results_cleaned.json'), ('preferred_word_absent', 'results_a.json'))
SELECT tier_case, model, topic, CAST(count(*) AS BIGINT) AS answers, min(name || ': ' || response) AS first_answer
FROM done, c GROUP BY tier_case, model, topic""", "done"),
    ["tier_case", "model", "topic", "answers", "first_answer"]), ["S9", "S10"])
def q_results_file_tiers(spark, sf_dir):
    """Which file each tier rule chooses: every file holds all answers, marked with the file's name."""
    # all files hold the same answers: they are grouped into documents once
    groups, out = scratch_path(spark, "tier-groups"), None
    files.answer_groups(views.done(spark, sf_dir)).write.parquet(groups)
    d = spark.read.parquet(groups)
    for case, (names, prefer) in _TIERS.items():
        base = scratch_path(spark, "tiers")
        for n in names:
            marked = F.transform("entries", lambda e: F.struct(
                e["persona_id"].alias("persona_id"), F.concat(F.lit(n + ": "), e["response"]).alias("response")))
            files.write_results_json(d.withColumn("entries", marked), f"{base}/{n}")
        back = files.read_results_json(spark, files.latest_results_file(spark, base, prefer), maps=True)
        # a document's answers are counted and compared where they are parsed
        per = back.select("model", "topic", F.size("answers").alias("n"), F.array_min(F.map_values("answers")).alias("first"))
        part = per.groupBy("model", "topic").agg(F.sum("n").alias("answers"), F.min("first").alias("first_answer")
                                                 ).select(F.lit(case).alias("tier_case"), "*")
        out = part if out is None else out.unionByName(part)
    return out

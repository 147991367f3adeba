"""Similarity scores of the main experiment: moments, central tables, pair reports.

Input: the ``obs`` view (answers with embeddings). Oracle: a DuckDB pair join
over the same rows, so the closed-form Spark results are checked against the
plain definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import central, moments, pairs
from . import views
from .registry import oracle, register

# DuckDB: unit-vector pair join over one experiment of obs (the definition).
PAIRS_SQL = """u AS (SELECT model, topic, experiment, persona_id, CAST(embedding AS DOUBLE[]) AS v FROM obs),
un AS (SELECT *, sqrt(list_dot_product(v, v)) AS nrm FROM u),
grp AS (SELECT model, topic, experiment, count(*) AS n FROM u GROUP BY model, topic, experiment),
ps AS (SELECT a.model, a.topic, a.experiment, a.persona_id AS id_a, b.persona_id AS id_b,
  CASE WHEN a.nrm = 0 OR b.nrm = 0 THEN 0.0
       ELSE list_dot_product(a.v, b.v) / (a.nrm * b.nrm) END AS similarity
  FROM un a JOIN un b ON a.model = b.model AND a.topic = b.topic
   AND a.experiment = b.experiment AND a.persona_id < b.persona_id)"""


def _sql(body: str) -> str:
    """Prefix the obs view and the pair CTEs (body may add more CTEs after a comma)."""
    from .views import VIEW_SQL
    return f"WITH obs AS ({VIEW_SQL['obs']}),\n{PAIRS_SQL}\n{body}"


MOMENTS_SQL = """, mom AS (
  SELECT g.model, g.topic, g.experiment, g.n, CAST(g.n * (g.n - 1) / 2 AS BIGINT) AS pairs,
         avg(ps.similarity) AS mean_similarity, stddev_pop(ps.similarity) AS std_similarity
  FROM grp g LEFT JOIN ps ON g.model = ps.model AND g.topic = ps.topic AND g.experiment = ps.experiment
  GROUP BY g.model, g.topic, g.experiment, g.n)"""


def main_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.obs(spark, sf_dir).where(F.col("experiment") == "main")


def main_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moments.group_moments(main_obs(spark, sf_dir))


@register("similarity_moments", oracle(_sql(MOMENTS_SQL + """
SELECT model, topic, CAST(n AS BIGINT) AS n, pairs, mean_similarity, std_similarity FROM mom
WHERE experiment = 'main'"""), ["model", "topic", "n", "pairs", "mean_similarity", "std_similarity"],
    ["mean_similarity", "std_similarity"]), ["V3", "V4", "V5", "V7", "A1", "A3"])
def q_similarity_moments(spark, sf_dir):
    """Mean and population std of the off-diagonal cosine similarity per group (closed form)."""
    return main_moments(spark, sf_dir).select("model", "topic", "n", "pairs",
                                              "mean_similarity", "std_similarity")


@register("avg_scores", oracle(_sql(MOMENTS_SQL + """
SELECT model, topic, mean_similarity AS avg_similarity FROM mom WHERE experiment = 'main'"""),
    ["model", "topic", "avg_similarity"], ["avg_similarity"]), ["A2"])
def q_avg_scores(spark, sf_dir):
    """Average similarity per model per topic."""
    return central.avg_scores(main_moments(spark, sf_dir))


@register("per_model_per_topic", oracle(_sql(MOMENTS_SQL + """
SELECT model, topic, mean_similarity AS mean_response_similarity, pairs AS pair_count
FROM mom WHERE experiment = 'main'"""),
    ["model", "topic", "mean_response_similarity", "pair_count"], ["mean_response_similarity"]),
    ["A4", "W1"])
def q_per_model_per_topic(spark, sf_dir):
    """Central analysis table 1: within-group mean similarity and pair count."""
    return central.per_model_per_topic(main_moments(spark, sf_dir)).orderBy("model", "topic")


_WEIGHTED_SQL = MOMENTS_SQL + """, ppt AS (
  SELECT model, topic, mean_similarity AS x, pairs AS w FROM mom WHERE experiment = 'main')"""


@register("model_overall_weighted", oracle(_sql(_WEIGHTED_SQL + """
SELECT model,
  sum(CASE WHEN x IS NOT NULL AND w > 0 THEN x * w END) / sum(CASE WHEN x IS NOT NULL AND w > 0 THEN w END)
    AS weighted_mean_similarity,
  CAST(count(CASE WHEN x IS NOT NULL AND w > 0 THEN 1 END) AS BIGINT) AS topics_count,
  CAST(coalesce(sum(CASE WHEN x IS NOT NULL AND w > 0 THEN w END), 0) AS BIGINT) AS total_pairs
FROM ppt GROUP BY model"""), ["model", "weighted_mean_similarity", "topics_count", "total_pairs"],
    ["weighted_mean_similarity"]), ["A5", "W2"])
def q_model_overall_weighted(spark, sf_dir):
    """Central analysis table 2: pair-weighted mean per model, best first."""
    ppt = central.per_model_per_topic(main_moments(spark, sf_dir))
    return central.model_overall_weighted(ppt).orderBy(F.desc_nulls_last("weighted_mean_similarity"))


@register("topic_across_models_weighted", oracle(_sql(_WEIGHTED_SQL + """
SELECT topic,
  sum(CASE WHEN x IS NOT NULL AND w > 0 THEN x * w END) / sum(CASE WHEN x IS NOT NULL AND w > 0 THEN w END)
    AS response_weighted_topic_consistency,
  CAST(count(CASE WHEN x IS NOT NULL AND w > 0 THEN 1 END) AS BIGINT) AS models_contributing,
  CAST(coalesce(sum(CASE WHEN x IS NOT NULL AND w > 0 THEN w END), 0) AS BIGINT) AS total_response_pairs
FROM ppt GROUP BY topic"""), ["topic", "response_weighted_topic_consistency", "models_contributing",
                              "total_response_pairs"], ["response_weighted_topic_consistency"]), ["A6"])
def q_topic_across_models_weighted(spark, sf_dir):
    """Central analysis table 3: pair-weighted mean per topic across models."""
    ppt = central.per_model_per_topic(main_moments(spark, sf_dir))
    return central.topic_across_models_weighted(ppt)


@register("benchmark", oracle(_sql(_WEIGHTED_SQL + """, mw AS (
  SELECT model, sum(CASE WHEN x IS NOT NULL AND w > 0 THEN x * w END)
              / sum(CASE WHEN x IS NOT NULL AND w > 0 THEN w END) AS wm
  FROM ppt GROUP BY model)
SELECT avg(wm) AS benchmark FROM mw"""), ["benchmark"], ["benchmark"]), ["A7"])
def q_benchmark(spark, sf_dir):
    """Benchmark: arithmetic mean of the models' weighted means."""
    ppt = central.per_model_per_topic(main_moments(spark, sf_dir))
    return central.benchmark(central.model_overall_weighted(ppt))


_LEADER_SQL = MOMENTS_SQL + """, om AS (
  SELECT model, coalesce(avg(mean_similarity), 0.0) AS overall_similarity
  FROM mom WHERE experiment = 'main' GROUP BY model)"""


@register("overall_leaderboard", oracle(_sql(_LEADER_SQL + """
SELECT model, overall_similarity,
  CAST(row_number() OVER (ORDER BY overall_similarity DESC, model) AS BIGINT) AS rank FROM om"""),
    ["model", "overall_similarity", "rank"], ["overall_similarity"]), ["A12", "W6"])
def q_overall_leaderboard(spark, sf_dir):
    """Overall leaderboard: plain mean of each model's topic scores, ranked."""
    return central.overall_leaderboard(central.avg_scores(main_moments(spark, sf_dir)))


@register("topic_model_ranks", oracle(_sql(MOMENTS_SQL + """
SELECT model, topic, mean_similarity AS avg_similarity,
  CAST(row_number() OVER (PARTITION BY topic ORDER BY mean_similarity DESC NULLS LAST, model) AS BIGINT) AS rank
FROM mom WHERE experiment = 'main'"""), ["model", "topic", "avg_similarity", "rank"],
    ["avg_similarity"]), ["W6"])
def q_topic_model_ranks(spark, sf_dir):
    """Models ranked inside each topic."""
    return central.topic_model_ranks(central.avg_scores(main_moments(spark, sf_dir)))


@register("top5_models", oracle(_sql(_WEIGHTED_SQL + """, mw AS (
  SELECT model, sum(CASE WHEN x IS NOT NULL AND w > 0 THEN x * w END)
              / sum(CASE WHEN x IS NOT NULL AND w > 0 THEN w END) AS weighted_mean_similarity
  FROM ppt GROUP BY model)
SELECT model, weighted_mean_similarity, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY weighted_mean_similarity DESC NULLS LAST, model) AS rank FROM mw)
WHERE rank <= 5"""), ["model", "weighted_mean_similarity", "rank"], ["weighted_mean_similarity"]), ["W3"])
def q_top5_models(spark, sf_dir):
    """Top 5 models by weighted mean similarity (a top-k report)."""
    ppt = central.per_model_per_topic(main_moments(spark, sf_dir))
    mw = central.model_overall_weighted(ppt).select("model", "weighted_mean_similarity")
    return central.top_k(mw, "weighted_mean_similarity", "model", 5)


@register("top5_topics", oracle(_sql(_WEIGHTED_SQL + """, tw AS (
  SELECT topic, sum(CASE WHEN x IS NOT NULL AND w > 0 THEN x * w END)
              / sum(CASE WHEN x IS NOT NULL AND w > 0 THEN w END) AS response_weighted_topic_consistency
  FROM ppt GROUP BY topic)
SELECT topic, response_weighted_topic_consistency, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY response_weighted_topic_consistency DESC NULLS LAST, topic) AS rank
  FROM tw) WHERE rank <= 5"""), ["topic", "response_weighted_topic_consistency", "rank"],
    ["response_weighted_topic_consistency"]), ["W3"])
def q_top5_topics(spark, sf_dir):
    """Top 5 topics by response-weighted consistency (a top-k report)."""
    ppt = central.per_model_per_topic(main_moments(spark, sf_dir))
    tw = central.topic_across_models_weighted(ppt).select("topic", "response_weighted_topic_consistency")
    return central.top_k(tw, "response_weighted_topic_consistency", "topic", 5)


@register("negative_pairs", oracle(_sql("""
SELECT model, topic, id_a, id_b, similarity FROM ps WHERE experiment = 'main' AND similarity < 0"""),
    ["model", "topic", "id_a", "id_b", "similarity"], ["similarity"]), ["A13", "J11"])
def q_negative_pairs(spark, sf_dir):
    """Pairs with negative similarity (blocked evaluation; only matches leave the tasks)."""
    return pairs.negative_pairs(main_obs(spark, sf_dir))


@register("negative_summary", oracle(_sql("""
, neg AS (SELECT model, topic, count(*) AS c, min(similarity) AS mn, max(similarity) AS mx,
               avg(similarity) AS av FROM ps WHERE experiment = 'main' AND similarity < 0
          GROUP BY model, topic)
SELECT g.model, g.topic, neg.c IS NOT NULL AS has_negative, CAST(coalesce(neg.c, 0) AS BIGINT) AS negative_count,
  neg.mn AS min_value, neg.mx AS max_value, neg.av AS mean_value
FROM grp g LEFT JOIN neg ON g.model = neg.model AND g.topic = neg.topic
WHERE g.experiment = 'main'"""), ["model", "topic", "has_negative", "negative_count", "min_value",
                                   "max_value", "mean_value"], ["min_value", "max_value", "mean_value"]),
    ["A13"])
def q_negative_summary(spark, sf_dir):
    """Negative-pair statistics per group (every group listed)."""
    return pairs.negative_summary(main_obs(spark, sf_dir))


@register("extreme_pairs", oracle(_sql("""
, mx AS (SELECT model, topic, arg_min(struct_pack(a := id_a, b := id_b, s := similarity),
                                      struct_pack(k := -similarity, a := id_a, b := id_b)) AS p
         FROM ps WHERE experiment = 'main' GROUP BY model, topic),
 mn AS (SELECT model, topic, arg_min(struct_pack(a := id_a, b := id_b, s := similarity),
                                     struct_pack(k := similarity, a := id_a, b := id_b)) AS p
        FROM ps WHERE experiment = 'main' GROUP BY model, topic)
SELECT mx.model, mx.topic, mx.p.a AS most_similar_a, mx.p.b AS most_similar_b, mx.p.s AS max_similarity,
  mn.p.a AS least_similar_a, mn.p.b AS least_similar_b, mn.p.s AS min_similarity
FROM mx JOIN mn ON mx.model = mn.model AND mx.topic = mn.topic"""),
    ["model", "topic", "most_similar_a", "most_similar_b", "max_similarity", "least_similar_a",
     "least_similar_b", "min_similarity"], ["max_similarity", "min_similarity"]), ["A14"])
def q_extreme_pairs(spark, sf_dir):
    """Most and least similar pair per group."""
    return pairs.extreme_pairs(main_obs(spark, sf_dir))


@register("connections", oracle(_sql("""
, c AS (SELECT persona_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
               CAST(embedding[3] AS DOUBLE) AS z FROM obs WHERE experiment = 'main')
SELECT ps.model, ps.topic, id_a, id_b, similarity, ca.x AS x_a, ca.y AS y_a, ca.z AS z_a,
  cb.x AS x_b, cb.y AS y_b, cb.z AS z_b
FROM ps JOIN c ca ON ps.id_a = ca.persona_id JOIN c cb ON ps.id_b = cb.persona_id
WHERE ps.experiment = 'main' AND similarity >= 0.3"""),
    ["model", "topic", "id_a", "id_b", "similarity", "x_a", "y_a", "z_a", "x_b", "y_b", "z_b"],
    ["similarity", "x_a", "y_a", "z_a", "x_b", "y_b", "z_b"]), ["J14"])
def q_connections(spark, sf_dir):
    """Links between answers at similarity >= 0.3 with endpoint coordinates.

    Coordinates here are the first three embedding dimensions; the 3D
    reduction of ``operators.clusters`` gives the same table shape.
    """
    o = main_obs(spark, sf_dir)
    coords = o.select("model", "topic", "persona_id",
                      F.col("embedding")[0].cast("double").alias("x"),
                      F.col("embedding")[1].cast("double").alias("y"),
                      F.col("embedding")[2].cast("double").alias("z"))
    return pairs.connections(o, coords, threshold=0.3).select(
        "model", "topic", "id_a", "id_b", "similarity", "x_a", "y_a", "z_a", "x_b", "y_b", "z_b")


@register("similarity_bands", oracle(_sql(MOMENTS_SQL + """
SELECT model, topic, mean_similarity,
  CASE WHEN mean_similarity >= 1.0 THEN 'perfect' WHEN mean_similarity >= 0.8 THEN 'high'
       WHEN mean_similarity >= 0.5 THEN 'moderate' WHEN mean_similarity >= 0.0 THEN 'low'
       WHEN mean_similarity < 0.0 THEN 'opposing' END AS band
FROM mom WHERE experiment = 'main'"""), ["model", "topic", "mean_similarity", "band"], ["mean_similarity"]),
    ["P25"])
def q_similarity_bands(spark, sf_dir):
    """Named similarity band of every group's mean similarity."""
    from ..functions.grades import similarity_band
    m = main_moments(spark, sf_dir)
    return m.select("model", "topic", "mean_similarity", similarity_band(F.col("mean_similarity")).alias("band"))


@register("encoded_moments", None, ["V1", "X1"])
def q_encoded_moments(spark, sf_dir):
    """Text answers encoded by a pluggable encoder (a token-hashing encoder here) in
    mapInPandas, then closed-form similarity moments per (model, topic)."""
    from ..operators import text_vectors
    a = views.answers(spark, sf_dir).select("model", "topic", "persona_id", "response")
    enc = text_vectors.encode(a, lambda: text_vectors.hashing_encoder(64))
    return moments.group_moments(enc).select("model", "topic", "n", "pairs", "mean_similarity",
                                             "std_similarity")


@register("persona_order", oracle(_sql("""
SELECT model, topic, persona_id,
  CAST(row_number() OVER (PARTITION BY model, topic ORDER BY persona_id) AS BIGINT) AS pos
FROM u WHERE experiment = 'main'"""), ["model", "topic", "persona_id", "pos"]), ["W9"])
def q_persona_order(spark, sf_dir):
    """Position of every persona id in its group's sorted id list (no group is collected)."""
    from ..operators.grid import grouped_index
    o = main_obs(spark, sf_dir).select("model", "topic", "persona_id")
    return grouped_index(o, ["model", "topic"], ["persona_id"], "pos")

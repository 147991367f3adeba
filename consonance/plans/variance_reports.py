"""Control versus main experiment: variance, comparison, zones, rankings.

Input: the ``obs`` view with both experiments. Oracle: a DuckDB pair join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import moments, variance
from ..session import checkpoint_dir
from . import views
from .registry import oracle, register
from .similarity_reports import _sql

# per (model, topic, experiment): n, pairs, mean, std, sums (pair-join definition)
MOM = """, mom AS (
  SELECT g.model, g.topic, g.experiment, g.n, CAST(g.n * (g.n - 1) / 2 AS BIGINT) AS pairs,
         avg(ps.similarity) AS mean_similarity, stddev_pop(ps.similarity) AS std_similarity,
         coalesce(sum(ps.similarity), 0.0) AS sum_s, coalesce(sum(ps.similarity * ps.similarity), 0.0) AS sum_s2
  FROM grp g LEFT JOIN ps ON g.model = ps.model AND g.topic = ps.topic AND g.experiment = ps.experiment
  GROUP BY g.model, g.topic, g.experiment, g.n),
cvar AS (
  SELECT m.model, m.mean_similarity, m.std_similarity, CAST(m.n AS BIGINT) AS num_reps FROM mom m
  JOIN (SELECT model, min(topic) AS topic FROM mom WHERE experiment = 'control' GROUP BY model) f
    ON m.model = f.model AND m.topic = f.topic
  WHERE m.experiment = 'control' AND m.n > 1),
pvar AS (
  SELECT model, avg(mean_similarity) AS mean_similarity, avg(std_similarity) AS std_similarity,
         CAST(count(*) AS BIGINT) AS num_topics, avg(n) AS avg_personas
  FROM mom WHERE experiment = 'main' AND n > 1 GROUP BY model),
pool AS (
  SELECT model,
    sum(CASE WHEN experiment = 'control' THEN pairs ELSE 0 END) AS c_pairs,
    sum(CASE WHEN experiment = 'control' THEN sum_s ELSE 0 END) AS c_sum,
    sum(CASE WHEN experiment = 'control' THEN sum_s2 ELSE 0 END) AS c_sum2,
    sum(CASE WHEN experiment = 'main' THEN pairs ELSE 0 END) AS m_pairs,
    sum(CASE WHEN experiment = 'main' THEN sum_s ELSE 0 END) AS m_sum,
    sum(CASE WHEN experiment = 'main' THEN sum_s2 ELSE 0 END) AS m_sum2
  FROM mom GROUP BY model
  HAVING max(CASE WHEN experiment = 'control' THEN 1 ELSE 0 END) = 1
     AND max(CASE WHEN experiment = 'main' THEN 1 ELSE 0 END) = 1),
comp AS (
  SELECT model,
    CASE WHEN c_pairs > 0 THEN c_sum / c_pairs ELSE 0.0 END AS control_mean,
    CASE WHEN m_pairs > 0 THEN m_sum / m_pairs ELSE 0.0 END AS persona_mean
  FROM pool),
merged AS (
  SELECT c.model, c.mean_similarity AS mean_similarity_control, c.std_similarity AS std_similarity_control,
    c.num_reps, p.mean_similarity AS mean_similarity_persona, p.std_similarity AS std_similarity_persona,
    p.num_topics, p.avg_personas
  FROM cvar c JOIN pvar p ON c.model = p.model)"""


def _moments_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per group; read up to three times by a report, so built once and checkpointed."""
    checkpoint_dir(spark)
    m = moments.group_moments(views.obs(spark, sf_dir), keys=("model", "topic", "experiment"))
    return m.checkpoint(eager=True)


def _cvar(m: DataFrame) -> DataFrame:
    return variance.within_model_variance(m.where(F.col("experiment") == "control"))


def _pvar(m: DataFrame) -> DataFrame:
    return variance.across_persona_variance(m.where(F.col("experiment") == "main"))


@register("within_model_variance", oracle(_sql(MOM + "\nSELECT * FROM cvar"),
    ["model", "mean_similarity", "std_similarity", "num_reps"], ["mean_similarity", "std_similarity"]),
    ["A8", "W13"])
def q_within_model_variance(spark, sf_dir):
    """Control: mean and population std over repetitions of each model's first topic."""
    return _cvar(_moments_both(spark, sf_dir))


@register("across_persona_variance", oracle(_sql(MOM + "\nSELECT * FROM pvar"),
    ["model", "mean_similarity", "std_similarity", "num_topics", "avg_personas"],
    ["mean_similarity", "std_similarity", "avg_personas"]), ["A9"])
def q_across_persona_variance(spark, sf_dir):
    """Main: per-topic mean/std, averaged over topics per model."""
    return _pvar(_moments_both(spark, sf_dir))


@register("variance_merged", oracle(_sql(MOM + """
SELECT *, mean_similarity_persona - mean_similarity_control AS persona_sensitivity,
  mean_similarity_control - mean_similarity_persona AS sensitivity_gap FROM merged"""),
    ["model", "mean_similarity_control", "std_similarity_control", "num_reps", "mean_similarity_persona",
     "std_similarity_persona", "num_topics", "avg_personas", "persona_sensitivity", "sensitivity_gap"],
    ["mean_similarity_control", "std_similarity_control", "mean_similarity_persona",
     "std_similarity_persona", "avg_personas", "persona_sensitivity", "sensitivity_gap"]), ["J12", "P22"])
def q_variance_merged(spark, sf_dir):
    """Control and main variance joined on model, with both sensitivity signs."""
    m = _moments_both(spark, sf_dir)
    return variance.merge_variance(_cvar(m), _pvar(m))


@register("comparison", oracle(_sql(MOM + """
SELECT model, control_mean, persona_mean, control_mean - persona_mean AS sensitivity_gap FROM comp"""),
    ["model", "control_mean", "persona_mean", "sensitivity_gap"],
    ["control_mean", "persona_mean", "sensitivity_gap"]), ["A10", "J13"])
def q_comparison(spark, sf_dir):
    """Pooled control and persona means per model present in both experiments."""
    return variance.comparison(_moments_both(spark, sf_dir))


@register("consistency_variability", oracle(_sql(MOM + """
SELECT model,
  CASE WHEN c_pairs + m_pairs > 0 THEN (c_sum + m_sum) / (c_pairs + m_pairs) ELSE 0.0 END AS avg_similarity,
  CASE WHEN c_pairs + m_pairs > 0 THEN sqrt(greatest((c_sum2 + m_sum2) / (c_pairs + m_pairs)
       - ((c_sum + m_sum) / (c_pairs + m_pairs)) ^ 2, 0.0)) ELSE 0.0 END AS avg_variability,
  (CASE WHEN c_pairs > 0 THEN c_sum / c_pairs ELSE 0.0 END)
   - (CASE WHEN m_pairs > 0 THEN m_sum / m_pairs ELSE 0.0 END) AS sensitivity_gap
FROM pool"""), ["model", "avg_similarity", "avg_variability", "sensitivity_gap"],
    ["avg_similarity", "avg_variability", "sensitivity_gap"]), ["A11", "U4"])
def q_consistency_variability(spark, sf_dir):
    """Mean and population std of all control and persona pair values together."""
    return variance.consistency_variability(_moments_both(spark, sf_dir))


@register("variance_summary", oracle(_sql(MOM + """
SELECT 'control' AS experiment, avg(mean_similarity) AS mean, stddev_samp(mean_similarity) AS std,
  min(mean_similarity) AS min, max(mean_similarity) AS max, CAST(count(mean_similarity) AS BIGINT) AS models
FROM cvar
UNION ALL
SELECT 'main', avg(mean_similarity), stddev_samp(mean_similarity), min(mean_similarity),
  max(mean_similarity), CAST(count(mean_similarity) AS BIGINT) FROM pvar"""),
    ["experiment", "mean", "std", "min", "max", "models"], ["mean", "std", "min", "max"]), ["A21"])
def q_variance_summary(spark, sf_dir):
    """Mean, sample std, min and max of model means, per experiment."""
    m = _moments_both(spark, sf_dir)
    return variance.summary_statistics(_cvar(m), "control").unionByName(
        variance.summary_statistics(_pvar(m), "main"))


@register("headline_difference", oracle(_sql(MOM + """
SELECT c.cm AS control_mean, p.pm AS persona_mean, abs(c.cm - p.pm) AS abs_difference
FROM (SELECT avg(mean_similarity) AS cm FROM cvar) c, (SELECT avg(mean_similarity) AS pm FROM pvar) p"""),
    ["control_mean", "persona_mean", "abs_difference"], ["control_mean", "persona_mean", "abs_difference"]),
    ["A22"])
def q_headline_difference(spark, sf_dir):
    """Absolute difference of the two experiments' mean similarity."""
    m = _moments_both(spark, sf_dir)
    return variance.headline_difference(_cvar(m), _pvar(m))


@register("comparison_medians", oracle(_sql(MOM + """
SELECT median(control_mean) AS control_median, median(persona_mean) AS persona_median FROM comp"""),
    ["control_median", "persona_median"], ["control_median", "persona_median"]), ["A23"])
def q_comparison_medians(spark, sf_dir):
    """Exact medians of pooled control and persona means."""
    return variance.medians(variance.comparison(_moments_both(spark, sf_dir)))


_BOX_SQL = """, vals AS (SELECT 'control' AS series, mean_similarity AS v FROM cvar
  UNION ALL SELECT 'main', mean_similarity FROM pvar),
q AS (SELECT series, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
        quantile_cont(v, 0.75) AS q3, avg(v) AS mean FROM vals GROUP BY series)
SELECT q.series, q1, median, q3, mean,
  min(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_low,
  max(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_high,
  CAST(count(CASE WHEN NOT (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) THEN 1 END) AS BIGINT)
    AS outliers
FROM q JOIN vals ON q.series = vals.series GROUP BY q.series, q1, median, q3, mean"""


@register("variance_box_stats", oracle(_sql(MOM + _BOX_SQL),
    ["series", "q1", "median", "q3", "mean", "whisker_low", "whisker_high", "outliers"],
    ["q1", "median", "q3", "mean", "whisker_low", "whisker_high"]), ["A24"])
def q_variance_box_stats(spark, sf_dir):
    """Box-plot statistics of per-model mean similarity, control and main."""
    m = _moments_both(spark, sf_dir)
    return variance.box_stats(_cvar(m), "mean_similarity", "control").unionByName(
        variance.box_stats(_pvar(m), "mean_similarity", "main"))


@register("variance_metric_table", oracle(_sql(MOM + """
SELECT model, metric, value FROM (
  SELECT model, 'control_mean' AS metric, mean_similarity_control AS value FROM merged UNION ALL
  SELECT model, 'control_std', std_similarity_control FROM merged UNION ALL
  SELECT model, 'persona_mean', mean_similarity_persona FROM merged UNION ALL
  SELECT model, 'persona_std', std_similarity_persona FROM merged)"""),
    ["model", "metric", "value"], ["value"]), ["A26"])
def q_variance_metric_table(spark, sf_dir):
    """Control/persona mean and std per model, unpivoted to (model, metric, value)."""
    m = _moments_both(spark, sf_dir)
    return variance.metric_table(variance.merge_variance(_cvar(m), _pvar(m)), long=True)


@register("behaviour_zones", oracle(_sql(MOM + """, med AS (
  SELECT median(control_mean) AS cmed, median(persona_mean) AS pmed FROM comp)
SELECT model, control_mean, persona_mean, control_mean - persona_mean AS sensitivity_gap,
  concat(CASE WHEN control_mean > cmed THEN 'hi' ELSE 'lo' END, '_',
         CASE WHEN persona_mean > pmed THEN 'hi' ELSE 'lo' END) AS zone,
  control_mean > cmed AND NOT (persona_mean > pmed) AS is_ideal,
  CASE WHEN control_mean - persona_mean > 0 THEN 'persona-aware' ELSE 'persona-agnostic' END AS persona_label
FROM comp, med"""), ["model", "control_mean", "persona_mean", "sensitivity_gap", "zone", "is_ideal",
                     "persona_label"], ["control_mean", "persona_mean", "sensitivity_gap"]),
    ["P23", "P24"])
def q_behaviour_zones(spark, sf_dir):
    """Zone of each model against the medians, ideal flag and persona label."""
    return variance.zones(variance.comparison(_moments_both(spark, sf_dir)))


@register("sensitivity_ranking", oracle(_sql(MOM + """
SELECT model, regexp_extract(model, '[^/]*$') AS label, control_mean - persona_mean AS sensitivity_gap,
  CASE WHEN control_mean - persona_mean > 0 THEN 'persona-aware' ELSE 'persona-agnostic' END AS persona_label,
  CAST(row_number() OVER (ORDER BY control_mean - persona_mean, model) AS BIGINT) AS rank FROM comp"""),
    ["model", "label", "sensitivity_gap", "persona_label", "rank"], ["sensitivity_gap"]), ["W5", "P11"])
def q_sensitivity_ranking(spark, sf_dir):
    """Models ranked by sensitivity gap, ascending."""
    return variance.sensitivity_ranking(variance.comparison(_moments_both(spark, sf_dir)))


@register("top5_consistent", oracle(_sql(MOM + """
SELECT model, mean_similarity, std_similarity, CAST(rank AS BIGINT) AS rank FROM (
  SELECT model, mean_similarity, std_similarity,
    row_number() OVER (ORDER BY mean_similarity DESC, model) AS rank FROM cvar) WHERE rank <= 5"""),
    ["model", "mean_similarity", "std_similarity", "rank"], ["mean_similarity", "std_similarity"]), ["W4"])
def q_top5_consistent(spark, sf_dir):
    """Top 5 most internally consistent models (highest control similarity)."""
    cv = _cvar(_moments_both(spark, sf_dir)).select("model", "mean_similarity", "std_similarity")
    return variance.top_k_by(cv, "mean_similarity", 5)


@register("top_persona_minus_control", oracle(_sql(MOM + """
SELECT model, mean_similarity_persona, mean_similarity_control, persona_sensitivity, CAST(rank AS BIGINT) AS rank
FROM (SELECT model, mean_similarity_persona, mean_similarity_control,
        mean_similarity_persona - mean_similarity_control AS persona_sensitivity,
        row_number() OVER (ORDER BY mean_similarity_persona - mean_similarity_control DESC, model) AS rank
      FROM merged) WHERE rank <= 5"""),
    ["model", "mean_similarity_persona", "mean_similarity_control", "persona_sensitivity", "rank"],
    ["mean_similarity_persona", "mean_similarity_control", "persona_sensitivity"]), ["W4", "P22"])
def q_top_persona_minus_control(spark, sf_dir):
    """Top 5 by persona - control mean (the report's 'most persona-sensitive')."""
    m = _moments_both(spark, sf_dir)
    mg = variance.merge_variance(_cvar(m), _pvar(m)).select(
        "model", "mean_similarity_persona", "mean_similarity_control", "persona_sensitivity")
    return variance.top_k_by(mg, "persona_sensitivity", 5)


@register("variability_extremes", oracle(_sql(MOM + """, cv AS (
  SELECT model, CASE WHEN c_pairs + m_pairs > 0 THEN (c_sum + m_sum) / (c_pairs + m_pairs) ELSE 0.0 END AS avg_similarity,
    CASE WHEN c_pairs + m_pairs > 0 THEN sqrt(greatest((c_sum2 + m_sum2) / (c_pairs + m_pairs)
       - ((c_sum + m_sum) / (c_pairs + m_pairs)) ^ 2, 0.0)) ELSE 0.0 END AS avg_variability,
    (CASE WHEN c_pairs > 0 THEN c_sum / c_pairs ELSE 0.0 END)
     - (CASE WHEN m_pairs > 0 THEN m_sum / m_pairs ELSE 0.0 END) AS sensitivity_gap FROM pool)
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY avg_variability, model) AS BIGINT) AS rank,
    'least_variable' AS side FROM cv) WHERE rank <= 3
UNION ALL
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY avg_variability DESC, model) AS BIGINT) AS rank,
    'most_variable' AS side FROM cv) WHERE rank <= 3"""),
    ["model", "avg_similarity", "avg_variability", "sensitivity_gap", "rank", "side"],
    ["avg_similarity", "avg_variability", "sensitivity_gap"]), ["W8"])
def q_variability_extremes(spark, sf_dir):
    """The 3 least and 3 most variable models."""
    return variance.variability_extremes(variance.consistency_variability(_moments_both(spark, sf_dir)))


@register("stacked_variance", oracle(_sql(MOM + """
SELECT model, mean_similarity AS similarity, std_similarity, num_reps AS n_units,
  CAST(NULL AS DOUBLE) AS avg_personas, 'Control (Within-Model)' AS experiment FROM cvar
UNION ALL
SELECT model, mean_similarity, std_similarity, num_topics, avg_personas, 'Main (Across-Persona)' FROM pvar"""),
    ["model", "similarity", "std_similarity", "n_units", "avg_personas", "experiment"],
    ["similarity", "std_similarity", "avg_personas"]), ["P27", "U4"])
def q_stacked_variance(spark, sf_dir):
    """Both variance tables tagged with their experiment and stacked."""
    m = _moments_both(spark, sf_dir)
    return variance.stacked_variance(_cvar(m), _pvar(m)).select(
        "model", "similarity", "std_similarity", "n_units", "avg_personas", "experiment")


_CV_SQL = """, cv AS (
  SELECT model, CASE WHEN c_pairs + m_pairs > 0 THEN (c_sum + m_sum) / (c_pairs + m_pairs) ELSE 0.0 END AS avg_similarity,
    CASE WHEN c_pairs + m_pairs > 0 THEN sqrt(greatest((c_sum2 + m_sum2) / (c_pairs + m_pairs)
       - ((c_sum + m_sum) / (c_pairs + m_pairs)) ^ 2, 0.0)) ELSE 0.0 END AS avg_variability,
    (CASE WHEN c_pairs > 0 THEN c_sum / c_pairs ELSE 0.0 END)
     - (CASE WHEN m_pairs > 0 THEN m_sum / m_pairs ELSE 0.0 END) AS sensitivity_gap FROM pool),
bx AS (WITH""" + _BOX_SQL[1:] + """),
med AS (SELECT median(control_mean) AS cmed, median(persona_mean) AS pmed FROM comp)"""

# (table, key column, numeric fields, text fields), each with its SQL relation
_TABLES = {
    "comparison": ("model", ["control_mean", "persona_mean", "sensitivity_gap"], [],
                   "(SELECT *, control_mean - persona_mean AS sensitivity_gap FROM comp)"),
    "consistency_variability": ("model", ["avg_similarity", "avg_variability", "sensitivity_gap"], [], "cv"),
    "zones": ("model", ["control_mean", "persona_mean", "sensitivity_gap"], ["zone", "is_ideal", "persona_label"],
              """(SELECT model, control_mean, persona_mean, control_mean - persona_mean AS sensitivity_gap,
  concat(CASE WHEN control_mean > cmed THEN 'hi' ELSE 'lo' END, '_', CASE WHEN persona_mean > pmed THEN 'hi' ELSE 'lo' END) AS zone,
  control_mean > cmed AND NOT (persona_mean > pmed) AS is_ideal,
  CASE WHEN control_mean - persona_mean > 0 THEN 'persona-aware' ELSE 'persona-agnostic' END AS persona_label FROM comp, med)"""),
    "sensitivity_ranking": ("model", ["sensitivity_gap", "rank"], ["label", "persona_label"],
                            """(SELECT model, regexp_extract(model, '[^/]*$') AS label, control_mean - persona_mean AS sensitivity_gap,
  CASE WHEN control_mean - persona_mean > 0 THEN 'persona-aware' ELSE 'persona-agnostic' END AS persona_label,
  row_number() OVER (ORDER BY control_mean - persona_mean, model) AS rank FROM comp)"""),
    "box_stats": ("series", ["q1", "median", "q3", "mean", "whisker_low", "whisker_high", "outliers"], [], "bx"),
    "metric_table": ("concat(model, ' ', metric)", ["value"], [],
                     """(SELECT model, 'control_mean' AS metric, mean_similarity_control AS value FROM merged
  UNION ALL SELECT model, 'control_std', std_similarity_control FROM merged
  UNION ALL SELECT model, 'persona_mean', mean_similarity_persona FROM merged
  UNION ALL SELECT model, 'persona_std', std_similarity_persona FROM merged)"""),
}


def _table_values_sql() -> str:
    parts = []
    for name, (key, nums, texts, rel) in _TABLES.items():
        parts += [f"SELECT '{name}' AS tab, {key} AS row_key, '{c}' AS field, CAST({c} AS DOUBLE) AS num,"
                  f" CAST(NULL AS VARCHAR) AS txt FROM {rel}" for c in nums]
        parts += [f"SELECT '{name}', {key}, '{c}', NULL, CAST({c} AS VARCHAR) FROM {rel}" for c in texts]
    return oracle(_sql(MOM + _CV_SQL + "\n" + "\nUNION ALL ".join(parts)),
                  ["tab", "row_key", "field", "num", "txt"], ["num"])


@register("comparison_tables", oracle(_sql(MOM + _CV_SQL + "\n" + "\nUNION ALL ".join(
    f"SELECT '{name}' AS \"table\", CAST(count(*) AS BIGINT) AS \"rows\" FROM {rel}"
    for name, (_k, _n, _t, rel) in _TABLES.items())), ['"table"', '"rows"']), ["R7"])
def q_comparison_tables(spark, sf_dir):
    """All chart-ready comparison tables built in one call; one row per table with its size."""
    tables = variance.comparison_tables(_moments_both(spark, sf_dir))
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


@register("comparison_table_values", _table_values_sql, ["R7"])
def q_comparison_table_values(spark, sf_dir):
    """Every value of every chart-ready table, one row per (table, row, field)."""
    tables = variance.comparison_tables(_moments_both(spark, sf_dir))
    out = None
    for name, df in tables.items():
        key, nums, texts, _rel = _TABLES[name]
        cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("num"),
                                   F.lit(None).cast("string").alias("txt")) for c in nums],
                        *[F.struct(F.lit(c).alias("field"), F.lit(None).cast("double").alias("num"),
                                   F.col(c).cast("string").alias("txt")) for c in texts])
        part = df.select(F.lit(name).alias("tab"), F.expr(key).alias("row_key"), F.inline(cells))
        out = part if out is None else out.unionByName(part)
    return out

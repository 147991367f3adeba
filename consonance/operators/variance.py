"""Control (within-model) versus main (across-persona) variance tables.

Everything starts from group moments carrying an ``experiment`` column
('control' or 'main'); the pooled tables add up pair sums, never pairs.
Model-grain tables are as small as the model list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_topic(moments: DataFrame) -> DataFrame:
    """The first topic of each model (smallest name): (model, topic)."""
    return moments.groupBy("model").agg(F.min("topic").alias("topic"))


def within_model_variance(control_moments: DataFrame, topic: str | None = None) -> DataFrame:
    """Control experiment: per model, mean/std of one topic's similarity, num_reps.

    Uses ``topic`` when given, else each model's first topic by name. Groups
    with n <= 1 are skipped.
    """
    m = control_moments
    if topic is None:
        m = m.join(first_topic(m), ["model", "topic"], "left_semi")
    else:
        m = m.where(F.col("topic") == topic)
    return (m.where(F.col("n") > 1)
             .select("model", "mean_similarity", "std_similarity",
                     F.col("n").alias("num_reps")))


def across_persona_variance(main_moments: DataFrame) -> DataFrame:
    """Main experiment: per-topic mean/std (n > 1), then a plain mean over topics."""
    m = main_moments.where(F.col("n") > 1)
    return m.groupBy("model").agg(
        F.avg("mean_similarity").alias("mean_similarity"),
        F.avg("std_similarity").alias("std_similarity"),
        F.count(F.lit(1)).alias("num_topics"),
        F.avg("n").alias("avg_personas"))


def merge_variance(control_var: DataFrame, persona_var: DataFrame) -> DataFrame:
    """Inner join on model with _control/_persona suffixes, plus both gap signs.

    ``persona_sensitivity`` = persona - control (the report's sign) and
    ``sensitivity_gap`` = control - persona (the comparison table's sign).
    """
    c = control_var.select("model", *[F.col(x).alias(f"{x}_control") for x in
                                      ("mean_similarity", "std_similarity")], "num_reps")
    p = persona_var.select("model", *[F.col(x).alias(f"{x}_persona") for x in
                                      ("mean_similarity", "std_similarity")],
                           "num_topics", "avg_personas")
    j = c.join(p, "model", "inner")
    return j.select("*",
                    (F.col("mean_similarity_persona") - F.col("mean_similarity_control"))
                    .alias("persona_sensitivity"),
                    (F.col("mean_similarity_control") - F.col("mean_similarity_persona"))
                    .alias("sensitivity_gap"))


def tag_experiment(df: DataFrame, label: str, rename: dict[str, str] | None = None) -> DataFrame:
    """Add an ``experiment`` label and rename columns, ready for ``unionByName``."""
    out = df.withColumn("experiment", F.lit(label))
    for old, new in (rename or {}).items():
        out = out.withColumnRenamed(old, new)
    return out


def stacked_variance(control_var: DataFrame, persona_var: DataFrame) -> DataFrame:
    """Both variance tables stacked with an experiment label (long form).

    ``n_units`` is num_reps for control rows and num_topics for main rows.
    """
    ren = {"mean_similarity": "similarity"}
    c = tag_experiment(control_var, "Control (Within-Model)",
                       {**ren, "num_reps": "n_units"}).withColumn(
        "avg_personas", F.lit(None).cast("double"))
    p = tag_experiment(persona_var, "Main (Across-Persona)", {**ren, "num_topics": "n_units"})
    return c.unionByName(p)


def _pooled_by_experiment(moments: DataFrame) -> DataFrame:
    """Per model: pooled pair count, sum and sum of squares per experiment."""
    is_c = F.col("experiment") == "control"
    is_m = F.col("experiment") == "main"
    return moments.groupBy("model").agg(
        F.max(is_c.cast("int")).alias("_has_c"), F.max(is_m.cast("int")).alias("_has_m"),
        F.sum(F.when(is_c, F.col("pairs")).otherwise(0)).alias("c_pairs"),
        F.sum(F.when(is_c, F.col("sum_s")).otherwise(0.0)).alias("c_sum"),
        F.sum(F.when(is_c, F.col("sum_s2")).otherwise(0.0)).alias("c_sum2"),
        F.sum(F.when(is_m, F.col("pairs")).otherwise(0)).alias("m_pairs"),
        F.sum(F.when(is_m, F.col("sum_s")).otherwise(0.0)).alias("m_sum"),
        F.sum(F.when(is_m, F.col("sum_s2")).otherwise(0.0)).alias("m_sum2"),
    ).where((F.col("_has_c") == 1) & (F.col("_has_m") == 1))


def _safe_mean(total, count):
    return F.when(count > 0, total / count).otherwise(F.lit(0.0))


def comparison(moments: DataFrame) -> DataFrame:
    """Pooled comparison per model present in both experiments.

    control_mean / persona_mean: mean over every upper-triangle value of every
    topic of that experiment (0.0 for an empty pool); sensitivity_gap =
    control_mean - persona_mean.
    """
    p = _pooled_by_experiment(moments)
    cm = _safe_mean(F.col("c_sum"), F.col("c_pairs"))
    pm = _safe_mean(F.col("m_sum"), F.col("m_pairs"))
    return p.select("model", cm.alias("control_mean"), pm.alias("persona_mean"),
                    (cm - pm).alias("sensitivity_gap"))


def consistency_variability(moments: DataFrame) -> DataFrame:
    """Mean and population std of control and persona values pooled together."""
    p = _pooled_by_experiment(moments)
    n = F.col("c_pairs") + F.col("m_pairs")
    tot = F.col("c_sum") + F.col("m_sum")
    tot2 = F.col("c_sum2") + F.col("m_sum2")
    mean = _safe_mean(tot, n)
    var = F.greatest(F.when(n > 0, tot2 / n - (tot / n) * (tot / n)).otherwise(0.0), F.lit(0.0))
    cm = _safe_mean(F.col("c_sum"), F.col("c_pairs"))
    pm = _safe_mean(F.col("m_sum"), F.col("m_pairs"))
    return p.select("model", mean.alias("avg_similarity"), F.sqrt(var).alias("avg_variability"),
                    (cm - pm).alias("sensitivity_gap"))


def summary_statistics(var_table: DataFrame, experiment: str) -> DataFrame:
    """Mean, sample std, min and max of per-model mean similarity."""
    x = F.col("mean_similarity")
    return var_table.agg(F.lit(experiment).alias("experiment"),
                         F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                         F.min(x).alias("min"), F.max(x).alias("max"),
                         F.count(x).alias("models"))


def headline_difference(control_var: DataFrame, persona_var: DataFrame) -> DataFrame:
    """|mean of control model means - mean of persona model means|."""
    c = control_var.agg(F.avg("mean_similarity").alias("control_mean"))
    p = persona_var.agg(F.avg("mean_similarity")).scalar()  # scalar subquery
    return c.select("control_mean", p.alias("persona_mean"),
                    F.abs(F.col("control_mean") - p).alias("abs_difference"))


def medians(comp: DataFrame) -> DataFrame:
    """Exact medians of control_mean and persona_mean over models."""
    return comp.agg(F.median("control_mean").alias("control_median"),
                    F.median("persona_mean").alias("persona_median"))


def zones(comp: DataFrame) -> DataFrame:
    """Behaviour zone by the two medians, persona-aware label and ideal flag.

    ``zone`` names control level then persona level (hi/lo against the
    medians, ties count as lo). ``is_ideal``: control above its median and
    persona at or below its median.
    """
    # the medians are scalar subqueries over the (model-grain) comparison table
    c_med = comp.agg(F.median("control_mean")).scalar()
    p_med = comp.agg(F.median("persona_mean")).scalar()
    j = comp
    c_hi = F.col("control_mean") > c_med
    p_hi = F.col("persona_mean") > p_med
    zone = F.concat(F.when(c_hi, "hi").otherwise("lo"), F.lit("_"),
                    F.when(p_hi, "hi").otherwise("lo"))
    return j.select("model", "control_mean", "persona_mean", "sensitivity_gap",
                    zone.alias("zone"), (c_hi & ~p_hi).alias("is_ideal"),
                    persona_label(F.col("sensitivity_gap")).alias("persona_label"))


def persona_label(gap: F.Column) -> F.Column:
    """'persona-aware' when control - persona > 0, else 'persona-agnostic'."""
    return F.when(gap > 0, "persona-aware").otherwise("persona-agnostic")


def sensitivity_ranking(comp: DataFrame) -> DataFrame:
    """Models ordered by sensitivity_gap ascending, with rank and short label."""
    w = Window.orderBy(F.asc("sensitivity_gap"), F.asc("model"))
    return comp.select("model", F.substring_index("model", "/", -1).alias("label"),
                       "sensitivity_gap", persona_label(F.col("sensitivity_gap")).alias("persona_label"),
                       F.row_number().over(w).cast("long").alias("rank"))


def box_stats(values: DataFrame, col: str, label: str) -> DataFrame:
    """Quartiles (linear interpolation), mean and 1.5 IQR whiskers of ``col``."""
    x = F.col(col)
    q1 = values.agg(F.percentile(x, 0.25)).scalar()
    q3 = values.agg(F.percentile(x, 0.75)).scalar()
    iqr = q3 - q1
    inside = (x >= q1 - 1.5 * iqr) & (x <= q3 + 1.5 * iqr)
    return values.agg(
        F.lit(label).alias("series"), F.percentile(x, 0.25).alias("q1"),
        F.median(x).alias("median"), F.percentile(x, 0.75).alias("q3"), F.avg(x).alias("mean"),
        F.min(F.when(inside, x)).alias("whisker_low"),
        F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(~inside).cast("long").alias("outliers"))


def metric_table(merged: DataFrame, long: bool = False) -> DataFrame:
    """Control mean/std and persona mean/std per model; ``long`` unpivots it."""
    wide = merged.select("model",
                         F.col("mean_similarity_control").alias("control_mean"),
                         F.col("std_similarity_control").alias("control_std"),
                         F.col("mean_similarity_persona").alias("persona_mean"),
                         F.col("std_similarity_persona").alias("persona_std"))
    if not long:
        return wide
    return wide.unpivot("model", ["control_mean", "control_std", "persona_mean", "persona_std"],
                        "metric", "value")


def top_k_by(df: DataFrame, score: str, k: int, ascending: bool = False) -> DataFrame:
    """The k rows with the largest (or smallest) ``score``, ties by model, ranked."""
    order = [F.asc(score) if ascending else F.desc(score), F.asc("model")]
    best = df.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def variability_extremes(cv: DataFrame, k: int = 3) -> DataFrame:
    """The k least and k most variable models by avg_variability."""
    least = top_k_by(cv, "avg_variability", k, ascending=True).withColumn("side", F.lit("least_variable"))
    most = top_k_by(cv, "avg_variability", k).withColumn("side", F.lit("most_variable"))
    return least.unionByName(most)


def comparison_tables(moments: DataFrame, control_var: DataFrame | None = None,
                      persona_var: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every chart-ready comparison table from one moments table (both experiments).

    comparison, consistency_variability, zones, sensitivity_ranking,
    box_stats (control and main) and metric_table (long form).
    """
    cv = control_var if control_var is not None else within_model_variance(
        moments.where(F.col("experiment") == "control"))
    pv = persona_var if persona_var is not None else across_persona_variance(
        moments.where(F.col("experiment") == "main"))
    comp = comparison(moments)
    return {
        "comparison": comp,
        "consistency_variability": consistency_variability(moments),
        "zones": zones(comp),
        "sensitivity_ranking": sensitivity_ranking(comp),
        "box_stats": box_stats(cv, "mean_similarity", "control").unionByName(
            box_stats(pv, "mean_similarity", "main")),
        "metric_table": metric_table(merge_variance(cv, pv), long=True),
    }

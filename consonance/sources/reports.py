"""Small final tables to CSV and text reports.

Reports are built as DataFrames of (section, line_no, text) from aggregate
tables (model- or topic-grain, i.e. small) and written as one text file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_csv(small: DataFrame, path: str) -> None:
    """One CSV file with a header; meant for final model/topic-grain tables."""
    small.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _lines(df: DataFrame, section: str, text: F.Column, order: list, offset: int = 0) -> DataFrame:
    w = Window.orderBy(*order)
    return df.select(F.lit(section).alias("section"),
                     (F.row_number().over(w) + offset).cast("int").alias("line_no"), text.alias("text"))


def _title(section: str, *texts: str) -> DataFrame:
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(section, i, t) for i, t in enumerate(texts)], "section string, line_no int, text string")


def benchmark_summary(benchmark: DataFrame, model_weighted: DataFrame, topic_weighted: DataFrame,
                      k: int = 5) -> DataFrame:
    """Benchmark line and the top-k models and topics (a text report table)."""
    b = benchmark.select(F.lit("1_benchmark").alias("section"), F.lit(0).alias("line_no"),
                         F.format_string("Benchmark (mean of models' weighted means): %.6f",
                                         F.col("benchmark")).alias("text"))
    mo = [F.desc_nulls_last("weighted_mean_similarity"), F.asc("model")]
    m = _lines(model_weighted.orderBy(*mo).limit(k), "2_top_models",
               F.format_string("%s  %.6f  topics=%d  pairs=%d", "model", "weighted_mean_similarity",
                               "topics_count", "total_pairs"), mo)
    to = [F.desc_nulls_last("response_weighted_topic_consistency"), F.asc("topic")]
    t = _lines(topic_weighted.orderBy(*to).limit(k), "3_top_topics",
               F.format_string("%s  %.6f  models=%d  pairs=%d", "topic", "response_weighted_topic_consistency",
                               "models_contributing", "total_response_pairs"), to)
    return b.unionByName(m).unionByName(t)


def variance_report(control_var: DataFrame, persona_var: DataFrame, merged: DataFrame, k: int = 5) -> DataFrame:
    """Summary statistics per experiment, top-k consistent and top-k persona-minus-control."""
    def stats(df, section, label):
        x = F.col("mean_similarity")
        a = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.min(x).alias("lo"), F.max(x).alias("hi"))
        return a.select(F.lit(section).alias("section"), F.lit(0).alias("line_no"),
                        F.format_string(label + ": mean %.4f, std %.4f, min %.4f, max %.4f",
                                        "m", "s", "lo", "hi").alias("text"))

    c = stats(control_var, "1_control", "Control (within-model) similarity across models")
    p = stats(persona_var, "2_persona", "Persona (across-persona) similarity across models")
    co = [F.desc("mean_similarity"), F.asc("model")]
    top_c = _lines(control_var.orderBy(*co).limit(k), "3_most_consistent",
                   F.format_string("%s: %.4f (std: %.4f)", "model", "mean_similarity", "std_similarity"), co)
    po = [F.desc("persona_sensitivity"), F.asc("model")]
    top_p = _lines(merged.orderBy(*po).limit(k), "4_persona_minus_control",
                   F.format_string("%s: Persona=%.4f, Control=%.4f, Diff=%.4f", "model",
                                   "mean_similarity_persona", "mean_similarity_control", "persona_sensitivity"), po)
    return c.unionByName(p).unionByName(top_c).unionByName(top_p)


def analysis_summary(negatives: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """Grand totals: groups, groups with negative pairs, negative pairs, clusters found."""
    n = negatives.agg(F.count(F.lit(1)).alias("groups"), F.count_if("has_negative").alias("neg_groups"),
                      F.sum("negative_count").alias("neg_pairs"))
    out = n.select(F.lit("1_negatives").alias("section"), F.lit(0).alias("line_no"),
                   F.format_string("groups %d, groups with negative pairs %d, negative pairs %d",
                                   "groups", "neg_groups", "neg_pairs").alias("text"))
    if choices is not None:
        c = choices.agg(F.count(F.lit(1)).alias("g"), F.sum("optimal_clusters").alias("k"))
        out = out.unionByName(c.select(F.lit("2_clusters").alias("section"), F.lit(0).alias("line_no"),
                                       F.format_string("groups clustered %d, clusters in total %d", "g", "k")
                                       .alias("text")))
    return out


def write_report(lines: DataFrame, path: str) -> None:
    """The report as one text file, sections and lines in order."""
    lines.orderBy("section", "line_no").select("text").coalesce(1).write.mode("overwrite").text(path)

"""Central analysis: per-group means, pair-weighted roll-ups, benchmark, rankings.

All tables derive from the group moments (``operators.moments``); no pair is
formed. The three weighted tables are three grains of one weighted mean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_model_per_topic(moments: DataFrame) -> DataFrame:
    """model, topic, mean_response_similarity (NULL when n <= 1), pair_count."""
    return moments.select(
        "model", "topic",
        F.col("mean_similarity").alias("mean_response_similarity"),
        F.col("pairs").alias("pair_count"))


def _weighted(ppt: DataFrame, by: str, mean_name: str, count_name: str,
              pairs_name: str) -> DataFrame:
    x, w = F.col("mean_response_similarity"), F.col("pair_count")
    ok = x.isNotNull() & ~F.isnan(x) & (w > 0)
    return ppt.groupBy(by).agg(
        (F.sum(F.when(ok, x * w)) / F.sum(F.when(ok, w))).alias(mean_name),
        F.count_if(ok).cast("long").alias(count_name),
        F.coalesce(F.sum(F.when(ok, w)), F.lit(0)).cast("long").alias(pairs_name))


def model_overall_weighted(ppt: DataFrame) -> DataFrame:
    """Pair-weighted mean per model over its topics; rows with no pairs ignored."""
    return _weighted(ppt, "model", "weighted_mean_similarity", "topics_count", "total_pairs")


def topic_across_models_weighted(ppt: DataFrame) -> DataFrame:
    """Pair-weighted mean per topic over the models that answered it."""
    return _weighted(ppt, "topic", "response_weighted_topic_consistency",
                     "models_contributing", "total_response_pairs")


def benchmark(model_weighted: DataFrame) -> DataFrame:
    """Arithmetic mean of the models' weighted means (NULLs skipped)."""
    return model_weighted.agg(F.avg("weighted_mean_similarity").alias("benchmark"))


def avg_scores(moments: DataFrame) -> DataFrame:
    """Average similarity per model per topic (NULL for a group with n <= 1)."""
    return moments.select("model", "topic", F.col("mean_similarity").alias("avg_similarity"))


def overall_leaderboard(scores: DataFrame) -> DataFrame:
    """Plain mean of a model's topic scores (0.0 when it has none), ranked.

    The ranking is a window over one row per model: the table is as small as
    the model list.
    """
    per_model = scores.groupBy("model").agg(
        F.coalesce(F.avg("avg_similarity"), F.lit(0.0)).alias("overall_similarity"))
    w = Window.orderBy(F.desc("overall_similarity"), F.asc("model"))
    return per_model.withColumn("rank", F.row_number().over(w).cast("long"))


def topic_model_ranks(scores: DataFrame) -> DataFrame:
    """Rank the models inside each topic by average similarity, best first.

    Ranks whatever (model, topic) rows exist; NULL scores rank last.
    """
    w = Window.partitionBy("topic").orderBy(F.desc_nulls_last("avg_similarity"), F.asc("model"))
    return scores.withColumn("rank", F.row_number().over(w).cast("long"))


def top_k(df: DataFrame, score: str, name: str, k: int = 5) -> DataFrame:
    """The k best rows by ``score`` (descending, NULLs last, ties by ``name``)."""
    order = [F.desc_nulls_last(score), F.asc(name)]
    # orderBy+limit plans a distributed take-ordered; the window then sees k rows
    best = df.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))

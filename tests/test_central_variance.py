"""Weighted, plain and pooled means; variance tables; ranking ties."""

import pytest
from pyspark.sql import functions as F

from consonance.operators import central, moments, variance

M_SCHEMA = "model string, topic string, experiment string, n long, pairs long, sum_s double, sum_s2 double"


def mom(spark, rows):
    df = spark.createDataFrame(rows, M_SCHEMA)
    mean = F.when(F.col("pairs") > 0, F.col("sum_s") / F.col("pairs"))
    var = F.col("sum_s2") / F.col("pairs") - mean * mean
    return df.withColumn("mean_similarity", mean).withColumn(
        "std_similarity", F.when(F.col("pairs") > 0, F.sqrt(F.greatest(var, F.lit(0.0)))))


def test_four_averages_differ_with_unequal_groups(spark):
    # group a: n=2 (1 pair, mean 0.9); group b: n=10 (45 pairs, mean 0.1)
    m = mom(spark, [("m", "a", "main", 2, 1, 0.9, 0.81), ("m", "b", "main", 10, 45, 4.5, 0.9)])
    ppt = central.per_model_per_topic(m)
    w = central.model_overall_weighted(ppt).collect()[0]
    assert w["weighted_mean_similarity"] == pytest.approx((0.9 + 4.5) / 46)
    assert w["topics_count"] == 2 and w["total_pairs"] == 46
    plain = central.overall_leaderboard(central.avg_scores(m)).collect()[0]
    assert plain["overall_similarity"] == pytest.approx((0.9 + 0.1) / 2)


def test_weighted_equals_plain_for_equal_sizes(spark):
    m = mom(spark, [("m", "a", "main", 5, 10, 3.0, 1.0), ("m", "b", "main", 5, 10, 5.0, 3.0)])
    ppt = central.per_model_per_topic(m)
    w = central.model_overall_weighted(ppt).collect()[0]["weighted_mean_similarity"]
    p = central.overall_leaderboard(central.avg_scores(m)).collect()[0]["overall_similarity"]
    assert w == pytest.approx(p)


def test_null_groups_ignored_and_all_null_model(spark):
    m = mom(spark, [("m1", "a", "main", 1, 0, 0.0, 0.0), ("m2", "a", "main", 3, 3, 1.5, 0.9)])
    w = {r["model"]: r for r in central.model_overall_weighted(central.per_model_per_topic(m)).collect()}
    assert w["m1"]["weighted_mean_similarity"] is None and w["m1"]["total_pairs"] == 0
    b = central.benchmark(central.model_overall_weighted(central.per_model_per_topic(m))).collect()[0]
    assert b["benchmark"] == pytest.approx(0.5)


def test_rank_ties_by_name(spark):
    scores = spark.createDataFrame([("b", "t", 0.5), ("a", "t", 0.5), ("c", "t", 0.1)],
                                   "model string, topic string, avg_similarity double")
    r = [x["model"] for x in central.topic_model_ranks(scores).orderBy("rank").collect()]
    assert r == ["a", "b", "c"]
    top = central.top_k(central.overall_leaderboard(scores).select("model", "overall_similarity"),
                        "overall_similarity", "model", 2).orderBy("rank").collect()
    assert [x["model"] for x in top] == ["a", "b"]


def test_variance_and_comparison(spark):
    m = mom(spark, [
        ("m", "ctl", "control", 4, 6, 4.8, 4.0),
        ("m", "t1", "main", 3, 3, 0.6, 0.2),
        ("m", "t2", "main", 1, 0, 0.0, 0.0),
        ("solo", "t1", "main", 3, 3, 0.3, 0.1),
    ])
    cv = variance.within_model_variance(m.where("experiment = 'control'")).collect()
    assert len(cv) == 1 and cv[0]["num_reps"] == 4
    pv = {r["model"]: r for r in variance.across_persona_variance(m.where("experiment = 'main'")).collect()}
    assert pv["m"]["num_topics"] == 1  # n <= 1 skipped
    comp = variance.comparison(m).collect()
    assert [r["model"] for r in comp] == ["m"]  # only models in both experiments
    assert comp[0]["control_mean"] == pytest.approx(0.8)
    assert comp[0]["persona_mean"] == pytest.approx(0.2)
    assert comp[0]["sensitivity_gap"] == pytest.approx(0.6)
    merged = variance.merge_variance(variance.within_model_variance(m.where("experiment = 'control'")),
                                     variance.across_persona_variance(m.where("experiment = 'main'"))).collect()[0]
    assert merged["persona_sensitivity"] == pytest.approx(-merged["sensitivity_gap"])


def test_moments_pooled(spark):
    df = spark.createDataFrame([("m", "a", "1", [1.0, 0.0]), ("m", "a", "2", [1.0, 0.0]),
                                ("m", "b", "3", [0.0, 1.0]), ("m", "b", "4", [0.0, -1.0])],
                               "model string, topic string, persona_id string, embedding array<double>")
    p = moments.pooled(moments.group_moments(df), ["model"]).collect()[0]
    assert p["pairs"] == 2 and p["mean_similarity"] == pytest.approx(0.0)
    assert p["std_similarity"] == pytest.approx(1.0)

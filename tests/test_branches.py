"""Grades per group, error rows of groups, vector lengths across buckets, and the reach of the branch queries."""

import pytest
from pyspark.sql import functions as F

import consonance.plans as plans
from consonance.operators import clusters, coverage, moments

SF = "/root/testdata/sf0.001"
KEYS = "model string, topic string, persona_id string"


def test_grades_by_group(spark):
    tasks = [("m", f"t{i}", p) for p in ("full", "one_bad", "half", "none") for i in range(20)]
    done = [(m, t, p, True) for m, t, p in tasks if p == "full" or (p == "half" and t < "t15")]
    done += [(m, t, p, t != "t3") for m, t, p in tasks if p == "one_bad"]
    done += [("m", "t1", "full", False), ("m", "zz", "full", True), ("m", "t2", "half", None)]
    out = coverage.grades_by(spark.createDataFrame(done, KEYS + ", success boolean"),
                             spark.createDataFrame(tasks + tasks[:3], KEYS), ["persona_id"])
    got = {r["persona_id"]: (r["expected"], r["completed"], r["successful"], r["grade"]) for r in out.collect()}
    n = len({t for _m, t, p in tasks if t < "t15"} | {"t2"})
    assert got == {"full": (20, 20, 20, "PERFECT"), "one_bad": (20, 20, 19, "EXCELLENT"),
                   "half": (20, n, n - 1, "WARNING"), "none": (20, 0, 0, "WARNING")}


def test_groups_without_vectors_are_errors(spark):
    groups = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "model string")
    done = spark.createDataFrame([("a", 3, 7, True)], "model string, optimal_clusters int, negative_count long, has_negative boolean")
    got = {r["model"]: (r["optimal_clusters"], r["negative_count"], r["error"])
           for r in clusters.group_outcomes(groups, done, ["model"]).collect()}
    assert got == {"a": (3, 7, None), "b": (1, 0, clusters.NO_EMBEDDINGS)}


def test_vector_lengths_are_compared_across_buckets(spark):
    rows = [("g", str(i), [1.0, float(i)] if i % 2 else [1.0, 2.0, float(i)]) for i in range(12)]
    df = spark.createDataFrame(rows, "model string, persona_id string, embedding array<double>")
    with pytest.raises(Exception, match="different lengths"):
        moments.group_moments(df, keys=["model"], bucket_rows=1).collect()
    one = moments.group_moments(df.withColumn("embedding", F.expr("CASE WHEN size(embedding) = 2 THEN embedding END")),
                                keys=["model"], bucket_rows=1).collect()[0]
    assert (one["n"], one["nz"]) == (12, 6)


def test_sizes_read_no_vectors(spark, tmp_path):
    spark.createDataFrame([("g", "a", [1.0, 2.0]), ("g", "b", [2.0, 1.0])],
                          "model string, persona_id string, embedding array<double>").write.parquet(str(tmp_path / "v"))
    m = moments.group_moments(spark.read.parquet(str(tmp_path / "v")), keys=["model"])
    plan = m._sc._jvm.PythonSQLUtils.explainString(m._jdf.queryExecution(), "formatted")
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert any("embedding" not in s for s in schemas), schemas


def test_branch_inputs_reach_every_branch(spark):
    q = {n: plans.REGISTRY[n].fn(spark, SF) for n in ("persona_grades", "request_branches", "spec_branches")}
    assert {r["grade"] for r in q["persona_grades"].select("grade").distinct().collect()} == {
        "PERFECT", "EXCELLENT", "COMPLETE", "GOOD", "WARNING"}
    plan = {(r["endpoint"], r["token_field"]) for r in q["request_branches"].collect()}
    assert plan == {("responses", "max_output_tokens"), ("chat/completions", "max_completion_tokens"),
                    ("chat/completions", "max_tokens")}
    assert {r["route"] for r in q["spec_branches"].collect()} == {"openai", "openrouter"}

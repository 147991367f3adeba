"""Grids, dense indexes, missing tasks, merges, last-answer-wins."""

import pytest
from pyspark.sql import functions as F

from consonance.operators import coverage, grid, personas

K = "model string, topic string, persona_id string"


def test_expand_and_grid_order(spark):
    p = spark.createDataFrame([("t1", "1", "x"), ("t1", "2", "y")], "topic string, persona_id string, prompt string")
    m = spark.createDataFrame([("b",), ("a",), ("a",)], "model string")
    g = grid.task_grid(p, m)
    assert g.count() == 4
    b = grid.batch_numbers(g, 3).orderBy("position").collect()
    assert [(r["persona_id"], r["model"], r["batch"]) for r in b] == [
        ("1", "a", 0), ("1", "b", 0), ("2", "a", 0), ("2", "b", 1)]


def test_expand_long_lists(spark):
    """A list beyond the literal limit is joined in blocks; the rows are the same."""
    df = spark.range(3)
    dim = spark.range(10_001).select(F.col("id").cast("string").alias("v"))
    out = grid.expand(df, dim.union(dim), "v")
    assert out.count() == 30_003 and out.distinct().count() == 30_003
    short = dim.where("id < 50")
    key = lambda r: (r["id"], r["v"])
    assert sorted(map(key, grid.expand(df, short, "v", max_values=10).collect())) == sorted(
        map(key, grid.expand(df, short, "v").collect()))


def test_dense_index_many_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("k"))
    idx = grid.dense_index(df, ["k"], "i").collect()
    assert sorted(r["i"] for r in idx) == list(range(1, 1001))
    assert all(r["i"] == r["k"] + 1 for r in idx)


def test_missing_plus_completed_is_expected(spark):
    tasks = spark.createDataFrame([("m", "t", str(i)) for i in range(10)], K)
    done = spark.createDataFrame([("m", "t", str(i), "ans") for i in range(0, 10, 3)], K + ", response string")
    miss = coverage.missing_tasks(tasks, done)
    assert miss.count() + done.count() == tasks.count()
    rep = coverage.missing_report(miss, 5).collect()[0]
    assert rep["missing"] == 6 and rep["first_persona_ids"] == "1,2,4,5,7"
    st = coverage.resume_status(tasks, done).collect()[0]
    assert (st["total"], st["completed"], st["missing"]) == (10, 4, 6)


def test_merge_old_wins_and_idempotent(spark):
    old = spark.createDataFrame([("m", "t", "1", "old")], K + ", response string")
    new = spark.createDataFrame([("m", "t", "1", "new"), ("m", "t", "2", "new2")], K + ", response string")
    got = {r["persona_id"]: r["response"] for r in coverage.merge_results(old, new).collect()}
    assert got == {"1": "old", "2": "new2"}
    once = coverage.merge_results(old, new).select(*K.replace(" string", "").split(", "), "response")
    twice = coverage.merge_results(once, new)
    assert sorted(map(tuple, twice.select("persona_id", "response").collect())) == \
        sorted(map(tuple, once.select("persona_id", "response").collect()))


def test_empty_target_models(spark):
    p = spark.createDataFrame([("t", "1", "x")], "topic string, persona_id string, prompt string")
    done = spark.createDataFrame([], K + ", response string")
    models = spark.createDataFrame([], "model string")
    assert coverage.prompts_missing_for_any_model(p, done, models).count() == 0
    models = spark.createDataFrame([("a",)], "model string")
    assert coverage.prompts_missing_for_any_model(p, done, models).count() == 1


def test_last_answer_wins_order_independent(spark):
    rows = [("m", "t", "1", 1, "first", False), ("m", "t", "1", 3, "third", True), ("m", "t", "1", 2, "second", True)]
    a = spark.createDataFrame(rows, K + ", seq long, response string, success boolean")
    r = coverage.last_answer_wins(a.repartition(3)).collect()
    assert len(r) == 1 and r[0]["response"] == "third"
    caps = coverage.attempt_caps(a, max_retries=1).orderBy("seq").collect()
    assert [c["beyond_cap"] for c in caps] == [False, False, True]


def test_placeholders(spark):
    tasks = spark.createDataFrame([("m", "t", "1"), ("m", "t", "2")], K)
    res = spark.createDataFrame([("m", "t", "1", "ok", True, 3)], K + ", response string, success boolean, tokens int")
    got = {r["persona_id"]: r for r in coverage.fill_placeholders(tasks, res).collect()}
    assert got["2"]["placeholder"] and not got["2"]["success"] and got["2"]["tokens"] == 0
    assert got["2"]["response"].startswith("ERROR: Task failed after all retry attempts.")


def test_control_prompts_need_one_base(spark):
    p = spark.createDataFrame([("t", "7", "x"), ("t", "8", "y")], "topic string, persona_id string, prompt string")
    with pytest.raises(ValueError):
        personas.control_prompts(p, 3).collect()
    one = personas.control_prompts(p.limit(1).where("persona_id = '7'"), 3)
    assert sorted(r["persona_id"] for r in one.collect()) == ["7_rep1", "7_rep2", "7_rep3"]


def test_grouped_index_across_partitions(spark):
    df = spark.range(0, 600, 1, 5).select((F.col("id") % 3).cast("string").alias("g"),
                                          ((F.col("id") * 37) % 600).alias("v"))
    got = grid.grouped_index(df, ["g"], ["v"], "pos").collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append((r["v"], r["pos"]))
    for g, lst in by.items():
        lst.sort()
        assert [p for _, p in lst] == list(range(1, len(lst) + 1))

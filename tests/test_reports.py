"""Text reports and the all-tables comparison call."""

import pytest
from pyspark.sql import functions as F

from consonance.operators import central, moments, variance
from consonance.sources import reports


def _moments(spark):
    rows = []
    import numpy as np
    rng = np.random.default_rng(0)
    for m in ("a/x", "b/y", "c/z"):
        for t, exp, n in (("ctl", "control", 5), ("t1", "main", 4), ("t2", "main", 6)):
            for i in range(n):
                rows.append((m, t, exp, f"{t}{i}", [float(v) for v in rng.normal(size=4)]))
    df = spark.createDataFrame(rows, "model string, topic string, experiment string, persona_id string, "
                                     "embedding array<double>")
    return moments.group_moments(df, keys=("model", "topic", "experiment"))


def test_comparison_tables_all_present(spark):
    tabs = variance.comparison_tables(_moments(spark))
    assert set(tabs) == {"comparison", "consistency_variability", "zones", "sensitivity_ranking",
                         "box_stats", "metric_table"}
    assert tabs["comparison"].count() == 3
    assert tabs["metric_table"].count() == 12
    z = tabs["zones"].collect()
    assert all(r["zone"] in {"hi_hi", "hi_lo", "lo_hi", "lo_lo"} for r in z)
    ranks = [r["rank"] for r in tabs["sensitivity_ranking"].orderBy("rank").collect()]
    assert ranks == [1, 2, 3]


def test_report_lines(spark, tmp_path):
    m = _moments(spark)
    main = m.where(F.col("experiment") == "main")
    ppt = central.per_model_per_topic(main)
    mw = central.model_overall_weighted(ppt)
    lines = reports.benchmark_summary(central.benchmark(mw), mw, central.topic_across_models_weighted(ppt))
    got = lines.orderBy("section", "line_no").collect()
    assert got[0]["text"].startswith("Benchmark (mean of models' weighted means): ")
    assert sum(1 for r in got if r["section"] == "2_top_models") == 3
    cv = variance.within_model_variance(m.where(F.col("experiment") == "control"))
    pv = variance.across_persona_variance(main)
    vr = reports.variance_report(cv, pv, variance.merge_variance(cv, pv)).collect()
    assert any("Persona=" in r["text"] and "Diff=" in r["text"] for r in vr)
    out = str(tmp_path / "rep")
    reports.write_report(lines, out)
    text = "".join(open(p).read() for p in __import__("glob").glob(out + "/part-*"))
    assert text.splitlines()[0].startswith("Benchmark")


def test_request_plans_cover_every_topic(spark):
    import __spark_entry__ as e
    sf = "/root/testdata/sf0.001"
    keys = ["model", "topic", "persona_id"]
    plans, tasks = e.queries()["request_plans"](spark, sf), e.queries()["task_grid"](spark, sf)
    assert sorted(plans.select(keys).collect()) == sorted(tasks.select(keys).collect())
    assert plans.select("topic").distinct().count() > 1
    assert "request_plans" in e.oracle_sql()


def test_main_run_ranking_takes_large_groups_without_pairs(spark, monkeypatch):
    """Pairs of every group of the main run grew with the square of the personas."""
    import functools

    from consonance.operators import central, inference, pairs, text_vectors
    from consonance.plans import inference_reports

    rows = [(m, "t", str(i), f"alpha beta word{i % 3} {m} item{i}", True, 1, False) for m in ("v/a", "v/b") for i in range(9)]
    ans = spark.createDataFrame(rows, "model string, topic string, persona_id string, response string, success boolean, "
                                      "tokens int, placeholder boolean")
    sizes = ans.groupBy("model", "topic").count().withColumnRenamed("count", "n")
    vec = text_vectors.sparse_vectors(text_vectors.tfidf_weights(ans), None)
    m = pairs.pair_moments(vec, vec_col="vec", sparse_dim=1000, sizes=sizes)
    want = {r["model"]: r for r in central.model_overall_weighted(central.per_model_per_topic(m)).collect()}
    monkeypatch.setattr(inference_reports.grid, "task_grid", lambda *a: None)
    monkeypatch.setattr(inference_reports, "_prompts", lambda *a: None)
    monkeypatch.setattr(inference_reports.views, "models", lambda *a: None)
    monkeypatch.setattr(inference, "run_with_retries", lambda *a: None)
    monkeypatch.setattr(inference, "final_answers", lambda *a: ans)
    monkeypatch.setattr(pairs, "pair_moments", None)
    monkeypatch.setattr(text_vectors, "tfidf_similarity_moments",
                        functools.partial(text_vectors.tfidf_similarity_moments, pair_max=5))
    got = {r["model"]: r for r in inference_reports.q_main_run_ranking(spark, "").collect()}
    assert set(got) == set(want) == {"v/a", "v/b"}
    for k, r in got.items():
        for c, v in r.asDict().items():
            assert v == want[k][c] or abs(v - want[k][c]) < 1e-9


def test_personas_are_dealt_out_before_they_multiply(spark, tmp_path):
    """The customer table is one small split; its rows become topics x models tasks each."""
    from pyspark.sql import functions as F

    from consonance.plans import views

    d = str(tmp_path)
    spark.sql("SELECT id AS c_custkey, 0 AS c_nationkey, 'X' AS c_mktsegment, concat('c', id) AS c_name FROM range(200)").coalesce(
        1).write.parquet(f"{d}/customer.parquet")
    spark.sql("SELECT 0 AS n_nationkey, 0 AS n_regionkey, 'N' AS n_name").write.parquet(f"{d}/nation.parquet")
    spark.sql("SELECT 0 AS r_regionkey, 'R' AS r_name").write.parquet(f"{d}/region.parquet")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = views.personas(spark, d)
    assert p.count() == 200 and n > 1 and p.select(F.spark_partition_id()).distinct().count() == n


def test_grouped_answers_give_the_same_documents(spark, tmp_path):
    from pyspark.sql import functions as F

    from consonance.sources import files

    rows = [("m", f"t{i % 2}", str(i), None if i == 7 else f"answer {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "model string, topic string, persona_id string, response string")
    groups = files.answer_groups(df, max_per_doc=10)
    assert groups.count() > 2
    files.write_results_json(groups, str(tmp_path / "a"))
    assert sorted(map(tuple, files.read_results_json(spark, str(tmp_path / "a")).collect()), key=str) == sorted(rows, key=str)
    maps = files.read_results_json(spark, str(tmp_path / "a"), maps=True)
    got = maps.groupBy("model", "topic").agg(F.sum(F.size("answers")).alias("n"), F.min(F.array_min(F.map_values("answers"))).alias("f"))
    assert sorted(map(tuple, got.collect())) == [("m", "t0", 25, "answer 0"), ("m", "t1", 25, "answer 1")]

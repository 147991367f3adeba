"""File round trips, answering rounds and streaming drains."""

import json
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from consonance.operators import coverage, inference
from consonance.sources import files
from consonance.streaming import ingest

K = "model string, topic string, persona_id string"


def test_persona_documents(spark, tmp_path):
    doc = {"rows": [{"row": {"uuid": "abc", "persona": "P", "professional_persona": "Pro", "age": 40,
                             "sports_persona": "drop me"}},
                    {"other": 1},
                    {"row": {"uuid": "def", "persona": "Q"}}]}
    p = tmp_path / "personas.json"
    p.write_text(json.dumps(doc, indent=2))
    e = files.read_persona_entries(spark, str(p))
    assert e.count() == 3
    rows = files.read_personas(spark, str(p)).collect()
    assert [r["uuid"] for r in rows] == ["abc", "def"]
    page = files.persona_page(spark, str(p), 1, 5).collect()
    assert len(page) == 2 and page[0]["row"] is None
    assert files.read_persona_entries(spark, str(tmp_path / "missing.json")).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_single_persona(spark, str(tmp_path / "missing.json"))
    with pytest.raises(ValueError):
        files.read_single_persona(spark, str(p))
    from consonance.operators import personas
    numbered = personas.number_personas(e.select("row_idx", "row")).orderBy("row_idx").collect()
    assert [r["uuid"] for r in numbered] == ["1", None, "2"]
    assert "sports_persona" not in numbered[0].asDict()


def test_results_documents_both_layouts(spark, tmp_path):
    bare = {"m1": {"t": {"1": "a", "0x1f": "b"}}}
    snap = {"metadata": {"stage": "final"}, "performance_metrics": {}, "results": {"m2": {"t": {"2": "c"}}}}
    (tmp_path / "a.json").write_text(json.dumps(bare, indent=2))
    (tmp_path / "b.json").write_text(json.dumps(snap, indent=2))
    rows = files.read_results_json(spark, str(tmp_path), whole_files=True).collect()
    assert sorted((r["model"], r["persona_id"], r["response"]) for r in rows) == [
        ("m1", "0x1f", "b"), ("m1", "1", "a"), ("m2", "2", "c")]


def test_latest_file_tiers(spark, tmp_path):
    d = str(tmp_path)
    ans = spark.createDataFrame([("m", "t", "1", "x")], K + ", response string")
    files.write_results_json(ans, f"{d}/incremental_results_1.json")
    assert files.latest_results_file(spark, d).endswith("incremental_results_1.json")
    time.sleep(0.05)
    files.write_results_json(ans, f"{d}/run_final_1.json")
    assert files.latest_results_file(spark, d).endswith("run_final_1.json")
    files.write_results_json(ans, f"{d}/results_1.json")
    assert files.latest_results_file(spark, d).endswith("results_1.json")
    files.write_results_json(ans, f"{d}/incremental_results_cleaned_2.json")
    assert files.latest_results_file(spark, d, prefer="cleaned").endswith("cleaned_2.json")
    assert files.latest_results_file(spark, str(tmp_path / "none")) is None


def test_retries_recover_and_placeholders(spark):
    tasks = spark.createDataFrame([("vendor/a", "T", str(i), "prompt text") for i in range(20)],
                                  K + ", prompt string")

    def factory():
        def ans(model, topic, pid, prompt, attempt):
            if pid == "3":
                raise RuntimeError("connection refused")
            if int(pid) % 4 == 0 and attempt == 1:
                return "", None, 0
            return "A sufficiently long answer about the topic for persona " + pid, None, 11
        return ans

    att = inference.run_with_retries(tasks, factory, max_retries=2)
    fin = {r["persona_id"]: r for r in inference.final_answers(tasks, att).collect()}
    assert len(fin) == 20
    assert fin["4"]["success"] and fin["4"]["response"].startswith("A sufficiently")
    assert not fin["3"]["success"] and fin["3"]["response"].startswith("Error: connection refused")
    stages = {r["stage"] for r in att.select("stage").distinct().collect()}
    assert {"batch", "retry_round_1"} <= stages


def test_stream_rate_audit_and_dedup(spark, tmp_path):
    rows = [("m1", "2024-01-01 00:00:05", 1), ("m1", "2024-01-01 00:00:50", 2), ("m1", "2024-01-01 00:01:10", 3),
            ("m2", "2024-01-01 00:00:10", 4)]
    df = spark.createDataFrame(rows, "model string, ts string, event_id int").withColumn("ts", F.to_timestamp("ts"))
    src = str(tmp_path / "src")
    df.repartition(2).write.parquet(src)
    out = str(tmp_path / "audit")
    ingest.rate_audit(spark, src, df.schema, out, limit=2,
                      checkpoint=str(tmp_path / "ck1")).awaitTermination()
    got = {(r["model"], str(r["window_start"])): (r["requests"], r["limited"])
           for r in ingest.read_rate_audit(spark, out).collect()}
    assert got[("m1", "2024-01-01 00:00:00")] == (2, True)
    assert got[("m1", "2024-01-01 00:01:00")] == (1, False)
    dd = spark.createDataFrame([("m", "t", "1", "2024-01-01 00:00:00"), ("m", "t", "1", "2024-01-01 00:00:02"),
                                ("m", "t", "2", "2024-01-01 00:00:01")], K + ", ts string").withColumn(
        "ts", F.to_timestamp("ts"))
    src2, out2 = str(tmp_path / "src2"), str(tmp_path / "dedup")
    dd.write.parquet(src2)
    ingest.dedup_attempts(spark, src2, dd.schema, out2, checkpoint=str(tmp_path / "ck2")).awaitTermination()
    assert sorted(r["persona_id"] for r in spark.read.parquet(out2).collect()) == ["1", "2"]


def test_snapshot_reader_and_writers(spark, tmp_path):
    snap = {"metadata": {"timestamp": "2024-01-01T00:00:00", "batch_number": 3, "total_batches": 10,
                         "stage": "batch", "incremental_counter": 4, "progress_percentage": 40.0},
            "performance_metrics": {"success_rate": 0.9, "total_requests": 100, "successful_requests": 90},
            "results": {"m": {"t": {"1": "a", "2": "b"}}}}
    p = tmp_path / "incremental_results_1.json"
    p.write_text(json.dumps(snap, indent=2))
    meta, rows = files.read_snapshot(spark, str(p))
    m = meta.collect()[0]
    assert (m["stage"], m["batch_number"], m["total_requests"]) == ("batch", 3, 100)
    assert sorted((r["persona_id"], r["response"]) for r in rows.collect()) == [("1", "a"), ("2", "b")]
    attempts = spark.createDataFrame([("m", "t", "1", 1, "x" * 60, True), ("m", "t", "1", 2, "y" * 60, True)],
                                     K + ", seq long, response string, success boolean")
    docs = files.snapshot_documents(attempts, "final", 0, 1, 1)
    out = str(tmp_path / "snap_out")
    docs.write.text(out)
    back = files.read_results_json(spark, out).collect()
    assert [(r["persona_id"], r["response"]) for r in back] == [("1", "y" * 60)]
    pers = spark.createDataFrame([("u1", "P", "Pro")], "uuid string, persona string, professional_persona string")
    files.write_personas(pers, str(tmp_path / "pj"), "main", "tag1", "20240101")
    got = spark.read.json(str(tmp_path / "pj")).collect()
    assert got[0]["experiment"] == "main" and got[0]["tag"] == "tag1"


def test_replayed_micro_batch_counts_once(spark, tmp_path):
    df = spark.createDataFrame([("m", True, 3), ("m", False, 4)], "model string, success boolean, tokens int")
    table, metrics = str(tmp_path / "t"), str(tmp_path / "m")
    ingest.write_batch(df, 0, table, metrics)
    ingest.write_batch(df.limit(1), 1, table, metrics)
    ingest.write_batch(df, 0, table, metrics)      # the same micro-batch again after a failure
    assert spark.read.parquet(table).count() == 3
    got = [tuple(r) for r in ingest.running_metrics(spark, metrics).orderBy("micro_batch").collect()]
    assert [(g[0], g[1], g[4]) for g in got] == [(0, 2, 2), (1, 1, 3)]


def test_checkpoint_folder_is_required_beyond_one_process():
    from types import SimpleNamespace

    from consonance.session import checkpoint_dir

    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=sc)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(fake)
    sc.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        checkpoint_dir(fake)


def test_retry_rounds_do_not_read_all_tasks_again(spark):
    """Every retry round joined its queue with the prompts of all tasks, which were built again for it."""
    from consonance.operators import inference

    read = spark.sparkContext.accumulator(0)
    rows = [("m", "t", str(i), "ask " * (1 + i % 3)) for i in range(40)]
    schema = "model string, topic string, persona_id string, prompt string"

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    tasks = spark.createDataFrame(rows, schema).mapInArrow(seen, schema)

    def factory():
        # persona 3 never answers, every other one with an even id on its second attempt
        return lambda m, t, p, pr, a: ("" if p == "3" or (a < 2 and int(p or 0) % 2 == 0) else f"{p} {pr} {'word ' * 20}", None, 7)

    att = inference.run_with_retries(tasks, factory, max_retries=3).collect()
    assert read.value <= 2 * len(rows)  # the first round and the search for absent keys
    by = {}
    for r in att:
        by.setdefault(r["stage"], []).append(r)
    assert {s: len(v) for s, v in by.items()} == {"batch": 40, "retry_round_1": 21, "retry_round_2": 1, "retry_round_3": 1}
    assert all(r["response"].startswith(f"{r['persona_id']} ask ") for r in by["retry_round_1"] if r["success"])
    # a repeated key is asked again with each prompt of it, a key with a null is asked by the recovery pass alone
    odd = [("m", "t", "3", "p"), ("m", "t", "3", "q"), ("m", None, "4", "r"), ("m", "t", "6", "s"), ("m", "t", "5", "u")]
    att = inference.run_with_retries(spark.createDataFrame(odd, schema), factory, max_retries=2).collect()
    count = {}
    for r in att:
        count[r["stage"], r["persona_id"]] = count.get((r["stage"], r["persona_id"]), 0) + 1
    assert count == {("batch", "3"): 2, ("batch", "4"): 1, ("batch", "6"): 1, ("batch", "5"): 1, ("retry_round_1", "3"): 4,
                     ("retry_round_1", "6"): 1, ("retry_round_2", "3"): 8, ("post_recovery", "4"): 1}

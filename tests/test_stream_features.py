"""Snapshots at an interval, late keys, request windows and paging."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from consonance.session import scratch_path
from consonance.sources import files
from consonance.streaming import ingest, snapshots, windows

ATTEMPT = "model string, topic string, persona_id string, seq long, response string, success boolean, ts timestamp"
T0 = dt.datetime(2024, 1, 1)


def _attempts(spark, rows):
    return spark.createDataFrame([("m", "t", p, s, r, True, T0 + dt.timedelta(seconds=at)) for p, s, r, at in rows], ATTEMPT)


def test_snapshots_are_due_at_the_interval_and_at_the_end():
    assert [b for b in range(8) if snapshots.due(b, 8, 3)] == [0, 3, 6, 7]
    with pytest.raises(ValueError):
        snapshots.due(0, 1, 0)


def test_replayed_batches_write_no_second_snapshot(spark):
    out = scratch_path(spark, "snap")
    batches = [_attempts(spark, [("a", 0, "one", 0), ("b", 0, "x", 5)]), _attempts(spark, [("a", 1, "two", 20)]),
               _attempts(spark, [("c", 0, "last", 60)])]

    def run(b):
        ingest.write_batch(batches[b], b, f"{out}/attempts", f"{out}/metrics")
        return snapshots.due(b, 3, 2) and snapshots.write_snapshot(spark, out, b, 3, "r", start_batch=10, initial_counter=5)

    assert [run(0), run(0), run(1), run(2), run(2), run(0)] == [True, False, False, True, False, False]
    got = {r.batch: (r.number, r.counter, r.file) for r in snapshots.commits(spark, out).collect()}
    assert got == {0: (10, 6, "incremental_results_r_batch010_batch_006.json"), 2: (12, 7, "incremental_results_r_batch012_batch_007.json")}
    assert sorted(r["name"] for r in files.list_files(spark, f"{out}/snapshots").collect()) == sorted(v[2] for v in got.values())
    last = {r.persona_id: r.response for r in files.read_results_json(spark, f"{out}/snapshots/{got[2][2]}").collect()}
    assert last == {"a": "two", "b": "x", "c": "last"}
    meta, _ = files.read_snapshot(spark, f"{out}/snapshots/{got[2][2]}")
    assert {(m.batch_number, m.incremental_counter, m.progress_percentage) for m in meta.collect()} == {(12, 7, 100.0)}
    p = {r.batch: r for r in snapshots.progress(spark, out, 3).collect()}
    assert [(p[b].total_requests, p[b].eta_seconds, p[b].snapshot_counter) for b in range(3)] == [(2, 10, 6), (3, 10, None), (4, 0, 7)]


def test_a_snapshot_without_its_marker_is_written_again(spark):
    """A failure between documents and marker: the replay takes the same name."""
    out = scratch_path(spark, "snap")
    ingest.write_batch(_attempts(spark, [("a", 0, "one", 0)]), 0, f"{out}/attempts", f"{out}/metrics")
    spark.createDataFrame([("half",)], "value string").write.text(f"{out}/snapshots/incremental_results_r_batch000_batch_001.json")
    assert snapshots.write_snapshot(spark, out, 0, 1, "r")
    assert files.list_files(spark, f"{out}/snapshots").count() == 1
    (row,) = files.read_results_json(spark, f"{out}/snapshots/incremental_results_r_batch000_batch_001.json").collect()
    assert row.response == "one"


def test_late_rows_and_expired_keys(spark):
    """Three batches, an hour of delay: a duplicate goes, an expired key is kept again, a late row is set aside."""
    out = scratch_path(spark, "late")
    hour = 3600
    batches = [[("a", 0, "first", 0), ("a", 1, "again", 10), ("b", 0, "b", 20)],
               [("a", 2, "soon", 500), ("c", 0, "c", 5 * hour)],
               [("a", 3, "expired", 5 * hour), ("c", 1, "dup", 5 * hour + 9), ("d", 0, "late", 30), ("b", 1, "earlier", 2)]]
    for b, rows in [(0, batches[0]), *enumerate(batches), (2, batches[2])]:  # the first and the last batch are replayed
        ingest.write_deduplicated(_attempts(spark, rows), b, out, delay_seconds=hour)
    kept = sorted((r.persona_id, r.response) for r in spark.read.parquet(f"{out}/kept").collect())
    late = sorted((r.persona_id, r.response) for r in spark.read.parquet(f"{out}/late").collect())
    assert kept == [("a", "expired"), ("a", "first"), ("b", "b"), ("c", "c")]
    assert late == [("b", "earlier"), ("d", "late")]
    got = {r.persona_id: (r.response, r.kept_rows, r.late_rows) for r in ingest.reconciled(spark, out).collect()}
    assert got == {"a": ("first", 2, 0), "b": ("earlier", 1, 1), "c": ("c", 1, 0), "d": ("late", 0, 1)}


def _judged(requests, limit, window, pause):
    """The rule of the windows, request by request."""
    out, state = {}, {}
    for t, i, m, limited in sorted(requests):
        s = state.setdefault(m, {"start": t, "n": 0, "until": 0})
        if t < s["until"]:
            out[i] = "backoff"
            continue
        if t - s["start"] >= window:
            s["start"], s["n"] = t, 0
        if s["n"] >= limit:
            out[i] = "window"
            continue
        s["n"] += 1
        out[i] = "sent"
        if limited:
            s["until"] = t + pause
    return out


def test_request_windows_over_disordered_files(spark):
    """Requests arrive out of order within the watermark, over several micro-batches; heartbeats finish the log."""
    rng = random.Random(4)
    requests = [(rng.randrange(0, 4000) + 0.25, i, f"m{i % 3}", rng.random() < 0.05) for i in range(600)]
    src = scratch_path(spark, "req")
    schema = "model string, event_id long, ts timestamp, rate_limited boolean"
    arrival = sorted(requests, key=lambda r: r[0] + rng.uniform(0, 200))
    for a in range(0, 600, 150):
        part = [(m, i, T0 + dt.timedelta(seconds=t), x) for t, i, m, x in arrival[a:a + 150]]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([("m0", None, T0 + dt.timedelta(days=1), False)], schema).coalesce(1).write.mode("append").parquet(src)
    out = scratch_path(spark, "windows")
    windows.audit_windows(spark, src, spark.read.parquet(src).schema, out, 7, 60, 30, "10 minutes").awaitTermination()
    got = {r.event_id: r.decision for r in spark.read.schema(windows.OUT).parquet(out).collect()}
    assert got == _judged(requests, 7, 60, 30)
    assert set(got.values()) == {"sent", "window", "backoff"}


def test_a_page_opens_only_its_files(spark):
    path, index = scratch_path(spark, "pages"), scratch_path(spark, "index")
    p = spark.range(1000).select(F.col("id").cast("string").alias("uuid"), F.concat(F.lit("p"), "id").alias("persona"))
    files.write_ordered_documents(p, path, "uuid", rows_per_doc=10, n_files=5)
    files.write_page_index(spark, path, index, multi_line=False)
    n_files = spark.read.parquet(index).count()
    assert n_files == 5
    for offset, length in ((0, 7), (195, 20), (990, 100), (1000, 5), (3, 0), (0, 5000)):
        page = files.persona_page(spark, path, offset, length, index, multi_line=False)
        assert sorted((r.pos, r.row.uuid) for r in page.collect()) == [(i, str(i)) for i in range(offset, min(offset + length, 1000))]
        assert len(page.inputFiles()) <= 2 + length * n_files // 1000
    assert files.persona_page(spark, path + "-none", 0, 5).collect() == []

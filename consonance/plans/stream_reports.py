"""Streaming queries drained with ``availableNow`` and compared with batch SQL.

Each query lands its view as Parquet files (one file per arrival group) in a
fresh folder under the checkpoint folder, runs the stream to completion and
returns what the sink holds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage
from ..session import scratch_path
from ..sources import files
from ..streaming import ingest, snapshots, windows
from . import views
from .registry import oracle, register
from .views import with_views


def _land(df, name, by, files=8):
    """Write a view as several Parquet files (stand-in for arriving files)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.repartition(files, by).write.mode("overwrite").parquet(path)
    return path, spark.read.parquet(path).schema


def _land_in_order(df, name, order):
    """Write a view as one file per value of ``order`` (a few integers from 0), each newer than the one before."""
    import time

    path = scratch_path(df.sparkSession, name)
    last = df.agg(F.max(order)).first()[0]
    for i in range((last if last is not None else -1) + 1):
        df.where(F.col(order) == i).drop(order).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)  # file times tell the order, some stores keep them coarse
    return path, df.drop(order).schema


BATCHES, INTERVAL = 5, 2

# attempts with an event time, in the order of arrival: conversations by fifths, an hour of log each
_ARRIVALS = f""", timed AS (SELECT *, CAST(persona_id AS BIGINT) % {BATCHES} AS arrival,
  1704067200 + (CAST(persona_id AS BIGINT) % {BATCHES}) * 3600 + seq AS sec FROM attempts)"""


def _arrivals(spark, sf_dir):
    fifth = F.col("persona_id").cast("bigint") % BATCHES
    return views.attempts(spark, sf_dir).withColumn("arrival", fifth.cast("int")).withColumn(
        "ts", F.timestamp_seconds(F.lit(1704067200) + F.col("arrival") * 3600 + F.col("seq")))


def _snapshot_run(spark, sf_dir):
    src, schema = _land_in_order(_arrivals(spark, sf_dir), "snapshot-src", "arrival")
    out = scratch_path(spark, "snapshot-run")
    snapshots.ingest_with_snapshots(spark, src, schema, out, BATCHES, "run", INTERVAL).awaitTermination()
    return out


@register("stream_progress", oracle(with_views(_ARRIVALS + f"""
, b AS (SELECT arrival AS batch, count(*) AS requests, min(sec) AS lo, max(sec) AS hi FROM timed GROUP BY arrival),
c AS (SELECT batch, requests, sum(requests) OVER w AS total_requests, min(lo) OVER w AS lo, max(hi) OVER w AS hi
      FROM b WINDOW w AS (ORDER BY batch))
SELECT CAST(batch AS INTEGER) AS batch, requests, CAST(total_requests AS BIGINT) AS total_requests,
  100.0 * (batch + 1) / {BATCHES} AS progress_percentage, CAST(hi - lo AS DOUBLE) AS elapsed_seconds,
  CAST(floor((hi - lo) * 1.0 / (batch + 1) * ({BATCHES} - batch - 1)) AS BIGINT) AS eta_seconds,
  CAST(CASE WHEN batch % {INTERVAL} = 0 OR batch = {BATCHES} - 1
       THEN (SELECT count(*) FROM range({BATCHES}) r(i) WHERE (i % {INTERVAL} = 0 OR i = {BATCHES} - 1) AND i <= batch) END AS INTEGER)
    AS snapshot_counter FROM c""", "attempts"),
    ["batch", "requests", "total_requests", "progress_percentage", "elapsed_seconds", "eta_seconds", "snapshot_counter"],
    ["progress_percentage", "elapsed_seconds"]), ["K3", "K4", "X2"])
def q_stream_progress(spark, sf_dir):
    """Progress, pace and snapshots of a stream of attempts: a snapshot after every second batch and the last."""
    return snapshots.progress(spark, _snapshot_run(spark, sf_dir), BATCHES).drop("successful_requests", "success_rate")


@register("stream_snapshots", oracle(with_views(_ARRIVALS + f"""
, s AS (SELECT i, row_number() OVER (ORDER BY i) AS counter FROM range({BATCHES}) r(i) WHERE i % {INTERVAL} = 0 OR i = {BATCHES} - 1)
SELECT CAST(counter AS INTEGER) AS counter, model, topic, persona_id, arg_max(response, seq) AS response
FROM timed JOIN s ON arrival <= i GROUP BY counter, model, topic, persona_id""", "attempts"),
    ["counter", "model", "topic", "persona_id", "response"]), ["K3", "S5"])
def q_stream_snapshots(spark, sf_dir):
    """Contents of every snapshot of the stream: the latest answer of each task up to its batch."""
    out = _snapshot_run(spark, sf_dir)
    rows = None
    for c in snapshots.commits(spark, out).orderBy("batch").collect():  # one row per snapshot
        part = files.read_results_json(spark, f"{out}/snapshots/{c.file}").withColumn("counter", F.lit(c.counter))
        rows = part if rows is None else rows.unionByName(part)
    return rows.select("counter", "model", "topic", "persona_id", "response")


@register("stream_late_keys", oracle(with_views(_ARRIVALS + """
, late AS (SELECT *, CASE WHEN CAST(persona_id AS BIGINT) % 7 = 3 THEN sec - 18000 ELSE sec END AS t FROM timed)
SELECT model, topic, persona_id, strftime(to_timestamp(min(t)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS first_ts
FROM late GROUP BY model, topic, persona_id""", "attempts"),
    ["model", "topic", "persona_id", "first_ts"]), ["X4", "U3"])
def q_stream_late_keys(spark, sf_dir):
    """Keyed dedup of a stream in which every seventh task arrives five hours late: kept and late rows give the batch result."""
    a = _arrivals(spark, sf_dir)
    a = a.withColumn("ts", F.when(F.col("persona_id").cast("bigint") % 7 == 3, F.col("ts") - F.expr("INTERVAL 5 HOURS")).otherwise(F.col("ts")))
    src, schema = _land_in_order(a, "late-src", "arrival")
    out = scratch_path(spark, "late-dedup")
    ingest.dedup_with_late(spark, src, schema, out).awaitTermination()
    r = ingest.reconciled(spark, out)
    return r.select("model", "topic", "persona_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("first_ts"))


@register("stream_ingest_coverage", oracle(with_views("""
SELECT CAST(count(*) AS BIGINT) AS processed, CAST(count_if(success) AS BIGINT) AS successful,
  CAST(coalesce(sum(tokens), 0) AS BIGINT) AS total_tokens FROM reqlog""", "reqlog"),
    ["processed", "successful", "total_tokens"]), ["X2", "K3", "K4"])
def q_stream_ingest_coverage(spark, sf_dir):
    """Request log ingested file by file (foreachBatch); totals from the per-batch metrics table."""
    r = views.reqlog(spark, sf_dir)
    src, schema = _land(r, "reqlog-src", "batch")
    table, metrics = scratch_path(spark, "ingested"), scratch_path(spark, "ingest-metrics")
    q = ingest.ingest_attempts(spark, src, schema, table, metrics)
    q.awaitTermination()
    m = spark.read.parquet(metrics)
    return m.agg(F.sum("requests").cast("long").alias("processed"),
                 F.sum("successful").cast("long").alias("successful"),
                 F.sum("tokens").cast("long").alias("total_tokens"))


@register("stream_rate_audit", oracle(with_views("""
SELECT model, strftime(to_timestamp(floor(epoch(ts) / 60) * 60), '%Y-%m-%d %H:%M:%S') AS window_start,
  CAST(count(*) AS BIGINT) AS requests, count(*) >= 2 AS limited
FROM reqlog GROUP BY model, floor(epoch(ts) / 60)""", "reqlog"),
    ["model", "window_start", "requests", "limited"]), ["X3", "A15"])
def q_stream_rate_audit(spark, sf_dir):
    """Requests per model per 60-second window from a stream, limit 2 per window."""
    r = views.reqlog(spark, sf_dir)
    src, schema = _land(r, "reqlog-audit-src", "batch")
    out = scratch_path(spark, "audit")
    q = ingest.rate_audit(spark, src, schema, out, limit=2)
    q.awaitTermination()
    a = ingest.read_rate_audit(spark, out)
    return a.select("model", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    "requests", "limited")


_LIMIT, _WINDOW, _PAUSE = 3, 7200, 3600


@register("stream_request_windows", oracle(with_views(f""",
r AS (SELECT model, event_id, CAST(epoch(ts) AS DOUBLE) AS t, rate_limited,
        row_number() OVER (PARTITION BY model ORDER BY ts, event_id) AS rn FROM reqlog),
s AS (
  SELECT model, rn, event_id, t AS start, 1 AS sent, CASE WHEN rate_limited THEN t + {_PAUSE} ELSE 0.0 END AS backoff,
    'sent' AS decision FROM r WHERE rn = 1
  UNION ALL
  SELECT r.model, r.rn, r.event_id,
    CASE WHEN r.t < s.backoff THEN s.start WHEN r.t - s.start >= {_WINDOW} THEN r.t ELSE s.start END,
    CASE WHEN r.t < s.backoff THEN s.sent WHEN r.t - s.start >= {_WINDOW} THEN 1 WHEN s.sent >= {_LIMIT} THEN s.sent
         ELSE s.sent + 1 END,
    CASE WHEN r.t >= s.backoff AND (r.t - s.start >= {_WINDOW} OR s.sent < {_LIMIT}) AND r.rate_limited THEN r.t + {_PAUSE}
         ELSE s.backoff END,
    CASE WHEN r.t < s.backoff THEN 'backoff' WHEN r.t - s.start >= {_WINDOW} THEN 'sent' WHEN s.sent >= {_LIMIT} THEN 'window'
         ELSE 'sent' END
  FROM s JOIN r ON r.model = s.model AND r.rn = s.rn + 1)
SELECT model, event_id, start AS window_start, CAST(sent AS INTEGER) AS sent_in_window, decision FROM s""", "reqlog").replace(
    "WITH ", "WITH RECURSIVE ", 1), ["model", "event_id", "window_start", "sent_in_window", "decision"], ["window_start"]),
    ["X3", "A15"])
def q_stream_request_windows(spark, sf_dir):
    """Every request judged by a window that starts at a request of its model, with backoff after a rate limit."""
    r = views.reqlog(spark, sf_dir).select("model", F.col("event_id").cast("long"), F.col("ts").cast("timestamp").alias("ts"),
                                           "rate_limited")
    # files in the order of time, and a heartbeat behind them that lets the last requests be judged
    sec = F.unix_micros("ts") / 1e6
    span = r.agg(F.min(sec).alias("lo"), F.max(sec).alias("hi")).first()
    if span.lo is None:
        return spark.createDataFrame([], "model string, event_id long, window_start double, sent_in_window int, decision string")
    part = F.floor((sec - span.lo) / (span.hi - span.lo + 1) * 3).cast("int")
    beat = spark.range(1).select(F.lit("heartbeat").alias("model"), F.lit(None).cast("long").alias("event_id"),
                                 F.timestamp_seconds(F.lit(span.hi + 86400)).alias("ts"),
                                 F.lit(False).alias("rate_limited"), F.lit(3).alias("part"))
    src, schema = _land_in_order(r.withColumn("part", part).unionByName(beat), "window-src", "part")
    out = scratch_path(spark, "request-windows")
    windows.audit_windows(spark, src, schema, out, _LIMIT, _WINDOW, _PAUSE).awaitTermination()
    d = spark.read.schema(windows.OUT).parquet(out)
    return d.select("model", "event_id", F.col("window_start").cast("double").alias("window_start"), "sent_in_window", "decision")


@register("stream_dedup_keys", oracle(with_views("""
SELECT DISTINCT model, topic, persona_id FROM attempts""", "attempts"),
    ["model", "topic", "persona_id"]), ["X4", "U3"])
def q_stream_dedup_keys(spark, sf_dir):
    """Attempt stream deduplicated by task key within the watermark (keys compared)."""
    a = views.attempts(spark, sf_dir).withColumn(
        "ts", F.timestamp_seconds(F.lit(1704067200) + F.col("seq")))
    src, schema = _land(a, "attempts-src", "seq")
    out = scratch_path(spark, "dedup")
    q = ingest.dedup_attempts(spark, src, schema, out)
    q.awaitTermination()
    return spark.read.parquet(out).select(*coverage.KEYS)

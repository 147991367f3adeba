"""Structured Streaming forms of the answer log.

* ``ingest_attempts`` (incremental snapshots): each micro-batch is written to
  its own ``micro_batch=<id>`` partition of a Parquet table in
  ``foreachBatch``, and its metrics row to the same partition of a second
  table. A replayed micro-batch overwrites its partition, so nothing counts
  twice; readers get running totals from the metrics table and exact results
  from the attempts table.
* ``rate_audit`` (request window check): requests per model per tumbling
  event-time window, flagged at a limit; update mode into ``foreachBatch``,
  so late rows inside the watermark revise a window and the latest version
  of each window wins on read.
* ``dedup_attempts``: one row per task key within the watermark
  (``dropDuplicatesWithinWatermark``; the first arrival is kept, unlike the
  batch rule where the last attempt wins, so only the keys are comparable).
* ``dedup_with_late``: the same with its watermark in tables, where rows behind
  the watermark go to a side table instead of being dropped; ``reconciled``
  puts both together to the batch result.

Every query takes its checkpoint location under ``spark.checkpoint.dir`` and
runs with ``availableNow`` when asked to drain what is there (tests, catch-up).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.validity import is_valid
from ..session import scratch_path

KEYS = ["model", "topic", "persona_id"]


def _start(writer, available_now: bool):
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def write_batch(df: DataFrame, batch_id: int, table_dir: str, metrics_dir: str) -> None:
    """One micro-batch and its metrics, each to its own partition; a replay overwrites both."""
    df = df.persist()
    try:
        df.write.mode("overwrite").parquet(f"{table_dir}/micro_batch={batch_id}")
        ok = F.coalesce(F.col("success"), F.lit(False))
        if "response" in df.columns:
            ok = ok & is_valid(F.col("response"))
        tokens = F.sum("tokens") if "tokens" in df.columns else F.lit(None).cast("long")
        ts = F.col("ts").cast("timestamp") if "ts" in df.columns else F.lit(None).cast("timestamp")
        m = df.agg(F.count(F.lit(1)).alias("requests"), F.count_if(ok).alias("successful"),
                   F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"),
                   F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
        m.write.mode("overwrite").parquet(f"{metrics_dir}/micro_batch={batch_id}")
    finally:
        df.unpersist()


def ingest_attempts(spark: SparkSession, source_dir: str, schema: T.StructType, table_dir: str,
                    metrics_dir: str, available_now: bool = True, checkpoint: str | None = None):
    """New attempt files to ``table_dir`` and per-batch metrics to ``metrics_dir`` (``write_batch``)."""
    stream = spark.readStream.schema(schema).parquet(source_dir)

    def per_batch(df: DataFrame, batch_id: int) -> None:
        write_batch(df, batch_id, table_dir, metrics_dir)

    q = _start(stream.writeStream.foreachBatch(per_batch)
               .option("checkpointLocation", checkpoint or scratch_path(spark, "ingest-ckpt")), available_now)
    return q


def running_metrics(spark: SparkSession, metrics_dir: str) -> DataFrame:
    """Cumulative requests, successes and success rate after each micro-batch."""
    from ..operators.grid import running_sums

    m = spark.read.parquet(metrics_dir).select("micro_batch", "requests", "successful", "tokens")
    c = running_sums(m, "micro_batch", ["requests", "successful"])
    return c.select("micro_batch", "requests", "successful", "tokens", F.col("requests_cum").alias("cum_requests"),
                    (F.col("successful_cum") / F.col("requests_cum")).alias("cum_success_rate"))


def rate_audit_stream(requests: DataFrame, limit: int, window: str = "60 seconds",
                      watermark: str = "10 minutes", ts_col: str = "ts") -> DataFrame:
    """Requests per (model, tumbling window) with ``limited`` = count >= ``limit``."""
    r = requests.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark)
    c = r.groupBy("model", F.window(ts_col, window).alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return c.select("model", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "requests", (F.col("requests") >= limit).alias("limited"))


def rate_audit(spark: SparkSession, source_dir: str, schema: T.StructType, out_dir: str, limit: int,
               window: str = "60 seconds", watermark: str = "10 minutes", available_now: bool = True,
               checkpoint: str | None = None):
    """Run the rate audit over request files; window versions land in ``out_dir``."""
    counts = rate_audit_stream(spark.readStream.schema(schema).parquet(source_dir), limit, window, watermark)

    def per_batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out_dir}/micro_batch={batch_id}")

    return _start(counts.writeStream.outputMode("update").foreachBatch(per_batch)
                  .option("checkpointLocation", checkpoint or scratch_path(spark, "audit-ckpt")), available_now)


def read_rate_audit(spark: SparkSession, out_dir: str) -> DataFrame:
    """Latest version of every (model, window) written by ``rate_audit``."""
    v = spark.read.parquet(out_dir)
    last = v.groupBy("model", "window_start").agg(
        F.max_by(F.struct("window_end", "requests", "limited"), F.col("micro_batch")).alias("v"))
    return last.select("model", "window_start", "v.window_end", "v.requests", "v.limited")


def dedup_attempts(spark: SparkSession, source_dir: str, schema: T.StructType, out_dir: str,
                   keys: Sequence[str] = KEYS, ts_col: str = "ts", watermark: str = "1 hour",
                   available_now: bool = True, checkpoint: str | None = None):
    """Keep the first row of each key within the watermark; append to ``out_dir``."""
    s = spark.readStream.schema(schema).parquet(source_dir)
    d = s.withWatermark(ts_col, watermark).dropDuplicatesWithinWatermark(list(keys))
    return _start(d.writeStream.format("parquet").outputMode("append").option("path", out_dir)
                  .option("checkpointLocation", checkpoint or scratch_path(spark, "dedup-ckpt")), available_now)


# --- late rows and expired keys -------------------------------------------------------------


def write_deduplicated(df: DataFrame, batch_id: int, out_dir: str, keys: Sequence[str] = KEYS, ts_col: str = "ts",
                       delay_seconds: int = 3600) -> None:
    """One micro-batch: new keys to ``kept``, rows behind the watermark to ``late``, the new watermark to ``marks``.

    The watermark of a batch is the largest event time of all earlier batches less the delay. A key is a duplicate
    if it was kept at or after the watermark; one kept before it has expired and is kept again. Each output is a
    partition of its batch, read back only from earlier batches, so a replay gives the same rows.
    """
    spark, keys = df.sparkSession, list(keys)
    earlier = F.col("micro_batch") < batch_id
    mark = None
    if batch_id > 0:
        mark = spark.read.parquet(f"{out_dir}/marks").where(earlier).agg(F.max("last_ts")).first()[0]
    df = df.persist()
    try:
        limit = F.lit(mark) - F.make_dt_interval(secs=F.lit(delay_seconds)) if mark is not None else F.lit(None).cast("timestamp")
        late = F.coalesce(F.col(ts_col) < limit, F.lit(False))
        df.where(late).write.mode("overwrite").parquet(f"{out_dir}/late/micro_batch={batch_id}")
        first = df.where(~late).groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(ts_col, *keys)).alias("r")).select("r.*")
        if batch_id > 0:
            known = spark.read.parquet(f"{out_dir}/kept").where(earlier).where(F.coalesce(F.col(ts_col) >= limit, F.lit(True)))
            same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
            first = first.alias("a").join(known.select(*keys).distinct().alias("b"), same, "left_anti")
        first.write.mode("overwrite").parquet(f"{out_dir}/kept/micro_batch={batch_id}")
        df.agg(F.max(ts_col).alias("last_ts")).write.mode("overwrite").parquet(f"{out_dir}/marks/micro_batch={batch_id}")
    finally:
        df.unpersist()


def dedup_with_late(spark: SparkSession, source_dir: str, schema: T.StructType, out_dir: str, keys: Sequence[str] = KEYS,
                    ts_col: str = "ts", delay_seconds: int = 3600, files_per_batch: int = 1, available_now: bool = True,
                    checkpoint: str | None = None):
    """Keyed dedup of attempt files that loses no late row: ``kept`` and ``late`` below ``out_dir`` (``write_deduplicated``)."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)

    def per_batch(df: DataFrame, batch_id: int) -> None:
        write_deduplicated(df, batch_id, out_dir, keys, ts_col, delay_seconds)

    return _start(stream.writeStream.foreachBatch(per_batch)
                  .option("checkpointLocation", checkpoint or scratch_path(spark, "dedup-ckpt")), available_now)


def reconciled(spark: SparkSession, out_dir: str, keys: Sequence[str] = KEYS, ts_col: str = "ts") -> DataFrame:
    """Per key its first row by event time over kept and late rows, and how many rows of each kind it has: the batch result."""
    both = None
    for kind in ("kept", "late"):
        part = spark.read.parquet(f"{out_dir}/{kind}").drop("micro_batch").withColumn("_late", F.lit(kind == "late"))
        both = part if both is None else both.unionByName(part)
    rest = [c for c in both.columns if c not in (*keys, "_late")]
    out = both.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(ts_col, *[c for c in rest if c != ts_col])).alias("r"),
                                  F.count_if(~F.col("_late")).alias("kept_rows"), F.count_if("_late").alias("late_rows"))
    return out.select(*keys, "r.*", "kept_rows", "late_rows")

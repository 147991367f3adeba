"""Streaming ingest with snapshots at an interval, progress and an estimate of the time left.

Every micro-batch lands in its own partition of the attempts table and of the
metrics table (``ingest.write_batch``). After every ``interval``-th batch, and
after the last one, a snapshot of the latest answer of every task so far is
written as results documents with metadata, under the name
``incremental_results_<tag>_batch<number>_<stage>_<counter>.json``.

A snapshot counts once its commit marker is written, after its documents. The
counter of a snapshot is one more than the committed snapshots of earlier
batches, so a batch that is replayed after a failure writes the same name
again, and one that was committed writes nothing.

``progress`` derives from the metrics table: batches done, cumulative requests
and successes, percentage, and the time left at the pace so far. Time is the
event time of the log, so a rerun gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ..sources import files
from .ingest import _start, write_batch


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def due(batch: int, total_batches: int, interval: int) -> bool:
    """Whether a snapshot follows batch ``batch`` (from 0) of ``total_batches``."""
    if interval <= 0:
        raise ValueError("interval must be positive")
    return batch % interval == 0 or batch == total_batches - 1


def commits(spark: SparkSession, out_dir: str) -> DataFrame:
    """Committed snapshots: batch, number, counter, file."""
    schema = "number int, counter int, file string, batch int"
    if not _exists(spark, f"{out_dir}/commits"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{out_dir}/commits")


def write_snapshot(spark: SparkSession, out_dir: str, batch: int, total_batches: int, tag: str, stage: str = "batch",
                   start_batch: int = 0, initial_counter: int = 0) -> bool:
    """The snapshot after ``batch``, unless it is committed already; whether it was written."""
    marker = f"{out_dir}/commits/batch={batch}"
    if _exists(spark, f"{marker}/_SUCCESS"):
        return False
    before = commits(spark, out_dir).where(F.col("batch") < batch).count()
    number, counter = batch + start_batch, initial_counter + before + 1
    seen = spark.read.parquet(f"{out_dir}/attempts").where(F.col("micro_batch") <= batch)
    name = f"incremental_results_{tag}_batch{number:03d}_{stage}_{counter:03d}.json"
    docs = files.snapshot_documents(seen, stage, number, total_batches + start_batch, counter,
                                    100.0 * (batch + 1) / max(total_batches, 1))
    docs.write.mode("overwrite").text(f"{out_dir}/snapshots/{name}")
    spark.createDataFrame([(number, counter, name)], "number int, counter int, file string").coalesce(1).write.mode(
        "overwrite").parquet(marker)
    return True


def ingest_with_snapshots(spark: SparkSession, source_dir: str, schema: T.StructType, out_dir: str, total_batches: int,
                          tag: str, interval: int = 1, stage: str = "batch", start_batch: int = 0, initial_counter: int = 0,
                          files_per_batch: int = 1, available_now: bool = True, checkpoint: str | None = None):
    """New attempt files to ``out_dir``: tables ``attempts`` and ``metrics``, documents in ``snapshots``, markers in ``commits``."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)

    def per_batch(df: DataFrame, batch_id: int) -> None:
        write_batch(df, batch_id, f"{out_dir}/attempts", f"{out_dir}/metrics")
        if due(batch_id, total_batches, interval):
            write_snapshot(df.sparkSession, out_dir, batch_id, total_batches, tag, stage, start_batch, initial_counter)

    return _start(stream.writeStream.foreachBatch(per_batch)
                  .option("checkpointLocation", checkpoint or scratch_path(spark, "snapshot-ckpt")), available_now)


def progress(spark: SparkSession, out_dir: str, total_batches: int) -> DataFrame:
    """One row per batch: cumulative requests and successes, percentage done, seconds elapsed and left, its snapshot if any.

    Windows here run over the metrics table: one row per batch.
    """
    m = spark.read.parquet(f"{out_dir}/metrics")
    so_far = Window.orderBy("micro_batch")
    done = F.col("micro_batch") + 1
    p = m.select(F.col("micro_batch").cast("int").alias("batch"), "requests",
                 F.sum("requests").over(so_far).alias("total_requests"), F.sum("successful").over(so_far).alias("successful_requests"),
                 (100.0 * done / total_batches).alias("progress_percentage"),
                 (F.max("last_ts").over(so_far).cast("double") - F.min("first_ts").over(so_far).cast("double")).alias("elapsed_seconds"))
    left = F.floor(F.col("elapsed_seconds") / (F.col("batch") + 1) * F.greatest(F.lit(total_batches) - F.col("batch") - 1, F.lit(0)))
    p = p.withColumn("success_rate", F.try_divide("successful_requests", "total_requests")).withColumn("eta_seconds", left.cast("long"))
    return p.join(commits(spark, out_dir).select("batch", F.col("counter").alias("snapshot_counter")), "batch", "left")

"""Request windows per model that start at a request, kept as streaming state.

The rule, applied to the requests of a model in the order of time:

* while a backoff lasts, a request is refused (``backoff``) and changes nothing;
* a request ``window_seconds`` or more after the start of the window starts a
  new one;
* a window that has sent ``limit`` requests refuses the next ones (``window``);
* any other request is sent and counted; if it was answered with a rate limit,
  a backoff of ``backoff_seconds`` begins.

A request can only be judged once no earlier one can arrive, so each model
holds the requests ahead of the watermark in its state and an event-time timer
wakes it when the watermark has passed the first of them. State is the window,
the backoff and these requests, never the log of the model.

Rows without ``event_id`` are heartbeats: they move the watermark and are no
requests. Requests behind the watermark are dropped by Spark's late-row rule.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .ingest import _start

OUT = "model string, event_id long, ts timestamp, window_start timestamp, sent_in_window int, decision string"
_STATE = "start double, sent int, backoff double, waiting binary"


def judge(requests: list[tuple[float, int, bool]], start: float | None, sent: int, backoff: float, limit: int,
          window: float, pause: float) -> tuple[list[tuple], float | None, int, float]:
    """Decisions on (time, id, rate limited) in order, and the state behind them."""
    out = []
    for t, i, limited in requests:
        if t < backoff:
            out.append((i, t, start, sent, "backoff"))
            continue
        if start is None or t - start >= window:
            start, sent = t, 0
        if sent >= limit:
            out.append((i, t, start, sent, "window"))
            continue
        sent += 1
        out.append((i, t, start, sent, "sent"))
        if limited:
            backoff = t + pause
    return out, start, sent, backoff


def request_windows(requests: DataFrame, limit: int, window_seconds: float = 60, backoff_seconds: float = 60,
                    watermark: str = "10 minutes", ts_col: str = "ts") -> DataFrame:
    """Decision on every request (model, event_id, ``ts_col``, rate_limited) of a stream."""
    r = requests.select("model", F.col("event_id").cast("long"), F.col(ts_col).cast("timestamp").alias("ts"),
                        F.coalesce("rate_limited", F.lit(False)).alias("rate_limited")).withWatermark("ts", watermark)
    r = r.withColumn("sec", F.unix_micros("ts") / 1e6)

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, sent, backoff, waiting = state.get if state.exists else (None, 0, 0.0, None)
        rows = pickle.loads(waiting) if waiting else []
        for f in frames:
            f = f[f["event_id"].notna()]
            rows += zip(f["sec"].tolist(), f["event_id"].astype("int64").tolist(), f["rate_limited"].tolist())
        rows.sort()
        mark = state.getCurrentWatermarkMs()
        n = sum(t * 1000 <= mark for t, _, _ in rows)
        out, start, sent, backoff = judge(rows[:n], start, sent, backoff, limit, window_seconds, backoff_seconds)
        rest = rows[n:]
        state.update((start, sent, backoff, pickle.dumps(rest) if rest else None))
        if rest:
            state.setTimeoutTimestamp(max(int(rest[0][0] * 1000), mark + 1))
        if out:
            df = pd.DataFrame(out, columns=["event_id", "ts", "window_start", "sent_in_window", "decision"])
            for c in ("ts", "window_start"):
                df[c] = pd.to_datetime((df[c].astype("float64") * 1e6).round().astype("Int64"), unit="us")
            df.insert(0, "model", key[0])
            yield df

    return r.groupBy("model").applyInPandasWithState(step, T.StructType.fromDDL(OUT), T.StructType.fromDDL(_STATE), "append",
                                                     "EventTimeTimeout")


def audit_windows(spark: SparkSession, source_dir: str, schema: T.StructType, out_dir: str, limit: int,
                  window_seconds: float = 60, backoff_seconds: float = 60, watermark: str = "10 minutes",
                  files_per_batch: int = 1, available_now: bool = True, checkpoint: str | None = None):
    """Run ``request_windows`` over request files; the decisions of a micro-batch land in its own partition of ``out_dir``."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)
    decisions = request_windows(stream, limit, window_seconds, backoff_seconds, watermark)

    def per_batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out_dir}/micro_batch={batch_id}")

    return _start(decisions.writeStream.outputMode("append").foreachBatch(per_batch)
                  .option("checkpointLocation", checkpoint or scratch_path(spark, "window-ckpt")), available_now)

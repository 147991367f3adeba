"""Partition layout helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` over ``partitions`` when the caller asks for a number; else ``df`` as it is.

    Meant for CPU-heavy per-row work on an input that is known to arrive in
    few partitions. Nothing is executed or measured here.
    """
    return df.repartition(partitions) if partitions else df

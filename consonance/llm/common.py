"""Small helpers shared by the llm operators."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package


#: Spark removes the shuffle files of a query as soon as it ends
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Queries that end in here leave no shuffle files (they would stay until the driver collects its garbage)."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below spark.checkpoint.dir and read back (cuts lineage, survives lost executors).

    The table is what is read from then on, so the shuffles behind it go with the write.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)  # the executors' Python workers import this package
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def n_shuffle(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def only(df: DataFrame, cols: Sequence[str], as_names: Sequence[str] | None = None) -> DataFrame:
    """Select ``cols`` under fixed internal names, so other columns of the input cannot clash."""
    return df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(cols, as_names or cols)])

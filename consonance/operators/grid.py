"""Task grids and dense ordering indexes.

* ``expand`` multiplies a large table by a list (topics, models). A short list
  enters the plan as a literal array, so the grid is a per-row ``explode``
  with no join and no shuffle of the large side; a longer one is joined in
  blocks of values. Both give the same rows.
* ``dense_index`` numbers rows 1..n in a given order without a global window:
  a distributed sort, then per-partition counts turned into offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: a list of up to this many values enters the plan as a literal array
LITERAL_VALUES = 1_000
#: values of a longer list that are joined to a row at once
BLOCK_VALUES = 256
_ROW_BITS = 33  # monotonically_increasing_id keeps the record number in the low 33 bits


def distinct_values(dim: DataFrame, col: str, max_values: int = LITERAL_VALUES) -> list | None:
    """Sorted distinct non-null values, or None when there are more than ``max_values`` (at most that many are read)."""
    vals = dim.select(col).where(F.col(col).isNotNull()).distinct()
    head = vals.limit(max_values + 1).collect()
    return sorted(r[0] for r in head) if len(head) <= max_values else None


def expand(df: DataFrame, dim: DataFrame, col: str, max_values: int = LITERAL_VALUES) -> DataFrame:
    """Each row of ``df`` once per distinct value of ``dim[col]`` (duplicates collapse)."""
    values = distinct_values(dim, col, max_values)
    if values is None:
        return _expand_blocks(df, dim, col)
    return expand_values(df, col, values, dim.schema[col].dataType)


def _expand_blocks(df: DataFrame, dim: DataFrame, col: str) -> DataFrame:
    """The same for a list of any length: values in blocks, rows joined to every block.

    Only block numbers enter the plan. The block number is the join key on both
    sides, and each value's block is dealt to ``salts`` copies, so the rows of
    ``df`` spread over blocks x salts keys.
    """
    spark = df.sparkSession
    vals = dim.select(col).where(F.col(col).isNotNull()).distinct()
    blocks = max(1, -(-vals.count() // BLOCK_VALUES))
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    v = vals.select(col, F.pmod(F.xxhash64(col), F.lit(blocks)).cast("int").alias("_block"),
                    F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    own = F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")
    rows = df.withColumn("_salt", own).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return rows.join(v, ["_block", "_salt"]).drop("_block", "_salt")


def expand_values(df: DataFrame, col: str, values: list, data_type=None) -> DataFrame:
    """Each row of ``df`` once per value of a known short list."""
    values = sorted(set(v for v in values if v is not None))
    if not values:
        return df.withColumn(col, F.lit(None).cast(data_type or "string")).where(F.lit(False))
    return df.withColumn(col, F.explode(F.array(*[F.lit(v) for v in values])))


def dense_index(df: DataFrame, order: Sequence, name: str = "idx",
                start: int = 1) -> DataFrame:
    """Add ``name`` = position in ``order`` (start, start+1, ...), computed distributed.

    ``order`` must be a total order (unique keys), otherwise ties may number
    differently between runs. The sorted table is checkpointed into the shared
    checkpoint folder so the counts and the numbering see the same rows.
    """
    from ..session import checkpoint_dir

    spark = df.sparkSession
    checkpoint_dir(spark)
    mid = F.monotonically_increasing_id()
    sorted_df = df.orderBy(*order).withColumn("_mid", mid).checkpoint(eager=True)
    part = F.shiftright(F.col("_mid"), _ROW_BITS)
    local = F.col("_mid") - F.shiftleft(part, _ROW_BITS)
    counts = sorted_df.groupBy(part.alias("_pid")).agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per partition: a window over it is as small as the partition count
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    out = sorted_df.withColumn("_pid", part).join(F.broadcast(offsets), "_pid")
    return out.withColumn(name, (F.col("_off") + local + F.lit(start)).cast("long")).drop(
        "_pid", "_off", "_mid")


def task_grid(prompts: DataFrame, models: DataFrame,
              max_models: int = LITERAL_VALUES) -> DataFrame:
    """prompts(topic, persona_id, prompt) x models, models innermost.

    The order key (topic, persona_id, model) interleaves models inside each
    prompt, as the reference's batches do.
    """
    return expand(prompts, models, "model", max_models).select(
        "model", "topic", "persona_id", *[c for c in prompts.columns
                                          if c not in ("model", "topic", "persona_id")])


def batch_numbers(tasks: DataFrame, batch_size: int,
                  order: Sequence[str] = ("topic", "persona_id", "model")) -> DataFrame:
    """Batch number (0-based) of each task at ``batch_size`` in grid order."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    idx = dense_index(tasks, list(order), "_pos", start=0)
    return idx.withColumn("batch", F.floor(F.col("_pos") / batch_size).cast("long")).withColumnRenamed(
        "_pos", "position")


def experiment_size(personas: DataFrame, topics: DataFrame, models: DataFrame,
                    rate_per_second: float = 10.0) -> DataFrame:
    """Main experiment size: personas x topics x models, and minutes at a rate."""
    n_p = personas.agg(F.count(F.lit(1))).scalar()
    n_t = topics.select("topic").distinct().agg(F.count(F.lit(1))).scalar()
    m = models.select("model").distinct().agg(F.count(F.lit(1)).alias("models"))
    calls = F.col("models") * n_p * n_t
    return m.select(n_p.alias("personas"), n_t.alias("topics"), "models",
                    calls.cast("long").alias("calls"),
                    (calls / F.lit(rate_per_second) / 60.0).alias("estimated_minutes"))


def control_size(models: DataFrame, repetitions: int, rate_per_second: float = 10.0) -> DataFrame:
    """Control experiment size: repetitions x models, and minutes at a rate."""
    m = models.select("model").distinct().agg(F.count(F.lit(1)).alias("models"))
    calls = F.col("models") * repetitions
    return m.select(F.lit(repetitions).cast("long").alias("repetitions"), "models",
                    calls.cast("long").alias("calls"),
                    (calls / F.lit(rate_per_second) / 60.0).alias("estimated_minutes"))


def running_sums(df: DataFrame, order: str, cols: Sequence[str], suffix: str = "_cum") -> DataFrame:
    """Add running totals of ``cols`` in ``order`` (unique) without a global window.

    A distributed sort (checkpointed, so both uses see the same partitions),
    running sums inside each partition, plus the totals of all earlier
    partitions (a table with one row per partition).
    """
    from ..session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    s = df.orderBy(order).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    local = Window.partitionBy("_pid").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    tot = s.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("_pid", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}")
                                for c in cols])
    out = s.join(F.broadcast(offs), "_pid")
    for c in cols:
        out = out.withColumn(c + suffix, F.sum(c).over(local) + F.col(f"_o_{c}"))
    return out.drop("_pid", *[f"_o_{c}" for c in cols])


def grouped_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos",
                  start: int = 1) -> DataFrame:
    """Position of each row inside its group in ``order`` (unique per group).

    Same idea as ``dense_index`` per group: after a distributed sort on
    (keys, order), a group may span several partitions; its rows are numbered
    inside each partition and shifted by the counts of that group in earlier
    partitions (a table of one row per partition and group). No window or
    task ever holds a whole group.
    """
    from ..session import checkpoint_dir

    keys = list(keys)
    checkpoint_dir(df.sparkSession)
    s = df.orderBy(*keys, *order).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    cnt = s.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = cnt.select("_pid", *keys, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy("_pid", *keys).orderBy(*order)
    out = s.join(offs, ["_pid", *keys]).withColumn(
        name, (F.row_number().over(local) + F.col("_off") + F.lit(start - 1)).cast("long"))
    return out.drop("_pid", "_off")

"""Blocked within-group pair evaluation for the pair-valued operators.

Aggregates of the similarity matrix come from ``operators.moments`` without
pairs. A few reports need values of individual pairs: negative pairs, the most
and least similar pair, links above a threshold, silhouette distances. Those
are evaluated here without ever emitting the full set of pairs as rows:

1. count the rows of each group and give each row a block,
   ``pmod(xxhash64(id), nb)`` with ``nb = ceil(n / block_size)``; hashing (not a
   window) keeps a hot group spread over many tasks;
2. send each row to the ``nb`` block pairs (lo, hi) it belongs to, so a block
   pair task holds at most two blocks (about ``2 * block_size`` rows);
3. ``applyInPandas`` per (group, lo, hi): one numpy product of the two blocks,
   reduced inside the task by a *reducer* that emits only what the report
   needs (filtered pairs, block-local extremes, per-cluster distance sums).

Shuffle volume is ``n * nb`` rows per group; task memory is bounded by the
block size whatever the group size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .moments import unit_rows

DEFAULT_BLOCK = 1024

# reducer(keys_tuple, ids_a, mat_a, ids_b, mat_b, same_block, extra_a, extra_b) -> DataFrame | None
Reducer = Callable[..., "pd.DataFrame | None"]


def assign_blocks(vectors: DataFrame, keys: Sequence[str], id_col: str,
                  block_size: int = DEFAULT_BLOCK, sizes: DataFrame | None = None) -> DataFrame:
    """Add ``block`` and ``nb`` columns (hash blocks of at most ~block_size rows).

    ``sizes`` (keys, n) may give the group sizes from a cheaper source than
    the vectors themselves.
    """
    keys = list(keys)
    counts = (sizes.select(*keys, F.col("n").alias("_n")) if sizes is not None
              else vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    nb = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(block_size))).cast("int")
    counts = counts.select(*keys, nb.alias("nb"))
    # the count table has one row per group; AQE broadcasts it when it is small
    with_nb = vectors.join(counts, keys, "inner")
    return with_nb.withColumn(
        "block", F.pmod(F.xxhash64(F.col(id_col)), F.col("nb").cast("long")).cast("int"))


def replicate_to_block_pairs(blocked: DataFrame) -> DataFrame:
    """Each row goes to the nb block pairs containing its block."""
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("_other")
    x = blocked.select("*", other)
    return (x.withColumn("lo", F.least("block", "_other"))
             .withColumn("hi", F.greatest("block", "_other"))
             .drop("_other"))


def evaluate_pairs(vectors: DataFrame, keys: Sequence[str], id_col: str, vec_col: str,
                   reducer: Reducer, out_schema: T.StructType,
                   extra_cols: Sequence[str] = (), block_size: int = DEFAULT_BLOCK,
                   metric: str = "cosine", sparse_dim: int | None = None,
                   sizes: DataFrame | None = None) -> DataFrame:
    """Run ``reducer`` on every block pair of every group.

    ``metric`` 'cosine' hands the reducer unit vectors (zero rows stay zero);
    'raw' hands the vectors as given (for Euclidean distances).
    With ``sparse_dim`` the vector column is a struct (idx, val) of a vector
    with that many dimensions; blocks are densified inside the task.
    """
    keys = list(keys)
    extra_cols = list(extra_cols)
    if sparse_dim is not None:
        base = vectors.select(*keys, id_col, F.col(f"{vec_col}.idx").alias("_idx"),
                              F.col(f"{vec_col}.val").alias("_val"), *extra_cols)
    else:
        base = vectors.select(*keys, id_col, vec_col, *extra_cols)
    reps = replicate_to_block_pairs(assign_blocks(base, keys, id_col, block_size, sizes))

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=out_schema.fieldNames())
        key = tuple(pdf[k].iloc[0] for k in keys)
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        a = pdf[pdf["block"] == lo]
        b = a if lo == hi else pdf[pdf["block"] == hi]
        if len(a) == 0 or len(b) == 0:  # an empty hash block has no pairs
            return pd.DataFrame(columns=out_schema.fieldNames())
        if sparse_dim is not None:
            ma = _sparse_matrix(a["_idx"], a["_val"], sparse_dim, metric)
            mb = _sparse_matrix(b["_idx"], b["_val"], sparse_dim, metric)
        else:
            ma, mb = _matrix(a[vec_col], metric), _matrix(b[vec_col], metric)
        out = reducer(key, a[id_col].to_numpy(), ma, b[id_col].to_numpy(), mb, lo == hi,
                      a[extra_cols] if extra_cols else None,
                      b[extra_cols] if extra_cols else None)
        if out is None or len(out) == 0:
            return pd.DataFrame(columns=out_schema.fieldNames())
        for i, k in enumerate(keys):
            out.insert(i, k, key[i])
        return out[out_schema.fieldNames()]

    return reps.groupBy(*keys, "lo", "hi").applyInPandas(fn, out_schema)


def _matrix(col: pd.Series, metric: str) -> np.ndarray:
    vals = col.to_numpy()
    dims = {len(v) for v in vals if v is not None}
    if len(dims) > 1:
        raise ValueError(f"vectors of different lengths in one group: {sorted(dims)}")
    d = dims.pop() if dims else 0
    x = np.zeros((len(vals), d), dtype=np.float64)
    for i, v in enumerate(vals):
        if v is not None:
            x[i] = np.asarray(v, dtype=np.float64)
    if metric == "cosine":
        return unit_rows(x, np.sqrt((x * x).sum(axis=1)))
    return x


def _sparse_matrix(idx: pd.Series, val: pd.Series, dim: int, metric: str) -> np.ndarray:
    x = np.zeros((len(idx), dim), dtype=np.float64)
    for i, (ix, vx) in enumerate(zip(idx.to_numpy(), val.to_numpy())):
        if ix is not None and len(ix):
            x[i, np.asarray(ix, dtype=np.int64)] = np.asarray(vx, dtype=np.float64)
    if metric == "cosine":
        return unit_rows(x, np.sqrt((x * x).sum(axis=1)))
    return x


def _pair_view(ids_a, ma, ids_b, mb, same):
    """Similarity values of the block pair, as (ia, ib, s) with each pair once."""
    s = ma @ mb.T
    if same:
        ia, ib = np.triu_indices(len(ids_a), k=1)
    else:
        ia, ib = np.indices(s.shape).reshape(2, -1)
    return ia, ib, s[ia, ib]


def _oriented(ids_a, ids_b, ia, ib):
    """Pair ids ordered so that id_a < id_b (string order)."""
    xa, xb = ids_a[ia].astype(str), ids_b[ib].astype(str)
    swap = xa > xb
    return np.where(swap, xb, xa), np.where(swap, xa, xb)


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(k, df.schema[k].dataType, True) for k in keys]


# --------------------------------------------------------------------------
# reports built on the evaluator


def filtered_pairs(vectors: DataFrame, predicate: str, threshold: float,
                   keys: Sequence[str] = ("model", "topic"), id_col: str = "persona_id",
                   vec_col: str = "embedding", block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """Pairs (id_a < id_b) whose cosine similarity is ``< threshold`` ('lt') or
    ``>= threshold`` ('ge'). Block pairs that cannot hold one are skipped
    (``pruned_pairs``); only matching pairs leave the tasks."""
    from .pruned_pairs import filtered

    return filtered(vectors, predicate, threshold, keys, id_col, vec_col, block_size)


def negative_pairs(vectors: DataFrame, **kw) -> DataFrame:
    """All pairs with negative cosine similarity (long form)."""
    return filtered_pairs(vectors, "lt", 0.0, **kw)


def negative_summary(vectors: DataFrame, keys: Sequence[str] = ("model", "topic"), id_col: str = "persona_id",
                     vec_col: str = "embedding", block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """Per group: has_negative, negative_count, min/max/mean of negative values.

    Every group appears; a group without negative pairs gives false, 0, NULLs.
    """
    from .pruned_pairs import filtered_sums

    keys = list(keys)
    stats = filtered_sums(vectors, "lt", 0.0, keys, id_col, vec_col, block_size).select(
        *keys, F.col("n").alias("negative_count"), F.col("lowest").alias("min_value"),
        F.col("highest").alias("max_value"), (F.col("total") / F.col("n")).alias("mean_value"))
    groups = vectors.select(*keys).distinct()
    return (groups.join(stats, keys, "left")
                  .select(*keys,
                          F.col("negative_count").isNotNull().alias("has_negative"),
                          F.coalesce("negative_count", F.lit(0)).cast("long").alias("negative_count"),
                          "min_value", "max_value", "mean_value"))


def extreme_pairs(vectors: DataFrame, keys: Sequence[str] = ("model", "topic"),
                  id_col: str = "persona_id", vec_col: str = "embedding",
                  block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """Most and least similar pair of each group with two or more rows.

    Ties go to the smallest (id_a, id_b). Found by best-first search over the
    bounds of block pairs (``pruned_pairs.extremes``).
    """
    from .pruned_pairs import extremes

    return extremes(vectors, keys, id_col, vec_col, block_size)[0]


def connections(vectors: DataFrame, coords: DataFrame, threshold: float = 0.8,
                keys: Sequence[str] = ("model", "topic"), id_col: str = "persona_id",
                vec_col: str = "embedding", block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """Links between pairs at or above ``threshold`` with both endpoints' x, y, z.

    ``coords`` has the group keys, the id column and x, y, z.
    """
    keys = list(keys)
    links = filtered_pairs(vectors, "ge", threshold, keys=keys, id_col=id_col,
                           vec_col=vec_col, block_size=block_size)
    c = coords.select(*keys, F.col(id_col).cast("string").alias("_id"), "x", "y", "z")
    ca = c.select(*keys, F.col("_id").alias("id_a"), F.col("x").alias("x_a"),
                  F.col("y").alias("y_a"), F.col("z").alias("z_a"))
    cb = c.select(*keys, F.col("_id").alias("id_b"), F.col("x").alias("x_b"),
                  F.col("y").alias("y_b"), F.col("z").alias("z_b"))
    return links.join(ca, keys + ["id_a"]).join(cb, keys + ["id_b"])


def pair_moments(vectors: DataFrame, keys: Sequence[str] = ("model", "topic"),
                 id_col: str = "persona_id", vec_col: str = "embedding",
                 sparse_dim: int | None = None, block_size: int = DEFAULT_BLOCK,
                 sizes: DataFrame | None = None) -> DataFrame:
    """Per group: n, pairs, sum_s, sum_s2, mean and population std from block sums.

    Each block pair sends one row of sums; used for vectors whose closed form
    would need a d x d Gram matrix per group (TF-IDF rows with up to 1000
    dimensions).
    """
    keys = list(keys)
    schema = T.StructType(_key_fields(vectors, keys) + [
        T.StructField("p", T.LongType()), T.StructField("s1", T.DoubleType()),
        T.StructField("s2", T.DoubleType())])

    def reducer(key, ids_a, ma, ids_b, mb, same, _ea, _eb):
        _ia, _ib, s = _pair_view(ids_a, ma, ids_b, mb, same)
        return pd.DataFrame({"p": [len(s)], "s1": [float(s.sum())], "s2": [float((s * s).sum())]})

    v = vectors.withColumn(id_col, F.col(id_col).cast("string"))
    n = sizes if sizes is not None else vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sums = evaluate_pairs(v, keys, id_col, vec_col, reducer, schema, block_size=block_size,
                          sparse_dim=sparse_dim, sizes=n).groupBy(*keys).agg(
        F.sum("p").alias("pairs"), F.sum("s1").alias("sum_s"), F.sum("s2").alias("sum_s2"))
    j = n.join(sums, keys, "left")
    pairs = F.expr("n * (n - 1) div 2")
    mean = F.col("sum_s") / F.col("pairs")
    var = F.greatest(F.col("sum_s2") / F.col("pairs") - mean * mean, F.lit(0.0))
    out = j.select(*keys, "n", pairs.alias("pairs"), F.coalesce("sum_s", F.lit(0.0)).alias("sum_s"),
                   F.coalesce("sum_s2", F.lit(0.0)).alias("sum_s2"))
    return out.select("*", F.when(F.col("pairs") > 0, mean).alias("mean_similarity"),
                      F.when(F.col("pairs") == 1, F.lit(0.0)).when(F.col("pairs") > 1, F.sqrt(var))
                       .alias("std_similarity"))

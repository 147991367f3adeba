"""Closed-form similarity moments per group, linear in the number of answers.

For unit vectors u_i of one group (a zero vector stays zero), nz non-zero
vectors, S = sum u_i and G = sum u_i u_i^T:

* sum over pairs i<j of cos(i, j)   = (|S|^2 - nz) / 2
* sum over pairs i<j of cos(i, j)^2 = (|G|_F^2 - nz) / 2

so mean and population standard deviation of the off-diagonal similarity
matrix come without forming a single pair. The work is:

1. group sizes (a count that reads the key columns alone), which give every group
   ceil(n / bucket_rows) buckets; a row's bucket is a hash of its columns, so a
   group holding a third of all rows spreads over many tasks;
2. one grouped pass per (group, bucket), at most about ``bucket_rows`` rows:
   a group of one bucket gives its final |S|^2 and |G|^2, one row; a bucket of a
   larger group gives n, nz and S in one row and the upper part of G in stripes
   of ``STRIPE`` rows, one row of bytes each (an entry per row would be d^2 / 2
   rows a bucket);
   (each bucket also gives its vector length; two lengths in a group are an error);
3. for larger groups, a sum over the buckets keyed by (group, stripe), and a sum
   of squares per group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: rows of a Gram matrix that travel together
STRIPE = 32
LENGTHS = "vectors of different lengths in one group"


def _stack(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a group as float64 matrix; NULL vectors become zero rows."""
    vals = vectors.to_numpy()
    dims = {len(v) for v in vals if v is not None}
    if len(dims) > 1:
        raise ValueError(f"{LENGTHS}: {sorted(dims)}")
    d = dims.pop() if dims else 0
    x = np.zeros((len(vals), d), dtype=np.float64)
    for i, v in enumerate(vals):
        if v is not None:
            x[i] = np.asarray(v, dtype=np.float64)
    return x, np.sqrt((x * x).sum(axis=1))


def unit_rows(x: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Rows divided by their L2 norm; zero rows stay zero."""
    safe = np.where(norms > 0, norms, 1.0)
    return x / safe[:, None]


#: rows of a bucket, about
BUCKET_ROWS = 4096
#: the same for sparse rows, which take less room than the Gram matrix that every bucket sends
SPARSE_ROWS = 16_384


_PARTIAL = "_g string, k int, n long, nz long, d int, s_sq double, g_sq double, m binary"


def _entries(n: int, nz: int, s: np.ndarray, g: np.ndarray, whole: bool) -> pd.DataFrame:
    """Final squares of a whole group (one row), or of one bucket S (k = -1) and the stripes of G from their diagonal on."""
    d = len(s)
    row = {"k": -1, "n": n, "nz": nz, "d": d or None, "s_sq": 0.0, "g_sq": 0.0, "m": None}
    if whole:
        return pd.DataFrame([row | {"s_sq": float(s @ s), "g_sq": float((g * g).sum())}])
    rows = [row | {"m": s.tobytes() if d else None}]
    rows += [row | {"k": a // STRIPE, "n": 0, "nz": 0, "m": g[a:a + STRIPE, a:].tobytes()} for a in range(0, d, STRIPE)]
    return pd.DataFrame(rows)


def _square_of_sum(k: int, parts: list) -> float:
    """|S|^2 of the sum of the parts of S, or a stripe's share of |G|^2: the diagonal block once, the rest twice."""
    total = np.zeros(0)
    for p in parts:
        x = np.frombuffer(p)
        if len(total) and len(total) != len(x):
            raise ValueError(LENGTHS)
        total = total + x if len(total) else x.copy()
    if k < 0:
        return float(total @ total)
    # a stripe of STRIPE rows, or the last one: a square of fewer
    rows = STRIPE if len(total) % STRIPE == 0 and len(total) >= STRIPE * STRIPE else math.isqrt(len(total))
    g = total.reshape(rows, -1)
    sq = (g * g)
    return float(2 * sq.sum() - sq[:, :rows].sum())


def _stack_sparse(idx: pd.Series, val: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse (idx, val) rows densified to ``dim`` columns; NULL rows become zero rows."""
    x = np.zeros((len(idx), dim), dtype=np.float64)
    for i, (ix, vx) in enumerate(zip(idx.to_numpy(), val.to_numpy())):
        if ix is not None and len(ix):
            x[i, np.asarray(ix, dtype=np.int64)] = np.asarray(vx, dtype=np.float64)
    return x, np.sqrt((x * x).sum(axis=1))


#: entries of a Gram matrix that a product of dense rows adds in the time of one entry of sparse rows
DENSE_SPEED = 500
#: products of sparse entries that are held at once, about
HELD_PRODUCTS = 2_000_000


def _sparse_gram(idx: np.ndarray, val: np.ndarray, dim: int) -> tuple[int, np.ndarray, np.ndarray] | None:
    """(nz, S, G) of sparse rows from the products of their entries; None where dense rows are faster or an index repeats."""
    size = np.array([0 if ix is None else len(ix) for ix in idx], dtype=np.int64)
    if int((size * size).sum()) * DENSE_SPEED > len(size) * dim * dim:
        return None
    s, g = np.zeros(dim), np.zeros(dim * dim)
    if not size.any():
        return 0, s, g.reshape(dim, dim)
    col = np.concatenate([np.asarray(ix, dtype=np.int64) for ix in idx[size > 0]])
    u = np.concatenate([np.asarray(vx, dtype=np.float64) for vx in val[size > 0]])
    row = np.repeat(np.arange(len(size)), size)
    if len(np.unique(row * dim + col)) < len(col):
        return None
    norms = np.sqrt(np.bincount(row, u * u, minlength=len(size)))
    u /= np.where(norms > 0, norms, 1.0)[row]
    s = np.bincount(col, u, minlength=dim)
    # rows of one size are a matrix; the products of all its entries with each other go to their places of G
    start = np.cumsum(size) - size
    for m in np.unique(size[size > 0]):
        at = start[size == m]
        step = max(1, HELD_PRODUCTS // int(m * m))
        for a in range(0, len(at), step):
            places = at[a:a + step, None] + np.arange(m)
            c, v = col[places], u[places]
            g += np.bincount((c[:, :, None] * dim + c[:, None, :]).ravel(), (v[:, :, None] * v[:, None, :]).ravel(),
                             minlength=dim * dim)
    return int((norms > 0).sum()), s, g.reshape(dim, dim)


def _dense_gram(idx: pd.Series, val: pd.Series, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(nz, S, G) of sparse rows, densified ``BUCKET_ROWS`` at a time."""
    nz, s, g = 0, np.zeros(dim), np.zeros((dim, dim))
    for a in range(0, len(idx), BUCKET_ROWS):
        x, norms = _stack_sparse(idx.iloc[a:a + BUCKET_ROWS], val.iloc[a:a + BUCKET_ROWS], dim)
        u = unit_rows(x, norms)
        nz, s, g = nz + int((norms > 0).sum()), s + u.sum(axis=0), g + u.T @ u
    return nz, s, g


def _bucket_fn(vec_col: str, sparse_dim: int | None = None):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        if sparse_dim is not None:
            nz, s, g = (_sparse_gram(pdf["_idx"].to_numpy(), pdf["_val"].to_numpy(), sparse_dim)
                        or _dense_gram(pdf["_idx"], pdf["_val"], sparse_dim))
        else:
            x, norms = _stack(pdf["_vec"])
            u = unit_rows(x, norms)
            nz, s, g = int((norms > 0).sum()), u.sum(axis=0), u.T @ u
        out = _entries(len(pdf), nz, s, g, int(pdf["_nb"].iloc[0]) == 1)
        out["d"] = out["d"].astype("Int32")  # null: a bucket of null vectors only
        out["_g"] = pdf["_g"].iloc[0]
        return out[["_g", "k", "n", "nz", "d", "s_sq", "g_sq", "m"]]

    return fn


def group_moments(vectors: DataFrame, keys: Sequence[str] = ("model", "topic"),
                  vec_col: str = "embedding", sparse_dim: int | None = None,
                  sizes: DataFrame | None = None, bucket_rows: int | None = None) -> DataFrame:
    """Per group: n, nz, pairs, sum_s, sum_s2, mean_similarity, std_similarity.

    ``mean_similarity`` is the mean off-diagonal cosine similarity (NULL for
    n <= 1) and ``std_similarity`` its population standard deviation. With
    ``sparse_dim`` the vector column is a struct (idx, val): short rows add the
    products of their entries, others are densified inside the task; ``sizes`` (keys, n) supplies group sizes when rows of zero
    vectors are absent from ``vectors``. Vectors of different lengths in one
    group are an error.
    """
    keys = list(keys)
    bucket_rows = bucket_rows or (BUCKET_ROWS if sparse_dim is None else SPARSE_ROWS)
    # keys travel as one string per group; null keys are a group of their own
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    tagged = vectors.withColumn("_g", group)
    # the sizes need the key columns only, so that scan reads no vectors
    groups = tagged.groupBy("_g", *keys).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_nb", F.ceil(F.col("_n") / F.lit(bucket_rows)).cast("int"))
    row = tagged.join(groups.select(F.col("_g").alias("_g2"), "_nb"), F.col("_g") == F.col("_g2")).withColumn(
        "_b", F.pmod(F.xxhash64(*vectors.columns), F.col("_nb")).cast("int"))
    vec = ([F.col(f"{vec_col}.idx").alias("_idx"), F.col(f"{vec_col}.val").alias("_val")] if sparse_dim is not None
           else [F.col(vec_col).alias("_vec")])
    partial = row.select("_g", "_b", "_nb", *vec).groupBy("_g", "_b").applyInPandas(
        _bucket_fn(vec_col, sparse_dim), _PARTIAL)

    @F.pandas_udf("double")
    def square(k: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([_square_of_sum(int(i), p) for i, p in zip(k, m)], dtype="float64")

    # a stripe's parts meet by (group, stripe); whole groups have none
    entries = partial.groupBy("_g", "k").agg(
        F.sum("n").alias("n"), F.sum("nz").alias("nz"), F.min("d").alias("lo"), F.max("d").alias("hi"),
        F.sum("s_sq").alias("s_sq"), F.sum("g_sq").alias("g_sq"), F.collect_list("m").alias("m"))
    entries = entries.withColumn("sq", square("k", "m")).drop("m")
    n = F.when(F.min("lo") != F.max("hi"), F.raise_error(F.lit(LENGTHS))).otherwise(F.sum("n"))
    per_group = entries.groupBy("_g").agg(
        n.cast("long").alias("n"), F.sum("nz").cast("long").alias("nz"),
        F.sum(F.col("s_sq") + F.when(F.col("k") < 0, F.col("sq")).otherwise(F.lit(0.0))).alias("s_sq"),
        F.sum(F.col("g_sq") + F.when(F.col("k") >= 0, F.col("sq")).otherwise(F.lit(0.0))).alias("g_sq"),
    )
    per_group = groups.select("_g", *keys).join(per_group, "_g").drop("_g")
    if sizes is not None:
        per_group = sizes.select(*keys, F.col("n").cast("long").alias("n")).join(
            per_group.drop("n"), keys, "left").fillna(0, ["nz"]).fillna(0.0, ["s_sq", "g_sq"])
    return finish_moments(per_group, keys)


def finish_moments(per_group: DataFrame, keys: Sequence[str]) -> DataFrame:
    """From n, nz, |S|^2, |G|_F^2 to pair sums, mean and population std."""
    n, nz = F.col("n"), F.col("nz")
    pairs = F.expr("n * (n - 1) div 2")
    sum_s = (F.col("s_sq") - nz) / 2
    sum_s2 = (F.col("g_sq") - nz) / 2
    out = per_group.select(
        *keys, "n", "nz", pairs.alias("pairs"),
        F.when(pairs > 0, sum_s).otherwise(F.lit(0.0)).alias("sum_s"),
        F.when(pairs > 0, sum_s2).otherwise(F.lit(0.0)).alias("sum_s2"))
    mean = F.col("sum_s") / F.col("pairs")
    # E[s^2] - E[s]^2 cancels when all values are close: clamp at 0, and a
    # single pair has no spread at all
    var = F.greatest(F.col("sum_s2") / F.col("pairs") - mean * mean, F.lit(0.0))
    return out.select(
        "*",
        F.when(F.col("pairs") > 0, mean).alias("mean_similarity"),
        F.when(F.col("pairs") == 1, F.lit(0.0)).when(F.col("pairs") > 1, F.sqrt(var))
         .alias("std_similarity"))


def pooled(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pool pair sums over the groups sharing ``keys`` (all pairs of all topics).

    Gives pooled mean and population std over the union of the pairs, plus the
    pair and group counts. A pool with no pairs gives NULL mean and std.
    """
    keys = list(keys)
    agg = moments.groupBy(*keys).agg(
        F.sum("pairs").alias("pairs"), F.sum("sum_s").alias("sum_s"),
        F.sum("sum_s2").alias("sum_s2"), F.count(F.lit(1)).alias("groups"))
    mean = F.col("sum_s") / F.col("pairs")
    var = F.greatest(F.col("sum_s2") / F.col("pairs") - mean * mean, F.lit(0.0))
    return agg.select(*keys, "groups", "pairs", "sum_s", "sum_s2",
                      F.when(F.col("pairs") > 0, mean).alias("mean_similarity"),
                      F.when(F.col("pairs") > 0, F.sqrt(var)).alias("std_similarity"))

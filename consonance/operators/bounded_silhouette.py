"""Exact silhouette in which bounds per cluster decide most of the work.

For a point x and a cluster c with centroid m and mean squared distance W of its
points to m, the mean distance of x to the points of c lies between |x - m| and
sqrt(|x - m|^2 + W) (the norm of a mean is at most the mean norm; the mean is at
most the root of the mean square). A cluster whose lower bound is above the
smallest upper bound of the other clusters cannot be the nearest one of x, so
distances to its points are never taken. The work is

1. sums per (group, cluster, dimension): sizes, centroids and W;
2. one projection per point over the clusters of its group: its own cluster and
   those the bounds leave open (``candidates``, checkpointed);
3. counts of the points that ask for each cluster, which give the blocks;
4. a cogroup per (group, cluster, block of the cluster, block of the asking
   points): one numpy distance block, row sums only.

A side has ``BLOCKS`` blocks at most while they hold up to ``MAX_FACTOR`` times
``block_size`` rows, so rows travel a fixed number of times; a task holds about
two blocks and ``CELL`` distances whatever the size of a group or cluster. The
clusters of one group travel as one array: number of clusters x dimensions.

Null vectors are zero vectors, null labels a cluster of their own, groups with a
null key are left out. A point alone in its cluster scores 0, a group of one
cluster NULL. Rows with equal ids in a group and cluster count as one point
whose distances are averaged.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir
from .pairs import DEFAULT_BLOCK, _key_fields, _matrix

#: bounds are widened by this share of the lengths involved (rounding)
SLACK = 1e-9
#: a cluster is cut into this many blocks at most (a row travels once per block of the other side), while its blocks
#: hold up to MAX_FACTOR times ``block_size`` rows
BLOCKS, MAX_FACTOR = 8, 32
#: distances that a task holds at once, about
CELL = 1 << 22


def _cluster_table(pts: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: ``_cl``, an array of (c, n, m, w, scale) of its clusters."""
    n = pts.groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias("n"))
    x = F.col("x")
    dims = pts.select(*keys, "_c", F.posexplode("_v").alias("pos", "x")).groupBy(*keys, "_c", "pos").agg(
        F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"))
    d = dims.groupBy(*keys, "_c").agg(F.array_sort(F.collect_list(F.struct("pos", "sx", "sxx"))).alias("s"))
    j = n.join(d, keys + ["_c"], "left")
    mean = F.coalesce(F.transform("s", lambda e: e["sx"] / F.col("n")), F.array().cast("array<double>"))
    square = F.coalesce(F.aggregate("s", F.lit(0.0), lambda a, e: a + e["sxx"] / F.col("n")), F.lit(0.0))
    j = j.select(*keys, "_c", "n", mean.alias("m"), square.alias("sq"))
    spread = F.col("sq") - F.aggregate("m", F.lit(0.0), lambda a, v: a + v * v)
    return j.groupBy(*keys).agg(F.collect_list(F.struct(
        F.col("_c").alias("c"), "n", "m", F.greatest(spread, F.lit(0.0)).alias("w"),
        F.sqrt("sq").alias("scale"))).alias("_cl"))


def _let(value: F.Column, use) -> F.Column:
    """``use(value)`` with ``value`` computed once, however often it is used (a lambda's variable is not inlined)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def candidates(points: DataFrame, keys: Sequence[str], label: str = "cluster", vec_col: str = "scaled",
               id_col: str = "persona_id") -> DataFrame:
    """Points (keys, _id, _c, _v) with ``_to``: their own cluster and every cluster that may be their nearest other."""
    keys = list(keys)
    pts = points.select(*keys, F.col(id_col).cast("string").alias("_id"),
                        F.coalesce(F.col(label).cast("string"), F.lit("None")).alias("_c"),
                        F.col(vec_col).cast("array<double>").alias("_v"))
    j = pts.join(_cluster_table(pts, keys), keys)

    def bounds(e):
        zero = F.transform(e["m"], lambda v: F.lit(0.0))
        x = F.coalesce(F.col("_v"), zero)
        m = F.when(F.size(e["m"]) > 0, e["m"]).otherwise(F.transform(x, lambda v: F.lit(0.0)))

        def of(d2):
            room = (F.sqrt(d2) + e["scale"]) * F.lit(SLACK)
            # the spread is a difference of squares: its rounding counts as a share of the squares
            wide = d2 + e["w"] + e["scale"] * e["scale"] * F.lit(1e-12)
            return F.struct(e["c"].alias("c"), e["n"].alias("n"), (F.sqrt(d2) - room).alias("low"),
                            (F.sqrt(wide) + room).alias("high"))

        return _let(F.aggregate(F.zip_with(x, m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v), of)

    def open_ones(b):
        limit = F.array_min(F.transform(F.filter(b, lambda e: e["c"] != F.col("_c")), lambda e: e["high"]))
        return _let(limit, lambda most: F.filter(b, lambda e: (e["c"] == F.col("_c")) | (e["low"] <= most)))

    # as columns of their own, the bounds would be inlined into the filter and taken once per cluster and use
    keep = _let(F.transform("_cl", bounds), open_ones)
    return j.select(*keys, "_id", "_c", "_v", F.transform(keep, lambda e: F.struct(e["c"].alias("c"), e["n"].alias("n")))
                    .alias("_to"))


def _asked(cand: DataFrame, keys: list[str]) -> DataFrame:
    """Per (group, cluster): its size and the number of points that ask for it."""
    return cand.select(*keys, F.explode("_to").alias("t")).groupBy(
        *keys, F.col("t.c").alias("_t")).agg(F.count(F.lit(1)).alias("asking"), F.max("t.n").alias("size"))


def work(cand: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: points, point-cluster sums taken, distances taken and those of all pairs (both directions)."""
    a = _asked(cand, list(keys))
    return a.groupBy(*keys).agg(F.sum("size").alias("points"), F.sum("asking").alias("sums"),
                                F.sum(F.col("asking") * F.col("size")).alias("distances"),
                                (F.sum("size") * F.sum("size")).alias("all_distances"))


def _distance_fn(keys: list[str], names: list[str]):
    def fn(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame(columns=names)
        x, y = _matrix(q["_v"], "raw"), _matrix(t["_v2"], "raw")
        if x.shape[1] != y.shape[1]:  # a side of null vectors only
            d = max(x.shape[1], y.shape[1])
            if x.shape[1] and y.shape[1]:
                raise ValueError(f"vectors of different lengths in one group: {sorted((x.shape[1], y.shape[1]))}")
            x, y = (m if m.shape[1] else np.zeros((len(m), d)) for m in (x, y))
        cnt = np.full(len(q), len(t), dtype=np.int64)
        place = {i: k for k, i in enumerate(t["_id2"])}
        target = q["_t"].iloc[0]
        own = [(r, place[i]) for r, (i, c) in enumerate(zip(q["_id"], q["_c"])) if c == target and i in place]  # the point itself
        own = np.array(own, dtype=np.int64).reshape(-1, 2)
        cnt[own[:, 0]] -= 1
        yy, sd, step = (y * y).sum(1)[None, :], np.empty(len(x)), max(1, CELL // len(y))
        for a in range(0, len(x), step):
            part = x[a:a + step]
            dist = np.sqrt(np.maximum((part * part).sum(1)[:, None] + yy - 2 * part @ y.T, 0.0))
            here = own[(own[:, 0] >= a) & (own[:, 0] < a + step)]
            dist[here[:, 0] - a, here[:, 1]] = 0.0
            sd[a:a + step] = dist.sum(axis=1)
        out = q[[*keys, "_id"]].copy()
        out["own"] = (q["_c"] == target).to_numpy()
        out["other"], out["sd"], out["cnt"] = target, sd, cnt
        return out[names]

    return fn


def _blocks(rows: F.Column, block_size: int) -> F.Column:
    """Blocks of a side of so many rows: of ``block_size`` while they are few, of more rows then."""
    size = F.greatest(F.lit(block_size), F.least(F.ceil(rows / F.lit(BLOCKS)), F.lit(MAX_FACTOR * block_size)))
    return F.ceil(rows / size).cast("int")


def silhouette(points: DataFrame, keys: Sequence[str], label: str = "cluster", vec_col: str = "scaled",
               id_col: str = "persona_id", block_size: int = DEFAULT_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(mean silhouette per group, ``work`` per group)."""
    keys = list(keys)
    checkpoint_dir(points.sparkSession)
    cand = candidates(points, keys, label, vec_col, id_col).checkpoint(eager=True)
    def blocks(c: str) -> F.Column:
        return _blocks(F.col(c), block_size)

    plan = _asked(cand, keys).select(*keys, "_t", blocks("size").alias("_nt"), blocks("asking").alias("_nq"))
    h = F.xxhash64("_id")
    q = cand.select(*keys, "_id", "_c", "_v", F.explode("_to.c").alias("_t")).join(plan, keys + ["_t"])
    q = q.select(*keys, "_t", F.explode(F.sequence(F.lit(0), F.col("_nt") - 1)).alias("_tb"),
                 F.pmod(h, F.col("_nq")).cast("int").alias("_qb"), "_id", "_c", "_v")
    t = cand.select(*keys, F.col("_c").alias("_t"), "_id", "_v").join(plan, keys + ["_t"])
    # names of their own: both sides of the cogroup come from one table
    cell_t = [*(f"_key{i}" for i in range(len(keys))), "_t2", "_tb2", "_qb2"]
    t = t.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col("_t").alias("_t2"),
                 F.pmod(h, F.col("_nt")).cast("int").alias("_tb2"),
                 F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)).alias("_qb2"),
                 F.col("_id").alias("_id2"), F.col("_v").alias("_v2"))
    schema = T.StructType(_key_fields(points, keys) + [
        T.StructField("_id", T.StringType()), T.StructField("own", T.BooleanType()),
        T.StructField("other", T.StringType()), T.StructField("sd", T.DoubleType()), T.StructField("cnt", T.LongType())])
    cell = [*keys, "_t", "_tb", "_qb"]
    parts = q.groupBy(*cell).cogroup(t.groupBy(*cell_t)).applyInPandas(_distance_fn(keys, schema.fieldNames()), schema)
    per = parts.groupBy(*keys, "_id", "own", "other").agg(F.sum("sd").alias("sd"), F.sum("cnt").alias("cnt"))
    mean = F.when(F.col("cnt") > 0, F.col("sd") / F.col("cnt"))
    point = per.groupBy(*keys, "_id").agg(F.max(F.when(F.col("own"), mean)).alias("a"),
                                          F.min(F.when(~F.col("own"), mean)).alias("b"))
    # no other point in the own cluster, or no other cluster: 0; all distances 0: 0
    s = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    s = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), s).otherwise(F.lit(0.0))
    k = points.groupBy(*keys).agg(F.countDistinct(label).alias("_k"))
    mean_s = point.groupBy(*keys).agg(F.avg(s).alias("silhouette")).join(k, keys).select(
        *keys, F.when(F.col("_k") > 1, F.col("silhouette")).alias("silhouette"))
    return mean_s, work(cand, keys)

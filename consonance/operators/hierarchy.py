"""Ward's agglomerative clustering of many groups at once, and spectral labels from a neighbour graph.

Ward: the cost of merging two clusters is n_a n_b / (n_a + n_b) times the
squared distance of their centres. It is reducible, so clusters that are each
other's nearest may be merged in any order and all at once, and the tree stays
that of merging the cheapest pair first.

* A group with more than ``LOCAL`` clusters goes through rounds over a table of
  clusters (keys, cid, n, centre): blocks of clusters meet in pairs, every
  cluster learns its nearest, and all mutual pairs merge. A round is a few
  grouped aggregates; no task holds more than two blocks.
* What is left of a group, at most ``LOCAL`` clusters, is finished by a
  nearest-neighbour chain in one task.

The larger of two cluster numbers hangs below the smaller one, so the tree is a
table of parents with heights. Cutting it at k removes the k - 1 highest merges
of a group (a distributed sort), and pointer jumping gives every row its root.

Spectral labels: rows go to the nearest of at most ``LANDMARKS`` rows of their
group (all rows of a smaller group, which makes the result exact); the means of
these cells, their 10-nearest-neighbour graph and its normalised Laplacian fit
in one task whatever the size of the group.

Defined cases: null vectors count as zero vectors; ties go to the smaller
numbers, in the order of the ids; a group with at most k rows gives every row a
label of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grid import grouped_index
from .pairs import DEFAULT_BLOCK, _key_fields, _matrix, evaluate_pairs
from .pruned_pairs import _written

#: clusters of a group that one task merges
LOCAL = 2048
#: cells of a group whose neighbour graph one task holds
LANDMARKS = 512
NEIGHBOURS = 10


def _costs(ca: np.ndarray, na: np.ndarray, cb: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Ward's cost of merging every cluster of one block with every one of another."""
    d = (ca * ca).sum(1)[:, None] + (cb * cb).sum(1) - 2 * ca @ cb.T
    return np.maximum(d, 0) * (na[:, None] * nb / (na[:, None] + nb))


def _chain(cid: np.ndarray, n: np.ndarray, c: np.ndarray) -> list[tuple[int, int, float]]:
    """(cid, parent, cost) of all merges of one group, by nearest-neighbour chains."""
    cid, n, c = cid.copy(), n.astype(float).copy(), c.copy()
    alive, out, chain = np.ones(len(cid), bool), [], []
    for _ in range(len(cid) - 1):
        while True:
            if not chain:
                chain = [int(np.flatnonzero(alive)[cid[alive].argmin()])]
            at = chain[-1]
            diff = c - c[at]
            cost = (diff * diff).sum(1) * (n * n[at] / (n + n[at]))
            cost[~alive], cost[at] = np.inf, np.inf
            near = np.flatnonzero(cost == cost.min())
            # ties: the step before, else the smallest number
            to = chain[-2] if len(chain) > 1 and chain[-2] in near else int(near[cid[near].argmin()])
            if len(chain) > 1 and to == chain[-2]:
                break
            chain.append(to)
        a, b = sorted(chain[-2:], key=lambda i: cid[i])
        out.append((int(cid[b]), int(cid[a]), float(cost[to])))
        c[a] = (n[a] * c[a] + n[b] * c[b]) / (n[a] + n[b])
        n[a] += n[b]
        alive[b] = False
        chain = chain[:-2]
    return out


def _mutual_round(clusters: DataFrame, keys: list[str], block: int) -> tuple[DataFrame, DataFrame]:
    """(clusters after, merges of) one round in which all mutual nearest pairs merge."""
    schema = T.StructType([*_key_fields(clusters, keys), T.StructField("cid", T.LongType()), T.StructField("cost", T.DoubleType()),
                           T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])

    def reducer(key, ia, ca, ib, cb, same, ea, eb):
        cost = _costs(ca, ea["n"].to_numpy(float), cb, eb["n"].to_numpy(float))
        if same:
            np.fill_diagonal(cost, np.inf)
        frames = []
        for own, other, m in ((ia, ib, cost), *(() if same else ((ib, ia, cost.T),))):
            best = m.min(axis=1)
            to = np.where(m == best[:, None], other[None, :], np.iinfo(np.int64).max).min(axis=1)
            ok = np.isfinite(best)
            frames.append(pd.DataFrame({"cid": own[ok], "cost": best[ok], "lo": np.minimum(own, to)[ok],
                                        "hi": np.maximum(own, to)[ok]}))
        return pd.concat(frames)

    near = evaluate_pairs(clusters, keys, "cid", "c", reducer, schema, extra_cols=["n"], block_size=block, metric="raw")
    best = near.groupBy(*keys, "cid").agg(F.min(F.struct("cost", "lo", "hi")).alias("m"))
    merges = best.groupBy(*keys, F.col("m.lo").alias("lo"), F.col("m.hi").alias("hi")).agg(
        F.count(F.lit(1)).alias("_both"), F.min("m.cost").alias("height")).where("_both = 2").drop("_both")
    merges = _written(merges, "ward-merges")
    a = merges.join(clusters.withColumnRenamed("cid", "lo"), [*keys, "lo"])
    b = clusters.select(*keys, F.col("cid").alias("hi"), F.col("n").alias("n2"), F.col("c").alias("c2"))
    joined = a.join(b, [*keys, "hi"]).select(
        *keys, F.col("lo").alias("cid"), (F.col("n") + F.col("n2")).alias("n"),
        F.expr("zip_with(c, c2, (x, y) -> (n * x + n2 * y) / (n + n2))").alias("c"))
    gone = merges.select(*keys, F.explode(F.array("lo", "hi")).alias("cid"))
    after = clusters.join(gone, [*keys, "cid"], "left_anti").unionByName(joined)
    return _written(after, "ward-clusters"), merges.select(*keys, F.col("hi").alias("cid"), F.col("lo").alias("parent"), "height")


def ward_tree(points: DataFrame, keys: Sequence[str], id_col: str = "persona_id", vec_col: str = "scaled", local: int = LOCAL,
              block: int = DEFAULT_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows (keys, id, cid), tree (keys, cid, parent, height)); ``cid`` numbers the rows of a group in the order of their ids."""
    keys = list(keys)
    rows = points.select(*keys, F.col(id_col).cast("string").alias(id_col), F.col(vec_col).cast("array<double>").alias("c"))
    d = rows.agg(F.max(F.size("c"))).scalar()
    zero = F.array_repeat(F.lit(0.0), F.greatest(d, F.lit(0)))
    rows = _written(grouped_index(rows.withColumn("c", F.coalesce("c", zero)), keys, [id_col], "cid", start=0), "ward-rows")
    clusters, tree = rows.select(*keys, "cid", F.lit(1).cast("long").alias("n"), "c"), None
    rest = None
    while True:
        size = clusters.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        small = clusters.join(size.where(F.col("_n") <= local).select(*keys), keys, "left_semi")
        rest = small if rest is None else rest.unionByName(small)
        large = clusters.join(size.where(F.col("_n") > local).select(*keys), keys, "left_semi")
        if large.isEmpty():
            break
        clusters, merges = _mutual_round(large, keys, block)
        tree = merges if tree is None else tree.unionByName(merges)
    schema = T.StructType([*_key_fields(rows, keys), T.StructField("cid", T.LongType()), T.StructField("parent", T.LongType()),
                           T.StructField("height", T.DoubleType())])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        merges = _chain(pdf["cid"].to_numpy(), pdf["n"].to_numpy(), _matrix(pdf["c"], "raw"))
        out = pd.DataFrame(merges, columns=["cid", "parent", "height"])
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    last = _written(rest.groupBy(*keys).applyInPandas(finish, schema), "ward-merges")
    return rows.select(*keys, id_col, "cid"), last if tree is None else tree.unionByName(last)


def cut(rows: DataFrame, tree: DataFrame, keys: Sequence[str], k: DataFrame | int, id_col: str = "persona_id") -> DataFrame:
    """(keys, id, cluster): the tree of each group cut into k clusters (a number, or a table keys, k), numbered by their first row."""
    keys = list(keys)
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("k", F.lit(k)) if isinstance(k, int) else n.join(k.select(*keys, "k"), keys)
    order = grouped_index(tree, keys, ["height", "cid"], "_rank", start=1).join(n, keys)
    kept = order.where("_rank <= _n - k").select(*keys, "cid", F.col("parent").alias("root"))
    at = _written(rows.join(n.select(*keys), keys, "left_semi").join(kept, [*keys, "cid"], "left").withColumn(
        "root", F.coalesce("root", "cid")), "ward-roots")
    while True:
        up = at.select(*keys, F.col("cid").alias("root"), F.col("root").alias("_up"))
        nxt = _written(at.join(up, [*keys, "root"]).select(*keys, id_col, "cid", F.col("_up").alias("root"),
                                                           (F.col("_up") != F.col("root")).alias("_moved")), "ward-roots")
        at = nxt.drop("_moved")
        if nxt.where("_moved").isEmpty():
            break
    roots = at.select(*keys, "root").distinct().withColumn(
        "cluster", (F.row_number().over(Window.partitionBy(*keys).orderBy("root")) - 1).cast("int"))
    return at.join(roots, [*keys, "root"]).select(*keys, id_col, "cluster")


def agglomerative(points: DataFrame, keys: Sequence[str], k: DataFrame | int, id_col: str = "persona_id",
                  vec_col: str = "scaled", local: int = LOCAL, block: int = DEFAULT_BLOCK) -> DataFrame:
    """(keys, id, cluster): Ward's clusters of every group."""
    rows, tree = ward_tree(points, keys, id_col, vec_col, local, block)
    return cut(rows, tree, keys, k, id_col)


# --- spectral labels ------------------------------------------------------------------------

def neighbour_graph(x: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Symmetric affinities: half for each direction in which one row is among the nearest of the other (itself included)."""
    d = (x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T
    np.fill_diagonal(d, -np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :min(neighbours, len(x))]
    a = np.zeros(d.shape)
    np.put_along_axis(a, near, 1.0, axis=1)
    return (a + a.T) / 2


def spectral_cells(x: np.ndarray, k: int, neighbours: int = NEIGHBOURS, rounds: int = 100) -> np.ndarray:
    """Labels of a few rows: k-means, from farthest-first starts, on the eigenvectors of the normalised graph."""
    if len(x) <= k:
        return np.arange(len(x))
    a = neighbour_graph(x, neighbours)
    np.fill_diagonal(a, 0)
    deg = np.sqrt(np.maximum(a.sum(1), 1e-12))
    _, v = np.linalg.eigh(a / deg[:, None] / deg)
    e = v[:, -k:] / deg[:, None]
    e = e / np.maximum(np.abs(e).max(axis=0), 1e-12)
    starts = [int(np.lexsort((np.arange(len(e)), -(e * e).sum(1)))[0])]
    far = ((e - e[starts[0]]) ** 2).sum(1)
    while len(starts) < k:
        starts.append(int(far.argmax()))
        far = np.minimum(far, ((e - e[starts[-1]]) ** 2).sum(1))
    centres, lab = e[starts], None
    for _ in range(rounds):
        new = ((e[:, None] - centres) ** 2).sum(-1).argmin(1)
        if lab is not None and (new == lab).all():
            break
        lab = new
        centres = np.stack([e[lab == j].mean(0) if (lab == j).any() else centres[j] for j in range(k)])
    return lab


def spectral(points: DataFrame, keys: Sequence[str], k: DataFrame | int, id_col: str = "persona_id", vec_col: str = "scaled",
             landmarks: int = LANDMARKS, block: int = DEFAULT_BLOCK) -> DataFrame:
    """(keys, id, cluster): spectral clusters of every group (k: a number, or a table keys, k)."""
    keys = list(keys)
    rows = points.select(*keys, F.col(id_col).cast("string").alias(id_col), F.col(vec_col).cast("array<double>").alias("c"))
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_chunks", F.ceil(F.col("_n") / block).cast("int"))
    first = Window.partitionBy(*keys).orderBy(F.xxhash64(id_col), id_col)
    marks = _written(rows.withColumn("cell", F.row_number().over(first)).where(F.col("cell") <= landmarks)
                     .select(*keys, "cell", F.col("c").alias("m")), "landmarks")
    near = T.StructType([*_key_fields(rows, keys), T.StructField(id_col, T.StringType()), T.StructField("cell", T.IntegerType()),
                         T.StructField("c", T.ArrayType(T.DoubleType()))])

    def nearest(r: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(r):
            return pd.DataFrame(columns=near.fieldNames())
        m = m.sort_values("cell")
        both = _matrix(pd.concat([r["c"], m["m"]], ignore_index=True), "raw")
        x, y = both[:len(r)], both[len(r):]
        at = _costs(x, np.ones(len(x)), y, np.ones(len(y))).argmin(axis=1)
        return r.assign(cell=m["cell"].to_numpy()[at].astype(np.int32), c=list(x))[near.fieldNames()]

    chunk = F.pmod(F.xxhash64(id_col), F.col("_chunks").cast("long")).cast("int")
    dealt = rows.join(n, keys).withColumn("_chunk", chunk)
    to_all = marks.join(n, keys).select(*keys, "cell", "m", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"))
    cells = _written(dealt.select(*keys, id_col, "c", "_chunk").groupBy(*keys, "_chunk").cogroup(
        to_all.groupBy(*keys, "_chunk")).applyInPandas(nearest, near), "spectral-cells")
    sums = cells.select(*keys, "cell", F.posexplode("c").alias("_pos", "_x")).groupBy(*keys, "cell", "_pos").agg(
        F.avg("_x").alias("_x")).groupBy(*keys, "cell").agg(F.sort_array(F.collect_list(F.struct("_pos", "_x"))).alias("_m"))
    means = sums.select(*keys, "cell", F.col("_m._x").alias("m"))
    kk = n.select(*keys, F.lit(k).cast("int").alias("k")) if isinstance(k, int) else k.select(*keys, F.col("k").cast("int"))
    schema = T.StructType([*_key_fields(rows, keys), T.StructField("cell", T.IntegerType()), T.StructField("cluster", T.IntegerType())])

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        lab = spectral_cells(_matrix(pdf["m"], "raw"), int(pdf["k"].iloc[0]))
        return pdf.assign(cluster=lab.astype(np.int32))[schema.fieldNames()]

    labels = means.join(kk, keys).groupBy(*keys).applyInPandas(label, schema)
    return cells.join(labels, [*keys, "cell"]).select(*keys, id_col, "cluster")

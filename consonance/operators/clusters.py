"""Clustering of answer vectors per group, cluster quality indices and 3-D reduction.

Grouping keys are arbitrary (model, topic, ...). Everything runs for all
groups at once:

* standardisation, Calinski-Harabasz, Davies-Bouldin: grouped aggregates;
* silhouette: bounds per cluster first, then Euclidean distances in blocks
  (``operators.bounded_silhouette``), sums per (point, cluster) only;
* PCA: Gram partials per partition (numpy), summed by Spark, one small
  eigen-decomposition per group, projection by a join on the group key;
* k-means and Gaussian mixtures: every iteration is one distributed pass
  that sends per (group, k, component) sufficient statistics back; only the
  model parameters (groups x components x dims, size-checked) are held on the
  driver between iterations, as Spark ML's own estimators do. All groups and
  all k of a sweep advance together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pairs import DEFAULT_BLOCK, _key_fields, evaluate_pairs

MAX_MODEL_DOUBLES = 50_000_000  # size check for parameters held between iterations
WORST = {"silhouette": -1.0, "calinski_harabasz": 0.0, "davies_bouldin": math.inf,
         "bic": math.inf, "aic": math.inf}


# ---------------------------------------------------------------------------
# per-dimension statistics and standardisation


def _as_double_array(c: F.Column) -> F.Column:
    return F.transform(c, lambda x: x.cast("double"))


def dim_stats(vectors: DataFrame, keys: Sequence[str], vec_col: str = "embedding") -> DataFrame:
    """Per group: arrays of per-dimension mean and population std."""
    keys = list(keys)
    ex = vectors.select(*keys, F.posexplode(_as_double_array(F.col(vec_col))).alias("pos", "x"))
    s = ex.groupBy(*keys, "pos").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    g = s.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "mu", "sd"))).alias("_s"))
    return g.select(*keys, F.col("_s.mu").alias("mean"), F.col("_s.sd").alias("std"))


def standardize(vectors: DataFrame, keys: Sequence[str], vec_col: str = "embedding",
                out_col: str = "scaled") -> DataFrame:
    """Centre each dimension and divide by its population std (zero std: not scaled)."""
    keys = list(keys)
    st = dim_stats(vectors, keys, vec_col)
    j = vectors.join(st, keys)
    scaled = F.zip_with(F.zip_with(_as_double_array(F.col(vec_col)), F.col("mean"), lambda x, m: x - m),
                        F.col("std"), lambda c, s: F.when(s > 0, c / s).otherwise(c))
    return j.withColumn(out_col, scaled).drop("mean", "std")


#: fixed value: the error text of a group that has no vectors
NO_EMBEDDINGS = "No embeddings available"


def group_outcomes(groups: DataFrame, analysed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for every group of ``groups``: its row of ``analysed``, or an error row.

    A group without a row there has no vectors: ``error`` says so, it counts one
    cluster and no negative pair. Groups with a null key are left out.
    """
    keys = list(keys)
    g = groups.select(*keys).where(F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)) == F.lit(False)).distinct()
    j = g.join(analysed.withColumn("_found", F.lit(True)), keys, "left")
    error = F.when(F.col("_found").isNull(), F.lit(NO_EMBEDDINGS))
    return (j.withColumn("error", error).withColumn("optimal_clusters", F.coalesce("optimal_clusters", F.lit(1)))
             .withColumn("negative_count", F.coalesce("negative_count", F.lit(0)))
             .withColumn("has_negative", F.coalesce("has_negative", F.lit(False))).drop("_found"))


# ---------------------------------------------------------------------------
# cluster quality indices for given labels


def _sq_dist(a: F.Column, b: F.Column) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def centroids(points: DataFrame, keys: Sequence[str], label: str, vec_col: str) -> DataFrame:
    """Per (group, cluster): size and centroid array."""
    keys = list(keys)
    ex = points.select(*keys, label, F.posexplode(_as_double_array(F.col(vec_col))).alias("pos", "x"))
    s = ex.groupBy(*keys, label, "pos").agg(F.avg("x").alias("mu"), F.count(F.lit(1)).alias("n"))
    g = s.groupBy(*keys, label).agg(F.array_sort(F.collect_list(F.struct("pos", "mu"))).alias("_c"),
                                    F.max("n").alias("size"))
    return g.select(*keys, label, "size", F.col("_c.mu").alias("centroid"))


def calinski_harabasz(points: DataFrame, keys: Sequence[str], label: str = "cluster",
                      vec_col: str = "scaled") -> DataFrame:
    """Between / within dispersion ratio per group (1.0 when within dispersion is 0)."""
    keys = list(keys)
    x = F.posexplode(_as_double_array(F.col(vec_col))).alias("pos", "x")
    ex = points.select(*keys, label, x)
    per_c = ex.groupBy(*keys, label, "pos").agg(F.count(F.lit(1)).alias("nc"), F.sum("x").alias("sx"),
                                                F.sum(F.col("x") * F.col("x")).alias("sxx"))
    per_d = per_c.groupBy(*keys, "pos").agg(F.sum("nc").alias("n"), F.sum("sx").alias("tx"),
                                            F.sum("sxx").alias("txx"),
                                            F.sum(F.col("sx") * F.col("sx") / F.col("nc")).alias("between_raw"))
    # W = sum_c sum (x - mu_c)^2 = txx - sum_c sx^2/nc ; B = sum_c sx^2/nc - tx^2/n
    agg = per_d.groupBy(*keys).agg(
        F.sum(F.col("txx") - F.col("between_raw")).alias("w"),
        F.sum(F.col("between_raw") - F.col("tx") * F.col("tx") / F.col("n")).alias("b"),
        F.max("n").alias("n"))
    k = points.groupBy(*keys).agg(F.countDistinct(label).alias("_k"))
    j = agg.join(k, keys)
    ch = F.when(F.col("w") == 0, F.lit(1.0)).otherwise(
        F.col("b") * (F.col("n") - F.col("_k")) / (F.col("w") * (F.col("_k") - 1)))
    return j.select(*keys, F.when(F.col("_k") > 1, ch).alias("calinski_harabasz"))


def davies_bouldin(points: DataFrame, keys: Sequence[str], label: str = "cluster",
                   vec_col: str = "scaled") -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / d(c_i, c_j) per group.

    s_i is the mean Euclidean distance of a cluster's points to its centroid.
    The centroid pairs of a group number at most k(k-1)/2 (k clusters).
    """
    keys = list(keys)
    c = centroids(points, keys, label, vec_col)
    pj = points.join(c.select(*keys, label, "centroid"), keys + [label])
    intra = pj.groupBy(*keys, label).agg(
        F.avg(F.sqrt(_sq_dist(_as_double_array(F.col(vec_col)), F.col("centroid")))).alias("s"))
    cc = c.join(intra, keys + [label])
    a = cc.select(*keys, F.col(label).alias("ci"), F.col("centroid").alias("ca"), F.col("s").alias("sa"))
    b = cc.select(*keys, F.col(label).alias("cj"), F.col("centroid").alias("cb"), F.col("s").alias("sb"))
    # centroid pairs: bounded by the number of clusters per group
    pairs = a.join(b, keys).where(F.col("ci") != F.col("cj"))
    d = F.sqrt(_sq_dist(F.col("ca"), F.col("cb")))
    ratio = F.when(d > 0, (F.col("sa") + F.col("sb")) / d)
    worst = pairs.groupBy(*keys, "ci").agg(F.max(ratio).alias("r"), F.max(d).alias("dmax"),
                                           F.max("sa").alias("sa"))
    return worst.groupBy(*keys).agg(
        F.when((F.max("dmax") == 0) | (F.max("sa") == 0), F.lit(0.0))
         .otherwise(F.avg(F.coalesce("r", F.lit(0.0)))).alias("davies_bouldin"))


def silhouette(points: DataFrame, keys: Sequence[str], label: str = "cluster",
               vec_col: str = "scaled", id_col: str = "persona_id",
               block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """Mean silhouette (Euclidean) per group; a point alone in its cluster scores 0.

    Clusters that cannot be a point's nearest one are skipped (``bounded_silhouette``).
    """
    from . import bounded_silhouette

    return bounded_silhouette.silhouette(points, keys, label, vec_col, id_col, block_size)[0]


def bic_aic(log_likelihood: F.Column, k: F.Column, d: F.Column, n: F.Column) -> tuple[F.Column, F.Column]:
    """BIC and AIC of a full-covariance Gaussian mixture with k components in d dims."""
    p = k * d * (d + 1) / 2 + k * d + k - 1
    return -2 * log_likelihood + p * F.log(n), -2 * log_likelihood + 2 * p


def choose_k(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Composite score per (group, k) and the winning k per group.

    Composite = plain mean of the available raw values silhouette (> -1),
    calinski_harabasz (> 0), 1/davies_bouldin, 1/bic, 1/aic (finite); highest
    wins, the smallest k on ties. Groups with no metrics get k = 1.
    """
    keys = list(keys)
    parts = [
        F.when(F.col("silhouette") > -1, F.col("silhouette")),
        F.when(F.col("calinski_harabasz") > 0, F.col("calinski_harabasz")),
        F.when(F.col("davies_bouldin").isNotNull() & ~F.isnan("davies_bouldin")
               & (F.col("davies_bouldin") != math.inf) & (F.col("davies_bouldin") != 0),
               1 / F.col("davies_bouldin")),
        F.when(F.col("bic").isNotNull() & (F.col("bic") != math.inf) & (F.col("bic") != 0), 1 / F.col("bic")),
        F.when(F.col("aic").isNotNull() & (F.col("aic") != math.inf) & (F.col("aic") != 0), 1 / F.col("aic")),
    ]
    total = F.aggregate(F.array(*[F.coalesce(p, F.lit(0.0)) for p in parts]), F.lit(0.0), lambda a, b: a + b)
    count = F.aggregate(F.array(*[p.isNotNull().cast("int") for p in parts]), F.lit(0), lambda a, b: a + b)
    scored = metrics.withColumn("composite", F.when(count > 0, total / count).otherwise(F.lit(0.0)))
    w = Window.partitionBy(*keys).orderBy(F.desc("composite"), F.asc("k"))
    best = scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    return best.select(*keys, F.col("k").alias("optimal_clusters"), "composite")


# ---------------------------------------------------------------------------
# grouped Gram partials, PCA


def _gram_fn(keys: list[str], vec_col: str):
    def fn(batches):
        acc: dict[tuple, list] = {}
        for pdf in batches:
            for key, idx in pdf.groupby(keys, sort=False, dropna=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec_col].iloc[idx]])
                cur = acc.setdefault(key, [0, 0.0, 0.0])
                cur[0] += len(idx)
                cur[1] = cur[1] + x.sum(0)
                cur[2] = cur[2] + x.T @ x
        for key, (n, s, g) in acc.items():
            d = len(s)
            kind = np.concatenate([[0], np.ones(d), np.full(d * d, 2)]).astype(np.int32)
            k = np.concatenate([[0], np.arange(d), np.arange(d * d)]).astype(np.int64)
            v = np.concatenate([[float(n)], s, g.ravel()])
            out = pd.DataFrame({"kind": kind, "k": k, "v": v})
            for name, val in zip(keys, key):
                out[name] = val
            yield out[keys + ["kind", "k", "v"]]
    return fn


def pca_models(vectors: DataFrame, keys: Sequence[str], vec_col: str, n_components: int) -> DataFrame:
    """Per group: mean vector, component matrix (rows) and explained variance ratios.

    Each component's largest-magnitude loading is made positive.
    """
    keys = list(keys)
    kf = _key_fields(vectors, keys)
    partial_schema = T.StructType(kf + [T.StructField("kind", T.IntegerType()),
                                        T.StructField("k", T.LongType()), T.StructField("v", T.DoubleType())])
    partial = vectors.select(*keys, _as_double_array(F.col(vec_col)).alias(vec_col)).mapInPandas(
        _gram_fn(keys, vec_col), partial_schema)
    entries = partial.groupBy(*keys, "kind", "k").agg(F.sum("v").alias("v"))
    out_schema = T.StructType(kf + [
        T.StructField("mean", T.ArrayType(T.DoubleType())),
        T.StructField("components", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("explained_variance_ratio", T.ArrayType(T.DoubleType()))])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n = float(pdf.loc[pdf.kind == 0, "v"].iloc[0])
        s = pdf[pdf.kind == 1].sort_values("k")["v"].to_numpy()
        d = len(s)
        g = np.zeros(d * d)
        gg = pdf[pdf.kind == 2]
        g[gg["k"].to_numpy()] = gg["v"].to_numpy()
        mu = s / n
        cov = g.reshape(d, d) / n - np.outer(mu, mu)
        vals, vecs = np.linalg.eigh(cov)
        order = np.argsort(vals)[::-1][:n_components]
        vals, comps = np.clip(vals[order], 0, None), vecs[:, order].T
        for i in range(len(comps)):
            j = np.argmax(np.abs(comps[i]))
            if comps[i, j] < 0:
                comps[i] = -comps[i]
        tot = np.clip(np.linalg.eigvalsh(cov), 0, None).sum()
        ratio = vals / tot if tot > 0 else np.zeros_like(vals)
        row = {k: pdf[k].iloc[0] for k in keys}
        row.update(mean=list(mu), components=[list(c) for c in comps], explained_variance_ratio=list(ratio))
        return pd.DataFrame([row])

    return entries.groupBy(*keys).applyInPandas(fit, out_schema)


def pca_project(vectors: DataFrame, keys: Sequence[str], vec_col: str = "scaled",
                n_components: int = 3, out_col: str = "coords") -> DataFrame:
    """Project each vector on its group's first components (after centring).

    Vectors with at most ``n_components`` dimensions are returned as they are.
    """
    keys = list(keys)
    models = pca_models(vectors, keys, vec_col, n_components)
    j = vectors.join(models.select(*keys, "mean", "components"), keys)
    v = _as_double_array(F.col(vec_col))
    centred = F.zip_with(v, F.col("mean"), lambda a, m: a - m)
    proj = F.transform(F.col("components"), lambda c: F.aggregate(
        F.zip_with(centred, c, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    keep = F.size(v) <= n_components
    return j.withColumn(out_col, F.when(keep, v).otherwise(proj)).drop("mean", "components")


def reduce_3d(vectors: DataFrame, keys: Sequence[str], vec_col: str = "scaled", method: str = "pca",
              id_col: str = "persona_id") -> DataFrame:
    """x, y, z per vector by PCA or classical MDS (equal to PCA scores for Euclidean data)."""
    if method not in ("pca", "mds"):
        raise ValueError(f"unknown reduction method {method!r}; use 'pca' or 'mds'")
    p = pca_project(vectors, keys, vec_col, 3, "_c")
    return p.select(*keys, id_col, *[F.col("_c")[i].alias(n) for i, n in enumerate("xyz")])


def point_table(coords: DataFrame, labels: DataFrame, keys: Sequence[str], id_col: str = "persona_id",
                size: int = 8) -> DataFrame:
    """Plot-ready rows: x, y, z, id, color (cluster), size, group."""
    keys = list(keys)
    j = coords.join(labels.select(*keys, id_col, "cluster"), keys + [id_col], "left")
    return j.select("x", "y", "z", F.col(id_col).alias("id"), F.col("cluster").alias("color"),
                    F.lit(size).alias("size"), F.concat_ws("|", *keys).alias("group"))


# ---------------------------------------------------------------------------
# grouped k-means and Gaussian mixtures


#: the mixture's starts and iterations, and k-means iterations, unless the caller says otherwise
N_INIT, MIXTURE_ITER, KMEANS_ITER = 10, 1000, 300


def _by_group(params: dict) -> dict:
    """{(group, k): p} -> {group: [(k, p), ...]} for per-group lookups inside tasks."""
    out: dict = {}
    for (g, k), p in params.items():
        out.setdefault(g, []).append((k, p))
    return out


def _check_size(n_doubles: int) -> None:
    if n_doubles > MAX_MODEL_DOUBLES:
        raise ValueError(f"model parameters of {n_doubles} doubles exceed {MAX_MODEL_DOUBLES}; "
                         "reduce dimensions (PCA) or the number of groups per call")


def _dense(points: DataFrame, keys, id_col, vec_col) -> DataFrame:
    return points.select(*keys, F.col(id_col).cast("string").alias("_id"),
                         _as_double_array(F.col(vec_col)).alias("_x"))


def _init_centres(points: DataFrame, keys: list[str], ks: Sequence[int], seed: int) -> dict:
    """k seeded points per (group, k): the k smallest hashes, chosen in two salted steps."""
    kmax = max(ks)
    h = points.withColumn("_h", F.xxhash64("_id", F.lit(seed))).withColumn(
        "_b", F.pmod(F.col("_h"), F.lit(64)))
    w1 = Window.partitionBy(*keys, "_b").orderBy("_h", "_id")
    c = h.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= kmax)
    w2 = Window.partitionBy(*keys).orderBy("_h", "_id")
    c = c.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= kmax)
    rows = c.select(*keys, "_r", "_x").collect()  # at most groups x kmax rows
    by_group: dict[tuple, list] = {}
    for r in rows:
        by_group.setdefault(tuple(r[k] for k in keys), []).append((r["_r"], np.asarray(r["_x"])))
    out = {}
    for g, lst in by_group.items():
        lst.sort(key=lambda t: t[0])
        for k in ks:
            if len(lst) >= k:
                out[(g, k)] = np.stack([x for _, x in lst[:k]])
    return out


def _stats_schema(points: DataFrame, keys):
    return T.StructType(_key_fields(points, keys) + [
        T.StructField("k", T.IntegerType()), T.StructField("c", T.IntegerType()),
        T.StructField("kind", T.IntegerType()), T.StructField("idx", T.IntegerType()),
        T.StructField("v", T.DoubleType())])


def _stat_rows(keys: list[str], acc: dict) -> pd.DataFrame | None:
    """Long-form statistics: kind 0 = weight, 1 = log-likelihood, 2 = sum x, 3 = sum x x^T."""
    frames = []
    for (g, k, j), (n, sx, sxx, ll) in acc.items():
        parts = [([0], [0], [n]), ([1], [0], [ll]), ([2] * len(sx), range(len(sx)), sx)]
        if sxx is not None:
            flat = np.asarray(sxx).ravel()
            parts.append(([3] * len(flat), range(len(flat)), flat))
        kind = np.concatenate([np.asarray(a, dtype=np.int32) for a, _, _ in parts])
        idx = np.concatenate([np.asarray(list(b), dtype=np.int32) for _, b, _ in parts])
        v = np.concatenate([np.asarray(c, dtype=np.float64) for _, _, c in parts])
        f = pd.DataFrame({"kind": kind, "idx": idx, "v": v})
        for name, val in zip(keys, g):
            f[name] = val
        f["k"] = k
        f["c"] = j
        frames.append(f)
    return pd.concat(frames, ignore_index=True) if frames else None


def _collect_stats(stats: DataFrame, keys: list[str], d: int) -> dict:
    """Sum the per-partition statistics by (group, k, component, entry) and bring them back.

    One shuffle, keyed by the entry so a hot group spreads out; only
    model-sized sums (groups x components x (d*d + d + 2)) reach the driver.
    """
    gk = keys + ["k", "c"]
    pdf = stats.groupBy(*gk, "kind", "idx").agg(F.sum("v").alias("v")).toPandas()
    out: dict = {}
    for key, part in pdf.groupby(gk, sort=False):
        g = tuple(key[:len(keys)])
        kinds, idx, v = part["kind"].to_numpy(), part["idx"].to_numpy(), part["v"].to_numpy()
        sx = np.zeros(d)
        sx[idx[kinds == 2]] = v[kinds == 2]
        sxx = None
        if (kinds == 3).any():
            sxx = np.zeros(d * d)
            sxx[idx[kinds == 3]] = v[kinds == 3]
        n = float(v[kinds == 0].sum())
        ll = float(v[kinds == 1].sum())
        out[(g, int(key[len(keys)]), int(key[len(keys) + 1]))] = (n, sx, sxx, ll)
    return out


def kmeans(points: DataFrame, keys: Sequence[str], ks: Sequence[int], id_col: str = "persona_id",
           vec_col: str = "scaled", max_iter: int = KMEANS_ITER, seed: int = 42, tol: float = 1e-6):
    """Grouped Lloyd k-means for every group and every k in ``ks`` at once.

    Each (group, k) stops by its own rule, so a fit does not depend on what
    else is in the call. Returns (labels DataFrame (keys, k, id, cluster), centres dict). Groups with
    fewer than k points get no fit for that k.
    """
    keys = list(keys)
    spark = points.sparkSession
    pts = _dense(points, keys, id_col, vec_col).cache()
    centres = _init_centres(pts, keys, ks, seed)
    if not centres:
        pts.unpersist()
        return None, {}
    d = next(iter(centres.values())).shape[1]
    _check_size(sum(c.size for c in centres.values()))
    schema = _stats_schema(pts, keys)
    moving = set(centres)
    for _ in range(max_iter):
        bc = spark.sparkContext.broadcast({gk: centres[gk] for gk in moving})

        def step(batches, bc=bc):
            cs = _by_group(bc.value)
            acc: dict = {}
            for pdf in batches:
                for key, idx in pdf.groupby(keys, sort=False).indices.items():
                    g = key if isinstance(key, tuple) else (key,)
                    x = np.stack(pdf["_x"].iloc[idx].to_numpy())
                    for k, c in cs.get(g, ()):
                        lab = _nearest(x, c)
                        for j in range(k):
                            m = lab == j
                            if m.any():
                                cur = acc.setdefault((g, k, j), [0.0, np.zeros(d)])
                                cur[0] += m.sum()
                                cur[1] += x[m].sum(0)
            out = _stat_rows(keys, {key: (v[0], v[1], None, 0.0) for key, v in acc.items()})
            if out is not None:
                yield out[schema.fieldNames()]

        stats = _collect_stats(pts.mapInPandas(step, schema), keys, d)
        bc.unpersist()
        for (g, k) in sorted(moving, key=str):
            c = centres[(g, k)]
            c2 = c.copy()
            for j in range(k):
                st = stats.get((g, k, j))
                if st and st[0] > 0:
                    c2[j] = st[1] / st[0]
            centres[(g, k)] = c2
            if float(np.abs(c2 - c).max()) <= tol:
                moving.discard((g, k))
        if not moving:
            break
    labels = _assign(pts, keys, centres, spark)
    return labels, centres


def _assign(pts: DataFrame, keys: list[str], centres: dict, spark) -> DataFrame:
    bc = spark.sparkContext.broadcast(centres)
    schema = T.StructType(_key_fields(pts, keys) + [
        T.StructField("k", T.IntegerType()), T.StructField("_id", T.StringType()),
        T.StructField("cluster", T.IntegerType())])

    def fn(batches):
        cs = _by_group(bc.value)
        for pdf in batches:
            out = []
            for key, idx in pdf.groupby(keys, sort=False).indices.items():
                g = key if isinstance(key, tuple) else (key,)
                x = np.stack(pdf["_x"].iloc[idx].to_numpy())
                ids = pdf["_id"].iloc[idx].to_numpy()
                for k, c in cs.get(g, ()):
                    lab = _nearest(x, c)
                    out.append(pd.DataFrame({**{kk: [g[i]] * len(ids) for i, kk in enumerate(keys)},
                                             "k": k, "_id": ids, "cluster": lab.astype(np.int32)}))
            if out:
                yield pd.concat(out, ignore_index=True)[schema.fieldNames()]

    return pts.mapInPandas(fn, schema)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centre of every row, the first one on ties.

    Distances come from one matrix product; rows whose two nearest centres are
    within its rounding are measured again by differences.
    """
    if len(c) == 1:
        return np.zeros(len(x), dtype=np.intp)
    size = np.einsum("ij,ij->i", x, x)
    dist = (c * c).sum(1)[None, :] - 2 * (x @ c.T)
    lab = dist.argmin(1)
    two = np.partition(dist, 1, axis=1)
    scale = size + float((c * c).sum(1).max())
    close = np.flatnonzero(~(two[:, 1] - two[:, 0] > 1e-9 * scale))
    for a in range(0, len(close), 4096):
        rows = close[a:a + 4096]
        lab[rows] = ((x[rows][:, None, :] - c[None, :, :]) ** 2).sum(-1).argmin(1)
    return lab


def _log_gauss(x: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = x.shape[1]
    chol = np.linalg.cholesky(cov)
    # products with the inverse factor, in blocks that stay in the cache: a solve would factorise the triangle again
    whiten = np.ascontiguousarray(np.linalg.inv(chol).T)
    size, block = np.empty(len(x)), min(len(x), 1024)
    diff, z = np.empty((block, d)), np.empty((block, d))
    for a in range(0, len(x), block or 1):
        m = min(block, len(x) - a)
        np.subtract(x[a:a + m], mu, out=diff[:m])
        np.matmul(diff[:m], whiten, out=z[:m])
        np.einsum("ij,ij->i", z[:m], z[:m], out=size[a:a + m])
    return -0.5 * (d * np.log(2 * np.pi) + size) - np.log(np.diag(chol)).sum()


#: shares of a row in a component below this add nothing to sums of doubles (and are slow as denormal numbers)
NO_SHARE = 1e-100


def _outer_sum(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """sum of r_i x_i x_i^T (a matrix times its own transpose takes half the work)."""
    rows = np.flatnonzero(r > NO_SHARE)
    y = (x if len(rows) == len(r) else x[rows]) * np.sqrt(r[rows])[:, None]
    return y.T @ y


def _log_joint(x: np.ndarray, w: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> np.ndarray | None:
    """log(weight * density) per row and component; None when a covariance cannot be factorised."""
    try:
        return np.stack([np.log(max(w[j], 1e-300)) + _log_gauss(x, mu[j], cov[j]) for j in range(len(w))], axis=1)
    except np.linalg.LinAlgError:
        return None


def gaussian_mixture(points: DataFrame, keys: Sequence[str], ks: Sequence[int],
                     id_col: str = "persona_id", vec_col: str = "scaled", max_iter: int = MIXTURE_ITER,
                     tol: float = 1e-4, reg_covar: float = 1e-6, seed: int = 42):
    """Grouped full-covariance EM for every group and every k, started from k-means.

    Returns (labels (keys, k, id, cluster), log-likelihoods {(group, k): logL},
    dims). Each (group, k) stops by its own rule; one whose covariance cannot
    be factorised has failed: log-likelihood -inf and the single label 0. One
    distributed pass per EM iteration; the per-component
    sufficient statistics (n, sum x, sum x x^T) and the log-likelihood are
    summed by Spark.
    """
    keys = list(keys)
    spark = points.sparkSession
    km_labels, centres = kmeans(points, keys, ks, id_col, vec_col, seed=seed)
    if not centres:
        return None, {}, 0
    pts = _dense(points, keys, id_col, vec_col).cache()
    d = next(iter(centres.values())).shape[1]
    _check_size(sum(c.shape[0] * (d * d + d + 1) for c in centres.values()))
    # initial parameters from the k-means partition (component stats in one pass)
    lab = km_labels.withColumnRenamed("cluster", "c")
    init = (pts.join(lab, keys + ["_id"]).groupBy(*keys, "k", "c")
               .agg(F.count(F.lit(1)).alias("n")).collect())
    sizes = {(tuple(r[k] for k in keys), r["k"], r["c"]): r["n"] for r in init}
    params = {}
    for (g, k), c in centres.items():
        tot = sum(sizes.get((g, k, j), 0) for j in range(k))
        w = np.array([max(sizes.get((g, k, j), 0), 1) / max(tot, 1) for j in range(k)])
        params[(g, k)] = (w / w.sum(), c.copy(), np.stack([np.eye(d)] * k))
    schema = _stats_schema(pts, keys)
    prev_ll: dict = {}
    ll_out: dict = {}
    moving = set(params)
    for it in range(max_iter):
        bc = spark.sparkContext.broadcast({gk: params[gk] for gk in moving})

        def estep(batches, bc=bc):
            ps = _by_group(bc.value)
            acc: dict = {}
            for pdf in batches:
                for key, idx in pdf.groupby(keys, sort=False).indices.items():
                    g = key if isinstance(key, tuple) else (key,)
                    x = np.stack(pdf["_x"].iloc[idx].to_numpy())
                    for k, (w, mu, cov) in ps.get(g, ()):
                        lp = _log_joint(x, w, mu, cov)
                        if lp is None:
                            cur = acc.setdefault((g, k, 0), [0.0, np.zeros(d), np.zeros((d, d)), 0.0])
                            cur[3] = -np.inf
                            continue
                        mx = lp.max(1, keepdims=True)
                        lse = mx[:, 0] + np.log(np.exp(lp - mx).sum(1))
                        r = np.exp(lp - lse[:, None])
                        for j in range(k):
                            cur = acc.setdefault((g, k, j), [0.0, np.zeros(d), np.zeros((d, d)), 0.0])
                            rj = r[:, j]
                            cur[0] += rj.sum()
                            cur[1] += rj @ x
                            cur[2] += _outer_sum(x, rj)
                            if j == 0:
                                cur[3] += lse.sum()
            out = _stat_rows(keys, {key: (v[0], v[1], v[2], v[3]) for key, v in acc.items()})
            if out is not None:
                yield out[schema.fieldNames()]

        stats = _collect_stats(pts.mapInPandas(estep, schema), keys, d)
        bc.unpersist()
        for (g, k) in sorted(moving, key=str):
            w, mu, cov = params[(g, k)]
            ll = stats.get((g, k, 0), (0, None, None, 0.0))[3]
            ll_out[(g, k)] = ll
            n_tot = sum(stats.get((g, k, j), (0,))[0] for j in range(k))
            if ll == -np.inf:
                moving.discard((g, k))
                continue
            w2, mu2, cov2 = w.copy(), mu.copy(), cov.copy()
            for j in range(k):
                st = stats.get((g, k, j))
                if st is None or st[0] <= 1e-12:
                    continue
                nj, sx, sxx = st[0], st[1], np.asarray(st[2]).reshape(d, d)
                w2[j] = nj / n_tot
                mu2[j] = sx / nj
                cov2[j] = sxx / nj - np.outer(mu2[j], mu2[j]) + reg_covar * np.eye(d)
            params[(g, k)] = (w2 / w2.sum(), mu2, cov2)
            if abs(ll - prev_ll.get((g, k), -np.inf)) <= tol * max(n_tot, 1):
                moving.discard((g, k))
            prev_ll[(g, k)] = ll
        if not moving:
            break
    labels = _assign_gmm(pts, keys, params, spark)
    return labels, ll_out, d


def _assign_gmm(pts, keys, params, spark):
    bc = spark.sparkContext.broadcast(params)
    schema = T.StructType(_key_fields(pts, keys) + [
        T.StructField("k", T.IntegerType()), T.StructField("_id", T.StringType()),
        T.StructField("cluster", T.IntegerType())])

    def fn(batches):
        ps = _by_group(bc.value)
        for pdf in batches:
            out = []
            for key, idx in pdf.groupby(keys, sort=False).indices.items():
                g = key if isinstance(key, tuple) else (key,)
                x = np.stack(pdf["_x"].iloc[idx].to_numpy())
                ids = pdf["_id"].iloc[idx].to_numpy()
                for k, (w, mu, cov) in ps.get(g, ()):
                    lp = _log_joint(x, w, mu, cov)
                    lp = np.zeros((len(x), k)) if lp is None else lp
                    out.append(pd.DataFrame({**{kk: [g[i]] * len(ids) for i, kk in enumerate(keys)},
                                             "k": k, "_id": ids, "cluster": lp.argmax(1).astype(np.int32)}))
            if out:
                yield pd.concat(out, ignore_index=True)[schema.fieldNames()]

    return pts.mapInPandas(fn, schema)


def sweep(points: DataFrame, keys: Sequence[str], max_clusters: int = 10, id_col: str = "persona_id",
          vec_col: str = "scaled", seed: int = 42, n_init: int = N_INIT, max_iter: int = MIXTURE_ITER,
          with_fits: bool = False):
    """k = 2..min(max_clusters, n-1) per group: mixture fit and the five metrics.

    A fit that uses a single label, or failed, gets the worst scores (-1, 0,
    inf, inf, inf); a group of one or two rows gets one row with k = 1 and no
    scores, so every group is in the result. ``n_init`` and ``max_iter`` belong
    to the mixture.
    Returns (keys, k, silhouette, calinski_harabasz, davies_bouldin, bic, aic);
    ``with_fits`` adds the labels of ``fit_groups`` (None without any fit), which
    ``robust_labels`` takes instead of fitting again.
    """
    keys = list(keys)
    from ..session import checkpoint_dir

    checkpoint_dir(points.sparkSession)
    points = points.select(*keys, id_col, vec_col).checkpoint(eager=True)  # reused by every metric
    n_max = points.groupBy(*keys).count().agg(F.max("count")).collect()[0][0] or 0
    ks = [k for k in range(2, min(max_clusters, n_max - 1) + 1)]
    tiny = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n <= 2").select(
        *keys, F.lit(1).alias("k"), *[F.lit(None).cast("double").alias(c) for c in
                                      ("silhouette", "calinski_harabasz", "davies_bouldin", "bic", "aic")])
    if not ks:
        return (tiny, None) if with_fits else tiny
    fitted, ll_df, d = fit_groups(points, keys, ks, id_col, vec_col, seed=seed, n_init=n_init, max_iter=max_iter)
    labels = fitted.where(F.col("method") == "gmm").drop("method")
    n = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    labels = labels.join(n, keys).where(F.col("k") <= F.col("_n") - 1).drop("_n")
    lab = labels.withColumnRenamed("_id", id_col)
    pts = points.select(*keys, F.col(id_col).cast("string").alias(id_col), vec_col)
    lp = lab.join(pts, keys + [id_col])
    gk = keys + ["k"]
    sil = silhouette(lp, gk, "cluster", vec_col, id_col)
    ch = calinski_harabasz(lp, gk, "cluster", vec_col)
    db = davies_bouldin(lp, gk, "cluster", vec_col)
    nk = lp.groupBy(*gk).agg(F.countDistinct("cluster").alias("_used"), F.count(F.lit(1)).alias("_n"))
    ll_df = ll_df.withColumnRenamed("ll", "_ll")
    m = nk.join(sil, gk, "left").join(ch, gk, "left").join(db, gk, "left").join(ll_df, gk, "left")
    bic, aic = bic_aic(F.col("_ll"), F.col("k"), F.lit(d), F.col("_n"))
    one = F.col("_used") <= 1
    m = m.select(*keys, F.col("k").cast("int").alias("k"),
                 F.when(one, F.lit(-1.0)).otherwise(F.col("silhouette")).alias("silhouette"),
                 F.when(one, F.lit(0.0)).otherwise(F.col("calinski_harabasz")).alias("calinski_harabasz"),
                 F.when(one, F.lit(math.inf)).otherwise(F.col("davies_bouldin")).alias("davies_bouldin"),
                 F.when(one, F.lit(math.inf)).otherwise(bic).alias("bic"),
                 F.when(one, F.lit(math.inf)).otherwise(aic).alias("aic")).unionByName(tiny)
    # one row per group and k, read by the choice of k and everything after it: written once
    from .pruned_pairs import _written

    m = _written(m, "sweep-metrics")
    return (m, fitted) if with_fits else m


def robust_labels(points: DataFrame, keys: Sequence[str], k_per_group: DataFrame,
                  id_col: str = "persona_id", vec_col: str = "scaled", seed: int = 42,
                  fitted: DataFrame | None = None) -> DataFrame:
    """Final labels at each group's chosen k: mixture, k-means, agglomerative, spectral, then seeded random.

    A group with fewer points than k labels each point on its own. A method
    whose result uses a single label hands over to the next one. ``fitted``:
    labels of ``fit_groups`` with the same seed that hold every chosen k.
    """
    keys = list(keys)
    kp = k_per_group.select(*keys, F.col("optimal_clusters").cast("int").alias("k"))
    ks = sorted({r[0] for r in kp.select("k").distinct().collect() if r[0] and r[0] >= 2})
    n = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    base = points.select(*keys, F.col(id_col).cast("string").alias(id_col)).join(kp, keys, "left").join(n, keys)
    tiny = F.coalesce(F.col("k"), F.lit(1)) > F.col("_n")
    # groups smaller than their k hold fewer than max_clusters rows: a window is fine there
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(id_col)) - 1
    own = base.where(tiny).select(*keys, id_col, rn.cast("int").alias("cluster"),
                                  F.lit("own_label").alias("method"))
    base = base.where(~tiny)
    out_cols = [*keys, id_col, "cluster", "method"]
    if not ks:
        return base.select(*keys, id_col, F.lit(0).alias("cluster"),
                           F.lit("single").alias("method")).unionByName(own)
    if fitted is None:
        fitted = fit_groups(points, keys, ks, id_col, vec_col, seed=seed)[0]
    gm = fitted.where(F.col("method") == "gmm").drop("method")
    km = fitted.where(F.col("method") == "kmeans").drop("method")

    def pick(lab, name):
        lab = lab.withColumnRenamed("_id", id_col).join(kp, keys + ["k"], "left_semi")
        used = lab.groupBy(*keys).agg(F.countDistinct("cluster").alias("_u"))
        return lab.join(used, keys).select(*keys, id_col, F.col("cluster").alias(f"c_{name}"),
                                           (F.col("_u") > 1).alias(f"ok_{name}"))

    j = base.join(pick(gm, "gmm"), keys + [id_col], "left").join(pick(km, "km"), keys + [id_col], "left")
    single = F.coalesce("k", F.lit(1)) <= 1
    fits = [("ok_gmm", "c_gmm", "gmm"), ("ok_km", "c_km", "kmeans")]
    # the later steps run for the groups that no fit has split
    from . import hierarchy

    open_ = j.where(~single & ~F.coalesce("ok_gmm", F.lit(False)) & ~F.coalesce("ok_km", F.lit(False))).select(
        *keys, "k").distinct()
    open_ = hierarchy._written(open_, "unsplit-groups")
    if not open_.isEmpty():
        left = points.join(open_.select(*keys), keys, "left_semi")
        for step, name in ((hierarchy.agglomerative, "agglomerative"), (hierarchy.spectral, "spectral")):
            lab = step(left, keys, open_, id_col, vec_col).join(open_, keys).withColumnRenamed(id_col, "_id")
            j = j.join(pick(lab, name), keys + [id_col], "left")
            fits.append((f"ok_{name}", f"c_{name}", name))
    cluster, method = F.when(single, F.lit(0)), F.when(single, "single")
    for ok, c, name in fits:
        cluster, method = cluster.when(F.coalesce(ok, F.lit(False)), F.col(c)), method.when(F.coalesce(ok, F.lit(False)), name)
    rnd = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.greatest(F.col("k"), F.lit(1)).cast("long")).cast("int")
    return j.select(*keys, id_col, cluster.otherwise(rnd).alias("cluster"), method.otherwise("random").alias("method")).select(
        *out_cols).unionByName(own)


# ---------------------------------------------------------------------------
# a group of at most LOCAL_MAX rows is fitted inside one task (all k at once);
# larger groups run the same iterations distributed, from the same starts and
# with the same stop rules, so only rounding differs

LOCAL_MAX = 20_000


def _local_kmeans(x: np.ndarray, init: np.ndarray, max_iter: int, tol: float = 1e-6) -> np.ndarray:
    c = init.copy()
    for _ in range(max_iter):
        lab = _nearest(x, c)
        c2 = c.copy()
        for j in range(len(c)):
            m = lab == j
            if m.any():
                c2[j] = x[m].mean(0)
        moved = float(np.abs(c2 - c).max())
        c = c2
        if moved <= tol:
            break
    return c


def _local_gmm(x: np.ndarray, centres: np.ndarray, max_iter: int, tol: float = 1e-4, reg_covar: float = 1e-6):
    n, d = x.shape
    k = len(centres)
    lab = _nearest(x, centres)
    sizes = np.array([max((lab == j).sum(), 1) for j in range(k)], dtype=float)
    w, mu, cov = sizes / sizes.sum(), centres.copy(), np.stack([np.eye(d)] * k)
    prev = -np.inf
    ll = prev
    for _ in range(max_iter):
        lp = _log_joint(x, w, mu, cov)
        if lp is None:
            return np.zeros(n, dtype=int), -np.inf
        mx = lp.max(1, keepdims=True)
        lse = mx[:, 0] + np.log(np.exp(lp - mx).sum(1))
        ll = float(lse.sum())
        r = np.exp(lp - lse[:, None])
        nk = r.sum(0)
        for j in range(k):
            if nk[j] <= 1e-12:
                continue
            w[j] = nk[j] / n
            mu[j] = r[:, j] @ x / nk[j]
            cov[j] = _outer_sum(x, r[:, j]) / nk[j] - np.outer(mu[j], mu[j]) + reg_covar * np.eye(d)
        w = w / w.sum()
        if abs(ll - prev) <= tol * n:
            break
        prev = ll
    lp = _log_joint(x, w, mu, cov)
    return (np.zeros(n, dtype=int), -np.inf) if lp is None else (lp.argmax(1), ll)


def _best_mixture(points: DataFrame, keys: list[str], ks: Sequence[int], id_col: str, vec_col: str, seed: int,
                  n_init: int, max_iter: int):
    """The best of ``n_init`` distributed fits per (group, k)."""
    fits = [gaussian_mixture(points, keys, ks, id_col, vec_col, max_iter=max_iter, seed=seed + i) for i in range(n_init)]
    lls, d = [f[1] for f in fits], fits[0][2]
    first = {gk: max(range(n_init), key=lambda i: lls[i].get(gk, -np.inf)) for gk in lls[0]}
    spark = points.sparkSession
    kf = _key_fields(points, keys) + [T.StructField("k", T.IntegerType())]
    labels = None
    for i, (lab, _, _) in enumerate(fits):
        mine = [(*g, int(k)) for (g, k), at in first.items() if at == i]
        if mine:
            part = lab.join(F.broadcast(spark.createDataFrame(mine, T.StructType(kf))), keys + ["k"], "left_semi")
            labels = part if labels is None else labels.unionByName(part)
    return labels, {gk: lls[at][gk] for gk, at in first.items()}, d


#: tasks of the local fits at most; one holds several units beyond that
MAX_FIT_TASKS = 2000


def _fit_units(points: DataFrame, sizes: DataFrame, keys: list[str], ks: list[int], id_col: str, vec_col: str, seed: int,
               n_init: int, max_iter: int) -> DataFrame:
    """The local fits of every group of ``sizes`` (keys, _n), written: (keys, method, k, _id, cluster, ll, d, _start).

    A unit is a group and a start, and has a task of its own: the groups are numbered, largest first, so that no
    two units meet by their hash.
    """
    from .grid import dense_index
    from .pruned_pairs import _written

    kf = _key_fields(points, keys)
    some = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)) == F.lit(False)
    numbered = dense_index(sizes.where(some), [F.desc("_n"), *keys], "_unit", start=0).drop("_n")
    tasks = min(max(1, numbered.count() * n_init), MAX_FIT_TASKS)
    start = F.explode(F.sequence(F.lit(0), F.lit(n_init - 1))).alias("_start")
    units = _dense(points, keys, id_col, vec_col).join(numbered, keys).select("*", start)
    units = units.withColumn("_h", F.xxhash64("_id", F.lit(seed) + F.col("_start"))).withColumn(
        "_unit", F.col("_unit") * n_init + F.col("_start"))
    units = units.repartitionById(tasks, F.pmod("_unit", F.lit(tasks)).cast("int")).sortWithinPartitions("_unit")
    out_schema = T.StructType(kf + [T.StructField("method", T.StringType()), T.StructField("k", T.IntegerType()),
                                    T.StructField("_id", T.StringType()), T.StructField("cluster", T.IntegerType()),
                                    T.StructField("ll", T.DoubleType()), T.StructField("d", T.IntegerType()),
                                    T.StructField("_start", T.IntegerType())])

    def fit(pdf: pd.DataFrame):
        pdf = pdf.sort_values("_id")
        x = np.stack(pdf["_x"].to_numpy())
        ids = pdf["_id"].to_numpy()
        order = np.argsort(pdf["_h"].to_numpy(), kind="stable")
        start = int(pdf["_start"].iloc[0])
        key = {k: pdf[k].iloc[0] for k in keys}
        for k in ks:
            if len(x) < k:
                continue
            c = _local_kmeans(x, x[order[:k]], KMEANS_ITER)
            lab, llv = _local_gmm(x, c, max_iter)
            # k-means labels are those of the first start
            for method, lab, llv in (("kmeans", _nearest(x, c), np.nan), ("gmm", lab, float(llv)))[start > 0:]:
                yield pd.DataFrame({**{kk: [v] * len(ids) for kk, v in key.items()}, "method": method, "k": k,
                                    "_id": ids, "cluster": lab.astype(np.int32), "ll": llv, "d": x.shape[1],
                                    "_start": start})[out_schema.fieldNames()]

    def run(batches):
        held, unit = [], None
        for pdf in batches:
            for u, idx in pdf.groupby("_unit", sort=True).indices.items():
                if held and u != unit:
                    yield from fit(pd.concat(held, ignore_index=True))
                    held = []
                unit = u
                held.append(pdf.iloc[idx])
        if held:
            yield from fit(pd.concat(held, ignore_index=True))

    # the fitted labels feed several metrics: written once
    return _written(units.mapInPandas(run, out_schema), "local-fits")


def fit_groups(points: DataFrame, keys: Sequence[str], ks: Sequence[int], id_col: str = "persona_id",
               vec_col: str = "scaled", seed: int = 42, local_max: int = LOCAL_MAX, n_init: int = N_INIT,
               max_iter: int = MIXTURE_ITER):
    """K-means and mixture labels for every group and k, plus mixture log-likelihoods.

    The mixture is fitted from ``n_init`` starts (seeds seed, seed + 1, ...);
    the first one with the best log-likelihood stays. K-means labels are those
    of the first start.

    Returns (labels (keys, method, k, id, cluster), loglik (keys, k, ll), dims).
    Groups of at most ``local_max`` rows are fitted inside tasks, one task per
    group and start (the group's rows are bounded by the size check), so the
    starts of one group run beside each other; larger groups go through the
    distributed ``kmeans`` / ``gaussian_mixture`` iterations.
    """
    keys = list(keys)
    spark = points.sparkSession
    kf = _key_fields(points, keys)
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ks = sorted(set(int(k) for k in ks))
    local = _fit_units(points, sizes.where(F.col("_n") <= local_max), keys, ks, id_col, vec_col, seed, n_init, max_iter)
    mixed = F.col("method") == "gmm"
    # one row per (group, k, start); a fit that is not a number loses unless it is the first
    rank = F.when(F.isnan("ll"), F.when(F.col("_start") == 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))).otherwise(F.col("ll"))
    fits = local.where(mixed).groupBy(*keys, "k", "_start").agg(F.first("ll").alias("ll"))
    best = fits.groupBy(*keys, "k").agg(F.max(F.struct(rank.alias("rank"), (-F.col("_start")).alias("first"), "ll")).alias("b"))
    ll = best.select(*keys, "k", F.col("b.ll").alias("ll"))
    stays = best.select(*keys, "k", (-F.col("b.first")).alias("_start"))
    labels = local.where(mixed).join(stays, [*keys, "k", "_start"], "left_semi").unionByName(local.where(~mixed)).select(
        *keys, "method", "k", "_id", "cluster")
    d = local.agg(F.max("d")).collect()[0][0]
    big_keys = sizes.where(F.col("_n") > local_max).select(*keys)
    if big_keys.limit(1).count() > 0:
        big = points.join(big_keys, keys, "left_semi")
        gm, gll, gd = _best_mixture(big, keys, ks, id_col, vec_col, seed, n_init, max_iter)
        km, _ = kmeans(big, keys, ks, id_col, vec_col, seed=seed)
        labels = labels.unionByName(gm.withColumn("method", F.lit("gmm"))).unionByName(
            km.withColumn("method", F.lit("kmeans")))
        rows = [(*g, int(k), float(v)) for (g, k), v in gll.items()]
        ll = ll.unionByName(spark.createDataFrame(rows, T.StructType(kf + [
            T.StructField("k", T.IntegerType()), T.StructField("ll", T.DoubleType())])))
        d = d or gd
    return labels, ll, d

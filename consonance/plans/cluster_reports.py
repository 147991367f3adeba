"""Cluster quality indices, mixture sweeps, final labels and 3-D points.

Inputs: ``embeddings`` with its ``label`` as given clusters, grouped by
experiment (control / main rule of the obs view), for the SQL-checkable
indices; the ``obs`` view grouped by model for the fits.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bounded_silhouette, clusters, hierarchy, pairs
from . import views
from .registry import oracle, register
from .views import with_views
from ..sources.tables import table

# DuckDB: standardised vectors per experiment (population std, zero std unscaled)
_SCALED = """e AS (SELECT CASE WHEN vec_id % 5 = 0 THEN 'control' ELSE 'main' END AS experiment,
             CAST(vec_id AS VARCHAR) AS persona_id, CAST(label AS VARCHAR) AS cluster,
             CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ex AS (SELECT experiment, persona_id, cluster, pos, v[pos] AS x FROM e, range(1, 65) r(pos)
       WHERE pos <= len(v)),
st AS (SELECT experiment, pos, avg(x) AS mu, stddev_pop(x) AS sd FROM ex GROUP BY experiment, pos),
sx AS (SELECT ex.experiment, ex.persona_id, ex.cluster, ex.pos,
         CASE WHEN st.sd > 0 THEN (ex.x - st.mu) / st.sd ELSE ex.x - st.mu END AS z
       FROM ex JOIN st ON ex.experiment = st.experiment AND ex.pos = st.pos),
sc AS (SELECT experiment, persona_id, cluster, list(z ORDER BY pos) AS v FROM sx
       GROUP BY experiment, persona_id, cluster)"""


def _sql(body: str) -> str:
    return f"WITH {_SCALED}\n{body}"


def _points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    p = e.select(F.when(F.col("vec_id") % 5 == 0, "control").otherwise("main").alias("experiment"),
                 F.col("vec_id").cast("string").alias("persona_id"),
                 F.col("label").cast("string").alias("cluster"), "embedding")
    return clusters.standardize(p, ["experiment"], "embedding", "scaled")


@register("standardized_vectors", oracle(_sql("""
SELECT experiment, persona_id, CAST(pos - 1 AS INTEGER) AS pos, z AS value FROM sx"""),
    ["experiment", "persona_id", "pos", "value"], ["value"]), ["C1"])
def q_standardized_vectors(spark, sf_dir):
    """Per-experiment standardised embeddings, long form (one row per dimension)."""
    s = _points(spark, sf_dir)
    return s.select("experiment", "persona_id", F.posexplode("scaled").alias("pos", "value")).select(
        "experiment", "persona_id", F.col("pos").cast("int").alias("pos"), "value")


@register("silhouette", oracle(_sql("""
, d AS (SELECT a.experiment, a.persona_id AS i, a.cluster AS ci, b.cluster AS cj, list_distance(a.v, b.v) AS dist
        FROM sc a JOIN sc b ON a.experiment = b.experiment AND a.persona_id <> b.persona_id),
pc AS (SELECT experiment, i, ci, cj, avg(dist) AS md FROM d GROUP BY experiment, i, ci, cj),
pt AS (SELECT experiment, i, max(CASE WHEN ci = cj THEN md END) AS a, min(CASE WHEN ci <> cj THEN md END) AS b
       FROM pc GROUP BY experiment, i)
SELECT experiment, avg(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette
FROM pt GROUP BY experiment"""), ["experiment", "silhouette"], ["silhouette"]), ["C3"])
def q_silhouette(spark, sf_dir):
    """Mean silhouette (Euclidean, standardised vectors) of the given labels."""
    return clusters.silhouette(_points(spark, sf_dir), ["experiment"], "cluster", "scaled")


@register("silhouette_work", oracle(_sql("""
, cz AS (SELECT experiment, cluster, pos, avg(z) AS mu, var_pop(z) AS s2, count(*) AS n FROM sx GROUP BY experiment, cluster, pos),
cen AS (SELECT experiment, cluster, list(mu ORDER BY pos) AS c, sum(s2) AS w, max(n) AS n FROM cz GROUP BY experiment, cluster),
bd AS (SELECT sc.experiment, sc.persona_id, sc.cluster = cen.cluster AS own, cen.n, list_distance(sc.v, cen.c) AS low,
         sqrt(pow(list_distance(sc.v, cen.c), 2) + cen.w) AS high FROM sc JOIN cen ON sc.experiment = cen.experiment),
li AS (SELECT experiment, persona_id, min(CASE WHEN NOT own THEN high END) AS lim FROM bd GROUP BY experiment, persona_id),
op AS (SELECT bd.experiment, sum(bd.n) AS distances, count(*) AS sums FROM bd JOIN li
       ON bd.experiment = li.experiment AND bd.persona_id = li.persona_id WHERE own OR low <= lim GROUP BY bd.experiment),
n AS (SELECT experiment, count(*) AS points FROM sc GROUP BY experiment)
SELECT n.experiment, CAST(points AS BIGINT) AS points, CAST(sums AS BIGINT) AS sums, CAST(distances AS BIGINT) AS distances,
  CAST(points * points AS BIGINT) AS all_distances FROM n JOIN op ON n.experiment = op.experiment"""),
    ["experiment", "points", "sums", "distances", "all_distances"]), ["C3"])
def q_silhouette_work(spark, sf_dir):
    """Distances the silhouette takes after its bounds, against those of all pairs."""
    cand = bounded_silhouette.candidates(_points(spark, sf_dir), ["experiment"])
    return bounded_silhouette.work(cand, ["experiment"])


@register("calinski_harabasz", oracle(_sql("""
, pc AS (SELECT experiment, cluster, pos, count(*) AS nc, sum(z) AS s, sum(z * z) AS ss FROM sx
         GROUP BY experiment, cluster, pos),
pd AS (SELECT experiment, pos, sum(nc) AS n, sum(s) AS t, sum(ss) AS tt, sum(s * s / nc) AS br FROM pc
       GROUP BY experiment, pos),
ag AS (SELECT experiment, sum(tt - br) AS w, sum(br - t * t / n) AS b, max(n) AS n FROM pd GROUP BY experiment),
k AS (SELECT experiment, count(DISTINCT cluster) AS k FROM sc GROUP BY experiment)
SELECT ag.experiment, CASE WHEN k.k <= 1 THEN NULL WHEN w = 0 THEN 1.0 ELSE b * (n - k.k) / (w * (k.k - 1)) END
  AS calinski_harabasz FROM ag JOIN k ON ag.experiment = k.experiment"""),
    ["experiment", "calinski_harabasz"], ["calinski_harabasz"]), ["C4"])
def q_calinski_harabasz(spark, sf_dir):
    """Calinski-Harabasz index of the given labels per experiment."""
    return clusters.calinski_harabasz(_points(spark, sf_dir), ["experiment"], "cluster", "scaled")


@register("davies_bouldin", oracle(_sql("""
, cz AS (SELECT experiment, cluster, pos, avg(z) AS mu FROM sx GROUP BY experiment, cluster, pos),
cen AS (SELECT experiment, cluster, list(mu ORDER BY pos) AS c FROM cz GROUP BY experiment, cluster),
intra AS (SELECT sc.experiment, sc.cluster, avg(list_distance(sc.v, cen.c)) AS s FROM sc JOIN cen
          ON sc.experiment = cen.experiment AND sc.cluster = cen.cluster GROUP BY sc.experiment, sc.cluster),
cc AS (SELECT cen.*, intra.s FROM cen JOIN intra ON cen.experiment = intra.experiment AND cen.cluster = intra.cluster),
pr AS (SELECT a.experiment, a.cluster AS ci, a.s AS sa, list_distance(a.c, b.c) AS d, b.s AS sb FROM cc a JOIN cc b
       ON a.experiment = b.experiment AND a.cluster <> b.cluster),
w AS (SELECT experiment, ci, max(CASE WHEN d > 0 THEN (sa + sb) / d END) AS r, max(d) AS dmax, max(sa) AS sa
      FROM pr GROUP BY experiment, ci)
SELECT experiment, CASE WHEN max(dmax) = 0 OR max(sa) = 0 THEN 0.0 ELSE avg(coalesce(r, 0.0)) END AS davies_bouldin
FROM w GROUP BY experiment"""), ["experiment", "davies_bouldin"], ["davies_bouldin"]), ["C5"])
def q_davies_bouldin(spark, sf_dir):
    """Davies-Bouldin index of the given labels per experiment."""
    return clusters.davies_bouldin(_points(spark, sf_dir), ["experiment"], "cluster", "scaled")


def _model_points(spark, sf_dir):
    o = views.obs(spark, sf_dir).where(F.col("experiment") == "main")
    return clusters.standardize(o, ["model"], "embedding", "scaled")


@register("cluster_sweep", None, ["C2", "C6", "C7"])
def q_cluster_sweep(spark, sf_dir):
    """Mixture fits for k = 2..10 per model (full standardised vectors), the five
    metrics per k, and the composite choice of k."""
    pts = _model_points(spark, sf_dir)
    m = clusters.sweep(pts, ["model"], 10, "persona_id", "scaled")
    best = clusters.choose_k(m, ["model"])
    return m.join(best, "model", "left")


@register("cluster_analysis", None, ["C8", "C9", "C10", "A25"])
def q_cluster_analysis(spark, sf_dir):
    """Per model: negative-pair summary, chosen k and final labels (robust chain)."""
    pts = _model_points(spark, sf_dir)
    m, fitted = clusters.sweep(pts, ["model"], 10, "persona_id", "scaled", with_fits=True)
    best = clusters.choose_k(m, ["model"])
    # the sweep has fitted every k that can be chosen, with the same starts
    labels = clusters.robust_labels(pts, ["model"], best, "persona_id", "scaled", fitted=fitted)
    o = views.obs(spark, sf_dir).where(F.col("experiment") == "main")
    neg = pairs.negative_summary(o, keys=["model"])
    per = labels.groupBy("model").agg(F.countDistinct("cluster").alias("clusters_found"),
                                      F.first("method").alias("method"))
    return (best.join(per, "model", "left").join(neg, "model", "left")
                .select("model", "optimal_clusters", "clusters_found", "method", "has_negative",
                        "negative_count", "min_value", "max_value", "mean_value"))


@register("ward_clusters", oracle(with_views(""",
ex AS (SELECT model, persona_id, pos, CAST(embedding[pos] AS DOUBLE) AS x FROM obs, range(1, 65) r(pos)
       WHERE experiment = 'main' AND pos <= len(embedding)),
st AS (SELECT model, pos, avg(x) AS mu, stddev_pop(x) AS sd FROM ex GROUP BY model, pos),
z AS (SELECT ex.model, persona_id, list(CASE WHEN sd > 0 THEN (x - mu) / sd ELSE x - mu END ORDER BY ex.pos) AS c
      FROM ex JOIN st ON ex.model = st.model AND ex.pos = st.pos GROUP BY ex.model, persona_id),
w AS (
  SELECT 0 AS step, model, row_number() OVER (PARTITION BY model ORDER BY persona_id) - 1 AS cid, 1 AS n, c,
    [persona_id] AS members FROM z
  UNION ALL
  SELECT step, model, cid, n, c, members FROM (
    WITH best AS (
      SELECT a.model, arg_min(struct_pack(lo := a.cid, hi := b.cid),
               struct_pack(cost := a.n * b.n / (a.n + b.n) * pow(list_distance(a.c, b.c), 2), lo := a.cid, hi := b.cid)) AS p
      FROM w a JOIN w b ON a.model = b.model AND a.cid < b.cid GROUP BY a.model HAVING count(*) > 3)
    SELECT step + 1 AS step, w.model, w.cid, w.n, w.c, w.members FROM w JOIN best ON w.model = best.model
    WHERE w.cid <> p.lo AND w.cid <> p.hi
    UNION ALL
    SELECT a.step + 1, a.model, a.cid, a.n + b.n,
      list_transform(list_zip(a.c, b.c), lambda t: (a.n * t[1] + b.n * t[2]) / (a.n + b.n)), a.members || b.members
    FROM best JOIN w a ON a.model = best.model AND a.cid = p.lo JOIN w b ON b.model = best.model AND b.cid = p.hi)),
l AS (SELECT model, max(step) AS step FROM w GROUP BY model),
f AS (SELECT w.model, members, row_number() OVER (PARTITION BY w.model ORDER BY cid) - 1 AS cluster
      FROM w JOIN l ON w.model = l.model AND w.step = l.step)
SELECT model, unnest(members) AS persona_id, CAST(cluster AS INTEGER) AS cluster FROM f""", "obs").replace("WITH ", "WITH RECURSIVE ", 1),
    ["model", "persona_id", "cluster"]), ["C9"])
def q_ward_clusters(spark, sf_dir):
    """Agglomerative step: Ward's tree of every model's answers, cut into three clusters."""
    return hierarchy.agglomerative(_model_points(spark, sf_dir), ["model"], 3, "persona_id", "scaled")


@register("spectral_clusters", None, ["C9"])
def q_spectral_clusters(spark, sf_dir):
    """Spectral step: sizes of three clusters per model from the neighbour graph of its answers."""
    lab = hierarchy.spectral(_model_points(spark, sf_dir), ["model"], 3, "persona_id", "scaled")
    return lab.groupBy("model", "cluster").agg(F.count(F.lit(1)).alias("answers"))


@register("points_3d", None, ["C11", "C12", "C13"])
def q_points_3d(spark, sf_dir):
    """3-D PCA coordinates per model with given-label colours (plot table)."""
    o = views.obs(spark, sf_dir).where(F.col("experiment") == "main")
    s = clusters.standardize(o, ["model"], "embedding", "scaled")
    xyz = clusters.reduce_3d(s, ["model"], "scaled", "pca")
    lab = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("persona_id"),
                                                    F.col("label").alias("cluster"))
    lab = o.select("model", "persona_id").join(lab, "persona_id")
    return clusters.point_table(xyz, lab, ["model"])

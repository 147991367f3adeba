"""Silhouette with bounds against the definition, and the distances it leaves out."""

import numpy as np
import pytest

from consonance.operators import bounded_silhouette as bs

SCHEMA = "grp string, persona_id string, cluster string, scaled array<double>"


def brute(rows):
    out = {}
    for g in {r[0] for r in rows}:
        pts = [r for r in rows if r[0] == g]
        x = np.array([r[3] for r in pts], dtype=float)
        lab = np.array([r[2] for r in pts])
        if len(set(lab)) < 2:
            out[g] = None
            continue
        s = []
        for i in range(len(pts)):
            d = np.sqrt(((x - x[i]) ** 2).sum(1))
            own = (lab == lab[i]) & (np.arange(len(pts)) != i)
            b = min(d[lab == c].mean() for c in set(lab) if c != lab[i])
            a = d[own].mean() if own.any() else None
            s.append(0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b))
        out[g] = float(np.mean(s))
    return out


def blobs(g, k, n, gap, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(k, 5)) * gap
    return [(g, f"{c}-{i}", f"c{c}", [float(v) for v in centre[c] + rng.normal(size=5)]) for c in range(k) for i in range(n)]


@pytest.mark.parametrize("block", [4, 1000])
def test_equals_definition(spark, block):
    rows = blobs("far", 6, 9, 30.0, 1) + blobs("near", 4, 8, 0.2, 2) + blobs("one", 1, 5, 1.0, 3)
    rows += [("lone", "a", "x", [0.0, 0.0]), ("lone", "b", "y", [1.0, 0.0]), ("lone", "c", "y", [1.0, 2.0])]
    rows += [("same", str(i), f"s{i % 2}", [1.0, 1.0]) for i in range(6)]
    s, _work = bs.silhouette(spark.createDataFrame(rows, SCHEMA), ["grp"], block_size=block)
    got = {r["grp"]: r["silhouette"] for r in s.collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for g in want:
        assert (got[g] is None) == (want[g] is None)
        assert want[g] is None or abs(got[g] - want[g]) < 1e-6, g


def test_far_clusters_are_skipped(spark):
    rows = blobs("far", 8, 12, 60.0, 4) + blobs("near", 8, 12, 0.0, 5)
    _s, work = bs.silhouette(spark.createDataFrame(rows, SCHEMA), ["grp"], block_size=16)
    w = {r["grp"]: r for r in work.collect()}
    assert w["far"]["points"] == w["near"]["points"] == 96
    assert w["far"]["distances"] < 0.5 * w["far"]["all_distances"]
    assert w["near"]["distances"] > 0.8 * w["near"]["all_distances"]


def test_null_vectors_labels_and_empty(spark):
    rows = [("g", "a", None, [3.0, 4.0]), ("g", "b", "x", None), ("g", "c", "x", [0.0, 1.0]), ("g", "d", None, [3.0, 3.0]),
            ("g", "e", "y", None)]
    plain = [(g, i, c or "None", v or [0.0, 0.0]) for g, i, c, v in rows]
    got = bs.silhouette(spark.createDataFrame(rows, SCHEMA), ["grp"])[0].collect()[0]["silhouette"]
    assert abs(got - brute(plain)["g"]) < 1e-9
    assert bs.silhouette(spark.createDataFrame([], SCHEMA), ["grp"])[0].collect() == []


def test_copies_of_a_row_do_not_grow_with_its_cluster(spark, monkeypatch):
    """Blocks of a fixed size sent every row once per block of the other side: the square of the cluster."""
    from pyspark.sql import functions as F

    from consonance.operators import bounded_silhouette as b

    rows = [(n, -(-n // 1024)) for n in (1, 1024, 1025, 8192, 48_000, 262_144, 10_000_000)]
    got = [r[0] for r in spark.createDataFrame(rows, "n long, old long").select(b._blocks(F.col("n"), 1024)).collect()]
    assert got[:4] == [1, 1, 2, 8] and got[4:6] == [8, 8] and got[6] == -(-10_000_000 // (32 * 1024))
    # large blocks, and distances in parts, give the same mean
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([("g", f"{i}", str(i % 3), [float(a) for a in v + i % 3]) for i, v in enumerate(rng.normal(0, 1, (120, 4)))],
                               "g string, persona_id string, cluster string, scaled array<double>")
    want = b.silhouette(df, ["g"])[0].collect()[0]["silhouette"]
    monkeypatch.setattr(b, "CELL", 100)
    for size in (2, 7):
        assert abs(b.silhouette(df, ["g"], block_size=size)[0].collect()[0]["silhouette"] - want) < 1e-9


def test_bounds_are_taken_once_per_point_and_cluster(spark):
    from consonance.operators import bounded_silhouette

    df = spark.createDataFrame([("g", str(i), str(i % 3), [float(i), 1.0]) for i in range(9)],
                               "k string, persona_id string, cluster string, scaled array<double>")
    plan = bounded_silhouette.candidates(df, ["k"])._jdf.queryExecution().optimizedPlan().toString().lower()
    # inlined into the filter, the distance would be computed again for every cluster and use of it
    assert plan.replace("_", "").count("zipwith(") == 1

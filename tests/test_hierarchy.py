"""Ward's tree against merging the cheapest pair, and spectral labels of shapes that centres cannot tell apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from consonance.operators import hierarchy as H

SCHEMA = "g string, persona_id string, scaled array<double>"


def _greedy(x, k):
    """Clusters (sets of rows) after always merging the cheapest pair."""
    parts = [([i], x[i].copy()) for i in range(len(x))]
    while len(parts) > k:
        best = min(((len(a) * len(b) / (len(a) + len(b)) * ((ca - cb) ** 2).sum(), i, j)
                    for i, (a, ca) in enumerate(parts) for j, (b, cb) in enumerate(parts[:i])))
        _, i, j = best
        (a, ca), (b, cb) = parts[i], parts[j]
        parts[j] = (a + b, (len(a) * ca + len(b) * cb) / (len(a) + len(b)))
        parts.pop(i)
    return {frozenset(p[0]) for p in parts}


def _sets(rows, g):
    out = {}
    for r in rows:
        if r.g == g:
            out.setdefault(r.cluster, set()).add(int(r.persona_id))
    assert sorted(out) == list(range(len(out)))
    return {frozenset(s) for s in out.values()}


def _frame(spark, groups):
    return spark.createDataFrame([(g, f"{i:04d}", None if v is None else [float(a) for a in v])
                                  for g, x in groups.items() for i, v in enumerate(x)], SCHEMA)


@pytest.mark.parametrize("local", [H.LOCAL, 24])
def test_ward_equals_greedy_merging(spark, local):
    """One task per group, and rounds of mutual pairs before it: 200 points in 6 dimensions, and a small group."""
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=(200, 6)), "b": rng.normal(size=(30, 6)) + 9}
    rows, tree = H.ward_tree(_frame(spark, groups), ["g"], local=local, block=32)
    for k in (2, 7):
        got = H.cut(rows, tree, ["g"], k).collect()
        assert len(got) == 230
        for g, x in groups.items():
            assert _sets(got, g) == _greedy(x, k)


def test_ward_ties_nulls_and_small_groups(spark):
    groups = {"same": np.ones((9, 2)), "few": [[0.0, 1.0], [5.0, 5.0]], "one": [[1.0, 1.0]],
              "null": [None, [0.0, 0.0], [8.0, 8.0], [8.0, 9.0]], "line": [[float(i), 0.0] for i in range(16)]}
    for local in (H.LOCAL, 3):
        got = H.agglomerative(_frame(spark, groups), ["g"], 3, local=local, block=4).collect()
        assert len(got) == sum(map(len, groups.values()))
        size = {g: len(_sets(got, g)) for g in groups}
        assert size == {"same": 3, "few": 2, "one": 1, "null": 3, "line": 3}
        assert frozenset({0, 1}) in _sets(got, "null")
    ks = spark.createDataFrame([("line", 5)], "g string, k int")
    assert len(_sets(H.agglomerative(_frame(spark, groups), ["g"], ks).collect(), "line")) == 5


def _rings(n, seed=0):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, 2 * np.pi, n)) if n < 100 else 2 * np.pi * np.arange(n) / n
    inner = np.c_[np.cos(t), np.sin(t)]
    return np.concatenate([inner, 6 * inner]) + rng.normal(0, 0.02, (2 * n, 2))


@pytest.mark.parametrize("n,landmarks", [(150, H.LANDMARKS), (600, 256)])
def test_spectral_separates_rings(spark, n, landmarks):
    """Two rings around one centre, exactly and over landmarks."""
    got = H.spectral(_frame(spark, {"r": _rings(n)}), ["g"], 2, landmarks=landmarks, block=128).collect()
    sets = _sets(got, "r")
    assert sets == {frozenset(range(n)), frozenset(range(n, 2 * n))}


def test_spectral_small_and_empty(spark):
    groups = {"few": [[0.0], [1.0]], "null": [None, [0.0], [9.0], [9.1], [9.2]], "same": np.ones((20, 1))}
    got = H.spectral(_frame(spark, groups), ["g"], 3).collect()
    assert len(got) == 27 and len(_sets([r for r in got if r.g == "few"], "few")) == 2
    empty = _frame(spark, {"x": [[1.0]]}).where(F.lit(False))
    assert H.spectral(empty, ["g"], 2).collect() == []
    assert H.agglomerative(empty, ["g"], 2).collect() == []


def test_unsplit_groups_go_on_to_the_agglomerative_step(spark):
    """Equal rows: neither fit uses two labels, Ward's tree does; other groups keep their fit."""
    from consonance.operators import clusters

    rng = np.random.default_rng(0)
    blobs = np.concatenate([rng.normal(0, 0.1, (20, 2)), rng.normal(9, 0.1, (20, 2))])
    df = _frame(spark, {"same": np.ones((12, 2)), "blobs": blobs, "one": [[1.0, 2.0]]})
    ks = spark.createDataFrame([("same", 3), ("blobs", 2), ("one", 1)], "g string, optimal_clusters int")
    got = clusters.robust_labels(df, ["g"], ks).collect()
    method = {r.g: r.method for r in got}
    assert method == {"same": "agglomerative", "blobs": "gmm", "one": "single"}
    assert len({r.cluster for r in got if r.g == "same"}) == 3 and len(got) == 53

"""Pruned pair reports against all pairs, and what they skip on clustered vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from consonance.operators import pairs, pruned_pairs

SCHEMA = "model string, topic string, persona_id string, embedding array<float>"


def _clustered(seed=0, groups=2, clusters=6, each=60, d=8, spread=0.05):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        c = rng.normal(size=(clusters, d))
        for i in range(clusters * each):
            rows.append((f"m{g}", "t", f"{i:04d}", (c[i % clusters] + spread * rng.normal(size=d)).tolist()))
    return rows


def _odd(seed=1, n=150):
    """Random directions with copies, opposite, zero and null rows; a group of two and one of a single row."""
    rng = np.random.default_rng(seed)
    rows = [("m", "t", f"{i:03d}", rng.normal(size=5).tolist()) for i in range(n)]
    rows += [("m", "t", f"c{i}", rows[i % 3][3]) for i in range(12)] + [("m", "t", "neg", [-x for x in rows[0][3]])]
    rows += [("m", "t", f"z{i}", [0.0] * 5) for i in range(4)] + [("m", "t", "null", None)]
    return rows + [("two", "t", "a", [1.0, 0.0, 0.0, 0.0, 0.0]), ("two", "t", "b", [0.0, 2.0, 0.0, 0.0, 0.0]), ("one", "t", "a", [1.0] * 5),
                   ("bare", "t", "a", [0.0] * 5), ("bare", "t", "b", None)]


def _brute(rows):
    """(model, topic) -> {(id_a, id_b): similarity}."""
    out = {}
    for m, t in {(r[0], r[1]) for r in rows}:
        mine = sorted((r[2], r[3]) for r in rows if r[:2] == (m, t))
        d = max((len(v) for _, v in mine if v), default=1)
        x = np.array([np.zeros(d) if v is None else np.float32(v).astype(float) for _, v in mine])
        nrm = np.linalg.norm(x, axis=1, keepdims=True)
        u = np.divide(x, nrm, out=np.zeros_like(x), where=nrm > 0)
        s = u @ u.T
        out[(m, t)] = {(mine[i][0], mine[j][0]): s[i, j] for i in range(len(mine)) for j in range(i + 1, len(mine))}
    return out


@pytest.mark.parametrize("make", [_clustered, _odd])
@pytest.mark.parametrize("predicate,threshold", [("ge", 0.9), ("ge", 0.05), ("lt", -0.5), ("lt", 0.05)])
def test_filtered_equals_all_pairs(spark, make, predicate, threshold):
    rows = make()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.model, r.topic, r.id_a, r.id_b): r.similarity for r in pruned_pairs.filtered(df, predicate, threshold, block=16).collect()}
    want = {(*g, *p): s for g, ps in _brute(rows).items() for p, s in ps.items() if (s < threshold if predicate == "lt" else s >= threshold)}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_block_pairs_of_clusters_are_skipped(spark):
    """Six tight clusters: links at 0.9 stay inside them, so most block pairs are never evaluated."""
    at = pruned_pairs.layout(spark.createDataFrame(_clustered(), SCHEMA), block=16)
    all_pairs = at.pairs.agg(F.count("*"), F.sum("n_pairs")).first()
    kept = pruned_pairs.crossing(at, "ge", 0.9).agg(F.count("*"), F.sum("n_pairs")).first()
    assert all_pairs[1] == 2 * 360 * 359 // 2
    assert kept[0] < all_pairs[0] / 2 and kept[1] < all_pairs[1] / 2
    assert max(r[0] for r in at.rows.groupBy("model", "topic", "block").count().select("count").collect()) <= 16


@pytest.mark.parametrize("make", [_clustered, _odd])
def test_extremes_equal_all_pairs(spark, make):
    rows = make()
    out, work = pruned_pairs.extremes(spark.createDataFrame(rows, SCHEMA), block=16)
    got = {(r.model, r.topic): r for r in out.collect()}
    brute = {g: ps for g, ps in _brute(rows).items() if ps}
    assert got.keys() == brute.keys()
    for g, ps in brute.items():
        for which, a, b, sign in (("max", "most_similar_a", "most_similar_b", -1), ("min", "least_similar_a", "least_similar_b", 1)):
            best = min(sign * s for s in ps.values())
            assert got[g][f"{which}_similarity"] == pytest.approx(sign * best, abs=1e-9)
            assert ps[(got[g][a], got[g][b])] == pytest.approx(sign * best, abs=1e-9)
    share = {r.model: r.evaluated / r.n_pairs for r in work.collect()}
    assert all(0 < s <= 1 for s in share.values())
    if make is _clustered:
        assert max(share.values()) < 0.6


def test_negative_summary_adds_up(spark):
    rows = _odd()
    got = {(r.model, r.topic): r for r in pairs.negative_summary(spark.createDataFrame(rows, SCHEMA), block_size=16).collect()}
    for g, ps in _brute(rows).items():
        neg = [s for s in ps.values() if s < 0]
        assert got[g].negative_count == len(neg) and got[g].has_negative == bool(neg)
        if neg:
            assert got[g].mean_value == pytest.approx(np.mean(neg)) and got[g].min_value == pytest.approx(min(neg))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert pruned_pairs.filtered(df, "ge", 0.5).collect() == []
    assert pruned_pairs.extremes(df)[0].collect() == []

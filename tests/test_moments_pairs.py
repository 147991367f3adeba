"""Closed-form moments and blocked pair reports against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from consonance.operators import moments, pairs

SCHEMA = "model string, topic string, persona_id string, embedding array<float>"


def brute(vecs):
    x = np.asarray(vecs, dtype=np.float32).astype(np.float64)  # the frame stores float32
    nrm = np.linalg.norm(x, axis=1)
    u = np.where(nrm[:, None] > 0, x / np.where(nrm > 0, nrm, 1)[:, None], 0)
    s = u @ u.T
    iu = np.triu_indices(len(x), k=1)
    return s[iu]


def frame(spark, groups):
    rows = []
    for (m, t), vecs in groups.items():
        for i, v in enumerate(vecs):
            rows.append((m, t, f"{i:03d}", [float(a) for a in v]))
    return spark.createDataFrame(rows, SCHEMA)


def test_hand_goldens(spark):
    df = frame(spark, {
        ("same", "t"): [[1, 2, 3], [2, 4, 6]],
        ("orth", "t"): [[1, 0], [0, 3]],
        ("opp", "t"): [[1, 1], [-2, -2]],
        ("zero", "t"): [[1, 0], [0, 0], [2, 0]],
        ("one", "t"): [[1, 2]],
    })
    got = {r["model"]: r for r in moments.group_moments(df).collect()}
    assert got["same"]["mean_similarity"] == pytest.approx(1.0)
    assert got["same"]["std_similarity"] == pytest.approx(0.0, abs=1e-7)
    assert got["orth"]["mean_similarity"] == pytest.approx(0.0, abs=1e-12)
    assert got["opp"]["mean_similarity"] == pytest.approx(-1.0)
    # zero vector: its two pairs are 0, the other pair is 1 -> mean 1/3
    assert got["zero"]["nz"] == 2
    assert got["zero"]["mean_similarity"] == pytest.approx(1 / 3)
    assert got["one"]["pairs"] == 0 and got["one"]["mean_similarity"] is None


def test_closed_form_equals_pairs(spark):
    rng = np.random.default_rng(7)
    groups = {("m", f"t{g}"): rng.normal(size=(n, 16)) for g, n in enumerate([2, 5, 17, 40])}
    got = {r["topic"]: r for r in moments.group_moments(frame(spark, groups)).collect()}
    for (m, t), v in groups.items():
        s = brute(v)
        assert got[t]["mean_similarity"] == pytest.approx(s.mean(), abs=1e-9)
        assert got[t]["std_similarity"] == pytest.approx(s.std(), abs=1e-7)
        assert got[t]["pairs"] == len(s)


def test_permutation_invariance(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(12, 8))
    a = moments.group_moments(frame(spark, {("m", "t"): v})).collect()[0]
    b = moments.group_moments(frame(spark, {("m", "t"): v[::-1]}).repartition(3)).collect()[0]
    assert a["mean_similarity"] == pytest.approx(b["mean_similarity"], abs=1e-12)
    assert a["std_similarity"] == pytest.approx(b["std_similarity"], abs=1e-9)


@pytest.mark.parametrize("block", [3, 1024])
def test_blocked_pairs_match_brute_force(spark, block):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(23, 6))
    df = frame(spark, {("m", "t"): v})
    s = brute(v)
    neg = pairs.negative_pairs(df, block_size=block).collect()
    assert len(neg) == int((s < 0).sum())
    assert all(r["id_a"] < r["id_b"] for r in neg)
    assert all(-1 - 1e-12 <= r["similarity"] < 0 for r in neg)
    ex = pairs.extreme_pairs(df, block_size=block).collect()[0]
    assert ex["max_similarity"] == pytest.approx(s.max())
    assert ex["min_similarity"] == pytest.approx(s.min())
    pm = pairs.pair_moments(df, block_size=block).collect()[0]
    assert pm["mean_similarity"] == pytest.approx(s.mean(), abs=1e-9)
    assert pm["std_similarity"] == pytest.approx(s.std(), abs=1e-9)
    summ = pairs.negative_summary(df, block_size=block).collect()[0]
    assert summ["negative_count"] == int((s < 0).sum())


def test_extreme_pair_ties_go_to_smallest_ids(spark):
    df = frame(spark, {("m", "t"): [[1, 0], [1, 0], [1, 0]]})
    ex = pairs.extreme_pairs(df, block_size=2).collect()[0]
    assert (ex["most_similar_a"], ex["most_similar_b"]) == ("000", "001")


def test_buckets_keep_results(spark):
    """Groups of one bucket and of many give the same values; a null key is a group."""
    rng = np.random.default_rng(21)
    groups = {("m", f"t{g}"): rng.normal(size=(n, 6)) for g, n in enumerate([1, 3, 15, 40])}
    df = frame(spark, groups).repartition(3)
    full = {r["topic"]: r for r in moments.group_moments(df).collect()}
    split = {r["topic"]: r for r in moments.group_moments(df, bucket_rows=4).collect()}
    for t in full:
        assert split[t]["n"] == full[t]["n"] and split[t]["nz"] == full[t]["nz"]
        if full[t]["mean_similarity"] is not None:
            assert split[t]["mean_similarity"] == pytest.approx(full[t]["mean_similarity"], abs=1e-12)
            assert split[t]["std_similarity"] == pytest.approx(full[t]["std_similarity"], abs=1e-9)
    df = spark.createDataFrame([("m", None, "1", [1.0, 0.0]), ("m", None, "2", [1.0, 0.0])],
                               "model string, topic string, persona_id string, embedding array<double>")
    assert [(r["topic"], r["n"], r["mean_similarity"]) for r in moments.group_moments(df).collect()] == [(None, 2, 1.0)]


def test_different_lengths_are_an_error(spark):
    df = spark.createDataFrame([("m", "t", "1", [1.0]), ("m", "t", "2", [1.0, 0.0])],
                               "model string, topic string, persona_id string, embedding array<double>")
    with pytest.raises(Exception, match="different lengths"):
        moments.group_moments(df).collect()


def test_gram_stripes_of_large_groups(spark):
    """Buckets of a large group send stripes of G, not an entry a row; the squares stay those of all pairs."""
    from consonance.operators import moments

    rng = np.random.default_rng(3)
    for d in (1, 31, 32, 33, 64, 70):
        x = rng.normal(0, 1, (50, d))
        rows = [("m", "t", str(i), [float(a) for a in v]) for i, v in enumerate(x)] + [("m", "t", "none", None), ("m", "u", "a", [1.0] * d)]
        df = spark.createDataFrame(rows, "model string, topic string, persona_id string, embedding array<double>")
        got = {r["topic"]: r for r in moments.group_moments(df, bucket_rows=8).collect()}
        u = x / np.linalg.norm(x, axis=1)[:, None]
        s = (u @ u.T)[np.triu_indices(50, 1)]
        assert got["t"]["n"] == 51 and got["t"]["nz"] == 50 and got["u"]["mean_similarity"] is None
        assert abs(got["t"]["sum_s"] - s.sum()) < 1e-8 and abs(got["t"]["sum_s2"] - (s * s).sum()) < 1e-8
    e = moments._entries(9, 9, np.ones(1000), np.ones((1000, 1000)), False)
    assert len(e) == 1 + -(-1000 // moments.STRIPE)
    total = sum(moments._square_of_sum(int(k), [m]) for k, m in zip(e["k"], e["m"]) if k >= 0)
    assert total == 1000 * 1000


def test_short_sparse_rows_are_summed_without_dense_rows(monkeypatch):
    """Rows of a dozen entries were densified to 1,000 columns before their products were taken."""
    import numpy as np
    import pandas as pd

    from consonance.operators import moments

    rng, dim = np.random.default_rng(3), 300
    idx = [rng.permutation(dim)[:k].astype(np.int32) for k in rng.integers(0, 9, 500)] + [None]
    val = [rng.normal(size=len(i)) for i in idx[:-1]] + [None]
    val[3] = val[3] * 0.0
    pdf = pd.DataFrame({"_idx": idx, "_val": val, "_nb": 2, "_g": "g"})
    fn = moments._bucket_fn("vec", dim)
    monkeypatch.setattr(moments, "DENSE_SPEED", 10 ** 9)
    want = fn(pdf)
    monkeypatch.undo()
    monkeypatch.setattr(moments, "_stack_sparse", None)
    got = fn(pdf)
    assert got.drop(columns="m").equals(want.drop(columns="m")) and len(got) == 11
    for a, b in zip(got["m"], want["m"]):
        assert np.abs(np.frombuffer(a) - np.frombuffer(b)).max() < 1e-12
    # an index that repeats in a row is left to dense rows, where the last value counts
    assert moments._sparse_gram(np.array([[1, 1]] * 2), np.array([[1.0, 2.0]] * 2), dim) is None

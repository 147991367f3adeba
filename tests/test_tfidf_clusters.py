"""TF-IDF against a brute-force definition; cluster indices against numpy."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from consonance.operators import clusters, pairs, text_vectors

DOCS = [("m", "t", "1", "Apples and pears; apples again!"),
        ("m", "t", "2", "Pears are green, apples are red."),
        ("m", "t", "3", "Élan vital: über-cool café"),
        ("m", "t", "4", "a b c"),  # no token of length >= 2: zero vector
        ("m", "u", "5", "solo text here")]


def brute_tfidf(texts, stop, k=1000):
    import re
    toks = [[t for t in re.findall(r"[^\W]{2,}", x.lower()) if t not in stop] for x in texts]
    cnt = Counter(t for d in toks for t in d)
    vocab = sorted(cnt, key=lambda t: (-cnt[t], t))[:k]
    n = len(texts)
    df = {t: sum(1 for d in toks if t in d) for t in vocab}
    rows = []
    for d in toks:
        c = Counter(t for t in d if t in df)
        w = {t: c[t] * (math.log((1 + n) / (1 + df[t])) + 1) for t in c}
        nr = math.sqrt(sum(v * v for v in w.values()))
        rows.append({t: v / nr for t, v in w.items()} if nr else {})
    return rows


def test_tfidf_matches_definition(spark):
    df = spark.createDataFrame(DOCS, "model string, topic string, persona_id string, response string")
    stop = set(text_vectors.spark_stop_words())
    w = text_vectors.tfidf_weights(df).collect()
    got = {}
    for r in w:
        got.setdefault((r["topic"], r["persona_id"]), {})[r["term"]] = r["weight"]
    exp = brute_tfidf([d[3] for d in DOCS[:4]], stop)
    for i, e in enumerate(exp):
        g = got.get(("t", str(i + 1)), {})
        assert set(g) == set(e)
        for t in e:
            assert g[t] == pytest.approx(e[t])


def test_tfidf_vocab_cap_and_sparse_moments(spark):
    df = spark.createDataFrame(DOCS, "model string, topic string, persona_id string, response string")
    w = text_vectors.tfidf_weights(df, max_features=2)
    assert w.groupBy("model", "topic").agg(F.countDistinct("term").alias("k")).agg(F.max("k")).collect()[0][0] <= 2
    w = text_vectors.tfidf_weights(df)
    v = text_vectors.sparse_vectors(w, df)
    assert v.count() == len(DOCS)  # documents without terms keep a zero vector
    pm = {r["topic"]: r for r in pairs.pair_moments(v, vec_col="vec", sparse_dim=1000, block_size=2).collect()}
    cf = {r["topic"]: r for r in text_vectors.sparse_mean_similarity(w, df).collect()}
    assert pm["t"]["mean_similarity"] == pytest.approx(cf["t"]["mean_similarity"])
    assert pm["u"]["pairs"] == 0 and pm["u"]["mean_similarity"] is None


def _pts(spark, x, labels, group="g"):
    rows = [(group, str(i), str(l), [float(a) for a in v]) for i, (v, l) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "grp string, persona_id string, cluster string, scaled array<double>")


def test_indices_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (8, 3)), rng.normal(4, 1, (7, 3)), rng.normal((0, 5, 0), 1, (1, 3))])
    lab = np.array([0] * 8 + [1] * 7 + [2])
    df = _pts(spark, x, lab)
    d = np.linalg.norm(x[:, None] - x[None], axis=-1)
    s = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    sil = clusters.silhouette(df, ["grp"], block_size=4).collect()[0]["silhouette"]
    assert sil == pytest.approx(np.mean(s))
    mu = x.mean(0)
    cents = np.array([x[lab == c].mean(0) for c in range(3)])
    W = sum(((x[lab == c] - cents[c]) ** 2).sum() for c in range(3))
    B = sum((lab == c).sum() * ((cents[c] - mu) ** 2).sum() for c in range(3))
    ch = clusters.calinski_harabasz(df, ["grp"]).collect()[0]["calinski_harabasz"]
    assert ch == pytest.approx(B * (len(x) - 3) / (W * 2))
    intra = np.array([np.linalg.norm(x[lab == c] - cents[c], axis=1).mean() for c in range(3)])
    cd = np.linalg.norm(cents[:, None] - cents[None], axis=-1)
    np.fill_diagonal(cd, np.inf)
    db_exp = np.mean(np.max((intra[:, None] + intra[None]) / cd, axis=1))
    db = clusters.davies_bouldin(df, ["grp"]).collect()[0]["davies_bouldin"]
    assert db == pytest.approx(db_exp)


def test_standardize_and_pca(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 5)) * [1, 2, 3, 0, 5]
    rows = [("g", str(i), [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "grp string, persona_id string, embedding array<double>")
    s = clusters.standardize(df, ["grp"], "embedding", "scaled")
    z = np.array([r["scaled"] for r in s.orderBy(F.col("persona_id").cast("int")).collect()])
    assert np.allclose(z[:, [0, 1, 2, 4]].mean(0), 0, atol=1e-12)
    assert np.allclose(z[:, [0, 1, 2, 4]].std(0), 1)
    assert np.allclose(z[:, 3], 0)  # zero variance: centred, not scaled
    m = clusters.pca_models(s, ["grp"], "scaled", 3).collect()[0]
    assert sum(m["explained_variance_ratio"]) <= 1 + 1e-9
    p = clusters.reduce_3d(s, ["grp"], "scaled", "pca").collect()
    assert len(p) == 30
    with pytest.raises(ValueError):
        clusters.reduce_3d(s, ["grp"], "scaled", "tsne")


def test_kmeans_gmm_invariants(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(0, 0.3, (12, 2)), rng.normal(5, 0.3, (12, 2))])
    rows = [("g", str(i), [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "grp string, persona_id string, scaled array<double>")
    lab, cen = clusters.kmeans(df, ["grp"], [2, 3])
    got = lab.collect()
    assert len(got) == 48 and {r["k"] for r in got} == {2, 3}
    k2 = {r["_id"]: r["cluster"] for r in got if r["k"] == 2}
    assert len(set(k2[str(i)] for i in range(12))) == 1 and k2["0"] != k2["12"]
    glab, ll, d = clusters.gaussian_mixture(df, ["grp"], [2])
    g2 = {r["_id"]: r["cluster"] for r in glab.collect()}
    assert len(g2) == 24 and g2["0"] != g2["12"]
    m = clusters.sweep(df, ["grp"], max_clusters=4)
    best = clusters.choose_k(m, ["grp"]).collect()[0]
    assert 2 <= best["optimal_clusters"] <= 4
    final = clusters.robust_labels(df, ["grp"], clusters.choose_k(m, ["grp"])).collect()
    assert len(final) == 24 and len({r["persona_id"] for r in final}) == 24


def test_distributed_fit_path_for_large_groups(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 0.3, (10, 2)), rng.normal(6, 0.3, (10, 2))])
    rows = [("big", str(i), [float(a) for a in v]) for i, v in enumerate(x)] + \
           [("small", str(100 + i), [float(a) for a in v]) for i, v in enumerate(x[:6])]
    df = spark.createDataFrame(rows, "grp string, persona_id string, scaled array<double>")
    labels, ll, d = clusters.fit_groups(df, ["grp"], [2], local_max=8, n_init=2)  # 'big' exceeds the bound
    got = labels.where("grp = 'big' AND method = 'gmm'").collect()
    lab = {r["_id"]: r["cluster"] for r in got}
    assert len(lab) == 20 and lab["0"] != lab["10"]
    assert {r["grp"] for r in ll.collect()} == {"big", "small"} and d == 2


def test_fit_does_not_depend_on_path_or_on_other_fits(spark):
    """The same labels from one task and from distributed passes, alone and beside other groups and k."""
    rng = np.random.default_rng(11)
    rows = [(g, f"{g}{i}", [float(a) for a in v]) for g in "ab" for i, v in enumerate(rng.normal(0, 1, (40, 3)))]
    df = spark.createDataFrame(rows, "grp string, persona_id string, scaled array<double>")

    def fit(data, ks, bound):
        lab, ll, _ = clusters.fit_groups(data, ["grp"], ks, local_max=bound, n_init=2, max_iter=60)
        return ({(r["grp"], r["method"], r["k"], r["_id"]): r["cluster"] for r in lab.collect()},
                {(r["grp"], r["k"]): r["ll"] for r in ll.collect()})

    local, ll = fit(df, [2, 3], 1000)
    spread, ll2 = fit(df, [2, 3], 10)
    assert local == spread and ll2 == pytest.approx(ll, abs=1e-6)
    alone, _ = fit(df.where("grp = 'a'"), [3], 10)
    assert all(local[key] == c for key, c in alone.items()) and len(alone) == 80


def test_small_and_failed_groups_stay_in_the_result(spark):
    rows = [("two", "1", [0.0, 1.0]), ("two", "2", [1.0, 0.0]), ("one", "3", [1.0, 1.0])]
    rows += [("nan", f"n{i}", [float("nan"), 1.0]) for i in range(4)]
    rows += [("ok", f"o{i}", [float(i // 4 * 9 + i % 3), float(i)]) for i in range(8)]
    df = spark.createDataFrame(rows, "grp string, persona_id string, scaled array<double>")
    m = clusters.sweep(df, ["grp"], max_clusters=3, n_init=1, max_iter=20)
    best = {r["grp"]: r["optimal_clusters"] for r in clusters.choose_k(m, ["grp"]).collect()}
    assert set(best) == {"two", "one", "nan", "ok"} and best["two"] == best["one"] == 1
    bad = [r for r in m.collect() if r["grp"] == "nan"]
    assert bad and all(r["silhouette"] == -1.0 for r in bad)
    only = clusters.sweep(df.where("grp = 'one'"), ["grp"])
    assert [(r["k"], r["silhouette"]) for r in only.collect()] == [(1, None)]


def test_tfidf_moments_both_paths_agree(spark):
    rows = [("m", "t", str(i), f"alpha beta gamma {'delta ' * (i % 4)} epsilon{i % 3} zeta{i % 5}")
            for i in range(40)]
    df = spark.createDataFrame(rows, "model string, topic string, persona_id string, response string")
    w = text_vectors.tfidf_weights(df)
    sizes = df.groupBy("model", "topic").count().withColumnRenamed("count", "n")
    a = text_vectors.tfidf_similarity_moments(w, sizes, pair_max=1000).collect()[0]
    b = text_vectors.tfidf_similarity_moments(w, sizes, pair_max=10).collect()[0]  # Gram path
    assert a["pairs"] == b["pairs"] == 780
    assert a["mean_similarity"] == pytest.approx(b["mean_similarity"], abs=1e-9)
    assert a["std_similarity"] == pytest.approx(b["std_similarity"], abs=1e-6)


def test_encoder_fallback(spark):
    rows = [("m", "t", str(i), t) for i, t in enumerate(["alpha beta", "alpha gamma", "delta"])]
    df = spark.createDataFrame(rows, "model string, topic string, persona_id string, response string")

    def encoder():
        return lambda texts: np.ones((len(texts), 4))

    def absent():
        raise OSError("no model files")

    assert text_vectors.answer_moments(df, encoder).collect()[0]["mean_similarity"] == pytest.approx(1.0)
    tfidf = text_vectors.answer_moments(df).collect()[0]["mean_similarity"]
    assert tfidf < 0.9
    for m in (text_vectors.answer_moments(df, encoder, force_tfidf=True), text_vectors.answer_moments(df, absent)):
        assert m.collect()[0]["mean_similarity"] == pytest.approx(tfidf)


def test_nearest_is_exact_on_ties_and_close_distances():
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(0, 1, (500, 5)), np.repeat(rng.normal(0, 1, (3, 5)), 4, axis=0)])
    c = np.vstack([x[:3], x[:3], x[0] + 1e-12, x[-1]])
    assert (clusters._nearest(x, c) == ((x[:, None, :] - c[None, :, :]) ** 2).sum(-1).argmin(1)).all()


def test_every_start_of_a_group_has_a_task_of_its_own(spark, monkeypatch):
    """All starts in one task per group (and groups that AQE puts together) left the other cores idle."""
    x = np.random.default_rng(5).normal(0, 1, (30, 2))
    df = spark.createDataFrame([(g, f"{i}", [float(a) for a in v]) for g in "ab" for i, v in enumerate(x)],
                               "grp string, persona_id string, scaled array<double>")
    used = {}
    kept = type(df).repartitionById
    monkeypatch.setattr(type(df), "repartitionById", lambda self, n, c: used.update(
        n=n, rows=kept(self, n, c).groupBy(F.spark_partition_id().alias("p")).agg(
            F.countDistinct("grp", "_start").alias("units")).collect()) or kept(self, n, c))
    labels, ll, _ = clusters.fit_groups(df, ["grp"], [2, 3], n_init=3)
    assert used["n"] == 6 and [r["units"] for r in used["rows"]] == [1] * 6
    assert labels.where("method = 'gmm'").count() == 2 * 2 * 30 and ll.count() == 4


def test_labels_of_a_sweep_are_not_fitted_again(spark, monkeypatch):
    x = np.random.default_rng(6).normal(0, 1, (20, 2))
    df = spark.createDataFrame([("g", f"{i}", [float(a) for a in v]) for i, v in enumerate(x)],
                               "grp string, persona_id string, scaled array<double>")
    m, fitted = clusters.sweep(df, ["grp"], 3, n_init=clusters.N_INIT, with_fits=True)
    best = clusters.choose_k(m, ["grp"])
    again = {tuple(r) for r in clusters.robust_labels(df, ["grp"], best).collect()}
    monkeypatch.setattr(clusters, "fit_groups", None)
    assert {tuple(r) for r in clusters.robust_labels(df, ["grp"], best, fitted=fitted).collect()} == again


def test_tfidf_shuffles_texts_not_term_counts(spark, capsys):
    """What is counted per document stays where its text was dealt to: counts, the vocabulary join and the norm need no other shuffle."""
    df = spark.createDataFrame(DOCS, "model string, topic string, persona_id string, response string")
    text_vectors.tfidf_weights(df).explain("simple")
    plan = capsys.readouterr().out
    by_document = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "persona_id" in x]
    assert by_document and all("REPARTITION_BY" in x for x in by_document)
    assert "BroadcastExchange" in plan

"""Learned operators: held-out accuracy, brute-force statistics, gradients and defined cases."""

import binascii
import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from consonance.llm import decision_list as D
from consonance.llm import fm_quality as Q
from consonance.llm import secret_scan as X

SF = "/root/testdata/sf0.01"
EDGES = [None, "", " \n", "a", "x " * 4000, "same line\nsame line\n\nsame line", "Then Then Then Then Then Then Then", "é ü ñ" * 30,
         "a b c d e a b c d e f", "#*$%&|<> !!", "tab\tand\x0bvt\x0cff\rcr"]


def _statistics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    cov = {j for i in range(len(w) - 4) if c[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cov))


def test_statistics_equal_brute_force(spark):
    texts = dict(enumerate(EDGES))
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in texts.items()], "doc_id long, text string, n int, words string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in D.statistics(df).collect()}
    assert got == {i: _statistics(t) for i, t in texts.items()}
    assert D.statistics(spark.createDataFrame([], T.StructType.fromDDL("doc_id long, text string"))).collect() == []


def test_decision_list_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id % 4 = 0")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    stats = D.written(D.statistics(docs), "test-stats")
    rules = D.learn(stats, labels)
    assert rules and all(r.covered >= D.MIN_COVERED for r in rules)
    rows = D.apply_rules(stats, rules).join(labels, "doc_id").collect()
    held = [r for r in rows if binascii.crc32(str(r.doc_id).encode()) % 5 == 0]
    junk = [r for r in held if r.quality == 0]
    clean = [r for r in held if r.quality == 1 and not r.base_failed]
    assert sum(not r.kept for r in junk) >= 0.9 * len(junk)
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.rule == 0)


def test_decision_list_without_labels(spark):
    stats = D.statistics(spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, None), (None, 0), (1, 1)], "doc_id long, quality int")
    assert D.learn(stats, labels) == [] and D.verdict_sql([]) == "0"
    assert [r.kept for r in D.apply_rules(stats, []).collect()] == [False, False]


def test_factorisation_identity():
    """The linear-time margin equals the sum over all pairs."""
    rng = np.random.default_rng(0)
    m = Q.Machine(0.3, rng.normal(size=Q.BUCKETS + 2), rng.normal(size=(Q.BUCKETS + 2, 4)), np.zeros(2), np.ones(2))
    at, x = np.array([5, 77, 900, Q.BUCKETS, Q.BUCKETS + 1]), rng.normal(size=5)
    got, _ = m.margin(np.zeros(5, int), at, x, 1)
    want = m.bias + (m.w[at] * x).sum()
    for i in range(5):
        for j in range(i):
            want += m.v[at[i]] @ m.v[at[j]] * x[i] * x[j]
    assert got[0] == pytest.approx(want)


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id % 3 = 0")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = Q.score(docs, Q.train(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in rows if binascii.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= Q.THRESHOLD) == (r.quality == 1) for r in held) >= 0.96 * len(held)


def test_quality_never_sees_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", Q.F.when(Q.held_out("doc_id"), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    a, b = Q.train(docs, labels, rows=60), Q.train(docs, flipped, rows=60)
    assert a.bias == b.bias and (a.w == b.w).all() and (a.v == b.v).all()


def test_quality_edge_rows(spark):
    df = spark.createDataFrame([(i % 4 or None, t, None, 2.0) for i, t in enumerate(EDGES)],
                               "doc_id long, text string, n_chars long, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    assert [r.score for r in Q.score(df, Q.train(df, labels)).collect()] == [0.5] * len(EDGES)
    one = Q.fit([(np.array([1, 2]), np.array([0.6, 0.8]), np.arange(13.0) + i) for i in range(6)], np.array([0, 1] * 3))
    s = [r.score for r in Q.score(df, one).collect()]
    assert len(s) == len(EDGES) and all(0 <= x <= 1 for x in s)
    empty = spark.createDataFrame([], T.StructType.fromDDL("doc_id long, text string"))
    assert Q.score(empty, one).collect() == []


def _base(t):
    """The base findings, written from their definition."""
    t = t or ""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return [(s, ("assign", "access", "hex")[k], e) for s, k, e in sorted(out)]


def test_secret_query_base_findings(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in X.query(spark, SF).collect():
        want = _base(docs[r.doc_id])
        text = ",".join(f"{k}:{s}:{e}" for s, k, e in want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in want) for x in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("learned")] == [x for x in text.split(",") if x]


def test_secret_edge_rows(spark):
    h = "0123456789abcdef"
    texts = [None, "", "é password: token: abcdefghij", "TOKEN='" + h * 2 + "'", "apikey=short api_key = longer_than_8", "AKIA" + "A" * 12,
             "AKIAAKIA", h * 5000, "Secret:x" * 3, "ſecret=abcdefghijk", "same token=12345678", "same token=12345678"]
    df = spark.createDataFrame([(i if i < 9 else 9, t, "z") for i, t in enumerate(texts)] + [(None, "token=abcdefgh", "z")],
                               "doc_id long, text string, findings string")
    got = [(r.doc_id, [(f["first"], f["kind"], f["last"]) for f in r.findings]) for r in X.scan(df, X.train(df)).collect()]
    want = [(i if i < 9 else 9, _base(t)) for i, t in enumerate(texts)] + [(None, _base("token=abcdefgh"))]
    # this input labels no negatives, so nothing is learned
    assert sorted(got, key=str) == sorted(want, key=str)
    assert X.scan(spark.createDataFrame([], T.StructType.fromDDL("doc_id long, text string")), None).collect() == []


def test_redaction():
    t = "a token=abcdefghij b"
    f = [{"first": s, "last": e} for s, e, _ in X.base_findings(t)]
    assert X._redact(t, f) == "a [secret] b" and X._redact(None, []) is None


def _findings(n, seed):
    rng = np.random.default_rng(seed)
    x, y, h = [], [], []
    for i in range(n):
        if i % 3:
            t = f"call {rng.integers(200, 999)}-{rng.integers(1000, 9999)} or {rng.integers(10 ** 15, 10 ** 16)} then"
            s, e = X.candidates(t, [])[i % 2]
        else:
            s, t = 7, "token = " + "".join(rng.choice(list("0123456789abcdef"), 24)) + " then"
            s, e = 8, 32
        x.append(X.view(t, s, e))
        y.append(int(i % 3 == 0))
        h.append(i % 3 == 0)
    return np.stack(x), np.array(y), np.array(h)


def test_network_gradients_and_held_out_recall():
    x, y, h = _findings(400, 0)
    net = X._new_net(np.random.default_rng(1))
    xb, yb, w = x[:16], y[:16].astype(float), np.ones(16)

    def loss():
        m = net.forward(xb)[3]
        return (np.log1p(np.exp(m)) - yb * m).mean()

    for p, g in zip([net.emb, net.conv, net.cb, net.out, net.ob], X._gradients(net, xb, yb, w)):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[i]
        p[i] = old + 1e-5
        a = loss()
        p[i] = old - 1e-5
        b = loss()
        p[i] = old
        assert (a - b) / 2e-5 == pytest.approx(g[i], rel=1e-3)
    fitted = X.fit(x, y, h)
    x2, y2, _ = _findings(200, 7)
    p = fitted.probability(x2)
    at = fitted.thresholds[None]
    assert (p[y2 == 1] >= at).mean() >= 0.97 and (p[y2 == 0] >= at).mean() <= 0.03
    assert X.fit(x, np.ones(400, int), h) is None


def test_secret_candidates_are_read_whole():
    """Runs without a digit are candidates, and the views of a long run leave no character out."""
    t = "tell correct-horse-battery and short or " + "https//host.example/" + "path/" * 30 + "end 12345678"
    got = [t[s:e] for s, e in X.candidates(t, [])]
    assert got == [w for w in t.split() if len(w) >= 8]
    for n in (8, 48, 49, 72, 73, 200):
        spans = X.parts(5, 5 + n)
        assert spans[0][0] == 5 and spans[-1][1] == 5 + n and all(e - s <= 48 for s, e in spans)
        # whatever is up to 24 characters long lies in one view
        assert all(any(s <= a and min(a + 24, 5 + n) <= e for s, e in spans) for a in range(5, 5 + n))
    net = X._new_net(np.random.default_rng(0))
    a, b = "x" * 90 + "AKxq7Zp9Lm3Rt5Vw" + "x" * 90, "x" * 196
    high = [max(net.probability(np.stack([X.view(w, *p) for p in X.parts(0, len(w))]))) for w in (a, b)]
    assert high[0] != high[1]


def _plain_view(text, start, end):
    """A view put together character by character."""
    out = []
    for a in [*range(start - X.BEFORE, start), *range(start, start + X.HEAD + X.TAIL), *range(end, end + X.AFTER)]:
        hidden = len(out) < X.BEFORE + X.HEAD + X.TAIL and a >= end
        c = text[a] if 0 <= a < len(text) and not hidden else None
        out.append(0 if c is None else ord(c) - 31 if " " <= c <= "~" else 96)
    return out


def test_secret_views_of_a_batch():
    texts = ["", "abcdefgh", "é" * 30 + "token_run-1234567 tail\x00x", "z" * 100]
    spans = [(1, 0, 8), (2, 30, 47), (2, 48, 52), (3, 0, 48), (3, 52, 100), (3, 90, 100)]
    got = X.Codes(texts).views(*np.array(spans).T)
    assert got.tolist() == [_plain_view(texts[i], a, b) for i, a, b in spans]


def test_secret_looked_up_sums_are_the_network():
    rng = np.random.default_rng(1)
    net = X._new_net(rng)
    net.cb, net.ob = rng.normal(0, 1, net.cb.shape), rng.normal(0, 1, 1)
    x = rng.integers(0, 97, (700, X._LEN)).astype(np.uint8)
    assert np.allclose(net.margins(x), net.forward(x)[3], atol=1e-4)


def test_secret_first_examples_by_hash(spark, monkeypatch):
    monkeypatch.setattr(X, "MAX_EXAMPLES", 20)
    ex = spark.range(3000).selectExpr("cast(cast(id as string) as binary) x", "1 y", "false hexlike").withColumn("h", X.F.xxhash64("x"))
    want = [r.x for r in ex.orderBy("h", "x").limit(20).collect()]
    assert [r.x for r in X._first(ex, 3000).collect()] == want
    assert [r.x for r in X._first(ex, 10 ** 9).collect()] == want and X._first(ex.limit(5), 5).count() == 5


def test_secret_fit_reads_every_document(spark):
    """Labelled findings in documents that come last by the hash of their ids, behind 20,000 others."""
    ids = [r.id for r in spark.range(20_060).orderBy(X.F.xxhash64("id"), "id").collect()]
    rows = [(i, f"see token: {i:024x} here" if k >= 20_000 else f"see item{i:09d} here") for k, i in enumerate(ids)]
    net = X.train(spark.createDataFrame(rows, "doc_id long, text string"))
    assert net is not None and set(net.thresholds) >= {None}


def test_secret_fit_is_that_of_the_rows(spark, monkeypatch):
    """Several rounds of several parts, whatever the partitions; slices and parts leave no document out."""
    monkeypatch.setattr(X, "SLICE", 64)
    assert [(a, k) for a, _, k in X._rounds(1000)] == [(0, 1), (0.064, 4), (0.32, 11)] and X._rounds(1000)[-1][1] == 1
    rng = np.random.default_rng(0)
    rows = [(i if i % 50 else None, "token = " + "".join(rng.choice(list("0123456789abcdef"), 24)) if i % 4 == 0 else
             f"call {rng.integers(10 ** 15, 10 ** 16)} or https://host.example/{i:05d} then") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = X.train(df.repartition(3)), X.train(df.orderBy(X.F.desc("text")).coalesce(1))
    assert all(np.array_equal(p, q) for p, q in zip(X._params(a), X._params(b)))
    assert (a.slope, a.shift, a.thresholds) == (b.slope, b.shift, b.thresholds)
    x = np.concatenate([v[y == 1] for v, y, _ in X._examples([r[1] for r in rows])])
    assert (a.probability(x) >= a.thresholds[None]).mean() >= 0.95

"""ARC to WARC, exact top-k search and the corpus pipeline."""

import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import types as T

import corpus_pipeline as P
from consonance.llm import arc_to_warc as A
from consonance.llm import nra_topk as N

SF = "/root/testdata/sf0.001"


def _arc(version, records, extra=""):
    block = f"{version} 0 org\n{A.ARC_FIELDS[version]}\n".encode()
    out = [f"filedesc://x.arc 0.0.0.0 20050607080910 text/plain {len(block)}\n".encode(), block]
    for url, ctype, body in records:
        more = "" if version == 1 else " 200 - - 0 x.arc"
        out.append(f"\n{url} 10.0.0.1 20050607080911 {ctype}{more} {len(body)}\n".encode() + body)
    return b"".join([*out, extra.encode()])


@pytest.mark.parametrize("version", [1, 2])
def test_parse_arc_versions(version):
    http = b"HTTP/1.0 200 OK\r\nX-Page-Id: 7\r\n\r\nbody\nwith lines\n"
    recs = list(A.parse_arc(_arc(version, [("http://a/ b", "text/html", http), ("dns:a", "text/dns", b"1.2.3.4"), ("http://c", "t", b"")])))
    assert [r.kind for r in recs] == ["warcinfo", "response", "resource", "resource"]
    assert recs[1].payload == b"body\nwith lines\n" and recs[1].headers["x-page-id"] == "7"
    assert recs[1].fields["IP-address"] == "10.0.0.1" and recs[3].payload == b""
    if version == 1:
        assert recs[1].fields["URL"] == "http://a/ b"       # legacy urls may hold spaces
    warc = b"".join(A.warc_record(r, "x.arc", None) for r in recs)
    back = list(A.parse_warc(warc))
    assert [f["warc-type"] for f, _ in back] == ["warcinfo", "response", "resource", "resource"]
    assert back[1][1] == http and back[1][0]["warc-date"] == "2005-06-07T08:09:11Z"
    assert len({f["warc-record-id"] for f, _ in back}) == 4
    assert back[1][0]["warc-record-id"] == f"<{A.record_id('s3/x.arc', recs[1].offset)}>"


def test_truncated_and_malformed():
    data = _arc(1, [("http://a", "text/html", b"12345")])[:-2]
    assert list(A.parse_arc(data))[-1].truncated
    assert b"WARC-Truncated: length" in A.warc_record(list(A.parse_arc(data))[-1], "x", None)
    with pytest.raises(ValueError, match="offset"):
        list(A.parse_arc(data + b"\nno header here\n"))
    assert A.warc_date("2005") == "2005-01-01T00:00:00Z" and A.warc_date("x") == "1970-01-01T00:00:00Z"
    assert A._gunzip(gzip.compress(b"a") + gzip.compress(b"b")) == b"ab"


def test_pages_edge_rows(spark):
    big = "é" * 600
    rows = [(1, "http://a b", big), (2, None, big), (5, "u", big), (3, "u", None), (4, "u", ""), (6, "u", "x" * 999), (7, "u", "x" * 999),
            (8, "u", "line\n\r\n" * 3000), (9, "", "HTTP/1.1 inside\r\n\r\n" * 100), (None, "u", "z" * 2000), (10, "u", "z" * 2000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, type string").repartition(2)
    out = A.archived_pages(df, archive_bytes=3000).collect()
    got = {r.key: (r.payload_bytes, r.payload_digest, r.type, r.refers_to) for r in out}
    assert len(out) == len(rows)
    for key, _, html in rows:
        data = (html or "").encode()
        same = [k or -1 for k, _, t in rows if t == html and len(data) >= 1000]
        ref = max(same) if same and max(same) != (key or -1) else None
        assert got[key] == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if ref else "response", ref)


def test_pages_empty_table(spark):
    df = spark.createDataFrame([], T.StructType.fromDDL("page_id long, url string, html string"))
    assert A.archived_pages(df).collect() == []


def _brute(rows, k, queries):
    out = set()
    for q in queries:
        for own in [v for i, v in rows if i == q]:
            scored = sorted((-int(np.dot(own, v)), i) for i, v in rows if i != q and len(v) == len(own))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("kind", ["spread", "ties", "few"])
def test_top_k_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(N, "BLOCK", 64)
    monkeypatch.setattr(N, "QUERY_BLOCK", 4)
    monkeypatch.setattr(N, "RESOLVE", 8)
    rng = np.random.default_rng(3)
    n = 3 if kind == "few" else 300
    rows = [(int(i), rng.integers(-3, 4, 8).tolist() if kind == "ties" else rng.normal(0, 90, 8).astype(int).tolist()) for i in range(n)]
    if kind == "ties":
        rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]
        rows += [(900, [0] * 8), (901, [1, 2]), (950, [3, -4])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, vector array<long>, id int").repartition(3)
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in N.top_k(df.where("vec_id % 50 = 0"), df).collect()}
    assert got == _brute(rows, 5, [i for i, _ in rows if i % 50 == 0])


def test_lists_stop_early():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 60, (2000, 16)).astype(np.int64)
    lists = N.Lists(np.arange(2000), x)
    q = x[0]
    score = x @ q
    floor = int(np.sort(score)[-6])
    (ids, s), = lists.top(q[None], np.array([0]), 5, [floor])
    want = np.lexsort((np.arange(1, 2000), -score[1:]))[:5] + 1
    assert ids.tolist() == want.tolist() and s.tolist() == score[want].tolist()
    assert 5 <= lists.resolved <= N.RESOLVE and lists.read <= 2000


def test_lists_prune_on_their_own():
    """No score known beforehand; long-tailed vectors: the lower bounds alone stop the reading."""
    rng = np.random.default_rng(5)
    x = np.abs(rng.standard_cauchy((5000, 4)) * 100).clip(0, 10 ** 7).astype(np.int64)
    lists = N.Lists(np.arange(5000), x)
    at = np.arange(0, 5000, 250)
    for i, (ids, s) in zip(at, lists.top(x[at], at, 5, [None] * 20)):
        score = x @ x[i]
        score[i] = -1
        want = np.lexsort((np.arange(5000), -score))[:5]
        assert ids.tolist() == want.tolist() and s.tolist() == score[want].tolist()
    assert lists.resolved <= 20 * N.RESOLVE and lists.read < 20 * 5000 / 2


@pytest.mark.parametrize("size", [3 * 10 ** 8, 2 * 10 ** 9, 10 ** 12])
def test_lists_with_scores_beyond_doubles_and_longs(size):
    """Scores near 1.8e17, near the end of 64 bits and beyond it, also with the best floor of an earlier block."""
    rng = np.random.default_rng(2)
    x = (size + rng.integers(-40, 40, (3000, 2))).astype(np.int64)
    x[::7] = -x[::7]
    ids = rng.permutation(3000)
    lists = N.Lists(ids, x)
    for i in range(0, 3000, 150):
        exact = [min(max(int(a), -2 ** 63), 2 ** 63 - 1) for a in x.astype(object) @ x[i].astype(object)]
        want = sorted((-s, int(j)) for s, j in zip(exact, ids) if j != ids[i])[:5]
        for floor in (None, -want[-1][0]):
            got, = lists.top(x[i][None], ids[[i]], 5, [floor])
            assert [(-int(s), int(j)) for j, s in zip(*got)] == want


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None), (5, [0.5, -0.001]), (None, [1.0, 1.0]), (50, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = N.quantised(df)
    assert {r.vec_id: r.vector for r in v.where("vec_id is not null").collect()} == {0: [256, 512], 5: [128, -1], 50: []}
    assert [tuple(r) for r in N.top_k(v.where("vec_id % 50 = 0"), v).collect()] == [(0, 1, 5, 128 * 256 - 512)]
    empty = spark.createDataFrame([], T.StructType.fromDDL("vec_id long, vector array<long>"))
    assert N.top_k(empty, empty).collect() == []


def test_pipeline_stages(spark):
    """Each stage on the rows its predecessor kept: what it may change, and nothing else."""
    docs = P.table(spark, SF, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in P.STAGES:
        docs = P.written(stage(spark, docs, SF), f"test-{name}")
        rows = docs.collect()
        assert rows
        if name == "best_fit_packing":
            words = {}
            for r in rows:
                words[r.doc_id] = words.get(r.doc_id, 0) + r.n_words
            assert words == {i: len(r.text.split()) for i, r in before.items()}
            break
        assert tuple(docs.columns) == P.COLUMNS
        now = {r.doc_id: r for r in rows}
        assert len(now) == len(rows) and set(now) <= set(before)
        if name in ("quality_classifier", "near_dedup"):
            assert all(now[i] == before[i] for i in now)
        if name == "line_dedup":
            assert all(set(now[i].text.split("\n")) <= set(before[i].text.split("\n")) for i in now)
            lines = [x for r in rows for x in r.text.split("\n") if x.strip()]
            assert len(lines) == len(set(lines))
        if name == "secret_scan":
            assert set(now) == set(before)
            assert all(now[i] == before[i] or "[secret]" in now[i].text for i in now)
            assert not any(P.secret_scan.base_findings(r.text) for r in rows)
        assert all(r.n_chars == len(r.text) or r.n_chars == before[r.doc_id].n_chars for r in rows)
        before = now


def test_pipeline_edge_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    rows = [(1, None, "en", "s", None, 1), (None, "a null id here", None, None, 3, 1), (2, "", "en", "s", 0, 1),
            (3, "token=abcdefghij word", "en", None, 21, 1), (3, "token=abcdefghij word", "en", None, 21, 1)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in P.STAGES:
            docs = P.written(stage(spark, docs, SF), f"edge-{name}")
            assert tuple(docs.columns) == P.COLUMNS or name == "best_fit_packing"
        assert data or docs.count() == 0


def test_registered(spark):
    from consonance.llm import registry
    names = registry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(names)


def test_read_back_hashes_a_response_twice(monkeypatch):
    http = b"HTTP/1.0 200 OK\r\nX-Page-Id: 7\r\n\r\n" + b"body" * 500
    recs = list(A.parse_arc(_arc(1, [("http://a", "text/html", http)])))
    warc = gzip.compress(b"".join(A.warc_record(r, "x.arc", None) for r in recs[1:]))
    calls, digest = [], A._digest
    monkeypatch.setattr(A, "_digest", lambda data: calls.append(len(data)) or digest(data))
    batch = A.pa.RecordBatch.from_pydict({"content": [warc]})
    row = next(A._read(A.KEY_HEADER)(iter([batch]))).to_pylist()[0]
    assert calls == [len(http), 2000] and row["payload_digest"] == hashlib.sha1(b"body" * 500).hexdigest()
    bad = warc[:0] + gzip.compress(gzip.decompress(warc).replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:Z", 1))
    with pytest.raises(ValueError, match="payload digest"):
        list(A._read(A.KEY_HEADER)(iter([A.pa.RecordBatch.from_pydict({"content": [bad]})])))


def test_archives_are_written_at_the_cheap_level(spark, tmp_path):
    import random

    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(400)]
    data = (" ".join(rng.choices(words, k=60_000)) + "\n").encode()
    df = spark.createDataFrame([(bytearray(data),)], "content binary")
    A.write_archives(df, str(tmp_path / "a"), "\n")
    got = max((f.read_bytes() for f in (tmp_path / "a").glob("*.gz")), key=len)
    assert A._gunzip(got) == data
    assert len(got) > 1.02 * len(gzip.compress(data, 6))

"""Byte-level BPE against whole-text encoding by the library itself, and the exact round trip."""

import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import tiktoken
from pyspark.sql import types as T

from consonance.llm import byte_bpe as B

RANKS = P.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"


def _enc():
    with open(RANKS, "rb") as f:
        return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.parse_ranks(f.read()), special_tokens={})


def _digests(text):
    ids = _enc().encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(
        (text or "").encode()).hexdigest()


def test_query_equals_whole_text_encoding(spark):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.query(spark, SF).collect()}
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    assert got == {i: _digests(x) for i, x in zip(t["doc_id"], t["text"])}


def test_edge_texts(spark):
    texts = [None, "", " ", "\n\n  \t x", "don't  <|endoftext|> stop", "é" * 3000 + " ß", "a " * 5000, "日本語テキスト" * 500,
             "tab\tnbsp x   y\x1c z", "same", "same"]
    rows = [(i % 10, t, i) for i, t in enumerate(texts)] + [(None, "no id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = B.decode(B.encode(df, RANKS, P.PATTERN, piece_chars=16), RANKS, P.PATTERN).collect()
    got = sorted((r.n_tokens, hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.decoded).hexdigest()) for r in out)
    assert got == sorted(_digests(t) for _, t, _ in rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], T.StructType.fromDDL("doc_id long, text string"))
    assert B.decode(B.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect() == []


def test_pieces_join_to_the_text():
    t = "ab cd\nef  gh " * 50 + "x" * 200
    for size in (1, 7, 64, 10_000):
        assert "".join(B.pieces(t, size)) == t


def _merged(run: bytes, ranks):
    """Byte pair merges of a run of one repeated character, in plain Python, a rank at a time."""
    parts = [run[i:i + 1] for i in range(len(run))]
    while True:
        best = min((ranks.get(x + y, 1 << 60) for x, y in set(zip(parts, parts[1:]))), default=1 << 60)
        if best == 1 << 60:
            return [ranks[p] for p in parts]
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and ranks.get(parts[i] + parts[i + 1]) == best:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


def test_very_long_white_space_runs(spark):
    """Runs that the pattern's matcher cannot take, alone, at the end and between words."""
    with open(RANKS, "rb") as f:
        ranks = B.parse_ranks(f.read())
    n = 1_000_000
    texts, want = [], []
    for c in (" ", "\t", "\n", "\u3000"):
        enc = c.encode()
        whole, cut = _merged(enc * n, ranks), _merged(enc * (n - 1), ranks)
        last = _enc().encode_ordinary(c + "word")
        texts += [c * n, "word" + c * n, "word" + c * n + "word"]
        want += [whole, _enc().encode_ordinary("word") + whole, _enc().encode_ordinary("word") + cut + last]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = B.decode(B.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in out} == dict(enumerate(want))
    assert {r.doc_id: bytes(r.decoded).decode() for r in out} == dict(enumerate(texts))


def test_runs_are_cut_as_the_pattern_cuts_them(monkeypatch):
    import re

    monkeypatch.setattr(B, "RUN_CHARS", 3)
    monkeypatch.setattr(B, "_RUN", re.compile(B._RUN.pattern.replace("{65536,}", "{3,}")))
    with open(RANKS, "rb") as f:
        enc = B.Encoder(B.parse_ranks(f.read()), P.PATTERN)
    for t in ("a   b", "   ", "a \t\n b  \u2003\u3000c", "x\n\n\n\n", "   !  \x1c   d", "\x85\x85\x85\xa0\xa0é", ""):
        for size in (1, 2, 100):
            assert enc(t, size).tolist() == _enc().encode_ordinary(t)

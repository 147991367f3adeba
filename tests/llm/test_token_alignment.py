"""Alignment of two tokenizations against brute force over single bytes."""

import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T
from tokenizers import Tokenizer

from consonance.llm import token_alignment as M

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _files():
    with open(A, "rb") as f, open(B, "rb") as g:
        return f.read(), g.read()


def _tokens(text, a, b, alphabet):
    ia = a.encode(" " + text, add_special_tokens=False).ids
    ib = b.encode(text)
    ba = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ia]
    bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    want = (" " + text).encode()
    return (list(zip(ia, ba)), list(zip(ib, bb))) if text and b"".join(ba) == b"".join(bb) == want else ([], [])


def _brute(rows):
    """Every result by walking over the bytes of each text."""
    a, b, alphabet = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), M.byte_alphabet()
    a.encode_special_tokens = True
    docs, count = [], Counter()
    for doc_id, text in rows:
        ta, tb = _tokens(text or "", a, b, alphabet)
        over = [[k for k, (_, w) in enumerate(t) for _ in w] for t in (ta, tb)]
        links = sorted(set(zip(*over)))
        groups, cur = [], ([], [])
        for k, (x, y) in enumerate(zip(*over)):
            for side, tok, t in ((0, x, ta), (1, y, tb)):
                if k == 0 or over[side][k - 1] != tok:
                    cur[side].append(t[tok][0])
            if k + 1 == len(over[0]) or (over[0][k + 1] != x and over[1][k + 1] != y):
                groups.append("|".join(",".join(map(str, c)) for c in cur))
                cur = ([], [])
        pairs = [(ta[x][0], tb[y][0]) for x, y in links]
        count.update(set(pairs))
        docs.append((doc_id, len(ta), len(tb), groups, pairs))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted(((i is not None, i), na, nb, len(g), len(p), sum(count[q] == best[q[0]] for q in p), sum(count[q] for q in p),
                   hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, na, nb, g, p in docs)


def _run(monkeypatch, spark, df, tmp_path, block):
    """The query over a table of its own, in blocks of ``block`` characters."""
    path = str(tmp_path / "documents.parquet")
    df.write.parquet(path)
    monkeypatch.setattr(M.aligned, "__defaults__", (*M.aligned.__defaults__[:-1], block))
    out = M.query(spark, str(tmp_path))
    assert tuple(out.columns) == COLUMNS
    return sorted(((r[0] is not None, r[0]), *r[1:]) for r in out.collect())


def test_query_equals_brute_force(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    got = sorted(((True, r[0]), *r[1:]) for r in M.query(spark, SF).collect())
    assert got == _brute(list(zip(t["doc_id"], t["text"])))


@pytest.mark.parametrize("block", [1, 3000, M.BLOCK_BYTES])
def test_edge_texts_in_blocks_of_any_size(spark, monkeypatch, tmp_path, block):
    texts = [None, "", " ", "  lead", "has ▁ inside", "<|endoftext|> </s> <0x41>", "日本語 テキスト 😀", "a\n\n b\t ", "x" * 500,
             " " * 300, "same words here", "same words here", "naïve café — don't", "12345 6,789.00"] * 2
    rows = [(i % 9, t) for i, t in enumerate(texts)] + [(None, "no id")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a int, block string")
    assert _run(monkeypatch, spark, df, tmp_path, block) == _brute(rows)


def test_files_whose_ids_do_not_follow_the_merges_use_their_library():
    """The same vocabulary with two merged tokens swapped."""
    a, _ = _files()
    spec = json.loads(a)
    vocab = spec["model"]["vocab"]
    x, y = (t for t, i in vocab.items() if i in (300, 301))
    vocab[x], vocab[y] = vocab[y], vocab[x]
    plain, swapped = M.ByteLevel(a, P.PATTERN), M.ByteLevel(json.dumps(spec).encode(), P.PATTERN)
    assert plain.encoder and not plain.tokenizer and swapped.tokenizer and not swapped.encoder
    texts = [" the cat <|endoftext|> in  the hat\n", ""]
    for ours in (plain, swapped):
        assert [b"".join(ours.bytes[i] for i in ids) for ids in ours.ids(texts)] == [t.encode() for t in texts]
    assert [[{300: 301, 301: 300}.get(i, i) for i in ids] for ids in plain.ids(texts)] == swapped.ids(texts)


def test_all_documents_encode_as_by_the_library():
    rows = [" " + (t or "") for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()]
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    assert M.ByteLevel(_files()[0], P.PATTERN).ids(rows) == [e.ids for e in a.encode_batch(rows, add_special_tokens=False)]


def test_long_text_equals_the_tokenizers():
    al = M.Aligner(*_files(), P.PATTERN)
    text = "word, naïve 12 " * 20_000
    a = Tokenizer.from_file(A)
    assert al.tokens([text])[0][0] == a.encode(" " + text, add_special_tokens=False).ids
    assert al.tokens([text])[1][0] == al.b.pieces.library.encode(text)


def test_empty_table(spark, monkeypatch, tmp_path):
    df = spark.createDataFrame([], T.StructType.fromDDL("doc_id long, text string"))
    assert _run(monkeypatch, spark, df, tmp_path, 10) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=12), st.lists(st.integers(1, 5), max_size=12), st.integers(0, 6))
def test_coalesce_equals_brute_force(widths_a, widths_b, shift):
    """Any two sides, also where they do not cover the same range."""
    ends_a, ends_b = np.cumsum(widths_a, dtype=np.int64), np.cumsum(widths_b, dtype=np.int64) + shift
    starts_a, starts_b = ends_a - np.array(widths_a, np.int64), ends_b - np.array(widths_b, np.int64)
    ga, gb, la, lb = M.coalesce(starts_a, ends_a, starts_b, ends_b)
    links = [(i, j) for i in range(len(ends_a)) for j in range(len(ends_b))
             if starts_a[i] < ends_b[j] and starts_b[j] < ends_a[i]]
    assert list(zip(la.tolist(), lb.tolist())) == links
    assert all(ga[i] == gb[j] for i, j in links)
    cover = Counter(x for s, e in [*zip(starts_a, ends_a), *zip(starts_b, ends_b)] for x in range(s + 1, e))
    cuts = {int(s) for s in [*starts_a, *starts_b] if not cover[int(s)]}
    assert len(set(ga) | set(gb)) == len(cuts)


def test_texts_of_a_batch_become_strings_a_run_at_a_time():
    texts = ["é" * 400, None, "", "b" * 700, "c" * 5000, "d"] * 300
    got = list(M.slices(pa.array(texts), 1000))
    assert [t for _, _, part, _ in got for t in part] == texts
    assert [i for i, *_ in got] == [0, *(j for _, j, *_ in got[:-1])]
    assert all(chars == sum(len(t or "") for t in part) for *_, part, chars in got)
    assert all(chars <= 1000 or len(part) == 1 for *_, part, chars in got)
    # two workers share an executor's 1.2 GB outside the heap: arrays of some 100 bytes a character, each
    assert max(chars for *_, chars in M.slices(pa.array(["x" * 1000] * 4000))) <= 1 << 19

"""SentencePiece encoding, spans and the normaliser against the library itself."""

import hashlib
import random

import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import types as T

from consonance.llm import piece_offsets as O

MODEL = P.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "  a  b ", "héllo ▁x ▁", "<s> </s> <0x41> <unk>", "日本語テキスト😀\x00z", "a\n\n b\t", "x" * 3000,
         " " * 3000, "word " * 4000, "same", "same", "é ក្ម \x1c"]


def _model():
    with open(MODEL, "rb") as f:
        return f.read()


def _digests(text):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = lib.encode(text or "", add_eos=True)
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(lib.decode(ids).encode()).hexdigest(), len((text or "").encode()))


def test_query_equals_the_library(spark):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.span_bytes) for r in O.query(spark, SF).collect()}
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    assert got == {i: _digests(x) for i, x in zip(t["doc_id"], t["text"])}


@pytest.mark.parametrize("segment", [1, 7, O.SEGMENT_CHARS])
def test_ids_and_spans_equal_the_library(segment):
    pieces = O.Pieces(_model(), segment)
    assert pieces.segment_chars == segment
    for t in TEXTS:
        ids, starts, ends = pieces.spans(t or "")
        want = pieces.library.encode(t or "", return_type="proto").pieces
        assert list(zip(ids.tolist(), starts.tolist(), ends.tolist())) == [(p.id, p.begin, p.end) for p in want]
        assert pieces.ids(t or "").tolist() == ids.tolist()


def test_edge_rows(spark):
    rows = [(i % 5, t, i) for i, t in enumerate(TEXTS)] + [(None, "no id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    e = O.encode(df, MODEL)
    got = sorted((r.n_tokens, " ".join(map(str, r.ids)), r.decoded) for r in O.decode(e, MODEL).collect())
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = [lib.encode(t or "", add_eos=True) for _, t, _ in rows]
    assert got == sorted((len(i), " ".join(map(str, i)), lib.decode(i)) for i in ids)
    empty = [r for r in e.collect() if r.n_tokens == 1]
    assert all((r.ids, r.starts, r.ends) == ([2], [0], [0]) for r in empty) and len(empty) == 2


def test_long_texts(spark):
    texts = [" " * 1_000_000, "a" * 1_000_000, "one two " * 200_000]
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.ids for r in O.encode(df, MODEL, end_id=False).collect()} == dict(enumerate(lib.encode(texts)))


def test_empty_table(spark):
    df = spark.createDataFrame([], T.StructType.fromDDL("doc_id long, text string"))
    assert O.decode(O.encode(df, MODEL), MODEL).collect() == []


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_normaliser_equals_the_library(rule):
    """Longest-prefix replacement and its alignment, for the compiled maps that the library brings along."""
    rnd = random.Random(7)
    alphabet = list(" 　 ¨ａＡ①ﬁ㍿é́ガｶﾞ​ﷺab\t\n­ Éß▁")
    for flags in range(8):
        theirs = sentencepiece.SentencePieceNormalizer(
            rule_name=rule, add_dummy_prefix=bool(flags & 1), escape_whitespaces=bool(flags & 2),
            remove_extra_whitespaces=bool(flags & 4))
        mine = O.Normaliser(b"".join(v for k, v in O.fields(theirs.serialized_model_proto()) if k == 3))
        for _ in range(150):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(14)))
            want, offsets = theirs.normalize(text, with_offsets=True)
            got, source = mine(text)
            at = [0]
            for c in got:
                at.append(at[-1] + len(c.encode()))
            assert got == want
            assert [len(text.encode()[:source[a]].decode()) for a in at] == list(offsets)


def test_user_defined_symbols_stay():
    mine = O.Normaliser(b"", (b"<x>", b"<x><y>"))
    spec = [v for k, v in O.fields(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf").serialized_model_proto()) if k == 3]
    fold = O.Normaliser(b"".join(spec), ("ＡＢ".encode(),))
    assert mine("a <x><y>")[0] == "▁a▁<x><y>"
    assert fold("ＡＢＡ")[0].endswith("ＡＢa")

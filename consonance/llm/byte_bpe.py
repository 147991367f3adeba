"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts are split by the tokenizer's pattern and every match is encoded on its
own, without special tokens. Long texts are cut first, at safe boundaries: a
match of the pattern never goes from a non-space character into white space,
and the pattern looks at nothing to its left, so a cut before a space or
newline that follows a non-space character leaves all matches as they are.
Pieces of about ``PIECE_CHARS`` characters bound the memory of the split; a run
without such a boundary stays whole. White space runs of ``RUN_CHARS`` characters
and more never reach the pattern, whose matcher has a bounded stack: the pattern
takes such a run as one match, but for its last character if a non-space
follows, so just this is encoded as one piece and the rest goes on from there.

Ids travel as packed little-endian unsigned 32-bit integers; decoding joins the
raw bytes of the ids, so it gives back the exact bytes even where a token ends
inside a character.

The rank file (under 1 MB) is read once on the driver and broadcast.

Defined cases: null or empty texts have no ids and decode to no bytes; every
row is encoded on its own, whatever its id (null and repeated ids included);
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, table

NAME = "op2_byte_bpe"
#: characters of a piece of a long text
PIECE_CHARS = 1 << 16
#: characters of a white space run that is cut by rule
RUN_CHARS = 1 << 16
# the White_Space property, which is what the pattern takes as \\s
_RUN = re.compile(f"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{RUN_CHARS},}}")

# not just "before white space": Python's \S excludes a few control characters that the pattern takes as non-space
_SAFE = re.compile(r"(?<=\S)[ \n]")


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a tiktoken rank file: one ``base64(token) rank`` per line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in pieces of at least ``size`` characters, cut at the next safe boundary only."""
    a = 0
    while len(text) - a > size:
        m = _SAFE.search(text, a + size)
        if m is None:
            break
        yield text[a:m.start()]
        a = m.start()
    yield text[a:]


def cuts(text: str, size: int = PIECE_CHARS) -> Iterator[tuple[str, bool]]:
    """``text`` in parts that can be encoded apart, and whether a part is (a run that is) one match of the pattern."""
    a = 0
    for m in _RUN.finditer(text) if len(text) >= RUN_CHARS else ():
        b = m.end() - (m.end() < len(text))
        for p in pieces(text[a:m.start()], size):
            yield p, False
        yield text[m.start():b], True
        a = b
    for p in pieces(text[a:], size):
        yield p, False


class Encoder:
    """Ids of whole texts by ranks: one encoding for the pattern, one for parts that are a single match."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str, size: int = PIECE_CHARS) -> np.ndarray:
        if len(text) <= min(size, RUN_CHARS):
            return self.ranks.encode_to_numpy(text, disallowed_special=())
        return np.concatenate([(self._whole if run else self.ranks).encode_to_numpy(p, disallowed_special=())
                               for p, run in cuts(text, size)])


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def _encoder(data: bytes, pattern: str) -> Encoder:
    """One encoder per Python worker."""
    key = (hash(data), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(parse_ranks(data), pattern)
    return _ENCODERS[key]


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           piece_chars: int = PIECE_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian uint32) of every whole text."""
    with open(rank_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value, pattern)
        for rb in batches:
            texts, n, packed = rb.column("text"), [], []
            for t in texts:
                ids = enc(t.as_py() or "", piece_chars).astype("<u4")
                n.append(len(ids))
                packed.append(ids.tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": rb.column("doc_id"), "n_tokens": pa.array(n, pa.int64()),
                                              "ids": pa.array(packed, pa.binary())})

    src = only(docs, [id_col, text_col], ["doc_id", "text"]).select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """The rows of ``encode`` with ``decoded``: the raw bytes of their ids."""
    with open(rank_file, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value, pattern).ranks
        for rb in batches:
            out = [enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) if x else x for x in rb.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(out, pa.binary())],
                                             names=[*rb.schema.names, "decoded"])

    e = encoded.select("doc_id", "n_tokens", "ids")
    return e.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every whole document, and back."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents")
    out = decode(encode(docs, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


SQL = None

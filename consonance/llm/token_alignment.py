"""Alignment of two tokenizations of the same bytes, and how often token pairs go together.

Per text, tokenizer A (a byte-level BPE, given a space and the text) and
tokenizer B (a SentencePiece model, which adds the space) are laid over the
bytes of space + text. Interval coalescing then works on whole batches of texts
at once, each text shifted behind the one before:

* all tokens of A and B are sorted by start (``lexsort``); the running maximum
  of their ends (``maximum.accumulate``) breaks them into groups wherever a
  start reaches it, that is, where tokens of both sides have ended;
* within the groups, each A token expands to the B tokens whose bytes it
  overlaps: the links.

The count of an id pair is the number of documents of the corpus that hold it
linked. Counting on a cluster:

1. Texts go through the tokenizers once. Each document keeps its distinct pairs
   and how often it uses them; every block of about ``BLOCK_BYTES`` of text adds
   one row with its distinct pairs and their numbers of documents (a written
   table). A pair that every document holds costs one entry per block.
2. The entries of the blocks are summed per pair; the highest count of each A id
   is a window over its pairs (at most the vocabulary of B).
3. The counts are joined back to the entries and meet the documents of their
   block, where each document adds up its links. Pairs are never exploded per
   document, and no group is larger than a block.

Defined cases: a text that is null or empty, or whose joined token bytes of A or
B are not space + text (a model that normalises, a text with U+2581), has no
tokens, groups or links; every row counts as a document of its own, whatever
its id (null and repeated ids included); other columns are ignored; an empty
table gives an empty result. Long texts are given to the tokenizers in pieces
cut where neither can join across.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import Encoder
from .common import only, table, written
from .piece_offsets import Pieces, parts, shared

NAME = "op11_token_alignment"
#: characters of text whose documents form a block
BLOCK_BYTES = 32 << 20
#: characters of text aligned at once (a worker holds some 100 bytes of arrays for each)
BATCH_BYTES = 1 << 18

_ALIGNED = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
            "pairs binary, uses binary, block_pairs array<long>, block_docs array<long>")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves, the other bytes, in order, for the characters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A: a ``tokenizers`` file with a byte-level vocabulary.

    Where the ids of the merged tokens follow the order of the merges, a merge by
    rank of the joined token is the merge of the file: if the ends of a token are
    token ends, no merge has crossed them, so what is between them was split as
    in training. Such files (checked on loading; no normaliser, the usual
    pattern) run in ``byte_bpe``'s encoder, which takes a third of the time; all
    others in their own library.
    """

    def __init__(self, data: bytes, pattern: str):
        spec, alphabet = json.loads(data), byte_alphabet()
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        entries = {i: bytes(alphabet[c] for c in t) for t, i in model["vocab"].items() if i not in added}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        ranked = merged == list(range(len(entries) - len(merged), len(entries))) and not spec["normalizer"] and usual
        self.encoder = self.tokenizer = None
        if ranked and all(t["special"] for t in spec["added_tokens"]):
            self.encoder = Encoder({w: i for i, w in entries.items()}, pattern)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per Spark task
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(data.decode())
            self.tokenizer.encode_special_tokens = True
        entries |= added
        self.bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]

    def ids(self, texts: list[str]) -> list[list[int]]:
        if self.encoder:
            return [self.encoder(t).tolist() for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class SpacePieces:
    """Tokenizer B: a SentencePiece model."""

    def __init__(self, data: bytes):
        self.pieces = Pieces(data)
        library = self.pieces.library
        self.bytes = [bytes([int(t[3:5], 16)]) if library.is_byte(i) else t.decode().replace("▁", " ").encode()
                      for i, t in enumerate(self.pieces.texts)]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [self.pieces.ids(t).tolist() for t in texts]


def coalesce(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray):
    """(group of each A token, group of each B token, A index and B index of each link).

    Both sides ascend and do not overlap themselves; tokens are not empty. Groups are numbered from 0, left to right.
    """
    starts, ends = np.concatenate([starts_a, starts_b]), np.concatenate([ends_a, ends_b])
    side = np.repeat([0, 1], [len(starts_a), len(starts_b)])
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order]) if len(order) else ends
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(np.concatenate([[False], starts[order][1:] >= reach[:-1]])[:len(order)])
    first = np.searchsorted(ends_b, starts_a, "right")
    n = np.maximum(np.searchsorted(starts_b, ends_a, "left") - first, 0)
    link_a = np.repeat(np.arange(len(starts_a)), n)
    link_b = np.arange(len(link_a)) + np.repeat(first - np.cumsum(n) + n, n)
    return group[:len(starts_a)], group[len(starts_a):], link_a, link_b


class Aligner:
    """Two tokenizers over batches of texts."""

    def __init__(self, a: bytes, b: bytes, pattern: str):
        self.a, self.b = ByteLevel(a, pattern), SpacePieces(b)
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t.bytes]) for t in (self.a, self.b))
        self.n_b = len(self.b.bytes)
        n = max(len(self.a.bytes), self.n_b)
        self._written = [f"{i}{sep}" for i in range(n) for sep in (",", "|", ";", "")]

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of each text; none where a side does not give back space + text."""
        given = [t or "" for t in texts]
        ids_a, ids_b = self.a.ids([" " + t for t in given]), self.b.ids(given)
        for k, t in enumerate(given):
            want = (" " + t).encode()
            if not t or any(b"".join(map(tok.bytes.__getitem__, ids[k])) != want
                            for tok, ids in ((self.a, ids_a), (self.b, ids_b))):
                ids_a[k], ids_b[k] = [], []
        return ids_a, ids_b

    def align(self, texts: list[str | None]) -> dict[str, list]:
        """Per text n_a, n_b, n_groups, n_links, groups, pairs (ascending) and uses."""
        lists = self.tokens(texts)
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in lists)
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in lists)
        end_a, end_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        group_a, group_b, link_a, link_b = coalesce(end_a - self.sizes_a[a], end_a, end_b - self.sizes_b[b], end_b)
        doc_a, doc_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)

        # written groups: A tokens, then B tokens of each group; what follows a token depends on the next one
        side, doc = np.repeat([0, 1], [len(a), len(b)]), np.concatenate([doc_a, doc_b])
        group = np.concatenate([group_a, group_b])
        seq = np.argsort(group, kind="stable")
        group, side, doc = group[seq], side[seq], doc[seq]
        follows = np.full(len(seq), 3)
        if len(seq):
            follows[:-1] = np.where(doc[1:] != doc[:-1], 3, np.where(group[1:] != group[:-1], 2, side[1:] - side[:-1]))
        words = list(map(self._written.__getitem__, (np.concatenate([a, b])[seq] * 4 + follows).tolist()))
        at = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        last = np.concatenate([[-1], group])[at]  # groups are numbered over the whole batch

        # the document in the high bits: distinct pairs of each document, and how often each occurs
        span = len(self.a.bytes) * self.n_b
        keys, uses = np.unique(doc_a[link_a] * span + a[link_a] * self.n_b + b[link_b], return_counts=True)
        cut = np.searchsorted(keys, np.arange(len(n_a) + 1) * span)
        keys %= span
        rows = range(len(n_a))
        return {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(last), "n_links": np.bincount(doc_a[link_a], minlength=len(n_a)),
                "groups": ["".join(words[at[k]:at[k + 1]]) for k in rows], "pairs": [keys[cut[k]:cut[k + 1]] for k in rows],
                "uses": [uses[cut[k]:cut[k + 1]] for k in rows]}


_LOADED: dict[tuple[int, int, str], Aligner] = {}


def loaded(a: bytes, b: bytes, pattern: str) -> Aligner:
    """One aligner per Python worker."""
    key = hash(a), hash(b), pattern
    if key not in _LOADED:
        _LOADED[key] = Aligner(a, b, pattern)
    return _LOADED[key]


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and the sums of their counts."""
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)


def slices(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int, list[str | None], int]]:
    """(first row, behind-last row, texts, characters) of runs of rows of ``limit`` characters at most (or one row).

    Only the texts of one run at a time are Python strings.
    """
    sizes = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
    for i, j in parts(sizes, limit):
        yield i, j, column.slice(i, j - i).to_pylist(), sum(sizes[i:j])


def aligned(docs: DataFrame, a_file: str, b_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document, and one row per block of documents (``block_pairs`` not null).

    Documents: n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``: ids of A and B, group by group),
    pairs (ascending distinct A id * vocabulary of B + B id) and uses (links of each), both packed
    little-endian 64-bit integers. Blocks: distinct pairs and the number of documents that hold each.
    """
    spark = docs.sparkSession
    a, b = shared(spark, a_file), shared(spark, b_file)
    none = pa.scalar(None, pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, block, size = loaded(a.value, b.value, pattern), TaskContext.get().partitionId() << 32, 0
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            k, n = _merged(keys, counts) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            keys.clear()
            counts.clear()
            row = {f: pa.nulls(1, t) for f, t in fields}
            row |= {"block": pa.array([block]), "block_pairs": pa.array([k], pa.list_(pa.int64())),
                    "block_docs": pa.array([n], pa.list_(pa.int64()))}
            return pa.RecordBatch.from_pydict(row)

        for rb in batches:
            for i, j, texts, chars in slices(rb.column("text")):
                got = al.align(texts)
                held = np.concatenate(got["pairs"])
                k, n = np.unique(held, return_counts=True)
                if len(keys) > 7:  # keep the parts of a block few
                    keys[:], counts[:] = ([x] for x in _merged(keys, counts))
                keys.append(k)
                counts.append(n)
                row = {"block": pa.array(np.full(j - i, block)), "doc_id": rb.column("doc_id").slice(i, j - i)}
                row |= {c: pa.array(got[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")}
                row |= {"groups": pa.array(got["groups"], pa.string())}
                row |= {c: pa.array([x.astype("<i8").tobytes() for x in got[c]], pa.binary()) for c in ("pairs", "uses")}
                row |= {c: pa.repeat(none, j - i) for c in ("block_pairs", "block_docs")}
                yield pa.RecordBatch.from_pydict(row)
                size += chars
                if size >= block_bytes:
                    yield close()
                    block, size = block + 1, 0
        if keys:
            yield close()

    longs, arrays = pa.int64(), pa.list_(pa.int64())
    fields = [("block", longs), ("doc_id", longs), ("n_a", longs), ("n_b", longs), ("n_groups", longs), ("n_links", longs),
              ("groups", pa.string()), ("pairs", pa.binary()), ("uses", pa.binary()), ("block_pairs", arrays), ("block_docs", arrays)]
    src = only(docs, [id_col, text_col], ["doc_id", "text"]).select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return src.mapInArrow(run, _ALIGNED)


def pair_counts(entries: DataFrame, n_b: int) -> DataFrame:
    """pair, count (documents of the corpus that hold it linked), best (whether no pair of its A id has a higher count)."""
    counts = entries.groupBy("pair").agg(F.sum("docs").alias("count"))
    of_a = Window.partitionBy(F.expr(f"pair div {n_b}"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(of_a))


def link_sums(rows: DataFrame, answers: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the documents with n_best and count_sum over their links, block by block."""

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known.column("pair").to_numpy())
        pair, count, best = (known.column(c).to_numpy()[order] for c in ("pair", "count", "best"))
        sums = {"n_best": [], "count_sum": []}
        for p, u in zip(docs.column("pairs"), docs.column("uses")):
            held, uses = np.frombuffer(p.as_py(), "<i8"), np.frombuffer(u.as_py(), "<i8")
            at = np.searchsorted(pair, held)
            sums["n_best"].append(int(uses[best[at].astype(bool)].sum()))
            sums["count_sum"].append(int((uses * count[at]).sum()))
        out = {c: docs.column(c) for c in columns} | {c: pa.array(v, pa.int64()) for c, v in sums.items()}
        return pa.table(out)

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*columns).schema),
                        "n_best long, count_sum long"])
    known = answers.select(F.col("block").alias("of_block"), "pair", "count", "best")  # a column of its own: both sides come from one table
    return rows.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document, weighed by the pair counts of the whole corpus."""
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    with open(b, "rb") as f:
        n_b = len(Pieces(f.read()).texts)
    t = aligned(table(spark, sf_dir, "documents"), a, b, public_tokenizers.PATTERN)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups"), 256))
    t = written(t.withColumn("groups_sha256", digest).drop("groups"), "token-alignment")
    entries = t.where("block_pairs is not null").select(
        "block", F.explode(F.arrays_zip("block_pairs", "block_docs")).alias("e")).select(
        "block", F.col("e.block_pairs").alias("pair"), F.col("e.block_docs").alias("docs"))
    answers = entries.select("block", "pair").join(pair_counts(entries, n_b), "pair")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = t.where("block_pairs is null").select("block", "pairs", "uses", *columns)
    return link_sums(rows, answers, columns).select(*columns[:-1], "n_best", "count_sum", "groups_sha256")


SQL = None

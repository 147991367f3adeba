"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A window is ``window`` consecutive words (``[^\\x20\\x09-\\x0D]+``, unchanged)
of one document. A window is repeated if its word sequence also starts in a
document with a smaller id; every word covered by a repeated window goes, and
overlapping or touching windows merge into maximal removal intervals. All
windows are judged on the input.

How it runs on a cluster:

1. Documents are packed into blocks of a few MB (a written table).
2. Each block hashes all its windows with a rolling hash and sends, per hash
   bucket, every *distinct* hash with the smallest document of the block that
   holds it. A passage that a third of all documents share costs one entry per
   block, not one per document, so no hash can grow into a hot key.
3. One task per bucket finds the smallest document of each hash and answers
   each block with one bit per hash it sent: "an earlier document elsewhere".
   Buckets hold about ``BUCKET_WINDOWS`` entries at any input size.
4. The bits are joined back to their block, which recomputes its hashes and
   cuts its texts. Texts are never shuffled by hash or by window.

Equality of two windows is equality of their 64-bit rolling hash and of the
bucket, which comes from a second, independent rolling hash: 64 + log2(number
of buckets) bits, and the number of buckets grows with the input.

Defined cases: null or empty texts have no words and give an empty kept text;
documents shorter than a window lose nothing; rows with equal ids do not count
against each other (only a *smaller* id does); a row with a null id neither
loses words nor makes others lose them; other columns of the input are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordkit as W
from .common import n_shuffle, only, table, written

NAME = "op10_substring_dedup"
WINDOW = 13
#: bytes of text in a block (a longer document is a block of its own)
BLOCK_BYTES = 4 << 20
#: aimed-at entries of a hash bucket
BUCKET_WINDOWS = 1 << 20

_BLOCK = "block long, n_words long, ids binary, no_id binary, ends binary, texts binary"
_RESULT = ("doc_id long, n_words long, n_removed long, kept_text string, "
           "intervals array<struct<first:int,last:int>>")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, seq = TaskContext.get().partitionId(), 0
    z = zstandard.ZstdCompressor(level=1)
    for rb in batches:
        ids = rb.column("doc_id")
        null = np.asarray(ids.is_null())
        ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        for a, b, part, ends in W.text_slices(rb.column("text"), BLOCK_BYTES):
            n = len(W.split_words(part, ends).start) if len(part) < W.SLICE_BYTES else sum(
                len(W.split_words(p, e).start) for p, e in _parts(part, ends))
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([(task << 32) + seq], pa.int64()), "n_words": pa.array([n], pa.int64()),
                "ids": [ids[a:b].tobytes()], "no_id": [np.packbits(null[a:b]).tobytes()],
                "ends": [ends.tobytes()], "texts": [z.compress(part.tobytes())]})
            seq += 1


def _parts(part: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of whole documents of about one slice each."""
    a, n = 0, len(ends) - 1
    while a < n:
        b = max(int(np.searchsorted(ends, ends[a] + W.SLICE_BYTES, "right")) - 1, a + 1)
        yield part[ends[a]:ends[b]], ends[a:b + 1] - ends[a]
        a = b


class _Block:
    """A block's windows: hash, bucket and document, and its distinct hashes in sending order."""

    def __init__(self, row: dict, window: int, n_buckets: int):
        self.ends = np.frombuffer(row["ends"], np.int64)
        self.ids = np.frombuffer(row["ids"], np.int64)
        n = len(self.ids)
        self.no_id = np.unpackbits(np.frombuffer(row["no_id"], np.uint8), count=n).astype(bool)
        self.texts = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["texts"]), np.uint8)
        fp, bucket, doc = [], [], []
        first = 0
        for part, ends in _parts(self.texts, self.ends):
            w = W.split_words(part, ends)
            h = W.word_hashes(w)
            a, d, at = W.shingles(w, h, window)
            second = W.rolling(h, window, 1)[at]
            fp.append(a)
            bucket.append((second % np.uint64(n_buckets)).astype(np.int32))
            doc.append((d + first).astype(np.int32))
            first += len(ends) - 1
        fp, bucket, doc = (np.concatenate(x) if x else np.zeros(0, t)
                           for x, t in ((fp, np.uint64), (bucket, np.int32), (doc, np.int32)))
        self.fp, self.doc = fp, doc
        # documents by rank of their id: ties (equal ids) share a rank
        self.rank_ids, rank = np.unique(self.ids, return_inverse=True)
        own = rank.astype(np.int32)[doc]
        live = np.flatnonzero(~self.no_id[doc]) if self.no_id.any() else np.arange(len(fp))
        # distinct (bucket, hash) with the smallest rank, bucket by bucket, in order of rank
        order = live[np.lexsort((own[live], fp[live], bucket[live]))]
        b, f = bucket[order], fp[order]
        head = np.ones(len(order), bool)
        head[1:] = (f[1:] != f[:-1]) | (b[1:] != b[:-1])
        heads = order[head]
        send = np.lexsort((fp[heads], own[heads], bucket[heads]))
        self.send = heads[send]
        self.send_bucket = bucket[self.send]
        self.send_rank = own[self.send]
        # of each window: its place in the sending order, and whether an earlier document of the block has it
        place = np.empty(len(heads), np.int64)
        place[send] = np.arange(len(heads))
        self.place = np.full(len(fp), -1, np.int64)
        self.place[order] = place[np.cumsum(head) - 1]
        self.later = np.zeros(len(fp), bool)
        self.later[order] = own[order] > own[heads][np.cumsum(head) - 1]


def _sender(window: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for rb in batches:
            for row in rb.to_pylist():
                x = _Block(row, window, n_buckets)
                cut = np.flatnonzero(np.diff(x.send_bucket, prepend=-1))
                cuts = np.append(cut, len(x.send))
                ids = x.rank_ids[x.send_rank]
                fps = x.fp[x.send]
                if not len(cut):
                    continue
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(x.send_bucket[cut], pa.int32()),
                    "block": pa.array([row["block"]] * len(cut), pa.int64()),
                    "fps": pa.array([fps[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    "ids": pa.array([z.compress(np.diff(ids[a:b], prepend=0).tobytes())
                                     for a, b in zip(cuts, cuts[1:])], pa.binary())})
    return run


def _judge(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: which hashes of each block also occur in a smaller document of another block."""
    z = zstandard.ZstdDecompressor()
    fps = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["fps"]])
    ids = np.concatenate([np.cumsum(np.frombuffer(z.decompress(x), np.int64)) for x in pdf["ids"]])
    order = np.lexsort((ids, fps))
    f = fps[order]
    head = np.ones(len(f), bool)
    head[1:] = f[1:] != f[:-1]
    least = ids[order[head]][np.cumsum(head) - 1]
    hit = np.empty(len(f), bool)
    hit[order] = least < ids[order]
    sizes = np.array([len(x) // 8 for x in pdf["fps"]])
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    some = [i for i in range(len(sizes)) if hit[cuts[i]:cuts[i + 1]].any()]
    return pd.DataFrame({"block": pdf["block"].to_numpy()[some], "bucket": pdf["bucket"].to_numpy()[some],
                         "bits": [np.packbits(hit[cuts[i]:cuts[i + 1]]).tobytes() for i in some]})


def _cutter(window: int, n_buckets: int, schema: pa.Schema):
    def cut(row: dict) -> pa.RecordBatch:
        x = _Block(row, window, n_buckets)
        hit = np.zeros(len(x.send) + 1, bool)   # the last entry is for windows that were not sent
        lo = np.searchsorted(x.send_bucket, np.arange(n_buckets), "left")
        hi = np.searchsorted(x.send_bucket, np.arange(n_buckets), "right")
        for e in row["answers"] or []:
            a, b = lo[e["bucket"]], hi[e["bucket"]]
            hit[a:b] = np.unpackbits(np.frombuffer(e["bits"], np.uint8), count=b - a)
        remove = (x.later | hit[x.place]) if len(x.place) else np.zeros(0, bool)
        n_words, n_removed, kept, spans = [], [], [], []
        seen = 0
        for part, ends in _parts(x.texts, x.ends):
            w = W.split_words(part, ends)
            n = len(w.start)
            inside = w.doc[:max(n - window + 1, 0)] == w.doc[window - 1:] if n >= window else np.zeros(0, bool)
            at = np.flatnonzero(inside)
            flags = remove[seen:seen + len(at)]
            seen += len(at)
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, at[flags], 1)
            np.add.at(cover, at[flags] + window, -1)
            gone = np.cumsum(cover[:n]) > 0
            # bytes of the kept words, each with one space behind it
            keep = np.flatnonzero(~gone)
            w.buf[w.end[keep]] = 0x20
            edge = np.zeros(len(w.buf) + 1, np.int8)
            edge[w.start[keep]] += 1
            np.add.at(edge, w.end[keep] + 1, -1)
            out = w.buf[np.cumsum(edge[:-1], dtype=np.int8) > 0]
            size = np.bincount(w.doc[keep], weights=w.end[keep] + 1 - w.start[keep], minlength=w.n_docs)
            cuts = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            cnt = w.counts()
            n_words += cnt.tolist()
            n_removed += (cnt - np.bincount(w.doc[keep], minlength=w.n_docs)).tolist()
            blob = out.tobytes()
            kept += [blob[a:max(b - 1, a)].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
            base = np.concatenate([[0], np.cumsum(cnt)])
            mine = [[] for _ in range(w.n_docs)]
            step = np.flatnonzero(gone & np.concatenate([[True], ~gone[:-1] | (w.doc[1:] != w.doc[:-1])])) if n else []
            stop = np.flatnonzero(gone & np.concatenate([~gone[1:] | (w.doc[1:] != w.doc[:-1]), [True]])) if n else []
            for s, e in zip(step, stop):
                d = w.doc[s]
                mine[d].append({"first": int(s - base[d]), "last": int(e - base[d])})
            spans += mine
        ids = pa.array(x.ids, pa.int64(), mask=x.no_id)
        return pa.RecordBatch.from_arrays([
            ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()),
            pa.array(spans, schema.field("intervals").type)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for row in rb.to_pylist():
                yield cut(row)
    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space), intervals (of word numbers, both ends in)."""
    spark = docs.sparkSession
    src = only(docs, [id_col, text_col], ["doc_id", "text"]).select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"))
    blocks = written(src.mapInArrow(_pack, _BLOCK), "substring-blocks")
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    n_buckets = max(n_shuffle(spark), -(-total // BUCKET_WINDOWS), 1)
    sent = blocks.mapInArrow(_sender(window, n_buckets), "bucket int, block long, fps binary, ids binary")
    answers = sent.groupBy("bucket").applyInPandas(_judge, "block long, bucket int, bits binary")
    answers = answers.groupBy(F.col("block").alias("answered")).agg(
        F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    both = blocks.join(answers, F.col("block") == F.col("answered"), "left").drop("answered")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("kept_text", pa.string()),
                        ("intervals", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])
    return both.mapInArrow(_cutter(window, n_buckets, schema), _RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring dedup of every whole document with 13-word windows."""
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM w)),
least_doc AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
hit AS (SELECT doc_id, i FROM win JOIN least_doc USING (s) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM hit)),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.j) AS t, count(*) AS n
         FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.j = gone.j
         WHERE gone.j IS NULL GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

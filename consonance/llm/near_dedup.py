"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

A document's set holds the hashes of its distinct ``shingle``-word shingles
(A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``); with fewer words the whole
sequence is its one shingle. Two documents are linked when their Jaccard
similarity is at least ``percent`` / 100, decided in integers on the full sets;
the result is the connected components of the links.

1. One pass hashes each text into its set, a 128-bit digest of the set, and 50
   band keys of 5 SuperMinHash values each. A pair at 0.75 shares no band with
   probability 1.3e-6.
2. Documents with equal sets form one class, named after one of its rows; only
   that row goes on, so thousands of exact copies cost one row. Classes that
   share a document id are linked.
3. Links between classes come from ``banding``: star rounds that join large
   groups of near copies without their pairs, then every pair in a bucket whose
   components still differ.

Verification joins the two texts and compares whole sets; texts of candidates
only are shuffled. Equality of shingles is equality of 64-bit hashes.

Defined cases: null, empty or blank texts have an empty set and are linked with
nothing (component_id = own id, kept); a null id is linked with nothing, its
component_id is null and it is kept; rows with equal ids are one vertex; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import banding
from . import superminhash as S
from . import wordkit as W
from .common import only, table, written
from .components import components

NAME = "op5_near_dedup"
SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 50, 5

_SIGNED = "doc_id long, text_hash long, n_shingles long, k1 long, k2 long, bands array<long>"


def _signer(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ids = rb.column("doc_id")
            for a, b, part, ends in W.text_slices(rb.column("text")):
                n = b - a
                h, doc = W.word_shingle_sets(part, ends, shingle)
                count = np.bincount(doc, minlength=n)
                cuts = np.concatenate([[0], np.cumsum(count)])
                digest = [xxhash.xxh3_128_digest(h[s:e].tobytes()) for s, e in zip(cuts, cuts[1:])]
                k = np.frombuffer(b"".join(digest), np.int64).reshape(n, 2)
                keys = S.band_keys(S.signatures(h, doc, n, BANDS * ROWS), BANDS).view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS), pa.int32()),
                                                 pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids.slice(a, n), "text_hash": rb.column("text_hash").slice(a, n), "n_shingles": pa.array(count, pa.int64()),
                    "k1": pa.array(k[:, 0].copy()), "k2": pa.array(k[:, 1].copy()), "bands": bands})
    return run


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    for rb in batches:
        texts = [z.compress((t or "").encode()) for t in rb.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict({"id": rb.column("id"), "z": pa.array(texts, pa.binary())})


def _verifier(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        last = (None, None)

        def sets(blobs: list[bytes]) -> list[np.ndarray]:
            raw = [z.decompress(x) for x in blobs]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
            h, doc = W.word_shingle_sets(np.frombuffer(b"".join(raw), np.uint8), ends, shingle)
            cuts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(raw)))])
            return [h[s:e] for s, e in zip(cuts, cuts[1:])]

        for rb in batches:
            us, vs = rb.column("u").to_pylist(), rb.column("v").to_pylist()
            zu, zv = rb.column("zu"), rb.column("zv")
            good = []
            for a in range(0, len(us), 256):
                mine = sets([zu[i].as_py() for i in range(a, min(a + 256, len(us)))])
                for i, x in zip(range(a, a + len(mine)), mine):
                    blob = zv[i].as_py()
                    if last[0] != blob:
                        last = (blob, sets([blob])[0])
                    y = last[1]
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or not len(x):
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        good.append(i)
            yield pa.RecordBatch.from_pydict({"u": pa.array([us[i] for i in good], pa.int64()),
                                              "v": pa.array([vs[i] for i in good], pa.int64())})
    return run


def _linked(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose full sets are similar enough."""
    a = texts.select(F.col("id").alias("u"), F.col("z").alias("zu"))
    b = texts.select(F.col("id").alias("v"), F.col("z").alias("zv"))
    return pairs.select("u", "v").join(a, "u").join(b, "v").mapInArrow(_verifier(shingle, percent), "u long, v long")


def _lister(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for rb in batches:
            for i, blob in zip(rb.column("id").to_pylist(), rb.column("z").to_pylist()):
                raw = z.decompress(blob)
                h, _ = W.word_shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), shingle)
                yield pa.RecordBatch.from_pydict({"id": pa.array(np.full(len(h), i), pa.int64()),
                                                  "e": pa.array(h.view(np.int64))})
    return run


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    src = only(docs, [id_col, text_col], ["doc_id", "text"]).select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = written(src.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_signer(shingle), _SIGNED).withColumn(
        "row", F.monotonically_increasing_id()), "near-signed")
    sets = signed.where("n_shingles > 0 and doc_id is not null")

    # classes of equal sets, each with one row that stands for it; its number is the vertex of the class
    classes = written(sets.groupBy("k1", "k2").agg(F.min("row").alias("id"), F.min("doc_id").alias("low")), "near-classes")
    reps = written(sets.join(classes.select(F.col("id").alias("row")), "row", "left_semi").select(
        F.col("row").alias("id"), F.col("n_shingles").alias("n"), "bands", "doc_id", "text_hash"), "near-reps")

    busy = written(banding.buckets(reps), "near-buckets")
    wanted = reps.join(busy.select("id").distinct(), "id", "left_semi").select("id", "doc_id", "text_hash")
    # rows equal in id and text are one text
    texts = src.withColumn("text_hash", F.xxhash64("text")).join(wanted, ["doc_id", "text_hash"])
    texts = written(texts.dropDuplicates(["doc_id", "text_hash"]).select("id", "text").mapInArrow(_squeeze, "id long, z binary"),
                    "near-texts")
    links = banding.links(
        busy, lambda pairs: _linked(pairs, texts, shingle, percent),
        lambda ids: texts.join(ids, "id", "left_semi").mapInArrow(_lister(shingle), "id long, e long").distinct(), percent)

    # rows with equal ids and different sets link their classes
    shared = sets.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("a"), F.max(F.struct("k1", "k2")).alias("b")).where("a <> b")
    same = sets.join(shared.select("doc_id"), "doc_id", "left_semi").select("doc_id", "k1", "k2").distinct()
    same = written(same.join(classes, ["k1", "k2"]).select("doc_id", "id"), "near-shared-ids")
    same = same.join(same.groupBy("doc_id").agg(F.min("id").alias("v")), "doc_id").select(F.col("id").alias("u"), "v")
    labels = components(links.union(same))
    named = classes.join(labels, F.col("id") == F.col("vertex"), "left").withColumn("comp", F.coalesce("component", "id"))
    least = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    of_class = named.select("k1", "k2", "comp").join(least, "comp").select("k1", "k2", "component_id")
    # rows with a set, rows without one (they share the component of rows with their id), rows without id
    slim = signed.select("doc_id", "n_shingles", "k1", "k2")
    out = slim.where("n_shingles > 0 and doc_id is not null").join(of_class, ["k1", "k2"]).select(
        "doc_id", "n_shingles", "component_id")
    bare = slim.where("n_shingles = 0 and doc_id is not null").select("doc_id", "n_shingles")
    known = out.join(bare.select("doc_id"), "doc_id", "left_semi").select("doc_id", "component_id").distinct()
    bare = bare.join(known, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    none = slim.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(bare).unionByName(none).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of every whole document."""
    return near_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
       'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS v, doc_id AS c FROM w UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.v),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN m ON m.v = w.doc_id
"""

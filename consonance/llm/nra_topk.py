"""Exact top-k inner products by no-random-access aggregation over sorted lists.

A block of vectors has one sorted list per dimension. For a query the lists are
read step by step, from the end that contributes most (``q_d * x_d`` falling).
The bounds of a vector are what was read of it, and for every list that has not
shown it the last value read (upper bound) or the least value of the list
(lower bound). The floor is the k-th best lower bound, or the k-th best score of
earlier blocks. Reading goes on until at most ``RESOLVE`` vectors have an upper
bound that reaches the floor, or the lists end; only then, and only of these,
are scores resolved exactly. Ties go to the smaller vec_id, so bounds are
compared strictly, and widened by the rounding error of their sums.

How it runs: queries and vectors are packed into blocks; every query block
meets every vector block through a join on a shard number, in blocks, and
returns at most k rows per query and block; the best k of those are taken per
query with a group limit before the shuffle. A task carries the k-th best score
of a query block from one vector block to the next, which only makes later
blocks stop sooner.

Defined cases: vectors that are null or hold null or non-finite components take
no part, neither do rows without id or empty vectors; a query is compared with
vectors of its own length, and never with rows of its own id; rows with equal
ids are separate candidates; an all-zero query scores 0 everywhere; extra
columns are ignored; an empty table gives an empty result. Scores are 64-bit
integers, exact over that whole range; scores and components beyond it count as
its nearest end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_shuffle, only, table, written

NAME = "op9_nra_topk"
K = 5
BLOCK = 4096
QUERY_BLOCK = 512
#: reading goes on while more vectors than this could still qualify
RESOLVE = 512
#: the first step reads this many halvings of each list, each later one doubles what was read
HALVINGS = 5
#: queries that read the lists together
AT_ONCE = 64
#: query blocks whose k-th best scores a task remembers
REMEMBERED = 256
_END = 2.0 ** 63


def _packer(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        held: dict[int, list] = {}

        def row(dim: int) -> pa.RecordBatch:
            ids, vectors = zip(*held.pop(dim))
            return pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()), "ids": [np.array(ids, np.int64).tobytes()],
                "vectors": [z.compress(np.stack(vectors).tobytes())]})

        for rb in batches:
            col = rb.column("vector")
            flat, off = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(col.offsets)
            off = off - off[0]
            for i, key in enumerate(rb.column("id").to_pylist()):
                dim = int(off[i + 1] - off[i])
                mine = held.setdefault(dim, [])
                mine.append((key, flat[off[i]:off[i + 1]]))
                if len(mine) == size:
                    yield row(dim)
        for dim in list(held):
            yield row(dim)
    return run


class Lists:
    """The sorted lists of one block: one per dimension, read from its upper or its lower end."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.real = x.astype(np.float64)    # the bounds allow for the rounding
        order = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(self.real, order, axis=0)
        self.place = np.empty(x.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(len(x), dtype=np.int32)[:, None], axis=0)
        self.largest = np.abs(self.real).max(axis=0)
        self.resolved = self.read = 0       # vectors resolved, and places of each list read, over all queries

    def top(self, queries: np.ndarray, own: np.ndarray, k: int, floors: list[int | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(vec_id, score) of the best k, best first, per query; ``floors``: k other rows are known to score at least this.

        The queries read the lists in step; each leaves as soon as few vectors are left for it.
        """
        n, out = len(self.ids), [None] * len(queries)
        q = queries.astype(np.float64)
        up, down = np.maximum(q, 0).T, np.minimum(q, 0).T    # large values help a positive q_d, small ones a negative q_d
        slack = (q.shape[1] + 8) * 2.0 ** -50 * (np.abs(q) @ self.largest)
        known = np.array([-np.inf if f is None else float(f) for f in floors]) - slack
        going, low, high = np.arange(len(queries)), self.values[0], self.values[-1]
        for depth in sorted({max(1, n >> s) for s in range(HALVINGS, -1, -1)}):
            # a vector that no list has shown has this upper bound; while it reaches the floor, reading goes on
            last_up, last_down = self.values[n - depth], self.values[depth - 1]
            front = last_up @ up[:, going] + last_down @ down[:, going]
            ask = going[(front + slack[going] < known[going]) | (known[going] == -np.inf) | (depth == n)]
            if not len(ask):
                continue
            seen_up, seen_down = self.place >= n - depth, self.place < depth
            u, d = up[:, ask], down[:, ask]
            # of a list that has not shown a vector: the last value read, or the least that it can add
            upper = np.where(seen_up, self.real, last_up) @ u + np.where(seen_down, self.real, last_down) @ d
            lower = np.where(seen_up, self.real, low) @ u + np.where(seen_down, self.real, high) @ d
            for j in np.flatnonzero(np.isin(own[ask], self.ids)):
                mine = self.ids == own[ask[j]]
                upper[mine, j] = lower[mine, j] = -np.inf
            if n >= k:
                known[ask] = np.maximum(known[ask], np.partition(lower, n - k, axis=0)[n - k] - slack[ask])
            known = np.where(known < -_END, -np.inf, np.minimum(known, _END * (1 - 1e-9)))   # scores end there
            left = (upper + slack[ask] >= known[ask]) & (upper > -np.inf)
            done = left.sum(axis=0) <= RESOLVE if depth < n else np.ones(len(ask), bool)
            for j in np.flatnonzero(done):
                at = np.flatnonzero(left[:, j])
                out[ask[j]] = self._resolve(at, queries[ask[j]], k)
                self.resolved += len(at)
                self.read += depth
            going = np.setdiff1d(going, ask[done])
        return out

    def _resolve(self, at: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        x = self.x[at]
        if float((np.abs(q.astype(np.float64)) * self.largest).sum()) < 2.0 ** 62:
            score = x @ q
            best = np.lexsort((self.ids[at], -score))[:k]
            return self.ids[at][best], score[best]
        exact = [min(max(s, -(1 << 63)), (1 << 63) - 1) for s in x.astype(object) @ q.astype(object)]
        best = sorted(range(len(at)), key=lambda i: (-exact[i], self.ids[at[i]]))[:k]
        return self.ids[at[best]], np.array([exact[i] for i in best], np.int64)


def _read(blob_ids: bytes, blob: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(blob_ids, np.int64), np.frombuffer(zstandard.ZstdDecompressor().decompress(blob),
                                                           np.int64).reshape(-1, dim)


def _matcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[tuple, list] = {}
        last = (None, None)
        for rb in batches:
            for r in rb.to_pylist():
                if last[0] != r["vectors"]:
                    last = (r["vectors"], Lists(*_read(r["ids"], r["vectors"], r["dim"])))
                q_ids, qs = _read(r["q_ids"], r["q_vectors"], r["dim"])
                if r["q_block"] not in floors and len(floors) == REMEMBERED:
                    floors.pop(next(iter(floors)))
                known = floors.setdefault(r["q_block"], [None] * len(q_ids))
                out = [[], [], []]
                for a in range(0, len(q_ids), AT_ONCE):
                    part = slice(a, a + AT_ONCE)
                    for i, (ids, scores) in enumerate(last[1].top(qs[part], q_ids[part], k, known[part]), a):
                        if len(ids) == k:
                            known[i] = int(scores[-1]) if known[i] is None else max(known[i], int(scores[-1]))
                        out[0].append(np.full(len(ids), q_ids[i]))
                        out[1].append(ids)
                        out[2].append(scores)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out],
                                                 names=["query_id", "vec_id", "score"])
    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K, id_col: str = "vec_id",
          vector_col: str = "vector") -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of every query over all vectors (arrays of longs)."""
    spark = vectors.sparkSession
    blocks = {}
    for name, df, size in (("queries", queries, QUERY_BLOCK), ("vectors", vectors, BLOCK)):
        src = only(df, [id_col, vector_col], ["id", "vector"]).where(
            "id is not null and vector is not null and size(vector) > 0 and not exists(vector, x -> x is null)")
        src = src.select(F.col("id").cast("long"), F.col("vector").cast("array<long>"))
        packed = src.mapInArrow(_packer(size), "dim int, ids binary, vectors binary")
        blocks[name] = written(packed.withColumn("block", F.monotonically_increasing_id()), f"nra-{name}")
    shards = max(1, min(blocks["vectors"].count(), 4 * n_shuffle(spark)))
    v = blocks["vectors"].withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int"))
    q = blocks["queries"].select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"),
                                 F.col("vectors").alias("q_vectors"),
                                 F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    met = v.join(q, ["shard", "dim"]).select("dim", "ids", "vectors", "q_block", "q_ids", "q_vectors")
    found = met.mapInArrow(_matcher(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def quantised(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, vector with floor(scale * x) for every component x; rows with null or non-finite components go."""
    e = only(embeddings, [id_col, vector_col], ["vec_id", "e"]).select("vec_id", F.col("e").cast("array<double>").alias("e"))
    e = e.where("e is not null and not exists(e, x -> x is null or isnan(x) or abs(x) = double('Infinity'))")
    return e.select("vec_id", F.expr(f"transform(e, x -> cast(floor({scale} * x) as bigint))").alias("vector"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best vectors of every 50th row over all embeddings."""
    v = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(v.where("vec_id % 50 = 0"), v)


SQL = r"""
WITH v AS (SELECT vec_id, embedding, len(embedding) AS dim FROM embeddings WHERE embedding IS NOT NULL),
e AS (SELECT vec_id, dim, unnest(range(1, dim + 1)) AS d, floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS x FROM v),
bad AS (SELECT DISTINCT vec_id FROM e WHERE x IS NULL OR NOT isfinite(x)),
f AS (SELECT vec_id, dim, d, CAST(x AS BIGINT) AS x FROM e WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM f q JOIN f c ON q.d = c.d AND q.dim = c.dim AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
        vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

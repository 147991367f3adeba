"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise
term is computed in linear time as
1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].

Features of a whole text: its lower-cased (A-Z) words hashed into ``BUCKETS``
with weights log(1 + count), scaled to unit length; shares of symbols, capitals, digits, repeated words
and the like, standardised on the training rows; and metadata columns (by default n_chars)
as log(1 + value). Language, source, id and labels are never inputs.

Training takes a bounded sample (``TRAIN_ROWS`` labelled rows, the first by a
hash of their id) whose features are computed on the executors; the fit is a
few seconds of numpy on the driver with a fixed seed. Scoring is one pass over
all texts with the model (a few MB of fixed size) broadcast.

Defined cases: null or empty texts have no words and zero statistics and get
the score of that; null or non-numeric metadata counts as 0; rows with null id can be scored
but not learned from; contradictory labels of one id are not learned from; with
no labelled rows, or of one class only, every score is the smoothed share of
label 1; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordkit as W
from .common import only, table

NAME = "op4_fm_quality"
#: labelled rows learned from, at most
TRAIN_ROWS = 6000
BUCKETS = 1 << 15
FACTORS = 8
EPOCHS = 8
#: steps at least, so a small sample is gone through more often
MIN_STEPS = 240
BATCH = 256
RATE = 0.05
DECAY = 1e-4
SEED = 20
THRESHOLD = 0.3

STATISTICS = ("log_words", "word_bytes", "capitals", "digits", "symbols", "marks", "other_bytes", "lines_a_word",
              "distinct_words", "top_word", "same_as_previous", "repeated_shingles")
_SYMBOLS = b"#*$%&|<>"
_MARKS = b"!?"


def _share(flags: np.ndarray, ends: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[ends[1:]] - total[ends[:-1]]) / size


def features(part: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, weight) of the hashed words, by document, and the (documents, statistics) matrix."""
    n = len(ends) - 1
    w = W.split_words(part, ends, lower=True)
    h = W.word_hashes(w)
    count = w.counts().astype(np.float64)
    some = np.maximum(count, 1)
    key = w.doc.astype(np.uint64) * np.uint64(BUCKETS) + h % np.uint64(BUCKETS)
    pair, times = np.unique(key, return_counts=True)
    doc, bucket = (pair // np.uint64(BUCKETS)).astype(np.int64), (pair % np.uint64(BUCKETS)).astype(np.int64)
    x = np.log1p(times)
    norm = np.sqrt(np.bincount(doc, weights=x * x, minlength=n))
    x = x / np.maximum(norm, 1e-9)[doc]
    size = np.maximum(np.diff(ends), 1)
    top = np.zeros(n)
    np.maximum.at(top, doc, times)
    same = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    s, sd, _ = W.shingles(w, h, 5)
    n_s = np.bincount(sd, minlength=n)
    n_d = np.bincount(W.distinct_sets(s, sd)[1], minlength=n)
    is_in = [np.isin(part, np.frombuffer(b, np.uint8)) for b in (_SYMBOLS, _MARKS)]
    stats = np.stack([
        np.log1p(count), np.bincount(w.doc, weights=w.end - w.start, minlength=n) / some,
        _share((part >= 65) & (part <= 90), ends, size), _share((part >= 48) & (part <= 57), ends, size),
        _share(is_in[0], ends, size), _share(is_in[1], ends, size), _share(part >= 128, ends, size),
        _share(part == 10, ends, np.maximum(count, 1)), np.bincount(doc, minlength=n) / some, top / some,
        np.bincount(w.doc[1:][same], minlength=n) / some, (n_s - n_d) / np.maximum(n_s, 1)], axis=1)
    return doc, bucket, x, stats


@dataclass
class Machine:
    """A fitted machine; feature numbers are word buckets, then statistics and metadata."""
    bias: float
    w: np.ndarray          # (features,)
    v: np.ndarray          # (features, factors)
    mean: np.ndarray
    scale: np.ndarray

    def rows(self, doc, bucket, x, dense):
        """Sparse rows with the standardised dense part appended, by document."""
        n, d = dense.shape
        z = np.clip((dense - self.mean) / self.scale, -4, 4) / 2
        doc = np.concatenate([doc, np.repeat(np.arange(n), d)])
        at = np.concatenate([bucket, np.tile(BUCKETS + np.arange(d), n)])
        x = np.concatenate([x, z.ravel()])
        order = np.argsort(doc, kind="stable")
        return doc[order], at[order], x[order]

    def margin(self, doc, at, x, n):
        """(margin, factor sums) per document by the sum-of-squares identity; every document has a dense row."""
        first = np.searchsorted(doc, np.arange(n))
        vx = self.v[at] * x[:, None]
        sums = np.add.reduceat(vx, first, axis=0)
        squares = np.add.reduceat(vx * vx, first, axis=0)
        linear = np.add.reduceat(self.w[at] * x, first)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def score(self, part, ends, meta):
        doc, bucket, x, stats = features(part, ends)
        if len(self.w) == 0:
            return np.full(len(ends) - 1, self.bias)
        m, _ = self.margin(*self.rows(doc, bucket, x, np.hstack([stats, meta])), len(ends) - 1)
        return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def fit(samples: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, factors: int = FACTORS,
        epochs: int = EPOCHS) -> Machine:
    """Logistic loss by Adagrad over (bucket, weight, dense) samples in a fixed random order."""
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        none = np.zeros(0)
        return Machine((y.sum() + 0.5) / (len(y) + 1), none, none.reshape(0, 0), none, none)
    dense = np.stack([s[2] for s in samples])
    rng = np.random.default_rng(SEED)
    d = dense.shape[1]
    m = Machine(float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), np.zeros(BUCKETS + d),
                rng.normal(0, 0.05, (BUCKETS + d, factors)), dense.mean(axis=0), dense.std(axis=0) + 1e-6)
    gw, gv, gb = np.full(len(m.w), 1e-2), np.full(m.v.shape, 1e-2), 1e-2
    batches = -(-len(y) // BATCH)
    for _ in range(max(epochs, -(-MIN_STEPS // batches))):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            pick = order[a:a + BATCH]
            doc = np.repeat(np.arange(len(pick)), [len(samples[i][0]) for i in pick])
            doc, at, x = m.rows(doc, np.concatenate([samples[i][0] for i in pick]),
                                np.concatenate([samples[i][1] for i in pick]), dense[pick])
            margin, sums = m.margin(doc, at, x, len(pick))
            g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[pick]) / len(pick) ** 0.5
            used, inv = np.unique(at, return_inverse=True)
            step = g[doc] * x
            dw = np.bincount(inv, weights=step, minlength=len(used)) + DECAY * m.w[used]
            inner = step[:, None] * (sums[doc] - m.v[at] * x[:, None])
            dv = np.stack([np.bincount(inv, weights=inner[:, f], minlength=len(used)) for f in range(factors)], axis=1)
            dv += DECAY * m.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += g.sum() ** 2
            m.w[used] -= RATE * dw / np.sqrt(gw[used])
            m.v[used] -= RATE * dv / np.sqrt(gv[used])
            m.bias -= RATE * g.sum() / gb ** 0.5
    return m


def _meta(rb: pa.RecordBatch, a: int, b: int) -> np.ndarray:
    col = np.asarray(rb.column("meta").slice(a, b - a).flatten().fill_null(0.0), np.float64)
    return np.log1p(np.maximum(np.nan_to_num(col, posinf=0.0), 0)).reshape(b - a, -1)


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        for a, b, part, ends in W.text_slices(rb.column("text")):
            doc, bucket, x, stats = features(part, ends)
            dense = np.hstack([stats, _meta(rb, a, b)])
            cuts = np.searchsorted(doc, np.arange(b - a + 1))
            yield pa.RecordBatch.from_pydict({
                "y": rb.column("y").slice(a, b - a),
                "bucket": [bucket[s:e].astype(np.int32).tobytes() for s, e in zip(cuts, cuts[1:])],
                "x": [x[s:e].astype(np.float32).tobytes() for s, e in zip(cuts, cuts[1:])],
                "dense": [r.tobytes() for r in dense]})


def _source(docs: DataFrame, id_col: str, text_col: str, meta_cols: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    names = {f.name for f in docs.schema.fields}
    meta = F.array(*[F.expr(f"try_cast(`{c}` as double)") if c in names else F.lit(None).cast("double") for c in meta_cols])
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                       meta.alias("meta"), *[F.col(f"`{c}`").alias(f"_carry{i}") for i, c in enumerate(carry)])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = TRAIN_ROWS,
          id_col: str = "doc_id", text_col: str = "text", meta_cols: Sequence[str] = ("n_chars",)) -> Machine:
    """Fit on at most ``rows`` labelled ids outside the held-out fold (crc32 of the id as text modulo 5 = 0)."""
    lab = only(labels, [id_col, label_col], ["doc_id", "y"]).where("doc_id is not null and y in (0, 1)")
    lab = lab.where(~held_out("doc_id"))
    lab = lab.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").select("doc_id", "y")
    some = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    src = _source(docs, id_col, text_col, meta_cols).join(
        F.broadcast(some.select(F.col("doc_id").alias("_id"), F.col("y").cast("int").alias("y"))), F.col("doc_id") == F.col("_id"))
    # rows of equal ids beyond the bound are left out of the fit
    sample = src.select("doc_id", "text", "meta", "y").mapInArrow(
        _sampler, "y int, bucket binary, x binary, dense binary").limit(rows)
    # the bounded sample meets in one task; only the fitted machine comes to the driver
    got = sample.mapInArrow(_fitter, "machine binary").first()
    return pickle.loads(got[0]) if got else fit([], np.zeros(0))


def _fitter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The machine fitted on all rows of ``_sampler``."""
    rows = [r for rb in batches for r in zip(*(rb.column(c).to_pylist() for c in ("dense", "bucket", "x", "y")))]
    if rows:
        rows.sort(key=lambda r: r[:2])   # the same fit whatever the partitions
        samples = [(np.frombuffer(b, np.int32).astype(np.int64), np.frombuffer(x, np.float32).astype(np.float64),
                    np.frombuffer(d, np.float64)) for d, b, x, _ in rows]
        machine = fit(samples, np.array([r[3] for r in rows]))
        yield pa.RecordBatch.from_pydict({"machine": pa.array([pickle.dumps(machine)], pa.binary())})


def held_out(id_col: str):
    """True for the fold that no label is learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text",
          meta_cols: Sequence[str] = ("n_chars",), carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, ``carry`` columns and score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rb in batches:
            for a, b, part, ends in W.text_slices(rb.column("text")):
                s = m.score(part, ends, _meta(rb, a, b))
                yield pa.RecordBatch.from_arrays(
                    [rb.column("doc_id").slice(a, b - a), *[rb.column(f"_carry{i}").slice(a, b - a) for i in range(len(carry))],
                     pa.array(s, pa.float64())], names=["doc_id", *carry, "score"])

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    src = _source(docs, id_col, text_col, meta_cols, carry)
    return src.mapInArrow(run, ", ".join(["doc_id long", *[f"`{c}` {types[c]}" for c in carry], "score double"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


SQL = None

"""Exact pair reports that skip block pairs by angle bounds.

The angle between unit vectors is a metric, so two blocks of a group whose
angles to their pivots are known bound the angle of every pair across them
before any product is formed:

1. Every group takes ``ceil(n / block)`` of its rows (at most ``MAX_PIVOTS``,
   the smallest by a hash of their id) as pivots; each row goes to its nearest
   pivot. Rows meet the pivots in chunks, never as a whole group.
2. The rows of a pivot, in the order of their angle to it (a distributed sort
   with per-partition offsets), are cut into blocks of ``block`` rows: a ring
   [lo, hi] around the pivot.
3. For two rings around pivots at angle t, the triangle inequality gives a
   least and a greatest angle of all their pairs. Only block pairs whose bounds
   cross what is asked are evaluated: their rows, and no others, meet in a task
   of at most two blocks.

Rows without direction (null or all zero) have similarity 0 with every row;
they form blocks of their own at a right angle to all others.

``filtered`` needs one round. ``extremes`` searches best first: each round
evaluates the block pairs with the most promising bounds of every group, four
times as many as the round before, until no bound left beats the best pair
found.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .grid import grouped_index
from .pairs import DEFAULT_BLOCK, Reducer, _key_fields, _matrix, _oriented

MAX_PIVOTS = 128
#: allowance for the rounding of angles (an arc cosine near 1 loses half of the digits)
EPS = 1e-6
#: block pairs per group that the first round of ``extremes`` evaluates for each end
FIRST_ROUND = 2
_NO_PIVOT = -1


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass
class Layout:
    """``rows`` (keys, id, vector, block) and ``pairs`` (keys, a, b, n_pairs, near, far: bounds of the angle)."""

    keys: list[str]
    id_col: str
    vec_col: str
    rows: DataFrame
    pairs: DataFrame


def layout(vectors: DataFrame, keys: Sequence[str] = ("model", "topic"), id_col: str = "persona_id",
           vec_col: str = "embedding", block: int = DEFAULT_BLOCK) -> Layout:
    """Rings around pivots and the bounds of all their pairs (two written tables)."""
    keys = list(keys)
    base = vectors.select(*keys, F.col(id_col).cast("string").alias(id_col), vec_col)
    base = base.withColumn("_dir", F.coalesce(F.exists(vec_col, lambda x: x != 0), F.lit(False)))
    n = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_chunks", F.ceil(F.col("_n") / block).cast("int"))
    first = Window.partitionBy(*keys).orderBy(F.xxhash64(id_col), id_col)
    pivots = (base.where("_dir").withColumn("_p", F.row_number().over(first)).where(F.col("_p") <= MAX_PIVOTS)
              .join(n, keys).where("_p <= _chunks"))
    pivots = _written(pivots.select(*keys, (F.col("_p") - 1).alias("_p"), F.col(vec_col).alias("_pv"), "_chunks"), "pivots")

    # rows and pivots meet in the chunks of a group
    chunk = F.pmod(F.xxhash64(id_col), F.col("_chunks").cast("long")).cast("int")
    rows = base.where("_dir").join(n, keys).select(*keys, id_col, vec_col, chunk.alias("_chunk"))
    to_all = pivots.select(*keys, "_p", "_pv", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"))
    schema = T.StructType([*_key_fields(base, keys), base.schema[id_col], base.schema[vec_col],
                           T.StructField("_p", T.IntegerType()), T.StructField("_angle", T.DoubleType())])

    def nearest(r: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(r):
            return pd.DataFrame(columns=schema.fieldNames())
        angle = np.arccos(np.clip(_matrix(r[vec_col], "cosine") @ _matrix(p["_pv"], "cosine").T, -1, 1))
        at = angle.argmin(axis=1)
        r = r.assign(_p=p["_p"].to_numpy()[at].astype(np.int32), _angle=angle[np.arange(len(r)), at])
        return r[schema.fieldNames()]

    dealt = rows.groupBy(*keys, "_chunk").cogroup(to_all.groupBy(*keys, "_chunk")).applyInPandas(nearest, schema)
    bare = base.where("not _dir").select(*keys, id_col, vec_col, F.lit(_NO_PIVOT).alias("_p"), F.lit(0.0).alias("_angle"))
    placed = grouped_index(dealt.unionByName(bare), [*keys, "_p"], ["_angle", id_col], "_pos", start=0)
    rows = _written(placed.withColumn("block", F.expr(f"_p * bigint(4294967296) + _pos div {block}")).drop("_pos"), "rings")

    blocks = rows.groupBy(*keys, "block", "_p").agg(F.min("_angle").alias("lo"), F.max("_angle").alias("hi"),
                                                    F.count(F.lit(1)).alias("n"))
    between = T.StructType([*_key_fields(base, keys), T.StructField("_p", T.IntegerType()),
                            T.StructField("_p2", T.IntegerType()), T.StructField("_t", T.DoubleType())])

    def angles(p: pd.DataFrame) -> pd.DataFrame:
        t = np.arccos(np.clip((m := _matrix(p["_pv"], "cosine")) @ m.T, -1, 1))
        np.fill_diagonal(t, 0.0)
        i, j = np.indices(t.shape).reshape(2, -1)
        no = p["_p"].to_numpy().astype(np.int32)
        return pd.DataFrame({**{k: [p[k].iloc[0]] * t.size for k in keys}, "_p": no[i], "_p2": no[j], "_t": t.ravel()})

    t = pivots.drop("_chunks").groupBy(*keys).applyInPandas(angles, between)
    other = blocks.select(*keys, *[F.col(c).alias(f"{c}2") for c in ("block", "_p", "lo", "hi", "n")])
    both = blocks.join(other, keys).where("block <= block2").join(t, [*keys, "_p", "_p2"], "left")
    near = F.greatest(F.lit(0.0), F.expr("_t - hi - hi2"), F.expr("lo - _t - hi2"), F.expr("lo2 - _t - hi"))
    far = F.least(F.lit(math.pi), F.expr("hi + _t + hi2"))
    right = F.lit(math.pi / 2)
    bare = (F.col("_p") == _NO_PIVOT) | (F.col("_p2") == _NO_PIVOT)
    pairs = both.select(
        *keys, F.col("block").alias("a"), F.col("block2").alias("b"),
        F.expr("if(block = block2, n * (n - 1) div 2, n * n2)").alias("n_pairs"),
        F.when(bare, right).when(F.col("block") == F.col("block2"), F.lit(0.0)).otherwise(near).alias("near"),
        F.when(bare, right).otherwise(far).alias("far")).where("n_pairs > 0")
    return Layout(keys, id_col, vec_col, rows.drop("_p", "_angle"), _written(pairs, "ring-pairs"))


def evaluate(at: Layout, pairs: DataFrame, reducer: Reducer, out_schema: T.StructType) -> DataFrame:
    """``reducer`` on the chosen block pairs (keys, a, b); rows of other block pairs stay where they are."""
    keys, id_col, vec_col = at.keys, at.id_col, at.vec_col
    sides = pairs.select(*keys, "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    met = at.rows.join(sides, [*keys, "block"])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        key = tuple(pdf[k].iloc[0] for k in keys)
        a, b = pdf["a"].iloc[0], pdf["b"].iloc[0]
        x = pdf[pdf["block"] == a]
        y = x if a == b else pdf[pdf["block"] == b]
        out = reducer(key, x[id_col].to_numpy(), _matrix(x[vec_col], "cosine"),
                      y[id_col].to_numpy(), _matrix(y[vec_col], "cosine"), a == b, None, None)
        if out is None or not len(out):
            return pd.DataFrame(columns=out_schema.fieldNames())
        for i, k in enumerate(keys):
            out.insert(i, k, key[i])
        return out[out_schema.fieldNames()]

    return met.groupBy(*keys, "a", "b").applyInPandas(fn, out_schema)


def _similarities(ma: np.ndarray, mb: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The products of two blocks, and which of them are pairs (each pair once)."""
    s = ma @ mb.T
    return s, np.triu(np.ones(s.shape, bool), 1) if same else np.ones(s.shape, bool)


def crossing(at: Layout, predicate: str, threshold: float) -> DataFrame:
    """Block pairs that can hold a pair with similarity ``>= threshold`` ('ge') or ``< threshold`` ('lt')."""
    limit = math.acos(max(-1.0, min(1.0, threshold)))
    if predicate == "ge":
        return at.pairs.where(F.col("near") <= limit + EPS)
    if predicate == "lt":
        return at.pairs.where(F.col("far") >= limit - EPS)
    raise ValueError("predicate must be 'lt' or 'ge'")


def filtered(vectors: DataFrame, predicate: str, threshold: float, keys: Sequence[str] = ("model", "topic"),
             id_col: str = "persona_id", vec_col: str = "embedding", block: int = DEFAULT_BLOCK) -> DataFrame:
    """Pairs (id_a < id_b) whose similarity is ``>= threshold`` ('ge') or ``< threshold`` ('lt'), and their similarity."""
    at = layout(vectors, keys, id_col, vec_col, block)
    schema = T.StructType([*_key_fields(vectors, at.keys), T.StructField("id_a", T.StringType()),
                           T.StructField("id_b", T.StringType()), T.StructField("similarity", T.DoubleType())])

    def reducer(key, ids_a, ma, ids_b, mb, same, _ea, _eb):
        s, pair = _similarities(ma, mb, same)
        i, j = np.nonzero(pair & (s < threshold if predicate == "lt" else s >= threshold))
        x, y = _oriented(ids_a, ids_b, i, j)
        return pd.DataFrame({"id_a": x, "id_b": y, "similarity": s[i, j]})

    return evaluate(at, crossing(at, predicate, threshold), reducer, schema)


def filtered_sums(vectors: DataFrame, predicate: str, threshold: float, keys: Sequence[str] = ("model", "topic"),
                  id_col: str = "persona_id", vec_col: str = "embedding", block: int = DEFAULT_BLOCK) -> DataFrame:
    """Per group with such pairs: n, lowest, highest, total of the similarities that ``filtered`` would give.

    A block pair sends one row of sums, never its pairs.
    """
    at = layout(vectors, keys, id_col, vec_col, block)
    schema = T.StructType([*_key_fields(vectors, at.keys), T.StructField("n", T.LongType()),
                           *[T.StructField(c, T.DoubleType()) for c in ("lowest", "highest", "total")]])

    def reducer(key, ids_a, ma, ids_b, mb, same, _ea, _eb):
        s, pair = _similarities(ma, mb, same)
        hit = s[pair & (s < threshold if predicate == "lt" else s >= threshold)]
        if not len(hit):
            return None
        return pd.DataFrame({"n": [len(hit)], "lowest": [hit.min()], "highest": [hit.max()], "total": [hit.sum()]})

    return evaluate(at, crossing(at, predicate, threshold), reducer, schema).groupBy(*at.keys).agg(
        F.sum("n").alias("n"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
        F.sum("total").alias("total"))


def extremes(vectors: DataFrame, keys: Sequence[str] = ("model", "topic"), id_col: str = "persona_id",
             vec_col: str = "embedding", block: int = DEFAULT_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(most and least similar pair per group, ties to the smallest ids; work per group).

    ``work`` has n_pairs and evaluated: all pairs of the group, and those whose products were formed.
    """
    at = layout(vectors, keys, id_col, vec_col, block)
    keys = at.keys
    schema = T.StructType([*_key_fields(vectors, keys), T.StructField("which", T.StringType()),
                           T.StructField("id_a", T.StringType()), T.StructField("id_b", T.StringType()),
                           T.StructField("similarity", T.DoubleType())])

    def reducer(key, ids_a, ma, ids_b, mb, same, _ea, _eb):
        s, pair = _similarities(ma, mb, same)
        rows = []
        for which, best in (("max", s[pair].max()), ("min", s[pair].min())):
            i, j = np.nonzero(pair & (s == best))
            rows.append((which, *min(zip(*_oriented(ids_a, ids_b, i, j))), float(best)))
        return pd.DataFrame(rows, columns=["which", "id_a", "id_b", "similarity"])

    left, found, size = at.pairs, None, FIRST_ROUND
    while True:
        # the most promising block pairs of either end
        for name, order in (("_high", F.asc("near")), ("_low", F.desc("far"))):
            left = left.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order, "a", "b")))
        chosen = _written(left.where(F.least("_high", "_low") <= size).drop("_high", "_low"), "ring-chosen")
        part = _written(evaluate(at, chosen, reducer, schema), "ring-extremes")
        found = part if found is None else found.unionByName(part)
        best = found.groupBy(*keys).agg(F.max("similarity").alias("_max"), F.min("similarity").alias("_min"))
        # a bound that only equals the best pair may still hide a tie with smaller ids
        left = left.drop("_high", "_low").join(chosen.select(*keys, "a", "b"), [*keys, "a", "b"], "left_anti").join(best, keys)
        left = _written(left.where((F.cos("near") >= F.col("_max") - EPS) | (F.cos("far") <= F.col("_min") + EPS)).drop(
            "_max", "_min"), "ring-left")
        done = chosen if size == FIRST_ROUND else done.unionByName(chosen)
        if left.isEmpty():
            break
        size *= 4
    pick = F.struct("id_a", "id_b", "similarity")
    of = {w: F.col("which") == w for w in ("max", "min")}
    out = found.groupBy(*keys).agg(
        F.min_by(F.when(of["max"], pick), F.when(of["max"], F.struct(-F.col("similarity"), "id_a", "id_b"))).alias("mx"),
        F.min_by(F.when(of["min"], pick), F.when(of["min"], F.struct("similarity", "id_a", "id_b"))).alias("mn"))
    out = out.select(*keys, F.col("mx.id_a").alias("most_similar_a"), F.col("mx.id_b").alias("most_similar_b"),
                     F.col("mx.similarity").alias("max_similarity"), F.col("mn.id_a").alias("least_similar_a"),
                     F.col("mn.id_b").alias("least_similar_b"), F.col("mn.similarity").alias("min_similarity"))
    work = at.pairs.groupBy(*keys).agg(F.sum("n_pairs").alias("n_pairs")).join(
        done.groupBy(*keys).agg(F.sum("n_pairs").alias("evaluated")), keys)
    return out, work

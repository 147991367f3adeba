"""Distributed union-find: connected components by alternating large-star / small-star contraction.

Only grouped minima, joins and distinct over the edge table; the table is
written below spark.checkpoint.dir after every half round (their plans stay small), and nothing but a
number per round reaches the driver. A vertex of very high degree is no hot
group: minima are pre-aggregated, and its join is an ordinary skewed join that
adaptive execution splits. The number of rounds is logarithmic in the longest
path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
    j = both.join(least, F.col("u") == F.col("_u")).where("v > u")
    return j.select(F.col("v").alias("u"), F.least("m", "_u").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
    j = down.join(least, F.col("u") == F.col("_u"))
    return (j.select(F.col("v").alias("u"), F.col("m").alias("v"))
             .union(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
             .where("u <> v").distinct())


def _only_stars(e: DataFrame) -> bool:
    """Whether every upper end u of ``e`` (u > v, distinct) has one link and is no lower end: v is the smallest of its component."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        e.select("v", F.lit(0), F.lit(1)))
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.where("up > 1 or (up = 1 and down = 1)").agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex of ``edges`` (two long columns u, v): the smallest vertex reachable.

    Self-links and repeated links are allowed; rows with a null end are
    ignored; an empty table gives an empty result.
    """
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    while not _only_stars(e):
        e = written(_small_star(written(_large_star(e), "links")), "links")
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())

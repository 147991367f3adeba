"""From band keys to verified links, without the pairs of a group.

Input: one row per distinct item with its band keys. A bucket is all items with
one key. Two passes:

* Star rounds. In every bucket each item is a candidate of one representative
  (the smallest, in the second round the largest id of the bucket); an item is verified against the
  ``STARS`` representatives it shares most bands with. The links are grouped by
  distributed union-find, so a large group of similar items becomes one
  component without its pairs.
* The rest, exhaustively: every pair of items in one bucket whose components
  still differ is a candidate. Where a bucket would give many such pairs per
  item (items around something they share, or strays beside a large group),
  its items are matched by an exact prefix filter instead (after star rounds over
  the elements it looks at, which join most groups without their pairs): with the elements of
  each set ordered from rare to frequent, two sets at the threshold share an
  element among the first n - ceil(percent * n / 100) + 1 of both, and behind
  it enough is left for the overlap they need. It loses no pair, and what many
  items share is what it never looks at.

Sizes differ by at most ``percent`` among similar sets, so other pairs are
never formed. Candidate pairs are only ids and counts; ``verify`` decides on
the full sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .components import components

#: representatives that an item is verified against in a star round
STARS = 4
#: the items of buckets with more cross-component pairs per item than this are matched by the prefix filter
PAIRS_AN_ITEM = 4
#: star rounds over prefix elements, at most, and while one of so many pairs is a link
TURNS, LEAST_YIELD = 1, 50


def buckets(items: DataFrame) -> DataFrame:
    """key, id, n, low, low_n, high, high_n of all rows of buckets with two items or more (``items``: id, n, bands)."""
    rows = items.select("id", "n", F.explode("bands").alias("key"))
    ends = rows.groupBy("key").agg(F.min("id").alias("low"), F.min_by("n", "id").alias("low_n"),
                                   F.max("id").alias("high"), F.max_by("n", "id").alias("high_n")).where("low <> high")
    return rows.join(ends, "key")


def _similar_size(a: str, b: str, percent: int):
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose ends are not yet in one component."""
    a = labels.select(F.col("vertex").alias("u"), F.col("component").alias("cu"))
    b = labels.select(F.col("vertex").alias("v"), F.col("component").alias("cv"))
    return (pairs.join(a, "u", "left").join(b, "v", "left")
            .where("coalesce(cu, u) <> coalesce(cv, v)").drop("cu", "cv"))


def prefixes(elements: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """e, id, n, p: the elements, from rare to frequent, that a set must look at (``elements``: id, e; ``items``: id, n)."""
    often = elements.groupBy("e").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("id").orderBy("df", "e")
    el = elements.join(often, "e").withColumn("p", F.row_number().over(order))
    return el.join(items.select(F.col("id").alias("_i"), "n"), F.col("id") == F.col("_i")).where(
        f"df > 1 and p <= n - ceil({percent} * n / 100) + 1").select("e", "id", "n", "p")


def _enough_behind(percent: int) -> str:
    """Whether two sets that meet at places p and p2 of their orders can still reach the threshold."""
    return f"(1 + least(n - p, n2 - p2)) * {100 + percent} >= {percent} * (n + n2)"


def prefix_pairs(el: DataFrame, percent: int) -> DataFrame:
    """(u, v) of different components that can reach the threshold (``el``: rows of ``prefixes`` with comp)."""
    other = el.select("e", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "comp", "p")])
    j = el.join(other, "e").where("id < id2 and comp <> comp2").where(_similar_size("n", "n2", percent)).where(
        _enough_behind(percent))
    return j.select(F.col("id2").alias("u"), F.col("id").alias("v")).distinct()


def prefix_stars(el: DataFrame, percent: int, turn: int) -> DataFrame:
    """(u, v): each item and the ``STARS`` items it shares most elements with, of one item per element (chosen by a hash).

    Rare elements bring similar items together, so most groups become one component here, without their pairs.
    """
    mid = el.groupBy("e").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.min_by(
        F.struct("id", "n", "comp", "p"), F.xxhash64("id", F.lit(turn))).alias("m")).where("_lo <> _hi").select("e", "m.*")
    mid = mid.select("e", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "comp", "p")])
    cand = el.join(mid, "e").where("comp <> comp2").where(_similar_size("n", "n2", percent)).where(_enough_behind(percent))
    cand = cand.groupBy("id", "id2").agg(F.count(F.lit(1)).alias("shared"))
    best = Window.partitionBy("id").orderBy(F.desc("shared"), "id2")
    return cand.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= STARS).select(
        F.greatest("id", "id2").alias("u"), F.least("id", "id2").alias("v")).distinct()


def mixed_buckets(rows: DataFrame) -> DataFrame:
    """Rows (key, id, n, comp) of buckets with several components, with ``main``, the largest, and ``large``."""
    each = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).cast("double").alias("c"))
    cost = each.groupBy("key").agg(F.sum("c").alias("n_all"), F.sum(F.col("c") * F.col("c")).alias("same"),
                                   F.count(F.lit(1)).alias("comps"), F.max(F.struct("c", "comp")).alias("top")).where("comps > 1")
    cost = cost.select("key", F.col("top.comp").alias("main"), (F.col("n_all") * F.col("n_all") - F.col("same")
                                                                > 2 * PAIRS_AN_ITEM * F.col("n_all")).alias("large"))
    return rows.join(cost, "key")


def small_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """(u, v) of all items in one bucket that is not large and that lie in different components."""
    small = mixed.where("not large").select("key", "id", "n", "comp", "main")
    # one end of a pair lies outside the largest component of its bucket: what is inside never meets itself
    strays = small.where("comp <> main").select("key", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "comp")])
    pairs = strays.join(small, "key").where("comp <> comp2 and (comp = main or id < id2)").where(
        _similar_size("n", "n2", percent))
    return pairs.select(F.greatest("id", "id2").alias("u"), F.least("id", "id2").alias("v")).distinct()


def links(busy: DataFrame, verify: Callable[[DataFrame], DataFrame], elements: Callable[[DataFrame], DataFrame],
          percent: int) -> DataFrame:
    """Verified (u, v) links that hold every component of the items together.

    ``busy`` is a written ``buckets(items)``; ``verify`` keeps the similar ones of (u, v) pairs; ``elements`` gives
    (id, e), all elements of the sets of some ids.
    """
    found, tested, labels = None, None, None
    for star in ("low", "high"):
        cand = busy.where(F.col("id") != F.col(star)).where(_similar_size("n", f"{star}_n", percent))
        cand = cand.select(F.col("id").alias("u"), F.col(star).alias("v")).groupBy("u", "v").agg(
            F.count(F.lit(1)).alias("shared"))
        if labels is not None:
            cand = _apart(cand, labels)
        best = Window.partitionBy("u").orderBy(F.desc("shared"), "v")
        pairs = written(cand.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= STARS)
                        .select("u", "v"), "bands-star")
        good = written(verify(pairs), "bands-links")
        found = good if found is None else found.union(good)
        tested = pairs if tested is None else tested.union(pairs)
        labels = components(found)
    def labelled(now: DataFrame) -> DataFrame:
        return busy.join(now, F.col("id") == F.col("vertex"), "left").select(
            "key", "id", "n", F.coalesce("component", "id").alias("comp"))

    def untested(pairs: DataFrame) -> DataFrame:
        done = tested.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        return pairs.join(done, ["u", "v"], "left_anti")

    mixed = written(mixed_buckets(labelled(labels)), "bands-mixed")
    items = written(mixed.where("large").select("id", "n").distinct(), "bands-large")
    el = written(prefixes(written(elements(items.select("id")), "bands-elements"), items, percent), "bands-prefixes")

    def with_comp() -> DataFrame:
        return el.join(labels, F.col("id") == F.col("vertex"), "left").select("e", "id", "n", "p", F.coalesce("component", "id").alias("comp"))

    for turn in range(TURNS):
        pairs = written(untested(prefix_stars(with_comp(), percent, turn)), "bands-turn")
        good = written(verify(pairs), "bands-links")
        found, tested = found.union(good), tested.union(pairs)
        labels = components(found)
        if good.count() * LEAST_YIELD < pairs.count():
            break
    rest = _apart(small_pairs(mixed, percent), labels).union(prefix_pairs(with_comp(), percent)).distinct()
    rest = written(untested(rest), "bands-rest")
    return found.union(written(verify(rest), "bands-links"))

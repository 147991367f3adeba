"""Merkle manifest of a dataset, with an inclusion proof for every row.

A leaf is the SHA-256 of a row's fields, each ``-`` if null, else its UTF-8
byte count, ``:`` and its value. Per source the leaves ascend by id; while
several nodes remain, every 16 consecutive ones become the SHA-256 of their
joined digests. What remains is the source's subroot; the subroots, ordered by
source, form the tree of the dataset in the same way.

Checkpoint and recompute: the tree above the leaves is kept only at every
``step``-th level (a written table per kept level). A proof needs siblings of
all levels; the nodes in between are made again for one aligned subtree (at
most 16 ** step kept nodes) at a time, their digests go into the proofs of the
nodes below, and they are dropped. Proofs are extracted from the top down: a
subtree receives the path above its root once, not once per leaf.

How it runs on a cluster: only digests are sorted and grouped, never texts. The
leaves are sorted by (source, id, digest) into range partitions, which splits a
source that holds a third of all rows; the position of a leaf in its source is
its place in its partition plus the counts of that source in earlier
partitions (one row per partition and source). Groups are subtrees of bounded
size. Everything is a SQL expression; the driver learns one number, the size of
the largest source, to know how many levels there are.

Defined cases: a null source is a source of its own, before all others; null
ids come first in their source; rows with equal ids are ordered by their
digest, and rows equal in all fields are leaves next to each other; null, empty
and very long texts are hashed as they are; a single row is leaf, subroot and
root at once and its proof is empty; other columns are ignored; an empty table
has no leaves and gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_shuffle, only, table, written

NAME = "op13_merkle_manifest"
ARITY = 16
#: levels between two kept ones
STEP = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def row_digest(columns: list[Column]) -> Column:
    """The leaf of the given fields."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]), 256)


@dataclass
class Forest:
    """One tree per ``tree`` value: ``nodes`` (tree, pos, n, digest, carried columns) and the kept levels above.

    ``n`` is the number of nodes of the tree at that level; the last level has one node per tree.
    """

    nodes: DataFrame
    kept: list[DataFrame]
    carry: tuple[str, ...]
    step: int


def _positions(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with pos (from 0, in ``order``) and n per tree, without a task that sees a whole tree."""
    keys = ["tree", *order]
    dealt = leaves.repartitionByRange(n_shuffle(leaves.sparkSession), *keys).sortWithinPartitions(*keys)
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()),
                    "merkle-sorted")
    counts = dealt.groupBy("_part", "tree").agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(counts.select("_part", "tree", "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
                                    F.sum("_c").over(tree).alias("n")), "merkle-offsets")
    return dealt.join(offsets, ["_part", "tree"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop(
        "_part", "_at", "_first", "_before")


def _subtrees(nodes: DataFrame, step: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """tree, up (position of the subtree's root), n, leaves (the kept nodes), l0 .. l<step> (digests of its levels)."""
    own = F.struct("pos", "digest", *carry)
    out = nodes.groupBy("tree", F.expr(f"pos div {ARITY ** step}").alias("up")).agg(
        F.sort_array(F.collect_list(own)).alias("leaves"), F.first("n").alias("n"))
    out = out.withColumn("l0", F.col("leaves.digest"))
    for i in range(step):  # a level of one node is the root of its tree and goes up as it is
        out = out.withColumn(f"l{i + 1}", F.expr(
            f"if(n <= {ARITY ** i}, l{i}, transform(sequence(0, (size(l{i}) - 1) div {ARITY}), "
            f"r -> sha2(array_join(slice(l{i}, r * {ARITY} + 1, {ARITY}), ''), 256)))"))
    return out


def forest(leaves: DataFrame, order: list[str], carry: tuple[str, ...] = (), step: int = STEP) -> Forest:
    """The trees over ``leaves`` (tree, digest, ``order``, ``carry``); ``order`` is unique within a tree."""
    nodes = _positions(leaves, order)
    largest, kept, level = nodes.agg(F.max("n")).first()[0] or 0, [], nodes
    while largest > 1 or not kept:
        up = _subtrees(level, step).select(
            "tree", F.col("up").alias("pos"), F.expr(f"(n + {ARITY ** step - 1}) div {ARITY ** step}").alias("n"),
            F.element_at(f"l{step}", 1).alias("digest"))
        level = written(up, f"merkle-level-{step * (len(kept) + 1)}")
        kept.append(level)
        largest = -(-largest // ARITY ** step)
    return Forest(nodes, kept, carry, step)


def proofs(trees: Forest, tops: DataFrame) -> DataFrame:
    """Every leaf with its path, from ``tops`` (tree, path above the tree's root, further columns of the tree).

    A path holds, from the leaf up, the joined digests of the siblings ``before`` and ``after`` the node.
    """
    more = [c for c in tops.columns if c not in ("tree", "path")]
    above = tops.withColumn("up", F.lit(0).cast("long"))
    levels = [trees.nodes, *trees.kept[:-1]]
    for k in range(len(levels) - 1, -1, -1):
        carry = trees.carry if k == 0 else ()
        size = ARITY ** trees.step
        siblings = []
        for i in range(trees.step):
            at = f"cast((x.pos % {size}) div {ARITY ** i} as int)"
            siblings.append(
                f"if(n > {ARITY ** i}, array(named_struct("
                f"'before', array_join(slice(l{i}, {at} - {at} % {ARITY} + 1, {at} % {ARITY}), ''), "
                f"'after', array_join(slice(l{i}, {at} + 2, {ARITY - 1} - {at} % {ARITY}), ''))), array())")
        node = ", ".join(["x.pos as pos", "x.digest as digest", *[f"x.{c} as {c}" for c in carry]])
        each = f"transform(leaves, x -> struct({node}, concat({', '.join(siblings)}, path) as path))"
        sub = _subtrees(levels[k], trees.step, carry).join(above, ["tree", "up"])
        rows = sub.select("tree", *more, F.explode(F.expr(each)).alias("x")).select("tree", *more, "x.*")
        above = rows.select("tree", F.col("pos").alias("up"), "path", *more) if k else rows
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree_by: str = "source", id_col: str = "doc_id",
             extra: dict[str, Column] | None = None, step: int = STEP) -> DataFrame:
    """id, ``tree_by``, leaf, subroot, root, path and ``extra`` of every row.

    ``extra`` are columns over the fields of a row (which are named ``f_<field>``) to be carried along.
    """
    extra = extra or {}
    rows = only(docs, list(fields), [f"f_{f}" for f in fields])
    source = F.col(f"f_{tree_by}").cast("string")
    leaves = rows.select(F.coalesce(F.concat(F.lit("1"), source), F.lit("0")).alias("tree"), F.col(f"f_{id_col}").alias("id"),
                         row_digest([F.col(f"f_{f}") for f in fields]).alias("digest"),
                         F.monotonically_increasing_id().alias("_row"), *[c.alias(k) for k, c in extra.items()])
    trees = forest(written(leaves, "merkle-leaves"), ["id", "digest", "_row"], ("id", *extra), step)
    subroots = trees.kept[-1].select("tree", "digest")
    whole = forest(subroots.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("sub")), ["sub"], ("sub",), step)
    top = whole.kept[-1].select("tree", F.expr("cast(array() as array<struct<before:string,after:string>>)").alias("path"),
                                F.col("digest").alias("root"))
    tops = written(proofs(whole, top).select(F.col("sub").alias("tree"), "path", "root", F.col("digest").alias("subroot")),
                   "merkle-tops")
    return proofs(trees, tops).select(
        F.col("id").alias(id_col), F.when(F.col("tree") != "0", F.expr("substring(tree, 2)")).alias(tree_by),
        F.col("digest").alias("leaf"), "subroot", "root", "path", *extra)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document; a fifth of them is folded with a tampered leaf."""
    text = F.when(F.crc32(F.col("f_doc_id").cast("string")) % 5 == 0, F.translate("f_text", _UPPER, _LOWER)).otherwise(
        F.col("f_text"))
    probe = row_digest([text if f == "text" else F.col(f"f_{f}") for f in FIELDS])
    m = manifest(table(spark, sf_dir, "documents"), extra={"probe": probe})
    folded = fold(F.col("probe"), F.col("path"))
    joined = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    out = m.select("doc_id", "leaf", "subroot", "root", F.sha2(joined, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels(first: str, name: str, n: int) -> str:
    """CTEs of ``n`` levels over ``first`` (src, pos, n, d): nodes and the digests beside each."""
    out = [f"{name}0 AS ({first})"]
    for i in range(n):
        out.append(f"""{name}s{i} AS (
  SELECT src, pos, n, CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS b,
         CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER (b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS a
  FROM {name}{i} WINDOW b AS (PARTITION BY src, pos // 16 ORDER BY pos))""")
        out.append(f"""{name}{i + 1} AS (
  SELECT src, pos // 16 AS pos, (any_value(n) + 15) // 16 AS n,
         CASE WHEN any_value(n) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d
  FROM {name}{i} GROUP BY src, pos // 16)""")
    return ",\n".join(out)


def _sql(levels: int = 6, top: int = 4) -> str:
    def field(f: str) -> str:
        return f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(f) if f != "text" else field(text) for f in FIELDS) + ")"

    steps = [("s", f"s{i}", f"k.pos // {16 ** i}", "k.src") for i in range(levels)]
    steps += [("t", f"t{i}", f"q.pos // {16 ** i}", "0") for i in range(top)]
    joins = "\n".join(f"JOIN {kind}s{name[1:]} AS {name} ON {name}.src = {src} AND {name}.pos = {pos}"
                      for kind, name, pos, src in steps)
    fold_, proof = "k.probe", []
    for _, name, _, _ in steps:
        proof.append(f"{name}.b || {name}.a")
    folds = []
    for i, (_, name, _, _) in enumerate(steps):
        prev = f"f{i - 1}.f" if i else fold_
        folds.append(f"CROSS JOIN LATERAL (SELECT CASE WHEN {name}.n = 1 THEN {prev} ELSE sha256({name}.b || {prev} || {name}.a) END AS f) AS f{i}")
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = ("xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), "
           "lambda x, y: list_reduce([xor(x, y)] || range(0, 8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)")
    return f"""
WITH leaves AS (
  SELECT doc_id, coalesce('1' || source, '0') AS src, {leaf('text')} AS d,
         CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS probe FROM documents),
k AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY src) AS n
  FROM leaves),
{_levels("SELECT src, pos, n, d FROM k", "s", levels)},
q AS (SELECT src, row_number() OVER (ORDER BY src) - 1 AS pos, count(*) OVER () AS n, d FROM s{levels}),
{_levels("SELECT 0 AS src, pos, n, d FROM q", "t", top)},
proofs AS (
  SELECT k.doc_id, k.d AS leaf, q.d AS subroot, (SELECT d FROM t{top}) AS root,
         sha256({' || '.join(proof)}) AS proof_sha256, f{len(steps) - 1}.f AS folded_root
  FROM k JOIN q ON q.src = k.src
  {joins}
  {' '.join(folds)})
SELECT *, folded_root = root AS verified FROM proofs"""


SQL = _sql()

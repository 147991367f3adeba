"""Quality rules: learned decision lists over text statistics, as ordered Spark conditional expressions.

All of it is DataFrame and SQL functions. One pass computes the statistics of
every whole text into a table. Learning is sequential covering on the
statistics of all labelled rows (those outside the held-out fold): a rule is a
conjunction of thresholds on statistics, grown one condition at a time by the
largest information gain over the quantiles of each statistic, then pruned from its
end on rows that did not grow it; it is kept if it is precise enough, the rows
it covers are set aside, and the next rule is learned, until none is good
enough. One growth step is one grouped count per (statistic, quantile bin), so
only a few hundred numbers reach the driver, however many rows are labelled.
The list becomes one CASE expression.

Words are ``[^\\x20\\x09-\\x0D]+``. Statistics (long): n_words; word_chars, code
points in words; n_symbols, characters of ``[#*$%&|<>]``; n_dup_lines, lines
(split at ``\\n``) with a word that equal an earlier line; n_repeat_words, words
in 5-word windows found twice or more in the text, the first included; n_capitals, n_marks and
n_distinct_words. Equality of 5-word windows inside one text is equality of
64-bit hashes.

Defined cases: null or empty texts have no words, so they fail the base rule;
rows with null or contradictory labels or null ids are not learned from; with
no labels, or none of one class, the list is empty and the base rule alone
decides; rows with equal ids are judged one by one; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, table, written

NAME = "op3_decision_list"
#: the base rule: fewer words than this, or more than this percentage of repeated words
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
BINS = 40
MAX_CONDITIONS, MAX_RULES = 4, 12
#: a rule must cover this many unwanted rows and be right on this share of what it covers
MIN_COVERED, MIN_PRECISION = 5, 0.95

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks",
              "n_distinct_words")
# what conditions are about: SQL over the statistics
RATIOS = {
    "n_words": "cast(n_words as double)",
    "chars_a_word": "word_chars / greatest(n_words, 1)",
    "symbols_a_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_a_word": "n_dup_lines / greatest(n_words, 1)",
    "repeated_share": "n_repeat_words / greatest(n_words, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "marks_a_word": "n_marks / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every whole text."""
    d = only(docs, [id_col, text_col], ["doc_id", "text"]).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # each step is referenced several times by the next one, so the optimiser keeps them apart and evaluates them once
    d = d.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("n", F.size("words"))
    windows = ("CASE WHEN n >= 5 THEN transform(sequence(0, n - 5), "
               "i -> xxhash64(words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4])) END")
    d = d.select(
        "doc_id", F.col("n").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit("[!?]")).cast("long").alias("n_marks"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        F.expr(windows).alias("h"))
    # windows that occur again: neighbours with equal hashes after sorting (hash, place)
    d = d.withColumn("s", F.expr("CASE WHEN h IS NOT NULL AND size(array_distinct(h)) < size(h) "
                                 "THEN sort_array(transform(h, (x, i) -> struct(x AS x, i AS i))) END")).drop("h")
    d = d.withColumn("p", F.expr(
        "CASE WHEN s IS NOT NULL THEN sort_array(transform(filter(sequence(0, size(s) - 1), k -> "
        "(k > 0 AND s[k].x = s[greatest(k - 1, 0)].x) OR (k < size(s) - 1 AND s[k].x = s[least(k + 1, size(s) - 1)].x)), "
        "k -> s[k].i)) END")).drop("s")
    # words covered: each window adds what lies behind the end of the one before
    covered = ("CASE WHEN p IS NULL THEN 0L ELSE aggregate(p, struct(0L AS c, 0 AS e), "
               "(a, i) -> struct(a.c + i + 5 - greatest(a.e, i) AS c, i + 5 AS e), a -> a.c) END")
    return d.withColumn("n_repeat_words", F.expr(covered).cast("long")).select("doc_id", *STATISTICS)


@dataclass(frozen=True)
class Condition:
    ratio: str
    above: bool            # ratio > bound, else ratio <= bound
    bound: float

    def sql(self) -> str:
        return f"{RATIOS[self.ratio]} {'>' if self.above else '<='} {self.bound!r}D"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int           # unwanted rows it covered when learned
    wrong: int             # wanted rows

    def sql(self) -> str:
        return " AND ".join(f"({c.sql()})" for c in self.conditions)


def verdict_sql(rules: list[Rule]) -> str:
    """The ordered list as one conditional: the number of the first rule that holds, 0 if none does."""
    if not rules:
        return "0"
    return "CASE " + " ".join(f"WHEN {r.sql()} THEN {i}" for i, r in enumerate(rules, 1)) + " ELSE 0 END"


def _gain(p0: float, n0: float, p1: float, n1: float) -> float:
    """FOIL's information gain of narrowing (p0 unwanted, n0 wanted) to (p1, n1)."""
    if not p1:
        return 0.0
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))


def _bins(bounds: list[float], ratio: str) -> str:
    """SQL: how many bounds lie below the ratio."""
    return " + ".join(f"CAST({ratio} > {b!r}D AS INT)" for b in bounds)


def learn(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> list[Rule]:
    """Ordered rules that pick out label 0, learned outside the held-out fold (crc32 of the id as text modulo 5 = 0)."""
    lab = only(labels, [id_col, label_col], ["_id", "y"]).where("_id is not null and y in (0, 1)")
    lab = lab.groupBy("_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").select("_id", "y")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = stats.join(lab, F.col("doc_id") == F.col("_id")).where(fold % 5 != 0).select(
        *[F.expr(sql).alias(name) for name, sql in RATIOS.items()], (F.col("y") == 0).cast("int").alias("bad"),
        (F.floor(fold / 5) % 3 == 0).alias("prune"))
    names = list(RATIOS)
    steps = [(i + 0.5) / BINS for i in range(BINS)] + [0.002, 0.005, 0.995, 0.998]
    # quantiles of both classes apart: the rarer one is not lost between two of them
    cut = rows.groupBy("bad").agg(*[F.percentile_approx(c, steps, 10_000).alias(c) for c in names]).collect()
    if len(cut) < 2:
        return []
    bounds = {c: sorted({float(x) for r in cut for x in r[c]}) for c in names}
    binned = written(rows.select(*[F.expr(_bins(bounds[c], c)).alias(c) for c in names], "bad", "prune"), "rules-binned")

    def condition(c: Condition) -> str:
        at = bounds[c.ratio].index(c.bound) + 1
        return f"{c.ratio} {'>=' if c.above else '<'} {at}"

    def where(rows: DataFrame, conds: list[Condition]) -> DataFrame:
        return rows.where(" AND ".join(condition(c) for c in conds)) if conds else rows

    def counts(rows: DataFrame) -> tuple[int, int]:
        r = rows.agg(F.sum("bad"), F.sum(1 - F.col("bad"))).first()
        return int(r[0] or 0), int(r[1] or 0)

    rules: list[Rule] = []
    left = binned
    while len(rules) < MAX_RULES:
        conds: list[Condition] = []
        p0, n0 = counts(left.where("not prune"))
        while p0 and n0 and len(conds) < MAX_CONDITIONS:
            each = where(left.where("not prune"), conds).select("bad", F.explode(F.array(*[
                F.struct(F.lit(c).alias("ratio"), F.col(c).alias("bin")) for c in names])).alias("f"))
            table_ = each.groupBy("f.ratio", "f.bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
            best = None
            for c in names:
                p = [0] * (len(bounds[c]) + 1)
                n = list(p)
                for r in table_:
                    if r["ratio"] == c:
                        p[r["bin"]], n[r["bin"]] = r["p"], r["n"]
                below_p = below_n = 0
                for i, b in enumerate(bounds[c]):
                    below_p, below_n = below_p + p[i], below_n + n[i]
                    for above, p1, n1 in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                        # of equal gains the narrowest condition: rows unlike any labelled one are left alone
                        g = (round(_gain(p0, n0, p1, n1), 9), p1, -n1, i if above else -i)
                        if p1 >= MIN_COVERED and g[0] > 1e-9 and (best is None or g > best[0]):
                            best = (g, Condition(c, above, b), p1, n1)
            if best is None:
                break
            conds.append(best[1])
            p0, n0 = best[2], best[3]
        if not conds:
            break
        # prune from the end on the other rows: the shortest prefix with the best (p - n) / (p + n)
        tests = [" AND ".join(condition(c) for c in conds[:i + 1]) for i in range(len(conds))]
        held = left.where("prune").agg(*[F.sum(F.expr(f"CASE WHEN {t} THEN {v} ELSE 0 END")).alias(f"{k}{i}")
                                         for i, t in enumerate(tests) for k, v in (("p", "bad"), ("n", "1 - bad"))]).first()
        value = [((held[f"p{i}"] or 0) - (held[f"n{i}"] or 0)) / max((held[f"p{i}"] or 0) + (held[f"n{i}"] or 0), 1)
                 for i in range(len(conds))]
        conds = conds[:value.index(max(value)) + 1]
        p, n = counts(where(left, conds))
        if p < MIN_COVERED or p < MIN_PRECISION * (p + n):
            break
        rules.append(Rule(tuple(conds), p, n))
        left = left.where("NOT (" + " AND ".join(condition(c) for c in conds) + ")")
    return rules


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` with base_failed, rule (number of the first rule that holds, else 0) and kept."""
    base = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
    return (stats.withColumn("base_failed", F.expr(base)).withColumn("rule", F.expr(verdict_sql(rules)))
            .withColumn("kept", F.expr("NOT base_failed AND rule = 0")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every whole document."""
    stats = written(statistics(table(spark, sf_dir, "documents")), "rules-statistics")
    out = apply_rules(stats, learn(stats, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = None

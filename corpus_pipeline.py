"""A corpus pipeline over the documents table; part of the subpackage ``consonance.llm``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir),
works on all rows its predecessor kept, and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``:

1. quality_classifier: a factorisation machine, fitted on the labels outside
   the held-out fold; documents it scores below 0.3 go.
2. line_dedup: of similar lines only the first one in the corpus stays;
   documents that lose all their lines go.
3. near_dedup: one document of each near-duplicate group stays.
4. secret_scan: every finding is replaced by ``[secret]``.
5. best_fit_packing: the place of each piece of each document in a bin.

``n_chars`` is kept equal to the length of the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from consonance.llm import best_fit_packing, fm_quality, line_dedup, near_dedup, secret_scan
from consonance.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_REST = ("lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes, whole."""
    machine = fm_quality.train(docs, table(spark, sf_dir, "labels"))
    out = fm_quality.score(docs, machine, carry=("text", *_REST)).where(F.col("score") >= fm_quality.THRESHOLD)
    return out.select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; those with none left go."""
    out = line_dedup.line_dedup(docs, carry=_REST).where("n_removed = 0 or n_removed < n_lines")
    size = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", size.alias("n_chars"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each near-duplicate group, whole; rows with equal ids stay or go together."""
    keep = near_dedup.near_dedup(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(keep, F.col("doc_id") == F.col("_gone"), "left_anti").select(*COLUMNS)


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    out = secret_scan.scan(docs, secret_scan.train(docs), carry=_REST)
    size = F.when(F.size("findings") > 0, F.length("redacted").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", F.col("redacted").alias("text"), "lang", "source", size.alias("n_chars"))


def best_fit_packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, first_word, n_words, bin_id, bin_offset of every document that is left."""
    return best_fit_packing.best_fit(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scan", secret_scan_stage),
    ("best_fit_packing", best_fit_packing_stage),
]

#: learned stages and greedy packing are no SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

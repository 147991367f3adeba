"""The llm queries: one per operator, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import (arc_to_warc, best_fit_packing, byte_bpe, decision_list, fm_quality, line_dedup, merkle_manifest, near_dedup,
               nra_topk, piece_offsets, secret_scan, substring_dedup, token_alignment)

#: operator modules with NAME, query(spark, sf_dir) and SQL (None where SQL cannot express it)
MODULES = (arc_to_warc, best_fit_packing, byte_bpe, decision_list, fm_quality, line_dedup, merkle_manifest, near_dedup,
           nra_topk, piece_offsets, secret_scan, substring_dedup, token_alignment)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in MODULES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    out = {m.NAME: m.SQL for m in MODULES if m.SQL}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

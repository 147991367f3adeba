"""Personas to prompts: cleaning, numbering, required fields, prompt grid, control prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import DROPPED_PERSONA_FIELDS, persona_details, prompt_text
from .grid import dense_index, expand


def drop_fields(rows: DataFrame) -> DataFrame:
    """Remove the eight listed persona fields (those present)."""
    return rows.drop(*[c for c in DROPPED_PERSONA_FIELDS if c in rows.columns])


def number_personas(entries: DataFrame, order_col: str = "row_idx",
                    id_col: str = "uuid") -> DataFrame:
    """Sequential 1-based ``id_col`` over entries that have a row, in ``order_col`` order.

    ``entries`` has ``order_col`` and a struct column ``row`` (NULL when the
    entry has no row); numbered entries get ``row.*`` flattened with the id
    replaced, entries without a row pass through with NULL id.
    """
    with_row = entries.where(F.col("row").isNotNull())
    numbered = dense_index(with_row, [order_col], "_seq")
    fields = [f.name for f in entries.schema["row"].dataType.fields if f.name != id_col]
    flat = numbered.select(order_col, F.col("_seq").cast("string").alias(id_col),
                           *[F.col(f"row.{f}").alias(f) for f in fields])
    rest = entries.where(F.col("row").isNull()).select(
        order_col, F.lit(None).cast("string").alias(id_col),
        *[F.lit(None).cast(entries.schema["row"].dataType[f].dataType).alias(f) for f in fields])
    return drop_fields(flat.unionByName(rest))


def with_required_fields(personas: DataFrame) -> DataFrame:
    """Keep personas that have both ``persona`` and ``professional_persona``."""
    need = [c for c in ("persona", "professional_persona")]
    for c in need:
        if c not in personas.columns:
            return personas.where(F.lit(False))
    return personas.where(F.col("persona").isNotNull() & F.col("professional_persona").isNotNull())


def prompts(personas: DataFrame, topics: DataFrame, id_col: str = "persona_id") -> DataFrame:
    """(topic, persona_id, prompt) for every eligible persona and distinct topic."""
    p = with_required_fields(personas)
    p = p.select(F.col(id_col).cast("string").alias("persona_id"),
                 persona_details(p).alias("_details"))
    g = expand(p, topics, "topic")
    return g.select("topic", "persona_id", prompt_text(F.col("_details"), F.col("topic")).alias("prompt"))


def topic_prompt_counts(prompt_table: DataFrame, topics: DataFrame) -> DataFrame:
    """Prompts per distinct topic; a topic without personas stays with 0."""
    t = topics.select("topic").distinct()
    c = prompt_table.groupBy("topic").agg(F.count(F.lit(1)).alias("prompts"))
    return t.join(c, "topic", "left").select("topic", F.coalesce("prompts", F.lit(0)).cast("long")
                                             .alias("prompts"))


def control_prompts(prompt_table: DataFrame, repetitions: int = 10) -> DataFrame:
    """Repeat the one base prompt ``repetitions`` times with ids ``<id>_rep1..N``.

    The input must hold exactly one prompt (one persona, one topic); anything
    else is an error, as in the reference.
    """
    if repetitions < 1:
        raise ValueError("repetitions must be >= 1")
    n = prompt_table.limit(2).count()
    if n != 1:
        raise ValueError(f"control prompts need exactly one base prompt, got {n if n < 2 else '2+'}")
    rep = F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("rep")
    x = prompt_table.select("topic", F.col("persona_id").alias("base_id"), "prompt", rep)
    return x.select("topic", F.concat("base_id", F.lit("_rep"), F.col("rep").cast("string")).alias("persona_id"),
                    F.col("rep").cast("int").alias("rep"), "prompt")


def preview(personas: DataFrame, id_col: str = "persona_id", width: int = 100) -> DataFrame:
    """First persona (by numeric id, then text id) with its persona text cut at ``width``."""
    first = personas.orderBy(F.col(id_col).try_cast("bigint").asc_nulls_last(), F.col(id_col)).limit(1)
    return first.select(F.col(id_col).cast("string").alias("persona_id"),
                        F.substring("persona", 1, width).alias("persona_preview"))

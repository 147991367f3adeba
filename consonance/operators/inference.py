"""Answering tasks: distributed calls of a caller-supplied answer function, retry
rounds, recovery, placeholders and the control experiment.

The answer function is the extension point (in production an HTTP client for
a model API). ``answer_tasks`` runs it inside ``mapInArrow`` on the
executors, so calls spread over the cluster; outcome normalisation, retry
selection, merging and coverage are JVM-side DataFrame operations. Each
round is written to the shared checkpoint folder, which cuts the lineage
and makes a lost executor cost one round, not the run.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.validity import is_valid, normalise_outcome
from ..session import scratch_path
from .coverage import KEYS, fill_placeholders, last_answer_wins, merge_results, missing_tasks

# answerer(model, topic, persona_id, prompt, attempt) -> (text | None, error | None, tokens | None)
Answerer = Callable[[str, str, str, str, int], tuple]
RAW_FIELDS = [T.StructField("response_text", T.StringType()), T.StructField("error", T.StringType()),
              T.StructField("tokens_used", T.IntegerType()), T.StructField("received", T.BooleanType())]


def template_answerer(fail_modulus: int = 5) -> Answerer:
    """A deterministic local answer function (tests, examples, benchmarks).

    The answer restates the topic, persona, model and the prompt length; it
    comes back empty when (persona number * 7 + attempt * 3 + len(model)) is a
    multiple of ``fail_modulus``, so retries have something to recover.
    """
    def answer(model, topic, persona_id, prompt, attempt):
        try:
            num = int(persona_id)
        except (TypeError, ValueError):
            num = sum(map(ord, str(persona_id)))
        if fail_modulus and (num * 7 + attempt * 3 + len(model)) % fail_modulus == 0:
            return "", None, 0
        text = (f"Fact 1: {topic} as asked by persona {persona_id}. "
                f"Fact 2: answered by {model} on attempt {attempt} "
                f"for a prompt of {len(prompt or '')} characters.")
        return text, None, len(text) // 4

    return answer


def answer_tasks(tasks: DataFrame, answerer_factory: Callable[[], Answerer], attempt: int | str = 1,
                 partitions: int | None = None) -> DataFrame:
    """Call the answer function for every task; normalised (response, success, tokens).

    ``tasks`` has model, topic, persona_id, prompt and, when ``attempt`` is a
    column name, the attempt number per row. ``partitions`` spreads the calls
    (hash of model and persona, so models interleave inside a partition).
    """
    raw = _answered(tasks, answerer_factory, attempt, partitions)
    return raw.select(*KEYS, "attempt", "response", "success", "tokens")


def _answered(tasks: DataFrame, answerer_factory: Callable[[], Answerer], attempt: int | str,
              partitions: int | None) -> DataFrame:
    """``answer_tasks`` with the prompt of every row; the columns of a task pass through Python as they came."""
    att_col = F.col(attempt) if isinstance(attempt, str) else F.lit(int(attempt))
    t = tasks.select(*KEYS, "prompt", att_col.cast("int").alias("attempt"))
    if partitions:
        t = t.repartition(partitions, "model", "persona_id")
    schema = T.StructType(t.schema.fields + RAW_FIELDS)

    def fn(batches):
        answer = answerer_factory()
        for b in batches:
            out = []
            for m, tp, pid, pr, a in zip(*[c.to_pylist() for c in b.columns]):
                try:
                    text, err, tok = answer(m, tp, pid, pr, int(a))
                    out.append((text, err, tok))
                except Exception as e:  # noqa: BLE001 - a failed call becomes an error row
                    out.append((None, str(e), None))
            text, err, tok = zip(*out) if out else ((), (), ())
            raw = [pa.array(text, pa.string(), from_pandas=True), pa.array(err, pa.string(), from_pandas=True),
                   pa.array(pd.Series(tok, dtype=object).astype("Int32"), pa.int32()),
                   pa.array([True] * len(out), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *raw], names=schema.fieldNames())

    raw = t.mapInArrow(fn, schema)
    o = normalise_outcome(F.col("response_text"), F.col("error"), F.col("tokens_used"), F.col("received"))
    return raw.select(*KEYS, "prompt", "attempt", o.alias("o")).select(*KEYS, "prompt", "attempt", "o.response", "o.success",
                                                                       "o.tokens")


def _persist_round(df: DataFrame, name: str) -> DataFrame:
    """Write a round to the shared checkpoint folder and read it back (lineage cut)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run_with_retries(tasks: DataFrame, answerer_factory: Callable[[], Answerer], max_retries: int = 3,
                     partitions: int | None = None) -> DataFrame:
    """First round, up to ``max_retries`` retry rounds, then a recovery pass for
    absent keys. Returns every attempt with its ``stage`` and ``kept`` flag.

    Tasks whose first answer failed or is invalid (11-pattern check) are
    retried; a retry counts as recovered on ``success`` and leaves the queue;
    failed retries are logged but not kept, so an unrecovered task keeps its
    first answer.
    """
    some = F.greatest(*[F.col(k).isNull() for k in KEYS]) == F.lit(False)

    def written_round(todo, attempt, stage, kept, bad, name):
        """A round, written; a row that is asked again keeps its prompt, so no round is joined with all tasks."""
        rnd = _answered(todo, answerer_factory, attempt, partitions)
        again = F.coalesce(bad, F.lit(False)) & some
        return _persist_round(rnd.withColumn("stage", F.lit(stage)).withColumn("kept", kept).withColumn(
            "again", again).withColumn("prompt", F.when(F.col("again"), F.col("prompt"))), name)

    first = written_round(tasks, 1, "batch", F.lit(True), ~F.col("success") | ~is_valid(F.col("response")), "round-0")
    attempts = first.drop("prompt", "again")
    # a key of several tasks is asked again with the prompts of all of them
    many = _persist_round(first.where(some).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*KEYS),
                          "repeated-keys")
    repeats = not many.isEmpty()
    rnd = first
    for r in range(1, max_retries + 1):
        todo = rnd.where("again").select(*KEYS, "prompt")
        if repeats:
            prompts = tasks.select(*KEYS, "prompt").join(many, KEYS, "left_semi")
            todo = todo.join(many, KEYS, "left_anti").unionByName(
                todo.select(*KEYS).join(many, KEYS, "left_semi").join(prompts, KEYS))
        rnd = written_round(todo.withColumn("attempt", F.lit(r + 1)), "attempt", f"retry_round_{r}", F.col("success"),
                            ~F.col("success"), f"round-{r}")
        if rnd.limit(1).count() == 0:  # reads the written round: nothing was left to retry
            break
        attempts = attempts.unionByName(rnd.drop("prompt", "again"))
    # recovery pass for keys that never produced a row
    absent = missing_tasks(tasks, attempts.select(*KEYS))
    if absent.limit(1).count() > 0:
        rec = answer_tasks(absent, answerer_factory, max_retries + 2, partitions)
        attempts = attempts.unionByName(_persist_round(
            rec.withColumn("stage", F.lit("post_recovery")).withColumn("kept", F.lit(True)), "recovery"))
    return attempts


def replay(log: DataFrame, max_retries: int = 3, seq_col: str = "seq") -> DataFrame:
    """The rounds of ``run_with_retries`` over an answer log instead of calls.

    The r-th logged answer of a key (by ``seq_col``) is its r-th attempt. A
    first answer counts if it is successful and valid, a retry if it is
    successful; later answers of a finished key, and answers beyond
    ``max_retries`` retries, were never asked for. Returns the attempts made,
    with ``attempt``, ``stage`` and ``kept`` (the answer that counts; the first
    one when none does). One window per key, no rounds.
    """
    order = Window.partitionBy(*KEYS).orderBy(seq_col)
    a = log.withColumn("attempt", F.row_number().over(order)).where(F.col("attempt") <= 1 + max_retries)
    good = F.coalesce(F.col("success"), F.lit(False))
    good = F.when(F.col("attempt") == 1, good & is_valid(F.col("response"))).otherwise(good)
    done = F.min(F.when(good, F.col("attempt"))).over(Window.partitionBy(*KEYS))
    a = a.withColumn("_done", done).where(F.col("attempt") <= F.coalesce("_done", F.lit(1 + max_retries)))
    stage = F.when(F.col("attempt") == 1, F.lit("first")).otherwise(
        F.concat(F.lit("retry_"), (F.col("attempt") - 1).cast("string")))
    return a.withColumn("stage", stage).withColumn("kept", F.col("attempt") == F.coalesce("_done", F.lit(1))).drop("_done")


def control_replay(log: DataFrame, repetitions: int = 10, seq_col: str = "seq") -> DataFrame:
    """The control run over an answer log: per model, the logged answers to one prompt are its repetitions.

    The prompt is the first topic (by name) of the whole log and, per model, its
    smallest numeric persona id there; the r-th answer by ``seq_col`` gets the id
    ``<persona>_rep<r>``, at most ``repetitions`` of them (the number is the
    feature). A model without an answer to that topic has no rows.
    """
    num = F.col("persona_id").cast("bigint")
    at = log.where(F.col("topic") == log.agg(F.min("topic")).scalar())
    first = at.groupBy("model").agg(F.min(num).alias("_first"))
    rows = at.join(first, "model").where(num == F.col("_first"))
    r = F.row_number().over(Window.partitionBy("model").orderBy(seq_col))
    rows = rows.withColumn("_rep", r).where(F.col("_rep") <= repetitions)
    return rows.withColumn("persona_id", F.concat("persona_id", F.lit("_rep"), F.col("_rep").cast("string"))).drop("_first", "_rep")


def resume(tasks: DataFrame, existing: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Answer only the tasks without an existing answer and merge; an existing answer wins."""
    return merge_results(existing, answer(missing_tasks(tasks, existing)))


def final_answers(tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    """Latest kept answer per task; tasks with none get the placeholder text."""
    kept = attempts.where(F.col("kept")).select(*KEYS, "attempt", "response", "success", "tokens")
    last = last_answer_wins(kept, KEYS, "attempt")
    return fill_placeholders(tasks.select(*KEYS), last)


def control_tasks(base_prompt: DataFrame, models: DataFrame, repetitions: int = 10) -> DataFrame:
    """Control experiment grid: one prompt repeated ``repetitions`` times for every model."""
    from .grid import task_grid
    from .personas import control_prompts

    return task_grid(control_prompts(base_prompt, repetitions), models)

"""Completeness accounting over task grids and attempt logs.

Keys are (model, topic, persona_id) throughout. Every operator is a join,
anti-join or grouped aggregate; nothing collects a group into one row except
bounded top-k lists, which are built in two salted steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grades import coverage_grade
from ..functions.validity import PLACEHOLDER, is_valid, retry_priority

KEYS = ["model", "topic", "persona_id"]


def missing_tasks(tasks: DataFrame, done: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Expected tasks with no completed answer (the task columns, prompt included)."""
    return tasks.join(done.select(*keys), list(keys), "left_anti")


def smallest_k(df: DataFrame, group: Sequence[str], value: str, k: int,
               salt_buckets: int = 64) -> DataFrame:
    """Per group, the k smallest distinct ``value``s as a comma-joined string.

    Two steps keep a hot group spread out: top-k per (group, hash bucket),
    then top-k over at most k * salt_buckets candidates per group.
    """
    group = list(group)
    d = df.select(*group, value).distinct()
    d = d.withColumn("_b", F.pmod(F.xxhash64(value), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*group, "_b").orderBy(value)
    cand = d.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k)
    w2 = Window.partitionBy(*group).orderBy(value)
    best = cand.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= k)
    return best.groupBy(*group).agg(
        F.array_join(F.array_sort(F.collect_list(value)), ",").alias(f"first_{value}s"))


def missing_report(missing: DataFrame, k: int = 5) -> DataFrame:
    """Per (model, topic): number of missing tasks and the first k sorted ids."""
    counts = missing.groupBy("model", "topic").agg(F.count(F.lit(1)).alias("missing"))
    firsts = smallest_k(missing, ["model", "topic"], "persona_id", k)
    return counts.join(firsts, ["model", "topic"], "left")


def prompts_missing_for_any_model(prompts: DataFrame, done: DataFrame,
                                  target_models: DataFrame) -> DataFrame:
    """Prompts (topic, persona_id, prompt) lacking an answer from any target model.

    With an empty target model list nothing is missing.
    """
    from .grid import task_grid

    grid = task_grid(prompts.select("topic", "persona_id"), target_models)
    miss = missing_tasks(grid, done)
    return prompts.join(miss.select("topic", "persona_id").distinct(),
                        ["topic", "persona_id"], "left_semi")


def resume_status(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Totals of a resume: expected, completed, missing, rate, personas to retry."""
    d = done.select(*KEYS).distinct().withColumn("_done", F.lit(True))
    j = tasks.select(*KEYS).distinct().join(d, KEYS, "left")
    got = F.col("_done").isNotNull()
    agg = j.agg(F.count(F.lit(1)).alias("total"), F.count_if(got).alias("completed"),
                F.count_if(~got).alias("missing"))
    retry = (j.where(~got).select("topic", "persona_id").distinct()
              .agg(F.count(F.lit(1))).scalar())
    return agg.select("total", "completed", "missing",
                      F.when(F.col("total") > 0, F.col("completed") / F.col("total"))
                       .otherwise(F.lit(0.0)).alias("completion_rate"),
                      retry.alias("personas_to_retry"))


def merge_results(existing: DataFrame, new: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Full outer merge: an existing answer wins, a new one only fills a gap."""
    keys = list(keys)
    old = existing.select(*keys, F.col("response").alias("_old"))
    nw = new.select(*keys, F.col("response").alias("_new"))
    j = old.join(nw, keys, "full_outer")
    return j.select(*keys, F.coalesce("_old", "_new").alias("response"),
                    F.when(F.col("_old").isNotNull(), "existing").otherwise("new").alias("source"))


def combinations_for_models(results: DataFrame, models: DataFrame) -> DataFrame:
    """Number of (model, topic, persona) answers for the listed models."""
    return results.join(models.select("model").distinct(), "model", "left_semi").agg(
        F.count(F.lit(1)).alias("combinations"))


def fill_placeholders(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Every task with its answer; a still-missing task gets the fixed error text."""
    r = results.select(*KEYS, F.col("response").alias("_r"), F.col("success").alias("_s"),
                       F.col("tokens").alias("_t"))
    j = tasks.select(*KEYS).join(r, KEYS, "left")
    miss = F.col("_r").isNull()
    return j.select(*KEYS, F.when(miss, F.lit(PLACEHOLDER)).otherwise(F.col("_r")).alias("response"),
                    F.when(miss, F.lit(False)).otherwise(F.col("_s")).alias("success"),
                    F.when(miss, F.lit(0)).otherwise(F.col("_t")).cast("int").alias("tokens"),
                    miss.alias("placeholder"))


def last_answer_wins(attempts: DataFrame, keys: Sequence[str] = KEYS,
                     order: str = "seq") -> DataFrame:
    """One row per key: the attempt with the largest ``order`` value.

    A grouped ``max_by`` (partial aggregation before the shuffle, no window).
    """
    keys = list(keys)
    payload = [c for c in attempts.columns if c not in keys]
    pick = F.max_by(F.struct(*payload), F.col(order)).alias("_last")
    return attempts.groupBy(*keys).agg(pick).select(*keys, "_last.*")


def attempt_caps(attempts: DataFrame, max_retries: int, keys: Sequence[str] = KEYS,
                 order: str = "seq") -> DataFrame:
    """Attempt number per task; attempts beyond 1 + max_retries are flagged.

    The window is per task key, whose size is the number of attempts of one
    task.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.row_number().over(w)
    return attempts.withColumn("attempt", n.cast("int")).withColumn(
        "beyond_cap", F.col("attempt") > F.lit(1 + max_retries))


def retry_queue(attempts: DataFrame, max_retries: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Tasks whose latest attempt failed or is invalid and still have retries left.

    Ordered by priority (rate limit first), then sequence.
    """
    last = last_answer_wins(attempts, keys)
    tries = attempts.groupBy(*keys).agg(F.count(F.lit(1)).alias("tries"))
    bad = ~F.coalesce(F.col("success"), F.lit(False)) | ~is_valid(F.col("response"))
    q = last.where(bad).join(tries, list(keys))
    q = q.where(F.col("tries") <= max_retries).withColumn(
        "priority", retry_priority(F.col("response")))
    return q.select(*keys, "seq", "tries", "priority").orderBy("priority", "seq", *keys)


def final_report(results: DataFrame, expected: DataFrame, elapsed_seconds: float | None = None) -> DataFrame:
    """Processed, valid successes, failed, tokens, coverage and grade."""
    ok = F.coalesce(F.col("success"), F.lit(False)) & is_valid(F.col("response"))
    agg = results.agg(F.count(F.lit(1)).alias("processed"),
                      F.count_if(ok).alias("successful"),
                      F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total_tokens"))
    completed = results.select(*KEYS).distinct().agg(F.count(F.lit(1))).scalar()
    exp = expected.select(*KEYS).distinct().agg(F.count(F.lit(1))).scalar()
    cov = F.when(exp > 0, completed / exp * 100.0).otherwise(F.lit(0.0))
    rate = F.when(F.col("processed") > 0, F.col("successful") / F.col("processed")).otherwise(F.lit(0.0))
    out = agg.select("processed", "successful",
                     (F.col("processed") - F.col("successful")).alias("failed"), "total_tokens",
                     completed.alias("completed"), exp.alias("expected"),
                     cov.alias("coverage_pct"), rate.alias("success_rate"))
    out = out.withColumn("grade", coverage_grade(F.col("coverage_pct"), F.col("success_rate")))
    if elapsed_seconds:
        out = out.withColumn("queries_per_second", F.col("processed") / F.lit(float(elapsed_seconds)))
    return out


def grades_by(results: DataFrame, expected: DataFrame, by: Sequence[str], ok_col: str = "success") -> DataFrame:
    """Per ``by`` group of the expected tasks: completed and successful tasks, coverage, success rate and grade.

    A task with several rows counts once, as a success if any of them is one
    (null: not a success); results outside the expected tasks do not count.
    """
    by = list(by)
    got = results.groupBy(*KEYS).agg(F.max(F.coalesce(F.col(ok_col), F.lit(False))).alias("_ok"))
    j = expected.select(*KEYS).distinct().join(got, KEYS, "left")
    g = j.groupBy(*by).agg(F.count(F.lit(1)).alias("expected"), F.count("_ok").alias("completed"),
                           F.count_if(F.coalesce("_ok", F.lit(False))).alias("successful"))
    rate = F.when(F.col("completed") > 0, F.col("successful") / F.col("completed")).otherwise(F.lit(0.0))
    g = g.withColumn("coverage_pct", F.col("completed") * 100.0 / F.col("expected")).withColumn("success_rate", rate)
    return g.withColumn("grade", coverage_grade(F.col("coverage_pct"), F.col("success_rate")))


def batch_summary(attempts: DataFrame, batch_col: str = "batch") -> DataFrame:
    """Per batch: successes (valid ones when answer text is present), failed, tokens."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    if "response" in attempts.columns:
        ok = ok & is_valid(F.col("response"))
    return attempts.groupBy(batch_col).agg(
        F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"))


def retry_round_summary(attempts: DataFrame, round_col: str = "retry_round") -> DataFrame:
    """Per retry round: recovered (success), still failed, recovery rate."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    s = attempts.groupBy(round_col).agg(F.count_if(ok).alias("recovered"),
                                        F.count_if(~ok).alias("still_failed"))
    tot = F.col("recovered") + F.col("still_failed")
    return s.withColumn("recovery_rate", F.when(tot > 0, F.col("recovered") / tot))


def response_counts(results: DataFrame) -> DataFrame:
    """Answers per model."""
    return results.groupBy("model").agg(F.count(F.lit(1)).alias("responses"))


def topic_counts(results: DataFrame, n_models: int | None = None) -> DataFrame:
    """Answers per topic, and personas per topic as answers // models."""
    per = results.groupBy("topic").agg(F.count(F.lit(1)).alias("queries"))
    nm = results.select("model").distinct().agg(F.count(F.lit(1))).scalar() if n_models is None \
        else F.lit(n_models)
    return per.withColumn("personas", F.when(nm > 0, F.floor(F.col("queries") / nm)).cast("long"))

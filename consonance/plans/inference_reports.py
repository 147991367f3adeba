"""Answering the task grid with a deterministic local answer function.

The answer function (``operators.inference.template_answerer``) stands in for
a model API; it is SQL-expressible, so the oracle recomputes every attempt.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.validity import EMPTY_OR_INVALID, PLACEHOLDER
from ..operators import central, grid, inference, moments, text_vectors
from . import views
from .attempt_reports import reason_sql
from .registry import oracle, register, sql_text
from .task_reports import _prompts, _with


def _text(a: str) -> str:
    return ("'Fact 1: ' || topic || ' as asked by persona ' || persona_id || '. Fact 2: answered by ' || model"
            f" || ' on attempt {a} for a prompt of ' || CAST(length(prompt) AS VARCHAR) || ' characters.'")


def _attempt_sql(a: int) -> str:
    """(response, success, tokens) columns of attempt ``a`` after normalisation."""
    fail = f"(CAST(persona_id AS BIGINT) * 7 + {a} * 3 + length(model)) % 5 = 0"
    txt = _text(str(a))
    return f"""CASE WHEN {fail} THEN NULL ELSE {txt} END AS t{a}"""


_GRID = """, g AS (SELECT m.model, p.topic, p.persona_id, p.prompt FROM prompts p,
  (SELECT DISTINCT model FROM models WHERE model IS NOT NULL) m)"""


def _normalised(a: int, src: str = "g") -> str:
    r8 = reason_sql(f"t{a}", "8")
    return f""", a{a} AS (SELECT model, topic, persona_id,
  CASE WHEN t{a} IS NULL OR ({r8}) IS NOT NULL THEN {sql_text(EMPTY_OR_INVALID)} ELSE t{a} END AS r{a},
  t{a} IS NOT NULL AND ({r8}) IS NULL AS s{a},
  CAST(CASE WHEN t{a} IS NOT NULL AND ({r8}) IS NULL THEN length(t{a}) // 4 ELSE 0 END AS INTEGER) AS k{a}
  FROM (SELECT *, {_attempt_sql(a)} FROM {src}))"""


@register("answered_tasks", oracle(_with(_GRID + _normalised(1) + """
SELECT model, topic, persona_id, 1 AS attempt, r1 AS response, s1 AS success, k1 AS tokens FROM a1""",
    "personas", "topics", "models"), ["model", "topic", "persona_id", "attempt", "response", "success", "tokens"]),
    ["R1", "P18"])
def q_answered_tasks(spark, sf_dir):
    """Every task of the grid answered once on the executors, outcomes normalised."""
    t = grid.task_grid(_prompts(spark, sf_dir), views.models(spark, sf_dir))
    return inference.answer_tasks(t, lambda: inference.template_answerer(5), 1)


_R11 = reason_sql("r1", "11")
_RETRY_SQL = _GRID + _normalised(1) + _normalised(2) + _normalised(3) + _normalised(4) + f"""
, j AS (SELECT a1.*, r2, s2, k2, r3, s3, k3, r4, s4, k4 FROM a1
   JOIN a2 USING (model, topic, persona_id) JOIN a3 USING (model, topic, persona_id)
   JOIN a4 USING (model, topic, persona_id))
SELECT model, topic, persona_id,
  CASE WHEN s1 AND ({_R11}) IS NULL THEN r1 WHEN s2 THEN r2 WHEN s3 THEN r3 WHEN s4 THEN r4 ELSE r1 END AS response,
  CASE WHEN s1 AND ({_R11}) IS NULL THEN s1 WHEN s2 THEN s2 WHEN s3 THEN s3 WHEN s4 THEN s4 ELSE s1 END AS success,
  CASE WHEN s1 AND ({_R11}) IS NULL THEN k1 WHEN s2 THEN k2 WHEN s3 THEN k3 WHEN s4 THEN k4 ELSE k1 END AS tokens,
  false AS placeholder
FROM j"""


@register("retry_rounds", oracle(_with(_RETRY_SQL, "personas", "topics", "models"),
    ["model", "topic", "persona_id", "response", "success", "tokens", "placeholder"]),
    ["R2", "R3", "J10", "U2"])
def q_retry_rounds(spark, sf_dir):
    """First round, three retry rounds (recovered on success), recovery, placeholders."""
    t = grid.task_grid(_prompts(spark, sf_dir), views.models(spark, sf_dir))
    att = inference.run_with_retries(t, lambda: inference.template_answerer(5), 3)
    return inference.final_answers(t, att)


@register("retry_round_outcomes", None, ["A18", "R2"])
def q_retry_round_outcomes(spark, sf_dir):
    """Per stage of the retry run: attempts, recovered and still failed."""
    t = grid.task_grid(_prompts(spark, sf_dir), views.models(spark, sf_dir))
    att = inference.run_with_retries(t, lambda: inference.template_answerer(5), 3)
    return att.groupBy("stage").agg(F.count(F.lit(1)).alias("attempts"),
                                    F.count_if("success").alias("recovered"),
                                    F.count_if(~F.col("success")).alias("still_failed"))


@register("control_experiment", oracle(_with("""
, base AS (SELECT * FROM prompts WHERE topic = (SELECT min(topic) FROM prompts)
    AND persona_id = (SELECT CAST(min(CAST(persona_id AS BIGINT)) AS VARCHAR) FROM prompts)),
reps AS (SELECT topic, persona_id || '_rep' || CAST(r AS VARCHAR) AS persona_id, prompt FROM base, range(1, 11) q(r)),
g AS (SELECT m.model, reps.topic, reps.persona_id, reps.prompt FROM reps,
  (SELECT DISTINCT model FROM models WHERE model IS NOT NULL) m)""".replace(
    "persona_id || '_rep'", "persona_id || '_rep'") + _normalised(1).replace(
    "CAST(persona_id AS BIGINT)", "CAST(split_part(persona_id, '_rep', 1) AS BIGINT)").replace(
    "' as asked by persona ' || persona_id", "' as asked by persona ' || split_part(persona_id, '_rep', 1)") + """
SELECT model, topic, persona_id, r1 AS response, s1 AS success, k1 AS tokens FROM a1""",
    "personas", "topics", "models"), ["model", "topic", "persona_id", "response", "success", "tokens"]),
    ["R5", "P8"])
def q_control_experiment(spark, sf_dir):
    """Control run: the first persona's first-topic prompt, 10 repetitions, every model."""
    p = _prompts(spark, sf_dir)
    first_topic = p.agg(F.min("topic")).scalar()
    first_id = p.agg(F.min(F.col("persona_id").cast("bigint"))).scalar().cast("string")
    base = p.where((F.col("topic") == first_topic) & (F.col("persona_id") == first_id))
    t = inference.control_tasks(base, views.models(spark, sf_dir), 10)

    def factory():
        inner = inference.template_answerer(5)
        # repetitions answer as their base persona
        return lambda m, tp, pid, pr, a: inner(m, tp, str(pid).split("_rep")[0], pr, a)

    return inference.answer_tasks(t, factory, 1).select("model", "topic", "persona_id", "response",
                                                         "success", "tokens")


@register("main_run_ranking", None, ["R6"])
def q_main_run_ranking(spark, sf_dir):
    """Prompts -> grid -> answers (retries) -> per-group TF-IDF -> similarity -> model ranking."""
    t = grid.task_grid(_prompts(spark, sf_dir), views.models(spark, sf_dir))
    att = inference.run_with_retries(t, lambda: inference.template_answerer(5), 3)
    # the vocabulary, the weights and the sizes read the answers: merged once
    ans = inference._persist_round(inference.final_answers(t, att), "answers")
    w = text_vectors.tfidf_weights(ans)
    sizes = ans.groupBy("model", "topic").count().withColumnRenamed("count", "n")
    # pairs of small groups, the closed form of large ones: all pairs would grow with the square of the personas
    m = text_vectors.tfidf_similarity_moments(w, sizes)
    ppt = central.per_model_per_topic(m)
    return central.model_overall_weighted(ppt)

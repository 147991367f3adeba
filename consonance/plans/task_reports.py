"""Personas, prompts, task grids and completeness accounting.

Inputs: the ``personas``, ``topics``, ``models``, ``tasks``, ``done`` and
``attempts`` views. Oracles: DuckDB over the same views.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.prompts import PERSONA_DEFAULTS, PERSONA_DETAILS_TEMPLATE, PROMPT_TEMPLATE
from ..functions.validity import PLACEHOLDER
from ..operators import coverage, grid, personas
from . import views
from .registry import oracle, register, sql_format, sql_text


def _d(col: str, present: bool = True) -> str:
    default = sql_text(PERSONA_DEFAULTS[col])
    return f"coalesce(CAST({col} AS VARCHAR), {default})" if present else default


_DETAILS_SQL = sql_format(PERSONA_DETAILS_TEMPLATE, _d("age"), _d("sex"), _d("city"), _d("state"),
                          _d("occupation"), _d("education_level"), _d("persona"),
                          _d("cultural_background", present=False), _d("professional_persona"))
PROMPTS_SQL = f"""prompts AS (
  SELECT t.topic, p.persona_id, {sql_format(PROMPT_TEMPLATE, _DETAILS_SQL, 't.topic')} AS prompt
  FROM personas p, (SELECT DISTINCT topic FROM topics WHERE topic IS NOT NULL) t
  WHERE p.persona IS NOT NULL AND p.professional_persona IS NOT NULL)"""


def _with(body: str, *names: str) -> str:
    """WITH clause defining the named views (and ``prompts``) ahead of ``body``."""
    from .views import with_views
    base = with_views("SELECT 1", *names)[len("WITH "):-len("\nSELECT 1")]
    return f"WITH {base},\n{PROMPTS_SQL}\n{body}"


def _prompts(spark, sf_dir):
    return personas.prompts(views.personas(spark, sf_dir), views.topics(spark, sf_dir))


@register("prompts", oracle(_with("SELECT topic, persona_id, prompt FROM prompts", "personas", "topics"),
                            ["topic", "persona_id", "prompt"]), ["P3", "P4", "P5", "P6", "P7", "J1"])
def q_prompts(spark, sf_dir):
    """Prompt for every persona with the required fields and every distinct topic."""
    return _prompts(spark, sf_dir)


@register("topic_prompt_counts", oracle(_with("""
SELECT t.topic, CAST(count(p.persona_id) AS BIGINT) AS prompts
FROM (SELECT DISTINCT topic FROM topics) t LEFT JOIN prompts p ON t.topic = p.topic GROUP BY t.topic""",
    "personas", "topics"), ["topic", "prompts"]), ["P7"])
def q_topic_prompt_counts(spark, sf_dir):
    """Prompts per distinct topic (a topic without personas keeps 0)."""
    return personas.topic_prompt_counts(_prompts(spark, sf_dir), views.topics(spark, sf_dir))


@register("control_prompts", oracle(_with("""
, base AS (SELECT * FROM prompts
  WHERE topic = (SELECT min(topic) FROM prompts)
    AND persona_id = (SELECT CAST(min(CAST(persona_id AS BIGINT)) AS VARCHAR) FROM prompts))
SELECT topic, persona_id || '_rep' || CAST(r AS VARCHAR) AS persona_id, CAST(r AS INTEGER) AS rep, prompt
FROM base, range(1, 11) g(r)""", "personas", "topics"), ["topic", "persona_id", "rep", "prompt"]), ["P8"])
def q_control_prompts(spark, sf_dir):
    """The first persona's prompt on the first topic, repeated 10 times (uuid_repN ids)."""
    p = _prompts(spark, sf_dir)
    first_topic = p.agg(F.min("topic")).scalar()
    first_id = p.agg(F.min(F.col("persona_id").cast("bigint"))).scalar().cast("string")
    base = p.where((F.col("topic") == first_topic) & (F.col("persona_id") == first_id))
    return personas.control_prompts(base, 10)


@register("task_grid", oracle(_with("""
SELECT m.model, p.topic, p.persona_id, p.prompt FROM prompts p,
  (SELECT DISTINCT model FROM models WHERE model IS NOT NULL) m""", "personas", "topics", "models"),
    ["model", "topic", "persona_id", "prompt"]), ["J2"])
def q_task_grid(spark, sf_dir):
    """Prompts times models (models innermost), prompt attached."""
    return grid.task_grid(_prompts(spark, sf_dir), views.models(spark, sf_dir))


@register("batch_numbers", oracle(_with("""
SELECT model, topic, persona_id, CAST(position AS BIGINT) AS position, CAST(position // 100 AS BIGINT) AS batch
FROM (SELECT model, topic, persona_id, row_number() OVER (ORDER BY topic, persona_id, model) - 1 AS position
      FROM tasks)""", "tasks"), ["model", "topic", "persona_id", "position", "batch"]), ["W12"])
def q_batch_numbers(spark, sf_dir):
    """Grid position and batch number at batch size 100 (distributed dense index)."""
    return grid.batch_numbers(views.tasks(spark, sf_dir), 100)


@register("experiment_size", oracle(_with("""
SELECT CAST(np AS BIGINT) AS personas, CAST(nt AS BIGINT) AS topics, CAST(nm AS BIGINT) AS models,
  CAST(np * nt * nm AS BIGINT) AS calls, np * nt * nm / 10.0 / 60.0 AS estimated_minutes
FROM (SELECT count(*) AS np FROM personas), (SELECT count(DISTINCT topic) AS nt FROM topics),
     (SELECT count(DISTINCT model) AS nm FROM models)""", "personas", "topics", "models"),
    ["personas", "topics", "models", "calls", "estimated_minutes"], ["estimated_minutes"]), ["P28"])
def q_experiment_size(spark, sf_dir):
    """Number of calls of the main experiment and minutes at 10 calls per second."""
    return grid.experiment_size(views.personas(spark, sf_dir), views.topics(spark, sf_dir),
                                views.models(spark, sf_dir))


@register("persona_numbering", oracle(_with("""
SELECT CAST(persona_id AS BIGINT) AS row_idx, CAST(row_number() OVER (ORDER BY CAST(persona_id AS BIGINT)) AS VARCHAR)
  AS uuid, persona FROM personas""", "personas"), ["row_idx", "uuid", "persona"]), ["P1", "P2"])
def q_persona_numbering(spark, sf_dir):
    """Personas numbered 1..n in source order, listed fields dropped."""
    p = views.personas(spark, sf_dir)
    entries = p.select(F.col("persona_id").cast("bigint").alias("row_idx"),
                       F.struct(*[c for c in p.columns]).alias("row"))
    out = personas.number_personas(entries, "row_idx", "uuid")
    return out.select("row_idx", "uuid", "persona")


@register("persona_preview", oracle(_with("""
SELECT persona_id, substr(persona, 1, 100) AS persona_preview FROM personas
ORDER BY CAST(persona_id AS BIGINT) LIMIT 1""", "personas"), ["persona_id", "persona_preview"]), ["P29"])
def q_persona_preview(spark, sf_dir):
    """The first persona with its text cut at 100 characters."""
    return personas.preview(views.personas(spark, sf_dir))


@register("missing_tasks", oracle(_with("""
SELECT t.model, t.topic, t.persona_id FROM tasks t
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.model = t.model AND d.topic = t.topic
                  AND d.persona_id = t.persona_id)""", "done"), ["model", "topic", "persona_id"]),
    ["J3", "U1"])
def q_missing_tasks(spark, sf_dir):
    """Expected tasks without a completed answer."""
    return coverage.missing_tasks(views.tasks(spark, sf_dir), views.done(spark, sf_dir))


@register("missing_report", oracle(_with("""
, miss AS (SELECT t.model, t.topic, t.persona_id FROM tasks t ANTI JOIN done d
           ON d.model = t.model AND d.topic = t.topic AND d.persona_id = t.persona_id)
SELECT model, topic, CAST(count(*) AS BIGINT) AS missing,
  array_to_string(list_sort(list(persona_id ORDER BY persona_id)[1:5]), ',') AS first_persona_ids
FROM miss GROUP BY model, topic""", "done"), ["model", "topic", "missing", "first_persona_ids"]), ["J4"])
def q_missing_report(spark, sf_dir):
    """Missing count and first five sorted ids per (model, topic)."""
    miss = coverage.missing_tasks(views.tasks(spark, sf_dir), views.done(spark, sf_dir))
    return coverage.missing_report(miss, 5)


@register("prompts_missing_any_model", oracle(_with("""
SELECT p.topic, p.persona_id, p.prompt FROM prompts p
WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT model FROM models) m
              WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.model = m.model AND d.topic = p.topic
                                AND d.persona_id = p.persona_id))""", "personas", "topics", "models", "done"),
    ["topic", "persona_id", "prompt"]), ["J5"])
def q_prompts_missing_any_model(spark, sf_dir):
    """Prompts that lack an answer from at least one target model."""
    return coverage.prompts_missing_for_any_model(_prompts(spark, sf_dir), views.done(spark, sf_dir),
                                                  views.models(spark, sf_dir))


@register("prompts_missing_no_target", oracle(_with("""
SELECT topic, persona_id, prompt FROM prompts WHERE false""", "personas", "topics"),
    ["topic", "persona_id", "prompt"]), ["J6"])
def q_prompts_missing_no_target(spark, sf_dir):
    """Legacy variant without target models: nothing counts as missing."""
    no_models = views.models(spark, sf_dir).where(F.lit(False))
    return coverage.prompts_missing_for_any_model(_prompts(spark, sf_dir), views.done(spark, sf_dir),
                                                  no_models)


@register("resume_status", oracle(_with("""
, j AS (SELECT t.*, d.model IS NOT NULL AS got FROM tasks t LEFT JOIN (SELECT DISTINCT model, topic, persona_id FROM done) d
        ON d.model = t.model AND d.topic = t.topic AND d.persona_id = t.persona_id)
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count_if(got) AS BIGINT) AS completed,
  CAST(count_if(NOT got) AS BIGINT) AS missing, count_if(got) / count(*) AS completion_rate,
  (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT topic, persona_id FROM j WHERE NOT got))
    AS personas_to_retry
FROM j""", "done"), ["total", "completed", "missing", "completion_rate", "personas_to_retry"],
    ["completion_rate"]), ["J7"])
def q_resume_status(spark, sf_dir):
    """Resume totals: expected, completed, missing, rate, prompts to retry."""
    return coverage.resume_status(views.tasks(spark, sf_dir), views.done(spark, sf_dir))


@register("merge_results", oracle(_with("""
, nw AS (SELECT model, topic, persona_id, 'new ' || persona_id AS response FROM tasks
         WHERE (CAST(persona_id AS BIGINT) + length(topic)) % 3 = 0)
SELECT coalesce(d.model, n.model) AS model, coalesce(d.topic, n.topic) AS topic,
  coalesce(d.persona_id, n.persona_id) AS persona_id, coalesce(d.response, n.response) AS response,
  CASE WHEN d.response IS NOT NULL THEN 'existing' ELSE 'new' END AS source
FROM done d FULL OUTER JOIN nw n ON d.model = n.model AND d.topic = n.topic AND d.persona_id = n.persona_id""",
    "done"), ["model", "topic", "persona_id", "response", "source"]), ["J8"])
def q_merge_results(spark, sf_dir):
    """Resume merge: existing answers win; new answers only fill gaps."""
    t = views.tasks(spark, sf_dir)
    new = t.where((F.col("persona_id").cast("bigint") + F.length("topic")) % 3 == 0).select(
        "model", "topic", "persona_id", F.concat(F.lit("new "), F.col("persona_id")).alias("response"))
    return coverage.merge_results(views.done(spark, sf_dir), new)


@register("combinations_for_models", oracle(_with("""
SELECT CAST(count(*) AS BIGINT) AS combinations FROM done
WHERE model IN (SELECT model FROM models)""", "done"), ["combinations"]), ["J9"])
def q_combinations_for_models(spark, sf_dir):
    """Final number of answers for the listed models."""
    return coverage.combinations_for_models(views.done(spark, sf_dir), views.models(spark, sf_dir))


@register("fill_placeholders", oracle(_with(f"""
SELECT t.model, t.topic, t.persona_id, coalesce(d.response, {sql_text(PLACEHOLDER)}) AS response,
  d.response IS NOT NULL AS success, CAST(CASE WHEN d.response IS NULL THEN 0 ELSE length(d.response) END AS INTEGER)
  AS tokens, d.response IS NULL AS placeholder
FROM tasks t LEFT JOIN done d ON d.model = t.model AND d.topic = t.topic AND d.persona_id = t.persona_id""",
    "done"), ["model", "topic", "persona_id", "response", "success", "tokens", "placeholder"]), ["J10"])
def q_fill_placeholders(spark, sf_dir):
    """Every task with its answer or the fixed placeholder error text."""
    d = views.done(spark, sf_dir).select("model", "topic", "persona_id", "response",
                                         F.lit(True).alias("success"),
                                         F.length("response").cast("int").alias("tokens"))
    return coverage.fill_placeholders(views.tasks(spark, sf_dir), d)


@register("control_size", oracle(_with("""
SELECT CAST(10 AS BIGINT) AS repetitions, CAST(count(DISTINCT model) AS BIGINT) AS models,
  CAST(10 * count(DISTINCT model) AS BIGINT) AS calls, 10 * count(DISTINCT model) / 10.0 / 60.0 AS estimated_minutes
FROM models""", "models"), ["repetitions", "models", "calls", "estimated_minutes"], ["estimated_minutes"]), ["P28"])
def q_control_size(spark, sf_dir):
    """Number of calls of the control experiment (10 repetitions x models) and minutes at 10 per second."""
    return grid.control_size(views.models(spark, sf_dir), 10)

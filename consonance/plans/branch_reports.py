"""Queries whose input reaches every branch of specs, request plans, grades and persona entries.

The inputs are derived from ``supplier`` (specs and prompts) and from the
``personas``, ``tasks`` and ``done`` views.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import specs
from ..functions.prompts import DROPPED_PERSONA_FIELDS
from ..operators import coverage, personas
from ..sources.tables import table
from . import views
from .registry import oracle, register, sql_text
from .task_reports import _with

#: specs asked in turn: both direct endpoints, all three token fields, no provider, three segments, unsafe characters
SPECS = ["openai/gpt-5-pro", "openai/gpt-5-2025-08-07", "openai/o3-mini", "openai/gpt-4o", "OpenAI/chat model:free",
         "vendor/gpt-5-nano", "plain-model", "vendor/family/it's ok?", "router/openai/o1"]


def _asked(spark, sf_dir):
    """(s_suppkey, spec, prompt): every supplier asks one of ``SPECS``."""
    s = table(spark, sf_dir, "supplier")
    at = (F.col("s_suppkey") % len(SPECS)).cast("int") + 1
    return s.select("s_suppkey", F.element_at(F.array(*map(F.lit, SPECS)), at).alias("spec"), F.col("s_name").alias("prompt"))


def _asked_sql(body: str) -> str:
    def any_in(needles):
        return " OR ".join(f"contains(model_name, {sql_text(n)})" for n in needles)

    chosen = " ".join(f"WHEN s_suppkey % {len(SPECS)} = {i} THEN {sql_text(x)}" for i, x in enumerate(SPECS))
    return f"""WITH a AS (SELECT s_suppkey, CASE {chosen} END AS spec, s_name AS prompt FROM supplier),
b AS (SELECT *, contains(lower(spec), 'openai') AS direct,
  CASE WHEN contains(spec, '/') THEN split_part(spec, '/', 1) ELSE '' END AS provider,
  CASE WHEN contains(spec, '/') THEN split_part(spec, '/', 2) ELSE spec END AS model_name FROM a),
c AS (SELECT *, CASE WHEN direct AND ({any_in(specs.RESPONSES_ONLY_MODELS)}) THEN 'responses' ELSE 'chat/completions' END
  AS endpoint, CASE WHEN direct THEN model_name ELSE spec END AS sent FROM b),
d AS (SELECT *, CASE WHEN endpoint = 'responses' THEN 'max_output_tokens'
  WHEN direct AND ({any_in(specs.COMPLETION_TOKEN_MODELS)}) THEN 'max_completion_tokens' ELSE 'max_tokens' END AS token_field FROM c)
{body}"""


@register("spec_branches", oracle(_asked_sql("""
SELECT spec, provider, model_name, regexp_extract(spec, '[^/]*$') AS label, CASE WHEN direct THEN 'openai' ELSE 'openrouter' END AS route,
  regexp_replace(replace(replace(replace(spec, '/', '_'), ':', '_'), ' ', '_'), '[?'']', '', 'g') AS file_label,
  CAST(count(*) AS BIGINT) AS suppliers
FROM d GROUP BY ALL"""), ["spec", "provider", "model_name", "label", "route", "file_label", "suppliers"]),
    ["P9", "P10", "P11", "P12", "P26"])
def q_spec_branches(spark, sf_dir):
    """Parts of every spec: without provider, with three segments, on both routes, with characters unsafe in file names."""
    s = F.col("spec")
    return _asked(spark, sf_dir).select(
        "spec", specs.provider(s).alias("provider"), specs.model_name(s).alias("model_name"), specs.short_label(s).alias("label"),
        specs.route(s).alias("route"), specs.file_safe(s).alias("file_label")).groupBy(
        "spec", "provider", "model_name", "label", "route", "file_label").agg(F.count(F.lit(1)).alias("suppliers"))


_MESSAGES = "[{'role': 'user', 'content': prompt}]"


@register("request_branches", oracle(_asked_sql(f"""
SELECT s_suppkey, spec, endpoint, token_field, CAST(CASE token_field
  WHEN 'max_output_tokens' THEN to_json({{'model': sent, 'input': prompt, 'max_output_tokens': {specs.MAX_TOKENS}}})
  WHEN 'max_completion_tokens' THEN to_json({{'model': sent, 'messages': {_MESSAGES}, 'max_completion_tokens': {specs.MAX_TOKENS}}})
  ELSE to_json({{'model': sent, 'messages': {_MESSAGES}, 'max_tokens': {specs.MAX_TOKENS}}}) END AS VARCHAR) AS body FROM d"""),
    ["s_suppkey", "spec", "endpoint", "token_field", "body"]), ["P12", "P13"])
def q_request_branches(spark, sf_dir):
    """Request plan of every supplier's prompt, over both endpoints of the direct route and all token fields."""
    s = F.col("spec")
    return _asked(spark, sf_dir).select("s_suppkey", "spec", specs.endpoint(s).alias("endpoint"),
                                        specs.token_field(s).alias("token_field"),
                                        specs.request_body(s, F.col("prompt")).alias("body"))


_FAILS = "(CAST(persona_id AS BIGINT) * 3 + length(model) * 5 + length(topic)) % 61"


@register("persona_grades", oracle(_with(f"""
, keep AS (SELECT persona_id, model, topic, {_FAILS} <> 0 AS ok FROM tasks
    WHERE CAST(persona_id AS BIGINT) % 3 <> 0 OR (CAST(persona_id AS BIGINT) + length(model) * 3 + length(topic)) % 17 <> 0),
 g AS (SELECT t.persona_id, count(*) AS expected, count(k.persona_id) AS completed, count(*) FILTER (k.ok) AS successful
       FROM tasks t LEFT JOIN keep k ON t.persona_id = k.persona_id AND t.model = k.model AND t.topic = k.topic GROUP BY t.persona_id),
 r AS (SELECT *, completed * 100.0 / expected AS coverage_pct,
         CASE WHEN completed > 0 THEN successful / completed ELSE 0.0 END AS success_rate FROM g)
SELECT persona_id, CAST(expected AS BIGINT) AS expected, CAST(completed AS BIGINT) AS completed,
  CAST(successful AS BIGINT) AS successful, coverage_pct, success_rate,
  CASE WHEN completed = expected AND success_rate >= 0.99 THEN 'PERFECT' WHEN completed = expected AND success_rate >= 0.95
    THEN 'EXCELLENT' WHEN completed = expected THEN 'COMPLETE' WHEN coverage_pct >= 95 THEN 'GOOD' ELSE 'WARNING' END AS grade
FROM r""", "personas", "topics", "models", "tasks"),
    ["persona_id", "expected", "completed", "successful", "coverage_pct", "success_rate", "grade"],
    ["coverage_pct", "success_rate"]), ["P20", "A16"])
def q_persona_grades(spark, sf_dir):
    """Coverage, success rate and grade of every persona; the rules leave rows of all five grades."""
    t = views.tasks(spark, sf_dir)
    k, m, tp = F.col("persona_id").cast("bigint"), F.length("model"), F.length("topic")
    done = t.where((k % 3 != 0) | ((k + m * 3 + tp) % 17 != 0)).withColumn("success", (k * 3 + m * 5 + tp) % 61 != 0)
    return coverage.grades_by(done, t, ["persona_id"])


_ENTRY_FIELDS = ["age", "sex", "city", "persona", "professional_persona"]
_ENTRY_KEPT = [c for c in _ENTRY_FIELDS if c not in DROPPED_PERSONA_FIELDS]


@register("persona_entries", oracle(_with(f"""
, e AS (SELECT *, CAST(persona_id AS BIGINT) AS row_idx, CAST(persona_id AS BIGINT) % 5 <> 0 AS has_row FROM personas),
 n AS (SELECT row_idx, row_number() OVER (ORDER BY row_idx) AS seq FROM e WHERE has_row)
SELECT e.row_idx, CAST(n.seq AS VARCHAR) AS uuid,
  {', '.join(f'CASE WHEN has_row THEN {c} END AS {c}' for c in _ENTRY_KEPT)} FROM e LEFT JOIN n ON e.row_idx = n.row_idx""",
    "personas"), ["row_idx", "uuid", *_ENTRY_KEPT]), ["P1", "P2"])
def q_persona_entries(spark, sf_dir):
    """Entries with the dropped fields, every fifth without a row: the rows are numbered, the fields gone, the rest passes."""
    k = F.col("persona_id").cast("bigint")
    extra = [F.col("persona").alias(c) for c in DROPPED_PERSONA_FIELDS if c not in _ENTRY_FIELDS]
    row = F.struct(F.concat(F.lit("old-"), "persona_id").alias("uuid"), *_ENTRY_FIELDS, *extra)
    entries = views.personas(spark, sf_dir).select(k.alias("row_idx"), F.when(k % 5 != 0, row).alias("row"))
    return personas.number_personas(entries, "row_idx", "uuid")

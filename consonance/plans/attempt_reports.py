"""Attempt logs, request logs, answer validity and model specs.

Inputs: the ``attempts``, ``reqlog``, ``answers`` and ``models`` views.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import grades, specs, validity
from ..operators import coverage
from . import views
from .registry import oracle, register, sql_text
from .views import with_views

WS = validity.WS


def _contains_sql(col, patterns):
    return " OR ".join(f"contains(lower({col}), {sql_text(p)})" for p in patterns)


def reason_sql(col: str, patterns: str) -> str:
    """SQL of ``validity.invalid_reason`` for the text column ``col``."""
    trim = f"regexp_replace({col}, '^{WS}+|{WS}+$', '', 'g')"
    empty = f"({col} IS NULL OR length({col}) = 0 OR length({trim}) = 0)"
    short = f"length({trim}) < {validity.MIN_LENGTH}"
    noletter = f"NOT regexp_matches({col}, '\\p{{L}}')"
    if patterns == "8":
        return (f"CASE WHEN {empty} THEN 'empty' WHEN {short} THEN 'too_short' WHEN {noletter} THEN 'no_letter' "
                f"WHEN {_contains_sql(col, validity.ERROR_PATTERNS_8)} THEN 'error_phrase' END")
    return (f"CASE WHEN {empty} THEN 'empty' WHEN {short} THEN 'too_short' "
            f"WHEN {_contains_sql(col, validity.ERROR_PATTERNS_11)} THEN 'error_phrase' "
            f"WHEN {noletter} THEN 'no_letter' END")


REASON8 = reason_sql("response", "8")
REASON11 = reason_sql("response", "11")
PRIORITY = ("CASE WHEN contains(lower(coalesce(response, '')), 'rate limit') THEN 1 "
            "WHEN contains(lower(coalesce(response, '')), 'timeout') "
            "OR contains(lower(coalesce(response, '')), 'connection') THEN 2 ELSE 3 END")


@register("answer_validity", oracle(with_views(f"""
SELECT model, topic, persona_id, {REASON8} AS reason_8, {REASON11} AS reason_11,
  ({REASON8}) IS NULL AS valid_8, ({REASON11}) IS NULL AS valid_11 FROM answers""", "answers"),
    ["model", "topic", "persona_id", "reason_8", "reason_11", "valid_8", "valid_11"]), ["P16", "P17"])
def q_answer_validity(spark, sf_dir):
    """Both validity checks with the reason of the first failing rule (whole texts)."""
    a = views.answers(spark, sf_dir).select("model", "topic", "persona_id", "response")
    v = validity.with_validity(a, "response")
    return v.select("model", "topic", "persona_id", "reason_8", "reason_11",
                    F.col("reason_8").isNull().alias("valid_8"),
                    F.col("reason_11").isNull().alias("valid_11"))


@register("answer_outcomes", oracle(with_views(f"""
, raw AS (SELECT model, topic, persona_id, response, tokens,
            CASE WHEN success THEN NULL ELSE 'HTTP 500: ' || 'server error' END AS error FROM answers)
SELECT model, topic, persona_id,
  CASE WHEN error IS NOT NULL THEN 'Error: ' || error
       WHEN ({REASON8}) IS NOT NULL THEN {sql_text(validity.EMPTY_OR_INVALID)} ELSE response END AS response,
  error IS NULL AND ({REASON8}) IS NULL AS success,
  CAST(CASE WHEN error IS NULL AND ({REASON8}) IS NULL THEN coalesce(tokens, 0) ELSE 0 END AS INTEGER) AS tokens
FROM raw""", "answers"), ["model", "topic", "persona_id", "response", "success", "tokens"]), ["P15", "P18"])
def q_answer_outcomes(spark, sf_dir):
    """Raw answer records normalised to (response, success, tokens).

    A failed answer of the view stands for an HTTP 500 with body 'server error'.
    """
    a = views.answers(spark, sf_dir)
    status = F.when(F.col("success"), F.lit(200)).otherwise(F.lit(500))
    err = specs.http_error(status, F.lit("server error"))
    o = validity.normalise_outcome(F.col("response"), err, F.col("tokens"), F.lit(True))
    return a.select("model", "topic", "persona_id", o.alias("o")).select(
        "model", "topic", "persona_id", "o.response", "o.success", "o.tokens")


@register("answer_extraction", oracle(with_views("""
, raw AS (SELECT persona_id,
    CASE WHEN CAST(persona_id AS BIGINT) % 3 = 0 THEN 'chat/completions' ELSE 'responses' END AS endpoint,
    CASE WHEN CAST(persona_id AS BIGINT) % 3 = 0
           THEN to_json({'choices': [{'message': {'content': response}}], 'usage': {'total_tokens': tokens}})
         WHEN CAST(persona_id AS BIGINT) % 3 = 1
           THEN to_json({'output_text': response, 'usage': {'total_tokens': tokens}})
         ELSE to_json({'output_text': '', 'output': [{'content': [{'text': response}]}]}) END AS raw
  FROM answers)
SELECT persona_id, endpoint,
  CASE WHEN endpoint = 'responses' THEN coalesce(nullif(json_extract_string(raw, '$.output_text'), ''),
         json_extract_string(raw, '$.output[0].content[0].text'), '')
       ELSE json_extract_string(raw, '$.choices[0].message.content') END AS answer,
  CAST(coalesce(CAST(json_extract_string(raw, '$.usage.total_tokens') AS INTEGER), 0) AS INTEGER) AS tokens
FROM raw""", "answers"), ["persona_id", "endpoint", "answer", "tokens"]), ["P14"])
def q_answer_extraction(spark, sf_dir):
    """Answer text and tokens parsed from raw chat / responses documents.

    The raw documents are shaped from the answers view in three layouts
    (chat, responses, responses with the output-array fallback, no usage).
    """
    a = views.answers(spark, sf_dir)
    k = F.col("persona_id").cast("bigint") % 3
    usage = F.struct(F.col("tokens").alias("total_tokens"))
    chat = F.to_json(F.struct(
        F.array(F.struct(F.struct(F.col("response").alias("content")).alias("message"))).alias("choices"),
        usage.alias("usage")))
    resp = F.to_json(F.struct(F.col("response").alias("output_text"), usage.alias("usage")))
    fallback = F.to_json(F.struct(F.lit("").alias("output_text"), F.array(F.struct(F.array(F.struct(
        F.col("response").alias("text"))).alias("content"))).alias("output")))
    raw = F.when(k == 0, chat).when(k == 1, resp).otherwise(fallback)
    ep = F.when(k == 0, "chat/completions").otherwise("responses")
    r = a.select("persona_id", ep.alias("endpoint"), raw.alias("raw"))
    return r.select("persona_id", "endpoint", specs.answer_text(F.col("raw"), F.col("endpoint")).alias("answer"),
                    specs.answer_tokens(F.col("raw")).alias("tokens"))


@register("model_specs", oracle(with_views("""
SELECT model, CASE WHEN contains(model, '/') THEN split_part(model, '/', 1) ELSE '' END AS provider,
  CASE WHEN contains(model, '/') THEN split_part(model, '/', 2) ELSE model END AS model_name,
  regexp_extract(model, '[^/]*$') AS label,
  CASE WHEN contains(lower(model), 'openai') THEN 'openai' ELSE 'openrouter' END AS route,
  regexp_replace(replace(replace(replace(model, '/', '_'), ':', '_'), ' ', '_'), '[?'']', '', 'g') AS file_label
FROM (SELECT model FROM models UNION SELECT model FROM (SELECT DISTINCT concat('vendor/u', CAST(user_id % 10 AS VARCHAR)) AS model FROM events))""",
    "models"), ["model", "provider", "model_name", "label", "route", "file_label"]),
    ["P9", "P10", "P11", "P12", "P26"])
def q_model_specs(spark, sf_dir):
    """Provider, model name, short label, route and file-safe label of every model spec."""
    m = views.models(spark, sf_dir).unionByName(views.reqlog(spark, sf_dir).select("model")).distinct()
    s = F.col("model")
    return m.select("model", specs.provider(s).alias("provider"), specs.model_name(s).alias("model_name"),
                    specs.short_label(s).alias("label"), specs.route(s).alias("route"),
                    specs.file_safe(s).alias("file_label"))


def _request_plans_sql() -> str:
    from .task_reports import _with

    def any_in(needles):
        return " OR ".join(f"contains(model_name, {sql_text(n)})" for n in needles)

    msgs = "[{'role': 'user', 'content': prompt}]"
    return oracle(_with(f"""
, m AS (SELECT DISTINCT model, contains(lower(model), 'openai') AS direct,
    CASE WHEN contains(model, '/') THEN split_part(model, '/', 2) ELSE model END AS model_name
  FROM models WHERE model IS NOT NULL),
 e AS (SELECT *, CASE WHEN direct THEN model_name ELSE model END AS sent,
    CASE WHEN direct AND ({any_in(specs.RESPONSES_ONLY_MODELS)}) THEN 'responses' ELSE 'chat/completions' END AS endpoint
  FROM m),
 f AS (SELECT *, CASE WHEN endpoint = 'responses' THEN 'max_output_tokens'
    WHEN direct AND ({any_in(specs.COMPLETION_TOKEN_MODELS)}) THEN 'max_completion_tokens'
    ELSE 'max_tokens' END AS token_field FROM e)
SELECT f.model, p.topic, p.persona_id, f.endpoint, f.token_field, CAST(CASE f.token_field
    WHEN 'max_output_tokens' THEN to_json({{'model': sent, 'input': prompt, 'max_output_tokens': {specs.MAX_TOKENS}}})
    WHEN 'max_completion_tokens' THEN to_json({{'model': sent, 'messages': {msgs}, 'max_completion_tokens': {specs.MAX_TOKENS}}})
    ELSE to_json({{'model': sent, 'messages': {msgs}, 'max_tokens': {specs.MAX_TOKENS}}}) END AS VARCHAR) AS body
FROM prompts p, f""", "personas", "topics", "models"),
        ["model", "topic", "persona_id", "endpoint", "token_field", "body"])


@register("request_plans", _request_plans_sql, ["P13"])
def q_request_plans(spark, sf_dir):
    """Endpoint, token field and JSON body of every prompt (topic and persona) per model."""
    from ..operators.grid import task_grid
    from .task_reports import _prompts
    t = task_grid(_prompts(spark, sf_dir), views.models(spark, sf_dir))
    s = F.col("model")
    return t.select("model", "topic", "persona_id", specs.endpoint(s).alias("endpoint"),
                    specs.token_field(s).alias("token_field"),
                    specs.request_body(s, F.col("prompt")).alias("body"))


@register("last_answer_wins", oracle(with_views("""
SELECT model, topic, persona_id, max(seq) AS seq, arg_max(response, seq) AS response,
  arg_max(success, seq) AS success FROM attempts GROUP BY model, topic, persona_id""", "attempts"),
    ["model", "topic", "persona_id", "seq", "response", "success"]), ["A20", "U3"])
def q_last_answer_wins(spark, sf_dir):
    """One answer per key: the attempt with the largest sequence number."""
    return coverage.last_answer_wins(views.attempts(spark, sf_dir))


@register("attempt_caps", oracle(with_views("""
SELECT model, topic, persona_id, seq, CAST(attempt AS INTEGER) AS attempt, attempt > 4 AS beyond_cap FROM (
  SELECT model, topic, persona_id, seq,
    row_number() OVER (PARTITION BY model, topic, persona_id ORDER BY seq) AS attempt FROM attempts)""",
    "attempts"), ["model", "topic", "persona_id", "seq", "attempt", "beyond_cap"]), ["W11"])
def q_attempt_caps(spark, sf_dir):
    """Attempt number per task; attempts past 1 + 3 retries are flagged."""
    a = views.attempts(spark, sf_dir).select("model", "topic", "persona_id", "seq")
    return coverage.attempt_caps(a, max_retries=3)


@register("retry_queue", oracle(with_views(f"""
, last AS (SELECT model, topic, persona_id, max(seq) AS seq, arg_max(response, seq) AS response,
             arg_max(success, seq) AS success, count(*) AS tries FROM attempts GROUP BY model, topic, persona_id)
SELECT model, topic, persona_id, seq, CAST(tries AS BIGINT) AS tries, CAST({PRIORITY} AS INTEGER) AS priority
FROM last WHERE (NOT coalesce(success, false) OR ({REASON11}) IS NOT NULL) AND tries <= 3""", "attempts"),
    ["model", "topic", "persona_id", "seq", "tries", "priority"]), ["W10", "P19", "R2"])
def q_retry_queue(spark, sf_dir):
    """Tasks whose latest answer failed or is invalid, with retries left, by priority."""
    return coverage.retry_queue(views.attempts(spark, sf_dir), max_retries=3)


@register("retry_round_summary", oracle(with_views("""
SELECT seq AS retry_round, CAST(count_if(success) AS BIGINT) AS recovered,
  CAST(count_if(NOT success) AS BIGINT) AS still_failed, count_if(success) / count(*) AS recovery_rate
FROM attempts WHERE seq > 0 GROUP BY seq""", "attempts"),
    ["retry_round", "recovered", "still_failed", "recovery_rate"], ["recovery_rate"]), ["A18"])
def q_retry_round_summary(spark, sf_dir):
    """Per retry round (attempts after the first): recovered, still failed, rate."""
    a = views.attempts(spark, sf_dir).where(F.col("seq") > 0).withColumnRenamed("seq", "retry_round")
    return coverage.retry_round_summary(a)


@register("final_report", oracle(with_views(f"""
, res AS (SELECT model, topic, persona_id, CASE WHEN CAST(persona_id AS BIGINT) % 50 = 0 THEN '' ELSE response END AS response,
    CAST(persona_id AS BIGINT) % 40 <> 0 AS success, CAST(length(response) AS INTEGER) AS tokens FROM done),
 r AS (SELECT *, success AND ({REASON11}) IS NULL AS ok FROM res),
 n AS (SELECT count(*) AS processed, count_if(ok) AS successful, sum(tokens) AS total_tokens,
   (SELECT count(*) FROM (SELECT DISTINCT model, topic, persona_id FROM res)) AS completed,
   (SELECT count(*) FROM (SELECT DISTINCT model, topic, persona_id FROM tasks)) AS expected FROM r),
 c AS (SELECT *, completed * 100.0 / expected AS coverage_pct, successful / processed AS success_rate FROM n)
SELECT CAST(processed AS BIGINT) AS processed, CAST(successful AS BIGINT) AS successful,
  CAST(processed - successful AS BIGINT) AS failed, CAST(coalesce(total_tokens, 0) AS BIGINT) AS total_tokens,
  CAST(completed AS BIGINT) AS completed, CAST(expected AS BIGINT) AS expected, coverage_pct, success_rate,
  CASE WHEN coverage_pct >= 100 AND success_rate >= 0.99 THEN 'PERFECT'
       WHEN coverage_pct >= 100 AND success_rate >= 0.95 THEN 'EXCELLENT'
       WHEN coverage_pct >= 100 THEN 'COMPLETE' WHEN coverage_pct >= 95 THEN 'GOOD' ELSE 'WARNING' END AS grade
FROM c""", "done"), ["processed", "successful", "failed", "total_tokens", "completed", "expected",
                     "coverage_pct", "success_rate", "grade"], ["coverage_pct", "success_rate"]),
    ["A16", "P20", "U3"])
def q_final_report(spark, sf_dir):
    """Final statistics of the completed answers against the expected task grid, with grade."""
    k = F.col("persona_id").cast("bigint")
    a = views.done(spark, sf_dir).select(
        *coverage.KEYS, F.when(k % 50 == 0, F.lit("")).otherwise(F.col("response")).alias("response"),
        (k % 40 != 0).alias("success"), F.length("response").cast("int").alias("tokens"))
    return coverage.final_report(a, views.tasks(spark, sf_dir))


@register("batch_summary", oracle(with_views("""
SELECT batch, CAST(count_if(success) AS BIGINT) AS successful, CAST(count_if(NOT success) AS BIGINT) AS failed,
  CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens FROM reqlog GROUP BY batch""", "reqlog"),
    ["batch", "successful", "failed", "tokens"]), ["A17"])
def q_batch_summary(spark, sf_dir):
    """Per batch: successes, failures and tokens of the request log."""
    return coverage.batch_summary(views.reqlog(spark, sf_dir))


@register("batch_metrics", oracle(with_views("""
, b AS (SELECT batch, count(*) AS requests, count_if(success) AS successes, count_if(rate_limited) AS rate_limit_hits,
          epoch(max(ts)) - epoch(min(ts)) AS seconds, min(ts) AS t0, max(ts) AS t1 FROM reqlog GROUP BY batch),
 c AS (SELECT *, sum(requests) OVER (ORDER BY batch ROWS UNBOUNDED PRECEDING) AS cum_requests,
          sum(successes) OVER (ORDER BY batch ROWS UNBOUNDED PRECEDING) AS cum_successes,
          (SELECT count(*) FROM reqlog) AS total, (SELECT min(ts) FROM reqlog) AS start FROM b)
SELECT batch, CAST(requests AS BIGINT) AS requests, CAST(successes AS BIGINT) AS successes,
  CAST(rate_limit_hits AS BIGINT) AS rate_limit_hits, (requests - successes) / requests AS failed_rate,
  cum_successes / cum_requests AS cumulative_success_rate,
  CASE WHEN seconds > 0 THEN requests / seconds END AS requests_per_second,
  cum_requests * 100.0 / total AS progress_pct,
  CASE WHEN epoch(t1) - epoch(start) > 0 AND cum_requests / (epoch(t1) - epoch(start)) > 0 THEN
    CASE WHEN floor((total - cum_requests) / (cum_requests / (epoch(t1) - epoch(start))) / 3600) > 0
      THEN printf('%dh %dm', CAST(floor((total - cum_requests) / (cum_requests / (epoch(t1) - epoch(start))) / 3600) AS BIGINT),
                  CAST(floor(fmod((total - cum_requests) / (cum_requests / (epoch(t1) - epoch(start))), 3600) / 60) AS BIGINT))
      ELSE printf('%dm', CAST(floor(fmod((total - cum_requests) / (cum_requests / (epoch(t1) - epoch(start))), 3600) / 60) AS BIGINT))
    END END AS eta
FROM c""", "reqlog"), ["batch", "requests", "successes", "rate_limit_hits", "failed_rate",
                       "cumulative_success_rate", "requests_per_second", "progress_pct", "eta"],
    ["failed_rate", "cumulative_success_rate", "requests_per_second", "progress_pct"]), ["A15", "W7", "P21"])
def q_batch_metrics(spark, sf_dir):
    """Per-batch metrics with running success rate, progress and ETA text."""
    r = views.reqlog(spark, sf_dir)
    return batch_metrics(r)


def batch_metrics(reqlog):
    """Batch metrics over a request log (batch, ts, success, rate_limited).

    Running sums over batches are distributed prefix sums (``grid.running_sums``).
    """
    from ..operators.grid import running_sums

    secs = F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))
    b = reqlog.groupBy("batch").agg(F.count(F.lit(1)).alias("requests"),
                                    F.count_if("success").alias("successes"),
                                    F.count_if("rate_limited").alias("rate_limit_hits"),
                                    F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    total = reqlog.agg(F.count(F.lit(1))).scalar()
    start = reqlog.agg(F.min("ts")).scalar()
    c = running_sums(b, "batch", ["requests", "successes"]).withColumnRenamed(
        "requests_cum", "cum_requests").withColumnRenamed("successes_cum", "cum_successes")
    seconds = secs / 1e6
    elapsed = (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6
    rate = F.when(elapsed > 0, F.col("cum_requests") / elapsed)
    return c.select(
        "batch", "requests", "successes", "rate_limit_hits",
        ((F.col("requests") - F.col("successes")) / F.col("requests")).alias("failed_rate"),
        (F.col("cum_successes") / F.col("cum_requests")).alias("cumulative_success_rate"),
        F.when(seconds > 0, F.col("requests") / seconds).alias("requests_per_second"),
        (F.col("cum_requests") * 100.0 / total).alias("progress_pct"),
        grades.eta_text(total - F.col("cum_requests"), rate).alias("eta"))


@register("response_counts", oracle(with_views("""
SELECT model, CAST(count(*) AS BIGINT) AS responses FROM answers GROUP BY model""", "answers"),
    ["model", "responses"]), ["A19"])
def q_response_counts(spark, sf_dir):
    """Answers per model."""
    return coverage.response_counts(views.answers(spark, sf_dir))


@register("topic_counts", oracle(with_views("""
SELECT topic, CAST(count(*) AS BIGINT) AS queries,
  CAST(floor(count(*) / (SELECT count(DISTINCT model) FROM answers)) AS BIGINT) AS personas
FROM answers GROUP BY topic""", "answers"), ["topic", "queries", "personas"]), ["A19"])
def q_topic_counts(spark, sf_dir):
    """Answers per topic and personas per topic (answers // models)."""
    return coverage.topic_counts(views.answers(spark, sf_dir))

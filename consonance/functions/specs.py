"""Model specs ("provider/name"), request planning and answer extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# They must equal the reference's for the same request plans.
RESPONSES_ONLY_MODELS = [
    "gpt-5-pro-2025-10-06",
    "gpt-5-pro",
    "gpt-5-nano-2025-08-07",
    "gpt-5-nano",
]
COMPLETION_TOKEN_MODELS = ["gpt-5", "o1", "o3"]
MAX_TOKENS = 1000
# ---------------------------------------------------------------------------


def provider(spec: Column) -> Column:
    """Text before the first '/', or '' when there is none."""
    return F.when(spec.contains("/"), F.split_part(spec, F.lit("/"), F.lit(1))).otherwise(F.lit(""))


def model_name(spec: Column) -> Column:
    """The *second* '/'-segment, or the whole spec when there is no '/'."""
    return F.when(spec.contains("/"), F.split_part(spec, F.lit("/"), F.lit(2))).otherwise(spec)


def short_label(spec: Column) -> Column:
    """The last '/'-segment."""
    return F.substring_index(spec, "/", -1)


def route(spec: Column) -> Column:
    """'openai' when the lowercased spec mentions it, else 'openrouter'."""
    return F.when(F.lower(spec).contains("openai"), "openai").otherwise("openrouter")


def _any_in(name: Column, needles: list[str]) -> Column:
    c = F.lit(False)
    for n in needles:
        c = c | name.contains(n)
    return c


def endpoint(spec: Column) -> Column:
    """'responses' for the listed models on the direct route, else 'chat/completions'."""
    direct = route(spec) == "openai"
    return F.when(direct & _any_in(model_name(spec), RESPONSES_ONLY_MODELS), "responses") \
            .otherwise("chat/completions")


def token_field(spec: Column) -> Column:
    """Name of the output-token limit field of the request body."""
    name = model_name(spec)
    direct = route(spec) == "openai"
    return (F.when(endpoint(spec) == "responses", "max_output_tokens")
             .when(direct & _any_in(name, COMPLETION_TOKEN_MODELS), "max_completion_tokens")
             .otherwise("max_tokens"))


def request_body(spec: Column, prompt: Column) -> Column:
    """JSON request body (model, input or messages, token limit)."""
    direct = route(spec) == "openai"
    model = F.when(direct, model_name(spec)).otherwise(spec)
    msgs = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    lim = F.lit(MAX_TOKENS)
    fld = token_field(spec)
    return (F.when(endpoint(spec) == "responses",
                   F.to_json(F.struct(model.alias("model"), prompt.alias("input"),
                                      lim.alias("max_output_tokens"))))
             .when(fld == "max_completion_tokens",
                   F.to_json(F.struct(model.alias("model"), msgs.alias("messages"),
                                      lim.alias("max_completion_tokens"))))
             .otherwise(F.to_json(F.struct(model.alias("model"), msgs.alias("messages"),
                                           lim.alias("max_tokens")))))


def answer_text(raw_json: Column, endpoint_col: Column) -> Column:
    """Answer text from a raw response document.

    chat: ``choices[0].message.content``; responses: ``output_text``, falling
    back to ``output[0].content[0].text`` when empty or absent.
    """
    chat = F.get_json_object(raw_json, "$.choices[0].message.content")
    primary = F.nullif(F.get_json_object(raw_json, "$.output_text"), F.lit(""))
    fallback = F.get_json_object(raw_json, "$.output[0].content[0].text")
    resp = F.coalesce(primary, fallback, F.lit(""))
    return F.when(endpoint_col == "responses", resp).otherwise(chat)


def answer_tokens(raw_json: Column) -> Column:
    """``usage.total_tokens``, 0 when absent."""
    return F.coalesce(F.get_json_object(raw_json, "$.usage.total_tokens").cast("int"), F.lit(0))


def http_error(status: Column, body: Column) -> Column:
    """'HTTP <status>: <body>' for a non-200 status, else NULL."""
    return F.when(status != 200, F.concat(F.lit("HTTP "), status.cast("string"), F.lit(": "),
                                          F.coalesce(body, F.lit(""))))


def file_safe(label: Column) -> Column:
    """Label usable in a file name: '/', ':' and ' ' become '_'; '?' and quote removed."""
    return F.regexp_replace(F.translate(label, "/: ", "___"), "[?']", "")

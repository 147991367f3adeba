"""Validity checks, outcome normalisation, specs, answer extraction, grades."""

import pytest
from pyspark.sql import functions as F

from consonance.functions import grades, prompts, specs, validity


def one_col(spark, values, name="t"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_validity_cases(spark):
    texts = [None, "   ", "a" * 49, "a" * 50, "1" * 60, "x" * 50 + " Rate Limit",
             "This answer is long enough but mentions an empty shelf in it."]
    df = one_col(spark, texts)
    r = df.select("t", validity.invalid_reason(F.col("t"), "8").alias("r8"),
                  validity.invalid_reason(F.col("t"), "11").alias("r11")).collect()
    got = [(x["r8"], x["r11"]) for x in r]
    assert got[0] == ("empty", "empty")
    assert got[1] == ("empty", "empty")
    assert got[2] == ("too_short", "too_short")
    assert got[3] == (None, None)
    assert got[4] == ("no_letter", "no_letter")
    assert got[5] == ("error_phrase", "error_phrase")
    assert got[6] == (None, "error_phrase")  # 'empty' only in the 11-pattern list
    v = validity.with_validity(df, "t").collect()
    assert [(x["reason_8"], x["reason_11"]) for x in v] == got


def test_unicode_trim(spark):
    t = "　　" + "b" * 48 + "　 "
    df = one_col(spark, [t])
    r = df.select(F.length(validity.unicode_trim(F.col("t"))).alias("n"),
                  validity.invalid_reason(F.col("t"), "8").alias("r")).collect()[0]
    assert r["n"] == 48 and r["r"] == "too_short"


def test_outcome_normalisation(spark):
    df = spark.createDataFrame([
        ("x" * 60, None, 7, True), ("x" * 60, "HTTP 500: boom", None, True), ("short", None, 3, True),
        (None, None, None, False)], "text string, err string, tok int, rec boolean")
    o = df.select(validity.normalise_outcome(F.col("text"), F.col("err"), F.col("tok"), F.col("rec")).alias("o"))
    got = [tuple(r["o"]) for r in o.collect()]
    assert got[0] == ("x" * 60, True, 7)
    assert got[1] == ("Error: HTTP 500: boom", False, 0)
    assert got[2] == (validity.EMPTY_OR_INVALID, False, 0)
    assert got[3] == (validity.NO_RESPONSE, False, 0)


def test_retry_priority(spark):
    df = one_col(spark, ["Error: Rate limit hit", "connection reset", "Timeout", "bad answer", None])
    got = [r[0] for r in df.select(validity.retry_priority(F.col("t"))).collect()]
    assert got == [1, 2, 2, 3, 3]


def test_specs(spark):
    df = one_col(spark, ["a/b/c", "plain", "openai/gpt-5-pro", "x/OpenAI-y", "openai/o3-mini",
                         "openai/gpt-4o"], "m")
    m = F.col("m")
    rows = df.select("m", specs.provider(m).alias("p"), specs.model_name(m).alias("n"),
                     specs.short_label(m).alias("l"), specs.route(m).alias("r"),
                     specs.endpoint(m).alias("e"), specs.token_field(m).alias("f")).collect()
    got = {r["m"]: r for r in rows}
    assert (got["a/b/c"]["p"], got["a/b/c"]["n"], got["a/b/c"]["l"]) == ("a", "b", "c")
    assert (got["plain"]["p"], got["plain"]["n"]) == ("", "plain")
    assert got["openai/gpt-5-pro"]["r"] == "openai" and got["x/OpenAI-y"]["r"] == "openai"
    assert got["a/b/c"]["r"] == "openrouter"
    assert got["openai/gpt-5-pro"]["e"] == "responses"
    assert got["openai/gpt-5-pro"]["f"] == "max_output_tokens"
    assert got["openai/o3-mini"]["f"] == "max_completion_tokens"
    assert got["openai/gpt-4o"]["f"] == "max_tokens"
    body = df.select(specs.request_body(m, F.lit("hi")).alias("b")).collect()
    assert '"max_output_tokens":1000' in body[2]["b"] and '"input":"hi"' in body[2]["b"]


def test_answer_extraction(spark):
    docs = [
        ('{"choices":[{"message":{"content":"chat text"}}],"usage":{"total_tokens":12}}', "chat/completions"),
        ('{"output_text":"resp text","usage":{"total_tokens":5}}', "responses"),
        ('{"output_text":"","output":[{"content":[{"text":"fallback text"}]}]}', "responses"),
    ]
    df = spark.createDataFrame(docs, "raw string, ep string")
    r = df.select(specs.answer_text(F.col("raw"), F.col("ep")).alias("a"),
                  specs.answer_tokens(F.col("raw")).alias("k")).collect()
    assert [(x["a"], x["k"]) for x in r] == [("chat text", 12), ("resp text", 5), ("fallback text", 0)]


def test_http_error_and_file_safe(spark):
    df = spark.createDataFrame([(404, "nope", "a/b: c?'d")], "s int, b string, l string")
    r = df.select(specs.http_error(F.col("s"), F.col("b")).alias("e"), specs.file_safe(F.col("l")).alias("f")).collect()[0]
    assert r["e"] == "HTTP 404: nope" and r["f"] == "a_b__cd"


def test_grades(spark):
    df = spark.createDataFrame([(100.0, 1.0), (100.0, 0.96), (100.0, 0.5), (96.0, 1.0), (50.0, 1.0)],
                               "c double, s double")
    got = [r[0] for r in df.select(grades.coverage_grade(F.col("c"), F.col("s"))).collect()]
    assert got == ["PERFECT", "EXCELLENT", "COMPLETE", "GOOD", "WARNING"]
    eta = spark.createDataFrame([(7200.0 + 600, 1.0), (600.0, 1.0)], "rem double, rate double")
    assert [r[0] for r in eta.select(grades.eta_text(F.col("rem"), F.col("rate"))).collect()] == ["2h 10m", "10m"]
    b = spark.createDataFrame([(1.0,), (0.85,), (0.6,), (0.2,), (-0.1,)], "s double")
    assert [r[0] for r in b.select(grades.similarity_band(F.col("s"))).collect()] == \
        ["perfect", "high", "moderate", "low", "opposing"]


def test_prompt_defaults(spark):
    df = spark.createDataFrame([("1", None, None, "p", "pro")],
                               "persona_id string, age int, city string, persona string, professional_persona string")
    d = df.select(prompts.persona_details(df).alias("d")).collect()[0]["d"]
    assert d.startswith("I am a unknown-year-old person living in an undisclosed city, an undisclosed state.")
    assert d.endswith("p\n\npro")
    full = df.select(prompts.prompt_text(prompts.persona_details(df), F.lit("Tea")).alias("x")).collect()[0]["x"]
    assert "following topic:\nTea.\n\nCould you give me five facts" in full

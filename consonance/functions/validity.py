"""Answer validity, outcome normalisation and retry priority as column expressions.

All checks are JVM-side expressions (no Python UDF), so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# They must equal the reference's for the same verdicts.
MIN_LENGTH = 50
ERROR_PATTERNS_8 = [
    "error", "failed", "timeout", "rate limit", "quota exceeded",
    "service unavailable", "internal server error", "bad gateway",
]
ERROR_PATTERNS_11 = ERROR_PATTERNS_8 + ["empty", "invalid", "no response"]
EMPTY_OR_INVALID = "Error: Empty or invalid response"
NO_RESPONSE = "Error: No response received"
NO_RESPONSE_SIMPLE = "No response received"
PLACEHOLDER = ("ERROR: Task failed after all retry attempts. "
               "This persona was not successfully queried.")
# ---------------------------------------------------------------------------

# Unicode white space (the same class in Java regex and RE2)
WS = r"[\t\n\x0B\f\r\x{85}\p{Z}]"


def unicode_trim(text: Column) -> Column:
    """Strip leading and trailing Unicode white space."""
    # most texts have none at their ends, and the expression looks at every place of a text
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(WS), F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")).otherwise(text)


def _contains_any(lower_text: Column, patterns: list[str]) -> Column:
    cond = F.lit(False)
    for p in patterns:
        cond = cond | lower_text.contains(p)
    return cond


def invalid_reason(text: Column, patterns: str = "11") -> Column:
    """Why an answer is invalid, or NULL when it is valid.

    ``patterns='8'`` follows the response-object check (empty, short, no
    letter, error phrase, in that order); ``'11'`` the processor's check
    (empty, short, error phrase, no letter) with three more phrases.
    """
    trimmed = unicode_trim(text)
    empty = text.isNull() | (F.length(text) == 0) | (F.length(trimmed) == 0)
    short = F.length(trimmed) < MIN_LENGTH
    no_letter = ~text.rlike(r"\p{L}")
    low = F.lower(text)
    if patterns == "8":
        phrase = _contains_any(low, ERROR_PATTERNS_8)
        return (F.when(empty, "empty").when(short, "too_short").when(no_letter, "no_letter")
                 .when(phrase, "error_phrase"))
    if patterns != "11":
        raise ValueError("patterns must be '8' or '11'")
    phrase = _contains_any(low, ERROR_PATTERNS_11)
    return (F.when(empty, "empty").when(short, "too_short").when(phrase, "error_phrase")
             .when(no_letter, "no_letter"))


def _reason_from_parts(is_null: Column, raw_len: Column, trim_len: Column, low: Column,
                       has_letter: Column, patterns: str) -> Column:
    empty = is_null | (raw_len == 0) | (trim_len == 0)
    short = trim_len < MIN_LENGTH
    no_letter = ~has_letter
    if patterns == "8":
        phrase = _contains_any(low, ERROR_PATTERNS_8)
        return (F.when(empty, "empty").when(short, "too_short").when(no_letter, "no_letter")
                 .when(phrase, "error_phrase"))
    phrase = _contains_any(low, ERROR_PATTERNS_11)
    return (F.when(empty, "empty").when(short, "too_short").when(phrase, "error_phrase")
             .when(no_letter, "no_letter"))


def with_validity(df, text_col: str = "response", which=("8", "11"), partitions: int | None = None):
    """Add ``reason_<p>`` columns for each check in ``which`` (NULL = valid).

    The trimmed length, the lowercased text and the letter test are computed
    once per row in their own projection (so they are not re-evaluated per
    check); ``partitions`` spreads an input that is known to arrive in few.
    """
    from ..operators.layout import spread

    t = F.col(text_col)
    parts = spread(df, partitions).select("*", t.isNull().alias("_v_null"), F.length(t).alias("_v_len"),
                              F.length(unicode_trim(t)).alias("_v_tlen"), F.lower(t).alias("_v_low"),
                              t.rlike(r"\p{L}").alias("_v_letter"))
    out = parts.select("*", *[_reason_from_parts(F.col("_v_null"), F.col("_v_len"), F.col("_v_tlen"),
                                                  F.col("_v_low"), F.coalesce(F.col("_v_letter"), F.lit(False)),
                                                  p).alias(f"reason_{p}") for p in which])
    return out.drop("_v_null", "_v_len", "_v_tlen", "_v_low", "_v_letter")


def is_valid(text: Column, patterns: str = "11") -> Column:
    """True when the answer passes the check (NULL-safe: NULL text is invalid)."""
    return invalid_reason(text, patterns).isNull()


def normalise_outcome(response_text: Column, error: Column, tokens_used: Column,
                      received: Column) -> Column:
    """Struct(response, success, tokens) from one raw answer record.

    ``received`` is false when no answer record came back at all.
    """
    out = lambda r, s, t: F.struct(r.alias("response"), F.lit(s).alias("success"),
                                   t.cast("int").alias("tokens"))
    return (F.when(~received, out(F.lit(NO_RESPONSE), False, F.lit(0)))
             .when(error.isNotNull(), out(F.concat(F.lit("Error: "), error), False, F.lit(0)))
             .when(~is_valid(response_text, "8"), out(F.lit(EMPTY_OR_INVALID), False, F.lit(0)))
             .otherwise(out(response_text, True, F.coalesce(tokens_used, F.lit(0)))))


def retry_priority(failure_reason: Column) -> Column:
    """1 for rate limits, 2 for timeouts or connection trouble, 3 otherwise."""
    low = F.lower(F.coalesce(failure_reason, F.lit("")))
    return (F.when(low.contains("rate limit"), 1)
             .when(low.contains("timeout") | low.contains("connection"), 2)
             .otherwise(3))

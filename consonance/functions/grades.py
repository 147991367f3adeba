"""Named grades and bands: coverage grade, progress text, similarity band."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coverage_grade(coverage_pct: Column, success_rate: Column) -> Column:
    """PERFECT, EXCELLENT, COMPLETE, GOOD or WARNING from coverage and success rate."""
    full = coverage_pct >= 100.0
    return (F.when(full & (success_rate >= 0.99), "PERFECT")
             .when(full & (success_rate >= 0.95), "EXCELLENT")
             .when(full, "COMPLETE")
             .when(coverage_pct >= 95.0, "GOOD")
             .otherwise("WARNING"))


def eta_text(remaining: Column, rate: Column) -> Column:
    """'<h>h <m>m' (or '<m>m' under an hour) for ``remaining`` items at ``rate``/s."""
    eta = remaining / rate
    h = F.floor(eta / 3600)
    m = F.floor((eta % 3600) / 60)
    return F.when(rate > 0, F.when(h > 0, F.format_string("%dh %dm", h, m))
                  .otherwise(F.format_string("%dm", m)))


def similarity_band(sim: Column) -> Column:
    """perfect (1.0), high (0.8-0.99), moderate (0.5-0.8), low (0-0.5), opposing (< 0)."""
    return (F.when(sim >= 1.0, "perfect")
             .when(sim >= 0.8, "high")
             .when(sim >= 0.5, "moderate")
             .when(sim >= 0.0, "low")
             .when(sim < 0.0, "opposing"))

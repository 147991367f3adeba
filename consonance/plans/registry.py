"""Named queries and their DuckDB oracle SQL.

A query is a callable ``(spark, sf_dir) -> DataFrame``. Its oracle is SQL over
the given tables (pre-registered views in DuckDB) or ``None`` when the
operator is not expressible in SQL (iterative fits, inference rounds).
Double columns leave both sides rounded to 6 places so the two engines
compare equal.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .views import with_views


@dataclass(frozen=True)
class Entry:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | Callable[[], str] | None
    operators: tuple[str, ...]

    def oracle_text(self) -> str | None:
        """The oracle SQL; text that needs a session or a jar is built only here."""
        return self.sql() if callable(self.sql) else self.sql


REGISTRY: dict[str, Entry] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every floating-point column (comparison form)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def oracle(body: str, cols: Sequence[str], doubles: Sequence[str] = (),
           views: Sequence[str] = ()) -> str:
    """Wrap ``body`` so the oracle returns ``cols`` with doubles rounded."""
    sel = []
    for c in cols:
        sel.append(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" if c in doubles else c)
    inner = with_views(body, *views) if views else body
    return f"SELECT {', '.join(sel)} FROM (\n{inner}\n) q"


def register(name: str, sql: str | Callable[[], str] | None, operators: Sequence[str]):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ..session import ship_package

            ship_package(spark)  # executors' Python workers import this package
            return rounded(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = Entry(run, sql, tuple(operators))
        return fn

    return deco


def sql_text(s: str) -> str:
    """A DuckDB string expression for ``s`` (quotes doubled, newlines as chr(10))."""
    parts = s.split("\n")
    lits = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(lits) if len(lits) > 1 else lits[0]


def sql_format(template: str, *exprs: str) -> str:
    """DuckDB concatenation of a %s template with SQL expressions."""
    pieces = template.split("%s")
    if len(pieces) != len(exprs) + 1:
        raise ValueError("placeholder count mismatch")
    out = []
    for i, p in enumerate(pieces):
        if p:
            out.append(sql_text(p))
        if i < len(exprs):
            out.append(f"({exprs[i]})")
    return "(" + " || ".join(out) + ")"

"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c"
UNKNOWN = "unknown"


def strip(col: Column) -> Column:
    """Trim every ASCII blank, not only spaces."""
    return F.btrim(col, F.lit(WHITESPACE))


def first_filled(*cols: Column, default: str | None = None) -> Column:
    """First value that is neither null nor empty."""
    filled = [F.nullif(c, F.lit("")) for c in cols]
    return F.coalesce(*filled, F.lit(default)) if default is not None else F.coalesce(*filled)


def contains_any(col: Column, words: Iterable[str]) -> Column:
    """True when ``col`` holds one of the words as a substring."""
    return or_all(col.contains(w) for w in words)


def or_all(conditions: Iterable[Column]) -> Column:
    """Disjunction of conditions; false for none."""
    result: Column | None = None
    for condition in conditions:
        result = condition if result is None else result | condition
    return F.lit(False) if result is None else result


def imatch(col: Column, pattern: str) -> Column:
    """Case-insensitive regular-expression search."""
    return col.rlike("(?i)" + pattern)


def literal(value: object) -> str:
    """A Python value as SQL text: long rule tables reach the JVM as one expression, not one call per entry."""
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
        return f"'{escaped}'"
    return str(value)


def literal_array(values: Iterable[object]) -> Column:
    return F.expr("array(" + ", ".join(literal(v) for v in values) + ")")


def choose(column: str, cases: Iterable[tuple[object, str]], default: str = "NULL") -> Column:
    """``CASE column WHEN .. THEN ..`` from (value, SQL text) pairs."""
    body = " ".join(f"WHEN {literal(v)} THEN {text}" for v, text in cases)
    return F.expr(f"CASE {column} {body} ELSE {default} END")


def dimension(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A rule table as a local relation; how it is joined is left to the planner, by its size."""
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")

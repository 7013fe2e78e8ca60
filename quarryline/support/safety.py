"""Copies of tables under a checked filter."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that no filter may hold.
FORBIDDEN = ("DROP", "DELETE", "INSERT", "UPDATE", "TRUNCATE", "ALTER", "CREATE", "GRANT", "REVOKE", "EXEC", "EXECUTE", "UNION", "INTO")


class UnsafeSql(ValueError):
    """A filter that is no plain condition on the allowed columns."""


def safe_filter(spark: SparkSession, text: str | None, allowed: list[str] | None = None) -> Column | None:
    """A condition that Spark parses, without forbidden words or subqueries, over allowed columns only."""
    if not text or not text.strip():
        return None
    for word in FORBIDDEN:
        if re.search(rf"\b{word}\b", text, re.I):
            raise UnsafeSql(f"{word} may not be in a filter")
    if re.search(r"\b(SELECT|EXISTS)\b|;|--|/\*", text, re.I):
        raise UnsafeSql("subqueries, comments and several statements may not be in a filter")
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    except Exception as e:
        raise UnsafeSql(f"not a condition: {str(e).splitlines()[0]}") from e
    names = parsed.references().iterator()
    used = []
    while names.hasNext():
        used.append(names.next().name())
    if allowed is not None and (wrong := sorted({u for u in used if u.lower() not in {a.lower() for a in allowed}})):
        raise UnsafeSql(f"columns {wrong} are not among {sorted(allowed)}")
    return F.expr(text)


def safe_copy(table: DataFrame, where: str | None = None, limit: int | None = None, allowed: list[str] | None = None) -> DataFrame:
    condition = safe_filter(table.sparkSession, where, allowed if allowed is not None else table.columns)
    out = table.where(condition) if condition is not None else table
    return out.limit(limit) if limit is not None else out


def empty_table(spark: SparkSession, columns: list[tuple[str, T.DataType]]) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField(n, t) for n, t in columns]))

"""Row hashes: SHA-256 over the text of some columns in a given order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "|"
NULL_TEXT = "\x00"


def canonical_text(c: Column, kind: T.DataType | None = None) -> Column:
    """The text that stands for a value. Doubles and floats are written without an exponent where 17 digits hold them, and
    timestamps in UTC-independent microseconds form, so that a hash depends on no session setting but the time zone."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        exact = c.try_cast("decimal(38,12)")
        plain = F.regexp_replace(F.regexp_replace(exact.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
        return F.when(exact.cast("double") == c.cast("double"), plain).otherwise(c.cast("string"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return c.cast("string")


def row_hash(columns: list[str], *, separator: str = SEPARATOR, null_text: str = NULL_TEXT, schema: T.StructType | None = None) -> Column:
    """Hex SHA-256 of the columns' text, nulls as a sentinel, joined by a separator. The order of the columns matters."""
    if not columns:
        raise ValueError("columns must not be empty")
    kinds = {f.name: f.dataType for f in schema} if schema else {}
    parts = [F.coalesce(canonical_text(F.col(f"`{c}`"), kinds.get(c)), F.lit(null_text)) for c in columns]
    return F.sha2(F.concat_ws(separator, *parts), 256)

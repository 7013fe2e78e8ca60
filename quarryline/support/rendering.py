"""Small tables as Markdown, personal columns masked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = "***"


def masked(df: DataFrame, columns: list[str], mask: str = MASK) -> DataFrame:
    return df.withColumns({c: F.lit(mask) for c in columns if c in df.columns}) if set(columns) & set(df.columns) else df


def to_markdown(df: DataFrame, *, pii_columns: list[str] | None = None, mask: str = MASK, max_rows: int | None = 10) -> str:
    """The first rows; one more is read to know whether there are others, and they are counted only then."""
    shown = masked(df, pii_columns or [], mask)
    rows = shown.limit(max_rows + 1).collect() if max_rows is not None else shown.collect()
    line = lambda cells: "| " + " | ".join(cells) + " |"
    out = [line(df.columns), line(["---"] * len(df.columns))]
    cut = max_rows is not None and len(rows) > max_rows
    out += [line(["" if v is None else str(v) for v in r]) for r in rows[:max_rows]]
    return "\n".join(out + (["", f"*Showing {max_rows} of {df.count()} rows.*"] if cut else []))

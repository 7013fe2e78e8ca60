"""Duplicates, checksums, latest rows and set differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.hashing import canonical_text


def top_duplicates(df: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """The n keys with most copies, ties by key."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")
    return counts.orderBy(F.desc("copies"), *keys).limit(n)


def distinct_rows(df: DataFrame, columns: list[str], *, count_nulls: bool = True) -> DataFrame:
    """One row with n_distinct over a combination of columns; a combination with nulls is a value unless told otherwise."""
    rows = df.select(*columns) if count_nulls else df.select(*columns).dropna()
    return rows.distinct().agg(F.count("*").alias("n_distinct"))


def table_checksum(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """rows and checksum, the same for any order of rows: sums of the row hashes' leading bits, so it aggregates partially
    and counts copies."""
    columns = columns or df.columns
    kinds = {f.name: f.dataType for f in df.schema}
    text = F.concat_ws("|", *[F.coalesce(canonical_text(F.col(c), kinds[c]), F.lit("\x00")) for c in columns])
    head = F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(head), F.lit(0)).cast("string").alias("checksum"))


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row with the greatest `by` of each key, by one partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def missing_from(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that are not present; null keys are never present."""
    return expected.select(*keys).distinct().join(present.select(*keys).distinct(), keys, "left_anti")


def merge_json_maps(old, new):
    """Two JSON objects of strings in one, the second's values first; null counts as empty."""
    parse = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(parse(old), lambda k, _: ~F.map_contains_key(parse(new), k))
    merged = F.map_concat(kept, parse(new))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(merged))))

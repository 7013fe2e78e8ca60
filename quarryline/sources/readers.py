"""Reads: projection and partition filters, the latest partition, pages, text-only columns, and a database through JDBC."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z0-9_]+")


class EmptyPartitionedTable(LookupError):
    """A table without any partition has no latest one."""


def _names(columns: list[str]) -> None:
    if bad := [c for c in columns if not _NAME.fullmatch(c)]:
        raise ValueError(f"names may hold letters, digits and underscores only: {bad}")


def load(table: DataFrame, columns: list[str] | None = None, partition_column: str | None = None, partition_values: list | None = None) -> DataFrame:
    """Chosen columns of chosen partitions; both reach the scan."""
    _names([*(columns or []), *([partition_column] if partition_column else [])])
    if partition_column and partition_values is not None:
        table = table.where(F.col(partition_column).isin(list(partition_values)))
    return table.select(*columns) if columns else table


def latest_partition(table: DataFrame, partition_column: str = "load_period", columns: list[str] | None = None, *, allow_empty: bool = False) -> DataFrame:
    """Rows of the greatest partition. The greatest value is read first (from file statistics where there are any), so that
    the scan is pruned by a literal."""
    _names([partition_column, *(columns or [])])
    top = table.agg(F.max(partition_column)).first()[0]
    if top is None and not allow_empty:
        raise EmptyPartitionedTable(f"no row has a {partition_column}")
    picked = table.where(F.col(partition_column) == F.lit(top).cast(table.schema[partition_column].dataType))
    return picked.select(*columns) if columns else picked


def all_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every column as text."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns or df.columns])


def read_parquet(spark: SparkSession, paths: list[str], columns: list[str] | None = None, *, text: bool = True, with_origin: bool = False) -> DataFrame:
    """Parquet files as one table, as text unless told otherwise; with_origin adds the file and the row's place in it."""
    df = spark.read.parquet(*paths)
    picked = all_text(df, columns) if text else df.select(*(columns or df.columns))
    if not with_origin:
        return picked
    kept = [F.col(f"`{c}`").cast("string").alias(c) if text else F.col(f"`{c}`") for c in columns or df.columns]
    return df.select(*kept, F.col("_metadata.file_path").alias("_source_file"), F.col("_metadata.row_index").alias("_row_index"))


def page(df: DataFrame, order_by: list[str], number: int, size: int) -> DataFrame:
    """One page of an ordered table."""
    if size < 1:
        raise ValueError("a page holds one row at least")
    if not order_by:
        raise ValueError("pages need an order")
    return df.orderBy(*order_by).offset(number * size).limit(size)


def pages(df: DataFrame, order_by: list[str], size: int) -> Iterator[DataFrame]:
    """Every page in turn. order_by must tell any two rows apart: a page starts behind the last row of the one before, so
    it costs a scan and its own rows, and not another sort of the table."""
    if size < 1 or not order_by:
        raise ValueError("pages need an order, and a page holds one row at least")
    total, seen, last = df.count(), 0, None
    place = F.struct(*[F.col(f"`{c}`") for c in order_by])
    kinds = [df.schema[c].dataType for c in order_by]
    while seen < total:
        rest = df if last is None else df.where(place > F.struct(*[F.lit(v).cast(k).alias(c) for v, k, c in zip(last, kinds, order_by, strict=True)]))
        part = rest.orderBy(*order_by).limit(size)
        ends = part.select(*order_by).orderBy(*[F.desc(c) for c in order_by]).limit(1).collect()
        if not ends:
            raise ValueError(f"{order_by} doesn't tell all rows apart: {total - seen} rows are left behind the last page")
        last, seen = tuple(ends[0]), seen + part.count()
        yield part


def batches(df: DataFrame, size: int = 50_000) -> Iterator[pd.DataFrame]:
    """Rows as pandas frames of at most `size` rows on the driver, partition by partition. Rows travel as Arrow batches, and
    no more than one partition and the next are on their way."""
    if size < 1:
        raise ValueError("a batch holds one row at least")

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for low in range(0, part.num_rows, size):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as stream:
                    stream.write_batch(part.slice(low, size))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])

    held, rows = [], 0
    for row in df.mapInArrow(packed, "rows binary").toLocalIterator(prefetchPartitions=True):
        held.append(pa.ipc.open_stream(row["rows"]).read_all())
        rows += held[-1].num_rows
        while rows >= size:
            whole = pa.concat_tables(held)
            yield whole.slice(0, size).to_pandas()
            held, rows = [whole.slice(size)], rows - size
    if rows:
        yield pa.concat_tables(held).to_pandas()


def jdbc_batches(spark: SparkSession, url: str, query: str, *, size: int = 50_000, **options) -> Iterator[pd.DataFrame]:
    """The rows of a database query in frames of at most `size` rows."""
    return batches(jdbc(spark, url, query, fetch_size=size, **options), size)


def jdbc(spark: SparkSession, url: str, query: str, *, fetch_size: int = 50_000, partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 1, properties: dict[str, str] | None = None) -> DataFrame:
    """A database query through Spark's JDBC source; a numeric or date column with bounds makes the read parallel."""
    if fetch_size < 1:
        raise ValueError("fetch_size must be positive")
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size).options(**(properties or {}))
    if partition_column:
        low, high = bounds or (0, 0)
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", low).option("upperBound", high).option("numPartitions", partitions)
        return reader.option("dbtable", f"({query}) q").load()
    return reader.option("query", query).load()


def split_name(name: str) -> tuple[str, str]:
    parts = name.split(".")
    if len(parts) != 2 or not all(parts):
        raise ValueError(f"a table is named schema.table, not {name!r}")
    return parts[0], parts[1]


def source_table(contract, *, test_prefix: str | None = None, number: int = 0) -> str:
    """The table that a contract reads; under test, the copy named prefix, schema and table with `_source`."""
    tables = [s for s in contract.sources if s.get("type") == "table"]
    if number >= len(tables):
        raise ValueError(f"{contract.asset} has {len(tables)} source tables")
    schema, table = tables[number]["schema"], tables[number]["table"]
    return f"{test_prefix}{schema}_{table}_source" if test_prefix else f"{schema}.{table}"


#: Database types, and the Spark types they are read as.
DATABASE_TYPES = {"bool": "boolean", "int2": "smallint", "int4": "int", "int8": "bigint", "float4": "float", "float8": "double", "numeric": "double", "text": "string", "varchar": "string", "bpchar": "string", "uuid": "string", "json": "string", "jsonb": "string", "date": "date", "timestamp": "timestamp", "timestamptz": "timestamp", "bytea": "binary"}


def probed_schema(columns: list[tuple[str, str]]) -> str:
    """A DDL schema from a database's column types; types that aren't known are left to the reader."""
    return ", ".join(f"`{n}` {DATABASE_TYPES[t]}" for n, t in columns if t in DATABASE_TYPES)

"""Streams into tables: a function over every batch, and each batch committed once.

A DataFrame is already read and written in bounded pieces, so a batched transform is DataFrame.transform; functions that
look across rows see all rows, not one batch. Unbounded input comes through Structured Streaming: `availableNow` takes what
is there and stops, and a batch that is replayed after a failure is recognised by the number in the table's pointer.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.plans.sink import TableSink


def transform_batched(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return df.transform(fn)


def union_batches(batches: list[DataFrame]) -> DataFrame:
    """One DataFrame of all batches, with a `_batch` number to order rows of different batches by."""
    if not batches:
        raise ValueError("no batches")
    return reduce(DataFrame.unionByName, [b.withColumn("_batch", F.lit(k)) for k, b in enumerate(batches)])


def stream_files(spark: SparkSession, folder: str, schema, *, source: str = "parquet", files_per_batch: int | None = None, pattern: str | None = None) -> DataFrame:
    """New files of a folder, those whose name fits a pattern, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.format(source).load(folder)


def write_stream(stream: DataFrame, sink: TableSink, target: str, checkpoint: str, **options) -> list[int]:
    """Every available batch as one write of the sink; returns the numbers of the batches written. The number of the last
    batch is part of the table's commit, so a batch that was committed before a crash is not written again."""
    done: list[int] = []

    def one(batch: DataFrame, number: int) -> None:
        result = sink.write(batch, target, run_id=f"batch-{number}", batch=(checkpoint, number), **options)
        if result.version is not None:
            done.append(number)

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return done


def windowed_counts(events: DataFrame, *, time_col: str = "ts", width: str = "1 hour", late: str = "2 hours", by: list[str] | None = None) -> DataFrame:
    """Counts by event time, with late rows taken up to a bound. Works on batch and streaming frames. An extension: not
    part of the survey's inventory."""
    marked = events.withWatermark(time_col, late) if events.isStreaming else events
    return marked.groupBy(F.window(time_col, width), *(by or [])).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *(by or []), "n")

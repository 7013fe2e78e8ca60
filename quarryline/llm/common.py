"""Byte-level helpers shared by the training-data operators.

Texts travel to Python as UTF-8 bytes in Arrow batches; what follows works on whole buffers with numpy, so that a
position or a word costs a few nanoseconds and no Python object.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LEN = np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(20240607).integers(1, _M64, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(pattern_bytes: str) -> np.ndarray:
    """A 256-entry truth table of the bytes that a bytes pattern's single class matches."""
    import re

    return np.array([re.fullmatch(pattern_bytes.encode("latin-1"), bytes([b])) is not None for b in range(256)])


#: Anything but ASCII white space: the words of shingles and of language models.
NOT_SPACE = byte_class(r"[^\x20\x09-\x0D]")
#: ASCII digits and letters, and all that is not ASCII: the words of benchmark windows.
ALNUM = byte_class(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, unless the session does: 10,000 long texts at once are more than a worker needs."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, "4m")


#: What a worker keeps from one task to the next, by the name of what it is for.
_held: dict[str, dict] = {}


def held(name: str) -> dict:
    """A table that a worker keeps while it runs tasks that use it."""
    return _held.setdefault(name, {})


def trimmed(scan=None, *, using: str = ""):
    """A function over batches that gives its worker's freed memory back to the system while it runs and when it ends, for
    workers are kept for later stages. Tables that are held for other functions go first."""
    if scan is None:
        return functools.partial(trimmed, using=using)

    @functools.wraps(scan)
    def run(batches):
        for name, table in _held.items():
            if table and name != using:
                table.clear()
                gc.collect()
        try:
            for number, out in enumerate(scan(batches)):
                yield out
                if number % 32 == 31:
                    release()
        finally:
            release()

    return run


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def opened(shipped, keep: bool):
    """The value of a broadcast. Unless it is to be kept, the worker reads it afresh each time and lets go of it."""
    path = None if keep else getattr(shipped, "_path", None)
    return shipped.value if path is None else shipped.load_from_path(path)


def text_bytes(c: str = "text"):
    """A text as UTF-8 bytes; null counts as empty."""
    small_batches(SparkSession.getActiveSession())
    return F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, 2 * len(_powers[0]), 1 << 20)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running polynomial sums modulo 2^64, from which the hash of any span follows."""
    pw, _ = _grown(len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTES[buf] * pw[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end] for many spans at once; equal spans have equal hashes."""
    _, inv = _grown(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64) * _LEN)


def word_spans(buf: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes of a class; none crosses a bound between texts."""
    on = inside[buf]
    if not len(on):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1]
    last[:-1] &= ~on[1:]
    cut = bounds[(bounds > 0) & (bounds < len(buf))]
    first[cut] = on[cut]
    last[cut - 1] = on[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def binary_parts(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a binary column of about `limit` bytes each (one row at least): (low, high, bytes, bounds)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, high, raw[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def split_by(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket, and n + 1 bounds of the buckets in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def buckets_for(df: DataFrame) -> int:
    """Number of hash buckets for packed exchanges: it follows the session's shuffle width and the scan's."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.rdd.getNumPartitions())


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names for checkpoints; one of our own only in a local session that names none."""
    context = spark.sparkContext
    named = context._jsc.sc().getCheckpointDir()
    if named.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            import tempfile

            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
        named = context._jsc.sc().getCheckpointDir()
    return named.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to a table in the shared folder and read them from there. The shuffle files behind
    it are dropped as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that `checkpointed` wrote, when all that is read from them has been computed."""
    for table in tables:
        if path := getattr(table, "table_path", None):
            delete(table.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dealt(packed: DataFrame, n: int, *, ordered: bool = False) -> DataFrame:
    """Packed rows (bucket, kind, ...) brought together, one of n buckets a partition; ordered: kinds one after the other."""
    out = packed.repartitionById(n, "bucket")
    return out.sortWithinPartitions("kind") if ordered else out


def by_bucket(batches: Iterator[pa.RecordBatch]) -> list[dict]:
    """All rows of a partition that holds one bucket."""
    return [row for batch in batches for row in batch.to_pylist()]


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """A bucket from the high bits of a hash."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def joined(parts: list[bytes], dtype) -> np.ndarray:
    return np.frombuffer(b"".join(parts), dtype)

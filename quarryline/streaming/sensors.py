"""Sensors: which periods of a registry are ready to be worked on. Times are compared as times, never as text."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Signal:
    keys: list[str]
    cursor: datetime | None
    reason: str | None = None


def stamp(key: str, registry: DataFrame) -> Column:
    """A column of the registry, else a time in its metadata."""
    c = F.col(key) if key in registry.columns else F.get_json_object("metadata", f"$.{key}")
    return F.try_to_timestamp(c.cast("string"))


def actionable(registry: DataFrame, source_id: str, *, cursor: datetime | None = None, time_key: str = "registered_at", ready: Column | None = None, status: str = "materialized") -> DataFrame:
    """partition_key and at of ready periods past the cursor."""
    rows = registry.where((F.col("source_id") == source_id) & (F.col("status") == status)).withColumn("at", stamp(time_key, registry)).where(F.col("at").isNotNull())
    rows = rows.where(ready) if ready is not None else rows
    rows = rows.where(F.col("at") > F.lit(cursor).cast("timestamp")) if cursor is not None else rows
    return rows.select("partition_key", "at")


def per_partition(registry: DataFrame, source_id: str, **options) -> Signal:
    """Each ready period past the cursor; the cursor moves to the latest of them."""
    rows = sorted((r["partition_key"], r["at"]) for r in actionable(registry, source_id, **options).collect())
    if not rows:
        return Signal([], options.get("cursor"), "no period is ready past the cursor")
    return Signal([k for k, _ in rows], max(t for _, t in rows))


def barrier(registry: DataFrame, source_id: str, *, cursor: datetime | None = None, time_key: str = "registered_at", ready: Column | None = None, status: str = "materialized") -> DataFrame:
    """One row: n, all_ready, at, and fire, where all periods are ready and the latest is past the cursor."""
    rows = registry.where((F.col("source_id") == source_id) & (F.col("status") == status)).withColumn("at", stamp(time_key, registry))
    good = F.coalesce(ready if ready is not None else F.lit(True), F.lit(False)) & F.col("at").isNotNull()
    out = rows.agg(F.count("*").alias("n"), F.coalesce(F.bool_and(good), F.lit(False)).alias("all_ready"), F.max("at").alias("at"))
    late = F.lit(True) if cursor is None else F.col("at") > F.lit(cursor).cast("timestamp")
    return out.withColumn("fire", F.coalesce((F.col("n") > 0) & F.col("all_ready") & late, F.lit(False)))


def has_stamp(key: str) -> Column:
    return F.get_json_object("metadata", f"$.{key}").isNotNull()


def registered(registry: DataFrame, source_id: str, **options) -> Signal:
    return per_partition(registry, source_id, **options)


def silver_done(registry: DataFrame, source_id: str, **options) -> Signal:
    return per_partition(registry, source_id, time_key="silver_materialized_at", ready=has_stamp("silver_materialized_at"), **options)


def reconciled(registry: DataFrame, source_id: str, **options) -> Signal:
    return per_partition(registry, source_id, time_key="reconciled_at", ready=has_stamp("reconciled_at"), **options)


def new_partitions(discovered: DataFrame, existing: DataFrame, key: str = "partition_key") -> DataFrame:
    """Discovered keys that do not exist yet. Discovery never removes any."""
    return discovered.select(key).distinct().join(existing.select(key).distinct(), key, "left_anti")


class AccessDenied(RuntimeError):
    """A source refused the caller."""


#: The answers of a source that mean the caller may not look.
DENIED = (401, 403)


@dataclass(frozen=True)
class Discovery:
    """Keys that a source has and the table of partitions has not, or why nothing was found out this time."""

    keys: list[str]
    skipped: str | None = None


def discover(look: Callable[[], list[str]], existing: DataFrame, key: str = "partition_key") -> Discovery:
    """One tick of a discovery sensor. A source that refuses the caller is an error that a person must mend; any other
    failure skips this tick, and the next one looks again. The failure's number is its `status`, `code` or
    `response.status_code`."""
    try:
        found = sorted(set(look()))
    except Exception as e:
        status = next((v for v in (getattr(e, "status", None), getattr(e, "code", None), getattr(getattr(e, "response", None), "status_code", None)) if v is not None), None)
        if status in DENIED:
            raise AccessDenied(f"the source answered {status}; its credentials need a look") from e
        return Discovery([], f"{type(e).__name__}: discovery is tried again at the next tick")
    if not found:
        return Discovery([], "the source has no partitions")
    fresh = new_partitions(existing.sparkSession.createDataFrame([(k,) for k in found], f"{key} string"), existing, key)
    return Discovery(sorted(r[0] for r in fresh.collect()))


#: Days between periods, and the schedule they stand for.
CRON_DAYS = {28: "0 0 1 * *", 30: "0 0 1 * *", 31: "0 0 1 * *", 90: "0 0 1 */3 *", 91: "0 0 1 */3 *", 92: "0 0 1 */3 *", 182: "0 0 1 */6 *", 183: "0 0 1 */6 *", 365: "0 0 1 1 *", 366: "0 0 1 1 *"}


@dataclass(frozen=True)
class Partitions:
    """Either keys, or a first day and a schedule."""

    keys: list[str] | None = None
    start: str | None = None
    cron: str | None = None


def partitions_of(periods: list) -> Partitions:
    """Explicit keys where every period has one; a schedule where all periods are equally far apart in a known way; else
    the first days."""
    if not periods:
        raise ValueError("the source has no periods")
    if all(p.partition_key is not None for p in periods):
        return Partitions([p.partition_key for p in periods])
    days = {(b.effective_from - a.effective_from).days for a, b in zip(periods, periods[1:], strict=False)}
    if len(days) == 1 and (cron := CRON_DAYS.get(next(iter(days)))):
        return Partitions(start=periods[0].effective_from.isoformat(), cron=cron)
    return Partitions([p.effective_from.isoformat() for p in periods])


def period_of(periods: list, key: str):
    for p in periods:
        if key in (p.partition_key, p.effective_from.isoformat()):
            return p
    raise KeyError(f"no period for {key!r}; known: {[p.partition_key or p.effective_from.isoformat() for p in periods]}")

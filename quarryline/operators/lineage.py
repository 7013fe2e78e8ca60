"""Row lineage and registries: identifiers, audit rows, and the tables that record periods and column tags."""

from __future__ import annotations

import hashlib
import os
import time
import uuid
from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import writes
from .aggregates import merge_json_maps


def uuid7(millis: int | None = None) -> uuid.UUID:
    """A time-ordered identifier: 48 bits of milliseconds, then random bits."""
    ms = int(time.time() * 1000) if millis is None else millis
    value = ms << 80 | int.from_bytes(os.urandom(10), "big")
    value = value & ~(0xF << 76) | 0x7 << 76
    return uuid.UUID(int=value & ~(0x3 << 62) | 0x2 << 62)


def uuid7_time(u: uuid.UUID) -> datetime:
    return datetime.fromtimestamp((u.int >> 80) / 1000, timezone.utc)


def lineage_key(asset: str, layer: str, run_id: str, *, data_date: date | None = None, source_file: str | None = None, now: datetime | None = None) -> str:
    """v1:asset:layer:part:run with the date, else eight digits of the file's hash, else the time, as part."""
    if data_date is not None:
        part = (data_date.date() if isinstance(data_date, datetime) else data_date).isoformat()
    elif source_file:
        part = hashlib.sha256(source_file.encode()).hexdigest()[:8]
    else:
        part = (now or datetime.now(timezone.utc)).strftime("%Y%m%d%H%M%S")
    return ":".join(("v1", asset.replace(f"_{layer}", ""), layer, part, run_id[:6]))


def parse_lineage_key(c: Column | str) -> Column:
    """A struct of the five parts; null for what is no key of version 1."""
    parts = F.split(F.col(c) if isinstance(c, str) else c, ":")
    names = ("version", "asset", "layer", "date_or_hash", "run_id_prefix")
    fields = [F.regexp_replace(F.get(parts, k), "^v", "").alias(n) if k == 0 else F.get(parts, k).alias(n) for k, n in enumerate(names)]
    return F.when((F.size(parts) == 5) & (F.get(parts, 0) == "v1"), F.struct(*fields))


@dataclass(frozen=True)
class Lineage:
    lineage_id: str
    key: str


def new_lineage(target: str, run_id: str, *, data_date=None, source_file=None) -> Lineage:
    layer, asset = target.split(".", 1) if "." in target else ("", target)
    return Lineage(str(uuid7()), lineage_key(asset, layer, run_id, data_date=data_date, source_file=source_file))


def with_lineage(df: DataFrame, line: Lineage) -> DataFrame:
    return df.withColumns({"_lineage_id": F.lit(line.lineage_id), "_lineage_key": F.lit(line.key)})


def with_metadata(df: DataFrame, layer: str, run_id: str, processed_at: int, source_file: str | None = None) -> DataFrame:
    """What stands on a row where lineage does not: run, time in seconds, and file."""
    out = {f"_{layer}_run_id": F.lit(run_id), f"_{layer}_processed_at": F.lit(processed_at).cast("long")}
    return df.withColumns(out | ({"_source_file": F.lit(source_file)} if source_file else {}))


def parent_lineage_ids(df: DataFrame) -> DataFrame:
    return df.select(F.col("_lineage_id").alias("parent_id")).where("parent_id IS NOT NULL").distinct()


def history(lineage: DataFrame, *, limit: int = 100, **equal) -> DataFrame:
    """Lineage rows by equal fields, the latest first."""
    for k, v in equal.items():
        if v is not None:
            lineage = lineage.where(F.col(k) == v)
    return lineage.orderBy(F.desc("processed_at"), "lineage_id").limit(limit)


def prior(lineage: DataFrame, asset: str, layer: str, *, data_date: date | None = None, data_date_range: tuple[date, date] | None = None) -> DataFrame:
    """The latest row of an asset of the same shape: of the same date, of exactly the same range of dates, or of neither."""
    if data_date is not None:
        same = F.col("data_date") == F.lit(data_date)
    elif data_date_range is not None:
        same = F.col("data_date_range") == date_range(data_date_range)
    else:
        same = F.col("data_date").isNull() & F.col("data_date_range").isNull()
    rows = lineage.where((F.col("asset_name") == asset) & (F.col("layer") == layer) & same)
    return rows.orderBy(F.desc("processed_at"), "lineage_id").limit(1)


def date_range(days: tuple[date, date] | None) -> str | None:
    """A range of days, both ends in it, as text."""
    return f"[{days[0].isoformat()},{days[1].isoformat()}]" if days else None


def register_periods(registry: DataFrame, periods: DataFrame, *, now: datetime) -> DataFrame:
    """Upsert by (source_id, partition_key): fields move over, metadata objects merge, registered_at is now. Of repeated
    periods the last counts, by the input's order or, where it has none, by the fields."""
    keys = ["source_id", "partition_key"]
    order = None if writes.has_input_order(periods) else [c for c in periods.columns if c not in keys]
    stamped = writes.last_input_wins(periods, keys, order).withColumn("registered_at", F.lit(now).cast("timestamp"))
    before = registry.select(*keys, F.col("metadata").alias("_old"))
    merged = stamped.join(before, keys, "left").withColumn("metadata", merge_json_maps(F.col("_old"), F.col("metadata"))).drop("_old")
    return writes.upsert(registry, merged, keys, order_by=["registered_at"])


def update_metadata(registry: DataFrame, updates: DataFrame) -> DataFrame:
    """Merge metadata of known periods; unknown ones are not added. Updates of one period are merged first, those of later
    text over others, so that a period stays one row."""
    keys = ["source_id", "partition_key"]
    each = F.aggregate(F.array_sort(F.collect_list("metadata")), F.lit("{}"), lambda a, x: merge_json_maps(a, x))
    new = updates.groupBy(*keys).agg(each.alias("_new"))
    return registry.join(new, keys, "left").withColumn("metadata", F.when(F.col("_new").isNull(), F.col("metadata")).otherwise(merge_json_maps(F.col("metadata"), F.col("_new")))).select(*registry.columns)


def registry_periods(registry: DataFrame, source_id: str, status: str | None = "materialized") -> DataFrame:
    rows = registry.where(F.col("source_id") == source_id)
    return (rows.where(F.col("status") == status) if status else rows).orderBy("effective_from", "partition_key")


def sync_tags(tags: DataFrame, declared: DataFrame, *, at) -> DataFrame:
    """Column tags as versions: an open row (valid_to null) whose tags differ is closed, and a new one opened. Both frames
    have schema_name, table_name, column_name and tags; the first also valid_from and valid_to."""
    keys = ["schema_name", "table_name", "column_name"]
    kinds = {f.name: f.dataType for f in tags.schema}
    when = F.lit(at).cast(kinds["valid_from"])
    open_ = tags.where(F.col("valid_to").isNull())
    new = declared.select(*keys, F.col("tags").alias("_tags"), F.lit(True).alias("_there"))
    joined = open_.join(new, keys, "full_outer")
    differs = F.col("_there") & ~F.col("_tags").eqNullSafe(F.col("tags"))
    known = F.col("valid_from").isNotNull()
    closed = joined.where(known).withColumn("valid_to", F.when(F.coalesce(differs, F.lit(False)), when).cast(kinds["valid_to"])).select(*tags.columns)
    opened = joined.where(F.col("_there") & (~known | differs)).withColumns({"tags": F.col("_tags"), "valid_from": when, "valid_to": F.lit(None).cast(kinds["valid_to"])}).select(*tags.columns)
    return tags.where(F.col("valid_to").isNotNull()).unionByName(closed).unionByName(opened)


def register_pipeline(registry: DataFrame, row: DataFrame) -> DataFrame:
    """Upsert by pipeline_id that leaves a row alone unless its contract or handles differ."""
    return writes.upsert(registry, row, ["pipeline_id"], [c for c in row.columns if c not in ("pipeline_id", "registered_at")], skip_unchanged=True, order_by=["registered_at"])


def validation_rows(results, lineage_id: str) -> list[dict]:
    """Audit rows of checks; at most twenty sample values each."""
    return [{"lineage_id": lineage_id, "check_name": r.rule.name, "severity": r.rule.severity, "passed": r.passed, "failed_count": r.failed, "total_count": r.total, "samples": [str(s) for s in r.samples[:20]]} for r in results]



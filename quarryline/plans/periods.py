"""Sources with periods: their contracts, the registry of what was loaded, and the repair of versioned tables after it."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.operators import lineage, scd
from quarryline.sources.ingest import IngestSpec
from quarryline.sources.objects import SENSITIVITIES
from quarryline.sources.snapshot import SnapshotTable

from .contracts import ContractError, DataSource
from .sink import TableSink

_FIELDS = "source_id string, source_name string, partition_key string, effective_from date, effective_to date, source_uri string, status string, registered_at timestamp, registered_by string, run_id string, pipeline_id string, metadata string"
REGISTRY = T.StructType([T.StructField(n, {"string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampType()}[k]) for n, k in (f.split() for f in _FIELDS.split(", "))])


@dataclass(frozen=True)
class Corpus:
    """Ingest specifications and sources by name, checked against each other."""

    ingests: dict[str, IngestSpec]
    sources: dict[str, DataSource]
    feeds: dict[str, str]

    def errors(self) -> list[str]:
        """feeds: from a source's name to that of the ingest it reads."""
        out = [f"{n}: sensitivity must be one of {SENSITIVITIES}, not {i.sensitivity!r}" for n, i in self.ingests.items() if i.sensitivity not in SENSITIVITIES]
        for source, ingest in self.feeds.items():
            if source not in self.sources:
                out.append(f"{source} is fed but not declared")
            if ingest not in self.ingests:
                out.append(f"{source} reads {ingest!r}, which no contract lands")
        for ids in (self.ingests, self.sources):
            seen: dict[str, str] = {}
            for n, x in ids.items():
                if seen.setdefault(x.source_id, n) != n:
                    out.append(f"{n} and {seen[x.source_id]} share source_id {x.source_id}")
        for n, s in self.sources.items():
            starts = [p.effective_from for p in s.periods]
            if starts != sorted(set(starts)):
                out.append(f"{n}: periods must start one after the other")
            keys = [p.partition_key for p in s.periods if p.partition_key is not None]
            if len(keys) != len(set(keys)):
                out.append(f"{n}: partition keys repeat")
        return out

    def check(self) -> Corpus:
        if errors := self.errors():
            raise ContractError("corpus", errors)
        return self


class PeriodRegistry:
    """The table of periods."""

    def __init__(self, spark: SparkSession, root: str, name: str = "meta.period_registry"):
        self.spark, self.table = spark, SnapshotTable(spark, root, name)

    def read(self) -> DataFrame:
        return self.table.read() if self.table.exists() else self.spark.createDataFrame([], REGISTRY)

    def register(self, rows: list[dict[str, Any]], *, now: datetime) -> None:
        """Upsert by source and key; metadata merges."""
        blank = dict.fromkeys(REGISTRY.names)
        data = [tuple((blank | {"status": "registered"} | r | {"metadata": json.dumps(r.get("metadata") or {}, sort_keys=True)})[n] for n in REGISTRY.names) for r in rows]
        with self.table.locked():
            self.table.commit(lineage.register_periods(self.read(), self.spark.createDataFrame(data, REGISTRY), now=now))

    def stamp(self, source_id: str, keys: list[str], **metadata: str) -> None:
        rows = self.spark.createDataFrame([(source_id, k, json.dumps(metadata, sort_keys=True)) for k in keys], "source_id string, partition_key string, metadata string")
        with self.table.locked():
            self.table.commit(lineage.update_metadata(self.read(), rows))


def register_after_write(registry: PeriodRegistry, source: DataSource, effective_date: date | None, *, layer: str, run_id: str, now: datetime, uri: str | None = None) -> bool:
    """After a bronze write the period of its date is registered as materialized; after a later one it is stamped. A failure
    warns and never undoes the write."""
    try:
        period = next((p for p in source.periods if p.effective_from == effective_date), None)
        if period is None:
            return False
        key = period.partition_key or period.effective_from.isoformat()
        if layer == "bronze":
            registry.register([{"source_id": source.source_id, "source_name": source.source_name, "partition_key": key, "effective_from": period.effective_from, "effective_to": period.effective_to, "source_uri": uri or period.source, "status": "materialized", "registered_by": "write", "run_id": run_id}], now=now)
        else:
            registry.stamp(source.source_id, [key], **{f"{layer}_materialized_at": now.isoformat()})
        return True
    except Exception as e:  # noqa: BLE001  the write stands
        warnings.warn(f"period of {source.source_name} at {effective_date} was not registered: {e}", stacklevel=2)
        return False


def reconcile_and_stamp(sink: TableSink, registry: PeriodRegistry, source_id: str, target: str, business_key: list[str], *, now: datetime, collapse_duplicates: bool = True) -> scd.ReconcileCounts:
    """Repair a versioned table, then stamp every materialized period of its source."""
    counts = sink.reconcile(target, business_key, collapse_duplicates=collapse_duplicates)
    keys = [r["partition_key"] for r in lineage.registry_periods(registry.read(), source_id).select("partition_key").collect()]
    if keys:
        registry.stamp(source_id, keys, reconciled_at=now.isoformat())
    return counts


def effective_periods(registry: DataFrame, source_id: str, on: date) -> DataFrame:
    """Periods in force on a day; the end is exclusive and may be open."""
    day = F.lit(on)
    return registry.where((F.col("source_id") == source_id) & (F.col("effective_from") <= day) & (F.col("effective_to").isNull() | (F.col("effective_to") > day)))

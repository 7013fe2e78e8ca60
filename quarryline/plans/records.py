"""What is kept of every write beside its rows: lineage rows and their parents, results of checks, repairs, and pipelines, as
tables in the schema `meta` of the sink's root."""

from __future__ import annotations

from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import checks, lineage
from quarryline.operators.scd import ReconcileCounts
from quarryline.sources.snapshot import SnapshotTable

#: Columns of each table, in order.
TABLES = {
    "lineage": "lineage_id string, lineage_key string, asset_name string, layer string, data_date date, data_date_range string, source_file string, run_id string, pipeline_id string, mode string, version int, rows_in long, rows_inserted long, replaces_lineage_id string, processed_at timestamp, clear_method string, insert_method string",
    "lineage_parents": "lineage_id string, parent_id string",
    "checks": "lineage_id string, phase string, check_name string, severity string, passed boolean, failed_count long, total_count long, samples array<string>",
    "reconciles": "target string, run_id string, rows_collapsed long, rows_retimed long, rows_renumbered long, seconds double, at timestamp",
    "pipelines": "pipeline_id string, contract_hash string, asset_handle string, code_handle string, schedule_handle string, registered_at timestamp",
}


class Records:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> SnapshotTable:
        return SnapshotTable(self.spark, self.root, f"meta.{name}", keep=2)

    def read(self, name: str) -> DataFrame:
        t = self.table(name)
        return t.read() if t.exists() else self.spark.createDataFrame([], TABLES[name])

    def _add(self, name: str, rows: DataFrame | list[dict[str, Any]]) -> None:
        if isinstance(rows, list):
            if not rows:
                return
            fields = [f.split()[0] for f in TABLES[name].split(", ")]
            rows = self.spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], TABLES[name]).coalesce(1)
        t = self.table(name)
        with t.locked():
            t.append(rows)

    def wrote(self, line: lineage.Lineage, target: str, row: dict[str, Any], *, data_date: date | None, now: datetime, results: dict[str, list[checks.Result]], parents: DataFrame | None, replaces: bool) -> None:
        """One lineage row, the rows of its checks, and its parents. A full refresh names the row of the same shape that it
        replaces."""
        layer, asset = target.split(".", 1)
        before = None
        if replaces:
            known = lineage.prior(self.read("lineage"), asset, layer, data_date=data_date).select("lineage_id").first()
            before = known[0] if known else None
        self._add("lineage", [{"lineage_id": line.lineage_id, "lineage_key": line.key, "asset_name": asset, "layer": layer, "data_date": data_date, "replaces_lineage_id": before, "processed_at": now, **row}])
        self._add("checks", [r | {"phase": phase} for phase, found in results.items() for r in lineage.validation_rows(found, line.lineage_id)])
        if parents is not None:
            self._add("lineage_parents", lineage.parent_lineage_ids(parents).select(F.lit(line.lineage_id).alias("lineage_id"), "parent_id"))

    def reconciled(self, target: str, run_id: str, counts: ReconcileCounts, seconds: float, now: datetime) -> None:
        self._add("reconciles", [{"target": target, "run_id": run_id, "rows_collapsed": counts.rows_collapsed, "rows_retimed": counts.rows_retimed, "rows_renumbered": counts.rows_renumbered, "seconds": seconds, "at": now}])

    def pipeline(self, row: dict[str, Any], *, now: datetime) -> None:
        """Register a pipeline; its row moves only if its contract or handles differ."""
        fields = [f.split()[0] for f in TABLES["pipelines"].split(", ")]
        fresh = self.spark.createDataFrame([tuple((row | {"registered_at": now}).get(f) for f in fields)], TABLES["pipelines"])
        t = self.table("pipelines")
        with t.locked():
            t.commit(lineage.register_pipeline(self.read("pipelines"), fresh))

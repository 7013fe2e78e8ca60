"""Writing a table: checks, configuration, lineage, the write mode as a plan, checks of what was written, one commit, and the
records of it.

A write touches only the parts of a table that it changes: an append adds a part, a refresh or a versioned write of partitions
replaces theirs, and a versioned write of a whole table leaves ended versions where they are. Figures are observed while the
new parts are written, so that no join runs twice.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.operators import checks, scd, writes
from quarryline.operators.lineage import new_lineage, with_lineage, with_metadata
from quarryline.sources import outputs
from quarryline.sources.snapshot import Part, SnapshotTable
from quarryline.support.observe import LineageEvents

from . import config as cfg
from .contracts import Contract, DataSource, check_schema
from .records import Records

@dataclass(frozen=True)
class WriteResult:
    table: str
    mode: str
    version: int | None
    lineage_id: str
    stats: dict[str, int]
    checks: checks.Summary | None = None
    post_checks: checks.Summary | None = None
    seconds: float = 0.0
    notes: list[str] = field(default_factory=list)


@dataclass
class _Step:
    """New rows of a write, the parts that stay, the column that parts are split by, and the figures once rows are written."""

    rows: DataFrame
    keep: list[Part] | Callable[[list[Part]], list[Part]]
    split: str | None
    stats: Callable[[], dict[str, int]]
    schema: T.StructType | None = None


class TableSink:
    """Writes to snapshot tables below a root folder. records: keep lineage, check and repair rows; events: where lineage
    events go; pipeline: the row by which the pipeline is registered at every write."""

    def __init__(
        self, spark: SparkSession, root: str, *, enforcement: str = "error", keep: int = 3, grace: float = 0, cols: scd.Scd2Columns = scd.Scd2Columns(), records: bool = True, events: LineageEvents | None = None,
        pipeline: dict[str, Any] | None = None,
    ):
        self.spark, self.root, self.enforcement, self.keep, self.grace, self.cols = spark, root, enforcement, keep, grace, cols
        self.records = Records(spark, root) if records else None
        self.events, self.pipeline = events, pipeline

    def table(self, name: str) -> SnapshotTable:
        return SnapshotTable(self.spark, self.root, name, keep=self.keep, grace=self.grace)

    def write(self, df: DataFrame, target: str, *, run_id: str = "manual", **options: Any) -> WriteResult:
        """One write, as _write says; its start, end or failure goes to the events."""
        run = self.events.emit("START", target, outputs=[target]) if self.events else None
        try:
            result = self._write(df, target, run_id=run_id, **options)
        except Exception as e:
            if self.events:
                self.events.emit("FAIL", target, run, outputs=[target], facets={"error": type(e).__name__})
            raise
        if self.events:
            self.events.emit("COMPLETE", target, run, outputs=[target], facets={"stats": result.stats, "version": result.version})
        return result

    def _write(
        self, df: DataFrame, target: str, *, contract: Contract | None = None, run_id: str = "manual", effective_date: date | datetime | None = None, partition_values: list | None = None, now: datetime | None = None,
        lineage: bool = True, source_file: str | None = None, order_by: list[str] | None = None, periods: list[date] | None = None, batch: tuple[str, int] | None = None, source: DataSource | None = None,
        upstream: Contract | None = None, clear: str = "auto", insert: str = "auto", **options: Any,
    ) -> WriteResult:
        """Rules run on all rows before any write, and again, with the table rules, on the staged version; if an error shows,
        the table stays as it was. batch: a stream's name and the batch's number, which is written once only. source: the
        period of its effective_date is registered after the write. upstream: a contract whose personal columns should be
        personal here. Without lineage rows get run, time and file where options of a contract's layer name one."""
        began, now = time.time(), now or datetime.now(timezone.utc).replace(tzinfo=None)
        table, notes = self.table(target), []
        asked, named = cfg.WriteConfig.of(**options)
        plan = cfg.reconcile(contract, asked, named, table.schema_name, table.table_name)
        pre = None
        if contract and upstream and (plain := pii_drift(upstream, contract)):
            notes.append(f"personal upstream and not here: {plain}")
            warnings.warn(notes[-1], stacklevel=3)
        if contract:
            rules = [r for r in contract.rules() if r.column or r.kind in ("null_percentage", "unique_combination")]
            pre = checks.enforce([check_schema(contract, df.schema), *checks.run_checks(df, rules, now=now)], self.enforcement)
        df = self._partition(df, plan, effective_date, partition_values)
        cfg.validate(plan, df.columns, (self.cols.effective_from, self.cols.effective_to, self.cols.is_current))
        cfg.validate_partition_safety(plan, partition_values is not None)
        line = new_lineage(target, run_id, data_date=effective_date, source_file=source_file)
        parents = df if "_lineage_id" in df.columns else None
        if plan.mode == "scd2":
            df = scd.with_row_hash(df, plan.business_key, plan.tracked_columns, cols=self._cols(plan), exclude=(*scd.MANAGED, *([plan.partition_column] if plan.partition_column else [])))
        if lineage:
            df = with_lineage(df, line)
        elif contract:
            df = with_metadata(df, contract.layer, run_id, int(now.replace(tzinfo=timezone.utc).timestamp()), source_file)
        insert = outputs.insert_method(df.schema, insert, None, plan.mode)
        day = effective_date.date() if isinstance(effective_date, datetime) else effective_date
        post: list[checks.Summary] = []
        with table.locked():
            known = table.pointer()
            if batch and known and known["batches"].get(batch[0], -1) >= batch[1]:
                return WriteResult(target, plan.mode, None, line.lineage_id, {"rows_in": 0}, pre, None, time.time() - began, [f"batch {batch[1]} was written before"])
            step = self._planned(table, df, plan, effective_date or now, partition_values, order_by)

            def check(new: DataFrame, whole: DataFrame) -> None:
                if contract:
                    rows = step.stats()["rows_in"]
                    own = new.where(F.col("_lineage_id") == line.lineage_id) if lineage and plan.mode != "full_refresh" else new
                    results = checks.run_checks(own, [r for r in contract.expectations if r.kind != "history_completeness"], now=now, staged_rows=rows, samples=False)
                    results += checks.run_checks(whole, [r for r in contract.expectations if r.kind == "history_completeness"], now=now, periods=periods, effective_date=day, effective_from=self.cols.effective_from, samples=False)
                    post.append(checks.enforce(results, self.enforcement))

            version = table.commit(step.rows, check=check, split=step.split, keep=step.keep, schema=step.schema, batches={batch[0]: batch[1]} if batch else None)
            stats = step.stats()
        clear = outputs.clear_method(clear, stats.get("rows_deleted"))
        if self.records:
            row = {"run_id": run_id, "source_file": source_file, "pipeline_id": contract.pipeline_id if contract else None, "mode": plan.mode, "version": version, "rows_in": stats["rows_in"], "rows_inserted": stats.get("rows_inserted"), "clear_method": clear, "insert_method": insert}
            found = {phase: list(s.results) for phase, s in (("before", pre), ("after", post[0] if post else None)) if s}
            self.records.wrote(line, target, row, data_date=day, now=now, results=found, parents=parents if lineage else None, replaces=plan.mode == "full_refresh")
            if self.pipeline:
                self.records.pipeline(self.pipeline, now=now)
        if source:
            from .periods import PeriodRegistry, register_after_write

            register_after_write(PeriodRegistry(self.spark, self.root), source, day, layer=table.schema_name, run_id=run_id, now=now, uri=source_file)
        return WriteResult(target, plan.mode, version, line.lineage_id, stats, pre, post[0] if post else None, time.time() - began, notes)

    def _cols(self, plan: cfg.WriteConfig) -> scd.Scd2Columns:
        return scd.Scd2Columns(self.cols.effective_from, self.cols.effective_to, self.cols.is_current, self.cols.row_hash, plan.sequence_column, self.cols.end_of_time)

    @staticmethod
    def _partition(df: DataFrame, plan: cfg.WriteConfig, effective_date, values: list | None) -> DataFrame:
        """The partition column is put in only where it is configured and absent: the period first, then the one key."""
        pc = plan.partition_column
        if not pc or pc in df.columns:
            return df
        if effective_date is not None:
            return df.withColumn(pc, F.lit(effective_date).cast("date"))
        return df.withColumn(pc, F.lit(values[0])) if values and len(values) == 1 else df

    def _empty(self, df: DataFrame, plan: cfg.WriteConfig) -> DataFrame:
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
        if plan.mode == "scd2":
            c = self._cols(plan)
            for name, kind in ((c.effective_from, T.TimestampType()), (c.effective_to, T.TimestampType()), (c.is_current, T.BooleanType()), *([(c.seq_id, T.IntegerType())] if c.seq_id else [])):
                schema = schema.add(name, kind)
        return self.spark.createDataFrame([], schema)

    def _planned(self, table: SnapshotTable, df: DataFrame, plan: cfg.WriteConfig, at, values, order_by) -> _Step:
        parts = table.parts() if table.exists() else []
        schema = table.schema() if table.exists() else self._empty(df, plan).schema
        target = lambda some: table.read_parts(some, schema)
        pc = plan.partition_column
        if plan.mode == "append":
            rows, seen = _observed(writes.conform(target([]), df), rows_in=F.count(F.lit(1)))
            return _Step(rows, parts, pc, lambda: seen() | {"rows_inserted": seen()["rows_in"]})
        if plan.mode == "full_refresh" and not pc:
            rows, seen = _observed(df, rows_in=F.count(F.lit(1)))
            gone = target(parts).count()
            return _Step(rows, [], None, lambda: seen() | {"rows_inserted": seen()["rows_in"], "rows_deleted": gone})
        if plan.mode == "full_refresh":
            return self._refresh(table, target, df, pc, values, parts)
        if plan.mode == "upsert":
            writes.check_upsert(df, plan.primary_key)
            scope, keep = parts, []
            if pc in (plan.primary_key or []):
                # a key has one partition, so others are not touched
                scope, keep = _chosen(table, df, pc, None, parts)
            marked = writes.upsert_marked(target(scope), df, plan.primary_key, plan.update_columns, skip_unchanged=plan.skip_unchanged, order_by=order_by)
            rows, seen = _observed(marked, "_action", rows_inserted=F.count_if(F.col("_action") == "inserted"), rows_updated=F.count_if(F.col("_action") == "updated"))
            n = df.count()
            return _Step(rows, keep, pc if pc in plan.primary_key else None, lambda: {"rows_in": n, "rows_upserted": n} | seen())
        cols = self._cols(plan)
        n = scd.check_incoming(df, plan.business_key, partition_column=pc, cols=cols, detect_deletes=plan.detect_deletes)
        if pc:
            if values is None:
                values = [r[0] for r in df.select(pc).distinct().collect()]
            scope, keep = _chosen(table, df, pc, values, parts)
            history, split = None, pc
        else:
            # versions that have ended stay in their parts; only keys and numbers are read of them
            keep = [p for p in parts if p.get("by") == cols.is_current and p["value"] == "false"]
            scope, history, split = [p for p in parts if p not in keep], target(keep), cols.is_current
        marked = scd.apply_scd2_marked(target(scope), df, plan.business_key, at, detect_deletes=plan.detect_deletes, partition_column=pc, partition_values=values, cols=cols, history=history)
        counts = dict(zip(("rows_new", "rows_expired", "rows_inserted", "rows_unchanged", "rows_deleted"), scd.action_counts(), strict=True))
        rows, seen = _observed(marked, "_action", **counts)
        return _Step(rows, keep, split, lambda: {"rows_in": n} | seen())

    def _refresh(self, table: SnapshotTable, target, df: DataFrame, pc: str, values: list | None, parts: list[Part]) -> _Step:
        """Parts of the given partitions, or of those that come, give way; only parts that may hold several partitions, from
        writes without a partition column, are written again."""
        mixed = [p for p in parts if p.get("by") != pc]
        pure = [p for p in parts if p.get("by") == pc]
        incoming, seen = _observed(writes.conform(target([]), df), rows_in=F.count(F.lit(1)))
        if mixed and values is None:
            values = [r[0] for r in df.select(pc).where(F.col(pc).isNotNull()).distinct().collect()]
        rows = writes.refresh_partitions(target(mixed), incoming, pc, values) if mixed else incoming
        dropped: list[Part] = []

        def keep(new: list[Part]) -> list[Part]:
            gone = {p["value"] for p in new if p["value"] is not None} if values is None else table.shown(pc, values) if table.exists() else set()
            dropped.extend(p for p in pure if p["value"] in gone)
            return [p for p in pure if p["value"] not in gone]

        deleted = target(mixed).where(F.coalesce(F.col(pc).isin(list(values)), F.lit(False))).count() if mixed and values else 0
        counted: dict[str, int] = {}

        def stats() -> dict[str, int]:
            if not counted:
                counted.update(seen() | {"rows_inserted": seen()["rows_in"], "rows_deleted": deleted + target(dropped).count()})
            return dict(counted)

        return _Step(rows, keep, pc, stats)

    def reconcile(self, target: str, business_key: list[str], *, collapse_duplicates: bool = True, run_id: str = "manual", now: datetime | None = None) -> scd.ReconcileCounts:
        """Repair a versioned table's timelines; nothing is written if nothing differs."""
        table, began = self.table(target), time.time()
        with table.locked():
            old = table.read()
            counts = scd.reconcile_counts(old, business_key, collapse_duplicates=collapse_duplicates, cols=self.cols)
            if counts.rows_collapsed or counts.rows_retimed or counts.rows_renumbered:
                table.commit(scd.reconcile(old, business_key, collapse_duplicates=collapse_duplicates, cols=self.cols), split=self.cols.is_current)
        if self.records:
            self.records.reconciled(target, run_id, counts, time.time() - began, now or datetime.now(timezone.utc).replace(tzinfo=None))
        return counts

    def load_periods(self, target: str, periods: list, read, **options: Any) -> list[WriteResult]:
        """One versioned write a period, in order; each takes effect on the period's first day."""
        if not periods:
            raise ValueError("the source has no periods")
        return [self.write(read(p), target, effective_date=p.effective_from, **options) for p in periods]


def _observed(df: DataFrame, drop: str | None = None, **counts) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """df, with figures that are counted while its rows are written."""
    seen = Observation()
    out = df.observe(seen, *[c.alias(name) for name, c in counts.items()])
    return out.drop(drop) if drop else out, lambda: dict(seen.get)


def _chosen(table: SnapshotTable, df: DataFrame, column: str, values: list | None, parts: list[Part]) -> tuple[list[Part], list[Part]]:
    """Parts that may hold rows of some partitions (those that come, where none are given), and the others."""
    if not parts:
        return [], []
    if values is None:
        values = [r[0] for r in df.select(column).distinct().collect()]
    wanted = table.shown(column, [v for v in values if v is not None])
    scope = [p for p in parts if p.get("by") != column or p["value"] in wanted or p["value"] is None and None in values]
    return scope, [p for p in parts if p not in scope]


def pii_drift(upstream: Contract, downstream: Contract) -> list[str]:
    """Columns that are personal upstream and, under the same name, not downstream."""
    plain = {c.name for c in downstream.columns} - set(downstream.pii_columns)
    return sorted(plain & set(upstream.pii_columns))

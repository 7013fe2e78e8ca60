"""Type 2 slowly changing dimensions: change detection, versioned writes, timeline repair, and reads as of a time.

Every function is pure: it takes the target and the incoming rows and returns the new target. One full outer join on the
business key classifies all rows, so a write costs one shuffle of either side; history rows that can't change pass by
it. Times come in as literals, never from the clock of an executor.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.hashing import row_hash

#: Columns that a hash never covers by default.
MANAGED = ("_lineage_id", "_lineage_key", "_source_file")


@dataclass(frozen=True)
class Scd2Columns:
    effective_from: str = "effective_from"
    effective_to: str = "effective_to"
    is_current: str = "is_current"
    row_hash: str = "row_hash"
    seq_id: str | None = "seq_id"
    end_of_time: str = "9999-12-31"

    def bookkeeping(self) -> list[str]:
        return [c for c in (self.effective_from, self.effective_to, self.is_current, self.row_hash, self.seq_id) if c]


def _keys(business_key: str | list[str]) -> list[str]:
    keys = [business_key] if isinstance(business_key, str) else list(business_key)
    if not keys:
        raise ValueError("business_key must not be empty")
    return keys


def _need(df: DataFrame, label: str, columns: list[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{label} lacks {missing}; it has {sorted(df.columns)}")


def hash_columns(df: DataFrame, business_key: str | list[str], tracked: list[str] | None = None, exclude: tuple[str, ...] = MANAGED) -> list[str]:
    """Tracked columns as given; else all but key, managed and metadata columns, by name; with none left, the key itself,
    so that rows differ by presence only."""
    keys = _keys(business_key)
    if tracked:
        return list(tracked)
    rest = sorted(c for c in df.columns if c not in keys and c not in exclude and not (c.startswith("_") and c.endswith(("_run_id", "_processed_at"))))
    return rest or sorted(keys)


def with_row_hash(df: DataFrame, business_key, tracked=None, *, cols: Scd2Columns = Scd2Columns(), exclude: tuple[str, ...] = MANAGED) -> DataFrame:
    return df.withColumn(cols.row_hash, row_hash(hash_columns(df, business_key, tracked, exclude), schema=df.schema))


def classify(incoming: DataFrame, current: DataFrame, business_key, hash_col: str = "row_hash") -> DataFrame:
    """Every key of either side with `change`: new, changed, unchanged or deleted; the sides as structs `incoming` and
    `current`. Null keys match nothing; a hash that is null on a side is neither changed nor unchanged and gets null."""
    keys = _keys(business_key)
    _need(incoming, "incoming", [*keys, hash_col])
    _need(current, "current", [*keys, hash_col])
    i = incoming.select(F.struct(*[F.col(f"`{c}`") for c in incoming.columns]).alias("incoming"))
    c = current.select(F.struct(*[F.col(f"`{x}`") for x in current.columns]).alias("current"))
    on = [i["incoming"][k] == c["current"][k] for k in keys]
    same = F.col(f"incoming.{hash_col}") == F.col(f"current.{hash_col}")
    change = F.when(F.col("current").isNull(), "new").when(F.col("incoming").isNull(), "deleted").when(same, "unchanged").when(~same, "changed")
    return i.join(c, on, "full_outer").withColumn("change", change)


@dataclass(frozen=True)
class Changes:
    """Lazy parts of a comparison; summary() runs one aggregate."""

    classified: DataFrame
    keys: list[str]
    detect_deletes: bool

    def _side(self, side: str, change: str) -> DataFrame:
        return self.classified.where(F.col("change") == change).select(f"{side}.*")

    @property
    def new(self) -> DataFrame:
        return self._side("incoming", "new")

    @property
    def changed(self) -> DataFrame:
        return self._side("incoming", "changed")

    @property
    def unchanged(self) -> DataFrame:
        return self._side("incoming", "unchanged")

    @property
    def deleted_keys(self) -> DataFrame:
        gone = self._side("current", "deleted").select(*self.keys)
        return gone if self.detect_deletes else gone.where(F.lit(False))

    def summary(self) -> dict[str, int]:
        counts = dict(self.classified.groupBy("change").count().collect())
        out = {k: counts.get(k, 0) for k in ("new", "changed", "unchanged")}
        return out | {"deleted": counts.get("deleted", 0) if self.detect_deletes else 0, "total_incoming": sum(n for k, n in counts.items() if k != "deleted")}


def detect_changes(incoming: DataFrame, current: DataFrame, business_key, hash_col: str = "row_hash", *, detect_deletes: bool = False) -> Changes:
    return Changes(classify(incoming, current, business_key, hash_col), _keys(business_key), detect_deletes)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with the number of copies."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def check_incoming(incoming: DataFrame, business_key, *, partition_column: str | None = None, cols: Scd2Columns = Scd2Columns(), detect_deletes: bool = False) -> int:
    """Raises on bookkeeping columns, null keys, repeated keys, and on no rows with detect_deletes; returns the rows. One
    aggregate, and a second one only to name repeated keys."""
    keys = _keys(business_key)
    _need(incoming, "incoming", keys)
    if managed := [c for c in cols.bookkeeping() if c in incoming.columns and c != cols.row_hash]:
        raise ValueError(f"incoming must not hold bookkeeping columns: {managed}")
    scope = [*keys, *([partition_column] if partition_column else [])]
    per_key = incoming.groupBy(*scope).agg(F.count("*").alias("copies"))
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    rows, repeated, nulls = per_key.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count_if(F.col("copies") > 1), F.coalesce(F.sum(F.when(null_key, F.col("copies"))), F.lit(0))).first()
    if nulls:
        raise ValueError(f"{nulls} incoming rows have a null in the business key {keys}")
    if repeated:
        sample = [r.asDict() for r in duplicate_keys(incoming, scope).orderBy(F.desc("copies"), *scope).limit(5).collect()]
        raise ValueError(f"{repeated} business keys occur more than once, such as {sample}")
    if detect_deletes and not rows:
        raise ValueError("no incoming rows: with detect_deletes every current row would end")
    return rows


def _time(value, kind) -> Column:
    return F.lit(value).cast(kind)


def apply_scd2(target: DataFrame, incoming: DataFrame, business_key, at: date | datetime | str, *, detect_deletes: bool = False, partition_column: str | None = None, partition_values: list | None = None, cols: Scd2Columns = Scd2Columns(), history: DataFrame | None = None) -> DataFrame:
    """The new target. incoming carries row_hash; `at` ends expired versions and starts their successors. With a
    partition column, rows of other partitions than partition_values are out of scope: they neither match, end, nor count
    for the sequence. history holds ended versions that aren't part of target but count for the sequence."""
    scope = {"detect_deletes": detect_deletes, "partition_column": partition_column, "partition_values": partition_values, "cols": cols}
    return apply_scd2_marked(target, incoming, business_key, at, history=history, **scope).drop("_action")


def apply_scd2_marked(target: DataFrame, incoming: DataFrame, business_key, at, *, detect_deletes: bool = False, partition_column: str | None = None, partition_values: list | None = None, cols: Scd2Columns = Scd2Columns(), history: DataFrame | None = None) -> DataFrame:
    """As apply_scd2, with `_action`: kept, absent, expired or deleted for a current version, new or changed for one that
    comes, null for versions that were ended before.

    Target versions are brought together by key once, the current one with the greatest number, so either side is shuffled
    once; each key turns into none, one or two rows in place."""
    keys = _keys(business_key)
    live = _live(partition_column, partition_values, cols)
    kinds = {f.name: f.dataType for f in target.schema}
    numbered = bool(cols.seq_id) and cols.seq_id in kinds
    on = [*keys, *([partition_column] if partition_column else [])]
    i = incoming.select(F.struct(*[F.col(f"`{c}`") for c in incoming.columns]).alias("incoming"))
    if partition_column:
        # one key's numbers go over all partitions in scope, its current versions don't
        joined = classify(incoming, target.where(live), on, cols.row_hash)
        if numbered:
            top = target.where(_scope(partition_column, partition_values)).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(cols.seq_id).alias("_top"))
            joined = joined.join(top, [F.col(f"incoming.{k}") == F.col(f"_{k}") for k in keys], "left")
    else:
        _need(incoming, "incoming", [*keys, cols.row_hash])
        whole = F.when(live, F.struct(*[F.col(f"`{c}`") for c in target.columns])).alias("_now")
        seq = (F.col(cols.seq_id) if numbered else F.lit(None)).cast("int").alias("_seq")
        held = target.where(live if not numbered else F.lit(True)).select(*keys, whole, seq)
        if history is not None and numbered:
            held = held.unionByName(history.select(*keys, F.lit(None).cast(held.schema["_now"].dataType).alias("_now"), seq))
        held = held.groupBy(*keys).agg(F.collect_list("_now").alias("_nows"), F.max("_seq").alias("_top"))
        joined = i.join(held, [F.col(f"incoming.{k}") == F.col(k) for k in keys], "full_outer").select("incoming", "_top", F.explode_outer("_nows").alias("current"))
        same = F.col(f"incoming.`{cols.row_hash}`") == F.col(f"current.`{cols.row_hash}`")
        known, comes = F.col("current").isNotNull(), F.col("incoming").isNotNull()
        joined = joined.where(known | comes).withColumn("change", F.when(~known, "new").when(~comes, "deleted").when(same, "unchanged").when(~same, "changed"))
    change = F.coalesce("change", F.lit("unchanged"))
    ends = change.isin(["changed", "deleted"] if detect_deletes else ["changed"])
    fixed = {cols.effective_from: _time(at, kinds[cols.effective_from]), cols.effective_to: _time(cols.end_of_time, kinds[cols.effective_to]), cols.is_current: F.lit(True)}
    if numbered:
        fixed[cols.seq_id] = F.coalesce("_top", F.lit(0)) + 1
    old, fresh = [], []
    for name, kind in kinds.items():
        was = F.col(f"current.`{name}`")
        if name == cols.effective_to:
            was = F.when(ends, _time(at, kind)).otherwise(was)
        elif name == cols.is_current:
            was = was & ~ends
        old.append(was.cast(kind).alias(name))
        comes = fixed.get(name, F.col(f"incoming.`{name}`") if name in incoming.columns else F.lit(None))
        fresh.append(comes.cast(kind).alias(name))
    was = F.when(change == "unchanged", "kept").when(change == "changed", "expired").otherwise("deleted" if detect_deletes else "absent")
    rows = F.array(F.when(change != "new", F.struct(*old, was.alias("_action"))), F.when(change.isin("new", "changed"), F.struct(*fresh, change.alias("_action"))))
    return target.where(~live).withColumn("_action", F.lit(None).cast("string")).unionByName(joined.select(F.inline(F.array_compact(rows))))


def action_counts() -> list[Column]:
    """Of marked rows: the figures of scd2_stats."""
    n = lambda *kinds: F.count_if(F.col("_action").isin(*kinds))
    return [n("new").alias("rows_new"), n("expired").alias("rows_expired"), n("new", "changed").alias("rows_inserted"), n("kept").alias("rows_unchanged"), n("deleted").alias("rows_deleted")]


def _scope(partition_column: str | None, partition_values: list | None) -> Column:
    return F.coalesce(F.col(partition_column).isin(list(partition_values or [])), F.lit(False)) if partition_column else F.lit(True)


def _live(partition_column: str | None, partition_values: list | None, cols: Scd2Columns) -> Column:
    return F.coalesce(F.col(cols.is_current), F.lit(False)) & _scope(partition_column, partition_values)


def _stats(detect_deletes: bool) -> list[Column]:
    n = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
    same = F.count_if(F.col("change").isNull() | (F.col("change") == "unchanged"))
    deleted = n("deleted") if detect_deletes else F.lit(0).cast("long")
    return [n("new").alias("rows_new"), n("changed").alias("rows_expired"), n("new", "changed").alias("rows_inserted"), same.alias("rows_unchanged"), F.max(deleted).alias("rows_deleted") if not detect_deletes else deleted.alias("rows_deleted")]


def scd2_stats(incoming: DataFrame, target: DataFrame, business_key, *, detect_deletes: bool = False, partition_column=None, partition_values=None, cols: Scd2Columns = Scd2Columns()) -> DataFrame:
    """One row: rows_new, rows_expired, rows_inserted, rows_unchanged and rows_deleted of a write."""
    on = [*_keys(business_key), *([partition_column] if partition_column else [])]
    joined = classify(incoming, target.where(_live(partition_column, partition_values, cols)), on, cols.row_hash)
    return joined.agg(*_stats(detect_deletes)).na.fill(0)


def _timeline(business_key, cols: Scd2Columns, *more: str) -> Window:
    return Window.partitionBy(*_keys(business_key)).orderBy(*[F.col(c) for c in (cols.effective_from, *more)])


def collapse(table: DataFrame, business_key, *, cols: Scd2Columns = Scd2Columns()) -> DataFrame:
    """Of neighbouring versions of a key with the same hash the first stays. Ties in time go by sequence, then hash."""
    ties = [c for c in (cols.seq_id, cols.row_hash) if c and c in table.columns]
    w = _timeline(business_key, cols, *ties)
    return table.withColumn("_before", F.lag(cols.row_hash).over(w)).where(F.coalesce(F.col("_before") != F.col(cols.row_hash), F.lit(True))).drop("_before")


def restitch(table: DataFrame, business_key, *, cols: Scd2Columns = Scd2Columns()) -> DataFrame:
    """Each version ends where the next one starts; the last one is current and never ends."""
    kinds = {f.name: f.dataType for f in table.schema}
    ties = [c for c in (cols.seq_id, cols.row_hash) if c and c in table.columns]
    w = _timeline(business_key, cols, *ties)
    following = F.lead(cols.effective_from).over(w).cast(kinds[cols.effective_to])
    return table.withColumns({cols.effective_to: F.coalesce(following, _time(cols.end_of_time, kinds[cols.effective_to])), cols.is_current: F.lead(F.lit(True)).over(w).isNull()})


def renumber(table: DataFrame, business_key, *, cols: Scd2Columns = Scd2Columns()) -> DataFrame:
    """Sequence numbers from 1 along each key's timeline."""
    if not cols.seq_id or cols.seq_id not in table.columns:
        return table
    w = _timeline(business_key, cols, cols.seq_id, cols.row_hash)
    return table.withColumn(cols.seq_id, F.row_number().over(w).cast(table.schema[cols.seq_id].dataType))


def reconcile(table: DataFrame, business_key, *, collapse_duplicates: bool = True, cols: Scd2Columns = Scd2Columns()) -> DataFrame:
    """Collapse, restitch and renumber; all windows share one partitioning, so the table is shuffled once."""
    if collapse_duplicates:
        table = collapse(table, business_key, cols=cols)
    return renumber(restitch(table, business_key, cols=cols), business_key, cols=cols)


@dataclass(frozen=True)
class ReconcileCounts:
    rows_collapsed: int
    rows_retimed: int
    rows_renumbered: int
    notes: list[str] = field(default_factory=list)


def reconcile_counts(table: DataFrame, business_key, *, collapse_duplicates: bool = True, cols: Scd2Columns = Scd2Columns()) -> ReconcileCounts:
    """What a reconcile changes, without writing: rows that go, rows whose end or current flag moves, and rows whose
    number moves. Old values ride along under other names, so no join is needed."""
    marked = table.withColumns({"_to": F.col(cols.effective_to), "_cur": F.col(cols.is_current), "_seq": F.col(cols.seq_id) if cols.seq_id in table.columns else F.lit(None).cast("int")})
    out = reconcile(marked, business_key, collapse_duplicates=collapse_duplicates, cols=cols)
    moved = ~F.col("_to").eqNullSafe(F.col(cols.effective_to)) | ~F.col("_cur").eqNullSafe(F.col(cols.is_current))
    numbered = ~F.col("_seq").eqNullSafe(F.col(cols.seq_id)) if cols.seq_id in table.columns else F.lit(False)
    left, retimed, renumbered = out.agg(F.count("*"), F.count_if(moved), F.count_if(numbered)).first()
    return ReconcileCounts(table.count() - left, retimed, renumbered)


def as_of(table: DataFrame, at, *, cols: Scd2Columns = Scd2Columns()) -> DataFrame:
    """Versions in force at a time: started by then, not ended by then."""
    kinds = {f.name: f.dataType for f in table.schema}
    return table.where((F.col(cols.effective_from) <= _time(at, kinds[cols.effective_from])) & (F.col(cols.effective_to) > _time(at, kinds[cols.effective_to])))


def current_rows(table: DataFrame, *, cols: Scd2Columns = Scd2Columns()) -> DataFrame:
    return table.where(F.col(cols.is_current))

"""Write modes as pure functions (target, incoming) -> new target: append, full and partition refresh, and upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = "_input_order"


def check_columns(target: DataFrame, incoming: DataFrame) -> None:
    """Rows must not bring columns that the table has no place for."""
    if extra := [c for c in incoming.columns if c not in target.columns]:
        raise ValueError(f"the table has no columns {extra}; it has {sorted(target.columns)}")


def conform(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming in the target's layout and types; columns that it lacks are null."""
    check_columns(target, incoming)
    return incoming.select(*[(F.col(f"`{f.name}`") if f.name in incoming.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema])


def append(target: DataFrame, incoming: DataFrame) -> DataFrame:
    return target.unionByName(conform(target, incoming))


def full_refresh(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming in the target's layout; columns that it lacks are null."""
    return conform(target, incoming)


def refresh_partitions(target: DataFrame, incoming: DataFrame, partition_column: str, values: list | None = None) -> DataFrame:
    """Rows of the given partitions give way to incoming, even where incoming has none of them. Without values, those of
    incoming count. Rows whose partition is null stay."""
    if values is None:
        gone = incoming.select(F.col(partition_column).alias("_gone")).where(F.col("_gone").isNotNull()).distinct()
        kept = target.join(gone, F.col(partition_column) == F.col("_gone"), "left_anti")
    else:
        kept = target.where(~F.coalesce(F.col(partition_column).isin(list(values)), F.lit(False))) if values else target
        incoming = incoming if values else incoming.where(F.lit(False))
    return kept.unionByName(conform(target, incoming))


def has_input_order(df: DataFrame) -> bool:
    """Whether the order of the scan reaches the rows: behind an exchange it does not."""
    return "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def with_input_order(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """An order of the input's rows: the given columns, else the scan's order, which holds for one file or listed files."""
    if not order_by and not has_input_order(df):
        raise ValueError("the input's rows have gone through an exchange; name the columns of their order in order_by")
    return df.withColumn(ORDER, F.struct(*order_by) if order_by else F.monotonically_increasing_id())


def last_input_wins(incoming: DataFrame, primary_key: list[str], order_by: list[str] | None = None) -> DataFrame:
    """One row a key, the last in input order, by one partial aggregate without a sort."""
    rest = [c for c in incoming.columns if c not in primary_key]
    ordered = with_input_order(incoming, order_by)
    picked = ordered.groupBy(*primary_key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(1), ORDER).alias("_row"))
    return picked.select(*primary_key, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*incoming.columns)


def null_key_counts(incoming: DataFrame, primary_key: list[str]) -> dict[str, int]:
    row = incoming.agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in primary_key]).first()
    return {k: row[k] for k in primary_key if row[k]}


def check_upsert(incoming: DataFrame, primary_key: list[str]) -> None:
    if not primary_key:
        raise ValueError("an upsert needs a primary key")
    if missing := [k for k in primary_key if k not in incoming.columns]:
        raise ValueError(f"incoming lacks key columns {missing}")
    if counts := null_key_counts(incoming, primary_key):
        raise ValueError(f"nulls in key columns: {counts}")


def upsert(target: DataFrame, incoming: DataFrame, primary_key: list[str], update_columns: list[str] | None = None, *, skip_unchanged: bool = False, order_by: list[str] | None = None) -> DataFrame:
    """Rows with a known key take over update_columns (None: all but the key, empty: nothing); others are inserted whole.
    skip_unchanged leaves rows as they are unless an update column differs, nulls compared as values."""
    return upsert_marked(target, incoming, primary_key, update_columns, skip_unchanged=skip_unchanged, order_by=order_by).drop("_action")


def upsert_marked(target: DataFrame, incoming: DataFrame, primary_key: list[str], update_columns: list[str] | None = None, *, skip_unchanged: bool = False, order_by: list[str] | None = None) -> DataFrame:
    """As upsert, with `_action`: kept, updated or inserted."""
    check_columns(target, incoming)
    new = last_input_wins(incoming, primary_key, order_by)
    columns = [c for c in target.columns if c in new.columns]
    moved = [c for c in (columns if update_columns is None else update_columns) if c not in primary_key]
    # keys stand beside the rows, so that the join takes over the partitioning of the aggregate
    t = target.select(*[F.col(f"`{k}`").alias(f"_t_{k}") for k in primary_key], F.struct(*[F.col(f"`{c}`") for c in target.columns]).alias("t"))
    n = new.select(*[F.col(f"`{k}`").alias(f"_n_{k}") for k in primary_key], F.struct(*[F.col(f"`{c}`") for c in new.columns]).alias("n"))
    joined = t.join(n, [F.col(f"`_t_{k}`") == F.col(f"`_n_{k}`") for k in primary_key], "full_outer").select("t", "n")
    both = F.col("t").isNotNull() & F.col("n").isNotNull()
    touched = both & F.lit(bool(moved))
    if skip_unchanged and moved:
        differs = F.lit(False)
        for c in moved:
            differs = differs | ~F.col(f"t.`{c}`").eqNullSafe(F.col(f"n.`{c}`"))
        touched = touched & differs
    action = F.when(F.col("t").isNull(), "inserted").when(touched, "updated").otherwise("kept")
    out = []
    for f in target.schema:
        old = F.col(f"t.`{f.name}`")
        fresh = F.col(f"n.`{f.name}`").cast(f.dataType) if f.name in new.columns else F.lit(None).cast(f.dataType)
        out.append(F.when(F.col("_action") == "inserted", fresh).when(F.col("_action") == "updated", fresh if f.name in moved else old).otherwise(old).alias(f.name))
    return joined.withColumn("_action", action).select(*out, "_action")

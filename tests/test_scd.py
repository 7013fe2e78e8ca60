
import pytest
from pyspark.sql import functions as F

from quarryline.operators import scd, writes

SCHEMA = "id int, name string, price double"


def load(spark, rows):
    return scd.with_row_hash(spark.createDataFrame(rows, SCHEMA), "id", ["name", "price"])


def empty(spark):
    return spark.createDataFrame([], SCHEMA + ", row_hash string, effective_from timestamp, effective_to timestamp, is_current boolean, seq_id int")


def step(table, incoming, at, **options):
    return scd.apply_scd2(table, incoming, "id", at, **options)


def shown(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_history_over_three_loads(spark):
    t = step(empty(spark), load(spark, [(1, "a", 1.0), (2, "b", 2.0)]), "2024-01-01")
    t = step(t, load(spark, [(1, "a", 1.0), (2, "b", 3.0), (3, "c", 1.0)]), "2024-02-01", detect_deletes=True)
    t = step(t, load(spark, [(2, "b", 3.0)]), "2024-03-01", detect_deletes=True)
    t = step(t, load(spark, [(1, "a", 1.0), (2, "b", 3.0)]), "2024-04-01", detect_deletes=True)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    got = shown(t.select("id", "price", day("effective_from"), day("effective_to"), "is_current", "seq_id"), "*")
    assert got == sorted([
        (1, 1.0, "2024-01-01", "2024-03-01", False, 1), (1, 1.0, "2024-04-01", "9999-12-31", True, 2), (2, 2.0, "2024-01-01", "2024-02-01", False, 1),
        (2, 3.0, "2024-02-01", "9999-12-31", True, 2), (3, 1.0, "2024-02-01", "2024-03-01", False, 1),
    ], key=repr)
    again = step(t, load(spark, [(1, "a", 1.0), (2, "b", 3.0)]), "2024-05-01", detect_deletes=True)
    assert shown(again, "*") == shown(t, "*")
    assert scd.as_of(t, "2024-02-15").count() == 3 and scd.current_rows(t).count() == 2


def test_guards(spark):
    good = load(spark, [(1, "a", 1.0)])
    assert scd.check_incoming(good, "id") == 1
    for rows, text in (([(1, "a", 1.0), (1, "b", 1.0)], "more than once"), ([(None, "a", 1.0)], "null in the business key")):
        with pytest.raises(ValueError, match=text):
            scd.check_incoming(load(spark, rows), "id")
    with pytest.raises(ValueError, match="no incoming rows"):
        scd.check_incoming(good.where("false"), "id", detect_deletes=True)
    with pytest.raises(ValueError, match="bookkeeping"):
        scd.check_incoming(good.withColumn("is_current", F.lit(True)), "id")
    with pytest.raises(ValueError):
        scd.detect_changes(good.drop("row_hash"), good, "id")


def test_detect_changes_and_hash_columns(spark):
    old, new = load(spark, [(1, "a", 1.0), (2, "b", 2.0), (4, "d", 1.0)]), load(spark, [(1, "a", 1.0), (2, "b", 9.0), (3, "c", 1.0)])
    assert scd.detect_changes(new, old, ["id"], detect_deletes=True).summary() == {"new": 1, "changed": 1, "unchanged": 1, "deleted": 1, "total_incoming": 3}
    assert scd.detect_changes(new, old, "id").deleted_keys.count() == 0
    df = spark.createDataFrame([(1, 2, "x", "y", 3)], "b int, a int, _lineage_id string, _silver_run_id string, c int")
    assert scd.hash_columns(df, "b") == ["a", "c"] and scd.hash_columns(df.select("a", "b"), ["b", "a"]) == ["a", "b"]


def test_reconcile_is_idempotent_and_counts(spark):
    rows = [(1, "x", 1.0, "h1", d, "2024-01-01", False, s) for d, s in (("2024-03-01", 9), ("2024-01-01", 4), ("2024-02-01", 4))] + [(1, "y", 1.0, "h2", "2024-04-01", "2024-01-01", False, 1), (2, "z", 1.0, None, "2024-01-01", "9999-12-31", True, 1)]
    t = spark.createDataFrame(rows, SCHEMA + ", row_hash string, f string, t string, is_current boolean, seq_id int")
    t = t.select("id", "name", "price", "row_hash", F.to_timestamp("f").alias("effective_from"), F.to_timestamp("t").alias("effective_to"), "is_current", "seq_id")
    once = scd.reconcile(t, "id")
    assert shown(once, "id", "name", "is_current", "seq_id") == [(1, "x", False, 1), (1, "y", True, 2), (2, "z", True, 1)]
    assert shown(scd.reconcile(once, "id"), "*") == shown(once, "*")
    c = scd.reconcile_counts(t, "id")
    assert (c.rows_collapsed, c.rows_retimed, c.rows_renumbered) == (2, 2, 2)


def test_upsert_properties(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0)], SCHEMA)
    new = spark.createDataFrame([(2, "x", 5.0), (2, "y", 6.0), (3, None, None)], SCHEMA)
    once = writes.upsert(t, new, ["id"], order_by=["price"])
    assert shown(once, "*") == [(1, "a", 1.0), (2, "y", 6.0), (3, None, None)]
    assert shown(writes.upsert(once, new, ["id"], order_by=["price"]), "*") == shown(once, "*")
    assert shown(writes.upsert(t, new, ["id"], ["name"], order_by=["price"]), "*") == [(1, "a", 1.0), (2, "y", 2.0), (3, None, None)]
    same = writes.upsert_marked(t, t, ["id"], skip_unchanged=True)
    assert {r["_action"] for r in same.collect()} == {"kept"}
    with pytest.raises(ValueError, match="nulls in key"):
        writes.check_upsert(spark.createDataFrame([(None, "a", 1.0)], SCHEMA), ["id"])


def test_partition_refresh_keeps_null_partitions(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, p string")
    new = spark.createDataFrame([(9, "a")], "id int, p string")
    assert shown(writes.refresh_partitions(t, new, "p", ["a", "b"]), "id", "p") == [(3, None), (9, "a")]
    assert shown(writes.refresh_partitions(t, new.where("false"), "p", ["a"]), "id", "p") == [(2, "b"), (3, None)]
    assert shown(writes.refresh_partitions(t, new, "p", []), "id", "p") == shown(t, "id", "p")


def test_checksum_ignores_order(spark):
    from quarryline.operators.aggregates import table_checksum

    df = spark.range(100).withColumn("x", F.col("id") * 1.5)
    a, b, c = (tuple(table_checksum(d).first()) for d in (df, df.orderBy(F.desc("id")).repartition(7), df.where("id > 0")))
    assert a == b and a != c

"""Every registered query against its SQL, in DuckDB, over the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from quarryline import queries as own


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got, want = own.QUERIES[name](spark, sf_dir), duck.sql(own.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(own.QUERIES) == set(own.SQL)


def test_entry(spark):
    assert {r["change"] for r in entry_point.entry(spark).collect()} == {"new", "changed", "unchanged", "deleted"}


def test_plans_stay_in_the_engine(spark, sf_dir):
    for name in ("scd2_apply", "scd2_reconcile", "upsert_last_wins", "row_hash", "check_pattern", "ndc_normalize"):
        plan = own.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan and "Pandas" not in plan, name


def test_reconcile_shuffles_once(spark, sf_dir):
    plan = own.scd2_reconcile(spark, sf_dir)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_filters_reach_the_scan(spark, sf_dir):
    plan = own.read_projection_filter(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "In(o_orderpriority" in plan and "o_custkey" not in plan

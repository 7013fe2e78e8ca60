"""Registered queries of the library's own operators over the driver tables, each with SQL that gives the same rows."""

from __future__ import annotations

import io
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from datetime import date, datetime
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline import functions as fn
from quarryline.operators import aggregates, checks, lineage, scd, writes
from quarryline.operators.checks import Rule
from quarryline.plans import periods
from quarryline.plans.contracts import DataSource, Period, build_contract
from quarryline.plans.sink import TableSink
from quarryline.sources import ingest, objects, outputs, readers
from quarryline.streaming import batched, sensors
from quarryline.support import rendering, safety

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Rules that look at the clock are held against this moment.
NOW = datetime(2001, 1, 1)


def query(sql: str | None = None, name: str | None = None, *, text: str = ""):
    """Registers a query. Columns named in text (decimals, dates, times to the year 9999) are given as text on both sides,
    so that no client's date or number type gets in the way of a comparison."""

    def add(f):
        shown = (lambda spark, sf_dir: f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in text.split()})) if text else f
        QUERIES[name or f.__name__] = shown
        if sql:
            casts = ", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in text.split())
            SQL[name or f.__name__] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if text else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """A fresh folder for tables that a query makes: in the shared checkpoint folder where the session has one."""
    named = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = named.get() if named.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tables-")
    return f"{base}/tables-{uuid.uuid4().hex}"


# Fixtures, each in both languages.
PADDED = "SELECT p_partkey AS k, repeat(' ', CAST(p_partkey % 3 AS INTEGER)) || CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN p_name ELSE CAST(p_size AS VARCHAR) END || chr(9) AS t, CASE p_partkey % 7 WHEN 0 THEN ' Yes' WHEN 1 THEN 'n ' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'f' WHEN 4 THEN '1' WHEN 5 THEN 'maybe' ELSE NULL END AS b FROM part"


def padded(spark, sf_dir):
    k = F.col("p_partkey")
    words = F.when(k % 5 == 0, "").when(k % 5 == 1, F.col("p_name")).otherwise(F.col("p_size").cast("string"))
    flags = F.when(k % 7 == 0, " Yes").when(k % 7 == 1, "n ").when(k % 7 == 2, "TRUE").when(k % 7 == 3, "f").when(k % 7 == 4, "1").when(k % 7 == 5, "maybe")
    return table(spark, sf_dir, "part").select(k.alias("k"), F.concat(F.repeat(F.lit(" "), (k % 3).cast("int")), words, F.lit("\t")).alias("t"), flags.alias("b"))


BAL = "CAST(c_acctbal AS DECIMAL(12,2))"
HASH = "sha256(concat_ws('|', coalesce(c_name, chr(0)), coalesce(c_mktsegment, chr(0)), coalesce(CAST(bal AS VARCHAR), chr(0))))"
_COLS = f"c_custkey, c_name, c_mktsegment, {BAL} AS bal"
CURRENT = f"SELECT *, {HASH} AS row_hash FROM (SELECT {_COLS} FROM customer WHERE c_custkey % 10 <> 0)"
INCOMING = f"SELECT *, {HASH} AS row_hash FROM (SELECT c_custkey, c_name, c_mktsegment, CAST({BAL} + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS DECIMAL(12,2)) AS bal FROM customer WHERE c_custkey % 11 <> 0)"
TRACKED = ["c_name", "c_mktsegment", "bal"]


def current_customers(spark, sf_dir):
    df = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select("c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").cast("decimal(12,2)").alias("bal"))
    return scd.with_row_hash(df, "c_custkey", TRACKED)


def incoming_customers(spark, sf_dir):
    bal = (F.col("c_acctbal").cast("decimal(12,2)") + F.when(F.col("c_custkey") % 7 == 0, 1).otherwise(0)).cast("decimal(12,2)")
    df = table(spark, sf_dir, "customer").where("c_custkey % 11 <> 0").select("c_custkey", "c_name", "c_mktsegment", bal.alias("bal"))
    return scd.with_row_hash(df, "c_custkey", TRACKED)


DAY0, DAY1, END = "TIMESTAMP '2024-01-01'", "TIMESTAMP '2024-02-01'", "TIMESTAMP '9999-12-31'"
# the target: current customers at sequence 1, and for every third one an earlier, closed version numbered 1 before number 2
TARGET = f"SELECT *, {DAY0} AS effective_from, {END} AS effective_to, true AS is_current, CAST(CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS seq_id FROM ({CURRENT}) UNION ALL SELECT c_custkey, c_name, c_mktsegment, bal, 'old', TIMESTAMP '2023-01-01', {DAY0}, false, 1 FROM ({CURRENT}) WHERE c_custkey % 3 = 0"


def scd_target(spark, sf_dir):
    now = current_customers(spark, sf_dir)
    stamp = lambda s: F.lit(s).cast("timestamp")
    live = now.withColumns({"effective_from": stamp("2024-01-01"), "effective_to": stamp("9999-12-31"), "is_current": F.lit(True), "seq_id": F.when(F.col("c_custkey") % 3 == 0, 2).otherwise(1).cast("int")})
    old = now.where("c_custkey % 3 = 0").withColumns({"row_hash": F.lit("old"), "effective_from": stamp("2023-01-01"), "effective_to": stamp("2024-01-01"), "is_current": F.lit(False), "seq_id": F.lit(1)})
    return live.unionByName(old)


VERSIONS = "SELECT c_custkey, 'h' || CAST((c_custkey * (v // 2)) % 3 AS VARCHAR) AS row_hash, TIMESTAMP '2024-01-01' + to_days(CAST(30 * v AS INTEGER)) AS effective_from, TIMESTAMP '2024-01-01' AS effective_to, false AS is_current, CAST(5 - v AS INTEGER) AS seq_id FROM customer, (SELECT unnest([1,2,3,4]) AS v)"


def versions(spark, sf_dir):
    v = F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4)])).alias("v")
    rows = table(spark, sf_dir, "customer").select("c_custkey", v)
    start = F.lit("2024-01-01").cast("timestamp")
    h = F.concat(F.lit("h"), ((F.col("c_custkey") * F.floor(F.col("v") / 2)) % 3).cast("string"))
    return rows.select("c_custkey", h.alias("row_hash"), (start + F.make_dt_interval((F.col("v") * 30).cast("int"))).alias("effective_from"), start.alias("effective_to"), F.lit(False).alias("is_current"), (5 - F.col("v")).cast("int").alias("seq_id"))


# Column functions ----------------------------------------------------------------------------------------------------
_TRIM = r"nullif(regexp_replace(t, '^\s+|\s+$', '', 'g'), '')"


@query(f"SELECT k, {_TRIM} AS v FROM ({PADDED})")
def clean_text(spark, sf_dir):
    return padded(spark, sf_dir).select("k", fn.clean_text("t").alias("v"))


@query(f"SELECT k, TRY_CAST({_TRIM} AS BIGINT) AS v FROM ({PADDED})")
def safe_int(spark, sf_dir):
    return padded(spark, sf_dir).select("k", fn.safe_int("t", "null").alias("v"))


@query(f"SELECT k, TRY_CAST({_TRIM} AS DOUBLE) AS v FROM ({PADDED})")
def safe_decimal(spark, sf_dir):
    return padded(spark, sf_dir).select("k", fn.safe_decimal("t", "null").alias("v"))


@query(f"SELECT k, CASE WHEN lower(trim(b)) IN ('t','true','1','yes','y') THEN true WHEN lower(trim(b)) IN ('f','false','0','no','n') THEN false END AS v FROM ({PADDED})")
def safe_bool(spark, sf_dir):
    return padded(spark, sf_dir).select("k", fn.safe_bool("b").alias("v"))


_DATES = "SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m%d') WHEN 2 THEN strftime(o_orderdate, '%d-%b-%y') WHEN 3 THEN strftime(o_orderdate, '%d-%b-%Y') WHEN 4 THEN strftime(o_orderdate, '%b %d, %Y') WHEN 5 THEN ' ' || strftime(o_orderdate, '%Y/%m/%d') ELSE 'n/a' END AS t, CAST(o_orderdate AS DATE) AS d FROM orders"


def _dates(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 7
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyyMMdd")).when(k == 2, F.date_format(d, "dd-MMM-yy")).when(k == 3, F.date_format(d, "dd-MMM-yyyy"))
    text = text.when(k == 4, F.date_format(d, "MMM dd, yyyy")).when(k == 5, F.concat(F.lit(" "), F.date_format(d, "yyyy/MM/dd"))).otherwise("n/a")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), text.alias("t"))


@query(f"SELECT k, CASE WHEN k % 7 < 6 THEN d END AS v FROM ({_DATES})", text="v")
def safe_date_multi(spark, sf_dir):
    return _dates(spark, sf_dir).select("k", fn.safe_date("t").alias("v"))


@query("SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS v FROM orders", text="v")
def safe_date_two_digit_year(spark, sf_dir):
    text = F.date_format("o_orderdate", "dd-MMM-yy")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), fn.safe_date(text, format="%d-%b-%y").alias("v"))


@query("SELECT event_id AS k, date_trunc('second', ts) AS v FROM events", text="v")
def safe_datetime(spark, sf_dir):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), text.alias("t")).select("k", fn.safe_datetime("t").alias("v"))


_NDC = "SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN p_size || '-' || p_partkey WHEN 1 THEN p_size || '-' || p_partkey || '-7' WHEN 2 THEN CAST(1000000000 + p_partkey AS VARCHAR) WHEN 3 THEN CAST(p_partkey AS VARCHAR) WHEN 4 THEN 'no digits' ELSE CAST(123456789012345 + p_partkey AS VARCHAR) END AS t FROM part"
_LP = "CASE WHEN length({0}) >= {1} THEN {0} ELSE lpad({0}, {1}, '0') END"
_E = "substr(CASE WHEN length(t) = 10 THEN '0' || t WHEN length(t) < 11 THEN lpad(t, 11, '0') ELSE t END, 1, 11)"


@query(f"SELECT k, CASE WHEN k % 6 = 0 THEN {_LP.format("split_part(t,'-',1)", 5)} || '-' || {_LP.format("split_part(t,'-',2)", 4)} || '-00' WHEN k % 6 = 1 THEN {_LP.format("split_part(t,'-',1)", 5)} || '-' || {_LP.format("split_part(t,'-',2)", 4)} || '-07' WHEN k % 6 = 4 THEN NULL ELSE substr({_E},1,5) || '-' || substr({_E},6,4) || '-' || substr({_E},10,2) END AS v FROM ({_NDC})")
def ndc_normalize(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 6 == 0, F.concat(size, F.lit("-"), k)).when(k % 6 == 1, F.concat(size, F.lit("-"), k, F.lit("-7"))).when(k % 6 == 2, (k + 1000000000).cast("string")).when(k % 6 == 3, k.cast("string")).when(k % 6 == 4, "no digits").otherwise((k + 123456789012345).cast("string"))
    return table(spark, sf_dir, "part").select(k.alias("k"), text.alias("t")).select("k", fn.normalize_ndc("t", force_package=True).alias("v"))


_NAMES = "SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'The ' || c_name || ', Inc.' WHEN 1 THEN c_name || ' & Sons LLC' WHEN 2 THEN '  ' || c_name || '   Pty. Ltd. ' WHEN 3 THEN '...' ELSE c_name END AS t FROM customer"


@query(f"SELECT k, CASE WHEN k % 5 = 3 THEN NULL ELSE trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(t), ' & ', ' and '), '^the\\s+', ''), '(\\s*,)?\\s+(inc\\.|inc|llc|pty\\. ltd\\.)\\.?\\s*$', ''), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')) END AS v FROM ({_NAMES})")
def text_normalize(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_name")
    text = F.when(k % 5 == 0, F.concat(F.lit("The "), n, F.lit(", Inc."))).when(k % 5 == 1, F.concat(n, F.lit(" & Sons LLC"))).when(k % 5 == 2, F.concat(F.lit("  "), n, F.lit("   Pty. Ltd. "))).when(k % 5 == 3, "...").otherwise(n)
    normal = fn.TextNormalizer(strip_suffixes=True, strip_prefixes=True, symbol_mappings=True)
    return table(spark, sf_dir, "customer").select(k.alias("k"), text.alias("t")).select("k", normal.column("t").alias("v"))


@query("SELECT o_orderkey, sha256(concat_ws('|', o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR), CASE WHEN o_orderkey % 4 = 0 THEN chr(0) ELSE o_orderpriority END)) AS row_hash FROM orders")
def row_hash(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(14,2)").alias("price"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("priority"))
    return df.select("o_orderkey", fn.row_hash(["o_orderstatus", "price", "priority"]).alias("row_hash"))


@query("SELECT page_id, nullif(regexp_replace(translate(replace(url || ' a%20b', '%20', ' '), '/:*?<>|', ''), ' +', '_', 'g'), '') AS v FROM pages")
def filename_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fn.sanitize_filename(F.concat("url", F.lit(" a%20b"))).alias("v"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_name ELSE p_name || '.csv' END AS v FROM part")
def strip_extension(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(".TXT"))).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.concat("p_name", F.lit(".csv")))
    return table(spark, sf_dir, "part").select("p_partkey", fn.strip_extension(name, [".txt", ".dat"]).alias("v"))


@query("SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, CAST(o_orderdate AS DATE) - CAST((isodow(o_orderdate) - 1 - 2 + 7) % 7 AS INTEGER) AS week FROM orders", text="month quarter week")
def calendar_boundary(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.calendar_boundary(d, "monthly").alias("month"), fn.calendar_boundary(d, "quarterly").alias("quarter"), fn.calendar_boundary(d, "weekly", "wednesday").alias("week"))


# Change detection ----------------------------------------------------------------------------------------------------
_CLASSIFY = f"SELECT coalesce(i.c_custkey, c.c_custkey) AS c_custkey, CASE WHEN c.c_custkey IS NULL THEN 'new' WHEN i.c_custkey IS NULL THEN 'deleted' WHEN i.row_hash = c.row_hash THEN 'unchanged' ELSE 'changed' END AS change, i.row_hash AS new_hash, c.row_hash AS old_hash FROM ({INCOMING}) i FULL JOIN ({CURRENT}) c ON i.c_custkey = c.c_custkey"


@query(_CLASSIFY)
def scd2_detect_changes(spark, sf_dir):
    df = scd.classify(incoming_customers(spark, sf_dir), current_customers(spark, sf_dir), "c_custkey")
    return df.select(F.coalesce("incoming.c_custkey", "current.c_custkey").alias("c_custkey"), "change", F.col("incoming.row_hash").alias("new_hash"), F.col("current.row_hash").alias("old_hash"))


def _changes(spark, sf_dir):
    return scd.detect_changes(incoming_customers(spark, sf_dir), current_customers(spark, sf_dir), "c_custkey", detect_deletes=True)


@query(f"SELECT i.* FROM ({INCOMING}) i ANTI JOIN ({CURRENT}) c USING (c_custkey)", text="bal")
def scd2_new(spark, sf_dir):
    return _changes(spark, sf_dir).new


@query(f"SELECT i.* FROM ({INCOMING}) i JOIN ({CURRENT}) c USING (c_custkey) WHERE i.row_hash <> c.row_hash", text="bal")
def scd2_changed(spark, sf_dir):
    return _changes(spark, sf_dir).changed


@query(f"SELECT i.* FROM ({INCOMING}) i JOIN ({CURRENT}) c USING (c_custkey) WHERE i.row_hash = c.row_hash", text="bal")
def scd2_unchanged(spark, sf_dir):
    return _changes(spark, sf_dir).unchanged


@query(f"SELECT c.c_custkey FROM ({CURRENT}) c ANTI JOIN ({INCOMING}) i USING (c_custkey)")
def scd2_deleted_keys(spark, sf_dir):
    return _changes(spark, sf_dir).deleted_keys


@query("WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1) SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN a.user_id IS NULL THEN 'new' WHEN b.user_id IS NULL THEN 'deleted' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type")
def scd2_presence_only(spark, sf_dir):
    keys = ["user_id", "event_type"]
    ev = table(spark, sf_dir, "events")
    half = lambda k: scd.with_row_hash(ev.where(F.col("event_id") % 2 == k).select(*keys).distinct(), keys)
    df = scd.classify(half(1), half(0), keys)
    return df.select(*[F.coalesce(f"incoming.{k}", f"current.{k}").alias(k) for k in keys], "change")


# Checks --------------------------------------------------------------------------------------------------------------
_ORD = "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS status, o_totalprice AS price, o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS day, o_orderdate AS ts, o_custkey FROM orders"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus")).alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderdate").alias("ts"), "o_custkey")


_RULES = {
    "not_null": (Rule("not_null", "status"), "status IS NULL"),
    "accepted_values": (Rule("accepted_values", "status", {"values": ["O", "F"]}), "status NOT IN ('O','F')"),
    "not_in": (Rule("not_in", "status", {"values": ["P"]}), "status IN ('P')"),
    "pattern": (Rule("pattern", "priority", {"regex": "^[1-3]-[A-Z]+"}), "NOT regexp_matches(priority, '^[1-3]-[A-Z]+')"),
    "greater_than": (Rule("greater_than", "price", {"threshold": 100000}), "price <= 100000"),
    "greater_than_or_equal": (Rule("greater_than_or_equal", "price", {"value": 100000}), "price < 100000"),
    "less_than": (Rule("less_than", "price", {"threshold": 200000}), "price >= 200000"),
    "less_than_or_equal": (Rule("less_than_or_equal", "price", {"threshold": 200000}), "price > 200000"),
    "between": (Rule("between", "price", {"min": 50000, "max": 150000}), "price NOT BETWEEN 50000 AND 150000"),
    "not_in_future": (Rule("not_in_future", "day"), "day > DATE '1995-01-01'"),
    "within_days": (Rule("within_days", "day", {"days": 365}), "day < DATE '1995-01-01' - 365 OR day > DATE '1995-01-01'"),
    "min_length": (Rule("min_length", "priority", {"length": 6}), "length(priority) < 6"),
    "max_length": (Rule("max_length", "priority", {"length": 8}), "length(priority) > 8"),
}
_CLOCK = datetime(1995, 1, 1)


def _rule_query(rule: Rule):
    def run(spark, sf_dir):
        out = checks.row_counts(_orders(spark, sf_dir), [rule], _CLOCK)
        return out.select(F.col("failed_0").alias("failed"), F.col("total_0").alias("total"))

    return run


for _name, (_rule, _bad) in _RULES.items():
    query(f"SELECT count(*) FILTER (WHERE {_bad}) AS failed, count(*) AS total FROM ({_ORD})", f"check_{_name}")(_rule_query(_rule))


@query(f"SELECT CAST(count(*) - count(DISTINCT coalesce(o_custkey, -1)) AS BIGINT) AS failed, CAST(count(*) AS BIGINT) AS total FROM ({_ORD})")
def check_unique(spark, sf_dir):
    return checks.unique_counts(_orders(spark, sf_dir), ["o_custkey"])


@query(f"SELECT count(*) FILTER (WHERE status NOT IN ('O')) AS failed, count(status) AS total FROM ({_ORD})")
def check_when_not_null(spark, sf_dir):
    out = checks.row_counts(_orders(spark, sf_dir), [Rule("accepted_values", "status", {"values": ["O"]}, when="not_null")], _CLOCK)
    return out.select(F.col("failed_0").alias("failed"), F.col("total_0").alias("total"))


@query(f"SELECT count(*) AS n, count(*) BETWEEN 100 AND 1000000 AS passed FROM ({_ORD})")
def expect_row_count(spark, sf_dir):
    result = checks.run_checks(_orders(spark, sf_dir), [Rule("row_count", None, {"min": 100, "max": 1000000})], now=NOW)[0]
    return spark.createDataFrame([(result.total, result.passed)], "n long, passed boolean")


@query(f"SELECT (epoch_us(TIMESTAMP '2001-01-01') - epoch_us(max(ts))) / 3.6e9 AS age_hours, count(*) AS total FROM ({_ORD})")
def expect_freshness(spark, sf_dir):
    return checks.age_hours(_orders(spark, sf_dir), "ts", NOW)


@query(f"SELECT count(*) FILTER (WHERE status IS NULL) AS failed, count(*) AS total, count(*) FILTER (WHERE status IS NULL) * 100.0 / count(*) AS percent FROM ({_ORD})")
def expect_null_percentage(spark, sf_dir):
    return checks.null_percentage(_orders(spark, sf_dir), "status")


@query(f"SELECT CAST(sum(n - 1) AS BIGINT) AS failed, CAST(sum(n) AS BIGINT) AS total FROM (SELECT count(*) AS n FROM ({_ORD}) GROUP BY o_custkey, status)")
def expect_unique_combination(spark, sf_dir):
    return checks.unique_counts(_orders(spark, sf_dir), ["o_custkey", "status"])


@query("SELECT d AS expected FROM (SELECT unnest([DATE '1993-05-05', DATE '1800-01-01', DATE '2030-06-01']) AS d) WHERE d NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)", text="expected")
def expect_history_completeness(spark, sf_dir):
    return checks.missing_periods(table(spark, sf_dir, "orders"), "o_orderdate", [date(1993, 5, 5), date(1800, 1, 1), date(2030, 6, 1)])


@query(f"SELECT * FROM (VALUES ('not_null', 'status'), ('accepted_values', 'status'), ('between', 'price'), ('unique', 'o_orderkey')) v(rule, col), LATERAL (SELECT CASE rule WHEN 'not_null' THEN count(*) FILTER (WHERE status IS NULL) WHEN 'accepted_values' THEN count(*) FILTER (WHERE status NOT IN ('O','F')) WHEN 'between' THEN count(*) FILTER (WHERE price NOT BETWEEN 50000 AND 150000) ELSE count(*) - count(DISTINCT o_orderkey) END AS failed FROM ({_ORD}))")
def check_suite_orders(spark, sf_dir):
    rules = [_RULES["not_null"][0], _RULES["accepted_values"][0], _RULES["between"][0], Rule("unique", "o_orderkey")]
    results = checks.run_checks(_orders(spark, sf_dir), rules, now=_CLOCK, samples=False)
    return spark.createDataFrame([(r.rule.kind, r.rule.column, r.failed) for r in results], "rule string, col string, failed long")


@query(f"SELECT count(*) FILTER (WHERE seq_id > 1) AS failed, count(*) AS total FROM ({TARGET}) WHERE is_current")
def check_scope_current(spark, sf_dir):
    out = checks.row_counts(checks.scoped(scd_target(spark, sf_dir), current="is_current"), [Rule("less_than_or_equal", "seq_id", {"value": 1})], NOW)
    return out.select(F.col("failed_0").alias("failed"), F.col("total_0").alias("total"))


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, count(*) AS total FROM orders WHERE o_orderkey % 2 = 0")
def check_lineage_scope(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("_lineage_id", F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b"))
    out = checks.row_counts(checks.scoped(df, lineage_id="a"), [Rule("not_in", "o_orderstatus", {"values": ["P"]})], NOW)
    return out.select(F.col("failed_0").alias("failed"), F.col("total_0").alias("total"))


@query("SELECT o_custkey, count(*) AS copies FROM orders GROUP BY 1 HAVING count(*) > 1 ORDER BY copies DESC, o_custkey LIMIT 5")
def top_duplicates(spark, sf_dir):
    return aggregates.top_duplicates(table(spark, sf_dir, "orders"), ["o_custkey"])


@query("SELECT count(*) AS n_distinct FROM (SELECT DISTINCT o_custkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END FROM orders)")
def distinct_combinations(spark, sf_dir):
    return aggregates.distinct_rows(_orders(spark, sf_dir), ["o_custkey", "status"])


@query("SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(sha256(concat_ws('|', CAST(l_linenumber AS VARCHAR), CAST(l_orderkey AS VARCHAR), l_returnflag, CAST(l_suppkey AS VARCHAR))), 1, 13) AS BIGINT)) AS VARCHAR) AS checksum FROM lineitem")
def table_checksum(spark, sf_dir):
    return aggregates.table_checksum(table(spark, sf_dir, "lineitem").select("l_linenumber", "l_orderkey", "l_returnflag", "l_suppkey"))


# Writes --------------------------------------------------------------------------------------------------------------
_OLD = "SELECT o_orderkey, o_orderpriority, CAST(o_totalprice AS DECIMAL(14,2)) AS price FROM orders WHERE o_orderkey % 3 <> 0"
_NEW = "SELECT o_orderkey, o_orderpriority, CAST(CAST(o_totalprice AS DECIMAL(14,2)) + 1 AS DECIMAL(14,2)) AS price FROM orders WHERE o_orderkey % 5 = 0 AND o_orderpriority IN ('1-URGENT', '5-LOW')"


def _old(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("decimal(14,2)").alias("price"))


def _new(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_orderkey", "o_orderpriority", (F.col("o_totalprice").cast("decimal(14,2)") + 1).cast("decimal(14,2)").alias("price"))


@query(_NEW, text="price")
def full_refresh(spark, sf_dir):
    return writes.full_refresh(_old(spark, sf_dir), _new(spark, sf_dir))


@query(f"SELECT * FROM ({_OLD}) WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') UNION ALL SELECT * FROM ({_NEW})", text="price")
def full_refresh_partition(spark, sf_dir):
    return writes.refresh_partitions(_old(spark, sf_dir), _new(spark, sf_dir), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query(f"SELECT * FROM ({_OLD}) WHERE o_orderpriority NOT IN (SELECT o_orderpriority FROM ({_NEW})) UNION ALL SELECT * FROM ({_NEW})", text="price")
def full_refresh_partition_from_rows(spark, sf_dir):
    return writes.refresh_partitions(_old(spark, sf_dir), _new(spark, sf_dir), "o_orderpriority")


@query(f"{_OLD} UNION ALL {_NEW}", text="price")
def append(spark, sf_dir):
    return writes.append(_old(spark, sf_dir), _new(spark, sf_dir))


_EV_OLD = "SELECT user_id, min(event_id) AS event_id, 'first' AS event_type, CAST(0 AS DOUBLE) AS value FROM events WHERE user_id % 2 = 0 GROUP BY user_id"
_EV_NEW = "SELECT DISTINCT ON (user_id) user_id, event_id, event_type, value FROM events ORDER BY user_id, event_id DESC"


def _ev_old(spark, sf_dir):
    return table(spark, sf_dir, "events").where("user_id % 2 = 0").groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.lit("first").alias("event_type"), F.lit(0.0).alias("value"))


def _ev_new(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")


@query(_EV_NEW)
def upsert_last_wins(spark, sf_dir):
    return writes.upsert(_ev_old(spark, sf_dir), _ev_new(spark, sf_dir), ["user_id"], order_by=["event_id"])


@query(f"SELECT * FROM ({_EV_OLD}) UNION ALL SELECT n.* FROM ({_EV_NEW}) n ANTI JOIN ({_EV_OLD}) o USING (user_id)")
def upsert_do_nothing(spark, sf_dir):
    return writes.upsert(_ev_old(spark, sf_dir), _ev_new(spark, sf_dir), ["user_id"], [], order_by=["event_id"])


@query(f"SELECT n.user_id, coalesce(o.event_id, n.event_id) AS event_id, coalesce(o.event_type, n.event_type) AS event_type, n.value FROM ({_EV_NEW}) n LEFT JOIN ({_EV_OLD}) o USING (user_id)")
def upsert_partial_columns(spark, sf_dir):
    return writes.upsert(_ev_old(spark, sf_dir), _ev_new(spark, sf_dir), ["user_id"], ["value"], order_by=["event_id"])


@query(f"SELECT CASE WHEN o.user_id IS NULL THEN 'inserted' WHEN o.value IS DISTINCT FROM n.value THEN 'updated' ELSE 'kept' END AS action, count(*) AS n FROM ({_EV_NEW}) n LEFT JOIN ({_EV_OLD}) o USING (user_id) GROUP BY 1")
def upsert_skip_unchanged(spark, sf_dir):
    marked = writes.upsert_marked(_ev_old(spark, sf_dir), _ev_new(spark, sf_dir), ["user_id"], ["value"], skip_unchanged=True, order_by=["event_id"])
    return marked.groupBy(F.col("_action").alias("action")).agg(F.count("*").alias("n"))


# Versioned dimensions ------------------------------------------------------------------------------------------------
def _applied_sql(deletes: bool) -> str:
    ends = "i.c_custkey IS NOT NULL AND i.row_hash <> t.row_hash" + (" OR i.c_custkey IS NULL" if deletes else "")
    return f"""WITH t AS ({TARGET}), i AS ({INCOMING}) SELECT * FROM t WHERE NOT is_current
UNION ALL SELECT t.c_custkey, t.c_name, t.c_mktsegment, t.bal, t.row_hash, t.effective_from, CASE WHEN {ends} THEN {DAY1} ELSE t.effective_to END, NOT ({ends}), t.seq_id FROM t LEFT JOIN i ON i.c_custkey = t.c_custkey WHERE t.is_current
UNION ALL SELECT i.*, {DAY1}, {END}, true, CAST(coalesce((SELECT max(seq_id) FROM t WHERE t.c_custkey = i.c_custkey), 0) + 1 AS INTEGER) FROM i LEFT JOIN t ON t.c_custkey = i.c_custkey AND t.is_current WHERE t.c_custkey IS NULL OR t.row_hash <> i.row_hash"""


@query(_applied_sql(False), text="bal effective_from effective_to")
def scd2_apply(spark, sf_dir):
    return scd.apply_scd2(scd_target(spark, sf_dir), incoming_customers(spark, sf_dir), "c_custkey", "2024-02-01")


@query(_applied_sql(True), text="bal effective_from effective_to")
def scd2_apply_deletes(spark, sf_dir):
    return scd.apply_scd2(scd_target(spark, sf_dir), incoming_customers(spark, sf_dir), "c_custkey", "2024-02-01", detect_deletes=True)


@query(f"""WITH t AS ({TARGET}), i AS (SELECT * FROM ({INCOMING}) WHERE c_mktsegment = 'BUILDING'), s AS (SELECT * FROM t WHERE is_current AND c_mktsegment = 'BUILDING')
SELECT * FROM t WHERE NOT (is_current AND c_mktsegment = 'BUILDING')
UNION ALL SELECT s.c_custkey, s.c_name, s.c_mktsegment, s.bal, s.row_hash, s.effective_from, CASE WHEN i.c_custkey IS NULL OR i.row_hash <> s.row_hash THEN {DAY1} ELSE s.effective_to END, i.c_custkey IS NOT NULL AND i.row_hash = s.row_hash, s.seq_id FROM s LEFT JOIN i ON i.c_custkey = s.c_custkey
UNION ALL SELECT i.*, {DAY1}, {END}, true, CAST(coalesce((SELECT max(seq_id) FROM t WHERE t.c_custkey = i.c_custkey AND t.c_mktsegment = 'BUILDING'), 0) + 1 AS INTEGER) FROM i LEFT JOIN s ON s.c_custkey = i.c_custkey WHERE s.c_custkey IS NULL OR s.row_hash <> i.row_hash""", text="bal effective_from effective_to")
def scd2_apply_partitioned(spark, sf_dir):
    new = incoming_customers(spark, sf_dir).where("c_mktsegment = 'BUILDING'")
    return scd.apply_scd2(scd_target(spark, sf_dir), new, "c_custkey", "2024-02-01", detect_deletes=True, partition_column="c_mktsegment", partition_values=["BUILDING"])


@query(f"SELECT c_custkey, max(seq_id) AS seq FROM ({_applied_sql(True)}) GROUP BY c_custkey")
def scd2_sequence(spark, sf_dir):
    return scd2_apply_deletes(spark, sf_dir).groupBy("c_custkey").agg(F.max("seq_id").alias("seq"))


@query(f"SELECT count(*) FILTER (WHERE change = 'new') AS rows_new, count(*) FILTER (WHERE change = 'changed') AS rows_expired, count(*) FILTER (WHERE change IN ('new', 'changed')) AS rows_inserted, count(*) FILTER (WHERE change = 'unchanged') AS rows_unchanged, count(*) FILTER (WHERE change = 'deleted') AS rows_deleted FROM ({_CLASSIFY})")
def scd2_stats(spark, sf_dir):
    return scd.scd2_stats(incoming_customers(spark, sf_dir), scd_target(spark, sf_dir), "c_custkey", detect_deletes=True)


_COLLAPSE = f"SELECT * EXCLUDE (b) FROM (SELECT *, lag(row_hash) OVER (PARTITION BY c_custkey ORDER BY effective_from) AS b FROM ({VERSIONS})) WHERE b IS NULL OR b <> row_hash"
_STITCH = "SELECT * REPLACE (coalesce(lead(effective_from) OVER w, TIMESTAMP '9999-12-31') AS effective_to, lead(1) OVER w IS NULL AS is_current) FROM ({0}) WINDOW w AS (PARTITION BY c_custkey ORDER BY effective_from)"
_NUMBER = "SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY effective_from) AS INTEGER) AS seq_id) FROM ({0})"


@query(_COLLAPSE, text="effective_from effective_to")
def scd2_collapse(spark, sf_dir):
    return scd.collapse(versions(spark, sf_dir), "c_custkey")


@query(_STITCH.format(VERSIONS), text="effective_from effective_to")
def scd2_timeline(spark, sf_dir):
    return scd.restitch(versions(spark, sf_dir), "c_custkey")


@query(_NUMBER.format(VERSIONS), text="effective_from effective_to")
def scd2_renumber(spark, sf_dir):
    return scd.renumber(versions(spark, sf_dir), "c_custkey")


@query(_NUMBER.format(_STITCH.format(_COLLAPSE)), text="effective_from effective_to")
def scd2_reconcile(spark, sf_dir):
    return scd.reconcile(versions(spark, sf_dir), "c_custkey")


@query(f"SELECT * FROM ({_NUMBER.format(_STITCH.format(_COLLAPSE))}) WHERE effective_from <= TIMESTAMP '2024-03-15' AND effective_to > TIMESTAMP '2024-03-15'", text="effective_from effective_to")
def scd2_as_of(spark, sf_dir):
    return scd.as_of(scd2_reconcile(spark, sf_dir), "2024-03-15")


# Lineage and registries ----------------------------------------------------------------------------------------------
_LINE = "SELECT CAST(event_id AS VARCHAR) AS lineage_id, event_type AS asset_name, 'silver' AS layer, CAST(ts AS DATE) AS data_date, ts AS processed_at FROM events"


def _lineage_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("lineage_id"), F.col("event_type").alias("asset_name"), F.lit("silver").alias("layer"), F.col("ts").cast("date").alias("data_date"), F.col("ts").alias("processed_at"))


@query(f"SELECT * FROM ({_LINE}) WHERE asset_name = 'click' ORDER BY processed_at DESC, lineage_id LIMIT 20", text="data_date processed_at")
def lineage_history(spark, sf_dir):
    return lineage.history(_lineage_rows(spark, sf_dir), limit=20, asset_name="click")


@query(f"SELECT asset_name, max_by(lineage_id, processed_at) AS lineage_id, max(processed_at) AS processed_at FROM ({_LINE}) GROUP BY asset_name", text="processed_at")
def lineage_latest_prior(spark, sf_dir):
    return aggregates.latest(_lineage_rows(spark, sf_dir).select("asset_name", "lineage_id", "processed_at"), ["asset_name"], "processed_at")


@query("SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS parent_id FROM events WHERE user_id % 3 <> 0")
def parent_lineage_ids(spark, sf_dir):
    return lineage.parent_lineage_ids(table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("_lineage_id")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'orders' END AS asset, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS part FROM orders")
def lineage_key_parse(spark, sf_dir):
    key = F.concat_ws(":", F.lit("v1"), F.lit("orders"), F.lit("gold"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("abc123"))
    df = table(spark, sf_dir, "orders").withColumn("key", F.when(F.col("o_orderkey") % 2 == 0, key).otherwise("v2:orders:gold"))
    parsed = lineage.parse_lineage_key("key")
    return df.select("o_orderkey", parsed["asset"].alias("asset"), parsed["date_or_hash"].alias("part"))


_REG = "SELECT event_type AS source_id, strftime(ts, '%Y-%m-%d') AS partition_key, CAST(min(ts) AS DATE) AS effective_from, 'materialized' AS status, '{\"n\":\"' || count(*) || '\",\"a\":\"1\"}' AS metadata, TIMESTAMP '2020-01-01' AS registered_at FROM events GROUP BY 1, 2"


def _registry(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source_id"), F.date_format("ts", "yyyy-MM-dd").alias("partition_key"))
    out = g.agg(F.min("ts").cast("date").alias("effective_from"), F.count("*").cast("string").alias("n"))
    meta = F.concat(F.lit('{"n":"'), F.col("n"), F.lit('","a":"1"}'))
    return out.select("source_id", "partition_key", "effective_from", F.lit("materialized").alias("status"), meta.alias("metadata"), F.lit("2020-01-01").cast("timestamp").alias("registered_at"))


@query(f"SELECT source_id, partition_key, effective_from, status, CASE WHEN source_id = 'click' THEN '{{\"a\":\"2\",\"b\":\"3\",\"n\":\"' || json_extract_string(metadata, '$.n') || '\"}}' ELSE metadata END AS metadata, CASE WHEN source_id = 'click' THEN TIMESTAMP '2001-01-01' ELSE registered_at END AS registered_at FROM ({_REG})", text="effective_from registered_at")
def registry_upsert_merge(spark, sf_dir):
    reg = _registry(spark, sf_dir)
    return lineage.register_periods(reg, reg.where("source_id = 'click'").withColumn("metadata", F.lit('{"b":"3","a":"2"}')), now=NOW)


@query(f"SELECT * FROM ({_REG}) WHERE source_id = 'click' AND status = 'materialized'", text="effective_from registered_at")
def registry_periods(spark, sf_dir):
    return lineage.registry_periods(_registry(spark, sf_dir), "click")


_TAGS = "SELECT 's' AS schema_name, p_brand AS table_name, CAST(p_partkey AS VARCHAR) AS column_name, 'pii' AS tags, TIMESTAMP '2020-01-01' AS valid_from, CASE WHEN p_partkey % 4 = 0 THEN TIMESTAMP '2020-06-01' END AS valid_to FROM part WHERE p_partkey % 2 = 0"
_DECL = "SELECT 's' AS schema_name, p_brand AS table_name, CAST(p_partkey AS VARCHAR) AS column_name, CASE WHEN p_partkey % 3 = 0 THEN 'phi' ELSE 'pii' END AS tags FROM part WHERE p_partkey % 5 <> 0"


@query(f"""WITH t AS ({_TAGS}), d AS ({_DECL}), o AS (SELECT * FROM t WHERE valid_to IS NULL)
SELECT * FROM t WHERE valid_to IS NOT NULL UNION ALL SELECT o.schema_name, o.table_name, o.column_name, o.tags, o.valid_from, CASE WHEN d.tags <> o.tags THEN TIMESTAMP '2021-01-01' END FROM o LEFT JOIN d USING (schema_name, table_name, column_name)
UNION ALL SELECT d.schema_name, d.table_name, d.column_name, d.tags, TIMESTAMP '2021-01-01', NULL FROM d LEFT JOIN o USING (schema_name, table_name, column_name) WHERE o.tags IS NULL OR o.tags <> d.tags""", text="valid_from valid_to")
def tag_scd2_sync(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    key = [F.lit("s").alias("schema_name"), F.col("p_brand").alias("table_name"), F.col("p_partkey").cast("string").alias("column_name")]
    stamp = lambda s: F.lit(s).cast("timestamp")
    tags = part.where("p_partkey % 2 = 0").select(*key, F.lit("pii").alias("tags"), stamp("2020-01-01").alias("valid_from"), F.when(F.col("p_partkey") % 4 == 0, stamp("2020-06-01")).alias("valid_to"))
    declared = part.where("p_partkey % 5 <> 0").select(*key, F.when(F.col("p_partkey") % 3 == 0, "phi").otherwise("pii").alias("tags"))
    return lineage.sync_tags(tags, declared, at="2021-01-01")


# Reads ---------------------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM')")
def read_projection_filter(spark, sf_dir):
    return readers.load(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"], "o_orderpriority", ["1-URGENT", "3-MEDIUM"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE date_trunc('month', o_orderdate) = (SELECT max(date_trunc('month', o_orderdate)) FROM orders)")
def read_latest_partition(spark, sf_dir):
    return readers.latest_partition(table(spark, sf_dir, "orders").withColumn("load_period", F.trunc("o_orderdate", "month")), columns=["o_orderkey", "o_custkey"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def read_all_text(spark, sf_dir):
    return readers.read_parquet(spark, [f"{sf_dir}/customer.parquet"], ["c_custkey", "c_name", "c_nationkey"])


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 40 OFFSET 80")
def read_paged(spark, sf_dir):
    return readers.page(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], 2, 40)


# Batches, streams, sensors -------------------------------------------------------------------------------------------
@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DECIMAL(28,6)) AS total FROM events GROUP BY event_type", text="total")
def batched_equals_single(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    whole = batched.union_batches([ev.where(F.pmod("event_id", F.lit(4)) == k) for k in range(4)])
    return batched.transform_batched(whole, lambda d: d.withColumn("v", F.col("value").cast("decimal(18,6)"))).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("v").cast("decimal(28,6)").alias("total"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_into_table(spark, sf_dir):
    root = shared_root(spark)
    stream = batched.stream_files(spark, sf_dir, table(spark, sf_dir, "events").schema, pattern="events.parquet")
    sink = TableSink(spark, root)
    batched.write_stream(stream.select("event_id", "event_type"), sink, "silver.events", f"{root}/progress", mode="append", lineage=False)
    return sink.table("silver.events").read().groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"SELECT partition_key, TIMESTAMP '2020-01-01' + to_days(CAST(n AS INTEGER)) AS at FROM (SELECT partition_key, CAST(json_extract_string(metadata, '$.n') AS INTEGER) AS n FROM ({_REG}) WHERE source_id = 'click') WHERE n > 20", text="at")
def sensor_actionable(spark, sf_dir):
    reg = _registry(spark, sf_dir)
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.get_json_object("metadata", "$.n").cast("int"))
    return sensors.actionable(reg.withColumn("registered_at", day.cast("timestamp")), "click", cursor=datetime(2020, 1, 21))


@query(f"SELECT count(*) AS n, bool_and(CAST(json_extract_string(metadata, '$.n') AS INTEGER) > 0) AS all_ready, max(registered_at) AS at, count(*) > 0 AND max(registered_at) > TIMESTAMP '2019-01-01' AS fire FROM ({_REG}) WHERE source_id = 'click'", text="at")
def sensor_all_ready(spark, sf_dir):
    return sensors.barrier(_registry(spark, sf_dir), "click", cursor=datetime(2019, 1, 1), ready=F.get_json_object("metadata", "$.n").cast("int") > 0)


@query(f"SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS partition_key FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') NOT IN (SELECT partition_key FROM ({_REG}))")
def missing_partitions(spark, sf_dir):
    found = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("partition_key"))
    return sensors.new_partitions(found, _registry(spark, sf_dir))


# Support -------------------------------------------------------------------------------------------------------------
@query("SELECT '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS line FROM events")
def ndjson_lines(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "event_type", "user_id")).alias("line"))


@query("SELECT event_id, event_type, user_id FROM events")
def ndjson_roundtrip(spark, sf_dir):
    path = f"{shared_root(spark)}/ndjson"
    ndjson_lines(spark, sf_dir).write.text(path)
    return spark.read.schema("event_id long, event_type string, user_id long").json(path)


@query("SELECT * FROM (SELECT c_custkey, c_name, c_nationkey FROM customer) WHERE c_nationkey > 5 AND upper(c_name) LIKE '%1%'")
def safe_copy(spark, sf_dir):
    return safety.safe_copy(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_nationkey > 5 AND upper(c_name) LIKE '%1%'")


@query("SELECT c_custkey, '***' AS c_name, c_nationkey FROM customer")
def masked_projection(spark, sf_dir):
    return rendering.masked(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), ["c_name"])


@query("WITH t AS (SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10) SELECT '| c_custkey | c_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || c_custkey || ' | *** |', chr(10) ORDER BY c_custkey) || chr(10) || chr(10) || '*Showing 10 of ' || (SELECT count(*) FROM customer) || ' rows.*' AS md FROM t")
def markdown_masked(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy("c_custkey")
    return spark.createDataFrame([(rendering.to_markdown(df, pii_columns=["c_name"]),)], "md string")


@query(f"SELECT c_custkey, c_name, bal FROM ({INCOMING})", text="bal")
def sink_full_write(spark, sf_dir):
    """The whole path: configuration, lineage, plan, staged version, commit, read."""
    sink = TableSink(spark, shared_root(spark))
    sink.write(incoming_customers(spark, sf_dir).select("c_custkey", "c_name", "bal"), "gold.customers", mode="append", lineage=False)
    return sink.table("gold.customers").read()


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN chr(92) || 'N' ELSE chr(13) || chr(10) || chr(1) || chr(92) || chr(92) || 'n' || c_name || ', \"x\"' || chr(13) END AS t, CAST(c_acctbal AS DECIMAL(12,2)) AS bal FROM customer", text="bal")
def csv_roundtrip(spark, sf_dir):
    k = F.col("c_custkey") % 4
    text = F.when(k == 1, "").when(k == 2, "\\N").when(k == 3, F.concat(F.lit("\r\n\x01\\\\n"), "c_name", F.lit(', "x"\r')))
    df = table(spark, sf_dir, "customer").select("c_custkey", text.alias("t"), F.col("c_acctbal").cast("decimal(12,2)").alias("bal"))
    path = f"{shared_root(spark)}/csv"
    outputs.write_csv(df, path)
    return outputs.read_csv(spark, path, df.schema)


@query(f"WITH v AS ({VERSIONS}), n AS ({_NUMBER.format(_STITCH.format(_COLLAPSE))}) SELECT (SELECT count(*) FROM v) - (SELECT count(*) FROM n) AS rows_collapsed, (SELECT count(*) FROM n JOIN v USING (c_custkey, effective_from) WHERE n.effective_to <> v.effective_to OR n.is_current <> v.is_current) AS rows_retimed, (SELECT count(*) FROM n JOIN v USING (c_custkey, effective_from) WHERE n.seq_id <> v.seq_id) AS rows_renumbered")
def scd2_reconcile_counts(spark, sf_dir):
    c = scd.reconcile_counts(versions(spark, sf_dir), "c_custkey")
    return spark.createDataFrame([(c.rows_collapsed, c.rows_retimed, c.rows_renumbered)], "rows_collapsed long, rows_retimed long, rows_renumbered long")


@query("SELECT o_custkey, o_orderstatus, count(*) AS copies FROM orders GROUP BY ALL HAVING count(*) > 1")
def scd2_duplicate_keys(spark, sf_dir):
    return scd.duplicate_keys(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"])


@query("SELECT count(*) FILTER (WHERE o_orderkey % 7 = 0) AS o_orderkey, count(*) FILTER (WHERE o_custkey % 5 = 0) AS o_custkey FROM orders")
def upsert_null_keys(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey")).alias("o_orderkey"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("o_custkey"))
    n = writes.null_key_counts(df, ["o_orderkey", "o_custkey"])
    return spark.createDataFrame([(n.get("o_orderkey", 0), n.get("o_custkey", 0))], "o_orderkey long, o_custkey long")


@query(f"SELECT source_id, partition_key, effective_from FROM ({_REG}) WHERE effective_from <= DATE '2024-01-10'", text="effective_from")
def periods_in_force(spark, sf_dir):
    reg = _registry(spark, sf_dir).withColumn("effective_to", F.lit(None).cast("date"))
    parts = [periods.effective_periods(reg, s, date(2024, 1, 10)) for s in sorted(r[0] for r in reg.select("source_id").distinct().collect())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("source_id", "partition_key", F.col("effective_from"))


# Writes through the sink, and their records --------------------------------------------------------------------------
_STAMP = datetime(2024, 2, 1)


def _sink(spark) -> TableSink:
    return TableSink(spark, shared_root(spark))


def _orders_slim(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("decimal(12,2)").alias("price"))


_SLIM = "SELECT o_orderkey, o_orderpriority, CAST(o_totalprice AS DECIMAL(12,2)) AS price FROM orders"


@query(f"SELECT * FROM ({_SLIM}) UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 3 = 0", text="price")
def sink_append_twice(spark, sf_dir):
    sink, df = _sink(spark), _orders_slim(spark, sf_dir)
    sink.write(df, "gold.orders", mode="append", lineage=False)
    sink.write(df.where("o_orderkey % 3 = 0").select("o_orderkey"), "gold.orders", mode="append", lineage=False)
    return sink.table("gold.orders").read()


@query(f"SELECT * FROM ({_SLIM}) WHERE o_orderpriority NOT IN ('1-URGENT', '3-MEDIUM', '5-LOW') UNION ALL SELECT o_orderkey, o_orderpriority, CAST(price + 1 AS DECIMAL(12,2)) FROM ({_SLIM}) WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') AND o_orderkey % 2 = 0", text="price")
def sink_refresh_partition(spark, sf_dir):
    """Two partitions come anew, a third one comes empty; the parts of the others stay."""
    sink, df = _sink(spark), _orders_slim(spark, sf_dir)
    sink.write(df, "gold.orders", partition_column="o_orderpriority", lineage=False)
    fresh = df.where("o_orderpriority IN ('1-URGENT', '3-MEDIUM') AND o_orderkey % 2 = 0").withColumn("price", (F.col("price") + 1).cast("decimal(12,2)"))
    sink.write(fresh, "gold.orders", partition_column="o_orderpriority", partition_values=["1-URGENT", "3-MEDIUM", "5-LOW"], lineage=False)
    return sink.table("gold.orders").read()


@query(f"SELECT * FROM ({_SLIM}) WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')", text="price")
def sink_read_partitions(spark, sf_dir):
    """Parts of other partitions are not read."""
    sink = _sink(spark)
    sink.write(_orders_slim(spark, sf_dir), "gold.orders", partition_column="o_orderpriority", lineage=False)
    return sink.table("gold.orders").read_values("o_orderpriority", ["1-URGENT", "2-HIGH"])


_UP = f"SELECT o_orderkey, 'x' AS o_orderpriority, CAST(price * 2 AS DECIMAL(12,2)) AS price FROM ({_SLIM}) WHERE o_orderkey % 4 < 2"


@query(f"WITH t AS (SELECT * FROM ({_SLIM}) WHERE o_orderkey % 4 > 0), u AS ({_UP}) SELECT coalesce(u.o_orderkey, t.o_orderkey) AS o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN u.o_orderpriority ELSE t.o_orderpriority END AS o_orderpriority, coalesce(u.price, t.price) AS price FROM t FULL JOIN u USING (o_orderkey)", text="price")
def sink_upsert(spark, sf_dir):
    sink, df = _sink(spark), _orders_slim(spark, sf_dir)
    sink.write(df.where("o_orderkey % 4 > 0"), "gold.orders", mode="append", lineage=False)
    fresh = df.where("o_orderkey % 4 < 2").withColumns({"o_orderpriority": F.lit("x"), "price": (F.col("price") * 2).cast("decimal(12,2)")})
    sink.write(fresh, "gold.orders", mode="upsert", primary_key="o_orderkey", update_columns=["price"], lineage=False)
    return sink.table("gold.orders").read()


_NOT_HASH = "SELECT * EXCLUDE (row_hash) FROM ({0})"


def _three_loads(spark, sf_dir) -> TableSink:
    """Customers at three dates; half of the middle load's are missing, and come back."""
    sink, df = _sink(spark), table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(12,2)").alias("bal"))
    loads = [df, df.where("c_custkey % 2 = 0").withColumn("bal", F.when(F.col("c_custkey") % 4 == 0, F.col("bal") + 1).otherwise(F.col("bal")).cast("decimal(12,2)")), df]
    dated = [Period(str(k), date(2024, k + 1, 1)) for k in range(3)]
    sink.load_periods("gold.customers", dated, lambda p: loads[int(p.source)], mode="scd2", business_key="c_custkey", detect_deletes=True, now=_STAMP, lineage=False)
    return sink


_EVER = "TIMESTAMP '9999-12-31'"
_LOADED = f"""SELECT c_custkey, b.bal, b.f AS effective_from, b.t AS effective_to, b.t = {_EVER} AS is_current, CAST(b.seq AS INTEGER) AS seq_id FROM (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(12,2)) AS x FROM customer) c, LATERAL (
SELECT x AS bal, TIMESTAMP '2024-01-01' AS f, CASE WHEN c_custkey % 4 = 2 THEN {_EVER} ELSE TIMESTAMP '2024-02-01' END AS t, 1 AS seq
UNION ALL SELECT CAST(x + 1 AS DECIMAL(12,2)), TIMESTAMP '2024-02-01', TIMESTAMP '2024-03-01', 2 WHERE c_custkey % 4 = 0
UNION ALL SELECT x, TIMESTAMP '2024-03-01', {_EVER}, CASE WHEN c_custkey % 4 = 0 THEN 3 ELSE 2 END WHERE c_custkey % 4 <> 2) b"""


@query(_LOADED, text="bal effective_from effective_to")
def sink_scd2(spark, sf_dir):
    """Versions that ended stay in their own parts; the numbers of keys that come back go on from them."""
    return _three_loads(spark, sf_dir).table("gold.customers").read().drop("row_hash")


@query(f"SELECT mode, CAST(version AS INTEGER) AS version, rows_in, rows_inserted, day, v > 1 AND mode = 'full_refresh' AS replaces FROM (VALUES ('full_refresh', 1, (SELECT count(*) FROM customer), 1), ('full_refresh', 2, (SELECT count(*) FROM customer), 2), ('append', 3, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0), 3)) t(mode, version, rows_in, v), LATERAL (SELECT rows_in AS rows_inserted, CAST(NULL AS VARCHAR) AS day)", text="day")
def sink_lineage_rows(spark, sf_dir):
    """A lineage row for each write; a full refresh names the row that it replaces."""
    sink, df = _sink(spark), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    sink.write(df, "gold.customers", now=datetime(2024, 1, 1))
    sink.write(df, "gold.customers", now=datetime(2024, 1, 2))
    sink.write(df.where("c_custkey % 2 = 0"), "gold.customers", mode="append", now=datetime(2024, 1, 3))
    rows = sink.records.read("lineage")
    before = rows.select(F.col("lineage_id").alias("replaces_lineage_id"), F.col("version").alias("before"))
    return rows.join(before, "replaces_lineage_id", "left").select("mode", "version", "rows_in", "rows_inserted", F.col("data_date").alias("day"), (F.coalesce("before", F.lit(-1)) == F.col("version") - 1).alias("replaces"))


_CONTRACT = {"version": "1.0", "pipeline_id": "0190b8a0-0000-7000-8000-000000000001", "asset": "orders", "layer": "gold", "schema": {"strict": False, "columns": [
    {"name": "o_orderkey", "type": "integer", "nullable": False, "primary_key": True, "tests": ["not_null", "unique"]},
    {"name": "o_orderpriority", "type": "string", "nullable": True, "tests": [{"accepted_values": {"values": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}, "severity": "warn"}]},
]}}


@query("SELECT 'before' AS phase, check_name, passed, failed_count, CAST(total_count AS BIGINT) AS total_count FROM (SELECT count(*) AS total_count, count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS bad FROM orders), LATERAL (SELECT * FROM (VALUES ('not_null', true, CAST(0 AS BIGINT)), ('unique', true, 0), ('accepted_values', false, bad)) v(check_name, passed, failed_count))")
def sink_check_rows(spark, sf_dir):
    """The results of a contract's rules, kept with the write that they let through."""
    sink = _sink(spark)
    sink.write(_orders_slim(spark, sf_dir), "gold.orders", mode="append", contract=build_contract(_CONTRACT))
    rows = sink.records.read("checks").where("check_name LIKE '%not_null%' OR check_name LIKE '%unique%' OR check_name LIKE '%accepted%'")
    kind = F.regexp_extract("check_name", "(not_null|unique|accepted_values)", 1)
    return rows.select("phase", kind.alias("check_name"), "passed", "failed_count", "total_count")


@query("SELECT count(DISTINCT event_type) AS parents, CAST(1 AS BIGINT) AS children FROM events")
def sink_parent_rows(spark, sf_dir):
    """Lineage ids on the rows that come in become the parents of the write."""
    sink = _sink(spark)
    sink.write(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("_lineage_id")), "gold.events", mode="append")
    return sink.records.read("lineage_parents").agg(F.countDistinct("parent_id").alias("parents"), F.countDistinct("lineage_id").alias("children"))


@query("SELECT partition_key, status, CASE partition_key WHEN 'p2' THEN '{\"silver_materialized_at\":\"2024-02-01T00:00:00\"}' ELSE '{}' END AS metadata FROM (VALUES ('p1', 'materialized'), ('p2', 'materialized')) t(partition_key, status)")
def sink_period_rows(spark, sf_dir):
    """A write of a period registers it, a later layer's write stamps it, and a write of no known date does neither."""
    sink = _sink(spark)
    source = DataSource("0190b8a0-0000-7000-8000-000000000002", "nations", (Period("a", date(2024, 1, 1), partition_key="p1"), Period("b", date(2024, 2, 1), partition_key="p2")))
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    for day in (date(2024, 1, 1), date(2024, 2, 1), date(2030, 1, 1)):
        sink.write(df, "bronze.nations", mode="append", effective_date=day, source=source, now=_STAMP)
    sink.write(df, "silver.nations", mode="append", effective_date=date(2024, 2, 1), source=source, now=_STAMP)
    return periods.PeriodRegistry(spark, sink.root).read().select("partition_key", "status", "metadata")


@query("SELECT pipeline_id, contract_hash, registered_at FROM (VALUES ('a', 'h1', TIMESTAMP '2024-01-01'), ('b', 'h3', TIMESTAMP '2024-01-03')) t(pipeline_id, contract_hash, registered_at)", text="registered_at")
def pipeline_registry(spark, sf_dir):
    """A row moves only where its contract or handles differ."""
    records = _sink(spark).records
    for day, row in enumerate((("a", "h1"), ("a", "h1"), ("b", "h2"), ("b", "h3")), 1):
        records.pipeline(dict(zip(("pipeline_id", "contract_hash"), row, strict=True)), now=datetime(2024, 1, day))
    return records.read("pipelines").select("pipeline_id", "contract_hash", "registered_at")


@query("SELECT target, rows_collapsed, rows_retimed, rows_renumbered FROM (SELECT 'gold.customers' AS target, CAST(0 AS BIGINT) AS rows_collapsed, (SELECT count(*) FROM customer WHERE c_custkey % 4 IN (1, 3)) AS rows_retimed, CAST(0 AS BIGINT) AS rows_renumbered)")
def sink_reconcile_rows(spark, sf_dir):
    """The repair of a versioned table leaves a row: where a key went and came back, the gap closes."""
    sink = _three_loads(spark, sf_dir)
    sink.reconcile("gold.customers", ["c_custkey"], collapse_duplicates=False)
    return sink.records.read("reconciles").select("target", "rows_collapsed", "rows_retimed", "rows_renumbered")


@query(f"SELECT source_id, partition_key, CASE WHEN source_id = 'click' THEN '{{\"a\":\"3\",\"c\":\"2\",\"n\":\"' || json_extract_string(metadata, '$.n') || '\"}}' ELSE metadata END AS metadata FROM ({_REG})")
def registry_metadata_update(spark, sf_dir):
    """Updates of one period are merged first, so that it stays one row; unknown periods are not added."""
    reg = _registry(spark, sf_dir)
    known = reg.where("source_id = 'click'").select("source_id", "partition_key")
    updates = known.withColumn("metadata", F.lit('{"a":"2","c":"2"}')).unionByName(known.withColumn("metadata", F.lit('{"a":"3"}')))
    updates = updates.unionByName(updates.limit(1).withColumn("partition_key", F.lit("unknown")))
    normal = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.from_json("metadata", "map<string,string>")))))
    out = lineage.update_metadata(reg, updates).select("source_id", "partition_key", "metadata")
    return out.withColumn("metadata", F.when(F.col("source_id") == "click", normal).otherwise(F.col("metadata")))


_SHAPES = "SELECT *, CASE WHEN CAST(lineage_id AS BIGINT) % 3 = 0 THEN data_date END AS d, CASE WHEN CAST(lineage_id AS BIGINT) % 3 = 1 THEN '[2024-01-01,2024-01-31]' END AS r FROM ({0})"


@query(f"SELECT shape, lineage_id FROM (SELECT CASE WHEN d IS NOT NULL THEN 'date' WHEN r IS NOT NULL THEN 'range' ELSE 'whole' END AS shape, lineage_id, row_number() OVER (PARTITION BY d IS NOT NULL, r IS NOT NULL ORDER BY processed_at DESC, lineage_id) AS k FROM ({_SHAPES.format(_LINE)}) WHERE asset_name = 'click' AND (d IS NULL OR d = (SELECT max(d) FROM ({_SHAPES.format(_LINE)}) WHERE asset_name = 'click'))) WHERE k = 1")
def lineage_prior_by_shape(spark, sf_dir):
    """The latest row of the same date, of the same range of dates, or of the whole table."""
    n = F.col("lineage_id").cast("long") % 3
    rows = _lineage_rows(spark, sf_dir).withColumns({"data_date": F.when(n == 0, F.col("data_date")), "data_date_range": F.when(n == 1, lineage.date_range((date(2024, 1, 1), date(2024, 1, 31))))})
    day = rows.where("asset_name = 'click'").agg(F.max("data_date")).first()[0]
    shapes = {"date": {"data_date": day}, "range": {"data_date_range": (date(2024, 1, 1), date(2024, 1, 31))}, "whole": {}}
    found = [lineage.prior(rows, "click", "silver", **by).select(F.lit(shape).alias("shape"), "lineage_id") for shape, by in shapes.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"SELECT count(*) - count(DISTINCT status) AS failed, count(*) AS total FROM ({_ORD})")
def check_unique_sql_nulls(spark, sf_dir):
    """Uniqueness as SQL counts it: distinct values without null, against all rows."""
    return checks.unique_counts(_orders(spark, sf_dir), ["status"], null_policy="sql")


@query("SELECT c_nationkey, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY c_nationkey")
def read_in_batches(spark, sf_dir):
    """Rows by frames of bounded size, put together again."""
    frames = readers.batches(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), 500)
    parts = [f.groupby("c_nationkey")["c_custkey"].agg(["count", "sum"]).reset_index() for f in frames]
    rows = [tuple(map(int, r)) for p in parts for r in p.itertuples(index=False)]
    return spark.createDataFrame(rows, "c_nationkey long, n long, keys long").groupBy("c_nationkey").agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"))


def _packed(spark, database: Path) -> str:
    """Closes an embedded database and packs its files into one, as they are, from which any process can read."""
    try:
        spark._jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{database};shutdown=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # a database that has closed says so by an error
            raise
    with zipfile.ZipFile(f"{database}.jar", "w") as packed:
        for f in sorted(f for f in database.rglob("*") if f.is_file() and f.suffix != ".lck"):
            packed.write(f, f.relative_to(database.parent))
    shutil.rmtree(database)
    return f"jdbc:derby:jar:({database}.jar){database.name}"


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def jdbc_roundtrip(spark, sf_dir):
    """Rows into a database and back, in parallel by ranges of the key. The database is Derby, in files that one process at a
    time can write: on a cluster that is the driver. Then it is packed in the shared folder for all that read."""
    folder = Path(shared_root(spark).removeprefix("file:"))
    if folder.parts[0].endswith(":"):
        raise ValueError(f"Derby needs a shared folder that is mounted, not {folder}")
    folder.mkdir(parents=True)
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    options = {"properties": {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}}
    outputs.write_jdbc(df, f"jdbc:derby:{folder}/q;create=true", "customers", mode="overwrite", from_driver=not spark.sparkContext._jsc.sc().isLocal(), **options)
    low, high = df.agg(F.min("c_custkey"), F.max("c_custkey")).first()
    out = readers.jdbc(spark, _packed(spark, folder / "q"), "SELECT * FROM customers", partition_column="c_custkey", bounds=(low or 0, high or 0), partitions=4, **options)
    return out.select(*[F.col(c).cast(t).alias(c.lower()) for c, t in zip(out.columns, dict(df.dtypes).values(), strict=True)])


@query("SELECT n_nationkey, n_name, DATE '2024-03-01' AS load_period FROM nation", text="load_period")
def sink_puts_in_the_period(spark, sf_dir):
    """A configured partition column that the rows lack is put in, from the date of the write."""
    sink = _sink(spark)
    sink.write(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "gold.nations", partition_column="load_period", effective_date=date(2024, 3, 1), lineage=False)
    return sink.table("gold.nations").read()


@query("SELECT o_orderkey, o_orderpriority, 'nightly' AS _gold_run_id, epoch(TIMESTAMP '2024-02-01')::BIGINT AS _gold_processed_at, 'orders.csv' AS _source_file FROM orders")
def sink_metadata_columns(spark, sf_dir):
    """Without lineage, rows carry run, time and file."""
    sink = _sink(spark)
    sink.write(_orders_slim(spark, sf_dir).drop("price"), "gold.orders", mode="append", contract=build_contract(_CONTRACT), lineage=False, run_id="nightly", source_file="orders.csv", now=_STAMP)
    return sink.table("gold.orders").read()


@query("SELECT 'p' || k AS partition_key, CASE WHEN k < 3 THEN '{\"reconciled_at\":\"2024-02-01T00:00:00\"}' ELSE '{}' END AS metadata FROM range(1, 5) t(k)")
def reconcile_and_stamp(spark, sf_dir):
    """A repair stamps the materialized periods of its source, and no others."""
    sink = _three_loads(spark, sf_dir)
    registry = periods.PeriodRegistry(spark, sink.root)
    registry.register([{"source_id": "s" if k < 4 else "other", "source_name": "n", "partition_key": f"p{k}", "status": "materialized" if k != 3 else "registered"} for k in range(1, 5)], now=_STAMP)
    periods.reconcile_and_stamp(sink, registry, "s", "gold.customers", ["c_custkey"], now=_STAMP, collapse_duplicates=False)
    return registry.read().select("partition_key", "metadata")


# Landing files -------------------------------------------------------------------------------------------------------
class _Answers:
    """Answers to URLs from memory, in place of a network."""

    def __init__(self, answers: dict[str, tuple[bytes, dict[str, str]]]):
        self.answers = answers

    def fetch(self, url, to):
        body, headers = self.answers[url]
        to.write_bytes(body)
        return headers


def _store(spark) -> objects.FolderStore:
    folder = Path(shared_root(spark).removeprefix("file:"))
    return objects.FolderStore({"public": folder / "public", "confidential": folder / "far"})


def _nation_files(spark, sf_dir) -> dict[int, bytes]:
    """One text file of nations for each region."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    return {r: ("n_nationkey,n_name\n" + "".join(f"{x['n_nationkey']},{x['n_name']}\n" for x in rows if x["n_regionkey"] == r)).encode() for r in sorted({x["n_regionkey"] for x in rows})}


def _landed(spark, sf_dir):
    """Every region's file inside an archive inside an archive, with a file beside it that nobody wants."""
    store, answers = _store(spark), {}
    for region, body in _nation_files(spark, sf_dir).items():
        inner, outer = io.BytesIO(), io.BytesIO()
        with zipfile.ZipFile(inner, "w") as z:
            z.writestr(f"part {region}.csv", body)
        with zipfile.ZipFile(outer, "w") as z:
            z.writestr("inner.zip", inner.getvalue())
            z.writestr("readme.txt", "no")
        answers[f"http://h/{region}.zip"] = (outer.getvalue(), {"Content-Type": "application/zip"})
    spec = ingest.IngestSpec("id", "nations", "public", "raw/{source_name}/{partition_key}", ("zip", "zip"), (), ("*.csv",), {"partitions": {"all": sorted(answers)}, "content_types": ["application/zip"]})
    return store, spec, ingest.PATTERNS["http_urls"](_Answers(answers)).materialize(ingest.Landing(store, spec, "all", clock=lambda: "now"))


@query("SELECT n_nationkey, n_name FROM nation")
def ingest_read_partition(spark, sf_dir):
    """Archives inside archives land file by file, a manifest comes last, and the partition is read back from it."""
    store, spec, _ = _landed(spark, sf_dir)
    out = ingest.read_partition(spark, store, spec, "all", source="csv", pattern="*.csv", header=True)
    return out.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


_FILES = "SELECT n_regionkey, 'n_nationkey,n_name' || chr(10) || string_agg(n_nationkey || ',' || n_name || chr(10), '' ORDER BY n_nationkey) AS body FROM nation GROUP BY n_regionkey"


@query(f"SELECT 'raw/nations/all/part ' || n_regionkey || '.csv' AS path, sha256(body) AS sha256, CAST(octet_length(encode(body)) AS BIGINT) AS size_bytes FROM ({_FILES})")
def ingest_manifest_files(spark, sf_dir):
    _, _, manifest = _landed(spark, sf_dir)
    return spark.createDataFrame([(f["path"], f["sha256"], f["size_bytes"]) for f in manifest.files], "path string, sha256 string, size_bytes long")


@query(f"SELECT sha256(body) AS sha256, CAST(octet_length(encode(body)) AS BIGINT) AS size FROM ({_FILES})")
def ingest_file_hashes(spark, sf_dir):
    """Hashes of landed files, worked out on the executors."""
    store, _, manifest = _landed(spark, sf_dir)
    paths = [str(store.containers["public"] / f["path"]) for f in manifest.files]
    return ingest.file_hashes(spark, paths).select("sha256", "size")


@query("SELECT 1 AS landing, count(DISTINCT n_regionkey) AS written FROM nation UNION ALL SELECT 2, 0")
def ingest_unchanged_files_stay(spark, sf_dir):
    """A file that is stored with the same hash is not written again."""
    store, files = _store(spark), _nation_files(spark, sf_dir)
    counts = [sum(store.put("public", f"raw/{r}.csv", body)[2] for r, body in files.items()) for _ in range(2)]
    return spark.createDataFrame([(k, n) for k, n in enumerate(counts, 1)], "landing int, written long")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def ingest_crawl_ndjson(spark, sf_dir):
    """Records of a crawl land as one JSON object a line."""
    rows = [r.asDict() for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()]
    store, spec = _store(spark), ingest.IngestSpec("id", "nations", "public", "crawl/{partition_key}/")
    crawl = ingest.PATTERNS["api_crawl"](lambda key, throttle: iter([(f"{r['n_regionkey']}.ndjson", r) for r in sorted(rows, key=lambda r: r["n_regionkey"])]))
    crawl.materialize(ingest.Landing(store, spec, "all"))
    return ingest.read_partition(spark, store, spec, "all", source="json", schema="n_nationkey long, n_name string, n_regionkey long")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
def ingest_mirror_by_name(spark, sf_dir):
    """Files of another store whose names fit a pattern and no exclusion are mirrored."""
    store = _store(spark)
    for region, body in _nation_files(spark, sf_dir).items():
        store.put("confidential", f"in/k/{'odd' if region % 2 else 'even'}-{region}.csv", body)
        store.put("confidential", f"in/k/odd-{region}.skip.csv", body)
    spec = ingest.IngestSpec("id", "nations", "public", "m/{partition_key}/", config={"root": "in/", "glob": "odd*.csv", "exclude": ("*.skip.csv",)})
    far = objects.FolderStore({"public": store.containers["confidential"]})
    ingest.PATTERNS["blob_mirror"](far).materialize(ingest.Landing(store, spec, "k"))
    out = ingest.read_partition(spark, store, spec, "k", source="csv", header=True)
    return out.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


@query("SELECT d AS day, strftime(date_trunc('quarter', d), '%Y-%m-%d') AS quarter, strftime(date_trunc('month', d), 'http://h/%Y-%m') AS url FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)", text="day")
def release_calendar(spark, sf_dir):
    """The release that was current on each day on which there were orders."""
    days = [r[0] for r in table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date")).distinct().collect()]
    rows = []
    for day in days:
        calendar = ingest.CalendarResolver(lambda day=day: day)
        rows.append((day, calendar.current({"cadence": "quarterly", "url": "u"}).key, calendar.current({"url": "http://h/%Y-%m"}).url))
    return spark.createDataFrame(rows, "day date, quarter string, url string")


@query("SELECT n_nationkey, replace(n_name, ' ', '_') || '.csv' AS header, 'nations-' || n_nationkey || '.csv' AS template FROM nation")
def payload_names(spark, sf_dir):
    """Names of payloads from a response's header and from a template."""
    rows = []
    for r in table(spark, sf_dir, "nation").collect():
        said, key = f'attachment; filename="{r["n_name"]}.csv"', str(r["n_nationkey"])
        rows.append((r["n_nationkey"], ingest.disposition_filename(said), ingest.render("{source_name}-{partition_key}.csv", key, "nations")))
    return spark.createDataFrame(rows, "n_nationkey long, header string, template string")


@query("SELECT n_nationkey, make_timestamp(1700000000000000 + n_nationkey * 1000) AS at FROM nation", text="at")
def uuid7_times(spark, sf_dir):
    """Time-ordered identifiers give their time back, and sort by it."""
    keys = sorted(r["n_nationkey"] for r in table(spark, sf_dir, "nation").collect())
    ids = [lineage.uuid7(1_700_000_000_000 + k) for k in keys]
    if ids != sorted(ids):
        raise AssertionError("identifiers don't sort by their time")
    return spark.createDataFrame([(k, lineage.uuid7_time(u).replace(tzinfo=None)) for k, u in zip(keys, ids, strict=True)], "n_nationkey long, at timestamp")


@query("SELECT 'unique' AS rule, o_custkey AS sample, count(*) AS copies FROM orders GROUP BY 2 HAVING count(*) > 1 ORDER BY copies DESC, o_custkey LIMIT 5")
def check_samples(spark, sf_dir):
    """A failing rule shows five samples."""
    result = checks.run_checks(table(spark, sf_dir, "orders"), [Rule("unique", "o_custkey")], now=NOW)[0]
    return spark.createDataFrame([("unique", s["o_custkey"], s["copies"]) for s in result.samples], "rule string, sample long, copies long")


@query("SELECT 'n_name' AS col, 0 AS shown")
def check_samples_redacted(spark, sf_dir):
    """Values of personal columns show neither in samples nor in messages."""
    nations = table(spark, sf_dir, "nation")
    names = [r["n_name"] for r in nations.collect()]
    result = checks.run_checks(nations, [Rule("not_in", "n_name", {"values": names}, pii=True)], now=NOW)[0]
    return spark.createDataFrame([("n_name", len(result.samples) + sum(n in result.message for n in names))], "col string, shown int")


@query("SELECT DISTINCT source_id FROM (SELECT *, CAST(json_extract_string(metadata, '$.n') AS INTEGER) AS n FROM (" + _REG + ")) WHERE n > 15")
def sensor_stamped(spark, sf_dir):
    """Periods with a stamp that came after the cursor, source by source."""
    reg = _registry(spark, sf_dir)
    n = F.get_json_object("metadata", "$.n").cast("int")
    stamped = reg.withColumn("metadata", F.when(n > 15, F.to_json(F.struct(F.lit("2024-01-01").alias("reconciled_at")))).otherwise("{}"))
    sources = [r[0] for r in stamped.select("source_id").distinct().collect()]
    return spark.createDataFrame([(x,) for x in sources if sensors.reconciled(stamped, x).keys], "source_id string")


@query("SELECT * FROM (VALUES ('clear', '0', 'delete'), ('clear', '9999', 'delete'), ('clear', '10000', 'truncate'), ('insert', '9999', 'insert'), ('insert', '10000', 'copy')) t(kind, rows, method)")
def write_methods(spark, sf_dir):
    """Methods that automatic choices stand for, by the number of rows."""
    schema = table(spark, sf_dir, "nation").schema
    rows = [("clear", str(n), outputs.clear_method("auto", n)) for n in (0, 9_999, 10_000)] + [("insert", str(n), outputs.insert_method(schema, "auto", n, "append")) for n in (9_999, 10_000)]
    return spark.createDataFrame(rows, "kind string, rows string, method string")


# Extensions, beyond the survey's inventory ---------------------------------------------------------------------------
@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2", text="window_start")
def extension_windowed_counts(spark, sf_dir):
    return batched.windowed_counts(table(spark, sf_dir, "events"), by=["event_type"])


@query("SELECT c_nationkey, c_custkey, CAST(c_acctbal AS DECIMAL(12,2)) AS bal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3", text="bal")
def extension_top_per_group(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").withColumn("r", F.row_number().over(w)).where("r <= 3").select("c_nationkey", "c_custkey", F.col("c_acctbal").cast("decimal(12,2)").alias("bal"))


@query(f"SELECT v.c_custkey, f.d AS at, v.row_hash FROM (SELECT c_custkey, TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 150 AS INTEGER)) AS d FROM customer) f JOIN ({_NUMBER.format(_STITCH.format(_COLLAPSE))}) v ON v.c_custkey = f.c_custkey AND f.d >= v.effective_from AND f.d < v.effective_to", text="at")
def extension_facts_to_versions(spark, sf_dir):
    """Facts joined to the version in force at their time: an equi-join on the key, the times as a filter beside it."""
    day = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("c_custkey") % 150).cast("int"))
    facts = table(spark, sf_dir, "customer").select("c_custkey", day.alias("at"))
    v = scd2_reconcile_frame(spark, sf_dir)
    return facts.join(v, (facts.c_custkey == v.c_custkey) & (facts["at"] >= v.effective_from) & (facts["at"] < v.effective_to)).select(facts.c_custkey, "at", "row_hash")


def scd2_reconcile_frame(spark, sf_dir):
    return scd.reconcile(versions(spark, sf_dir), "c_custkey")

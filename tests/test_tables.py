import io
import json
import os
import subprocess
import sys
import uuid
import zipfile
from datetime import date, datetime
from pathlib import Path

import duckdb
import pyspark
import pytest
from pyspark.errors import AnalysisException

from quarryline.operators import checks, lineage
from quarryline.plans.contracts import Period, build_contract
from quarryline.plans.sink import TableSink
from quarryline.sources import ingest, objects, outputs, readers
from quarryline.sources.snapshot import SnapshotTable, TableBusy
from quarryline.streaming import batched, sensors
from quarryline.support import observe, rendering, safety

from .test_contracts import data


@pytest.fixture
def sink(spark, tmp_path):
    return TableSink(spark, str(tmp_path / "tables"))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "id int, name string, value double")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_snapshot_versions_and_failed_commit(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path), "gold.things", keep=2)
    assert not t.exists()
    for k in range(3):
        assert t.commit(frame(spark, *[(i, "a", 1.0) for i in range(k + 1)])) == k + 1
    assert t.read().count() == 3 and t.versions() == [2, 3] and t.read(2).count() == 2
    with pytest.raises(ValueError):
        t.read(1)

    def reject(*_):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        t.commit(frame(spark, (9, "z", 0.0)), check=reject)
    assert t.read().count() == 3 and len(list(Path(t.path).glob("v=*"))) == 2
    assert t.commit(t.read().where("id > 0")) == 4 and t.read().count() == 2
    with t.locked(), pytest.raises(TableBusy):
        with t.locked():
            pass
    with pytest.raises(ValueError):
        SnapshotTable(spark, str(tmp_path), "a.b.c")
    t.drop()
    assert not t.exists()


def test_sink_modes(spark, sink):
    r = sink.write(frame(spark, (1, "a", 1.0), (2, "b", 2.0)), "silver.t", mode="append")
    assert r.stats == {"rows_in": 2, "rows_inserted": 2} and r.version == 1
    r = sink.write(frame(spark, (2, "c", 2.0), (3, "d", 3.0)), "silver.t", mode="upsert", primary_key="id")
    assert r.stats == {"rows_in": 2, "rows_upserted": 2, "rows_inserted": 1, "rows_updated": 1} and ids(sink.table("silver.t").read()) == [1, 2, 3]
    r = sink.write(frame(spark, (7, "c", 2.0)), "silver.t")
    assert r.stats["rows_deleted"] == 3 and ids(sink.table("silver.t").read()) == [7]
    r = sink.write(frame(spark, (8, "z", 2.0)), "silver.t", partition_column="name", partition_values=["z", "q"])
    assert ids(sink.table("silver.t").read()) == [7, 8]
    with pytest.raises(ValueError, match="partition_column"):
        sink.write(frame(spark, (8, "z", 2.0)), "silver.t", partition_values=["z"])
    assert {"_lineage_id", "_lineage_key"} <= set(sink.table("silver.t").read().columns)


def test_sink_scd2_and_reconcile(spark, sink):
    options = {"mode": "scd2", "business_key": "id", "detect_deletes": True}
    periods = [Period("s", date(2024, m, 1)) for m in (1, 2, 3)]
    loads = {1: [(1, "a", 1.0), (2, "b", 1.0)], 2: [(1, "a", 2.0)], 3: [(1, "a", 2.0), (2, "b", 1.0)]}
    out = sink.load_periods("gold.d", periods, lambda p: frame(spark, *loads[p.effective_from.month]), **options)
    assert [r.stats["rows_new"] for r in out] == [2, 0, 1] and [r.stats["rows_deleted"] for r in out] == [0, 1, 0]
    assert out[1].stats["rows_expired"] == 1 and sink.table("gold.d").read().count() == 4
    late = sink.write(frame(spark, (1, "a", 1.0), (2, "b", 1.0)), "gold.d", effective_date=date(2024, 1, 15), **options)
    assert late.stats["rows_expired"] == 1
    assert sink.reconcile("gold.d", ["id"]).rows_retimed > 0
    assert sink.table("gold.d").read().where("is_current").count() == 2
    again = sink.reconcile("gold.d", ["id"])
    assert (again.rows_collapsed, again.rows_retimed, again.rows_renumbered) == (0, 0, 0)
    with pytest.raises(ValueError, match="more than once"):
        sink.write(frame(spark, (1, "a", 1.0), (1, "b", 1.0)), "gold.d", **options)


def test_sink_contract_stops_the_write(spark, sink):
    contract = build_contract(data(sinks=[{"type": "table", "schema": "bronze", "table": "claims", "mode": "append"}]))
    good = spark.createDataFrame([("a", 5.0)], "claim_id string, amount double")
    r = sink.write(good, "bronze.claims", contract=contract)
    assert r.mode == "append" and r.checks.status == "passed" and r.post_checks.total == 2
    for bad in (spark.createDataFrame([(None, 5.0)], good.schema), good.where("false")):
        with pytest.raises(checks.ContractViolation):
            sink.write(bad, "bronze.claims", contract=contract)
    assert sink.table("bronze.claims").read().count() == 1 and len(list(Path(sink.table("bronze.claims").path).glob("v=*"))) == 1


def test_streamed_batches_commit_once(spark, sink, tmp_path):
    folder = tmp_path / "in"
    for k in range(3):
        frame(spark, (k, "a", 1.0)).coalesce(1).write.mode("append").parquet(str(folder))
    stream = lambda: batched.stream_files(spark, str(folder), frame(spark, (1, "a", 1.0)).schema, files_per_batch=1)
    assert batched.write_stream(stream(), sink, "silver.s", str(tmp_path / "progress"), mode="append") == [0, 1, 2]
    assert batched.write_stream(stream(), sink, "silver.s", str(tmp_path / "progress"), mode="append") == []
    assert ids(sink.table("silver.s").read()) == [0, 1, 2]
    assert batched.union_batches([frame(spark, (1, "a", 1.0))] * 2).select("_batch").distinct().count() == 2


def test_sensors(spark):
    rows = [("s", f"p{k}", "materialized", datetime(2024, 1, k), json.dumps({"reconciled_at": f"2024-02-0{k}"} if k % 2 else {})) for k in range(1, 5)] + [("s", "x", "pending", datetime(2025, 1, 1), "{}")]
    reg = spark.createDataFrame(rows, "source_id string, partition_key string, status string, registered_at timestamp, metadata string")
    s = sensors.registered(reg, "s", cursor=datetime(2024, 1, 2))
    assert s.keys == ["p3", "p4"] and s.cursor == datetime(2024, 1, 4)
    assert sensors.reconciled(reg, "s").keys == ["p1", "p3"]
    assert sensors.registered(reg, "s", cursor=s.cursor).keys == []
    assert sensors.barrier(reg, "s").first()["fire"] and not sensors.barrier(reg, "s", ready=sensors.has_stamp("reconciled_at")).first()["fire"]
    assert not sensors.barrier(reg, "none").first()["fire"]


def test_lineage_ids():
    a, b = lineage.uuid7(1_700_000_000_000), lineage.uuid7(1_700_000_000_001)
    assert a < b and a.version == 7 and lineage.uuid7_time(b).timestamp() == 1_700_000_000.001
    assert lineage.lineage_key("claims_silver", "silver", "run123456", data_date=date(2024, 1, 1)) == "v1:claims:silver:2024-01-01:run123"
    assert len(lineage.lineage_key("c", "gold", "r", source_file="f").split(":")[3]) == 8


def test_registry_merge_and_metadata(spark):
    schema = "source_id string, partition_key string, status string, metadata string, registered_at timestamp"
    reg = spark.createDataFrame([("s", "p", "new", '{"a":"1","b":"2"}', datetime(2020, 1, 1))], schema)
    out = lineage.register_periods(reg, spark.createDataFrame([("s", "p", "done", '{"b":"3"}'), ("s", "q", "done", None)], "source_id string, partition_key string, status string, metadata string"), now=datetime(2024, 1, 1))
    assert sorted(map(tuple, out.select("partition_key", "status", "metadata").collect())) == [("p", "done", '{"a":"1","b":"3"}'), ("q", "done", "{}")]
    touched = lineage.update_metadata(reg, spark.createDataFrame([("s", "p", '{"c":"4"}'), ("s", "zz", "{}")], "source_id string, partition_key string, metadata string"))
    assert [r["metadata"] for r in touched.collect()] == ['{"a":"1","b":"2","c":"4"}']


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", date(2024, 1, 1)), (2, "b", date(2024, 2, 1)), (3, "c", None)], "id int, name string, load_period date")
    assert ids(readers.latest_partition(df)) == [2] and ids(readers.load(df, ["id"], "name", ["a", "c"])) == [1, 3]
    with pytest.raises(readers.EmptyPartitionedTable):
        readers.latest_partition(df.where("false"))
    with pytest.raises(ValueError):
        readers.load(df, ["id; drop"])
    assert [p.count() for p in readers.pages(df, ["id"], 2)] == [2, 1] and sum(map(len, readers.batches(df, 2))) == 3
    df.write.parquet(str(tmp_path / "t"))
    text = readers.read_parquet(spark, [str(tmp_path / "t")], ["id"], with_origin=True)
    assert dict(text.dtypes) == {"id": "string", "_source_file": "string", "_row_index": "bigint"}
    assert readers.split_name("a.b") == ("a", "b")


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, b in files.items():
            z.writestr(n.replace("__", "."), b)
    return out.getvalue()


class Client:
    def __init__(self, pages):
        self.pages = pages

    def fetch(self, url, to):
        body, headers = self.pages[url]
        to.write_bytes(body)
        return headers


def test_ingest_lands_and_reads_back(spark, tmp_path):
    store = objects.FolderStore({"public": tmp_path / "public"})
    inner = archive(a__csv="id,name\n1,x\n", b__txt="no")
    spec = ingest.IngestSpec("id1", "src", "public", "raw/{source_name}/{partition_key}", ("zip", "zip"), (".csv",), ("*a", "c"), {"partitions": {"2024": ["http://h/x.zip"]}})
    client = Client({"http://h/x.zip": (archive(inner__zip=inner, c__csv="id,name\n2,y\n"), {"Content-Type": "application/zip"})})
    landing = ingest.Landing(store, spec, "2024", clock=lambda: "now")
    pattern = ingest.PATTERNS["http_urls"](client)
    assert pattern.discover(spec) == ["2024"]
    first = pattern.materialize(landing)
    assert [f["path"] for f in first.files] == ["raw/src/2024/a", "raw/src/2024/c"]
    assert pattern.materialize(landing) == first and store.put("public", "raw/src/2024/a", b"id,name\n1,x\n")[2] is False
    assert sorted(map(tuple, ingest.read_partition(spark, store, spec, "2024", source="csv", header=True).collect())) == [("1", "x"), ("2", "y")]
    hashes = {r["sha256"] for r in ingest.file_hashes(spark, [str(tmp_path / "public/raw/src/2024/a")]).collect()}
    assert hashes == {first.files[0]["sha256"]}
    with pytest.raises(ingest.IngestError, match="not landed"):
        ingest.read_manifest(store, spec, "2025")
    with pytest.raises(ingest.IngestError, match="lack"):
        ingest.read_manifest(store, spec, "2024", ("release",))


def test_ingest_other_patterns(tmp_path):
    store, far = objects.FolderStore({"phi": tmp_path / "phi"}), objects.FolderStore({"public": tmp_path / "far"})
    spec = ingest.IngestSpec("i", "s", "phi", "p/{partition_key}/", config={"root": "in/", "glob": "*.csv", "exclude": ("skip*",), "cadence": "quarterly", "url": "http://h/%Y-%m"})
    for n in ("in/k1/a.csv", "in/k1/skip.csv", "in/k1/b.txt", "in/k2/x.csv"):
        far.put("public", n, n.encode())
    mirror = ingest.PATTERNS["blob_mirror"](far)
    assert mirror.discover(spec) == ["k1", "k2"] and [f["path"] for f in mirror.materialize(ingest.Landing(store, spec, "k1")).files] == ["p/k1/a.csv"]
    crawl = ingest.PATTERNS["api_crawl"](lambda key, throttle: iter([("r.ndjson", {"b": 1, "a": key})]))
    crawl.materialize(ingest.Landing(store, spec, "k9"))
    assert store.stream("phi", "p/k9/r.ndjson").read() == b'{"a": "k9", "b": 1}\n'
    with pytest.raises(ingest.IngestError, match="no record"):
        ingest.PATTERNS["api_crawl"](lambda *_: iter([])).materialize(ingest.Landing(store, spec, "k8"))
    resolver = ingest.CalendarResolver(lambda: date(2024, 5, 15))
    api = ingest.PATTERNS["api_resolver"](Client({"http://h/2024-04": (b"x", {"content-disposition": 'attachment; filename="f 1.csv"'})}), resolver)
    assert api.discover(spec) == ["2024-04-01"] and api.materialize(ingest.Landing(store, spec, "2024-04-01")).files[0]["path"] == "p/2024-04-01/f_1.csv"
    listed = ingest.ListResolver(lambda: iter([{"name": "a", "date": "2023-01-01", "url": "u"}, {"name": "b", "date": "bad", "url": "u"}, {"name": "c", "date": "2024-01-01", "url": "u"}]))
    assert [r.key for r in listed.historical({"start_date": "2023-06-01"})] == ["b", "c"]


def test_ingest_helpers(tmp_path):
    assert ingest.disposition_filename("attachment; filename*=UTF-8''a%20b.csv; filename=\"c\"") == "a_b.csv"
    assert ingest.render("{source_name}/{partition_key}", "k", "s") == "s/k"
    for bad in (b"[]", b"x", b'{"manifest_version": 2}', b'{"manifest_version": true}', b'{"manifest_version": 1}'):
        with pytest.raises(ingest.IngestError):
            ingest.Manifest.parse(bad)
    with pytest.raises(objects.StreamTooLarge):
        objects.drain(io.BytesIO(b"x" * 100), 99)
    assert objects.drain(io.BytesIO(b"x" * 99), 99) == b"x" * 99
    with pytest.raises(LookupError):
        objects.resolve_glob(iter(["a/1", "a/2"]), "a/*")
    with pytest.raises(ValueError):
        objects.FolderStore({"public": tmp_path}).put("public", "../x", b"")
    t, slept = ingest.Throttle(2, clock=lambda: 10.0, sleep=lambda s: slept.append(s)), []
    t.wait(), t.wait()
    assert slept == [0.5]


def test_support(spark):
    df = spark.createDataFrame([(k, f"n{k}", None) for k in range(12)], "id int, name string, x string")
    text = rendering.to_markdown(df.orderBy("id"), pii_columns=["name"], max_rows=2)
    assert text.splitlines() == ["| id | name | x |", "| --- | --- | --- |", "| 0 | *** |  |", "| 1 | *** |  |", "", "*Showing 2 of 12 rows.*"]
    assert safety.safe_copy(df, "id > 3 AND upper(name) = 'N5'").count() == 1 and safety.safe_copy(df, None, 3).count() == 3
    for bad in ("id = 1; DROP TABLE x", "id IN (SELECT 1)", "secret = 1", "id ==== 1", "1=1 UNION ALL", "id = 1 -- x"):
        with pytest.raises(safety.UnsafeSql):
            safety.safe_filter(spark, bad, df.columns)
    with observe.Sampler(0.01) as s:
        pass
    assert s.samples and s.peak
    sent = []
    events = observe.LineageEvents(sent.append, "ns")
    run = events.emit("START", "job", outputs=["t"])
    assert events.emit("COMPLETE", "job", run) == run and [e["eventType"] for e in sent] == ["START", "COMPLETE"]
    observe.LineageEvents(lambda _: 1 / 0, "ns").emit("FAIL", "job")


def files_of(table):
    return {p.name: p.stat().st_size for p in Path(table.path).rglob("*.parquet")}


def test_append_and_refresh_write_their_own_parts_only(spark, sink):
    big = spark.range(20_000).selectExpr("cast(id as int) id", "concat('n', id % 4) name", "id / 3.0 value")
    sink.write(big, "silver.t", partition_column="name", lineage=False)
    before = files_of(sink.table("silver.t"))
    sink.write(frame(spark, (1, "n1", 1.0)), "silver.t", mode="append", lineage=False)
    added = {n: s for n, s in files_of(sink.table("silver.t")).items() if n not in before}
    assert before.items() <= files_of(sink.table("silver.t")).items() and sum(added.values()) < sum(before.values()) / 10
    r = sink.write(frame(spark, (7, "n2", 1.0), (8, "n9", 1.0)), "silver.t", partition_column="name", lineage=False)
    assert r.stats == {"rows_in": 2, "rows_inserted": 2, "rows_deleted": 5000}
    t = sink.table("silver.t")
    assert t.read().count() == 15_003 and t.read_values("name", ["n2", "n9"]).count() == 2
    kept = [p for p in t.parts() if p.get("value") in ("n0", "n1", "n3")]
    assert len(kept) == 4 and t.read_parts(kept).count() == 15_001
    assert "name#" not in str(t.read_values("name", [])) and t.read_values("name", []).count() == 0
    # a part of several partitions is written again without the rows that go
    r = sink.write(frame(spark, (5, "n1", 5.0)), "silver.t", partition_column="name", partition_values=["n1"], lineage=False)
    assert r.stats["rows_deleted"] == 5001 and t.read_values("name", ["n1"]).count() == 1
    assert t.compact("name") > 0 and t.read().count() == 10_003 and {p["by"] for p in t.parts()} == {"name"}


def test_ended_versions_stay_in_their_files(spark, sink):
    options = {"mode": "scd2", "business_key": "id", "detect_deletes": True, "lineage": False}
    rows = lambda v, *ids: frame(spark, *[(k, "a", v) for k in ids])
    sink.write(rows(1.0, *range(100)), "gold.d", effective_date=date(2024, 1, 1), **options)
    sink.write(rows(2.0, *range(50)), "gold.d", effective_date=date(2024, 2, 1), **options)
    t = sink.table("gold.d")
    ended = [p for p in t.parts() if p["value"] == "false"]
    assert t.read_parts(ended).count() == 100
    r = sink.write(rows(2.0, *range(60)), "gold.d", effective_date=date(2024, 3, 1), **options)
    assert r.stats["rows_new"] == 10 and r.stats["rows_unchanged"] == 50
    assert [p for p in t.parts() if p in ended] == ended
    assert {r["seq_id"] for r in t.read().where("id between 50 and 59 and is_current").collect()} == {2}


def test_a_write_joins_once_and_shuffles_each_side_once(spark, sink, monkeypatch):
    plans = []
    stage = SnapshotTable.stage

    def watched(self, df, split=None):
        if self.schema_name != "meta":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(self, df, split)

    monkeypatch.setattr(SnapshotTable, "stage", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for options in ({"mode": "scd2", "business_key": "id"}, {"mode": "upsert", "primary_key": "id"}):
            for k in (1, 2):
                sink.write(frame(spark, (1, "a", float(k)), (2, "b", 1.0)), f"gold.{options['mode']}", lineage=False, **options)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) == 4
    for plan in plans:
        assert plan.count("Exchange hashpartitioning") <= 2 and plan.count("Join ") == 1, plan


def test_a_batch_is_committed_with_its_number(spark, sink):
    df = frame(spark, (1, "a", 1.0))
    assert sink.write(df, "silver.s", mode="append", batch=("job", 0)).version == 1
    # the same batch after a crash that lost the stream's own note of it
    again = sink.write(df, "silver.s", mode="append", batch=("job", 0))
    assert again.version is None and "written before" in again.notes[0]
    assert sink.write(df, "silver.s", mode="append", batch=("other", 0)).version == 2
    assert sink.write(df, "silver.s", mode="append", batch=("job", 1)).version == 3
    assert sink.table("silver.s").read().count() == 3


def test_unknown_columns_are_refused(spark, sink):
    sink.write(frame(spark, (1, "a", 1.0)), "silver.t", mode="append")
    wide = frame(spark, (2, "b", 2.0)).selectExpr("*", "1 as extra")
    for options in ({"mode": "append"}, {"mode": "upsert", "primary_key": "id"}, {"partition_column": "name"}):
        with pytest.raises(ValueError, match="extra"):
            sink.write(wide, "silver.t", **options)
    assert sink.table("silver.t").read().count() == 1


def test_a_lock_left_behind_is_taken_over_and_fences_its_writer(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path), "gold.things")
    other = SnapshotTable(spark, str(tmp_path), "gold.things", stale=0)
    with pytest.raises(TableBusy, match="took over"):
        with t.locked():
            with other.locked():
                other.commit(frame(spark, (2, "b", 1.0)))
            t.commit(frame(spark, (1, "a", 1.0)))
    assert ids(t.read()) == [2]
    with t.locked():
        t.commit(frame(spark, (3, "c", 1.0)))
    assert ids(t.read()) == [3]


def test_replaced_versions_stay_for_a_while(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path), "gold.things", keep=1, grace=3600)
    for k in range(3):
        t.commit(frame(spark, (k, "a", 1.0)))
    assert t.versions() == [1, 2, 3] and ids(t.read(1)) == [0]


def test_events_records_and_drift_of_a_write(spark, tmp_path):
    sent = []
    sink = TableSink(spark, str(tmp_path), events=observe.LineageEvents(sent.append, "ns"), pipeline={"pipeline_id": "p", "contract_hash": "h"})
    contract = build_contract(data(sinks=[{"type": "table", "schema": "bronze", "table": "claims", "mode": "append"}]))
    good = spark.createDataFrame([("a", 5.0)], "claim_id string, amount double")
    plain = build_contract(data(schema={"columns": [{"name": "claim_id", "type": "string", "nullable": True, "pii": False}], "strict": False}, sinks=[{"type": "table", "schema": "bronze", "table": "copy", "mode": "append"}]))
    with pytest.warns(UserWarning, match="personal upstream"):
        sink.write(good, "bronze.copy", contract=plain, upstream=contract, lineage=False)
    assert any(c.endswith("_run_id") for c in sink.table("bronze.copy").read().columns)
    sink.write(good, "bronze.claims", contract=contract)
    with pytest.raises(checks.ContractViolation):
        sink.write(good.where("false"), "bronze.claims", contract=contract)
    assert [e["eventType"] for e in sent] == ["START", "COMPLETE", "START", "COMPLETE", "START", "FAIL"]
    rows = sink.records.read("checks").where("phase = 'after'")
    assert rows.count() == 4 and rows.where("passed").count() == 4
    assert sink.records.read("pipelines").count() == 1 and sink.records.read("lineage").count() == 2


def test_discovery_skips_failures_but_not_refusals(spark):
    class Answer(Exception):
        def __init__(self, status):
            self.status = status

    def fail(status):
        def look():
            raise Answer(status)

        return look

    known = spark.createDataFrame([("2024-01",)], "partition_key string")
    assert sensors.discover(lambda: ["2024-02", "2024-01", "2024-03"], known).keys == ["2024-02", "2024-03"]
    for status in (401, 403):
        with pytest.raises(sensors.AccessDenied):
            sensors.discover(fail(status), known)
    skipped = sensors.discover(fail(500), known)
    assert skipped.keys == [] and "next tick" in skipped.skipped
    assert sensors.discover(lambda: [], known).skipped


def test_input_order_needs_a_scan(spark):
    from quarryline.operators import writes

    df = spark.createDataFrame([(1, "a"), (1, "b")], "id int, name string")
    assert writes.last_input_wins(df.coalesce(1), ["id"]).first()["name"] == "b"
    with pytest.raises(ValueError, match="order_by"):
        writes.last_input_wins(df.repartition(3), ["id"])
    assert writes.last_input_wins(df.repartition(3), ["id"], ["name"]).first()["name"] == "b"


def test_pages_need_an_order_that_tells_rows_apart(spark):
    df = spark.createDataFrame([(k, f"n{k % 2}") for k in range(7)] + [(None, "n")], "id int, name string")
    assert [[r["id"] for r in p.collect()] for p in readers.pages(df, ["id"], 3)] == [[None, 0, 1], [2, 3, 4], [5, 6]]
    assert [[r["id"] for r in p.collect()] for p in readers.pages(df, ["name", "id"], 4)] == [[None, 0, 2, 4], [6, 1, 3, 5]]
    with pytest.raises(ValueError, match="apart"):
        list(readers.pages(df, ["name"], 3))


def test_frames_of_bounded_size(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("id", "'x' as t")
    frames = list(readers.batches(df, 64))
    assert [len(f) for f in frames] == [64] * 15 + [40] and sorted(i for f in frames for i in f["id"]) == list(range(1000))
    assert list(readers.batches(df.where("id < 0"), 10)) == []


def test_rows_into_a_database_from_partitions_or_the_driver(spark):
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(k, None if k % 5 == 0 else f"n'{k}\n\u00e9\"" if k % 2 else "", None if k % 3 == 0 else k / 4, date(2024, 1, 1 + k) if k else None) for k in range(13)]
    df = spark.createDataFrame(rows, "id long, name string, value double, day date").repartition(3)
    for here in (False, True):
        url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
        read = lambda url=url: sorted((tuple(r) for r in readers.jdbc(spark, url, "SELECT * FROM t", properties=driver).collect()), key=repr)
        outputs.write_jdbc(df, url, "t", batch_size=2, properties=driver, from_driver=here)
        assert read() == sorted(rows, key=repr)
        outputs.write_jdbc(df.where("id < 2"), url, "t", properties=driver, from_driver=here)
        assert read() == sorted(rows + rows[:2], key=repr)
        with pytest.raises(AnalysisException):
            outputs.write_jdbc(df, url, "t", mode="error", properties=driver, from_driver=here)
        outputs.write_jdbc(df.where("id > 10"), url, "t", mode="overwrite", properties=driver, from_driver=here)
        assert read() == sorted(rows[11:], key=repr)
        outputs.write_jdbc(df.where("id < 0"), url, "t", mode="overwrite", properties=driver, from_driver=here)
        assert read() == []
    with pytest.raises(ValueError, match="ignore"):
        outputs.write_jdbc(df, url, "t", mode="ignore", properties=driver, from_driver=True)
    assert spark.range(3).count() == 3  # the driver's thread is no task's any more


def test_jdbc_roundtrip_on_a_cluster(tmp_path, sf_dir):
    """Executors in processes of their own, which see none of the driver's memory."""
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for f in Path(pyspark.__file__).parent.iterdir():  # executors keep their logs in Spark's home
        if f.name != "work":
            (home / f.name).symlink_to(f)
    code = f"""
from pyspark.sql import SparkSession
import __spark_entry__
conf = {{"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "600m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": "file://{tmp_path}/shared"}}
spark = SparkSession.builder.config(map=conf).getOrCreate()
for r in __spark_entry__.queries()["jdbc_roundtrip"](spark, {sf_dir!r}).collect():
    print("row", *r, sep="|")
spark.stop()
"""
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "PYTHONPATH": str(Path(__file__).parents[1]), "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-3000:]
    got = sorted(line for line in run.stdout.splitlines() if line.startswith("row|"))
    want = duckdb.sql(f"SELECT c_custkey, c_name, c_nationkey FROM '{sf_dir}/customer.parquet'").fetchall()
    assert len(want) > 0 and got == sorted(f"row|{k}|{name}|{nation}" for k, name, nation in want)

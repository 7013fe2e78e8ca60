from datetime import date, datetime

import pytest
from pyspark.sql import types as T

from quarryline.plans import periods, suite
from quarryline.plans.contracts import ContractError, DataSource, Period, build_contract
from quarryline.plans.sink import TableSink, pii_drift
from quarryline.sources import ingest, outputs, readers
from quarryline.streaming import sensors

from .test_contracts import data

NOW = datetime(2024, 6, 1)


def test_suites_are_found_and_scoped(spark, tmp_path):
    import yaml

    (tmp_path / "c.contract.yaml").write_text(yaml.safe_dump(data(sinks=[{"type": "table", "schema": "gold", "table": "claims", "mode": "scd2", "business_key": "claim_id"}])))
    (found,) = suite.discover([tmp_path], suffix="_test")
    assert found.table == "gold.claims_test" and found.current_column == "is_current"
    df = spark.createDataFrame([("a", 1.0, True), ("a", 2.0, False)], "claim_id string, amount double, is_current boolean")
    results = suite.run_all([found], lambda _: df, now=NOW)["gold.claims_test"]
    assert all(r.passed for r in results) and len(results) == 7
    assert not any(r.passed for r in found.run(df.drop("is_current"), now=NOW))
    up, down = build_contract(data()), build_contract(data(schema={"columns": [{"name": "claim_id", "type": "string", "nullable": True, "pii": False}]}))
    assert pii_drift(up, down) == ["claim_id"] and pii_drift(down, up) == []


def source(*starts, **more):
    return DataSource("id1", "src", tuple(Period("uri", d, **more) for d in starts))


def test_corpus_errors():
    spec = ingest.IngestSpec("i1", "raw", "public", "p/")
    good = periods.Corpus({"raw": spec}, {"src": source(date(2024, 1, 1))}, {"src": "raw"})
    assert good.check() is good
    bad = periods.Corpus({"raw": spec, "two": ingest.IngestSpec("i1", "two", "secret", "p/")}, {"src": source(date(2024, 2, 1), date(2024, 1, 1), partition_key="k")}, {"src": "gone", "none": "raw"})
    with pytest.raises(ContractError) as e:
        bad.check()
    assert len(e.value.errors) == 6


def test_periods_are_registered_stamped_and_reconciled(spark, tmp_path):
    sink, reg = TableSink(spark, str(tmp_path)), periods.PeriodRegistry(spark, str(tmp_path))
    src = source(date(2024, 1, 1), date(2024, 2, 1))
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    for p in src.periods:
        sink.write(df, "gold.d", mode="scd2", business_key="id", effective_date=p.effective_from)
        assert periods.register_after_write(reg, src, p.effective_from, layer="bronze", run_id="r", now=NOW)
    assert not periods.register_after_write(reg, src, date(1999, 1, 1), layer="bronze", run_id="r", now=NOW)
    assert periods.register_after_write(reg, src, date(2024, 1, 1), layer="silver", run_id="r", now=NOW)
    assert sensors.silver_done(reg.read(), "id1").keys == ["2024-01-01"]
    assert periods.reconcile_and_stamp(sink, reg, "id1", "gold.d", ["id"], now=NOW).rows_collapsed == 0
    assert sensors.reconciled(reg.read(), "id1").keys == ["2024-01-01", "2024-02-01"]
    assert periods.effective_periods(reg.read(), "id1", date(2024, 1, 15)).count() == 1
    with pytest.warns(UserWarning, match="not registered"):
        periods.register_after_write(None, src, date(2024, 1, 1), layer="bronze", run_id="r", now=NOW)


def test_text_files_keep_null_empty_and_marker_apart(spark, tmp_path):
    rows = [(1, None, 1.5), (2, "", None), (3, "\\N", 0.0), (4, 'a,"b"\\n\\"c', 2.0), (5, "line\nbreak, ü", -1.0), (None, ",", None)]
    schema = T.StructType().add("id", T.IntegerType()).add("t", T.StringType()).add("x", T.DoubleType())
    outputs.write_csv(spark.createDataFrame(rows, schema), str(tmp_path / "csv"))
    assert sorted(map(tuple, outputs.read_csv(spark, str(tmp_path / "csv"), schema).collect()), key=repr) == sorted(rows, key=repr)
    with pytest.raises(ValueError):
        outputs.write_csv(spark.sql("SELECT array(1) AS a"), str(tmp_path / "no"))


def test_methods_and_statistics(spark):
    flat, nested = T.StructType().add("a", T.IntegerType()), T.StructType().add("a", T.ArrayType(T.IntegerType()))
    assert [outputs.clear_method("auto", n) for n in (None, 9_999, 10_000)] == ["delete", "delete", "truncate"] and outputs.clear_method("delete", 10**6) == "delete"
    assert outputs.insert_method(flat, rows=10_000) == "copy" and outputs.insert_method(nested, rows=10**6) == "insert" and outputs.insert_method(flat, rows=10**6, mode="upsert") == "insert"
    with pytest.raises(ValueError):
        outputs.insert_method(nested, "copy")
    assert not outputs.analyze(spark, "no.table", mode="always") and not outputs.analyze(spark, "x", mode="partitioned")


def test_sources_and_secrets(tmp_path):
    c = build_contract(data(sources=[{"type": "table", "schema": "bronze", "table": "raw"}]))
    assert readers.source_table(c) == "bronze.raw" and readers.source_table(c, test_prefix="t_") == "t_bronze_raw_source"
    assert readers.probed_schema([("a", "int8"), ("b", "point"), ("c", "numeric")]) == "`a` bigint, `c` double"
    assert ingest.without_secrets("https://u:p@h/x?api_key=abc&y=1") == "https://***@h/x?api_key=***&y=1"

    class Broken:
        def fetch(self, url, to):
            raise OSError(f"no {url}")

    waits = []
    with pytest.raises(ingest.IngestError) as e:
        ingest.RedactingClient(Broken(), sleep=waits.append).fetch("https://h/?token=abc", tmp_path / "x")
    assert "abc" not in str(e.value) and waits == [1.0, 2.0]

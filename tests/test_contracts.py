from datetime import date, datetime

import pytest
from pyspark.sql import types as T

from quarryline.operators import checks
from quarryline.operators.checks import Rule
from quarryline.plans import config, contracts
from quarryline.plans.contracts import ContractError, build_contract

NOW = datetime(2024, 6, 1, 12)


def data(**more):
    return {
        "version": "1.0", "pipeline_id": "550e8400-e29b-41d4-a716-446655440000", "asset": "claims", "layer": "bronze",
        "schema": {"strict": False, "columns": [
            {"name": "claim_id", "type": "string", "nullable": False, "primary_key": True, "tests": ["not_null", "unique"]},
            {"name": "amount", "type": "decimal", "nullable": True, "pii": False, "tests": [{"greater_than": 0, "severity": "warn"}, {"between": {"min": 0, "max": 100}}]},
        ]},
        "expectations": [{"row_count": {"min": 1}}, {"unique_combination": {"columns": ["claim_id", "amount"]}}],
        "sinks": [{"type": "table", "schema": "bronze", "table": "claims", "mode": "upsert"}], "owner": {"team": "data"}, "tags": {"tier": "1"},
    } | more


def test_loading(tmp_path):
    import yaml

    (tmp_path / "a").mkdir()
    path = tmp_path / "a" / "claims.contract.yaml"
    path.write_text(yaml.safe_dump(data()))
    c = contracts.load_contract(path)
    assert c.primary_key == ["claim_id"] and c.pii_columns == ["claim_id"] and contracts.classification(c) == "PHI"
    assert [r.name for r in c.rules()] == ["claim_id__not_null", "claim_id__unique", "amount__greater_than", "amount__between", "row_count", "unique_combination"]
    index = contracts.ContractIndex([tmp_path])
    assert index.find("claims") == c and index.find("bronze.claims") == c and index.find("x/claims") == c and index.find("nothing") is None
    (tmp_path / "other.contract.yaml").write_text(yaml.safe_dump(data(layer="silver")))
    both = contracts.ContractIndex([tmp_path])
    assert both.find("claims", "silver").layer == "silver"
    with pytest.raises(ContractError, match="2 contracts"):
        both.find("claims")
    assert contracts.contract_tags([c])["quarryline/owner"] == "data"
    assert contracts.contract_hash(c) == contracts.contract_hash(build_contract(data())) != contracts.contract_hash(build_contract(data(asset="x")))
    assert contracts.schema_fingerprint(c) == contracts.schema_fingerprint(build_contract(data(asset="x")))


@pytest.mark.parametrize(("change", "text"), [
    ({"version": None, "layer": "iron"}, "layer must be one of"), ({"pipeline_id": "x"}, "no UUID"), ({"shema": {}}, "did you mean 'schema'"), ({"schema": {"columns": []}}, "not empty"),
    ({"schema": {"columns": [{"name": "a", "type": "text", "nullable": True}]}}, "type must be one of"), ({"schema": {"columns": [{"name": "a", "type": "string", "nullable": True, "tests": ["not_nul"]}]}}, "did you mean 'not_null'"),
    ({"schema": {"columns": [{"name": "a", "type": "string", "nullable": True, "tests": [{"pattern": {"regex": "x", "severity": "warn"}}]}]}}, "belongs beside"),
    ({"schema": {"columns": [{"name": "a", "type": "string", "nullable": True, "tests": ["between"]}]}}, "between needs min"), ({"expectations": [{"freshness": {"column": "a"}}]}, "needs max_age_hours"), ({"owner": {}}, "owner needs team"),
])
def test_errors(change, text):
    with pytest.raises(ContractError, match=text):
        build_contract(data(**change))


def test_schema_check():
    c = build_contract(data())
    fits = T.StructType().add("claim_id", "string").add("amount", "double").add("extra", "integer")
    assert contracts.check_schema(c, fits).passed
    strict = build_contract(data(schema=data()["schema"] | {"strict": True}))
    assert "unexpected extra" in contracts.check_schema(strict, fits).message
    assert contracts.check_schema(c, T.StructType().add("amount", "string")).failed == 2


def test_checks(spark):
    df = spark.createDataFrame([("a", 5.0, date(2024, 6, 2)), ("a", None, date(2024, 5, 31)), (None, 500.0, None), (None, -1.0, date(2020, 1, 1))], "s string, x double, d date")
    rules = [
        Rule("not_null", "s"), Rule("not_null", "s", when="not_null"), Rule("unique", "s"), Rule("between", "x", {"min": 0, "max": 100}), Rule("not_in_future", "d"), Rule("within_days", "d", {"value": 30}), Rule("not_in_future", "s"),
        Rule("min_length", "gone", {"length": 1}), Rule("row_count", params={"min": 5}), Rule("freshness", params={"column": "d", "max_age_hours": 48}), Rule("null_percentage", params={"column": "s", "max_percent": 50}),
        Rule("unique_combination", params={"columns": ["s", "x"]}), Rule("pattern", "s", {"value": "b"}, pii=True),
    ]
    got = checks.run_checks(df, rules, now=NOW)
    assert [(r.passed, r.failed) for r in got] == [(False, 2), (True, 0), (False, 2), (False, 2), (False, 1), (False, 2), (False, 4), (False, 1), (False, 1), (True, 0), (True, 2), (True, 0), (False, 2)]
    assert got[3].samples == [500.0, -1.0] and got[12].samples == [] and "a" not in got[12].message.split("Sample")[1].replace("Sample values", "").replace("REDACTED - column marked as PII", "").replace("values", "")
    assert checks.unique_counts(df, ["s"], null_policy="sql").first() == (3, 4)
    empty = checks.run_checks(df.where("false"), [Rule("not_null", "s"), Rule("unique", "s"), Rule("null_percentage", params={"column": "s", "max_percent": 0}), Rule("freshness", params={"column": "d", "max_age_hours": 1})], now=NOW)
    assert [r.passed for r in empty] == [True, True, True, False]
    hist = Rule("history_completeness")
    days = [date(2024, 6, 2), date(2020, 1, 1), date(1999, 1, 1)]
    run = lambda d: checks.run_checks(df, [hist], now=NOW, periods=days, effective_date=d, effective_from="d")[0]
    assert run(days[0]).passed and not run(days[2]).passed and not run(None).passed and run(None).failed == 1


def test_enforcement(spark):
    df = spark.createDataFrame([(None,)], "s string")
    results = checks.run_checks(df, [Rule("not_null", "s"), Rule("not_null", "s", severity="warn")], now=NOW)
    with pytest.raises(checks.ContractViolation):
        checks.enforce(results)
    s = checks.enforce(results, "warn")
    assert (s.status, s.failed, s.warned, s.passed) == ("failed", 1, 1, 0)


def test_reconcile_config():
    c = build_contract(data())
    plan, named = config.WriteConfig.of()
    out = config.reconcile(c, plan, named, "bronze", "claims")
    assert (out.mode, out.primary_key) == ("upsert", ["claim_id"])
    with pytest.warns(UserWarning, match="one place"):
        config.reconcile(c, *config.WriteConfig.of(mode="upsert"), "bronze", "claims")
    with pytest.raises(ContractError, match="in the contract"):
        config.reconcile(c, *config.WriteConfig.of(mode="append"), "bronze", "claims")
    with pytest.warns(UserWarning, match="none was applied"):
        assert config.matching_sink(c, "gold", "claims") is None
    assert config.matching_sink(c, "bronze", "renamed")["mode"] == "upsert"
    twice = build_contract(data(sinks=data()["sinks"] * 2))
    with pytest.raises(ContractError, match="several sinks"):
        config.matching_sink(twice, None, "claims")


@pytest.mark.parametrize("bad", [{"mode": "upsert"}, {"mode": "scd2"}, {"mode": "append", "skip_unchanged": True}, {"mode": "append", "detect_deletes": True}, {"mode": "upsert", "primary_key": ["z"]}, {"mode": "full_refresh", "partition_column": "z"}, {"mode": "merge"}])
def test_config_validation(bad):
    with pytest.raises(ValueError):
        config.validate(config.WriteConfig(**bad), ["a", "b"])


def test_partition_safety():
    for bad in ({"mode": "full_refresh"}, {"mode": "scd2", "business_key": ["a"]}, {"mode": "upsert", "primary_key": ["a"], "partition_column": "p"}):
        with pytest.raises(ValueError):
            config.validate_partition_safety(config.WriteConfig(**bad), True)
    config.validate_partition_safety(config.WriteConfig(mode="append"), True)
    with pytest.raises(ValueError, match="missing"):
        config.validate_columns(["a"], ["a", "b"])


def test_tags_and_periods():
    from quarryline.streaming.sensors import partitions_of, period_of

    tags = contracts.RunTags().add({"a": "1"}, b="2")
    assert tags == {"a": "1", "b": "2"}
    with pytest.raises(TypeError):
        tags["c"] = 3
    p = lambda d, k=None: contracts.Period("s", d, partition_key=k)
    months = [p(date(2024, 1, 1)), p(date(2024, 1, 31)), p(date(2024, 3, 1))]
    assert partitions_of(months).cron == "0 0 1 * *"
    assert partitions_of([p(date(2024, 1, 1)), p(date(2024, 1, 3)), p(date(2024, 3, 1))]).keys == ["2024-01-01", "2024-01-03", "2024-03-01"]
    assert partitions_of([p(date(2024, 1, 1), "x")]).keys == ["x"] and period_of(months, "2024-01-31") is months[1]
    with pytest.raises(KeyError):
        period_of(months, "none")


@pytest.mark.parametrize(
    ("entry", "says"),
    [
        ({"sinks": [{"type": "table", "schema": "a", "table": "b", "mood": "append"}]}, "mood"),
        ({"sinks": [{"type": "table", "schema": "a", "table": "b", "mode": "replace"}]}, "mode must be one of"),
        ({"sinks": [{"type": "table", "schema": "a"}]}, "table is missing"),
        ({"sinks": [{"type": "queue"}]}, "type must be"),
        ({"sinks": ["gold.t"]}, "must be a mapping"),
        ({"sinks": [{"type": "table", "schema": "a", "table": "b", "detect_deletes": "yes"}]}, "true or false"),
        ({"sources": [{"type": "table", "schema": "a", "table": "b", "where": "x"}]}, "where"),
    ],
)
def test_entries_of_sources_and_sinks_are_strict(entry, says):
    with pytest.raises(ContractError, match=says):
        build_contract(data(**entry))
    assert build_contract(data(sources=[{"type": "external", "anything": 1}])).sources

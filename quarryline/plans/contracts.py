"""Declarative contracts: models, strict loading from YAML, hashes, and the checks they stand for."""

from __future__ import annotations

import dataclasses
import difflib
import enum
import hashlib
import json
import uuid
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path
from typing import Any

from pyspark.sql import types as T

from quarryline.operators.checks import COLUMN_RULES, TABLE_RULES, Result, Rule

LAYERS = ("bronze", "silver", "gold")
VERSIONS = ("1.0",)
SUFFIX = ".contract.yaml"
#: Spark types that satisfy a contract type. Doubles satisfy decimal.
TYPES: dict[str, tuple[type, ...]] = {
    "string": (T.StringType, T.CharType, T.VarcharType), "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "decimal": (T.FloatType, T.DoubleType, T.DecimalType), "boolean": (T.BooleanType,),
    "date": (T.DateType,), "datetime": (T.TimestampType, T.TimestampNTZType), "uuid": (T.StringType,), "json": (T.StringType,), "jsonb": (T.StringType,),
}
_KNOWN = {
    "contract": {"version", "pipeline_id", "asset", "layer", "schema", "description", "owner", "expectations", "upstream", "sla", "sources", "sinks", "testing", "lineage", "tags", "parameters", "data_source"},
    "schema": {"columns", "strict"}, "column": {"name", "type", "nullable", "description", "primary_key", "managed", "pii", "phi", "tests"}, "owner": {"team", "contact", "slack_channel"},
    "sla": {"freshness_hours", "update_frequency", "availability_percent"}, "lineage": {"enabled", "source_system", "transformation_type"}, "upstream": {"name", "type", "system", "description"},
    # fields of the entries of sources and sinks that are tables; external entries may hold any
    "source": {"type", "schema", "table", "database", "description"},
    "sink": {"type", "schema", "table", "database", "description", "mode", "primary_key", "partition_column", "business_key", "tracked_columns", "detect_deletes", "skip_unchanged", "sequence_column", "full_refresh_method"},
    "testing": {"enabled", "source_row_limit", "source_where_clause", "expected_min_rows", "expected_max_rows", "timeout_seconds"},
}
_REQUIRED = ("version", "pipeline_id", "asset", "layer", "schema")


class ContractError(ValueError):
    """A contract that can't be loaded, with every reason found."""

    def __init__(self, where: str, errors: list[str]):
        super().__init__(f"{where}: " + "; ".join(errors))
        self.errors = errors


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    description: str | None = None
    primary_key: bool = False
    managed: bool = False
    pii: bool = True
    phi: bool | None = None
    tests: tuple[Rule, ...] = ()

    @property
    def is_phi(self) -> bool:
        return self.pii if self.phi is None else self.phi


@dataclass(frozen=True)
class Period:
    source: str
    effective_from: date
    effective_to: date | None = None
    partition_key: str | None = None
    match: str = "one"


@dataclass(frozen=True)
class DataSource:
    source_id: str
    source_name: str
    periods: tuple[Period, ...] = ()
    description: str | None = None


@dataclass(frozen=True)
class Contract:
    version: str
    pipeline_id: str
    asset: str
    layer: str
    columns: tuple[Column, ...]
    strict: bool = True
    description: str | None = None
    owner: dict[str, Any] | None = None
    expectations: tuple[Rule, ...] = ()
    upstream: tuple[dict[str, Any], ...] = ()
    sla: dict[str, Any] | None = None
    sources: tuple[dict[str, Any], ...] = ()
    sinks: tuple[dict[str, Any], ...] = ()
    testing: dict[str, Any] | None = None
    lineage: dict[str, Any] | None = None
    tags: dict[str, str] = field(default_factory=dict)
    parameters: dict[str, Any] = field(default_factory=dict)

    @property
    def primary_key(self) -> list[str]:
        return [c.name for c in self.columns if c.primary_key]

    @property
    def pii_columns(self) -> list[str]:
        return [c.name for c in self.columns if c.pii]

    @property
    def phi_columns(self) -> list[str]:
        return [c.name for c in self.columns if c.is_phi]

    def rules(self) -> list[Rule]:
        return [dataclasses.replace(t, pii=c.pii) for c in self.columns for t in c.tests] + list(self.expectations)

    def parameter(self, key: str, *default: Any) -> Any:
        if key in self.parameters:
            return self.parameters[key]
        if default:
            return default[0]
        raise KeyError(f"{self.asset} has no parameter {key!r}; it has {sorted(self.parameters)}")

    def table_sinks(self) -> list[dict[str, Any]]:
        return [s for s in self.sinks if s.get("type") == "table"]


def _plain(x: Any) -> Any:
    if isinstance(x, enum.Enum):
        return x.value
    if isinstance(x, date | datetime):
        return x.isoformat()
    if isinstance(x, uuid.UUID | Decimal):
        return str(x)
    if isinstance(x, set | frozenset):
        return sorted(map(str, x))
    raise TypeError(f"{type(x).__name__} has no JSON form")


def contract_hash(c: Contract) -> str:
    return hashlib.sha256(json.dumps(dataclasses.asdict(c), sort_keys=True, default=_plain).encode()).hexdigest()


def schema_fingerprint(c: Contract) -> str:
    """Over name, type and flags of the columns, whatever their order."""
    rows = sorted(({"name": x.name, "type": x.type, "nullable": x.nullable, "pii": x.pii, "phi": x.is_phi, "primary_key": x.primary_key, "managed": x.managed} for x in c.columns), key=lambda r: r["name"])
    return hashlib.sha256(json.dumps(rows, sort_keys=True).encode()).hexdigest()


def classification(c: Contract) -> str:
    return "PHI" if any(x.is_phi and not x.managed for x in c.columns) else "none"


def check_schema(c: Contract, schema: T.StructType) -> Result:
    """Missing columns, types that don't fit and, if strict, columns that the contract doesn't name."""
    have = {f.name: f.dataType for f in schema}
    wrong = [f"missing {x.name}" for x in c.columns if x.name not in have and not x.managed]
    wrong += [f"{x.name} is {have[x.name].simpleString()}, not {x.type}" for x in c.columns if x.name in have and not isinstance(have[x.name], TYPES[x.type])]
    if c.strict:
        known = {x.name for x in c.columns}
        wrong += [f"unexpected {n}" for n in have if n not in known and not n.startswith("_")]
    return Result(Rule("schema"), not wrong, "schema: " + ("fits" if not wrong else "; ".join(wrong)), len(wrong), len(c.columns))


def _unknown(data: dict[str, Any], part: str, where: str) -> list[str]:
    out = []
    for k in data:
        if k not in _KNOWN[part]:
            near = difflib.get_close_matches(str(k), _KNOWN[part], 1)
            out.append(f"{where}: unknown key {k!r}" + (f", did you mean {near[0]!r}?" if near else ""))
    return out


def parse_test(test: str | dict[str, Any], column: str | None = None) -> Rule:
    """A name, {name: value}, or {name: {parameters}}, with severity and when beside the name."""
    if isinstance(test, str):
        return Rule(test, column)
    names = [k for k in test if k not in ("severity", "when")]
    if len(names) != 1:
        raise ValueError(f"a test names one rule, not {names}")
    value = test[names[0]]
    params = dict(value) if isinstance(value, dict) else {} if value is None else {"value": value}
    if misplaced := {"severity", "when"} & params.keys():
        raise ValueError(f"{', '.join(sorted(misplaced))} belongs beside {names[0]}, not inside it")
    return Rule(names[0], column, params, test.get("severity", "error"), test.get("when"))


def _test_errors(rule: Rule, where: str) -> list[str]:
    out = []
    if rule.column and rule.kind not in COLUMN_RULES:
        near = difflib.get_close_matches(rule.kind, COLUMN_RULES, 1)
        out.append(f"{where}: unknown test {rule.kind!r}" + (f", did you mean {near[0]!r}?" if near else ""))
    elif rule.column and rule.kind == "between":
        out += [f"{where}: between needs {k}" for k in ("min", "max") if k not in rule.params]
    elif rule.column and COLUMN_RULES[rule.kind] and not set(COLUMN_RULES[rule.kind]) & rule.params.keys():
        out.append(f"{where}: {rule.kind} needs {COLUMN_RULES[rule.kind][0]}")
    if rule.severity not in ("error", "warn"):
        out.append(f"{where}: severity must be error or warn, not {rule.severity!r}")
    if rule.when not in (None, "not_null"):
        out.append(f"{where}: when can only be not_null, not {rule.when!r}")
    return out


#: Fixed values of a sink's entry.
_SINK_VALUES = {"mode": ("full_refresh", "upsert", "append", "scd2"), "full_refresh_method": ("auto", "delete", "truncate")}


def _entry_errors(entry: Any, kind: str, where: str) -> list[str]:
    """What is wrong with one entry of sources or sinks."""
    if not isinstance(entry, dict):
        return [f"{where} must be a mapping"]
    if entry.get("type") not in ("table", "external"):
        return [f"{where}: type must be table or external, not {entry.get('type')!r}"]
    if entry["type"] == "external":
        return []
    out = _unknown(entry, kind, where) + [f"{where}: {n} is missing" for n in ("schema", "table") if not entry.get(n)]
    if kind == "sink":
        out += [f"{where}: {k} must be one of {values}, not {entry[k]!r}" for k, values in _SINK_VALUES.items() if entry.get(k) is not None and entry[k] not in values]
        out += [f"{where}: {k} must be true or false" for k in ("detect_deletes", "skip_unchanged") if not isinstance(entry.get(k, False), bool)]
    return out


def contract_errors(data: dict[str, Any]) -> list[str]:
    """Everything wrong with a contract's data."""
    errors = [f"{k} is missing" for k in _REQUIRED if k not in data] + _unknown(data, "contract", "contract")
    if "pipeline_id" in data:
        try:
            uuid.UUID(str(data["pipeline_id"]))
        except ValueError:
            errors.append(f"pipeline_id is no UUID: {data['pipeline_id']!r}")
    if data.get("version") is not None and data["version"] not in VERSIONS:
        errors.append(f"version {data['version']!r} is not supported; supported: {VERSIONS}")
    if data.get("layer") is not None and data["layer"] not in LAYERS:
        errors.append(f"layer must be one of {LAYERS}, not {data['layer']!r}")
    for part in ("owner", "sla", "lineage", "testing"):
        if data.get(part) is not None:
            errors += _unknown(data[part], part, part) if isinstance(data[part], dict) else [f"{part} must be a mapping"]
    if isinstance(data.get("owner"), dict) and "team" not in data["owner"]:
        errors.append("owner needs team")
    for k, v in (data.get("tags") or {}).items():
        if not isinstance(k, str) or not isinstance(v, str):
            errors.append(f"tag {k!r} must be text with a text value")
    for kind in ("source", "sink"):
        for k, entry in enumerate(data.get(f"{kind}s") or []):
            errors += _entry_errors(entry, kind, f"{kind} {k}")
    schema = data.get("schema")
    if schema is not None and not isinstance(schema, dict):
        return [*errors, "schema must be a mapping"]
    if schema is not None:
        errors += _unknown(schema, "schema", "schema")
        if not schema.get("columns") or not isinstance(schema["columns"], list):
            errors.append("schema needs a list of columns that is not empty")
        seen = set()
        for k, col in enumerate(schema.get("columns") or []):
            where = f"column {col.get('name', k) if isinstance(col, dict) else k}"
            if not isinstance(col, dict):
                errors.append(f"{where} must be a mapping")
                continue
            errors += _unknown(col, "column", where) + [f"{where}: {n} is missing" for n in ("name", "type", "nullable") if n not in col]
            if col.get("type") is not None and col["type"] not in TYPES:
                errors.append(f"{where}: type must be one of {sorted(TYPES)}, not {col['type']!r}")
            if col.get("name") in seen:
                errors.append(f"{where} comes twice")
            seen.add(col.get("name"))
            for t in col.get("tests") or []:
                try:
                    errors += _test_errors(parse_test(t, str(col.get("name"))), where)
                except ValueError as e:
                    errors.append(f"{where}: {e}")
    for k, t in enumerate(data.get("expectations") or []):
        try:
            rule = parse_test(t)
        except ValueError as e:
            errors.append(f"expectation {k}: {e}")
            continue
        if rule.kind not in TABLE_RULES:
            errors.append(f"expectation {k}: unknown {rule.kind!r}")
        need = {"freshness": ("column", "max_age_hours"), "null_percentage": ("column", "max_percent"), "unique_combination": ("columns",)}.get(rule.kind, ())
        errors += [f"expectation {k}: {rule.kind} needs {n}" for n in need if n not in rule.params] + _test_errors(rule, f"expectation {k}")
    return errors


def build_contract(data: dict[str, Any], where: str = "contract") -> Contract:
    if errors := contract_errors(data):
        raise ContractError(where, errors)
    columns = tuple(Column(**{k: v for k, v in c.items() if k != "tests"}, tests=tuple(parse_test(t, c["name"]) for t in c.get("tests") or [])) for c in data["schema"]["columns"])
    listed = lambda k: tuple(data.get(k) or ())
    return Contract(
        str(data["version"]), str(data["pipeline_id"]), data["asset"], data["layer"], columns, data["schema"].get("strict", True), data.get("description"), data.get("owner"), tuple(parse_test(t) for t in data.get("expectations") or []),
        listed("upstream"), data.get("sla"), listed("sources"), listed("sinks"), data.get("testing"), data.get("lineage"), dict(data.get("tags") or {}), dict(data.get("parameters") or {}),
    )


def load_contract(path: str | Path) -> Contract:
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, dict):
        raise ContractError(str(path), ["the file holds no mapping"])
    return build_contract(data, str(path))


class ContractIndex:
    """Contracts below some folders, found by asset name, then by schema/table of a sink, then by the last part of a
    name; what fits several is an error."""

    def __init__(self, folders: list[str | Path]):
        self.contracts = [load_contract(p) for f in folders for p in sorted(Path(f).rglob(f"*{SUFFIX}"))]

    def find(self, name: str, layer: str | None = None) -> Contract | None:
        of_layer = [c for c in self.contracts if layer in (None, c.layer)]
        last = name.replace(".", "/").rsplit("/", 1)[-1]
        for fits in (lambda c: c.asset == name, lambda c: any(f"{s.get('schema')}/{s.get('table')}" == name.replace(".", "/") for s in c.table_sinks()), lambda c: c.asset.rsplit("/", 1)[-1] == last):
            found = [c for c in of_layer if fits(c)]
            if len(found) > 1:
                raise ContractError(name, [f"{len(found)} contracts fit: {[f'{c.asset} ({c.layer})' for c in found]}"])
            if found:
                return found[0]
        return None


def contract_tags(contracts: list[Contract], namespace: str = "quarryline") -> dict[str, str]:
    """Tags of one contract, or of several in one: sets joined by comma, flags by or; the contracts' own tags must agree."""
    if not contracts:
        return {}
    joined = lambda values: ",".join(sorted(set(values)))
    tags = {"layer": joined(c.layer for c in contracts), "pipeline_id": joined(c.pipeline_id for c in contracts), "has_sla": str(any(c.sla is not None for c in contracts)).lower(), "has_pii": str(any(c.pii_columns for c in contracts)).lower()}
    if teams := [c.owner["team"] for c in contracts if c.owner]:
        tags["owner"] = joined(teams)
    if systems := [c.lineage["source_system"] for c in contracts if c.lineage and c.lineage.get("source_system")]:
        tags["source_system"] = joined(systems)
    out = {f"{namespace}/{k}": v for k, v in tags.items()}
    own: dict[str, str] = {}
    for c in contracts:
        for k, v in c.tags.items():
            if own.setdefault(k, v) != v:
                raise ContractError(c.asset, [f"tag {k!r} is {v!r} here and {own[k]!r} elsewhere"])
    return out | own


class RunTags(dict):
    """Tags of a run: text to text."""

    def __setitem__(self, k: str, v: str) -> None:
        if not isinstance(k, str) or not isinstance(v, str):
            raise TypeError("tags are text with text values")
        super().__setitem__(k, v)

    def add(self, *more: dict[str, str], **tags: str) -> RunTags:
        for m in (*more, tags):
            for k, v in m.items():
                self[k] = v
        return self


def code_hash(module_file: str | Path) -> str:
    """Twelve hex digits over a module and the contracts beside it."""
    path = Path(module_file)
    h = hashlib.sha256(path.read_bytes())
    for c in sorted(path.parent.glob(f"*{SUFFIX}")):
        h.update(c.read_bytes())
    return h.hexdigest()[:12]

"""Write configuration: how a contract's sink and a caller's arguments become one, and what may not be asked for."""

from __future__ import annotations

import dataclasses
import warnings
from dataclasses import dataclass
from typing import Any

from .contracts import Contract, ContractError

MODES = ("full_refresh", "upsert", "append", "scd2")
#: From the name of a sink's entry to that of the option it sets.
SINK_OPTIONS = {
    "mode": "mode", "primary_key": "primary_key", "business_key": "business_key", "tracked_columns": "tracked_columns", "detect_deletes": "detect_deletes", "skip_unchanged": "skip_unchanged",
    "full_refresh_method": "full_refresh_method", "partition_column": "partition_column", "sequence_column": "sequence_column",
}
_LISTS = ("primary_key", "business_key", "tracked_columns")


@dataclass(frozen=True)
class WriteConfig:
    mode: str = "full_refresh"
    primary_key: list[str] | None = None
    update_columns: list[str] | None = None
    skip_unchanged: bool = False
    business_key: list[str] | None = None
    tracked_columns: list[str] | None = None
    detect_deletes: bool = False
    partition_column: str | None = None
    sequence_column: str | None = "seq_id"
    full_refresh_method: str | None = None

    @staticmethod
    def of(**asked: Any) -> tuple[WriteConfig, set[str]]:
        """The configuration, and which options the caller named."""
        for k in _LISTS:
            if isinstance(asked.get(k), str):
                asked[k] = [asked[k]]
        return WriteConfig(**asked), set(asked)


def matching_sink(contract: Contract | None, schema: str | None, table: str) -> dict[str, Any] | None:
    """The sink of a table: same schema (or none named) and same table; else the only sink there is."""
    if contract is None:
        return None
    sinks = contract.table_sinks()
    fits = [s for s in sinks if schema is None or s.get("schema") in (None, schema)]
    named = [s for s in fits if s.get("table") == table]
    if len(named) > 1:
        raise ContractError(contract.asset, [f"several sinks are for table {table!r}"])
    if named:
        return named[0]
    if other := [s.get("schema") for s in sinks if s.get("table") == table]:
        warnings.warn(f"{contract.asset}: sinks for {table!r} are of schema {other}, the write goes to {schema!r}; none was applied", stacklevel=2)
        return None
    return fits[0] if len(fits) == 1 and len({s.get("table") for s in sinks}) == 1 else None


def reconcile(contract: Contract | None, config: WriteConfig, asked: set[str], schema: str | None, table: str) -> WriteConfig:
    """Each option: said by the contract only, it counts; by the caller only, that counts; by both alike, with a warning;
    by both and differently, it is an error. A primary key may also come from the contract's columns."""
    sink = matching_sink(contract, schema, table)
    said = {option: sink[name] for name, option in SINK_OPTIONS.items() if sink and name in sink and (sink[name] is not None or name == "sequence_column")}
    if contract and "primary_key" not in said and contract.primary_key:
        said["primary_key"] = contract.primary_key
    out: dict[str, Any] = {}
    for option, value in said.items():
        if option in _LISTS:
            value = [value] if isinstance(value, str) else [str(v) for v in value]
        if option == "mode" and value not in MODES:
            raise ContractError(contract.asset, [f"unknown write mode {value!r}; known: {MODES}"])
        own = getattr(config, option)
        if option not in asked:
            out[option] = value
        elif (sorted(own or []) == sorted(value)) if option in _LISTS else own == value:
            if value is not None:
                warnings.warn(f"{option} is {value!r} in both the call and the contract of {contract.asset}; one place is enough", stacklevel=2)
        else:
            raise ContractError(contract.asset, [f"{option} is {own!r} in the call and {value!r} in the contract"])
    return dataclasses.replace(config, **out)


def validate(config: WriteConfig, columns: list[str], bookkeeping: tuple[str, ...] = ("effective_from", "effective_to", "is_current")) -> None:
    """Options that the mode has no use for, and columns that aren't there."""
    if config.mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {config.mode!r}")
    if config.mode == "upsert" and not config.primary_key:
        raise ValueError("upsert needs primary_key")
    if config.mode == "scd2" and not config.business_key:
        raise ValueError("scd2 needs business_key")
    for option, mode in (("skip_unchanged", "upsert"), ("detect_deletes", "scd2"), ("full_refresh_method", "full_refresh")):
        if getattr(config, option) and config.mode != mode:
            raise ValueError(f"{option} is for {mode}, not {config.mode}")
    for option in ("primary_key", "update_columns", "business_key", "tracked_columns"):
        if gone := [c for c in getattr(config, option) or [] if c not in columns]:
            raise ValueError(f"{option}: {gone} not among {sorted(columns)}")
    if config.partition_column and config.partition_column not in columns:
        raise ValueError(f"partition_column {config.partition_column!r} not among {sorted(columns)}")
    if config.mode == "scd2" and (found := sorted(set(bookkeeping) & set(columns))):
        raise ValueError(f"bookkeeping columns {found} must not come with the rows")


def validate_partition_safety(config: WriteConfig, partitioned: bool) -> None:
    """A write for one partition must not reach into others."""
    if not partitioned:
        return
    if config.partition_column is None and config.mode in ("full_refresh", "scd2"):
        raise ValueError(f"a partitioned {config.mode} needs partition_column, or it would touch every partition")
    if config.mode == "upsert" and config.partition_column and config.partition_column not in (config.primary_key or []):
        raise ValueError("a partitioned upsert needs partition_column in its primary key")


def validate_columns(columns: list[str], target: list[str], managed: tuple[str, ...] = ()) -> None:
    """Rows must hold the target's columns but managed ones, and no others."""
    missing = [c for c in target if c not in columns and c not in managed]
    extra = [c for c in columns if c not in target]
    if missing or extra:
        raise ValueError(f"columns differ from the table's: missing {missing}, extra {extra}")

"""Checks of tables as they stand: found from contracts, run in few aggregates, current rows only where rows have versions;
and the drift of personal columns between contracts."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame

from quarryline.operators import checks
from quarryline.operators.scd import Scd2Columns

from .contracts import Contract, ContractIndex, check_schema


@dataclass(frozen=True)
class CheckSuite:
    """The checks of one contract against one table."""

    contract: Contract
    table: str
    current_column: str | None = None

    @staticmethod
    def of(contract: Contract, *, suffix: str = "", cols: Scd2Columns = Scd2Columns()) -> CheckSuite:
        """The table of the contract's first sink, else of its layer and asset; versioned sinks are held to current rows."""
        sink = next(iter(contract.table_sinks()), {})
        name = f"{sink.get('schema', contract.layer)}.{sink.get('table', contract.asset.rsplit('/', 1)[-1])}{suffix}"
        return CheckSuite(contract, name, cols.is_current if sink.get("mode") == "scd2" else None)

    def run(self, df: DataFrame, *, now: datetime, samples: bool = True) -> list[checks.Result]:
        """One result a rule, the schema first. Without the flag column of a versioned table every rule fails."""
        if self.current_column and self.current_column not in df.columns:
            return [checks.Result(r, False, f"{self.table} has no column {self.current_column} to tell current rows by", 1, 1) for r in self.contract.rules()]
        rows = checks.scoped(df, current=self.current_column)
        schema = dataclasses.replace(self.contract, strict=self.contract.strict and not self.current_column)
        rules = [r for r in self.contract.rules() if r.kind != "history_completeness"]
        return [check_schema(schema, df.schema), *checks.run_checks(rows, rules, now=now, samples=samples)]


def discover(folders: list[str | Path], *, suffix: str = "") -> list[CheckSuite]:
    """A suite for every contract below some folders that declares rules."""
    return [CheckSuite.of(c, suffix=suffix) for c in ContractIndex(folders).contracts if c.rules()]


def run_all(suites: list[CheckSuite], load: Callable[[str], DataFrame], *, now: datetime) -> dict[str, list[checks.Result]]:
    return {s.table: s.run(load(s.table), now=now) for s in suites}

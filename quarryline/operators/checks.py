"""Data checks: column rules and table expectations, fused into few aggregates.

A rule gives two counts, the rows it looks at and those that fail. All rules that are sums over rows share one aggregate;
uniqueness rules take one partial aggregate each over the distinct values of their columns; samples are read for failing
rules only. Null values pass every rule but not_null, as nulls are no values.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLES = 5
HIDDEN = "[REDACTED - column marked as PII]"
#: Rules on a column, with the parameter names that a single value may stand for.
COLUMN_RULES = {
    "not_null": (), "unique": (), "accepted_values": ("values", "value"), "not_in": ("values", "value"), "pattern": ("regex", "pattern", "value"), "greater_than": ("threshold", "value"),
    "greater_than_or_equal": ("threshold", "value"), "less_than": ("threshold", "value"), "less_than_or_equal": ("threshold", "value"), "between": ("min", "max"), "not_in_future": (),
    "within_days": ("days", "value"), "min_length": ("length", "value"), "max_length": ("length", "value"),
}
TABLE_RULES = ("row_count", "freshness", "null_percentage", "unique_combination", "history_completeness")


@dataclass(frozen=True)
class Rule:
    kind: str
    column: str | None = None
    params: dict[str, Any] = field(default_factory=dict)
    severity: str = "error"
    when: str | None = None
    pii: bool = False

    @property
    def name(self) -> str:
        return f"{self.column}__{self.kind}" if self.column else self.kind

    def param(self, *names: str) -> Any:
        for n in names or COLUMN_RULES.get(self.kind, ()):
            if n in self.params:
                return self.params[n]
        raise ValueError(f"{self.name} needs one of {names or COLUMN_RULES.get(self.kind)}")


@dataclass(frozen=True)
class Result:
    rule: Rule
    passed: bool
    message: str
    failed: int = 0
    total: int = 0
    samples: list[Any] = field(default_factory=list)


def _moment(now: datetime) -> Column:
    return F.lit(now).cast("timestamp")


def failing(rule: Rule, df: DataFrame, now: datetime) -> Column:
    """Whether a row breaks a row-wise rule; never null."""
    c, kind = F.col(f"`{rule.column}`"), df.schema[rule.column].dataType
    if rule.kind == "not_null":
        return F.lit(False) if rule.when == "not_null" else c.isNull()
    if rule.kind in ("accepted_values", "not_in"):
        values = rule.param()
        known = c.isin(*(values if isinstance(values, list | tuple | set) else [values]))
        bad = known if rule.kind == "not_in" else ~known
    elif rule.kind == "pattern":
        bad = ~c.cast("string").rlike(rule.param())
    elif rule.kind == "between":
        bad = ~c.between(rule.param("min"), rule.param("max"))
    elif rule.kind in ("min_length", "max_length"):
        size = F.char_length(c.cast("string"))
        bad = size < rule.param() if rule.kind == "min_length" else size > rule.param()
    elif rule.kind == "not_in_future":
        if not isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
            return F.lit(True)
        bad = c > (F.lit(now.date()) if isinstance(kind, T.DateType) else _moment(now))
    elif rule.kind == "within_days":
        if not isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
            return F.lit(True)
        end = F.lit(now.date()) if isinstance(kind, T.DateType) else _moment(now)
        start = F.date_sub(F.lit(now.date()), int(rule.param())) if isinstance(kind, T.DateType) else end - F.make_dt_interval(F.lit(int(rule.param())))
        bad = (c < start) | (c > end)
    else:
        limit = rule.param()
        bad = {"greater_than": c <= limit, "greater_than_or_equal": c < limit, "less_than": c >= limit, "less_than_or_equal": c > limit}[rule.kind]
    return F.coalesce(bad, F.lit(False))


def in_scope(rule: Rule) -> Column:
    return F.col(f"`{rule.column}`").isNotNull() if rule.when == "not_null" else F.lit(True)


def scoped(df: DataFrame, *, current: str | None = None, lineage_id: str | None = None) -> DataFrame:
    """Current versions only, or rows of one write only."""
    if current:
        if current not in df.columns:
            raise ValueError(f"the table has no column {current} to tell current rows by")
        df = df.where(F.col(current))
    return df.where(F.col("_lineage_id") == lineage_id) if lineage_id else df


def row_counts(df: DataFrame, rules: list[Rule], now: datetime) -> DataFrame:
    """One row: failed_k and total_k of each row-wise rule k, and `rows`."""
    out = [F.count("*").alias("rows")]
    for k, r in enumerate(rules):
        out += [F.count_if(in_scope(r) & failing(r, df, now)).alias(f"failed_{k}"), F.count_if(in_scope(r)).alias(f"total_{k}")]
    return df.agg(*out)


def unique_counts(df: DataFrame, columns: list[str], *, null_policy: str = "value", when: str | None = None) -> DataFrame:
    """failed (rows beyond the first of each value) and total. Nulls are one value, or, with null_policy "sql", each a
    failure. Values are counted before they are compared, so a hot value costs a row for each task."""
    for c in columns:
        df = df.where(F.col(f"`{c}`").isNotNull()) if when == "not_null" else df
    values = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count("*").alias("n"))
    null = F.lit(False)
    for c in columns:
        null = null | F.col(f"`{c}`").isNull()
    extra = F.when(null & F.lit(null_policy == "sql"), F.col("n")).otherwise(F.col("n") - 1)
    return values.agg(F.coalesce(F.sum(extra), F.lit(0)).alias("failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def null_percentage(df: DataFrame, column: str) -> DataFrame:
    share = F.when(F.count("*") > 0, F.count_if(F.col(f"`{column}`").isNull()) * 100.0 / F.count("*")).otherwise(0.0)
    return df.agg(F.count_if(F.col(f"`{column}`").isNull()).alias("failed"), F.count("*").alias("total"), share.alias("percent"))


def age_hours(df: DataFrame, column: str, now: datetime) -> DataFrame:
    latest = F.max(F.col(f"`{column}`").cast("timestamp"))
    return df.agg(((F.unix_micros(_moment(now)) - F.unix_micros(latest)) / 3.6e9).alias("age_hours"), F.count("*").alias("total"))


def missing_periods(df: DataFrame, column: str, expected: Iterable[date]) -> DataFrame:
    """Expected dates that no row starts on."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(d,) for d in expected], "expected date")
    return wanted.join(df.select(F.col(column).cast("date").alias("expected")).distinct(), "expected", "left_anti")


def redacted(message: str) -> str:
    """A message without the values it shows."""
    return re.sub(r"(Sample[^:]*: )\[.*\]", lambda m: m[1] + HIDDEN, message, flags=re.S)


def _sample(df: DataFrame, rule: Rule, now: datetime) -> list[Any]:
    if rule.kind == "unique" or rule.kind == "unique_combination":
        columns = [rule.column] if rule.column else list(rule.params["columns"])
        rows = df.groupBy(*columns).agg(F.count("*").alias("copies")).where("copies > 1").orderBy(F.desc("copies"), *columns).limit(SAMPLES).collect()
        return [r.asDict() for r in rows]
    rows = df.where(in_scope(rule) & failing(rule, df, now)).select(F.col(f"`{rule.column}`").alias("v")).limit(SAMPLES).collect()
    return [r["v"] for r in rows]


def run_checks(df: DataFrame, rules: list[Rule], *, now: datetime, periods: list[date] | None = None, effective_date: date | None = None, effective_from: str = "effective_from", null_policy: str = "value", staged_rows: int | None = None, samples: bool = True) -> list[Result]:
    """Results in the order of the rules. staged_rows stands in for the row count of a versioned write."""
    out: dict[int, Result] = {}
    rowwise: list[int] = []
    for k, r in enumerate(rules):
        columns = [r.column] if r.column else [*r.params.get("columns", [])] if r.kind == "unique_combination" else [r.params["column"]] if r.kind in ("freshness", "null_percentage") else []
        if gone := [c for c in columns if c not in df.columns]:
            out[k] = Result(r, False, f"column {', '.join(gone)} is not in the table", 1, 1)
        elif r.column and r.kind != "unique":
            if r.kind not in COLUMN_RULES:
                raise ValueError(f"unknown rule {r.kind!r}")
            rowwise.append(k)
    if rowwise:
        row = row_counts(df, [rules[k] for k in rowwise], now).first()
        for n, k in enumerate(rowwise):
            failed, total = row[f"failed_{n}"], row[f"total_{n}"]
            out[k] = Result(rules[k], failed == 0, f"{rules[k].name}: {failed} of {total} rows fail", failed, total)
    # rules of uniqueness group by different columns, but run as one job
    repeated = [k for k, r in enumerate(rules) if k not in out and r.kind in ("unique", "unique_combination")]
    counted = [unique_counts(df, [rules[k].column] if rules[k].column else list(rules[k].params["columns"]), null_policy=null_policy if rules[k].column else "value", when=rules[k].when).withColumn("k", F.lit(k)) for k in repeated]
    for failed, total, k in reduce(DataFrame.unionByName, counted).collect() if counted else ():
        out[k] = Result(rules[k], failed == 0, f"{rules[k].name}: {failed} repeated of {total} rows", failed, total)
    for k, r in enumerate(rules):
        if k in out:
            continue
        if r.kind == "row_count":
            n = staged_rows if staged_rows is not None else df.count()
            low, high = r.params.get("min"), r.params.get("max")
            good = (low is None or n >= low) and (high is None or n <= high)
            out[k] = Result(r, good, f"row_count {n} is {'within' if good else 'outside'} [{low}, {high}]", 0 if good else 1, n)
        elif r.kind == "null_percentage":
            failed, total, percent = null_percentage(df, r.params["column"]).first()
            out[k] = Result(r, percent <= r.params["max_percent"], f"{r.params['column']}: {percent:.2f} % null, at most {r.params['max_percent']} %", failed, total)
        elif r.kind == "freshness":
            age, total = age_hours(df, r.params["column"], now).first()
            good = age is not None and age <= r.params["max_age_hours"]
            out[k] = Result(r, good, f"{r.params['column']}: " + ("no value" if age is None else f"{age:.2f} hours old") + f", at most {r.params['max_age_hours']}", 0 if good else 1, total)
        elif r.kind == "history_completeness":
            wanted = list(periods or [])
            gone = sorted(x["expected"] for x in missing_periods(df, effective_from, wanted).collect()) if wanted else []
            final = effective_date is None or bool(wanted) and effective_date == wanted[-1]
            out[k] = Result(r, not gone or not final, f"history: {len(wanted) - len(gone)} of {len(wanted)} periods present; missing {[d.isoformat() for d in gone]}", len(gone), len(wanted))
        else:
            raise ValueError(f"unknown rule {r.kind!r}")
    if samples:
        for k, x in out.items():
            if not x.passed and x.rule.kind not in TABLE_RULES[:3] + TABLE_RULES[4:] and not x.message.startswith("column "):
                shown = _sample(df, x.rule, now)
                message = f"{x.message}. Sample values: {shown}"
                out[k] = Result(x.rule, False, redacted(message) if x.rule.pii else message, x.failed, x.total, [] if x.rule.pii else shown)
    return [out[k] for k in range(len(rules))]


@dataclass(frozen=True)
class Summary:
    status: str
    total: int
    passed: int
    failed: int
    warned: int
    violations: list[str]
    warnings: list[str]
    results: list[Result]


class ContractViolation(Exception):
    """Raised where a rule of severity error fails and the enforcement is error."""

    def __init__(self, summary: Summary):
        super().__init__("; ".join(summary.violations))
        self.summary = summary


def enforce(results: list[Result], mode: str = "error") -> Summary:
    """Weighs results by severity and enforcement: error raises, warn reports, silent only counts."""
    if mode not in ("error", "warn", "silent"):
        raise ValueError(f"enforcement must be error, warn or silent, not {mode!r}")
    bad = [r for r in results if not r.passed]
    errors = [r.message for r in bad if r.rule.severity == "error"]
    warnings = [r.message for r in bad if r.rule.severity != "error"]
    status = "failed" if errors else "warning" if warnings else "passed"
    summary = Summary(status, len(results), len(results) - len(bad), len(errors), len(warnings), errors, warnings, results)
    if errors and mode == "error":
        raise ContractViolation(summary)
    return summary

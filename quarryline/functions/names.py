"""File names and calendar boundaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sanitize_filename(c: Column | str) -> Column:
    """Percent-decoded, without separators, unsafe and control characters; runs of white space become one underscore; what
    is empty is null. Malformed escapes stay as they are, and plus signs too."""
    raw = _col(c).cast("string")
    safe = F.regexp_replace(F.replace(raw, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    kept = F.regexp_replace(F.try_url_decode(safe), r'[/\\:*?"<>|\x00-\x1F\x7F]', "")
    return F.nullif(F.regexp_replace(kept, r"(?U)\s+", "_"), F.lit(""))


def strip_extension(c: Column | str, extensions: list[str]) -> Column:
    """The first of the extensions that a name ends with, in any case, is taken off once."""
    name = _col(c)
    out = F.when(F.lit(False), name)
    for ext in extensions:
        out = out.when(F.lower(name).endswith(ext.lower()), F.substring(name, F.lit(1), F.length(name) - len(ext)))
    return out.otherwise(name)


def calendar_boundary(c: Column | str, cadence: str, anchor: str = "monday") -> Column:
    """The latest start of a week (on the anchor day), month or quarter up to a date."""
    day = _col(c).cast("date")
    if cadence == "weekly":
        return F.date_sub(day, F.pmod(F.weekday(day) - WEEKDAYS.index(anchor.lower()), F.lit(7)))
    if cadence in ("monthly", "quarterly"):
        return F.trunc(day, "month" if cadence == "monthly" else "quarter")
    raise ValueError(f"cadence must be weekly, monthly or quarterly, not {cadence!r}")

"""National drug codes in the 5-4-2 layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _padded(part: Column, width: int) -> Column:
    """Zeros in front up to a width; a longer part stays whole."""
    return F.when(F.length(part) >= width, part).otherwise(F.lpad(part, width, "0"))


def normalize_ndc(c: Column | str, *, force_package: bool = False, package_suffix: str = "00", with_hyphens: bool = True) -> Column:
    """With dashes: two parts give 5-4 (and the package if forced), three or more 5-4-2. Without: ten digits get one zero in
    front, fewer are filled up to eleven, more are cut to eleven; no digits give null. A whole double reads as a whole
    number."""
    c = F.col(c) if isinstance(c, str) else c
    number = c.try_cast("decimal(38,9)")
    raw = F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")
    # a whole number written as a double, such as 12345.0 or 1.2345E9
    raw = F.when(raw.rlike(r"^-?\d+\.\d+(E\d+)?$") & (F.typeof(c) == "double") & (number == F.floor(number)), F.floor(number).cast("decimal(38,0)").cast("string")).otherwise(raw)
    parts = F.filter(F.split(raw, "-"), lambda p: p != "")
    part = lambda k, width: _padded(F.get(parts, k), width)
    package = F.lit(package_suffix.zfill(2))
    product = F.concat_ws("-", part(0, 5), part(1, 4))
    digits = F.regexp_replace(raw, "[^0-9]", "")
    eleven = F.when(F.length(digits) == 10, F.concat(F.lit("0"), digits)).otherwise(F.substring(_padded(digits, 11), 1, 11))
    dashed = raw.contains("-")
    out = F.when(dashed & (F.size(parts) == 2), F.concat_ws("-", product, package) if force_package else product)
    out = out.when(dashed & (F.size(parts) >= 3), F.concat_ws("-", product, part(2, 2)))
    out = out.when(digits != "", F.concat_ws("-", F.substring(eleven, 1, 5), F.substring(eleven, 6, 4), F.substring(eleven, 10, 2)))
    return out if with_hyphens else F.replace(out, F.lit("-"), F.lit(""))

"""Safe casts of text. Every function cleans first: cast to string, white space off both ends, empty becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date formats without day/month ambiguity, tried in this order.
UNAMBIGUOUS_DATES = ("%Y-%m-%d", "%Y%m%d", "%d-%b-%y", "%d-%b-%Y", "%b %d, %Y", "%Y/%m/%d")
#: Words for true and for false.
TRUE_WORDS = ("t", "true", "1", "yes", "y")
FALSE_WORDS = ("f", "false", "0", "no", "n")

_DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "y": "yy", "b": "MMM", "B": "MMMM", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "j": "DDD", "p": "a", "I": "hh"}
#: What a directive accepts, to tell layouts apart before they are parsed.
_SHAPES = {"Y": r"\d{4}", "m": r"\d{2}", "d": r"\d{2}", "y": r"\d{2}", "b": "[A-Za-z]{3}", "B": "[A-Za-z]{3,9}", "H": r"\d{2}", "M": r"\d{2}", "S": r"\d{2}", "f": r"\d{6}", "j": r"\d{3}", "p": "[AaPp][Mm]", "I": r"\d{2}"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """White space of any kind off both ends; what is empty then is null."""
    return F.nullif(F.regexp_replace(_col(c).cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))


def safe_decimal(c: Column | str, mode: str = "fail") -> Column:
    """A double. Text that is no number fails the query, or is null in mode "null"."""
    return clean_text(c).try_cast("double") if mode == "null" else clean_text(c).cast("double")


def safe_int(c: Column | str, mode: str = "fail") -> Column:
    """A long. Text that is no whole number fails the query, or is null in mode "null"."""
    return clean_text(c).try_cast("long") if mode == "null" else clean_text(c).cast("long")


def safe_bool(c: Column | str) -> Column:
    """Words for true and false in any case; anything else is null."""
    word = F.lower(clean_text(c))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def _layout(fmt: str) -> tuple[str, str]:
    """A strptime format as (Java pattern, regular expression of its shape)."""
    pattern, shape, k = "", "", 0
    while k < len(fmt):
        if fmt[k] == "%":
            k += 1
            if fmt[k] not in _DIRECTIVES:
                raise ValueError(f"directive %{fmt[k]} of {fmt!r} is not supported")
            pattern += _DIRECTIVES[fmt[k]]
            shape += _SHAPES[fmt[k]]
        else:
            pattern += f"'{fmt[k]}'" if fmt[k].isalpha() else fmt[k]
            shape += "\\" + fmt[k] if not fmt[k].isalnum() and fmt[k] != " " else fmt[k]
        k += 1
    return pattern, f"^{shape}$"


def _parsed(text: Column, fmt: str, strict: bool) -> Column:
    pattern, shape = _layout(fmt)
    if "MMM" in pattern:  # Java reads month names in one case only
        text = F.initcap(text)
    day = F.to_date(text, pattern) if strict else F.to_date(F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern))))
    # two digits stand for 1969 to 2068
    return F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day) if "%y" in fmt else day


def safe_date(c: Column | str, *, format: str | None = None, formats: list[str] | None = None) -> Column:
    """A date. One format: what doesn't fit fails the query. Several: the first that fits, else null."""
    if format is not None and formats is not None:
        raise ValueError("give format or formats, not both")
    text = clean_text(c)
    if format is not None:
        return _parsed(text, format, strict=True)
    return F.coalesce(*[_parsed(text, f, strict=False) for f in formats or UNAMBIGUOUS_DATES])


def safe_datetime(c: Column | str, format: str = "%Y-%m-%dT%H:%M:%S", *, ntz: bool = False) -> Column:
    """A timestamp of one format; what doesn't fit fails the query."""
    pattern, _ = _layout(format)
    return F.to_timestamp_ntz(clean_text(c), F.lit(pattern)) if ntz else F.to_timestamp(clean_text(c), pattern)

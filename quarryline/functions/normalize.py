"""Names of companies and people in a comparable form."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Legal forms taken off the end of a name.
DEFAULT_SUFFIXES = (
    "LLC", "PLLC", "Inc", "Inc.", "Incorporated", "Corp", "Corp.", "Corporation", "Co", "Co.", "Company", "Ltd", "Ltd.", "Limited", "LP", "LLP", "LLLP", "PA", "P.A.", "P.A", "Pa", "Pa.",
    "PC", "P.C.", "P.C", "DBA", "D.B.A.", "D.B.A", "PLC", "GmbH", "AG", "S.A.", "SA", "S.A", "NV", "N.V.", "N.V", "Pty", "Pty Ltd", "Pty. Ltd.", "BV", "B.V.", "B.V",
)
#: Words taken off the front of a name, and symbols spelled out.
DEFAULT_PREFIXES = ("The",)
DEFAULT_SYMBOLS = {" & ": " and "}


def _quoted(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", s)


@F.pandas_udf(StringType())
def _ascii(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, then everything outside ASCII dropped; Spark has no function for it."""
    return s.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


@F.pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    """Case folding beyond lower case, as of the sharp s; Spark has no function for it."""
    return s.str.casefold()


@dataclass(frozen=True)
class TextNormalizer:
    """Steps in order: to ASCII, symbols, case, one prefix, one suffix, punctuation, white space; empty becomes null. Only
    texts that hold other characters than ASCII pass through Python."""

    ignore_case: bool = True
    strip_punctuation: bool = True
    normalize_whitespace: bool = True
    unicode_normalize: bool = True
    strip_suffixes: bool | tuple[str, ...] = False
    strip_prefixes: bool | tuple[str, ...] = False
    symbol_mappings: bool | dict[str, str] = False

    def _words(self, chosen: bool | tuple[str, ...], default: tuple[str, ...]) -> str:
        words = default if chosen is True else tuple(chosen or ())
        return "|".join(sorted({_quoted(w.casefold()) for w in words}, key=lambda w: (-len(w), w)))

    def column(self, c: Column | str) -> Column:
        c = (F.col(c) if isinstance(c, str) else c).cast("string")
        out = F.when(c.rlike(r"[^\x00-\x7F]"), _ascii(c)).otherwise(c) if self.unicode_normalize else c
        for old, new in (DEFAULT_SYMBOLS if self.symbol_mappings is True else self.symbol_mappings or {}).items():
            out = F.replace(out, F.lit(old), F.lit(new))
        if self.ignore_case:
            out = F.lower(out) if self.unicode_normalize else F.when(out.rlike(r"[^\x00-\x7F]"), _folded(out)).otherwise(F.lower(out))
        if prefixes := self._words(self.strip_prefixes, DEFAULT_PREFIXES):
            out = F.regexp_replace(out, rf"(?i)^(?:{prefixes})\s+", "")
        if suffixes := self._words(self.strip_suffixes, DEFAULT_SUFFIXES):
            out = F.regexp_replace(out, rf"(?i)(?:\s*,)?\s+(?:{suffixes})\.?\s*$", "")
        if self.strip_punctuation:
            out = F.regexp_replace(out, r"[^\w\s]" if self.unicode_normalize else r"(?U)[^\w\s]", "")
        if self.normalize_whitespace:
            out = F.trim(F.regexp_replace(out, r"\s+", " "))
        return F.when(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")) == "", None).when(F.trim(F.regexp_replace(out, r"\s+", " ")) != "", out)

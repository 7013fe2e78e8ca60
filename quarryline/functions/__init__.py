"""Column functions: cleaning, parsing, normalising and hashing, all as native Spark expressions."""

from .codes import normalize_ndc
from .hashing import canonical_text, row_hash
from .names import calendar_boundary, sanitize_filename, strip_extension
from .normalize import DEFAULT_PREFIXES, DEFAULT_SUFFIXES, DEFAULT_SYMBOLS, TextNormalizer
from .text import clean_text, safe_bool, safe_date, safe_datetime, safe_decimal, safe_int

__all__ = ["DEFAULT_PREFIXES", "DEFAULT_SUFFIXES", "DEFAULT_SYMBOLS", "TextNormalizer", "calendar_boundary", "canonical_text", "clean_text", "normalize_ndc", "row_hash", "safe_bool", "safe_date", "safe_datetime", "safe_decimal", "safe_int", "sanitize_filename", "strip_extension"]

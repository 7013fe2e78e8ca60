"""Personal data: patterns propose spans, checksums confirm them, and words nearby move the score.

Emails, addresses of four numbers, payment cards and international phone numbers are the base kinds: a match that passes
its check (numbers to 255, Luhn, number of digits) is always reported. The further kinds (iban, national phone and
social security numbers) are reported when their score, raised by a checksum (mod 97) or by a word nearby that names
the kind, reaches the threshold, and when they overlap no other span.

Every scan is linear in the text: an email is grown leftward from its @, a dotted chain of numbers is cut into fours.
Defined results: null and empty texts have no spans; offsets are code points, the end exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, trimmed

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "phone_national", "ssn")
THRESHOLD = 0.7
NEARBY = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: Score before the context, words that raise it, and by how much.
CONTEXT = {
    "email": (0.9, re.compile(r"\b(?:e-?mail|contact|correo|courriel)\b", re.I), 0.1),
    "ip": (0.6, re.compile(r"\b(?:ip|host|server|address|adresse)\b", re.I), 0.3),
    "card": (0.8, re.compile(r"\b(?:card|visa|credit|carte|karte|tarjeta)\b", re.I), 0.2),
    "phone": (0.8, re.compile(r"\b(?:tel|phone|call|mobile|telefon|fax)\b", re.I), 0.2),
    "iban": (0.8, re.compile(r"\b(?:iban|account|konto|compte|cuenta|bank)\b", re.I), 0.2),
    "phone_national": (0.5, re.compile(r"\b(?:tel|phone|call|mobile|telefon|fax)\b", re.I), 0.3),
    "ssn": (0.5, re.compile(r"\b(?:ssn|social security)\b", re.I), 0.4),
}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d <<= k & 1
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _CHAIN.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k : k + 4])) + 3
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in parts[k : k + 4]):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base kinds in the order listed, each by start."""
    out = [("email", s, e) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", s, e) for s, e in _addresses(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _scored(text: str, kind: str, start: int, end: int) -> float:
    score, words, more = CONTEXT[kind]
    return min(1.0, score + more) if words.search(text, max(0, start - NEARBY), min(len(text), end + NEARBY)) else score


def find_spans(text: str | None, threshold: float = THRESHOLD) -> tuple[list[Span], list[Span]]:
    """Base spans and further spans of one text."""
    text = text or ""
    base = [Span(k, s, e, _scored(text, k, s, e)) for k, s, e in base_spans(text)]
    more: list[Span] = []
    if _DIGIT.search(text):
        taken = _merged([(x.start, x.end) for x in base])
        for kind, pattern in zip(MORE_KINDS, (_IBAN, _NATIONAL, _SSN), strict=True):
            for m in pattern.finditer(text):
                s, e = m.span()
                if kind == "iban" and not (15 <= len(m[0].replace(" ", "")) <= 34 and mod97(m[0].replace(" ", ""))):
                    continue
                score = _scored(text, kind, s, e)
                at = bisect_left(taken, (e, 0))  # the first span that starts at the end or behind it
                if score >= threshold and not (at and taken[at - 1][1] > s):
                    more.append(Span(kind, s, e, score))
            # matches of one pattern don't overlap, so they are looked up by the patterns after it only
            taken = _merged([*taken, *((x.start, x.end) for x in more if x.kind == kind)])
    return base, more


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def redact_text(text: str, spans: list[Span]) -> str:
    """Every span replaced by its kind in brackets; overlapping spans count as one, under the first one's kind."""
    out, done = [], 0
    for x in sorted(spans, key=lambda x: (x.start, -x.end)):
        if x.start >= done:
            out += [text[done : x.start], f"[{x.kind.upper()}]"]
        done = max(done, x.end)
    return "".join([*out, text[done:]])


def find_pii(documents: DataFrame, *, id_col="doc_id", text_col="text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: id, base and more as array<struct<kind,start,end,score>>."""
    small_batches(documents.sparkSession)
    id_type = documents.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    @trimmed
    def scan(batches):
        for batch in batches:
            both = [find_spans(t.as_py(), threshold) for t in batch.column(1)]
            arrays = [pa.array([[x._asdict() for x in spans[k]] for spans in both], pa.list_(span)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", "base", "more"])

    kind = "array<struct<kind:string,start:long,end:long,score:double>>"
    return documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(scan, f"id {id_type}, base {kind}, more {kind}").withColumnRenamed("id", id_col)


def redact(documents: DataFrame, *, text_col="text", threshold: float = THRESHOLD) -> DataFrame:
    """documents with every span of personal data in the text replaced by its kind; null texts stay null."""
    small_batches(documents.sparkSession)
    at = documents.columns.index(text_col)

    @trimmed
    def scan(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            clean = [t if not t or not (spans := [x for part in find_spans(t, threshold) for x in part]) else redact_text(t, spans) for t in texts]
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(clean, batch.schema.field(at).type))

    return documents.mapInArrow(scan, documents.schema)


def report(documents: DataFrame) -> DataFrame:
    """The registered query's columns."""
    found = find_pii(documents)
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.size(F.expr(f"filter(base, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed(F.concat("base", "more")).alias("spans"))

"""Language-model scores from a log-frequency Bloom filter.

Unigram and bigram counts are gathered over all training documents as packed, pre-aggregated blocks of word hashes. A
count c is quantised to the level 1 + floor(log c / log STEP), and every level from 1 up to it is put into the filter under
the n-gram's hash, of bigrams seen once too. A count is read back by probing level after level until one
is missing. The model interpolates: p(w | v) = MIX * count(vw) / count(v) + (1 - MIX) * (count(w) + 1) / (N + V + 1).

Every bucket's field has PROBES / ln 2 bits a key, whatever the input's size, so it is about half full. Fields are shipped
in ranges of buckets of at most FILTER_MB each; a task holds one range at a time and looks up GROUP parts of text in all of
them, so that scores don't depend on how many ranges there are. Base scores need exact counts: the HEAD most frequent words
are shipped with theirs, and the other words of a document meet their counts through an exchange by hash.

Words are known by 64-bit hashes. Defined results: null and empty texts are one end token; a null doc_id counts as the
empty text and so belongs to training; rows that share doc_id and text are scored alike, each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, binary_parts, bucket_of, buckets_for, by_bucket, checkpointed, dealt, joined, mix, opened, prefix_hash, span_hash, text_bytes, trimmed, word_spans

FOLDS, HELD = 7, 2
#: Weight of the bigram part. Held-out texts gain up to 0.35, but chance hits of the filter weigh more as it grows.
MIX = 0.2
STEP = 1.5
PROBES = 7
#: Bits of a field for each of its keys.
PER_KEY = PROBES / np.log(2)
FILTER_MB = 64
#: Parts of text that are looked up together where the filter has several ranges.
GROUP = 8
HEAD = 1 << 19
PART = 2 << 20
#: Tokens whose n-grams are counted together before they are packed.
TOGETHER = 2_500_000
NO_ID = -(1 << 63)
END = np.uint64(0x5851F42D4C957F2D)
_CONTEXT = np.uint64(0xC2B2AE3D27D4EB4F)
_EDGES = np.array([STEP**k for k in range(1, 110)])
#: The mean whole number of each level; level 0 is an unseen n-gram.
_MEANS = np.array([0.0, *[max(np.ceil(STEP**k), (np.ceil(STEP**k) + np.ceil(STEP ** (k + 1)) - 1) / 2) for k in range(0, 110)]])


def level(c: np.ndarray) -> np.ndarray:
    return np.searchsorted(_EDGES, c, "right") + 1


def tokens(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, an end token after each text, and the first token of each text and the end."""
    low = LOWER[buf]
    start, end = word_spans(low, bounds, NOT_SPACE)
    of = np.searchsorted(start, bounds)
    n = len(bounds) - 1
    out = np.full(len(start) + n, END, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(of))
    out[np.arange(len(start)) + doc] = span_hash(prefix_hash(low), start, end)
    return out, of + np.arange(n + 1)


def bigrams(t: np.ndarray) -> np.ndarray:
    """Hashes of each token with the one before it; every text begins behind an end token."""
    before = np.empty_like(t)
    before[0], before[1:] = END, t[:-1]
    return mix(before * _CONTEXT + t)


def _counts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(h, return_counts=True)


def _packed(order: int, h: np.ndarray, c: np.ndarray, n: int) -> Iterator[dict]:
    """h is sorted, so its buckets are ranges."""
    at = np.searchsorted(bucket_of(h, n), np.arange(n + 1))
    for b in np.flatnonzero(np.diff(at)):
        k = slice(at[b], at[b + 1])
        yield {"bucket": int(b), "kind": order, "h": h[k].tobytes(), "c": c[k].astype(np.uint32).tobytes() if int(c[k].max()) > 1 else b""}


_BLOCK = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("h", pa.binary()), ("c", pa.binary())])


def _read(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    h = joined([r["h"] for r in rows], np.uint64)
    c = np.concatenate([np.frombuffer(r["c"], np.uint32).astype(np.int64) if r["c"] else np.ones(len(r["h"]) // 8, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    return h, c


def gather(training: DataFrame, text_col: str, n: int) -> DataFrame:
    """Blocks (bucket, kind 1 or 2, h, c, types, total, bits) of all n-grams: exact counts of words only, and the bit field
    of the bucket."""

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: np.ndarray) -> Iterator[pa.RecordBatch]:
            for order in (1, 2):
                yield pa.RecordBatch.from_pylist(list(_packed(order, *_counts(t if order == 1 else bigrams(t)), n)), _BLOCK)

        held: list[np.ndarray] = []
        for batch in batches:
            for _, _, buf, bounds in binary_parts(batch.column(0), PART):
                held.append(tokens(buf, bounds)[0])
                if sum(map(len, held)) >= TOGETHER:
                    yield from out(np.concatenate(held))
                    held.clear()
        if held:
            yield from out(np.concatenate(held))

    @trimmed
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = by_bucket(batches)
        out = []
        for order in (1, 2):
            h, c = _read([r for r in rows if r["kind"] == order])
            if not len(h):
                continue
            by = np.argsort(h, kind="stable")
            h, c = h[by], c[by]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            h, c = h[first], np.add.reduceat(c, first)
            types, total = len(h), int(c.sum())
            bits = Filter.field(h, c, field_bits(c)).tobytes()
            if order == 2:
                h, c = h[:0], c[:0]
            out.append({"bucket": rows[0]["bucket"], "kind": order, "h": h.tobytes(), "c": c.tobytes(), "types": types, "total": total, "bits": bits})
        yield pa.RecordBatch.from_pylist(out, pa.schema([*_BLOCK, ("types", pa.int64()), ("total", pa.int64()), ("bits", pa.binary())]))

    blocks = training.select(text_bytes(text_col).alias("t")).mapInArrow(count, "bucket int, kind int, h binary, c binary")
    return dealt(blocks, n).mapInArrow(merge, "bucket int, kind int, h binary, c binary, types long, total long, bits binary")


def field_bits(c: np.ndarray) -> int:
    """Size of the field that holds n-grams of these counts."""
    return max(64, int(np.ceil(int(level(c).sum()) * PER_KEY / 64)) * 64)


class Filter:
    """One bit field a bucket; an n-gram's bits lie in its bucket's field."""

    def __init__(self, fields: dict[int, np.ndarray], n: int):
        self.n = n
        size = np.array([8 * len(fields[b]) if b in fields else 0 for b in range(n)], np.int64)
        self.size = size.astype(np.uint64)
        self.first = (np.cumsum(size) - size).astype(np.uint64)
        self.bits = np.concatenate([fields[b] for b in sorted(fields)]) if fields else np.zeros(0, np.uint8)

    @staticmethod
    def lead(h: np.ndarray, lev: int) -> np.ndarray:
        return mix(h + np.uint64(lev * 0x9E3779B97F4A7C15 % (1 << 64)))

    @staticmethod
    def step(a: np.ndarray) -> np.ndarray:
        """Distance of the further probes from the first one."""
        return mix(a ^ np.uint64(0x94D049BB133111EB)) | np.uint64(1)

    @staticmethod
    def place(a: np.ndarray, size: np.ndarray | np.uint64) -> np.ndarray:
        """A bit of a field from the high half of a hash; fields have fewer than 2^32 bits."""
        return (a >> np.uint64(32)) * size >> np.uint64(32)

    @staticmethod
    def field(h: np.ndarray, c: np.ndarray, bits: int) -> np.ndarray:
        out = np.zeros(bits, bool)
        lev = level(c)
        for k in range(1, int(lev.max(initial=0)) + 1):
            a = Filter.lead(h[lev >= k], k)
            b = Filter.step(a)
            for _ in range(PROBES):
                out[Filter.place(a, np.uint64(bits)).astype(np.int64)] = True
                a = a + b
        return np.packbits(out, bitorder="little")

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Of distinct n-grams: probe level after level until one is missing."""
        out = np.zeros(len(h), np.int64)
        bucket = bucket_of(h, self.n)
        size, first = self.size[bucket], self.first[bucket]
        left, k = np.flatnonzero(size), 1
        while len(left) and k < len(_MEANS):
            # most n-grams end at the first probe of a level, so the further ones are worked out for the rest only
            a = self.lead(h[left], k)
            hit = self.test(first[left] + self.place(a, size[left]))
            left, a = left[hit], a[hit]
            b = self.step(a)
            for _ in range(PROBES - 1):
                a = a + b
                hit = self.test(first[left] + self.place(a, size[left]))
                if not hit.all():
                    left, a, b = left[hit], a[hit], b[hit]
            out[left] = k
            k += 1
        return out

    def test(self, at: np.ndarray) -> np.ndarray:
        return self.bits[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) == 1


def ship_fields(blocks: DataFrame, n: int, filter_mb: float) -> list:
    """Broadcasts of the filters of words and bigrams, one for each range of buckets; the driver holds one range at a time."""
    sizes = blocks.groupBy("bucket").agg(F.sum(F.length("bits")).alias("size")).orderBy("bucket").collect()
    ranges: list[list[int]] = []
    held = 0
    for r in sizes:
        if not ranges or held + r["size"] > filter_mb * 1e6:
            ranges.append([r["bucket"], r["bucket"]])
            held = 0
        ranges[-1][1] = r["bucket"]
        held += r["size"]
    out = []
    for low, high in ranges:
        rows = blocks.where(F.col("bucket").between(low, high)).select("bucket", "kind", "bits").toArrow()
        fields = [{b.as_py(): np.frombuffer(x.as_buffer(), np.uint8) for b, k, x in zip(rows["bucket"], rows["kind"], rows["bits"], strict=True) if k.as_py() == order} for order in (1, 2)]
        out.append(blocks.sparkSession.sparkContext.broadcast(tuple(Filter(f, n) for f in fields)))
    return out


class Part:
    """The tokens of a part of text, its distinct words and bigrams, and their levels as far as they were looked up."""

    def __init__(self, low: int, high: int, t: np.ndarray, of: np.ndarray):
        self.low, self.high, self.t, self.of = low, high, t, of
        self.words, self.word = np.unique(t, return_inverse=True)
        self.pairs, self.pair = np.unique(bigrams(t), return_inverse=True)
        self.one, self.two = np.zeros(len(self.words), np.int64), np.zeros(len(self.pairs), np.int64)

    def look_up(self, one: Filter, two: Filter) -> None:
        """A filter answers 0 for n-grams of buckets that it does not hold."""
        self.one += one.levels(self.words)
        self.two += two.levels(self.pairs)

    def log10(self, total: int, types: int, mix_weight: float) -> np.ndarray:
        """Log-probability of each token behind the one before it; the first one follows an end token, as the last one is."""
        own = _MEANS[self.one][self.word]
        context = np.roll(own, 1)
        pair = np.minimum(_MEANS[self.two][self.pair], context)
        lower = (own + 1) / (total + types + 1)
        return np.log10(np.where(context > 0, mix_weight * pair / np.maximum(context, 1) + (1 - mix_weight) * lower, lower))


def held_out(id_col="doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD


def score(documents: DataFrame, *, id_col="doc_id", text_col="text", mix_weight: float = MIX, filter_mb: float = FILTER_MB, head: int = HEAD) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark, n = documents.sparkSession, buckets_for(documents)
    blocks = checkpointed(gather(documents.where(~held_out(id_col)), text_col, n))
    sums = {r["kind"]: r for r in blocks.groupBy("kind").agg(F.sum("types").alias("types"), F.sum("total").alias("total")).collect()}
    total, types = (int(sums[1][k]) if 1 in sums else 0 for k in ("total", "types"))
    ranges = ship_fields(blocks, n, filter_mb)
    shipped = spark.sparkContext.broadcast(_head(blocks, head))
    scale = float(np.log10(total + types + 1))
    entry = np.dtype([("h", "<u8"), ("id", "<i8"), ("row", "<i8"), ("tf", "<u4")])

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_h, head_c = shipped.value
        schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary()), ("id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64())])

        def finish(held: list[tuple[np.ndarray, np.ndarray, Part]]) -> Iterator[pa.RecordBatch]:
            for r in ranges:
                filters = opened(r, len(ranges) == 1)
                for _, _, part in held:
                    part.look_up(*filters)
            for ids, row, part in held:
                m, of = part.high - part.low, part.of
                doc = np.repeat(np.arange(m), np.diff(of))
                u, back = part.words, part.word
                model_log = np.add.reduceat(part.log10(total, types, mix_weight), of[:-1])
                k = np.minimum(np.searchsorted(head_h, u), max(0, len(head_h) - 1))
                in_head = head_h[k] == u if len(head_h) else np.zeros(len(u), bool)
                c = np.where(in_head, head_c[k] if len(head_h) else 0, 0)
                head_token = in_head[back]
                logs = np.bincount(doc, weights=np.where(head_token, np.log10(c + 1.0)[back], 0.0), minlength=m)
                known = np.bincount(doc, weights=head_token & (c[back] > 0), minlength=m).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket_of(mix(row.view(np.uint64) + ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), n), pa.int32()), pa.array(np.full(m, 2), pa.int32()), pa.nulls(m, pa.binary()), pa.array(ids), pa.array(row), pa.array(np.diff(of)), pa.array(known), pa.array(logs), pa.array(model_log)], schema=schema)
                rest = np.flatnonzero(~head_token)
                key, tf = np.unique(back[rest] * np.int64(m) + doc[rest], return_counts=True)
                ask = np.empty(len(key), entry)
                ask["h"], ask["tf"] = u[key // m], tf
                ask["id"], ask["row"] = ids[key % m], row[key % m]
                at = np.searchsorted(bucket_of(ask["h"], n), np.arange(n + 1))
                full = np.flatnonzero(np.diff(at))
                blobs = [ask[at[b] : at[b + 1]] for b in full]
                blobs = [x[np.argsort(x["row"], kind="stable")].tobytes() for x in blobs]
                none = len(full)
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(none, 1), pa.int32()), pa.array(blobs, pa.binary()), *[pa.nulls(none, f.type) for f in list(schema)[3:]]], schema=schema)

        held = []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for low, high, buf, bounds in binary_parts(batch.column(1), PART):
                row = span_hash(prefix_hash(buf), bounds[:-1], bounds[1:]).view(np.int64)
                held.append((ids[low:high], row, Part(low, high, *tokens(buf, bounds))))
                if len(held) >= (GROUP if len(ranges) > 1 else 1):
                    yield from finish(held)
                    held.clear()
        yield from finish(held)

    fields_out = "id long, row long, n long, known long, logs double, score double"

    @trimmed
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c, bucket = np.zeros(0, np.uint64), np.zeros(0, np.int64), None
        names = ["id", "row", "n", "known", "logs", "score"]
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            docs = batch.filter(pa.array(kinds == 2))
            if docs.num_rows:
                yield pa.RecordBatch.from_arrays([docs.column(k) for k in range(3, 9)], names=names)
            asked: list[np.ndarray] = []
            sums = []
            for b, kind, blob in zip(batch.column(0).to_pylist(), kinds.tolist(), batch.column(2), strict=True):
                if kind == 0:
                    rec = np.frombuffer(blob.as_py(), np.dtype([("h", "<u8"), ("c", "<i8")]))
                    h, c, bucket = rec["h"], rec["c"], b
                elif kind == 1:
                    x = np.frombuffer(blob.as_py(), entry)
                    if b == bucket and len(h):
                        k = np.minimum(np.searchsorted(h, x["h"]), len(h) - 1)
                        got = np.where(h[k] == x["h"], c[k], 0)
                    else:
                        got = np.zeros(len(x), np.int64)
                    asked.append(x)
                    sums.append(got)
            if asked:
                x, got = np.concatenate(asked), np.concatenate(sums)
                order = np.lexsort((x["row"], x["id"]))
                x, got = x[order], got[order]
                first = np.flatnonzero(np.concatenate([[True], (x["row"][1:] != x["row"][:-1]) | (x["id"][1:] != x["id"][:-1])]))
                known = np.add.reduceat(np.where(got > 0, x["tf"], 0).astype(np.int64), first)
                logs = np.add.reduceat(x["tf"] * np.log10(got + 1.0), first)
                some = len(first)
                yield pa.RecordBatch.from_arrays([pa.array(x["id"][first]), pa.array(x["row"][first]), pa.nulls(some, pa.int64()), pa.array(known), pa.array(logs), pa.nulls(some, pa.float64())], names=names)

    asked = documents.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text_bytes(text_col).alias("t")).mapInArrow(scan, "bucket int, kind int, blob binary, " + fields_out)
    tail = blocks.where("kind = 1").select("bucket", "h", "c").mapInArrow(_tail_counts, "bucket int, blob binary")
    tail = tail.select("bucket", F.lit(0).alias("kind"), "blob", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in fields_out.split(", "))])
    parts = dealt(asked.unionByName(tail), n, ordered=True).mapInArrow(answer, fields_out)
    summed = parts.groupBy("id", "row").agg(F.sum("n").alias("n_all"), F.count("n").alias("rows"), F.sum("known").alias("known_all"), F.sum("logs").alias("logs_all"), F.max("score").alias("score"))
    each = summed.where("rows > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    id_known = documents.select(id_col).schema[0].dataType.simpleString()
    each = each.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id")))
    return each.select(F.col("id").cast(id_known).alias(id_col), held_out("id").alias("held_out"), (F.col("n_all") / F.col("rows")).cast("long").alias("n_tokens"), (F.col("known_all") / F.col("rows")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("logs_all") / F.col("rows") - F.col("n_all") / F.col("rows") * scale).alias("base_score"), "score")


def _tail_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = np.dtype([("h", "<u8"), ("c", "<i8")])
    for batch in batches:
        for row in batch.to_pylist():
            rec = np.empty(len(row["h"]) // 8, kind)
            rec["h"], rec["c"] = np.frombuffer(row["h"], np.uint64), np.frombuffer(row["c"], np.int64)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([row["bucket"]], pa.int32()), "blob": pa.array([rec.tobytes()], pa.binary())})


def _head(blocks: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact counts of words that occur often enough for at most `head` of them to do so."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                v, n = np.unique(np.minimum(np.frombuffer(row["c"], np.int64), 100_000), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(n)], names=["c", "n"])

    ones = blocks.where("kind = 1").select("h", "c")
    seen = sorted((r["c"], r["n"]) for r in ones.mapInArrow(histogram, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect())
    least, left = 1 << 62, head
    for c, n in reversed(seen):
        if n > left:
            break
        least, left = c, left - n

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, c = np.frombuffer(row["h"], np.uint64), np.frombuffer(row["c"], np.int64)
                yield pa.RecordBatch.from_pydict({"h": pa.array([h[c >= least].tobytes()], pa.binary()), "c": pa.array([c[c >= least].tobytes()], pa.binary())})

    rows = ones.mapInArrow(pick, "h binary, c binary").toArrow()
    h, c = joined(rows["h"].to_pylist(), np.uint64), joined(rows["c"].to_pylist(), np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def report(documents: DataFrame) -> DataFrame:
    """The registered query's columns."""
    return score(documents)

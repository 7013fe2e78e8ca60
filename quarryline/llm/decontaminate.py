"""Benchmark decontamination with an FM-index per shard of the training texts.

The words of the benchmark are the index's alphabet. A shard (a few megabytes of documents) is written as a sequence of
word numbers; words outside the alphabet and ends of documents are separators, and a stretch between two separators
that is shorter than the shortest phrase is left out, for no phrase fits in it. The suffix array of what is left (prefix
doubling) gives the Burrows-Wheeler transform, held in a wavelet matrix. Every phrase is searched backward, one rank
pair a word for all phrases at once, and its occurrences are located from suffix positions sampled every SAMPLE words.

Defined results: null or empty texts have no words and no hits; an item without words is no phrase; repeated items or
windows count once for an item_id; a null item_id reads as an empty id; repeated documents are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, binary_parts, checkpointed, drop, opened, prefix_hash, span_hash, text_bytes, trimmed, word_spans

WINDOW = 8
SAMPLE = 8
SHARD_BYTES = 2 << 20
#: Phrases are shipped to the workers in blocks of about this many bytes of benchmark text. The driver builds one block at a
#: time, and a worker holds one at a time, by which it searches GROUP shards.
BLOCK_BYTES, GROUP = 8 << 20, 8


class Phrases:
    """The windows of a block of items, as rows of word numbers from 2; 1 separates and 0 ends a shard's text."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        texts = [t for _, t in items]
        buf = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        start, end = word_spans(buf, bounds, ALNUM)
        hashes = span_hash(prefix_hash(buf), start, end)
        self.words, number = np.unique(hashes, return_inverse=True)
        number = number.astype(np.int64) + 2
        of = np.searchsorted(start, bounds)
        self.names = sorted({n for n, _ in items})
        at = {n: k for k, n in enumerate(self.names)}
        size = np.diff(of)
        windows = np.where(size > 0, np.maximum(size - window, 0) + 1, 0)
        item = np.repeat(np.arange(len(items)), windows)
        first = np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows) + of[item]
        # shorter items are filled up with zeros, which are no word
        place = first[:, None] + np.arange(window)
        rows = np.where(place < of[item + 1][:, None], np.concatenate([number, [0]])[np.minimum(place, len(number))], 0).astype(np.int32)
        self.rows, row = np.unique(rows, axis=0, return_inverse=True)
        self.length = np.count_nonzero(self.rows, axis=1)
        pairs = np.unique(row.ravel() * max(1, len(self.names)) + np.array([at[n] for n, _ in items], np.int64)[item])
        self.items = pairs % max(1, len(self.names))
        self.item_bounds = np.searchsorted(pairs // max(1, len(self.names)), np.arange(len(self.rows) + 1))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of hashes, 0 for words outside the alphabet."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        k = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[k] == hashes, k + 2, 0)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling: sort the pairs of ranks at growing offsets until every rank is unique."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step if step < n else 0] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[0] = 0
        np.cumsum(key[order[1:]] != key[order[:-1]], out=fresh[1:])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Rank and access over integers, one bit plane a level."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.ones, self.zeros, self.bits = [], [], []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level & 1).astype(np.int8)
            count = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.bits.append(bit)
            self.ones.append(count)
            self.zeros.append(len(now) - int(count[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.base = self._down(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            one = self.ones[k][at]
            at = np.where(symbol >> (self.levels - 1 - k) & 1, self.zeros[k] + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._down(symbol, at) - self.base[symbol]

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            bit, one = self.bits[k][at], self.ones[k][at]
            out = out * 2 + bit
            at = np.where(bit, self.zeros[k] + one, at - one)
        return out


class FMIndex:
    def __init__(self, text: np.ndarray, top: int, sample: int = SAMPLE):
        """text: symbols 1 to top; one sentinel 0, smaller than all, is put at the end."""
        text = np.concatenate([text, [0]]).astype(np.int64)
        order = suffix_array(text)
        self.n = len(text)
        self.tree = WaveletMatrix(text[order - 1], top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])[: top + 1].astype(np.int64)
        self.marked = order % sample == 0
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.sampled = order[self.marked]

    def _back(self, at: np.ndarray) -> np.ndarray:
        symbol = self.tree.access(at)
        return self.before[symbol] + self.tree.rank(symbol, at)

    def search(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns that occur, and their ranges of suffixes."""
        alive = np.arange(len(rows))
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), self.n, np.int64)
        for step in range(rows.shape[1] if len(rows) else 0):
            go = length[alive] > step
            k = alive[go]
            symbol = rows[k, length[k] - 1 - step].astype(np.int64)
            low[k] = self.before[symbol] + self.tree.rank(symbol, low[k])
            high[k] = self.before[symbol] + self.tree.rank(symbol, high[k])
            alive = alive[high[alive] > low[alive]]
        return alive, low[alive], high[alive]

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step back to a sampled one and add the steps."""
        out = np.full(len(at), -1, np.int64)
        left, steps = np.arange(len(at)), 0
        while len(left):
            hit = self.marked[at[left]]
            out[left[hit]] = self.sampled[self.mark_rank[at[left[hit]]]] + steps
            left = left[~hit]
            at = at.copy()
            at[left] = self._back(at[left])
            steps += 1
        return out


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of many ranges, and the range of each."""
    size = high - low
    of = np.repeat(np.arange(len(low)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size), of


def scan_shard(buf: np.ndarray, bounds: np.ndarray, phrases: Phrases):
    """Word spans of a shard, which words are hit, and the distinct (document, item) pairs."""
    buf = LOWER[buf]
    start, end = word_spans(buf, bounds, ALNUM)
    number = phrases.numbers(span_hash(prefix_hash(buf), start, end))
    word_of = np.searchsorted(start, bounds)
    hit = np.zeros(len(start) + 1, np.int64)
    none = np.zeros(0, np.int64)
    if not len(phrases.rows) or not len(start):
        return start, end, word_of, hit[:-1] > 0, none, none
    inside = number > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = word_of[(word_of > 0) & (word_of < len(start))]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    keep = e - s >= int(phrases.length.min())
    s, e = s[keep], e[keep]
    if not len(s):
        return start, end, word_of, hit[:-1] > 0, none, none
    size = e - s
    place = np.cumsum(size + 1) - size - 1
    at, run = ranges(s, e)
    text = np.ones(int((size + 1).sum()), np.int64)  # 1 separates
    word_at = np.full(len(text), -1, np.int64)
    where = at - s[run] + place[run]
    text[where] = number[at]
    word_at[where] = at
    index = FMIndex(text, len(phrases.words) + 1)
    alive, low, high = index.search(phrases.rows, phrases.length)
    suffix, of = ranges(low, high)
    word = word_at[index.locate(suffix)]
    pattern = alive[of]
    np.add.at(hit, word, 1)
    np.subtract.at(hit, word + phrases.length[pattern], 1)
    doc = np.searchsorted(word_of, word, "right") - 1
    found = np.unique(doc * len(phrases.rows) + pattern)
    item, k = ranges(phrases.item_bounds[found % len(phrases.rows)], phrases.item_bounds[found % len(phrases.rows) + 1])
    pairs = np.unique((found // len(phrases.rows))[k] * len(phrases.names) + phrases.items[item])
    return start, end, word_of, np.cumsum(hit[:-1]) > 0, pairs // len(phrases.names), pairs % len(phrases.names)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The different items in blocks of about block_bytes, one after the other. One block for all but a benchmark of many
    megabytes."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), text_bytes(text_col).alias("t")).distinct()
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    items = items if n == 1 else checkpointed(items)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r["i"], bytes(r["t"])) for r in part.collect()]
    drop(items)


def find_overlaps(documents: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, the columns named in keep, n_words, hits array<struct<start,end>> (byte spans to remove: merged
    runs of hit words), n_hit, item_ids (distinct, sorted as strings)."""
    found = _found(documents, benchmark, id_col, text_col, item_col, item_text, window, block_bytes, keep)
    return found.withColumnsRenamed({"id": id_col, **{f"keep_{c}": c for c in keep}})


def _runs(hit: np.ndarray, word_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of hit words; none crosses from one document to the next."""
    first, last = hit.copy(), hit.copy()
    first[1:] &= ~hit[:-1]
    last[:-1] &= ~hit[1:]
    cut = word_of[(word_of > 0) & (word_of < len(hit))]
    first[cut], last[cut - 1] = hit[cut], hit[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last)


def _found(documents, benchmark, id_col, text_col, item_col, item_text, window, block_bytes, keep) -> DataFrame:
    """As find_overlaps, but the id is `id` and kept columns are prefixed, so that no name clashes. All blocks of phrases
    are searched in one pass over the documents, so a document's hits of several blocks never have to meet again."""
    picked = documents.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    kept = [f"keep_{c} {documents.schema[c].dataType.simpleString()}" for c in keep]
    id_type = documents.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"id {id_type}", *kept, "n_words long, n_hit long, hits array<struct<start:long,end:long>>, item_ids array<string>"])
    shipped = [documents.sparkSession.sparkContext.broadcast(Phrases(block, window)) for block in _blocks(benchmark, item_col, item_text, block_bytes)]

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(shards: list[tuple]) -> Iterator[pa.RecordBatch]:
            results: list[list] = [[None, []] for _ in shards]
            for block in shipped:
                phrases = opened(block, len(shipped) == 1)
                for result, (_, _, _, buf, bounds) in zip(results, shards, strict=True):
                    start, end, word_of, hit, doc, item = scan_shard(buf, bounds, phrases)
                    result[0] = (start, end, word_of, hit if result[0] is None else hit | result[0][3])
                    result[1] += zip(doc.tolist(), (phrases.names[k] for k in item), strict=True)
            for (words, pairs), (batch, low, high, _, bounds) in zip(results, shards, strict=True):
                start, end, word_of, hit = words
                n, (s, e) = high - low, _runs(hit, word_of)
                of = np.searchsorted(word_of, s, "right") - 1
                spans = pa.StructArray.from_arrays([pa.array(start[s] - bounds[of]), pa.array(end[e] - bounds[of])], ["start", "end"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(s, word_of).astype(np.int32)), spans)
                sums = np.concatenate([[0], np.cumsum(hit)])
                pairs = sorted(set(pairs))
                at = np.searchsorted(np.array([d for d, _ in pairs], np.int64), np.arange(n + 1)).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(at), pa.array([i for _, i in pairs], pa.string()))
                rest = [batch.column(k).slice(low, n) for k in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, n), *rest, pa.array(np.diff(word_of)), pa.array(sums[word_of[1:]] - sums[word_of[:-1]]), lists, ids], names=["id", *[f"keep_{c}" for c in keep], "n_words", "n_hit", "hits", "item_ids"])

        held: list[tuple] = []
        for batch in batches:
            for low, high, buf, bounds in binary_parts(batch.column(1), SHARD_BYTES):
                held.append((batch, low, high, buf, bounds))
                if len(held) >= (GROUP if len(shipped) > 1 else 1):
                    yield from finish(held)
                    held.clear()
        yield from finish(held)

    return picked.mapInArrow(scan, schema)


def remove_overlaps(documents: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", window: int = WINDOW) -> DataFrame:
    """documents with every hit span cut out of the text; a document without hits stays as it is."""
    names = documents.columns
    found = _found(documents, benchmark, id_col, text_col, "item_id", "text", window, BLOCK_BYTES, tuple(names))
    text = F.col(f"keep_{text_col}")
    low = "CASE WHEN i = 0 THEN 0 ELSE int(hits[i - 1].end) END"
    high = "CASE WHEN i = size(hits) THEN length(bytes) ELSE int(hits[i].start) END"
    pieces = F.expr(f"transform(sequence(0, size(hits)), i -> decode(substring(bytes, 1 + {low}, {high} - {low}), 'UTF-8'))")
    found = found.withColumn("bytes", text.cast("string").cast("binary")).withColumn("cut", F.when(F.size("hits") > 0, F.array_join(pieces, "")).otherwise(text))
    return found.select(*[F.col("cut" if c == text_col else f"keep_{c}").alias(c) for c in names])


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The registered query's columns: counts, a digest of the items found, and the verdict of two items or more."""
    joined = F.array_join("item_ids", ",")
    return find_overlaps(documents, benchmark).select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), (F.size("item_ids") >= 2).alias("contaminated"))


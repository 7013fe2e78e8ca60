"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. A line is seen through counts of its characters and words, how it repeats, and the same figures
of the lines before and after it. The chain's two-state transition weights tie neighbours together; forward-backward gives
each line's marginal, and the marginals weighted by line length give the document's quality, put on the scale of a
probability by a logistic fit.

Labels exist for documents only, so the labels of lines are hidden: after a start in which lines carry their document's
label and the chain has no ties, emissions and ties are fitted to the label's likelihood under the length-weighted
marginals. The gradient of a document's weighted marginals is the covariance of the weights and the features under the
chain, had from two forward-backward passes with the weights put on and taken off the emissions.

Training reads a bounded sample: of at most TRAIN_DOCS labelled documents, those with the smallest hash of doc_id, as many
as have TRAIN_LINES lines together; of several texts of one doc_id the smallest teaches. Scoring reads every text whole.
Defined results: null and empty texts are one empty line and get a score; repeated labels of a document count once (the
smallest); labels without quality or doc_id teach nothing; a null doc_id is held out; without any label of one of the
classes every score is the share of label 1, or one half without labels; a column that has the name of the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, binary_parts, byte_class, checkpointed, drop, prefix_hash, span_hash, text_bytes, trimmed, word_spans

#: Bounds of the training sample, in documents and in lines.
TRAIN_DOCS, TRAIN_LINES = 6000, 300_000
THRESHOLD = 0.3
FOLDS = 5
#: Steps of the start and of the fit to the documents' labels.
START, STEPS = 60, 80
RIDGE = 1e-3
NUDGE = 1e-3

_UPPER = byte_class(r"[A-Z]")
_ALPHA = byte_class(r"[A-Za-z\x80-\xFF]")
_DIGIT = byte_class(r"[0-9]")
_STOP = byte_class(r"[.,;:?'\x22()-]")
_SPACE = byte_class(r"[\x20\x09-\x0D]")
_NAMES = ("bias", "log length", "upper", "digit", "stop", "symbol", "symbol runs", "word length", "short words", "repeats", "same as before", "distinct lines", "distinct words", "empty")
N_OWN = len(_NAMES)
N_ALL = 3 * N_OWN - 2


def line_features(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines with their neighbours', line lengths, first line of each document and the end)."""
    n_docs = len(bounds) - 1
    cuts = np.flatnonzero(buf == 10)
    in_doc = np.searchsorted(bounds, cuts, "right") - 1
    per_doc = np.bincount(in_doc, minlength=n_docs) + 1
    line_of = np.concatenate([[0], np.cumsum(per_doc)])
    n = int(line_of[-1])
    start, end = np.empty(n, np.int64), np.empty(n, np.int64)
    place = np.arange(len(cuts)) + in_doc  # the line that each line feed ends
    is_last = np.zeros(n, bool)
    is_last[line_of[1:] - 1] = True
    end[is_last] = bounds[1:]
    end[place] = cuts
    start[line_of[:-1]] = bounds[:-1]
    start[place + 1] = cuts + 1
    doc = np.repeat(np.arange(n_docs), per_doc)
    size = end - start

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(table[buf], out=sums[1:], dtype=np.int32)
        return (sums[end] - sums[start]).astype(np.float64)

    low = LOWER[buf]
    prefix = prefix_hash(low)
    alpha, space = count(_ALPHA), count(_SPACE)
    upper, digit, stop = count(_UPPER), count(_DIGIT), count(_STOP)
    ink = np.maximum(size - space, 1)
    symbol = np.maximum(size - space - alpha - digit - stop, 0)
    on = ~(_ALPHA | _DIGIT | _STOP | _SPACE)[buf]
    pair = np.zeros(len(buf) + 1, np.int32)
    if len(buf) > 1:
        np.cumsum(on[1:] & on[:-1], out=pair[2:], dtype=np.int32)
    runs = np.maximum(pair[end] - pair[np.minimum(start + 1, end)], 0)

    ws, we = word_spans(low, np.union1d(bounds, np.concatenate([start, end])), NOT_SPACE)
    word_line = np.searchsorted(start, ws, "right") - 1
    words = np.bincount(word_line, minlength=n).astype(np.float64)
    short = np.bincount(word_line, weights=(we - ws <= 3), minlength=n)
    h = span_hash(prefix, ws, we)
    word_doc = doc[word_line] if len(word_line) else np.zeros(0, np.int64)
    order = np.lexsort((h, word_doc))
    new = np.ones(len(h), bool)
    if len(h) > 1:
        new[1:] = (h[order][1:] != h[order][:-1]) | (word_doc[order][1:] != word_doc[order][:-1])
    doc_words = np.bincount(word_doc, minlength=n_docs)
    doc_types = np.bincount(word_doc[order], weights=new, minlength=n_docs)

    lh = span_hash(prefix, start, end)
    order = np.lexsort((lh, doc))
    new = np.ones(n, bool)
    new[1:] = (lh[order][1:] != lh[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    group = np.cumsum(new) - 1
    times = np.empty(n, np.int64)
    times[order] = np.bincount(group)[group]
    distinct_lines = np.bincount(doc[order], weights=new, minlength=n_docs) / per_doc
    before = np.zeros(n, bool)
    before[1:] = (lh[1:] == lh[:-1]) & (doc[1:] == doc[:-1])

    x = np.zeros((n, N_OWN), np.float64)
    columns = (np.ones(n), np.log1p(size) / 5, upper / ink, digit / ink, stop / ink, symbol / ink, runs / ink, np.minimum(ink / np.maximum(words, 1), 30) / 10, short / np.maximum(words, 1), np.log(times), before, distinct_lines[doc], ((doc_types + 20) / (doc_words + 20))[doc], size == 0)
    for k, c in enumerate(columns):
        x[:, k] = c
    out = np.zeros((n, N_ALL), np.float64)
    out[:, :N_OWN] = x
    inner = doc[1:] == doc[:-1]
    out[1:, N_OWN : 2 * N_OWN - 1][inner] = x[:-1, 1:][inner]
    out[:-1, 2 * N_OWN - 1 :][inner] = x[1:, 1:][inner]
    return out, size, line_of


def _by_step(line_of: np.ndarray) -> list[np.ndarray]:
    """For each step along the chains, the documents that are that long, in one order of falling length."""
    size = np.diff(line_of)
    order = np.argsort(-size, kind="stable")
    alive = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), "right")
    return [order[:k] for k in alive]


@dataclass
class Field:
    """Emission weights for good against bad, the pairwise weights, and the logistic scale of document scores."""

    weights: np.ndarray
    pair: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def messages(self, x: np.ndarray, line_of: np.ndarray, extra: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Emissions, forward and backward log messages, and the order they were made in."""
        emit = np.zeros((len(x), 2))
        emit[:, 1] = x @ self.weights + (0 if extra is None else extra)
        ahead, back = np.zeros_like(emit), np.zeros_like(emit)
        steps, first, last = _by_step(line_of), line_of[:-1], line_of[1:] - 1
        for t, docs in enumerate(steps):
            at = first[docs] + t
            if t:
                m = ahead[at - 1][:, :, None] + self.pair
                ahead[at] = np.logaddexp(m[:, 0], m[:, 1]) + emit[at]
                at = last[docs] - t
                m = (back[at + 1] + emit[at + 1])[:, None, :] + self.pair
                back[at] = np.logaddexp(m[:, :, 0], m[:, :, 1])
            else:
                ahead[at] = emit[at]
        return emit, ahead, back, steps

    def marginals(self, x: np.ndarray, line_of: np.ndarray) -> np.ndarray:
        """Each line's probability of being good."""
        _, ahead, back, _ = self.messages(x, line_of)
        both = ahead + back
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))

    def raw(self, x: np.ndarray, size: np.ndarray, line_of: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the line marginals of each document."""
        weight = size + 1.0
        m = self.marginals(x, line_of) * weight
        return np.add.reduceat(m, line_of[:-1]) / np.add.reduceat(weight, line_of[:-1])

    def score(self, x: np.ndarray, size: np.ndarray, line_of: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(line_of) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(self.raw(x, size, line_of)) + self.shift, -500, 500)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class Climb:
    """Adam, uphill."""

    def __init__(self, n: int, rate: float):
        self.m, self.v, self.step, self.rate = np.zeros(n), np.zeros(n), 0, rate

    def move(self, grad: np.ndarray) -> np.ndarray:
        self.step += 1
        self.m, self.v = 0.9 * self.m + 0.1 * grad, 0.999 * self.v + 0.001 * grad * grad
        return self.rate * (self.m / (1 - 0.9**self.step)) / (np.sqrt(self.v / (1 - 0.999**self.step)) + 1e-8)


def expected(f: Field, z: np.ndarray, line_of: np.ndarray, extra: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the lines, and the expected features and ties of all chains; extra is added to good emissions."""
    _, ahead, back, _ = f.messages(z, line_of, extra)
    both = ahead + back
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    inner = np.ones(len(z), bool)
    inner[line_of[:-1]] = False
    at = np.flatnonzero(inner)
    emit = np.zeros((len(z), 2))
    emit[:, 1] = z @ f.weights + (0 if extra is None else extra)
    joint = ahead[at - 1][:, :, None] + f.pair + (emit[at] + back[at])[:, None, :] - total[at][:, None, None]
    return good, np.concatenate([z.T @ good, np.exp(joint).sum(0).ravel()])


def train(x: np.ndarray, size: np.ndarray, line_of: np.ndarray, label: np.ndarray, steps: int = STEPS) -> Field:
    """A start from line labels, then the likelihood of the documents' labels with hidden lines, both with a ridge; then
    the logistic scale."""
    if not len(label):
        return Field(np.zeros(N_ALL), np.zeros((2, 2)), constant=0.5)
    if label.min() == label.max():
        return Field(np.zeros(N_ALL), np.zeros((2, 2)), constant=float(label.mean()))
    scale = x.std(0)
    scale[scale < 1e-9] = 1.0
    z = x / scale
    theta = np.zeros(N_ALL + 4)
    line_label = np.repeat(label, np.diff(line_of)).astype(float)
    climb = Climb(N_ALL, 0.15)
    for _ in range(START):
        good = 1 / (1 + np.exp(-np.clip(z @ theta[:N_ALL], -30, 30)))
        theta[:N_ALL] += climb.move(z.T @ (line_label - good) / len(z) - RIDGE * theta[:N_ALL])
    share = (size + 1.0) / np.repeat(np.add.reduceat(size + 1.0, line_of[:-1]), np.diff(line_of))
    climb = Climb(N_ALL + 4, 0.05)
    for _ in range(steps):
        f = Field(theta[:N_ALL], theta[N_ALL:].reshape(2, 2))
        good, _ = expected(f, z, line_of)
        mean = np.clip(np.add.reduceat(good * share, line_of[:-1]), 1e-3, 1 - 1e-3)
        push = np.repeat((label / mean - (1 - label) / (1 - mean)), np.diff(line_of)) * share * NUDGE
        more, less = (expected(f, z, line_of, sign * push)[1] for sign in (1, -1))
        theta = theta + climb.move((more - less) / (2 * NUDGE * len(label)) - RIDGE * theta)
    field = Field(theta[:N_ALL] / scale, theta[N_ALL:].reshape(2, 2))
    s = _logit(field.raw(x, size, line_of))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        g = np.array([((label - p) * s).sum() - 1e-2 * a, (label - p).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * s * s).sum() + 1e-2, (w * s).sum()], [(w * s).sum(), w.sum()]])
        da, db = np.linalg.solve(h, g)
        a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -1, 1))
    field.slope, field.shift = a, b
    return field


def held_out(id_col="doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def fit(documents: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="quality", train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> Field:
    """A field from a bounded sample of labelled documents that are not held out. The executors make the features."""
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(train_docs)
    texts = documents.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t")).join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("t").alias("t"))
    texts = checkpointed(texts)
    # at most train_docs rows are left, so one task can add up their lines
    lines = F.length("t") - F.length(F.regexp_replace(F.decode("t", "UTF-8"), "\n", "").cast("binary")) + 1
    upto = texts.select("id", lines.alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy(F.xxhash64("id"), "id")))
    texts_used = texts.join(F.broadcast(upto.where(F.col("upto") <= train_lines).select("id")), "id").select("id", "y", "t")

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, buf, bounds in binary_parts(batch.column(2)):
                x, size, line_of = line_features(buf, bounds)
                packed = [x[a:b].astype(np.float32).tobytes() for a, b in zip(line_of[:-1], line_of[1:], strict=True)]
                sizes = [size[a:b].astype(np.int32).tobytes() for a, b in zip(line_of[:-1], line_of[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(packed, pa.binary()), pa.array(sizes, pa.binary())], names=["id", "y", "x", "s"])

    rows = texts_used.mapInArrow(scan, f"id {documents.schema[id_col].dataType.simpleString()}, y int, x binary, s binary").toArrow()
    drop(texts)
    order = sorted(range(rows.num_rows), key=lambda k: (rows["id"][k].as_py(), rows["x"][k].as_py()))
    x = [np.frombuffer(rows["x"][k].as_py(), np.float32).reshape(-1, N_ALL) for k in order]
    size = [np.frombuffer(rows["s"][k].as_py(), np.int32) for k in order]
    line_of = np.concatenate([[0], np.cumsum([len(s) for s in size])]).astype(np.int64)
    if not x:
        return train(np.zeros((0, N_ALL)), np.zeros(0), line_of, np.zeros(0))
    return train(np.concatenate(x).astype(np.float64), np.concatenate(size), line_of, np.array([rows["y"][k].as_py() for k in order]))


def score(documents: DataFrame, field: Field, *, text_col="text", out_col="score") -> DataFrame:
    """documents with a score; every other column stays."""
    if out_col != text_col:
        documents = documents.drop(out_col)
    shipped, names = documents.sparkSession.sparkContext.broadcast(field), documents.columns

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shipped.value.score(*line_features(buf, bounds)) for _, _, buf, bounds in binary_parts(batch.column(batch.num_columns - 1))]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*names, out_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return documents.select("*", text_bytes(text_col).alias(f"{out_col} bytes")).mapInArrow(scan, f"{fields}, `{out_col}` double")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered query's columns."""
    scored = score(documents.select("doc_id", "text"), fit(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """documents without those that the classifier rejects."""
    scored = score(documents, fit(documents, labels), out_col="quality score")
    return scored.where(F.col("quality score") >= threshold).select(*documents.columns)

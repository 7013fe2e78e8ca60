"""SentencePiece encoding and decoding as a shortest path through a weighted transducer.

Three machines are compiled from a model file:

- the normaliser, from the model's own settings: one arc for each state and class of characters, with what it outputs (a
  space put in front, spaces as U+2581, runs of spaces as one where the model says so);
- the pieces: states are pieces, and an arc from piece p to piece q reads q's characters, outputs its id and weighs
  w(p, q). A merge vocabulary weighs 1 where merging the joint text of p and q by the model's priorities gives p, q again,
  and infinitely much otherwise: segmenting by merges is local in this sense, a path is the model's segmentation exactly
  when each of its arcs is finite;
- byte fallback: an arc reads a character that no piece holds and outputs the ids of its UTF-8 bytes, at weight 1.

An input is composed with them: states of the composition are (position, piece), arcs are the pieces that Aho-Corasick finds
to end at each position. Relaxing the arcs in that order, over (min, +), gives the shortest path, which is the library's
result.

No piece holds U+2581 behind another character, nor most punctuation behind a letter, so inputs are composed one stretch at
a time, which ends where no piece reaches across; stretches and arc weights that were worked out are remembered in bounded tables of a worker.

Defined results: null texts count as empty; an empty text has no ids; decoding replaces broken UTF-8 by U+FFFD; columns of
the names that are put out are replaced; a model with a table of character rules or without merges is refused.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, small_batches, trimmed
from .vocabulary import SPACE, Pieces, Spec

#: Entries of each of the worker's two tables of stretches and of its table of weights, about 200 bytes each.
REMEMBERED = 250_000
ONE, INF = 1.0, float("inf")
_machines: dict[int, Transducer] = held("pieces")


class Normaliser:
    """A transducer over three classes of input: the text's start, spaces, and other characters. Its states are START, INSIDE
    and GAP (behind a space that is not yet put out); an arc is (output before the character, whether the character itself is
    put out, next state)."""

    START, INSIDE, GAP = range(3)

    def __init__(self, spec: Spec):
        space = SPACE if spec.escape else " "
        front = space if spec.dummy_prefix else ""
        word = {self.START: (front, True, self.INSIDE), self.INSIDE: ("", True, self.INSIDE), self.GAP: (space, True, self.INSIDE)}
        if spec.one_space:
            blank = {self.START: ("", False, self.START), self.INSIDE: ("", False, self.GAP), self.GAP: ("", False, self.GAP)}
        else:
            blank = {self.START: (front + space, False, self.INSIDE), self.INSIDE: (space, False, self.INSIDE)}
        self.arcs = {(state, kind): arc for kind, arcs in (("word", word), ("space", blank)) for state, arc in arcs.items()}
        #: Where spaces lead from INSIDE to itself, the arcs behind the start make one substitution.
        self.steady = blank[self.INSIDE][0] if blank[self.INSIDE][2] == self.INSIDE else None
        self.front = front

    def compose(self, text: str) -> str:
        if self.steady is not None:
            return self.front + text.replace(" ", self.steady) if text else ""
        state, out = self.START, []
        for c in text:
            before, self_out, state = self.arcs[state, "space" if c == " " else "word"]
            out.append(before + c if self_out else before)
        return "".join(out)


class Transducer:
    def __init__(self, pieces: Pieces):
        import ahocorasick

        pieces.spec.check()
        self.pieces, self.normaliser = pieces, Normaliser(pieces.spec)
        self.score = {p: s for p, (_, s) in pieces.ordinary.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece holds U+2581 behind another character; stretches can't be composed one at a time")
        known = {c for p in self.score for c in p}
        #: Characters of pieces that are no piece themselves get numbers from the model's size on; 0 is the start.
        lone = sorted(known - self.score.keys())
        self.labels = ["", *self.score, *lone]
        self.ids = [0, *(k for k, _ in pieces.ordinary.values()), *(-1 for _ in lone)]
        self.sizes = [len(p) for p in self.labels]
        self.trie = ahocorasick.Automaton()
        for k, p in enumerate(self.labels[1:], 1):
            self.trie.add_word(p, (len(p), k))
        self.trie.make_automaton()
        inner = "".join(map(re.escape, sorted(known - {SPACE})))
        self.cut = re.compile(f"{SPACE}*[{inner}]+|{SPACE}+|.", re.S)
        self.letters = frozenset(c for c in known if c.isalpha())
        #: What no piece holds right behind a letter.
        self.behind = frozenset(known - {SPACE} - {b for p in self.score for a, b in zip(p, p[1:], strict=False) if a in self.letters})
        #: Weights of the arcs that were met, under the key p * labels + q.
        self.weights: dict[int, float] = {}
        self.table = _Remembered(self)

    def merged(self, text: str) -> list[str]:
        """What merging neighbours by priority, leftmost first, makes of a short text."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -INF, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and s > best:
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def weight(self, p: int, q: int) -> float:
        """Of the arc from piece p to piece q."""
        if len(self.weights) >= REMEMBERED:
            self.weights.clear()
        a, b = self.labels[p], self.labels[q]
        w = self.weights[p * len(self.labels) + q] = ONE if self.merged(a + b) == ([a, b] if a else [b]) else INF
        return w

    def shortest(self, stretch: str) -> list[int]:
        """Labels on the shortest path through the composition of one stretch of known characters with the pieces. A finite
        path to a state (position, piece) is the model's segmentation of the characters before the position, and there is
        one segmentation only: so of all states of a position one at most is ever reached, and relaxing keeps that one."""
        n, sizes, known = len(self.labels), self.sizes, self.weights.get
        piece, cost = [0] * (len(stretch) + 1), [INF] * (len(stretch) + 1)
        cost[0] = 0.0
        for end, (size, q) in self.trie.iter(stretch):
            end += 1
            so_far = cost[end - size]
            # no arc weighs less than ONE, so this one can only help if that much would
            if so_far + ONE < cost[end]:
                p = piece[end - size]
                w = known(p * n + q)
                total = so_far + (self.weight(p, q) if w is None else w)
                if total < cost[end]:
                    cost[end], piece[end] = total, q
        out, end = [], len(stretch)
        while end:
            q = piece[end]
            out.append(q)
            end -= sizes[q]
        out.reverse()
        return out

    def tail(self, stretch: str) -> int:
        """Where the punctuation at the end of a stretch begins, if no piece reaches from the letter before into it; or 0."""
        k = len(stretch)
        while k and stretch[k - 1] not in self.letters:
            k -= 1
        return k if k < len(stretch) and stretch[k] in self.behind else 0

    def output(self, stretch: str) -> bytes:
        """Ids of a stretch, as packed 32-bit integers."""
        path = self.shortest(stretch) if self.trie.exists(stretch[0]) else []
        out = [self.ids[k] for k in path]
        if -1 in out:
            out = [i for k in path for i in ((self.ids[k],) if self.ids[k] >= 0 else self.fallback(self.labels[k]))]
        return array("i", out if path else self.fallback(stretch)).tobytes()

    def fallback(self, c: str) -> list[int]:
        ids = self.pieces.byte_ids
        return [ids[b] for b in c.encode("utf-8", "replace")] if ids else [self.pieces.unknown]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.table.__getitem__, self.cut.findall(self.normaliser.compose(text)))), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.pieces.texts.__getitem__, ids)).decode("utf-8", "replace")
        return text.removeprefix(" ") if self.pieces.spec.dummy_prefix else text


class _Remembered(dict):
    """Ids of the stretches met last. A full table becomes the old one, from which stretches come back when they are met."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine, self.old = machine, {}

    def __missing__(self, stretch: str) -> bytes:
        out = self.old.get(stretch)
        if out is None:
            k = self.machine.tail(stretch)
            out = self[stretch[:k]] + self[stretch[k:]] if k else self.machine.output(stretch)
        if len(stretch) <= 64:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[stretch] = out
        return out


def machine(shipped) -> Transducer:
    """The worker's machine for a broadcast of pieces."""
    if shipped.id not in _machines:
        _machines.clear()
        _machines[shipped.id] = Transducer(shipped.value)
    return _machines[shipped.id]


class _Shipped:
    """A broadcast with a number of its own, by which a worker finds the machine it has compiled."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    @property
    def value(self) -> Pieces:
        return self.broadcast.value

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}


def ship(spark, path: str | None = None) -> _Shipped:
    return _Shipped(spark.sparkContext.broadcast(Pieces.load(path)))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


def encode(documents: DataFrame, *, text_col="text", model: str | None = None, ids_col="ids") -> DataFrame:
    """documents with a column of ids, array<int>; every other column stays."""
    small_batches(documents.sparkSession)
    documents = documents.drop(ids_col) if ids_col != text_col else documents
    shipped, names = ship(documents.sparkSession, model), documents.columns

    @trimmed(using="pieces")
    def scan(batches):
        m = machine(shipped)
        for batch in batches:
            ids = [m.encode(t.as_py() or "") for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(ids)], names=[*names, ids_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return documents.select("*", F.col(text_col).cast("string").alias(f"{ids_col} text")).mapInArrow(scan, f"{fields}, `{ids_col}` array<int>")


def decode(encoded: DataFrame, *, ids_col="ids", text_col="text", model: str | None = None) -> DataFrame:
    """encoded with the text that its ids stand for, in place of any column of that name."""
    shipped = ship(encoded.sparkSession, model)
    rest = encoded.drop(text_col) if text_col != ids_col else encoded
    names = rest.columns

    @trimmed(using="pieces")
    def scan(batches):
        m = machine(shipped)
        for batch in batches:
            texts = [m.decode(k.as_py() or []) for k in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*names, text_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.select("*", F.col(ids_col).alias(f"{text_col} ids")).mapInArrow(scan, f"{fields}, `{text_col}` string")


def encode_checked(documents: DataFrame, *, text_col="text", model: str | None = None) -> DataFrame:
    """documents with ids array<int>, n_tokens, and round_trip: whether the ids decode to the text."""
    small_batches(documents.sparkSession)
    documents = documents.drop(*{"ids", "n_tokens", "round_trip"} - {text_col})
    shipped, names = ship(documents.sparkSession, model), documents.columns

    @trimmed(using="pieces")
    def scan(batches):
        m = machine(shipped)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            ids = [m.encode(t) for t in texts]
            same = [m.decode(k.tolist()) == t for k, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(ids), pa.array([len(k) for k in ids], pa.int64()), pa.array(same, pa.bool_())], names=[*names, "ids", "n_tokens", "round_trip"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return documents.select("*", F.col(text_col).cast("string").alias("ids text")).mapInArrow(scan, f"{fields}, ids array<int>, n_tokens long, round_trip boolean")


def report(documents: DataFrame, model: str | None = None) -> DataFrame:
    """The registered query's columns: count and digest of the ids (little-endian 32-bit), digest of the decoded text,
    and whether decoding gives the text back. Encoding and decoding happen in one pass, so no id list is shipped."""
    small_batches(documents.sparkSession)
    shipped = ship(documents.sparkSession, model)
    id_type = documents.schema["doc_id"].dataType.simpleString()

    @trimmed(using="pieces")
    def scan(batches):
        m = machine(shipped)
        for batch in batches:
            n, digest, back, same = [], [], [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                ids = m.encode(text)
                out = m.decode(ids.tolist())
                n.append(len(ids))
                digest.append(hashlib.sha256(ids.tobytes()).hexdigest())
                back.append(hashlib.sha256(out.encode()).hexdigest())
                same.append(out == text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    return documents.select("doc_id", F.col("text").cast("string").alias("t")).mapInArrow(scan, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")

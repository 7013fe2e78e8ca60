"""Token counts without tokens: an Aho-Corasick automaton lists every vocabulary piece in a word, and a Viterbi pass keeps
the best score and its number of pieces at each position; no segmentation is built.

The tokenizer is a unigram model: pieces with log-probabilities, words split in front of each space (written U+2581), a
character that no piece covers costs the lowest score less ten and counts its UTF-8 bytes. Ties follow the tokenizer:
pieces that end at a position are tried from the longest to the shortest, and only a better score replaces the best one.

The vocabulary comes from a model file whose pieces are ranked, not weighted; the score of rank r is -log(r + 2) rounded
to 1/64, by Zipf's law, so sums are exact. Null and empty texts have no tokens.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, small_batches, trimmed
from .vocabulary import SPACE, Pieces

#: Entries of the worker's table of words before it starts anew.
REMEMBERED = 600_000
UNKNOWN_PENALTY = 10.0
_counters: dict[int, Counter] = held("counter")


def unigram_scores(pieces: Pieces) -> dict[str, float]:
    """Zipf scores in the order of the pieces' ids, in 64ths."""
    ranked = sorted(pieces.ordinary, key=lambda p: pieces.ordinary[p][0])
    return {p: -round(64 * math.log(r + 2)) / 64 for r, p in enumerate(ranked)}


class Counter(dict):
    """From a word to its number of tokens."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p, s in scores.items():
            self.automaton.add_word(p, (len(p), s))
        if scores:
            self.automaton.make_automaton()
        self.single = frozenset(p for p in scores if len(p) == 1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY

    def viterbi(self, word: str) -> tuple[float, int]:
        """Best score of a word and the number of tokens on that path."""
        n = len(word)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        single, at = self.single, 0

        def close(end: int) -> None:
            """Unknown characters step on by one; they are the last to reach their end."""
            nonlocal at
            while at < end:
                c = word[at]
                if c not in single:
                    s = best[at] + self.unknown
                    if best[at + 1] is None or s > best[at + 1]:
                        best[at + 1], count[at + 1] = s, count[at] + len(c.encode("utf-8", "replace"))
                at += 1

        if len(self.automaton):
            for last, (size, score) in self.automaton.iter(word):
                if at < last:
                    close(last)
                end = last + 1
                s = best[end - size] + score
                if best[end] is None or s > best[end]:
                    best[end], count[end] = s, count[end - size] + 1
        close(n)
        return best[n], count[n]

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.viterbi(word)[1]
        if len(word) <= 64:
            self[word] = n
        return n

    def count(self, text: str) -> int:
        """A text starts with a space, its own or one put there; words start with theirs."""
        if not text:
            return 0
        text = text.replace(SPACE, " ")
        text = text[1:] if text[0] == " " else text
        return sum(map(self.__getitem__, (SPACE + text.replace(" ", " " + SPACE)).split(" ")))


def _counter(broadcast, number: int) -> Counter:
    if number not in _counters:
        _counters.clear()
        _counters[number] = Counter(broadcast.value)
    return _counters[number]


def count_tokens(documents: DataFrame, *, text_col="text", model: str | None = None, out_col="n_tokens") -> DataFrame:
    """documents with the number of tokens of a text; every other column stays, but one of that name."""
    small_batches(documents.sparkSession)
    documents = documents.drop(out_col) if out_col != text_col else documents
    broadcast = documents.sparkSession.sparkContext.broadcast(unigram_scores(Pieces.load(model)))
    number, names = broadcast._jbroadcast.id(), documents.columns

    @trimmed(using="counter")
    def scan(batches):
        counter = _counter(broadcast, number)
        for batch in batches:
            n = [counter.count(t.as_py() or "") for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*names, out_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return documents.select("*", F.col(text_col).cast("string").alias(f"{out_col} text")).mapInArrow(scan, f"{fields}, `{out_col}` long")


def report(documents: DataFrame, model: str | None = None) -> DataFrame:
    """The registered query's columns: doc_id, n_tokens, and the text's length in code points."""
    slim = documents.select("doc_id", "text")
    return count_tokens(slim, model=model).select("doc_id", "n_tokens", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))

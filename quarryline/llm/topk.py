"""Exact top-k inner products over norm-sorted vectors.

Components become integers, floor(64 x), so scores are exact. A rotation by the right singular vectors of the whole table
puts most of the length into the first coordinates. Candidates are dealt out by descending length and read in that order;
a block is skipped for a query once the product of the lengths (Cauchy-Schwarz) can't reach the query's k-th best score
so far. What is left goes through STAGES: each adds the partial sum over the next coordinates and drops every pair whose
sum plus the product of the residual lengths can't reach the k-th best, and with them the queries and candidates that have
no pair left. Only pairs that pass all stages get their integer inner product. The k-th best among the SEED longest vectors
is where queries start.

Queries are shipped in blocks of QUERY_BLOCK; each block is one pass over the candidates. Defined results: vectors that
are null or hold a null or non-finite component, and rows without vec_id, take no part; a shorter vector counts as padded
with zeros; a query's own row is every row of its vec_id; ties go to the smaller vec_id; rows equal in vec_id and vector are
one query but as many candidates as rows, and different vectors of one vec_id are ranked each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, trimmed

SCALE = 64
SEED = 512
QUERY_BLOCK = 32768
CAND_BLOCK = 2048
#: Quarters of the coordinates that are summed up, one after the other, before pairs are dropped.
STAGES = 4
#: Components of a block of vectors at most, and leading coordinates that are rotated.
COMPONENTS, TURNED = 1 << 22, 1024
EVERY = 20
K = 20


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    x = F.transform(vec_col, lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull())
    return rows.where(~bad).withColumn("v", F.transform("x", lambda c: F.floor(c * SCALE).cast("long"))).drop("x")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows padded with zeros."""
    at = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
    at = at - at[0]
    size = np.diff(at)
    if len(size) and (size == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(at[:-1], size)] = flat
    return out


class Ranked:
    """The best k of each query so far."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.astype(np.float64)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((query, ids, score))
        self.waiting += len(query)
        if self.waiting > 1 << 18:
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return (np.zeros(0, np.int64),) * 3
        q, i, s = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([first, [len(q)]]))
        place = np.arange(len(q)) - np.repeat(first, size)
        keep = place < self.k
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        self.parts, self.waiting = [(q[keep], i[keep], s[keep])], 0
        return self.parts[0]


class Search:
    """A block of queries in the rotated frame."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, rotation: np.ndarray, k: int):
        self.ids, self.queries, self.rotation, self.k = ids, queries, rotation, k
        self.edges = np.unique(np.linspace(0, queries.shape[1], STAGES + 1).astype(int))
        self.turned, self.rest = self.turn(queries)
        #: Pairs seen, and pairs left after each stage.
        self.seen, self.left = 0, np.zeros(len(self.edges), np.int64)

    def turn(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors in the rotated frame, and the length of what is left of each behind every edge."""
        y = v.astype(np.float64)
        n = len(self.rotation)
        y[:, :n] = y[:, :n] @ self.rotation
        square = np.concatenate([np.zeros((len(y), 1)), np.cumsum(y * y, 1)], 1)[:, self.edges]
        return y, np.sqrt(np.maximum(square[:, -1:] - square, 0))

    def scan(self, ids: np.ndarray, v: np.ndarray, best: Ranked) -> None:
        """Candidates of one block, longest first."""
        if not len(ids):
            return
        y, rest = self.turn(v)
        most = float(rest[:, 0].max(initial=0))
        slack = 1e-9 * (1.0 + self.rest[:, 0] * most)
        need = best.floor - slack
        self.seen += len(self.ids) * len(ids)
        alive = np.flatnonzero(self.rest[:, 0] * most >= need)
        for part in np.array_split(alive, -(-len(alive) // 1024)) if len(alive) else ():
            row, col = part, np.arange(len(ids))
            total = np.zeros((len(row), len(col)))
            for stage, (a, b) in enumerate(zip(self.edges[:-1], self.edges[1:], strict=True), 1):
                total += self.turned[row, a:b] @ y[col, a:b].T
                live = total + np.outer(self.rest[row, stage], rest[col, stage]) >= need[row][:, None]
                self.left[stage] += np.count_nonzero(live)
                r, c = live.any(1), live.any(0)
                if r.mean() < 0.9 or c.mean() < 0.9:
                    row, col, total, live = row[r], col[c], total[np.ix_(r, c)], live[np.ix_(r, c)]
                if not len(row):
                    break
            if not len(row):
                continue
            q, c = np.nonzero(live)
            q, c = row[q], col[c]
            own = self.ids[q] != ids[c]
            q, c = q[own], c[own]
            for a in range(0, len(q), max(1, COMPONENTS // v.shape[1])):
                b = slice(a, a + max(1, COMPONENTS // v.shape[1]))
                score = np.einsum("ij,ij->i", self.queries[q[b]], v[c[b]])
                good = score >= best.floor[q[b]]
                best.add(q[b][good], ids[c[b]][good], score[good])
        best.fold()


def top_k(vectors: DataFrame, *, id_col="vec_id", vec_col="embedding", every: int = EVERY, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    turned = min(width, TURNED)

    @trimmed
    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((turned, turned))
        for batch in batches:
            x = matrix(batch.column(0), turned).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(turned * turned)), pa.array(total.ravel())], names=["k", "s"])

    sums = rows.select(F.slice("v", 1, turned).alias("v")).mapInArrow(gram, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).toPandas()
    square = np.zeros(turned * turned)
    square[sums["k"].to_numpy()] = sums["s"].to_numpy()
    rotation = np.linalg.eigh(square.reshape(turned, turned))[1][:, ::-1].copy()

    block_rows = max(1, min(CAND_BLOCK, COMPONENTS // width))
    length = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    sized = rows.withColumn("length", length)
    longest = sized.orderBy(F.desc("length"), "id").limit(min(SEED, block_rows)).select("id", "v").toArrow().combine_chunks()
    seed_ids, seed_v = longest.column("id").to_numpy(), matrix(_whole(longest.column("v")), width)
    dealt = sized.repartitionByRange(F.desc("length"), F.col("id")).sortWithinPartitions(F.desc("length"), "id").select("id", "v")

    asked = rows.where(F.pmod("id", F.lit(every)) == 0).select("id", "v").distinct()
    passes = -(-asked.count() // max(1, min(query_block, 8 * COMPONENTS // width))) or 1
    if passes > 1:
        asked, dealt = checkpointed(asked), checkpointed(dealt)
    found = None
    for number in range(passes):
        block = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == number)
        table = block.orderBy("id", "v").toArrow().combine_chunks()
        if not table.num_rows:
            continue
        search = Search(table.column("id").to_numpy(), matrix(_whole(table.column("v")), width), rotation, k)
        start = Ranked(np.full(len(search.ids), -np.inf), k)
        search.scan(seed_ids, seed_v, start)
        shipped = spark.sparkContext.broadcast((search, start.floor))

        @trimmed
        def scan(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            search, floor = shipped.value
            best = Ranked(floor.copy(), k)
            for batch in batches:
                for a in range(0, batch.num_rows, block_rows):
                    part = batch.slice(a, block_rows)
                    search.scan(part.column(0).to_numpy(), matrix(part.column(1), width), best)
            q, i, s = best.fold()
            yield pa.RecordBatch.from_arrays([pa.array(search.ids[q]), pa.array(q), pa.array(i), pa.array(s)], names=["query_id", "query", "vec_id", "score"])

        part = dealt.mapInArrow(scan, "query_id long, query long, vec_id long, score long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _whole(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def report(vectors: DataFrame) -> DataFrame:
    return top_k(vectors)

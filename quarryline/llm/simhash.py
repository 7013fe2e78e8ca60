"""Near duplicates by SimHash and covering locality-sensitive hashing.

For radius r, every bit position gets a code of r + 1 bits, and each of the 2^(r+1) - 1 nonzero vectors v is one table: it
keeps the positions whose code has an odd inner product with v. Up to r differing positions put at most r linear
conditions on v, so some v drops them all: every pair within the radius shares a key in some table, without exception. The
codes are those of a first-order Reed-Muller code (for radius 7 with a bent function added), so every table but one keeps
about half of the positions and that one all.

Copies of a fingerprint are folded first; tables hold distinct fingerprints only, in packed blocks dealt out by key. What
shares a key is compared in one task, which hands on a spanning forest of the links and never all pairs; a key with more
than HEAVY fingerprints is first split by r + 1 stretches of bits, one of which any linked pair has in common. Components
come from alternating star contractions over those links, with the lineage cut in each round.

`keep_first`, which keeps one document of each group, links two documents exactly if the Jaccard similarity of their sets
of five-word shingles is 0.8 or more. Its candidates are what the covering tables connect: fingerprints over the distinct
words within MEET bits, and over the distinct five-word shingles within APART; the sets of each such group are compared.
64 bits can't promise every pair of that similarity, so an exact search for the rest follows: two such sets share one of the
first shingles of either (m - ceil(0.8 m) + 1 of m, in any one order), and what shares one of those and isn't connected yet
is compared too, without exception; shingles that are frequent in a sample come last in the order, which changes the work
and not the links.

Defined results: null and empty texts have fingerprint zero and link like any other; rows with the same doc_id are
separate documents; a null doc_id is never the smallest, and a component of null ids only has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, binary_parts, bucket_of, buckets_for, by_bucket, checkpointed, dealt, drop, mix, prefix_hash, span_hash, split_by, text_bytes, trimmed, word_spans

WORDS = 3
RADIUS = 3
SEED = 42
HEAVY = 8192
SMALL = 8
#: keep_first: words of a shingle, and the similarity as a fraction.
GROUP_WORDS, PART_OF, WHOLE_OF = 5, 4, 5
#: keep_first: the kinds of its two fingerprints, and how many bits of each may differ for candidates.
PRINTS, MEET, APART = ((1, True), (GROUP_WORDS, True)), 6, 16
#: Least documents of the sample, or one of so many, and how many of them hold a shingle that is put last; nodes and
#: shingles of a block, two of which are compared in one task.
SAMPLED, RATE, OFTEN, TOGETHER, SHINGLES = 10_000, 64, 3, 512, 1 << 20
#: Most bits of the map of a set that is compared before the set is.
MAP = 8192


def masks(radius: int = RADIUS) -> list[int]:
    """One 64-bit mask a table."""
    if not 0 <= radius <= 7:
        raise ValueError("codes exist for radius 0 to 7")

    def code(k: int) -> int:
        bit = [k >> j & 1 for j in range(6)]
        bent = bit[0] & bit[1] ^ bit[2] & bit[3] ^ bit[4] & bit[5]
        return 1 | sum(b << 1 + j for j, b in enumerate([*bit, bent][:radius]))

    return [sum(1 << k for k in range(64) if (code(k) & v).bit_count() & 1) for v in range(1, 2 << radius)]


def fingerprints_of(buf: np.ndarray, bounds: np.ndarray, words: int = WORDS, distinct: bool = False) -> np.ndarray:
    """SimHash of every text of a part, over all shingles or over the distinct ones."""
    buf = LOWER[buf]
    start, end = word_spans(buf, bounds, NOT_SPACE)
    raw, n_docs = buf.tobytes(), len(bounds) - 1
    of = np.searchsorted(start, bounds)
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes: list[int] = []
    sizes = np.zeros(n_docs, np.int64)
    starts, ends = start.tolist(), end.tolist()
    plain = np.ones(len(start), bool)  # whether one space stands between a word and the next
    if len(start) > 1:
        plain[:-1] = (start[1:] - end[:-1] == 1) & (buf[end[:-1]] == 32)
    odd = np.concatenate([[0], np.cumsum(~plain)])
    for d in range(n_docs):
        a, b = int(of[d]), int(of[d + 1])
        if a == b:
            continue
        size = min(words, b - a)
        if odd[b - 1] == odd[a]:
            shingles = [raw[s:e] for s, e in zip(starts[a : b - size + 1], ends[a + size - 1 : b], strict=True)]
        else:
            w = [raw[s:e] for s, e in zip(starts[a:b], ends[a:b], strict=True)]
            text = b" ".join(w)
            at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in w])])
            s, e = at[: b - a - size + 1].tolist(), (at[size:] - 1).tolist()
            shingles = [text[x:y] for x, y in zip(s, e, strict=True)]
        if distinct:
            shingles = set(shingles)
        hashes += [digest(x, seed) for x in shingles]
        sizes[d] = len(shingles)
    out = np.zeros(n_docs, np.uint64)
    filled = np.flatnonzero(sizes)
    if len(filled):
        h = np.array(hashes, np.uint64)
        first = (np.cumsum(sizes) - sizes)[filled]
        for bit in range(64):
            ones = np.add.reduceat((h >> np.uint64(bit) & np.uint64(1)).astype(np.int32), first)
            out[filled] |= (2 * ones > sizes[filled]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(documents: DataFrame, *, id_col="doc_id", text_col="text", keep: tuple[str, ...] = (), kinds: tuple[tuple[int, bool], ...] = ((WORDS, False),)) -> DataFrame:
    """id, the columns named in keep, and a fingerprint (64 bits as a signed long) for each kind (words, distinct): fp,
    and near for a second one."""
    fields = [f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in (id_col, *keep)]
    names = ["fp", "near"][: len(kinds)]

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[fingerprints_of(buf, bounds, *kind) for kind in kinds] for _, _, buf, bounds in binary_parts(batch.column(batch.num_columns - 1))]
            prints = [pa.array(np.concatenate([p[k] for p in parts]).view(np.int64) if parts else np.zeros(0, np.int64)) for k in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *prints], names=[id_col, *keep, *names])

    return documents.select(id_col, *keep, text_bytes(text_col).alias("text bytes")).mapInArrow(scan, ", ".join([*fields, *(f"{x} long" for x in names)]))


def forest(fp: np.ndarray, near: np.ndarray, radius: int, within: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among some fingerprints: memory in proportion to their number."""
    left = np.arange(1, len(fp))
    a, b, queue = [], [], [0]
    while queue or len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        k = queue.pop()
        hit = np.bitwise_count(fp[left] ^ fp[k]) <= radius
        if within < 64:
            hit &= np.bitwise_count(near[left] ^ near[k]) <= within
        found = left[hit]
        if len(found):
            a.append(np.full(len(found), k))
            b.append(found)
            queue += found.tolist()
            left = left[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def links_of(group: np.ndarray, fp: np.ndarray, near: np.ndarray, radius: int, within: int, heavy: int = HEAVY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of linked pairs inside each group of rows sorted by group."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(group)]]))
    small = np.repeat(size <= SMALL, size)
    for d in range(1, min(SMALL, len(group))):
        hit = np.flatnonzero((group[d:] == group[:-d]) & small[d:] & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= radius) & (np.bitwise_count(near[d:] ^ near[:-d]) <= within))
        if len(hit):
            yield hit, hit + d
    for k in np.flatnonzero(size > SMALL):
        own = np.arange(first[k], first[k] + size[k])
        stretches = [None]
        if size[k] > heavy:
            edges = np.linspace(0, 64, radius + 2).astype(int)
            stretches = [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for part in stretches:
            value = np.zeros(len(own), np.uint64) if part is None else fp[own] >> part[0] & part[1]
            order = np.argsort(value, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], value[order][1:] != value[order][:-1]]))
            for a, b in zip(cut, [*cut[1:], len(own)], strict=True):
                rows = own[order[a:b]]
                x, y = forest(fp[rows], near[rows], radius, within)
                if len(x):
                    yield rows[x], rows[y]


def links(nodes: DataFrame, *, radius: int = RADIUS, within: int = 64) -> DataFrame:
    """From distinct nodes (node, fp, near): pairs (a, b) of nodes, a < b, with fp within the radius and near within the
    second distance; enough of them to connect all that are linked."""
    n, tables = buckets_for(nodes), np.array(masks(radius), np.uint64)
    layout = (("table", np.uint8), ("node", np.int64), ("fp", np.uint64), ("near", np.uint64))[: 4 if within < 64 else 3]
    width = sum(np.dtype(t).itemsize for _, t in layout)
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])

    def key_of(table: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return mix((fp & tables[table]) + (table.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))

    @trimmed
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                cols = {"node": part.column(0).to_numpy(), "fp": part.column(1).to_numpy().view(np.uint64), "near": part.column(2).to_numpy().view(np.uint64)}
                cols = {name: np.tile(x, len(tables)) for name, x in cols.items()}
                cols["table"] = np.repeat(np.arange(len(tables)), part.num_rows)
                order, at = split_by(bucket_of(key_of(cols["table"], cols["fp"]), n), n)
                full = np.flatnonzero(np.diff(at))
                cols = {name: cols[name][order].astype(t) for name, t in layout}
                blobs = [b"".join(cols[name][at[b] : at[b + 1]].tobytes() for name, _ in layout) for b in full]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.zeros(len(full)), pa.int32()), pa.array(blobs, pa.binary())], schema=schema)

    @trimmed
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = by_bucket(batches)
        if not rows:
            return
        cols = {name: [] for name, _ in layout}
        for r in rows:
            count, at = len(r["blob"]) // width, 0
            for name, t in layout:
                cols[name].append(np.frombuffer(r["blob"], t, count, at))
                at += count * np.dtype(t).itemsize
        cols = {name: np.concatenate(x) for name, x in cols.items()}
        cell = key_of(cols["table"], cols["fp"])
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        alone = np.ones(len(cell), bool)
        alone[1:] &= cell[1:] != cell[:-1]
        alone[:-1] &= cell[1:] != cell[:-1]
        order, cell = order[~alone], cell[~alone]
        node, fp = cols["node"][order], cols["fp"][order]
        near = cols["near"][order] if "near" in cols else np.zeros(len(fp), np.uint64)
        for a, b in links_of(cell, fp, near, radius, within):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], names=["a", "b"])

    rows = nodes.select("node", "fp", F.col("near") if "near" in nodes.columns else F.lit(0).cast("long").alias("near"))
    return dealt(rows.mapInArrow(deal, "bucket int, kind int, blob binary"), n).mapInArrow(compare, "a long, b long").where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node on an edge (a, b). Alternates large and small stars until
    the edges stay the same; each round joins aggregated minima, so a node of any degree costs its edges only once."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        side = both.where("v > u") if large else both.where("v < u").unionByName(both.select("u", F.col("u").alias("v")).distinct())
        moved = side.join(least, "u").select(F.least("v", "m").alias("a"), F.greatest("v", "m").alias("b"))
        return moved.where("a != b").distinct()

    now = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct())
    sign = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())
    before = sign(now)
    while True:
        was, now = now, checkpointed(star(star(now, True), False))
        drop(was)
        after = sign(now)
        if after == before:
            break
        before = after
    stars = now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    out = checkpointed(stars.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()))
    drop(now)
    return out


def label(prints: DataFrame, *, id_col="doc_id", radius: int = RADIUS, within: int = 64) -> DataFrame:
    """prints with component_id, the smallest id of the component, and group, which is never null."""
    both = ["fp", "near"] if "near" in prints.columns else ["fp"]
    node = F.xxhash64("fp", "near") if len(both) > 1 else F.col("fp")
    nodes = checkpointed(prints.groupBy(*both).agg(F.min(id_col).alias("least")).withColumn("node", node))
    roots = components(links(nodes, radius=radius, within=within))
    rooted = checkpointed(nodes.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select(*both, "least", F.coalesce("root", "node").alias("group"), F.col("root").isNull().alias("alone")))
    # the least id of a group is a table of its own, so that a join of a large group can be split over tasks
    least = checkpointed(rooted.where("NOT alone").groupBy("group").agg(F.min("least").alias("component_id")))
    names = checkpointed(rooted.where("alone").select(*both, "group", F.col("least").alias("component_id")).unionByName(rooted.where("NOT alone").join(least, "group").select(*both, "group", "component_id")))
    drop(nodes, roots, rooted, least)
    return prints.join(names, both)


def near_duplicates(documents: DataFrame, *, id_col="doc_id", text_col="text", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """id, fp and component_id, one row per document."""
    prints = checkpointed(fingerprints(documents, id_col=id_col, text_col=text_col, kinds=((words, False),)))
    return label(prints, id_col=id_col, radius=radius).select(id_col, "fp", "component_id")


def shingle_sets(buf: np.ndarray, bounds: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of every text of a part, in order and those in `often` last, and bounds of the texts.
    A text of fewer words is one shingle."""
    low = LOWER[buf]
    start, end = word_spans(low, bounds, NOT_SPACE)
    w = span_hash(prefix_hash(low), start, end)
    of = np.searchsorted(start, bounds)
    n_docs = len(bounds) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(of))
    place = np.arange(len(w))
    h = np.zeros(len(w), np.uint64)
    for k in range(GROUP_WORDS):
        inside = place + k < of[doc + 1]
        h[inside] += mix(w[place[inside] + k] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    full = (place == of[doc]) | (place + GROUP_WORDS <= of[doc + 1])
    h, doc = mix(h[full]), doc[full]
    late = np.zeros(len(h), np.int64)
    if len(often):
        late = (often[np.minimum(np.searchsorted(often, h), len(often) - 1)] == h).astype(np.int64)
    order = np.lexsort((h, 2 * doc + late))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[first], np.searchsorted(doc[first], np.arange(n_docs + 1))


def node_of(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A name for each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(_NODE)), dtype=np.uint64)])
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


_NODE = 0x5851F42D4C957F2D


def frequent(documents: DataFrame, text_col: str) -> np.ndarray:
    """Sorted hashes of shingles that OFTEN distinct texts of a sample hold: one text of RATE, or SAMPLED if that is more."""
    rate = max(1, min(RATE, documents.count() // SAMPLED))
    texts = documents.where(F.pmod(F.xxhash64(text_col), F.lit(rate)) == 0).select(text_bytes(text_col).alias("t")).distinct()

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, bounds in binary_parts(batch.column(0)):
                h, c = np.unique(shingle_sets(buf, bounds, np.zeros(0, np.uint64))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    counted = texts.mapInArrow(scan, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= OFTEN)
    return np.sort(counted.orderBy(F.desc("c"), "h").limit(1 << 20).select("h").toArrow()["h"].to_numpy().view(np.uint64))


class Seen:
    """The values that a task met last, one for each slot: what it has just handed on needn't go again."""

    def __init__(self, slots: int = 1 << 16):
        self.held = np.zeros(slots, np.int64)

    def fresh(self, value: np.ndarray) -> np.ndarray:
        """Places of the values that aren't held, each value once."""
        own, first = np.unique(value, return_index=True)
        slot = (mix(own.view(np.uint64)) % np.uint64(len(self.held))).astype(np.int64)
        new = self.held[slot] != own
        self.held[slot] = own
        return np.sort(first[new])


def picked(h: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the sets, in the same form."""
    size = np.diff(at)[rows]
    bounds = np.concatenate([[0], np.cumsum(size)])
    return h[np.arange(bounds[-1]) - np.repeat(bounds[:-1], size) + np.repeat(at[rows], size)], bounds


_ENTRY = np.dtype([("key", "<u8"), ("node", "<i8"), ("size", "<i4")])


def sharing(rows: DataFrame, id_type: str, often) -> DataFrame:
    """From rows (id, h, t: bytes of a text): one row (id, h, node, size, map, fp, near) for each different (id, h), and groups
    (grp, node) of at least two nodes such that all similar pairs have a group in common."""
    n = buckets_for(rows)
    nulls = lambda count, *types: [pa.nulls(count, t) for t in types]
    names = ["bucket", "blob", "id", "h", "node", "size", "map", "fp", "near"]
    order_out, longs = ["grp", *names[4:5], *names[2:4], *names[5:]], (pa.int64(),) * 2
    rows = rows.withColumn("row", F.xxhash64("id", "h"))

    @trimmed
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, nodes = Seen(), Seen()
        for batch in batches:
            for low, high, buf, bounds in binary_parts(batch.column(2)):
                h, at = shingle_sets(buf, bounds, often.value)
                node, size, row = node_of(h, at), np.diff(at), batch.column(3).to_numpy()[low:high]
                new = documents.fresh(row)
                maps = maps_of(*picked(h, at, new))
                texts = picked(buf, bounds, new)
                prints = [pa.array(fingerprints_of(*texts, *kind).view(np.int64)) for kind in PRINTS]
                own = [batch.column(k).slice(low, high - low).take(pa.array(new)) for k in (0, 1)]
                place = bucket_of(mix(row[new].view(np.uint64)), n)
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), *nulls(len(new), pa.binary()), *own, pa.array(node[new]), pa.array(size[new]), pa.array(maps, pa.binary()), *prints], names=names)
                new = nodes.fresh(node)
                head = np.where(size[new] > 0, size[new] - -(-PART_OF * size[new] // WHOLE_OF) + 1, 0)
                of = np.repeat(new, head)
                out = np.empty(len(of), _ENTRY)
                out["key"] = h[np.arange(len(of)) - np.repeat(np.cumsum(head) - head, head) + at[of]]
                out["node"], out["size"] = node[of], size[of]
                order, edge = split_by(bucket_of(out["key"], n), n)
                out = out[order]
                full = np.flatnonzero(np.diff(edge))
                blobs = pa.array([out[edge[b] : edge[b + 1]].tobytes() for b in full], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), blobs, *nulls(len(full), batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.binary(), *longs)], names=names)

    @trimmed
    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, id_of = [], None
        for batch in batches:
            id_of = batch.column(2).type
            kept = batch.filter(batch.column(1).is_null())
            if kept.num_rows:
                yield pa.RecordBatch.from_arrays([*nulls(kept.num_rows, pa.int64()), *(kept.column(k) for k in (4, 2, 3, 5, 6, 7, 8))], names=order_out)
            blobs += [x.as_py() for x in batch.column(1) if x.is_valid]
        for name, node in grouped(np.frombuffer(b"".join(blobs), _ENTRY)):
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(node), *nulls(len(name), id_of, pa.int64(), pa.int64(), pa.binary(), *longs)], names=order_out)

    fields = f"id {id_type}, h long"
    packed = rows.select("id", "h", "t", "row").mapInArrow(deal, f"bucket int, blob binary, {fields}, node long, size long, map binary, fp long, near long")
    return dealt(packed, n).mapInArrow(group, f"grp long, node long, {fields}, size long, map binary, fp long, near long")


def grouped(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups (name, node) of the nodes that share a key, as far as their sizes allow them to be similar. Groups of the same
    nodes get the same name and come once."""
    key, node, size = (rows[c] for c in ("key", "node", "size"))
    order = np.lexsort((node, key))
    key, node, size = key[order], node[order], size[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node, size = key[first], node[first], size[first]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
    many = np.diff(at)
    two = np.flatnonzero(many == 2)
    a, b = at[two], at[two] + 1
    good = WHOLE_OF * np.minimum(size[a], size[b]) >= PART_OF * np.maximum(size[a], size[b])
    yield _named(np.unique(np.stack([node[a[good]], node[b[good]]], 1), axis=0))
    met: set[int] = set()

    def once(nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        name, own = _named(np.sort(nodes)[None, :])
        if len(own) > 1 and int(name[0]) not in met:
            met.add(int(name[0]))
            yield name, own

    for k in np.flatnonzero(many > 2):
        own = np.arange(at[k], at[k + 1])
        own = own[np.argsort(size[own], kind="stable")]
        block = np.cumsum(np.maximum(size[own].astype(np.int64), SHINGLES // TOGETHER)) // SHINGLES
        if block[-1] < 2:
            yield from once(node[own])
            continue
        blocks = np.split(own, np.flatnonzero(np.diff(block)) + 1)
        with_less = False
        for x, left in enumerate(blocks):
            near = [b for b in blocks[x + 1 :] if WHOLE_OF * size[left[-1]] >= PART_OF * size[b[0]]]
            for right in near:
                yield from once(node[np.concatenate([left, right])])
            if not near and not with_less:
                yield from once(node[left])
            with_less = bool(near)


def _named(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name and node of each place of some groups of equally many sorted nodes."""
    names = mix(mix(groups.view(np.uint64)).sum(1, dtype=np.uint64)).view(np.int64)
    return np.repeat(names, groups.shape[1]), np.ascontiguousarray(groups).ravel()


def similar(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the similar pairs among some sorted sets. A pair is compared unless its sizes, or the parities
    of its shingles in a bit map (no more bits differ than shingles do), rule it out."""
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum(size)])
    width = 64 * int(min(16, max(1, -(-2 * int(np.median(size)) // 64))))
    bits = np.zeros((len(sets), width // 64), np.uint64)
    if len(sets) > 2:
        for low in range(0, len(sets), 256):
            part = flat[at[low] : at[min(low + 256, len(sets))]]
            row = np.repeat(np.arange(len(size[low : low + 256])), size[low : low + 256])
            odd = np.bincount(row * width + (part % np.uint64(width)).astype(np.int64), minlength=len(size[low : low + 256]) * width) & 1
            bits[low : low + 256] = np.packbits(odd.astype(bool).reshape(-1, width), axis=1, bitorder="little").view(np.uint64)
    left, queue, a, b = np.arange(1, len(sets)), [0], [], []
    while queue or len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        k = queue.pop()
        both = size[left] + size[k]
        near = (WHOLE_OF * np.minimum(size[left], size[k]) >= PART_OF * np.maximum(size[left], size[k])) & (np.bitwise_count(bits[left] ^ bits[k]).sum(1, dtype=np.int64) * (PART_OF + WHOLE_OF) <= both * (WHOLE_OF - PART_OF))
        maybe = np.flatnonzero(near)
        if not len(maybe) or not size[k]:
            continue
        other = np.concatenate([sets[j] for j in left[maybe]])
        hit = sets[k][np.minimum(np.searchsorted(sets[k], other), size[k] - 1)] == other
        common = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(size[left[maybe]])[:-1]]))
        found = maybe[common * (PART_OF + WHOLE_OF) >= PART_OF * both[maybe]]
        if len(found):
            a.append(np.full(len(found), k))
            b.append(left[found])
            queue += left[found].tolist()
            left = np.delete(left, found)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def maps_of(h: np.ndarray, at: np.ndarray) -> list[bytes]:
    """For each set, the parity of the number of its shingles at each of some places: about as many as shingles, a power of
    two. No more bits of two maps differ than shingles do."""
    size = np.diff(at)
    width = np.clip(1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), 64, MAP)
    out = [b""] * len(size)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        for low in range(0, len(own), 256):
            part = own[low : low + 256]
            count = size[part]
            row = np.repeat(np.arange(len(part)), count)
            shingle = h[np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[part], count)]
            odd = np.bincount(row * w + (shingle % np.uint64(w)).astype(np.int64), minlength=len(part) * w) & 1
            bits = np.packbits(odd.astype(bool).reshape(-1, w), axis=1, bitorder="little")
            for k, x in zip(part.tolist(), bits, strict=True):
                out[k] = x.tobytes()
    return out


class Maps:
    """The maps of a group's sets. Of two maps the wider one is folded to the other one's width, which keeps parities."""

    def __init__(self, size: np.ndarray, maps: list[bytes]):
        self.size, self.words = size, np.array([len(x) // 8 for x in maps], np.int64)
        self.at: dict[int, np.ndarray] = {}
        for w in np.unique(self.words).tolist():
            table = np.zeros((len(maps), w), np.uint64)
            for k in np.flatnonzero(self.words == w):
                table[k] = np.frombuffer(maps[k], np.uint64)
            for k in np.flatnonzero(self.words == 2 * w):
                wide = np.frombuffer(maps[k], np.uint64)
                table[k] = wide[:w] ^ wide[w:]
            self.at[w] = table

    def maybe(self, k: int, others: np.ndarray) -> np.ndarray:
        """Places in others of the sets that sizes and maps allow to be similar to set k; similar sets differ in width by
        a factor of two at most."""
        size, w = self.size, int(self.words[k])
        place = np.flatnonzero(WHOLE_OF * np.minimum(size[others], size[k]) >= PART_OF * np.maximum(size[others], size[k]))
        differ = np.zeros(len(place), np.int64)
        less = self.words[others[place]] < w
        for rows, width in ((~less, w), (less, w // 2)):
            if rows.any():
                differ[rows] = np.bitwise_count(self.at[width][others[place[rows]]] ^ self.at[width][k]).sum(1, dtype=np.int64)
        return place[differ * (PART_OF + WHOLE_OF) <= (size[others[place]] + size[k]) * (WHOLE_OF - PART_OF)]


def narrowed(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Groups split so that all pairs that sizes and maps don't rule out stay together; nodes without such a pair go."""
    members = groups.join(nodes.select("node", "size", "map"), "node").select("grp", "node", "size", "map").repartition(buckets_for(groups), "grp").sortWithinPartitions("grp")

    @trimmed
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(rows: list[tuple]) -> Iterator[tuple[int, int]]:
            node = np.array([r[0] for r in rows], np.int64)
            maps = Maps(np.array([r[1] for r in rows], np.int64), [r[2] for r in rows])
            left = np.arange(len(rows))
            while len(left):
                queue, left, own = [int(left[0])], left[1:], [int(left[0])]
                while queue and len(left):
                    place = maps.maybe(queue.pop(), left)
                    own += left[place].tolist()
                    queue += left[place].tolist()
                    left = np.delete(left, place)
                if len(own) > 1:
                    name, nodes = _named(np.sort(node[own])[None, :])
                    yield from zip(name.tolist(), nodes.tolist(), strict=True)

        now, rows, out = None, [], []
        for batch in batches:
            for g, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != now:
                    out += parts(rows)
                    rows = []
                now = g
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["grp", "node"])
            out = []
        out += parts(rows)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["grp", "node"])

    return members.mapInArrow(split, "grp long, node long").distinct()


def meeting(nodes: DataFrame) -> DataFrame:
    """From nodes (node, fp, near): groups (grp, node) that the covering tables connect. One of more than 2 TOGETHER nodes is
    dealt into several by hash; what that separates is left to the search for the rest."""
    roots = components(links(nodes, radius=MEET, within=APART))
    large = checkpointed(roots.groupBy("root").agg(F.ceil(F.count("*") / TOGETHER).alias("parts")).where("parts > 2"))
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    out = checkpointed(roots.join(large, "root", "left").select(F.xxhash64("root", part).alias("grp"), "node"))
    drop(roots, large)
    return out


def similar_pairs(groups: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """From groups (grp, node) and sets (node, shingles): pairs (a, b) of similar nodes, enough of them to connect all that
    are linked."""
    members = groups.join(sets, "node").select("grp", "node", "shingles").repartition(n, "grp").sortWithinPartitions("grp")

    @trimmed
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(node: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
            x, y = similar(held)
            n = np.array(node, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(n[x], n[y])), pa.array(np.maximum(n[x], n[y]))], names=["a", "b"])

        now, node, held = None, [], []
        for batch in batches:
            for g, i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if g != now and held:
                    yield pairs(node, held)
                    node, held = [], []
                now = g
                node.append(i)
                held.append(np.sort(np.frombuffer(s.as_py(), np.uint64)))
        if held:
            yield pairs(node, held)

    return members.mapInArrow(compare, "a long, b long").distinct()


def keep_first(documents: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """One document of each group: that of the smallest id (a null id comes last), of several the smallest text hash.
    Rows equal in both are one document."""
    marked = documents.withColumn("text hash", F.xxhash64(text_col))
    often = documents.sparkSession.sparkContext.broadcast(frequent(documents, text_col))
    id_type = documents.schema[id_col].dataType.simpleString()
    texts = marked.select(F.col(id_col).alias("id"), F.col("text hash").alias("h"), text_bytes(text_col).alias("t"))
    shared = checkpointed(sharing(texts, id_type, often))
    # copies are folded before the groups are, so that only distinct sets meet in a group
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("k")
    nodes = checkpointed(shared.where("grp IS NULL").groupBy("node").agg(least, *(F.max(c).alias(c) for c in ("size", "map", "fp", "near"))))
    groups = checkpointed(narrowed(shared.where("grp IS NOT NULL").select("grp", "node").distinct(), nodes))
    drop(shared)
    met = meeting(nodes)
    near = checkpointed(narrowed(met, nodes))
    drop(met)

    @trimmed
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, buf, bounds in binary_parts(batch.column(1)):
                h, at = shingle_sets(buf, bounds, np.zeros(0, np.uint64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer((8 * at).astype(np.int32)), pa.py_buffer(h)])], names=["node", "shingles"])

    # the texts that are still to be compared are read again: their sets are several times as large as the groups
    asked = checkpointed(near.select("node").union(groups.select("node")).distinct().join(nodes, "node").select("node", F.col("k.id").alias("asked id"), F.col("k.h").alias("asked h")))
    found = texts.join(asked, texts["id"].eqNullSafe(asked["asked id"]) & (texts["h"] == asked["asked h"])).select("node", "t").dropDuplicates(["node"])
    sets = checkpointed(found.mapInArrow(scan, "node long, shingles binary"))
    n = buckets_for(documents)
    # what the tables connect is compared first, and the other groups only if this leaves them in several components
    some = checkpointed(similar_pairs(near, sets, n))
    known = components(some)
    now = groups.join(known, "node", "left").select("grp", "node", F.coalesce("root", "node").alias("root"))
    open_ = now.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("grp")
    rest = checkpointed(similar_pairs(groups.join(open_, "grp", "left_semi"), sets, n))
    roots = components(some.unionByName(rest))
    first = nodes.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("k").alias("k"))
    first = checkpointed(first.select(F.col("k.id").alias("kept id"), F.col("k.h").alias("kept hash")))
    drop(nodes, groups, near, asked, sets, some, known, rest, roots)
    kept = marked.join(first, marked[id_col].eqNullSafe(first["kept id"]) & (marked["text hash"] == first["kept hash"]), "left_semi")
    return kept.dropDuplicates([id_col, "text hash"]).select(*documents.columns)


def report(documents: DataFrame) -> DataFrame:
    """The registered query's columns."""
    return near_duplicates(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

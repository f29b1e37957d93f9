"""Linking of near-duplicates: banded signatures, candidate clusters, exact Jaccard on whole sets, distributed union-find.

A source of ``Flush``es names each distinct item of a task by a 64-bit ``node`` with its MinHash coordinates, and the
*places* where nodes stand. The steps:

1. Bands. Each item gives one entry (band key, node, one bit each of 64 coordinates) a band. Entries leave a task as
   packed arrays, one for each partition of keys, so that no row is made for each of them. Within a flush, members of a crowded
   key that look alike are held against its first one only, and only that one goes on: a group of copies of any size reaches a
   partition as a few rows a task.
2. Buckets. Within a key all pairs are looked at by their bits, in small buckets one by one; large buckets are split by slices of
   the bits first, and what is still large is held against centers. A pair is a candidate where the bits agree as
   the similarity asks, less 4.5 standard deviations, and where it shares two bands, or agrees within 1.5 deviations. Of the latter a
   bucket gives a forest only: what is joined by it is compared anyway.
3. Clusters. Components of the candidate pairs. A cluster of bounded size goes, each text once, to one task, which finds the
   exact similarity of all its pairs. In a larger one the candidates are measured first and those below ``LOOSE`` go, which takes
   apart what chance has joined; what is still large is compared in random blocks of bounded size, and what is then outside
   the cluster's largest component with all blocks.

What can be missed are pairs without a common bucket (``collisions``); pairs whose bits agree on 4.5 standard
deviations less than their similarity gives on average, 2 in 100,000 of those at exactly 0.75, and of those that share one band only pairs
below 1.5 deviations; and pairs that large buckets alone have in common, where neither a slice nor a center brings them together. Nothing is
gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release, sized_broadcast, texts
from .hashing import mix

#: Members of a bucket of which all pairs are looked at; of a key in a flush from which it is crowded.
SMALL, CROWDED = 32, 16
#: Nodes and characters of a cluster that one task compares; larger ones go in blocks of this size.
CLUSTER, CLUSTER_CHARS = 512, 4 << 20
#: Members of large buckets that are split by slices of the bits at a time.
SLICED = 20_000
#: Entries that one task of the bucket step sorts.
ENTRIES = 2_500_000
#: Edges up to which one task joins them (16 MB); beyond, rounds of joins do.
EDGES = 1_000_000
#: Distinct shingles multiplied at a time when a cluster is compared; the share of its texts up to which a shingle's are paired one by one.
COLUMNS, SPARSE = 4096, 0.05

#: Percentage of similarity below which a candidate doesn't hold a large cluster together.
LOOSE = 30

ENTRY, PLACE, PAIR = 0, 1, 2
BLOBS = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("blob", pa.binary())])
ROWS = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("z", pa.int64()), ("w", pa.int64()), ("kind", pa.int8())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class Flush(NamedTuple):
    """Distinct items: node and coordinates; and places: four longs each, the third being the node."""

    nodes: np.ndarray
    signatures: np.ndarray
    places: np.ndarray


class Bits(NamedTuple):
    """Agreeing bits of 64 from which a pair of shared bands is a candidate, and from which one band is enough."""

    least: int
    alone: int

    @classmethod
    def of(cls, percent: int) -> Bits:
        p = (1 + percent / 100) / 2
        dev = (64 * p * (1 - p)) ** 0.5
        return cls(int(64 * p - 4.5 * dev), int(64 * p - 1.5 * dev))


def collisions(n_bands: int, rows: int, similarity: float) -> float:
    """Chance that two items of this similarity share a bucket."""
    return 1 - (1 - similarity**rows) ** n_bands


def band_keys(signatures: np.ndarray, n_bands: int) -> np.ndarray:
    """One 64-bit key for each band of each row of a signature matrix."""
    n, width = signatures.shape
    rows = width // n_bands
    out = np.empty((n, n_bands), np.uint64)
    for b in range(n_bands):
        key = np.full(n, mix(np.array([b], np.uint64), 9)[0])
        for k in range(rows):
            key = mix(key ^ signatures[:, b * rows + k].astype(np.uint64), 10 + k)
        out[:, b] = key
    return out


def minis(signatures: np.ndarray) -> np.ndarray:
    """One bit of each of the first 64 coordinates of each row, mixed, in one integer."""
    bits = ((signatures[:, :64].astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 64 - np.bitwise_count(x ^ y).astype(np.int64)


def _packed(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal rows begin, and how long they are."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(new)))


def packed_places(places: np.ndarray) -> bytes:
    """Places, of which many in a row are of one document: its two longs and the number of its places, then node and fourth value of each."""
    starts, sizes = _runs(places[:, 0], places[:, 1])
    return _packed(np.array([len(starts)], np.int64), places[starts, 0], places[starts, 1], sizes, places[:, 2], places[:, 3].astype(np.int32))


def unpacked_places(raw: bytes) -> tuple[np.ndarray, ...]:
    m = int(np.frombuffer(raw, np.int64, 1)[0])
    x, y, sizes = np.frombuffer(raw, np.int64, 3 * m, 8).reshape(3, m)
    n, at = int(sizes.sum()), 8 + 24 * m
    return np.repeat(x, sizes), np.repeat(y, sizes), np.frombuffer(raw, np.int64, n, at), np.frombuffer(raw, np.int32, n, at + 8 * n).astype(np.int64)


def packed_entries(key: np.ndarray, node: np.ndarray, bit: np.ndarray, sizes: np.ndarray) -> bytes:
    """32 bits of each key, and a bit that says whether it begins a run of entries of one node; of each run the node and its bits."""
    begins = np.zeros(len(key), bool)
    begins[np.cumsum(sizes) - sizes] = True
    return _packed(np.array([len(key)], np.uint32), key.astype(np.uint32), node, bit, np.packbits(begins))


def unpacked_entries(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    at = 4 + 4 * n
    m = (len(raw) - at - (n + 7) // 8) // 16
    run = np.cumsum(np.unpackbits(np.frombuffer(raw, np.uint8, offset=at + 16 * m), count=n), dtype=np.int64) - 1
    return np.frombuffer(raw, np.uint32, n, 4), np.frombuffer(raw, np.int64, m, at)[run], np.frombuffer(raw, np.uint64, m, at + 8 * m)[run]


def emitted(flushes: Iterator[Flush], n_bands: int, parts: int, percent: int, task: int) -> Iterator[pa.RecordBatch]:
    """The blobs of a task's flushes."""
    bits = Bits.of(percent)
    for turn, (nodes, signatures, places) in enumerate(flushes):
        away = (task + turn) % parts
        rows = [(away, PLACE, packed_places(places))] if len(places) else []
        if len(nodes):
            key, bit = band_keys(signatures, n_bands).ravel(), minis(signatures)
            at = np.repeat(np.arange(len(nodes)), n_bands)
            key, at, pairs = _combined(key, at, nodes, bit, bits)
            if len(pairs[0]):
                rows.append((away, PAIR, _packed(*pairs)))
            part = ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.uint32)
            order = np.argsort(part, kind="stable")
            key, at, part = key[order], at[order], part[order]
            starts, sizes = _runs(part, at)
            node, bit = nodes[at[starts]], bit[at[starts]]
            cuts, inner = (np.searchsorted(x, np.arange(parts + 1)) for x in (part, part[starts]))
            rows += [(p, ENTRY, packed_entries(key[i:j], node[r:s], bit[r:s], sizes[r:s])) for p, (i, j, r, s) in enumerate(zip(cuts, cuts[1:], inner, inner[1:])) if j > i]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), BLOBS)], schema=BLOBS)
    release()


def _combined(key: np.ndarray, at: np.ndarray, nodes: np.ndarray, bit: np.ndarray, bits: Bits):
    """Without the members of crowded keys that look like their first one: those become pairs with it."""
    none = np.zeros(0, np.int64)
    slots = (key >> np.uint64(46)).astype(np.int64)
    few = np.flatnonzero(np.bincount(slots, minlength=1 << 18)[slots] >= CROWDED)
    if not len(few):
        return key, at, (none, none, none)
    few = few[np.lexsort((at[few], key[few]))]
    k = key[few]
    starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    size = np.diff(np.append(starts, len(k)))
    head = np.repeat(few[starts], size)
    alike = agreeing(bit[at[few]], bit[at[head]])
    gone = (np.repeat(size, size) >= CROWDED) & (few != head) & (alike >= bits.alone)
    a, b, n = nodes[at[head[gone]]], nodes[at[few[gone]]], alike[gone]
    keep = np.ones(len(key), bool)
    keep[few[gone]] = False
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((hi, lo))
    lo, hi, n = lo[order], hi[order], n[order]
    fresh = np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))[: len(lo)]
    return key[keep], at[keep], (lo[fresh], hi[fresh], n[fresh])


def _grouped(order_by: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by the last of the arrays, then the others; starts and sizes of the groups of the last one."""
    order = np.lexsort(order_by)
    k = order_by[-1][order]
    starts = np.flatnonzero(np.append(True, k[1:] != k[:-1])[: len(k)])
    return order, starts, np.diff(np.append(starts, len(k)))


def _all_pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs within groups of rows that lie together, by their distance."""
    end = np.repeat(starts + sizes, sizes)
    at = np.arange(len(end)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    d = 1
    while len(at):
        left = at + d < end
        at, end = at[left], end[left]
        if len(at):
            yield at, at + d
        d += 1


def forest(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places of those of the edges (i, j) that join all that they all join: for each j its smallest i, then what is still apart."""
    kept = []
    left = np.arange(len(i))
    a, b = i, j
    while len(left):
        order = np.lexsort((a[left], b[left]))
        first = left[order][np.append(True, b[left][order][1:] != b[left][order][:-1])]
        kept.append(first)
        ids, root = roots(i[np.concatenate(kept)], j[np.concatenate(kept)])
        of = np.arange(max(i.max(), j.max()) + 1)
        of[ids] = root
        a, b = np.minimum(of[i], of[j]), np.maximum(of[i], of[j])
        left = left[a[left] != b[left]]
    return np.concatenate(kept) if kept else left


def bucket_pairs(key: np.ndarray, node: np.ndarray, bit: np.ndarray, bits: Bits) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows that share a key and whose bits agree, each once; of those that agree well, a forest."""
    strong, weak = [], []

    def sort(i: np.ndarray, j: np.ndarray) -> None:
        alike = agreeing(bit[i], bit[j])
        i, j = np.minimum(i, j), np.maximum(i, j)
        for out, mine in ((strong, alike >= bits.alone), (weak, (alike >= bits.least) & (alike < bits.alone))):
            out.append((i[mine], j[mine]))

    def look(order: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        for i, j in _all_pairs(starts, sizes):
            sort(order[i], order[j])

    def held(rows: np.ndarray) -> None:
        while len(rows) > 1:
            sort(np.full(len(rows) - 1, rows[0]), rows[1:])
            rows = rows[1:][agreeing(bit[rows[1:]], bit[rows[:1]]) < bits.alone]

    order, starts, sizes = _grouped((node, key))
    small = sizes <= SMALL
    look(order, starts[small], sizes[small])
    starts, sizes = starts[~small], sizes[~small]
    turn = np.cumsum(sizes) // SLICED
    for t in np.unique(turn):  # large buckets together; slices of one that is larger still one after the other
        mine = turn == t
        rows = np.concatenate([order[s : s + m] for s, m in zip(starts[mine], sizes[mine])])
        bucket = np.repeat(np.arange(mine.sum()) * 8, sizes[mine])
        for slices in [np.arange(8)] if len(rows) <= 2 * SLICED else np.arange(8)[:, None]:
            piece = (bit[rows] >> (8 * slices[:, None]).astype(np.uint64)) & np.uint64(255)
            piece = ((bucket + slices[:, None]) << 8 | piece.astype(np.int64)).ravel()
            each = np.tile(rows, len(slices))
            inner, first, many = _grouped((node[each], piece))
            inner = each[inner]
            fit = many <= SMALL
            look(inner, first[fit], many[fit])
            for x, n in zip(first[~fit], many[~fit]):
                held(inner[x : x + n])
    none = np.zeros(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*strong)) if strong else (none, none)
    tree = forest(i, j)
    i, j = i[tree], j[tree]
    p, q = (np.concatenate(x) for x in zip(*weak)) if weak else (none, none)
    if len(p):
        p, q = np.divmod(np.unique(p * len(key) + q), len(key))  # several slices find the same pair
        ids, root = roots(i, j)
        of = np.arange(len(key))
        of[ids] = root
        apart = of[p] != of[q]
        p, q = p[apart], q[apart]
    return np.concatenate([i, p]), np.concatenate([j, q])


def _rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    n = len(columns[0])
    filled = [pa.array(c, pa.int64()) for c in columns] + [pa.array(np.zeros(n, np.int64))] * (4 - len(columns))
    return pa.RecordBatch.from_arrays([*filled, pa.array(np.full(n, kind, np.int8))], schema=ROWS)


def _bucketed(percent: int):
    bits = Bits.of(percent)

    def bucketed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in it:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob")):
                raw = blob.as_buffer().to_pybytes()
                if kind == ENTRY:
                    held.append(unpacked_entries(raw))
                elif kind == PLACE:
                    yield _rows(PLACE, *unpacked_places(raw))
                else:
                    yield _rows(PAIR, *np.frombuffer(raw, np.int64).reshape(3, -1))
        if held:
            key, node, bit = zip(*held)
            held = []
            key = np.concatenate(key)
            node = np.concatenate(node)
            bit = np.concatenate(bit)
            order = (np.sort(key.astype(np.uint64) << np.uint64(32) | np.arange(len(key), dtype=np.uint64)) & np.uint64(2**32 - 1)).astype(np.int64)
            k = key[order]
            same = np.append(k[1:] == k[:-1], False)
            same[1:] |= same[:-1].copy()
            order = order[same]
            order = order[np.lexsort((node[order], key[order]))]
            fresh = np.append(True, (key[order][1:] != key[order][:-1]) | (node[order][1:] != node[order][:-1]))[: len(order)]
            order = order[fresh]  # a node that several tasks have counts once
            key, node, bit = key[order], node[order], bit[order]
            i, j = bucket_pairs(key, node, bit, bits)
            lo, hi, alike = np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), agreeing(bit[i], bit[j])
            for s in range(0, len(lo), 100_000):
                yield _rows(PAIR, *(c[s : s + 100_000] for c in (lo, hi, alike)))
        release()

    return bucketed


def banded(scratch: Scratch, items: DataFrame, source: Callable, n_bands: int, size: float, percent: int) -> tuple[DataFrame, DataFrame]:
    """Places (x, y, z, w) and candidate pairs (a, b). size: about how many items there are."""
    parts = max(4 * scratch.spark.sparkContext.defaultParallelism, int(size * n_bands) // ENTRIES + 1)

    def leave(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from emitted(source(it), n_bands, parts, percent, TaskContext.get().partitionId())

    blobs = items.mapInArrow(leave, "part int, kind tinyint, blob binary").repartitionById(parts, "part")
    rows = scratch.save(blobs.select("kind", "blob").mapInArrow(_bucketed(percent), "x long, y long, z long, w long, kind tinyint"))
    alone = Bits.of(percent).alone
    found = rows.where(F.col("kind") == PAIR).groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.count("*").alias("n"), F.max("z").alias("alike"))
    pairs = scratch.save(found.where((F.col("n") > 1) | (F.col("alike") >= alone)).select("a", "b"))
    places = rows.where(F.col("kind") == PLACE).select("x", "y", "z", "w")
    places._scratch_path = rows._scratch_path
    return places, pairs


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges, and the smallest node that each leads to."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    parent = np.arange(len(ids))
    while True:  # hook to the smallest neighbour, then jump: rounds grow with the logarithm of a path
        low = np.minimum(parent[a], parent[b])
        new = parent.copy()
        np.minimum.at(new, parent[a], low)
        np.minimum.at(new, parent[b], low)
        new = new[new]
        if (new == parent).all():
            return ids, ids[parent]
        parent = new


def _joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in it]
    if held:
        ids, root = roots(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root)], names=["node", "component"])


def _forest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as a forest: each node with its root."""
    a, b, n = [], [], 0

    def out():
        ids, root = roots(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(root[ids != root]), pa.array(ids[ids != root])], schema=LINKS)

    for batch in it:
        a.append(batch.column("a").to_numpy())
        b.append(batch.column("b").to_numpy())
        n += batch.num_rows
        if n >= EDGES:
            yield out()
            a, b, n = [], [], 0
    if n:
        yield out()


def components(scratch: Scratch, edges: DataFrame, bound: int | None = None) -> DataFrame:
    """(node, component) of every node of the edges (a, b); component is the smallest node reachable.

    Each task joins its own edges first. What is left is joined by one task up to a counted bound, beyond it in rounds of hooking every
    label to its smallest neighbour, two pointer jumps and contraction; a round shrinks every path by a constant
    factor, and nothing is gathered on the driver.
    """
    left = scratch.save(edges.where("a <> b").mapInArrow(_forest, "a long, b long"))
    m = left.count()
    if m <= (EDGES if bound is None else bound):
        return scratch.save(left.coalesce(1).mapInArrow(_joined, "node long, component long"))
    left = left.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    labels = None
    while m:
        hooks = scratch.save(left.groupBy("hi").agg(F.min("lo").alias("to")))
        k = hooks.count()
        for _ in range(2):
            ahead = hooks.select(F.col("hi").alias("to"), F.col("to").alias("then"))
            hooks = hooks.join(sized_broadcast(ahead, k), "to", "left").select("hi", F.coalesce("then", "to").alias("to"))
        hooks = scratch.save(hooks)
        own = hooks.select(F.col("hi").alias("node"), F.col("to").alias("component"))
        if labels is None:
            labels = own
        else:
            moved = labels.join(sized_broadcast(hooks, k), F.col("component") == F.col("hi"), "left").select("node", F.coalesce("to", "component").alias("component"))
            labels = scratch.save(moved.unionByName(own))
        one = sized_broadcast(hooks.select("hi", F.col("to").alias("p")), k)
        two = sized_broadcast(hooks.select(F.col("hi").alias("lo"), F.col("to").alias("q")), k)
        contracted = left.join(one, "hi").join(two, "lo", "left").select("p", F.coalesce("q", "lo").alias("q")).where("p <> q")
        left = scratch.save(contracted.select(F.greatest("p", "q").alias("hi"), F.least("p", "q").alias("lo")).distinct())
        m = left.count()
    own = labels.select(F.col("component").alias("node"), "component").distinct()
    return scratch.save(labels.unionByName(own))


def linked(sets: list[np.ndarray], percent: int, other: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the sets whose exact similarity reaches the percentage: i < j among one list, or i of the one and j of the other."""
    both = sets if other is None else sets + other
    n, sizes = len(sets), np.array([len(x) for x in both], np.int64)
    none = np.zeros(0, np.int64)
    if len(both) < 2 or not sizes.sum():
        return none, none
    if n == 2 and other is None:
        common = len(np.intersect1d(*sets, assume_unique=True))
        return (none, none) if not common or 100 * common < percent * (sizes.sum() - common) else (np.array([0]), np.array([1]))
    value = np.concatenate(both)
    order = np.argsort(value)
    value = value[order]
    new = np.append(True, value[1:] != value[:-1])
    shared = ~new | np.append(~new[1:], False)  # a shingle of one set only is in no intersection
    row, column = np.repeat(np.arange(len(both)), sizes)[order[shared]], np.cumsum(new[shared]) - 1
    rights = both if other is None else other
    common = np.zeros(n * len(rights))
    if SPARSE * len(both) >= 2:
        starts, holders = _runs(column)
        few = holders <= SPARSE * len(both)
        for p, q in _all_pairs(starts[few], holders[few]):
            i, j = np.minimum(row[p], row[q]), np.maximum(row[p], row[q])
            if other is not None:
                across = (i < n) & (j >= n)
                i, j = i[across], j[across] - n
            common += np.bincount(i * len(rights) + j, minlength=len(common))
        many = ~np.repeat(few, holders)
        row, column = row[many], np.repeat(np.cumsum(~few) - 1, holders)[many]
    common = common.reshape(n, len(rights))
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, COLUMNS):
        i, j = np.searchsorted(column, (at, at + COLUMNS))
        grid = np.zeros((len(both), min(COLUMNS, width - at)), np.float32)
        grid[row[i:j], column[i:j] - at] = 1
        common += grid[:n] @ (grid if other is None else grid[n:]).T
    size = sizes.astype(float)
    union = size[:n, None] + (size if other is None else size[n:])[None, :] - common
    hit = (common > 0) & (100 * common >= percent * union)
    i, j = np.nonzero(hit)
    return (i[i < j], j[i < j]) if other is None else (i, j)


def _edges(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=LINKS)


def _clusters(make_set: Callable[[str], np.ndarray], percent: int, keys: tuple[str, ...]):
    """Rows come by group (keys); what links the texts of a group comes out, as a forest."""

    def compare(node: list, sets: list, side: list) -> pa.RecordBatch:
        node, side = np.array(node, np.int64), np.array(side)
        left, right = np.flatnonzero(side <= 1), np.flatnonzero(side == 2)
        if len(right):
            i, j = linked([sets[x] for x in left], percent, [sets[x] for x in right])
            a, b = node[left[i]], node[right[j]]
        else:
            i, j = linked(sets, percent)
            a, b = node[i], node[j]
        if not len(a):
            return _edges([], [])
        ids, root = roots(a, b)
        return _edges(root[ids != root], ids[ids != root])

    def clusters(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, node, sets, side = None, [], [], []
        for batch in it:
            grown = []
            for key, n, s, text in zip(zip(*(batch.column(k).to_pylist() for k in keys)), batch.column("node").to_pylist(), batch.column("side").to_pylist(), batch.column("payload")):
                if key != last:
                    if len(node) > 1:
                        grown.append(compare(node, sets, side))
                    last, node, sets, side = key, [], [], []
                if node and node[-1] == n and side[-1] == s:  # the same text of equal rows
                    continue
                node.append(n)
                side.append(s)
                sets.append(make_set(text.as_py() or ""))
            yield from grown
        if len(node) > 1:
            yield compare(node, sets, side)
        release()

    return clusters


def _measurer(make_set: Callable[[str], np.ndarray], percent: int):
    schema = pa.schema([*LINKS, ("linked", pa.bool_())])

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of (a, b): two texts a pair, the pairs of one a together."""
        last, first, kept_id, kept = None, None, None, None
        for batch in it:
            out = []
            for a, b, node, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "node")), batch.column("payload")):
                if (a, b) != last:
                    last, first = (a, b), (node, text)
                    continue
                if first is None or first[0] == node:
                    continue
                mine, theirs = (first[1], text) if first[0] == a else (text, first[1])
                if kept_id != a:
                    kept_id, kept = a, make_set(mine.as_py() or "")
                other = make_set(theirs.as_py() or "")
                common = len(np.intersect1d(kept, other, assume_unique=True))
                union = len(kept) + len(other) - common
                if common and 100 * common >= LOOSE * union:
                    out.append((a, b, 100 * common >= percent * union))
                first = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        release()

    return measure


def measured(pairs: DataFrame, n: int, got: DataFrame, make_set, percent: int) -> DataFrame:
    """Those of the pairs (a, b), n of them, whose similarity is loose at least; linked where it is the percentage. got: (node, payload)."""
    ends = pairs.selectExpr("a", "b", "a as node").unionByName(pairs.selectExpr("a", "b", "b as node"))
    both = got.join(sized_broadcast(ends, 2 * n), "node").select("a", "b", "node", "payload")
    return both.repartition("a", "b").sortWithinPartitions("a", "b", "node").mapInArrow(_measurer(make_set, percent), "a long, b long, linked boolean")


def _sizes(got: DataFrame) -> DataFrame:
    """(cluster, blocks): in how many blocks of bounded size a cluster goes."""
    sizes = got.groupBy("cluster").agg(F.count("*").alias("m"), F.sum(F.length("payload")).alias("chars"))
    return sizes.select("cluster", F.ceil(F.greatest(F.col("m") / CLUSTER, F.col("chars") / CLUSTER_CHARS)).cast("long").alias("blocks"))


def _whole(got: DataFrame, make_set, percent: int, *keys: str) -> DataFrame:
    """The links within each group of the keys, compared by one task."""
    dealt = got.select(*keys, "node", F.lit(1).alias("side"), "payload").repartition(*keys).sortWithinPartitions(*keys, "node")
    return dealt.mapInArrow(_clusters(make_set, percent, keys), "a long, b long")


def _blocks(scratch: Scratch, own: DataFrame, make_set, percent: int) -> DataFrame:
    """The links within clusters of several blocks. own: (node, cluster, blocks, payload)."""
    own = scratch.save(own.withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), "blocks")))
    edges = scratch.save(_whole(own, make_set, percent, "cluster", "block"))
    labels = components(scratch, edges)
    slim = own.select("node", "cluster", F.length("payload").alias("chars"))
    placed = scratch.save(slim.join(labels, "node", "left").select("node", "cluster", "chars", F.coalesce("component", "node").alias("component")))
    main = placed.groupBy("cluster", "component").agg(F.count("*").alias("m")).groupBy("cluster").agg(F.max_by("component", F.struct("m", "component")).alias("main"))
    main = scratch.save(main)
    apart = scratch.save(placed.join(sized_broadcast(main, main.count()), "cluster").where("component <> main").select("node", "cluster", "chars"))
    if not apart.take(1):
        return edges
    # what is apart goes, in groups of bounded size, to all blocks of its cluster
    groups = scratch.save(apart.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / CLUSTER, F.sum("chars") / CLUSTER_CHARS)).cast("long").alias("groups")))
    g = sized_broadcast(groups, groups.count())
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = own.join(apart.select("node"), "node", "left_semi").join(g, "cluster")
    left = left.select("cluster", F.pmod(F.xxhash64("node", F.lit(6)), "groups").alias("i"), upto("blocks").alias("j"), "node", F.lit(1).alias("side"), "payload")
    right = own.join(g, "cluster").select("cluster", upto("groups").alias("i"), F.col("block").alias("j"), "node", F.lit(2).alias("side"), "payload")
    keys = ("cluster", "i", "j")
    dealt = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "side", "node")
    return scratch.save(edges.unionByName(dealt.mapInArrow(_clusters(make_set, percent, keys), "a long, b long").where("a <> b")))


def _large(scratch: Scratch, pairs: DataFrame, got: DataFrame, large: DataFrame, make_set, percent: int) -> DataFrame:
    """The links within clusters beyond the bounds. got: (node, cluster, payload); large: (cluster, blocks)."""
    own = scratch.save(got.join(sized_broadcast(large, large.count()), "cluster", "left_semi").select("node", "payload").dropDuplicates(["node"]))
    some = scratch.save(pairs.join(own.select(F.col("node").alias("a")), "a", "left_semi"))
    seen = scratch.save(measured(some, some.count(), own, make_set, percent))
    cluster = components(scratch, seen.select("a", "b")).withColumnRenamed("component", "cluster")
    own = scratch.save(own.join(sized_broadcast(cluster, cluster.count()), "node").select("node", "cluster", "payload"))
    sizes = scratch.save(_sizes(own))
    fit, rest = (own.join(sized_broadcast(sizes.where(c), sizes.count()), "cluster") for c in ("blocks = 1", "blocks > 1"))
    edges = seen.where("linked").select("a", "b").unionByName(_whole(fit, make_set, percent, "cluster"))
    return edges.unionByName(_blocks(scratch, rest, make_set, percent))


def link(scratch: Scratch, pairs: DataFrame, payload, make_set, percent: int = 75) -> DataFrame:
    """(node, component) for every node that is linked; component is the smallest node reachable.

    payload gives (node, payload) of wanted nodes, a row or more each, their texts equal as sets.
    """
    cluster = components(scratch, pairs).withColumnRenamed("component", "cluster")
    m = cluster.count()
    got = scratch.save(payload(cluster, m).join(sized_broadcast(cluster, m), "node").select("node", "cluster", "payload"))
    large = scratch.save(_sizes(got).where("blocks > 1"))
    few = large.count()
    fit = got.join(sized_broadcast(large, few), "cluster", "left_anti") if few else got
    edges = _whole(fit, make_set, percent, "cluster")
    if few:
        edges = edges.unionByName(_large(scratch, pairs, got, large, make_set, percent))
    return components(scratch, edges)

"""MinHash near-dedup of documents: circulant signatures, banding, exact Jaccard on five-word shingles.

Circulant MinHash: one permutation scatters the shingle slots, a second one, circularly shifted by
0, 1, ... K - 1, gives all K coordinates. The shifts of one slot lie side by side in memory, so a shingle
costs one contiguous read instead of K hashes.

Equal sets are one class, named by a 64-bit hash of its own, from the start: only classes are banded and compared, so
copies make no pairs.

Defined results: a null or empty text has an empty set, is linked with nothing and is its own component;
fewer than five words are one shingle; rows that repeat a doc_id are returned as often as given, each by its own text, and
rows of one doc_id with different texts are
told apart, their components being those of their texts; a null doc_id keeps its row, unlinked (component null, kept
true); an empty table gives no row; columns besides doc_id and text are ignored. ``dedupe`` keeps the rows of the smallest
doc_id of a component, equal rows of it as often as given, with all their columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import docstats
from .common import Scratch, sized_broadcast, utf8
from .hashing import mix, shingle_set, text_shingle_set, word_hashes
from .neardup import Flush, banded, link

K, BANDS, SLOTS = 128, 32, 1 << 20
_STATE: dict[str, np.ndarray] = {}


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and the shifts of the circulant one: row p holds its values at p, p + 1, ... p + K - 1."""
    if not _STATE:
        rng = np.random.Generator(np.random.PCG64(7))
        _STATE["scatter"] = rng.permutation(SLOTS).astype(np.uint32)
        circle = rng.permutation(SLOTS).astype(np.uint32)
        _STATE["shifts"] = np.lib.stride_tricks.sliding_window_view(np.concatenate([circle, circle[: K - 1]]), K)
    return _STATE["scatter"], _STATE["shifts"]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The K coordinates of a shingle set."""
    scatter, shifts = _permutations()
    slots = scatter[(shingles & np.uint64(SLOTS - 1)).astype(np.int64)]
    best = np.full(K, SLOTS, np.uint32)
    for i in range(0, len(slots), 4096):
        np.minimum(best, shifts[slots[i : i + 4096]].min(axis=0), out=best)
    return best


#: Rows and characters of a flush; bytes of a document for scaling a table's size to documents: only the number of partitions depends on it.
ROWS, CHARS, TYPICAL = 5_000, 8 << 20, 1_000
#: Classes that a task remembers, so that a repeated set gets its signature once.
REMEMBERED = 200_000


def class_id(shingles: np.ndarray) -> int:
    """A 64-bit name of a set that doesn't depend on the order."""
    pair = np.array([mix(shingles, 20).sum(dtype=np.uint64), mix(shingles, 21).sum(dtype=np.uint64) ^ np.uint64(len(shingles))], np.uint64)
    return int(mix(mix(pair[:1], 22) ^ pair[1:], 23).view(np.int64)[0])


def _flushes(it: Iterator[pa.RecordBatch]) -> Iterator[Flush]:
    """Places are (doc_id, hash of the text, class, size of the set; -1 less the size where doc_id is null)."""
    seen: set[int] = set()
    places, nodes, sigs, n = [], [], [], 0
    for batch in it:
        for part in docstats.slices(batch):
            data, at_byte = utf8(part.column("text"))
            words, at = word_hashes(data, at_byte)
            n += len(data)
            for r, (doc, th) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("th").to_pylist())):
                s = shingle_set(words[at[r] : at[r + 1]])
                node = class_id(s) if len(s) else 0
                places.append((doc or 0, th, node, len(s) if doc is not None else -1 - len(s)))
                if len(s) and doc is not None and node not in seen:
                    if len(seen) < REMEMBERED:
                        seen.add(node)
                    nodes.append(node)
                    sigs.append(signature(s))
            if n > CHARS or len(places) >= ROWS:
                yield _flush(nodes, sigs, places)
                places, nodes, sigs, n = [], [], [], 0
    if places:
        yield _flush(nodes, sigs, places)


def _flush(nodes: list, sigs: list, places: list) -> Flush:
    ids, first = np.unique(np.array(nodes, np.int64), return_index=True)  # twice where the task can't remember more
    return Flush(ids, np.array([sigs[i] for i in first], np.uint32).reshape(-1, K), np.array(places, np.int64).reshape(-1, 4))


def _named(spark: SparkSession, docs: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id: one row per row of docs."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    chars = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    places, pairs = banded(scratch, slim, _flushes, BANDS, chars / TYPICAL, percent)
    rows = places.select(F.when(F.col("w") >= 0, F.col("x")).alias("doc_id"), F.col("y").alias("th"), F.when(F.col("w") > 0, F.col("z")).alias("node"), F.when(F.col("w") >= 0, F.col("w")).otherwise(-1 - F.col("w")).alias("n"))

    def payload(wanted: DataFrame, m: int) -> DataFrame:
        first = rows.join(sized_broadcast(wanted.select("node"), m), "node").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("at"))
        by_doc = scratch.save(first.select("at.doc_id", "at.th", "node"))
        return slim.join(sized_broadcast(by_doc, m), ["doc_id", "th"]).select("node", F.col("text").alias("payload"))

    labels = link(scratch, pairs, payload, text_shingle_set, percent)
    own = rows.join(sized_broadcast(labels, labels.count()), "node", "left").select("doc_id", "th", "n", F.coalesce("component", "node").alias("component"))
    least = own.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("m")).where("m > 1").select("component", "least")
    least = scratch.save(least)
    scratch.keep(places, labels, least)
    joined = own.join(sized_broadcast(least, least.count()), "component", "left")
    return joined.select("doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept, one row per row of docs."""
    out = _named(spark, docs, Scratch(spark, "minhash"), percent)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def dedupe(spark: SparkSession, docs: DataFrame, percent: int = 75) -> DataFrame:
    """The documents of which one of each group stays; all columns of docs."""
    scratch = Scratch(spark, "minhash")
    gone = scratch.save(_named(spark, docs, scratch, percent).where("doc_id <> component_id").select("doc_id", "th").distinct())
    scratch.keep(gone)
    own = (docs["doc_id"].cast("long") == gone["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["th"])
    return docs.join(sized_broadcast(gone, gone.count()), own, "left_anti")

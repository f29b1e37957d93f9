"""Ranked lexical search: the best documents of each item by exact integer scores, with MaxScore in every shard of an index.

The texts are read once: a task turns its documents, a bounded shard at a time, into the postings of the terms that items hold, one row a
shard. Document frequencies and lengths are sums over those rows. The search then reads shards, each by itself. Per item the
terms' lists are ordered by upper bound, the greatest score that any document of the shard has from them. Lists are added
up from the highest bound on; once what the rest could add stays below the item's threshold (its least score so far in the task),
no document outside of those seen can qualify: the rest are non-essential and only probed for documents that still can,
list by list, as bounds and threshold narrow. A task gives its best of each item, and two windows of bounded size rank them.

Items are a query set held by the driver a block at a time, bounded by number and bytes; each block is an index and a search of its own.

Defined results: a null or empty text has no terms and is counted nowhere; equal rows are documents each for itself, and so are rows that share a
doc_id; a null doc_id is ranked behind others of its score; items that are equal in all columns count once, and texts that
share an item_id are ranked each for itself; an item without terms, or whose terms no document has, gives no row; other columns are
ignored; an empty table gives no row.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, release, texts

#: Of a shard: documents and postings at most (a longer document alone); bytes of the groups of rows in the index's files.
SHARD_DOCS, SHARD_POSTINGS, GROUP_BYTES = 8192, 400_000, 16 << 20
#: Of a block of items: their number and the characters of their texts at most (a longer text alone).
ITEMS, ITEM_CHARS = 2000, 4_000_000
#: Tasks whose best are ranked together in the first of the two windows.
SALTS = 64
#: ASCII letters and digits and all other bytes from 128 on are a term's, A-Z as a-z; the rest are gaps.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """The maximal runs of letters, digits and characters beyond ASCII, A-Z in lower case."""
    return text.encode().translate(_BYTES).split()


def weight(df: int, n: int) -> int:
    """Of a term that df of n documents have."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


INDEX = "doc_ids array<bigint>, sizes array<bigint>, terms array<int>, starts array<int>, docs array<int>, counts array<bigint>"


def _shard(ids: list, sizes: list[int], found: list[dict[int, int]]) -> dict[str, list]:
    """The postings of documents' term counts: term t's are docs[starts[t] : starts[t + 1]], by document."""
    doc = np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in found])
    term = np.fromiter((t for x in found for t in x), np.int32, len(doc))
    count = np.fromiter((c for x in found for c in x.values()), np.int64, len(doc))
    order = np.argsort(term, kind="stable")
    held, first = np.unique(term[order], return_index=True)
    return {"doc_ids": ids, "sizes": sizes, "terms": held.tolist(), "starts": [*first.tolist(), len(doc)], "docs": doc[order], "counts": count[order]}


def _indexed(vocabulary: dict[bytes, int]):
    names = [x.split()[0] for x in INDEX.split(", ")]

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ids, sizes, found, postings = [], [], [], 0
        for batch in it:
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                words = terms(text)
                if not words:
                    continue
                own = {vocabulary[w]: c for w, c in Counter(words).items() if w in vocabulary}
                if found and (len(found) >= SHARD_DOCS or postings + len(own) > SHARD_POSTINGS):
                    yield _shard(ids, sizes, found)
                    ids, sizes, found, postings = [], [], [], 0
                ids.append(doc)
                sizes.append(len(words))
                found.append(own)
                postings += len(own)
        if found:
            yield _shard(ids, sizes, found)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict(zip(names, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())))
        for x in rows(it):
            yield pa.RecordBatch.from_arrays([pa.array([x[n]], pa.list_(kinds[n])) for n in names], names=names)
        release()

    return run


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """One row a shard: its documents' ids and sizes in terms, and the postings of the vocabulary's terms."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_indexed(vocabulary), INDEX)


def statistics(shards: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, terms with repeats, and document frequency by term (at most the vocabulary's)."""
    n, total = shards.selectExpr("sum(size(sizes))", "sum(aggregate(sizes, 0L, (x, y) -> x + y))").first()
    each = shards.selectExpr("posexplode(terms) as (k, term)", "starts").selectExpr("term", "starts[k + 1] - starts[k] as df")
    return n or 0, total or 0, {r["term"]: r["df"] for r in each.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def best(query: list[tuple[int, int]], lists: dict[int, tuple[np.ndarray, np.ndarray, int]], n_docs: int, threshold: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """MaxScore in a shard: documents that score at least the threshold, the top ones among them, and their scores.

    query: (term, times); lists: documents, scores of one occurrence and their greatest, by term. Ties with the last of the top are
    all given.
    """
    order = sorted(((times * lists[t][2], t, times) for t, times in query if t in lists), reverse=True)
    rest = np.append(np.cumsum([b for b, _, _ in order][::-1])[::-1], 0)  # what the lists from here on can add at most
    total = np.zeros(n_docs, np.int64)
    k = 0
    while k < len(order) and rest[k] >= threshold:  # essential: a document in none of the lists so far could still qualify
        _, t, times = order[k]
        docs, scores, _ = lists[t]
        total[docs] += times * scores
        k += 1
        threshold = _raised(total, threshold, top)
    live = np.flatnonzero((total > 0) & (total + rest[k] >= threshold))
    partial = total[live]
    for j in range(k, len(order)):  # non-essential: probed for documents that can still qualify
        if not len(live):
            break
        _, t, times = order[j]
        docs, scores, _ = lists[t]
        at = np.minimum(np.searchsorted(docs, live), len(docs) - 1)
        partial = partial + np.where(docs[at] == live, times * scores[at], 0)
        threshold = _raised(partial, threshold, top)
        can = partial + rest[j + 1] >= threshold
        live, partial = live[can], partial[can]
    return live, partial


def _raised(scores: np.ndarray, threshold: int, top: int) -> int:
    """The top-th score so far, if it is above the threshold: no final score of those documents is lower."""
    if len(scores) < top:
        return threshold
    return max(threshold, int(np.partition(scores, len(scores) - top)[len(scores) - top]))


FOUND = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _searched(queries: list[list[tuple[int, int]]], weights: dict[int, int], n: int, total: int, top: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in queries]  # of each item a heap of (score, -doc_id or least, doc_id)
        for batch in it:
            for i in range(batch.num_rows):
                ids, sizes, found, starts, docs, counts = (c[i].values for c in batch.columns)
                sizes, found, starts, docs, counts = (x.to_numpy(zero_copy_only=False) for x in (sizes, found, starts, docs, counts))
                m = 75 + (25 * sizes * n) // total
                lists = {}
                for t, a, b in zip(found.tolist(), starts.tolist(), starts[1:].tolist()):
                    tf = counts[a:b]
                    scores = weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[docs[a:b]]))
                    lists[t] = docs[a:b], scores, int(scores.max())
                for query, heap in zip(queries, held):
                    live, scores = best(query, lists, len(sizes), heap[0][0] if len(heap) == top else 1, top)
                    for d, score in zip(live.tolist(), scores.tolist()):
                        doc = ids[d].as_py()
                        entry = (score, -math.inf if doc is None else -doc, doc)
                        if len(heap) < top:
                            heapq.heappush(heap, entry)
                        elif entry[:2] > heap[0][:2]:
                            heapq.heapreplace(heap, entry)
        rows = [(k, doc, score) for k, heap in enumerate(held) for score, _, doc in heap if score > 0]
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND)], schema=FOUND)
        release()

    return run


def blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """(item_id, text) of all items in runs of bounded number and size; the driver holds one run and a partition."""
    held, size = [], 0
    for item_id, text in items.select("item_id", F.col("text").cast("string")).where(F.col("text") != "").distinct().toLocalIterator():
        if held and (len(held) >= ITEMS or size + len(text) > ITEM_CHARS):
            yield held
            held, size = [], 0
        held.append((item_id, text))
        size += len(text)
    if held:
        yield held


def _search_block(spark: SparkSession, scratch: Scratch, docs: DataFrame, block: list[tuple], top: int, kind: str) -> DataFrame:
    vocabulary: dict[bytes, int] = {}
    queries = [[(vocabulary.setdefault(w, len(vocabulary)), c) for w, c in Counter(terms(text)).items()] for _, text in block]
    shards = scratch.save(index(docs, vocabulary), **{"parquet.block.size": GROUP_BYTES})
    n, total, df = statistics(shards)
    weights = {t: weight(d, n) for t, d in df.items()}
    found = shards.mapInArrow(_searched(queries, weights, n, total, top), "item int, doc_id long, score long").withColumn("salt", F.spark_partition_id() % SALTS)
    order = "order by score desc, doc_id asc nulls last"
    found = found.selectExpr("*", f"row_number() over (partition by item, salt {order}) as place").where(F.col("place") <= top)
    ranked = found.selectExpr("item", "doc_id", "score", f"cast(row_number() over (partition by item {order}) as int) as rank").where(F.col("rank") <= top)
    names = spark.createDataFrame([(k, item_id) for k, (item_id, _) in enumerate(block)], f"item int, item_id {kind}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: each item's top documents of score above 0, equal scores by ascending doc_id."""
    scratch, kind = Scratch(spark, "lexical"), items.schema["item_id"].dataType.simpleString()
    out = None
    for block in blocks(items):
        part = scratch.save(_search_block(spark, scratch, docs, block, top, kind))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
SQL = f"""
with words as (select row, doc_id, unnest({_TERMS.format("text")}) as term from (select row_number() over () as row, doc_id, text from documents)),
sizes as (select row, any_value(doc_id) as doc_id, count(*) as n from words group by row),
whole as (select count(*) as docs, sum(n)::bigint as total from sizes),
counts as (select row, term, count(*) as tf from words group by row, term),
weights as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from counts, whole group by term),
asked as (select item, item_id, term, count(*) as times from (select item, item_id, unnest({_TERMS.format("text")}) as term
  from (select row_number() over () as item, item_id, text from (select distinct item_id, text from benchmark))) group by item, item_id, term),
scored as (select item, any_value(item_id) as item_id, row, any_value(s.doc_id) as doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::bigint as score
  from asked join weights using (term) join counts using (term) join sizes s using (row), whole group by item, row),
ranked as (select *, row_number() over (partition by item order by score desc, doc_id asc nulls last)::int as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 20
"""

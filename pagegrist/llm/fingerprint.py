"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

The triplets of bytes at distances 0, 2 and 5 are hashed into 1024 buckets and counted; a bucket's code (0 to 3)
says which quartile of all buckets its count is in. The digest is the codes, four to a byte, and a logarithmic
length code, in hex. Two digests differ by the sum of their code distances and of a bounded length
distance; likeness is one less that sum over what unrelated digests have, at least 0.

For the next document, texts are dealt once, by ranges of doc_id from approximate quantiles; each range also
gets the first document of the range below it. Ranges are sorted on their own and read in a stream.

Defined results: a null text is empty; an empty text's digest has no codes but zeros; a text too short for a triplet is read as if zeros followed; the order is doc_id
descending, nulls last, then text; the last document's next is the first, so a single row is its own next;
equal rows follow each other; an empty table gives no row; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

BUCKETS, STEPS = 1024, (0, 2, 5)
#: Code distance that unrelated digests reach; share of it that lengths can add; length codes to a doubling.
UNRELATED, LENGTH_SHARE, PER_DOUBLING = 1.25 * BUCKETS, 0.15, 8
#: Documents to a range, and most ranges.
RANGE_ROWS, MOST_RANGES = 4000, 20_000
_BLOCK = 1 << 20


def _triplets(data: np.ndarray) -> np.ndarray:
    """Counts of hashed triplets by bucket."""
    out = np.zeros(BUCKETS, np.int64)
    i, j, k = STEPS
    for at in range(0, max(0, len(data) - k), _BLOCK):
        part = data[at : at + _BLOCK + k].astype(np.uint32)
        m = len(part) - k
        h = part[i : i + m] * np.uint32(0x9E3779B1) + part[j : j + m] * np.uint32(0x85EBCA6B) + part[k : k + m] * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        out += np.bincount(h & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return out


def digest(text: str) -> bytes:
    """Codes of all buckets, four to a byte, then the length code."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = _triplets(data if len(data) > STEPS[2] or not len(data) else np.append(data, np.zeros(STEPS[2], np.uint8)))
    cuts = np.partition(counts, (BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4))[[BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4]]
    codes = ((counts > cuts[0]).astype(np.uint8) + (counts > cuts[1]) + (counts > cuts[2])).reshape(-1, 4)
    packed = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return packed.astype(np.uint8).tobytes() + bytes([min(255, int(PER_DOUBLING * np.log2(1 + len(data))))])


_APART = np.array([[sum(abs((a >> s & 3) - (b >> s & 3)) for s in (0, 2, 4, 6)) for b in range(256)] for a in range(256)], np.uint8)


def likeness(a: bytes, b: bytes) -> float:
    """1 of equal digests, about 0 of unrelated ones."""
    if a == b:
        return 1.0
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    lengths = min(1.0, abs(int(x[-1]) - int(y[-1])) / (4 * PER_DOUBLING)) * LENGTH_SHARE
    return max(0.0, 1.0 - float(_APART[x[:-1], y[:-1]].sum(dtype=np.int64)) / UNRELATED - lengths)


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as many first characters of the following one, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _stream(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, each range's own in order and then the first of the range below."""
    last, at = None, None

    def row(own, text, mark):
        doc, mine, fp = own
        changed = edited(mine, text)
        other = digest(changed)
        return doc, len(mine), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), fp.hex(), other.hex(), likeness(fp, other), likeness(fp, mark)

    for whole in it:
        for i in range(0, whole.num_rows, 512):
            batch, rows = whole.slice(i, 512), []
            for bucket, sentinel, doc, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "sentinel", "doc_id", "text"))):
                text = text or ""
                if bucket != at:
                    last, at = None, bucket
                if sentinel and last is None:
                    continue
                fp = digest(text)
                if last is not None:
                    rows.append(row(last, text, fp))
                last = None if sentinel else (doc, text, fp)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(OUT), OUT)], schema=OUT)


def _ranked(x: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above x: first among every so many of them, then within one run, so twice the root of their number is read."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    runs = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    upto = lambda listed: F.size(F.filter(listed, lambda b: b <= x))
    longs = lambda ids: F.array(*[F.lit(b).cast("long") for b in ids])
    run = upto(longs([r[0] for r in runs]))  # runs that begin at or below x
    return F.when(run == 0, 0).otherwise((run - 1) * width + upto(F.get(F.array(*map(longs, runs)), run - 1)))


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row per row of docs."""
    ship(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = slim.count()
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(slim.agg(F.percentile_approx("doc_id", cuts, max(10_000, 20 * ranges))).first()[0] or [])) if cuts else []
    above = _ranked(F.col("doc_id"), bounds)
    placed = slim.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(above))
    heads = {r["bucket"]: r["head"] for r in placed.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}  # a row per range
    if not heads:
        return slim.mapInArrow(lambda it: iter(()), _DDL)
    order = sorted(heads, reverse=True)
    to = dict(zip(order, [order[-1], *order[:-1]]))
    full = range(-1, max(order) + 1)
    head = F.array(*[F.lit(heads.get(b)).cast("long") for b in full])[F.col("bucket") + 1]
    back = F.array(*[F.lit(to.get(b, b)).cast("int") for b in full])[F.col("bucket") + 1]
    own = F.struct(F.col("bucket").cast("int").alias("bucket"), F.lit(0).alias("sentinel"))
    dealt = placed.select("doc_id", "text", F.explode(F.when(F.col("doc_id").eqNullSafe(head), F.array(own, F.struct(back.alias("bucket"), F.lit(1).alias("sentinel")))).otherwise(F.array(own))).alias("to"))
    dealt = dealt.select("doc_id", "text", "to.bucket", "to.sentinel").repartitionById(max(order) + 2, F.col("bucket") + 1)
    return dealt.sortWithinPartitions("bucket", "sentinel", F.col("doc_id").desc_nulls_last(), "text").mapInArrow(_stream, _DDL)


_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

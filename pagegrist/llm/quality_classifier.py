"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are the only inputs: never labels, language, source or id. The trees are learnt on the
driver from a bounded sample of labelled rows (``SAMPLE``, the smallest by hash of the id) and flattened into arrays;
scoring walks all trees of a slice of documents at once.

Defined results: a null or empty text has statistics of zeros and gets the score that the trees give to them; a
doc_id with several labels counts by the lowest; without labels, or with one class, every score is the smoothed
share of label 1; equal rows get equal scores; a null doc_id counts as held out; an empty table gives no row; columns besides
doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import docstats
from .common import release

#: Labelled rows learnt from at most; folds by crc32 of the id, of which fold 0 is held out; score from which a document is kept.
SAMPLE, FOLDS, CUT = 20_000, 5, 0.3
TREES, DEPTH, RATE, BINS, RIDGE, LEAST = 60, 4, 0.15, 64, 1.0, 1.0

STATISTICS = (
    "log_words", "mean_word", "symbols", "repeat_words", "adjacent_repeats", "distinct_words", "top_word", "letterless_words", "dup_lines", "short_lines",
    "bullets", "upper", "digits", "marks", "wide", "spaces", "pipes", "entropy", "words_per_line",
)


def statistics(batch: pa.RecordBatch) -> np.ndarray:
    """One row of statistics per document of a slice."""
    m = docstats.measure(batch)
    words, lines, chars = (np.maximum(1, m[k]).astype(float) for k in ("n_words", "n_lines", "n_chars"))
    total = np.maximum(1, m["bytes"].sum(axis=1)).astype(float)
    p = m["bytes"] / total[:, None]
    of = lambda table: m["bytes"] @ table / chars
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    columns = [
        np.log1p(m["n_words"]), m["word_chars"] / words, m["n_symbols"] / words, m["n_repeat_words"] / words, m["n_adjacent_repeats"] / words, m["n_distinct_words"] / words,
        m["top_word"] / words, m["n_letterless_words"] / words, m["n_dup_lines"] / lines, m["n_short_lines"] / lines, m["n_bullets"] / lines, of(docstats.UPPER), of(docstats.DIGIT),
        of(docstats.MARK), of(docstats.WIDE), of(docstats.SPACE), m["bytes"][:, ord("|")] / words, entropy, m["n_words"] / lines,
    ]
    return np.column_stack(columns).astype(np.float32)


class Trees(NamedTuple):
    """Complete trees in heap order: feature and threshold of inner nodes (a row goes right where it is larger), values of leaves."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        n, depth = len(x), int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        if not self.leaf.size:
            return np.full(n, 1 / (1 + np.exp(-self.start)))
        tree, row = np.arange(len(self.leaf))[None, :], np.arange(n)[:, None]
        at = np.zeros((n, len(self.leaf)), np.int64)
        for _ in range(depth):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return 1 / (1 + np.exp(-(self.start + self.leaf[tree, at - (2**depth - 1)].sum(axis=1))))


def learn(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Boosted trees on the logistic loss; splits between quantile bins, found in histograms of gradients."""
    n = len(y)
    share = (y.sum() + 1.0) / (n + 2.0)
    start = float(np.log(share / (1 - share)))
    none = Trees(start, np.zeros((0, 0), np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    if n == 0 or y.min() == y.max():
        return none
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")).astype(np.float32) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)])  # bin b: values up to cut b
    width, features = bins + 1, x.shape[1]
    flat = binned + np.arange(features)[None, :] * width
    total = np.full(n, start)
    inner = 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (features * width) + flat).ravel()
            shape = (many, features, width)
            sums = [np.bincount(cell, np.repeat(v, features), many * features * width).reshape(shape).cumsum(axis=2) for v in (g, h)]
            gl, hl = sums
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
            gain[(hl < LEAST) | (ha - hl < LEAST)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                f, b = divmod(int(best[k]), width)
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[t, first + k], threshold[t, first + k] = f, cuts[f][b]
            right = x[np.arange(n), feature[t, node]] > threshold[t, node]
            node = 2 * node + 1 + right
        own = node - inner
        leaf[t] = -rate * np.bincount(own, g, inner + 1) / (np.bincount(own, h, inner + 1) + RIDGE)
        total += leaf[t, own]
    return Trees(start, feature, threshold, leaf)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most so many labelled rows that aren't held out."""
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id").select("text", "y")  # `rows` bounds the broadcast side

    def measured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in docstats.slices(batch):
                yield pa.RecordBatch.from_pydict({"x": pa.array(list(statistics(part)), pa.list_(pa.float32())), "y": part.column("y")})

    got = slim.mapInArrow(measured, "x array<float>, y int").toArrow()
    x = np.array(got.column("x").to_pylist(), np.float32).reshape(-1, len(STATISTICS))
    y = got.column("y").to_numpy().astype(float)
    order = np.lexsort((y, *x.T))  # the order of arrival must not decide
    return x[order], y[order]


def _scorer(model: Trees):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in docstats.slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(model.score(statistics(part)))], schema=schema)

    return scored


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs."""
    ship(spark)
    model = learn(*sample(docs, labels))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = slim.mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents that the classifier doesn't reject; all columns of docs, as they are, whatever their names.

    Judged by text alone: a null or empty text by the score that the trees give to it, equal texts alike, a null doc_id as any
    other; without labels every score is 0.5, so all documents stay; an empty table stays empty.
    """
    ship(spark)
    model = learn(*sample(docs, labels))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def kept(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in docstats.slices(batch):
                yield part.filter(pa.array(model.score(statistics(part)) >= cut))
        release()

    return docs.mapInArrow(kept, schema)

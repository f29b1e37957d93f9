"""Rows of one doc_id with different texts, and columns named as the operators name theirs."""

import random

from pyspark.sql import functions as F

from pagegrist.llm import line_dedup, minhash_dedup
from pagegrist.llm.hashing import text_shingle_set

RNG = random.Random(17)


def prose(n):
    return " ".join("".join(RNG.choice("abcdefghijkl") for _ in range(6)) for _ in range(n))


def test_documents_of_one_id(spark):
    a, b = prose(200), prose(200)
    a2, b2 = a + " one more", b + " and another"
    rows = [(1, a), (1, b), (2, a2), (3, b2), (1, a), (4, None), (5, prose(50))]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    size = lambda x: len(text_shingle_set(x))
    assert got[2, size(a2)] == (1, False) and got[3, size(b2)] == (1, False) and got[1, size(a)] == (1, True) and got[4, 0] == (4, True)
    left = minhash_dedup.dedupe(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text or "") for r in left) == sorted((i, t or "") for i, t in rows if i not in (2, 3))


def test_lines_of_one_id(spark):
    line = "this line stands in several documents and is long enough to count"
    rows = [(1, f"{prose(30)}\n{prose(30)}\n{prose(30)}"), (1, prose(20)), (2, line), (1, line + "!"), (3, f"{line}?\nown words here"), (None, line), (3, f"{line}?\nown words here")]
    got = line_dedup.dedupe_lines(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    texts = sorted((r.doc_id or 0, r.text) for r in got)
    assert (1, line + "!") in texts and (2, "") in texts and texts.count((3, "own words here")) == 2 and (0, line) in texts
    assert len(got) == len(rows) and sum(r.n_lines_dropped for r in got) == 3


def test_clashing_columns(spark):
    text = "\n".join([prose(12)] * 2 + [prose(12)])
    names = ["gone_id", "GONE_TH", "gone_lines", "_gone", "_lost", "_gone_id", "n_lines_dropped", "component", "component_id", "node", "at", "m", "x", "y", "kind", "cluster", "payload"]
    docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string").select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    got = line_dedup.dedupe_lines(spark, docs)
    assert got.columns == [*(c for c in docs.columns if c != "n_lines_dropped"), "n_lines_dropped"]
    assert [r.n_lines_dropped for r in got.orderBy("doc_id").collect()] == [1, 3, 3] and got.first()["_gone"] == 3
    left = minhash_dedup.dedupe(spark, docs)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [0]
    assert minhash_dedup.near_duplicates(spark, docs).where("component_id = 0").count() == 3

"""Mixing sources to target weights by hash-threshold histograms; DataFrame operations only.

Every document gets a 60-bit number from its id. A source's budget is met by the documents whose number is
below a threshold, so larger budgets take supersets of what smaller ones take. The threshold comes from a histogram of
sizes over 4096 number ranges; only the range where the budget falls is split again, and what lies in the last such
range is settled number by number. Nothing is sorted but those few.

Repeats: a source whose target is q times its size and a rest takes every document q times, and those below the
rest's threshold once more. The threshold is where the sum comes nearest: a document is within it where the
middle of its own share lies within the budget.

Defined results: a null text has size 0; a null source is a source of its own, last in order; the empty string
sorts first; equal doc_ids of a source share a number and are taken together; a source of size 0 has target 0 and
takes nothing; an empty table gives no row; columns besides doc_id, source and text are ignored.

What is windowed without a key is one row a source: sources are names of collections, not hosts, so these rows are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh, sized_broadcast

BITS, LEVEL = 60, 12
RANGES = 1 << LEVEL
#: Weights by the order of the sources, repeating; share of all sizes that the mix has; most repeats of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2


def number(doc_id: Column) -> Column:
    """A 60-bit number of an id, the same in any engine: the first 15 hex digits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> also target: weighted shares that no source exceeds by its cap, the excess reshared.

    Resharing ends where target = min(cap, level * weight) for one level; with sources in order of cap / weight, those
    before the level are at their caps. Works on one row per source.
    """
    cases = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.selectExpr("*", "row_number() over (order by source is null, source) as rank").withColumn("w", cases)
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    run = ranked.selectExpr(
        "*",
        "sum(source_size) over () as total",
        "coalesce(sum(cap) over (order by cap / w, rank rows between unbounded preceding and 1 preceding), 0.0D) as capped",
        "sum(w) over (order by cap / w desc, rank desc rows unbounded preceding) as open_w",
    )
    level = run.withColumn("level", (F.lit(float(share)) * F.col("total") - F.col("capped")) / F.col("open_w"))
    # the level that holds is that of the first source in order that stays below its cap; none: all are capped
    held = level.selectExpr("*", "min(case when level * w <= cap then struct(cap / w as r, rank, level) end) over () as held")
    return held.select("source", "source_size", F.when(F.col("held").isNull() | (F.col("cap") <= F.col("held.level") * F.col("w")), F.col("cap")).otherwise(F.col("held.level") * F.col("w")).cast("double").alias("target"))


def _boundary(hist: DataFrame, at: str) -> DataFrame:
    """Of each source (key) the number range where the budget falls, and what lies before it."""
    run = hist.selectExpr("*", f"sum(words) over (partition by key order by {at} rows unbounded preceding) as upto")
    return run.where("upto > budget").groupBy("key").agg(F.min_by(F.struct(F.col(at).alias("at"), (F.col("upto") - F.col("words")).alias("before")), at).alias("b"))


def _key(source: Column) -> Column:
    """A source's name that tells null from the empty string."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def sized(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h, key of every document, written once: texts aren't read again."""
    every = docs.select("doc_id", F.col("source").cast("string").alias("source"), size(F.col("text")).alias("size"), number(F.col("doc_id")).alias("h"))
    return scratch.save(every.withColumn("key", _key(F.col("source"))))


def thresholds(scratch: Scratch, every: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, int]:
    """key, source_size, target, times, budget, limit of each source, and how many sources there are."""
    level1 = scratch.save(every.groupBy("key", F.shiftright("h", BITS - LEVEL).alias("r")).agg(F.sum("size").alias("words"), F.first("source").alias("source")))
    sources = level1.groupBy("key").agg(F.sum("words").alias("source_size"), F.first("source").alias("source"))
    aimed = targets(sources.select("source", "source_size"), weights, share, most)
    aimed = aimed.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aimed = scratch.save(aimed.withColumn("times", full).withColumn("budget", F.col("target") - F.col("times") * F.col("source_size")))
    n = aimed.count()

    def with_budget(df: DataFrame) -> DataFrame:
        return df.join(sized_broadcast(aimed.select("key", "budget"), n), "key")

    first = scratch.save(_boundary(with_budget(level1), "r"))
    shift = BITS - 2 * LEVEL

    def inside(at: DataFrame, bits: int) -> DataFrame:
        """The rows of the range where a source's budget falls."""
        at = sized_broadcast(at.select("key", F.col("b.at").alias("at")), n)
        return every.join(at, (every["key"] == at["key"]) & (F.shiftright(every["h"], bits) == at["at"])).drop(at["key"])

    level2 = inside(first, BITS - LEVEL).groupBy("key", F.shiftright("h", shift).alias("r")).agg(F.sum("size").alias("words"))
    less = first.select("key", F.col("b.before").alias("before"))
    left2 = with_budget(level2).join(sized_broadcast(less, n), "key").withColumn("budget", F.col("budget") - F.col("before")).drop("before")
    second = _boundary(left2, "r").join(less, "key").select("key", F.struct(F.col("b.at").alias("at"), (F.col("b.before") + F.col("before")).alias("before")).alias("b"))
    second = scratch.save(second)
    last = inside(second, shift).groupBy("key", "h").agg(F.sum("size").alias("words"))
    before = second.select("key", F.col("b.before").alias("before"))
    run = with_budget(last).join(sized_broadcast(before, n), "key").selectExpr("*", "before + sum(words) over (partition by key order by h rows unbounded preceding) as upto")
    beyond = run.where("upto - words / 2.0D > budget").groupBy("key").agg(F.min("h").alias("h0"))
    start = second.select("key", F.shiftleft("b.at", shift).alias("lo"), (F.shiftleft(F.col("b.at") + 1, shift)).alias("hi"))
    # without a number beyond the middle rule, all of the boundary range is within the budget
    limits = scratch.save(start.join(beyond, "key", "left").select("key", F.coalesce("h0", "hi").alias("limit")))
    return scratch.save(aimed.join(limits, "key", "left")), n


def _copies() -> Column:
    """How often a document is taken: in full times, and once more below the limit of what is left of the budget."""
    extra = F.coalesce((F.col("h") < F.col("limit")).cast("long"), F.lit(1))
    return (F.col("times") + F.when(F.col("budget") <= 0, 0).otherwise(extra)).cast("long")


def mix(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, source: one row per row of docs."""
    scratch = Scratch(spark, "mixing")
    every = sized(scratch, docs)
    limits, n = thresholds(scratch, every, weights, share, most)
    scratch.keep(every, limits)
    joined = every.join(sized_broadcast(limits, n), "key")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"), "source")


def mixed(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The documents of the mix, each as often as it is taken; all columns of docs, whatever their names. Texts without a word aren't taken."""
    scratch = Scratch(spark, "mixed")
    limits, n = thresholds(scratch, sized(scratch, docs), weights, share, most)
    scratch.keep(limits)
    name = {k: fresh(k, docs.columns) for k in ("key", "times", "budget", "limit", "copies", "copy")}
    limits = limits.select([F.col(k).alias(name[k]) for k in ("key", "times", "budget", "limit")])
    joined = docs.join(sized_broadcast(limits, n), _key(docs["source"]) == F.col(name["key"]))
    extra = F.coalesce((number(docs["doc_id"]) < F.col(name["limit"])).cast("int"), F.lit(1))
    copies = F.col(name["times"]).cast("int") + F.when(F.col(name["budget"]) <= 0, 0).otherwise(extra)
    copies = F.when(docs["text"].rlike(WORD), copies).otherwise(0)
    taken = joined.withColumn(name["copies"], copies).where(F.col(name["copies"]) > 0)
    return taken.withColumn(name["copy"], F.explode(F.sequence(F.lit(1), F.col(name["copies"])))).select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same rows in SQL, by sorting.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source IS NULL, source) AS k,
         sum(source_size) OVER () AS total FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * total - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS level FROM r),
t AS (
  SELECT source, source_size, least(cap, coalesce(w * (SELECT level FROM l WHERE level * w <= cap ORDER BY k LIMIT 1), cap))::DOUBLE AS target FROM l),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
m AS (
  SELECT d.doc_id, d.source, d.size, b.source_size, b.target, b.times, b.target - b.times * b.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, h) AS words
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (size * (times + CASE WHEN budget > 0 AND upto - words / 2.0 <= budget THEN 1 ELSE 0 END))::BIGINT AS taken, source
FROM m
"""

"""Chat formatting: cumulative snapshots of a conversation collapse to the longest, which is rendered.

Chat logs often hold a conversation once per turn, each time whole. A rolling hash of its turns (exclusive-or of
128 bits per turn, salted by its place) makes every prefix of every conversation a key. A conversation whose whole
hash is a prefix of a longer one goes, by an anti-join; of equal ones the smallest conv_id stays. What stays is rendered
in segments of bounded length, so that no task gathers a conversation of any length. Up to there a turn's text is carried as its
MD5: texts themselves move only to be rendered, those of conversations that stay.

Defined results: turns are ordered by turn (nulls last), role (nulls first) and MD5 of the text (nulls first); turns equal in all four
columns count once; a null role renders as "unknown", a null text as empty, and neither equals an empty string; a mark's
beginning ``<|`` inside a role or text is rendered as ``< |``, so that no text forges a turn; a null
conv_id is one conversation; an empty table gives no row; columns besides the four are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, sized_broadcast

#: Turns to a rendered segment; turn numbers to a block of the two-level prefix sums.
SEGMENT, BLOCK = 256, 4096


def slim(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, c (a name of the conversation that tells null apart), block, m (the MD5 of the text) and the 128 bits i1, i2 that stand for turn, role and text."""
    columns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    named = columns.withColumns({"c": F.coalesce(F.concat(F.lit("s"), F.col("conv_id").cast("string")), F.lit("")), "m": F.unhex(F.md5(F.col("text").cast("binary"))), "block": F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(2**62)).cast("long")})
    own = lambda salt: F.xxhash64(F.lit(salt), F.col("turn").isNull(), F.coalesce("turn", F.lit(0)), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.coalesce("m", F.lit(b"")))
    return named.withColumns({"i1": own(1), "i2": own(2)})


def ranked(turns: DataFrame) -> DataFrame:
    """c, conv_id, i1, i2, k (the place of a turn from 1), more (whether turns follow), h1, h2 (the rolling hash of the first k turns).

    All within blocks of turn numbers, in one order; conversations of several blocks, which are few, get what lies before a block and whether
    another follows by a join.
    """
    inner = turns.select("c", "conv_id", "block", "turn", "role", "m", "i1", "i2").distinct()
    order = "partition by c, block order by turn nulls last, role, m"
    inner = inner.selectExpr("*", f"row_number() over ({order}) as r", "count(*) over (partition by c, block) as n")
    sizes = turns.select("c", "block", "i1", "i2").distinct().groupBy("c", "block").agg(F.count("*").alias("n"))
    blocks = sizes.selectExpr("c", "block", "sum(n) over (partition by c order by block rows unbounded preceding) - n as before", "block < max(block) over (partition by c) as later")
    inner = inner.join(blocks.where("before > 0 or later"), ["c", "block"], "left")
    placed = inner.selectExpr("c", "conv_id", "block", "i1", "i2", "r + coalesce(before, 0) as k", "r < n or coalesce(later, false) as more")
    part = lambda salt: F.xxhash64(F.lit(salt), "k", "i1", "i2")
    return placed.withColumns({"x1": part(3), "x2": part(4)}).selectExpr(
        "c", "conv_id", "block", "i1", "i2", "k", "more", *[f"bit_xor(x{i}) over (partition by c, block order by k rows unbounded preceding) as r{i}" for i in (1, 2)]
    )


def rolled(scratch: Scratch, placed: DataFrame) -> DataFrame:
    """Those of ranked with h1, h2 over whole conversations: a block's own hash on top of those before it."""
    placed = scratch.save(placed)
    ends = placed.groupBy("c", "block").agg(F.max_by("r1", "k").alias("s1"), F.max_by("r2", "k").alias("s2"))
    upto = "over (partition by c order by block rows between unbounded preceding and 1 preceding)"
    before = ends.selectExpr("c", "block", f"bit_xor(s1) {upto} as b1", f"bit_xor(s2) {upto} as b2").where("b1 is not null")
    return placed.join(before, ["c", "block"], "left").selectExpr("c", "conv_id", "i1", "i2", "k", "more", "r1 ^ coalesce(b1, 0) as h1", "r2 ^ coalesce(b2, 0) as h2")


def maximal(ranks: DataFrame) -> DataFrame:
    """c, conv_id, n_turns, n_equal of the conversations that prefix no longer one, one of each group of equals.

    A prefix that goes on somewhere is inside a longer conversation; the anti-join of whole conversations with these is one
    aggregate, as both have the same key.
    """
    whole = ~F.col("more")
    by_hash = ranks.groupBy("k", "h1", "h2").agg(F.max("more").alias("inside"), F.count_if(whole).alias("n_equal"), F.min_by(F.struct("c", "conv_id"), F.when(whole, F.struct(F.col("conv_id").isNull(), "conv_id"))).alias("first"))
    return by_hash.where("not inside").select("first.c", "first.conv_id", F.col("k").alias("n_turns"), "n_equal")


def rendered(turns: DataFrame, ranks: DataFrame, kept: DataFrame, n: int) -> DataFrame:
    """conv_id, n_turns, n_equal, segment, text: the turns of kept conversations in order; n of them are kept.

    One row of a turn is enough, however often it is logged: equal rows meet in the segment's set. The join is by turn, so a long
    conversation spreads.
    """
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    line = F.concat(F.lit("<|"), plain(F.coalesce("role", F.lit("unknown"))), F.lit("|>\n"), plain(F.coalesce("text", F.lit(""))), F.lit("\n<|end|>\n"))
    side = sized_broadcast(kept.select("c", "n_turns", "n_equal"), n)
    own = turns.join(side, "c").join(ranks.join(sized_broadcast(kept.select("c"), n), "c", "left_semi").select("c", "i1", "i2", "k"), ["c", "i1", "i2"])
    own = own.select("c", "conv_id", "n_turns", "n_equal", F.floor((F.col("k") - 1) / SEGMENT).cast("int").alias("segment"), F.struct("k", line.alias("line")).alias("part"))
    parts = own.groupBy("c", "conv_id", "n_turns", "n_equal", "segment").agg(F.array_sort(F.collect_set("part")).alias("lines"))
    return parts.select("conv_id", "n_turns", "n_equal", "segment", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"))


def format_chats(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal, segment, text: maximal conversations, rendered."""
    scratch = Scratch(spark, "chat")
    turns = slim(turns)
    ranks = scratch.save(rolled(scratch, ranked(turns)))
    kept = scratch.save(maximal(ranks))
    scratch.keep(ranks, kept)
    return rendered(turns, ranks, kept, kept.count())


#: The same rows in SQL.
SQL = r"""
WITH u AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, md5(text) NULLS FIRST) AS k FROM u),
c AS (SELECT conv_id, count(*)::BIGINT AS n_turns, list({'r': role, 't': text} ORDER BY k) AS turns FROM r GROUP BY conv_id),
e AS (SELECT min(conv_id) AS conv_id, n_turns, count(*)::BIGINT AS n_equal, turns FROM c GROUP BY n_turns, turns),
m AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.n_turns > e.n_turns AND c.turns[1] = e.turns[1] AND c.turns[1:e.n_turns] = e.turns))
SELECT m.conv_id, n_turns, n_equal, ((k - 1) // 256)::INT AS segment,
       string_agg('<|' || replace(coalesce(role, 'unknown'), '<|', '< |') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || chr(10) || '<|end|>' || chr(10), '' ORDER BY k) AS text
FROM m JOIN r USING (conv_id) GROUP BY ALL
"""

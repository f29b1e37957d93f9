"""Attempt logs and evaluation runs: failure priority, first successes, timings, roll-ups, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import urls as U
from ..functions.text import blank, fold


def normalized(df: DataFrame) -> DataFrame:
    """Attempts with absent fields filled, negative times as 0 and errors clipped."""
    return df.withColumns({
        "engine": F.when(blank(F.col("engine")) == "", "unknown").otherwise(F.col("engine")), "status": F.coalesce("status", F.lit(0)).cast("int"),
        "elapsed_ms": F.greatest(F.coalesce("elapsed_ms", F.lit(0)), F.lit(0)).cast("long"), "error_code": blank(F.col("error_code")), "error": F.left(blank(F.col("error")), F.lit(500)),
    })


def priority(code: Column) -> Column:
    out = F.lit(10)
    for name, p, _ in fixed.FAILURES:
        out = F.when(code == name, p).otherwise(out)
    return out


def failure_class(code: Column) -> Column:
    out = F.lit("config")
    for name, _, kind in fixed.FAILURES:
        out = F.when(code == name, kind).otherwise(out)
    return out


def known_code(code: Column) -> Column:
    return F.when(code.isin(*[n for n, _, _ in fixed.FAILURES]), code).otherwise("INTERNAL")


def best_failure(attempts: DataFrame, key: str, seq: str) -> DataFrame:
    """By request the failure of the highest priority, the last of equals."""
    code = known_code(F.col("error_code"))
    failed = attempts.where(blank(F.col("error_code")) != "").withColumn("code", code)
    best = failed.groupBy(key).agg(F.max_by(F.struct("code", seq), F.struct(priority(F.col("code")).alias("p"), F.col(seq).alias("s"))).alias("b"))
    return best.select(key, F.col("b.code").alias("error_code"), failure_class(F.col("b.code")).alias("failure_class"), F.col(f"b.{seq}").alias(seq))


def until_first_success(attempts: DataFrame, key: str, seq: str) -> DataFrame:
    """The attempts of each request up to its first success: what a chain that stops there would have made."""
    ok = attempts.where(blank(F.col("error_code")) == "").groupBy(key).agg(F.min(seq).alias("_ok"))
    return attempts.join(ok, key, "left").where(F.col("_ok").isNull() | (F.col(seq) <= F.col("_ok"))).drop("_ok")


def engine_timings(attempts: DataFrame, *keys: str) -> DataFrame:
    """By key the summed time of each engine, as a map in order of engines."""
    sums = normalized(attempts).groupBy(*keys, "engine").agg(F.sum("elapsed_ms").alias("ms"))
    return sums.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("engine", "ms")))).alias("engine_timings_ms"))


def rolled_up(children: DataFrame, key: str) -> DataFrame:
    """Batches from their items' timing maps: maps merged by engine, items counted."""
    each = children.select(key, F.explode("engine_timings_ms").alias("engine", "ms")).groupBy(key, "engine").agg(F.sum(F.greatest("ms", F.lit(0))).alias("ms"))
    return each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("engine", "ms")))).alias("engine_timings_ms"))


def batch_attempts(attempts: DataFrame, items: DataFrame, key: str, order: str) -> DataFrame:
    """key, place, scope, request_id and the normal form of every attempt of a batch's items, in the items' order.

    One row an attempt instead of one list a batch. items: key, request_id, scope and their order; attempts: request_id, seq and
    the fields of ``normalized``.
    """
    own = items.select(key, F.col(order).alias("place"), F.col("request_id").alias("_r"), F.col("scope"))
    return normalized(attempts).join(own, F.col("request_id") == F.col("_r")).drop("_r")


def batch_quality(children: DataFrame, key: str) -> DataFrame:
    """Whether any item of a batch was judged, how many were, and how many of these passed. children: evaluated, ok."""
    return children.groupBy(key).agg(F.coalesce(F.bool_or("evaluated"), F.lit(False)).alias("evaluated"), F.count_if("evaluated").alias("n_evaluated"), F.count_if(F.col("evaluated") & F.col("ok")).alias("n_ok"))


def batch_scope(items: DataFrame, key: str, order: str, domain: str, most: int) -> DataFrame:
    """The first items of each batch up to a cap; in_scope tells whether they are all of one domain."""
    w = Window.partitionBy(key).orderBy(order)
    kept = items.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")
    return kept.withColumn("in_scope", F.min(domain).over(Window.partitionBy(key)).eqNullSafe(F.max(domain).over(Window.partitionBy(key))))


def rate(ok: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(ok / total, 4))


def by_domain(items: DataFrame, domain: str = "domain") -> DataFrame:
    counts = items.groupBy(domain).agg(F.count("*").alias("total"), F.count_if("ok").alias("n_ok"))
    return counts.withColumn("rate", rate(F.col("n_ok"), F.col("total")))


#: Ranges that a pass of the selection counts.
RANGES = 1024


def exact_median(df: DataFrame, column: str) -> float | None:
    """The median of a column's finite values by selection; null values don't count, and without any there is none.

    Values are counted by range, then the range that holds the middle is cut into ranges again, until it is one value: a few passes over
    the column, each combined before its shuffle, and at most RANGES rows for the driver. No task ever holds the values.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    low, high, n = x.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if not n:
        return None
    rank, below = (n - 1) // 2, 0
    while low < high:
        width = (high - low) / RANGES
        place = F.least(F.floor((F.col("x") - low) / width), F.lit(RANGES - 1)) if width > 0 else (F.col("x") > low).cast("long")
        counts = x.where(F.col("x").between(low, high)).groupBy(place.alias("k")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("k").collect()
        for r in counts:
            low, high = r["low"], r["high"]
            if below + r["n"] > rank:
                break
            below += r["n"]
    if n % 2:
        return low
    upto, above = x.agg(F.count_if(F.col("x") <= low), F.min(F.when(F.col("x") > low, F.col("x")))).first()
    return low if upto > n // 2 else (low + above) / 2


def run_meta(items: DataFrame) -> DataFrame:
    """Totals, rates, the longest time and the median of the easy tier; one row."""
    middle = exact_median(items.where("tier = 'easy'"), "elapsed_sec")
    m = items.agg(
        F.count("*").alias("total"), F.count_if("raw_ok").alias("raw_ok_count"), F.count_if("ok").alias("ok_count"), F.coalesce(F.max("elapsed_sec"), F.lit(0.0)).alias("max_elapsed_sec"),
        F.round(F.lit(middle).cast("double"), 3).alias("easy_p50_sec"),
    )
    return m.withColumns({"raw_success_rate": rate(F.col("raw_ok_count"), F.col("total")), "success_rate": rate(F.col("ok_count"), F.col("total"))})


def regressions(baseline: DataFrame, current: DataFrame, drop: int = 2) -> DataFrame:
    """Domains of both runs that lost so many successes; inputs as of by_domain."""
    b, c = baseline.select("domain", F.col("n_ok").alias("baseline_ok")), current.select("domain", F.col("n_ok").alias("current_ok"))
    return b.join(c, "domain").withColumn("drop", F.col("baseline_ok") - F.col("current_ok")).where(F.col("drop") >= drop).orderBy("domain")


def set_changes(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Values that one run has and the other hasn't."""
    b, c = baseline.select(column), current.select(column)
    return c.subtract(b).withColumn("change", F.lit("added")).unionByName(b.subtract(c).withColumn("change", F.lit("removed")))


def syndicated(originals: DataFrame, candidates: DataFrame, host: str, attribution: str, days: int = 2, one_table: bool = False) -> DataFrame:
    """Candidates of an original: on the host or below it, attributed within the first 4000 folded characters, equal normal
    title, published within days of it; the first by seq, and how many there are.

    An interval join without its pairs: time is cut into slots as wide as the interval, so what lies within it is the end of the slot before, the own
    slot, and the beginning of the next. An original asks each of them by one probe, and running minima and counts over a title's slot, in
    either order of time, answer all probes of a slot in one pass. A title with any number of articles costs as many rows, dealt by
    title and slot. originals: orig_id, url, title_key, published; candidates: cand_id, url, title_key, published,
    attribution_text, seq. one_table: both have the same ids, each once, and none is its own candidate.
    """
    at = F.regexp_replace(U.hostname(F.col("url")), r"\.+$", "")
    credited = F.contains(F.left(fold(F.col("attribution_text")), F.lit(4000)), fold(F.lit(attribution)))
    width, us = days * 86_400_000_000, F.unix_micros("published")
    slot = ((us - F.pmod(us, F.lit(width))) / width).cast("long")
    kind = candidates.schema["cand_id"].dataType
    wanted = candidates.where(U.under(at, F.lit(host.lower())) & credited & (F.col("title_key") != ""))
    found = wanted.select("title_key", slot.alias("slot"), us.alias("us"), F.lit(0).alias("side"), F.col("cand_id").alias("id"), F.lit(0).alias("turn"), F.struct("seq", "cand_id").alias("hit"), F.lit(None).cast(originals.schema["orig_id"].dataType).alias("orig_id"))
    asked = originals.where((blank(F.col("url")) != "") & (F.col("title_key") != "") & F.col("published").isNotNull())

    def probes(step, shift, side, turn):
        own = F.col("orig_id").cast(kind) if turn else F.lit(None).cast(kind)
        return asked.select("title_key", (slot + step).alias("slot"), (us + shift).alias("us"), F.lit(side).alias("side"), own.alias("id"), F.lit(turn).alias("turn"), F.lit(None).cast(found.schema["hit"].dataType).alias("hit"), "orig_id")

    def answered(each, *order):
        w = Window.partitionBy("title_key", "slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = found.unionByName(each).withColumns({"best": F.min("hit").over(w), "n": F.count("hit").over(w)})
        return rows.where("orig_id is not null and n > 0").select("orig_id", "best", "n")

    order = ("us", "side", "id", "turn")
    upto, after = (probes(0, 0, 0, -1), probes(0, 0, 0, 1)) if one_table else (probes(0, 0, 1, 0), probes(0, 0, 1, 0))
    hits = answered(upto.unionByName(probes(1, width, 1, 0)), *order).unionByName(answered(after.unionByName(probes(-1, -width, -1, 0)), *map(F.desc, order)))
    return hits.groupBy("orig_id").agg(F.min("best").alias("b"), F.sum("n").alias("n_candidates")).select("orig_id", F.col("b.cand_id").alias("cand_id"), "n_candidates")

"""State machines over event logs: freshness, transitions, cool-down gates, token buckets, budgets, sessions.

Cool-downs and buckets depend on what was let through before, so they are folds in time order; a fold runs in
Arrow batches over partitions sorted by key and time, which streams a key of any size with constant memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

# Seconds.
TTL, LEGACY_TTL, COOLDOWN = 7 * 86_400, 86_400, 300
BLOCKING = ("BOT_CHALLENGE", "HTTP_BLOCKED")


# What turns automatic renewal off; the least seconds of a setting.
OFF = ("0", "off", "false", "no")


def skip_reason(disabled: Column, switch: Column, pin: Column, explicit: Column) -> Column:
    """Why rules aren't renewed; empty where they may be."""
    given = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.when(disabled, "disabled_cli").when(F.lower(given(switch)).isin(*OFF), "disabled_env").when(given(pin) != "", "pinned").when(explicit.isNotNull(), "explicit_sites_js").otherwise("")


def clamped(setting: Column, default: int, least: int = 0) -> Column:
    """A number of seconds from a text setting: absent or odd ones are the default, small ones the least."""
    raw = F.trim(setting)
    return F.when(raw.rlike(r"^[+-]?[0-9]{1,18}$"), F.greatest(raw.cast("long"), F.lit(least).cast("long"))).otherwise(F.lit(default).cast("long"))


def manifests(raw: Column, fallback: Column, schema: str) -> Column:
    """The manifest inside a snapshot's JSON; where that is absent or corrupt the one that stands alone; null where both are."""
    own = F.from_json(F.get_json_object(raw, "$.manifest"), schema)
    return F.coalesce(F.when(F.startswith(F.trim(F.get_json_object(raw, "$.manifest")), F.lit("{")), own), F.when(F.startswith(F.trim(F.get_json_object(fallback, "$")), F.lit("{")), F.from_json(fallback, schema)))


def freshness(now: Column, fetched_at: Column, revalidate_after: Column, stale: Column, ttl: int = TTL) -> Column:
    """missing and corrupt are told apart by the caller's null record; else backoff, corrupt, expired or fresh."""
    age = F.unix_micros(now) - F.unix_micros(fetched_at)
    return F.when(revalidate_after.isNotNull() & (now < revalidate_after), "backoff").when(fetched_at.isNull(), "corrupt").when((age < 0) | F.coalesce(stale, F.lit(False)), "expired").when(age < ttl * 1_000_000, "fresh").otherwise("expired")


def transition(ok: Column, now: Column, fetched_at: Column, version: Column, old_hash: Column, new_hash: Column, backoff: int = 3600) -> dict[str, Column]:
    """The next manifest: a success renews it; a failure keeps its time, backs off and keeps the version of equal content."""
    fresh = F.concat(F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("#sha256:"), F.left(new_hash, F.lit(12)))
    keep = ~ok & (F.coalesce(version, F.lit("")) != "") & (old_hash == new_hash)
    return {
        "next_fetched_at": F.when(ok, now).otherwise(F.coalesce(fetched_at, now)),
        "next_revalidate_after": F.when(~ok, F.timestamp_micros(F.unix_micros(now) + backoff * 1_000_000)),
        "next_version": F.when(keep, version).otherwise(fresh),
    }


def folded(spark: SparkSession, df: DataFrame, key: str, time_us: str, extra: list[str], step: Callable, start: Callable, name: str, kind: str = "boolean") -> DataFrame:
    """key, time_us, extra and what step(state, time, *extra) -> (state, value) gives, in order of time within the key.

    A fold is sequential, so a key is one task, however hot; its state is constant in size and its rows are streamed.
    """
    ship(spark)
    columns = [key, time_us, *extra]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for b in it:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in columns)):
                if row[0] != last:
                    last, state = row[0], start()
                state, value = step(state, *row[1:])
                out.append(value)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(out, {"boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32()}[kind])], names=[*columns, name])

    slim = df.select(*columns)
    ddl = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in columns) + f", {name} {kind}"
    return slim.repartition(key).sortWithinPartitions(key, time_us, *extra).mapInArrow(run, ddl)


def cooldown(spark: SparkSession, df: DataFrame, key: str, time_us: str, code: str, seq: str, seconds: int = COOLDOWN) -> DataFrame:
    """Adds allowed: false while a key cools down after a blocking failure. What isn't allowed has no outcome."""

    def step(until, t, s, c):
        if until is not None and t < until:
            return until, False
        return (t + seconds * 1_000_000 if c in BLOCKING else None if c in (None, "") else None), True

    return folded(spark, df, key, time_us, [seq, code], step, lambda: None, "allowed")


def token_bucket(spark: SparkSession, df: DataFrame, key: str, time_us: str, seq: str, rate: float = 1.0, burst: float = 2.0) -> DataFrame:
    """Adds allowed: whether a token was there; tokens come back at a rate up to the burst."""

    def step(state, t, s):
        tokens, at = state
        tokens = burst if at is None else min(burst, tokens + (t - at) / 1e6 * rate)
        return ((tokens - 1.0, t), True) if tokens >= 1.0 else ((tokens, t), False)

    return folded(spark, df, key, time_us, [seq], step, lambda: (burst, None), "allowed")


def concurrent(spark: SparkSession, df: DataFrame, key: str, time_us: str, seq: str, end_us: str, most: int = 2) -> DataFrame:
    """Adds allowed: whether fewer than so many of the key's allowed events were still running; an event runs up to its end."""

    def step(running, t, s, end):
        running = [x for x in running if x > t]
        return (running + [end], True) if len(running) < most else (running, False)

    return folded(spark, df, key, time_us, [seq, end_us], step, list, "allowed")


def too_soon(df: DataFrame, key: str, time: str, seq: str, seconds: float = 2.0) -> DataFrame:
    """Adds too_soon: less than so many seconds after the key's event before."""
    from pyspark.sql import Window as W

    before = F.lag(time).over(W.partitionBy(key).orderBy(time, seq))
    us = lambda x: F.unix_micros(x.cast("timestamp"))
    return df.withColumn("too_soon", F.coalesce(us(F.col(time)) - us(before) < int(seconds * 1e6), F.lit(False)))


def within_budget(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each key."""
    from pyspark.sql import Window as W

    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")

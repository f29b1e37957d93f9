"""Queries of the streaming jobs: events as they landed, read as a stream to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import gates, jobs
from .q_attempts import _BUCKET, _COOL, _LOG, _RUNNING, CODES
from .registry import query


def attempts(spark, sf):
    """Events as a stream of attempts; an event type stands for a domain."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")  # a pattern, as a stream's plain path must be a folder
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("event_id") % 11 + 1).cast("int"))
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("request_id"), F.col("event_type").alias("domain"), (F.floor(F.col("value") * 10) - 5).alias("elapsed_ms"), code.alias("error_code"), F.col("ts").cast("timestamp").alias("ts"))


def _day(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("stream_rates", f"WITH {_LOG} SELECT engine AS domain, strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS started, count(*)::BIGINT AS n, count(*) FILTER (error_code <> '')::BIGINT AS n_failed FROM log GROUP BY ALL")
def stream_rates(spark, sf):
    r = jobs.drained(spark, jobs.rates(attempts(spark, sf), "6 hours"), "complete")
    return r.select("domain", _day("start").alias("started"), "n", "n_failed")


@query("stream_sessions", f"WITH {_LOG}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS first FROM log WINDOW w AS (PARTITION BY request_id ORDER BY ts)), s AS (SELECT *, sum(first) OVER (PARTITION BY request_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT request_id::VARCHAR AS domain, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*)::BIGINT AS n, sum(elapsed_ms)::BIGINT AS elapsed_ms FROM s GROUP BY request_id, k")
def stream_sessions(spark, sf):
    s = jobs.drained(spark, jobs.sessions(attempts(spark, sf).withColumn("domain", F.col("request_id").cast("string")), "6 hours"), "complete")
    return s.select("domain", _day("start").alias("started"), "n", "elapsed_ms")


def _gated(spark, sf, rule, key="request_id", **columns):
    """What a rule says of all events: a closing row that lands with them moves the watermark past the last one."""
    landed = attempts(spark, sf).withColumns({"domain": F.col(key).cast("string"), "end_us": F.lit(0).cast("long"), **columns}).select("domain", "seq", "ts", "error_code", "end_us")
    with gates.stateful(spark):
        return jobs.drained(spark, gates.judged(spark, landed.unionByName(gates.closing(spark)), rule, slot_seconds=7 * 86_400))


@query("stream_gate", _COOL)
def stream_gate(spark, sf):
    """The batch query cooldown_gate has the same SQL."""
    out = _gated(spark, sf, gates.CoolDown(86_400))
    return out.where("event <> 'reopened'").select("seq", (F.col("event") == "allowed").alias("allowed"))


@query("stream_reopened", f"{_COOL.replace('SELECT seq, allowed FROM f', '')} SELECT request_id::VARCHAR AS domain, strftime(make_timestamp(until), '%Y-%m-%d %H:%M:%S') AS reopened FROM f WHERE allowed AND until IS NOT NULL")
def stream_reopened(spark, sf):
    """When each cool-down ran out, told by a timer: no attempt comes at that time."""
    out = _gated(spark, sf, gates.CoolDown(86_400))
    return out.where("event = 'reopened'").select("domain", _day("ts").alias("reopened"))


@query("stream_token_bucket", _BUCKET)
def stream_token_bucket(spark, sf):
    """The batch query token_bucket has the same SQL."""
    out = _gated(spark, sf, gates.TokenBucket(0.00005, 2.0))
    return out.select(F.col("seq").alias("event_id"), (F.col("event") == "allowed").alias("allowed"))


@query("stream_concurrency", _RUNNING)
def stream_concurrency(spark, sf):
    """The batch query concurrency_bound has the same SQL."""
    end = F.unix_micros("ts") + F.lit(36_000_000_000) * (1 + F.col("seq") % 5)
    out = _gated(spark, sf, gates.Concurrency(2), end_us=end)
    return out.select(F.col("seq").alias("event_id"), (F.col("event") == "allowed").alias("allowed"))


@query("stream_first_seen", "SELECT DISTINCT event_type || '/' || user_id AS address FROM events")
def stream_first_seen(spark, sf):
    """Each address of the events once, whatever its spelling: the state forgets an address once the watermark has passed it."""
    e = attempts(spark, sf)
    url = F.concat(F.lit("HTTPS://Events.Example/"), "domain", F.lit("/"), F.col("request_id").cast("string"), F.lit("?utm_source=s"), F.col("seq").cast("string"), F.lit("#top"))
    seen = jobs.drained(spark, jobs.first_seen(e.select(url.alias("url"), "ts"), "60 days"))
    return seen.select(F.regexp_extract("canonical", r"^https://events\.example/(.*)$", 1).alias("address"))

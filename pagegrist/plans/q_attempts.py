"""Queries of attempt logs, evaluation runs and state machines; events stand in for logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import attempts as A
from ..operators import state as S
from ..sources import registries as R
from .registry import query

# What stands in for outcomes: error codes by event number.
CODES = ("", "NETWORK", "BOT_CHALLENGE", "", "HTTP_BLOCKED", "PAYWALL_REMAINING", "EXTRACT_FAILED", "ODD_CODE", "", "ARCHIVE_FAILED", "SSRF_BLOCKED")
_CODE = "CASE event_id % 11 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODES)) + " END"
_LOG = f"log AS (SELECT event_id AS seq, user_id AS request_id, event_type AS engine, (floor(value * 10) - 5)::BIGINT AS elapsed_ms, {_CODE} AS error_code, ts, event_id FROM events)"
_KNOWN = "CASE WHEN error_code IN ('SSRF_BLOCKED', 'PAYWALL_REMAINING', 'BOT_CHALLENGE', 'HTTP_BLOCKED', 'BROWSER_UNAVAILABLE', 'NETWORK', 'EXTRACT_FAILED', 'ARCHIVE_FAILED', 'NO_STRATEGY', 'INTERNAL') THEN error_code ELSE 'INTERNAL' END"
_PRIORITY = "CASE code WHEN 'SSRF_BLOCKED' THEN 100 WHEN 'PAYWALL_REMAINING' THEN 90 WHEN 'BOT_CHALLENGE' THEN 80 WHEN 'HTTP_BLOCKED' THEN 70 WHEN 'NETWORK' THEN 50 WHEN 'EXTRACT_FAILED' THEN 40 WHEN 'ARCHIVE_FAILED' THEN 30 ELSE 10 END"
_CLASS = "CASE code WHEN 'SSRF_BLOCKED' THEN 'config' WHEN 'PAYWALL_REMAINING' THEN 'strategy' WHEN 'BOT_CHALLENGE' THEN 'bot' WHEN 'HTTP_BLOCKED' THEN 'bot' WHEN 'NETWORK' THEN 'network' WHEN 'EXTRACT_FAILED' THEN 'extract' WHEN 'ARCHIVE_FAILED' THEN 'network' ELSE 'config' END"


def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def log(spark, sf):
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("event_id") % 11 + 1).cast("int"))
    return events(spark, sf).select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("request_id"), F.col("event_type").alias("engine"), (F.floor(F.col("value") * 10) - 5).alias("elapsed_ms"),
        code.alias("error_code"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("int").alias("status"), "ts",
    )


@query("engine_timings", f"WITH {_LOG} SELECT engine, sum(greatest(elapsed_ms, 0))::BIGINT AS elapsed_ms, count(*)::BIGINT AS n FROM log GROUP BY engine")
def engine_timings(spark, sf):
    return A.normalized(log(spark, sf)).groupBy("engine").agg(F.sum("elapsed_ms").alias("elapsed_ms"), F.count("*").alias("n"))


@query("request_timings", f"WITH {_LOG}, s AS (SELECT request_id, engine, sum(greatest(elapsed_ms, 0))::BIGINT AS ms FROM log GROUP BY ALL) SELECT request_id, string_agg(engine || '=' || ms, ',' ORDER BY engine) AS timings FROM s GROUP BY request_id")
def request_timings(spark, sf):
    t = A.engine_timings(log(spark, sf), "request_id")
    shown = F.transform(F.array_sort(F.map_entries("engine_timings_ms")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return t.select("request_id", F.array_join(shown, ",").alias("timings"))


@query("batch_timings", f"WITH {_LOG}, s AS (SELECT request_id % 10 AS batch, engine, sum(greatest(elapsed_ms, 0))::BIGINT AS ms FROM log GROUP BY ALL) SELECT batch, string_agg(engine || '=' || ms, ',' ORDER BY engine) AS timings FROM s GROUP BY batch")
def batch_timings(spark, sf):
    children = A.engine_timings(log(spark, sf), "request_id").withColumn("batch", F.col("request_id") % 10)
    shown = F.transform(F.array_sort(F.map_entries("engine_timings_ms")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return A.rolled_up(children, "batch").select("batch", F.array_join(shown, ",").alias("timings"))


_BATCH = f"""{_LOG}, i AS (SELECT request_id, request_id % 10 AS batch, row_number() OVER (PARTITION BY request_id % 10 ORDER BY request_id) AS place, min(engine) AS domain FROM log GROUP BY request_id)"""


def _batches(spark, sf):
    requests = log(spark, sf).groupBy("request_id").agg(F.min("engine").alias("domain")).withColumn("batch", F.col("request_id") % 10)
    return A.batch_scope(requests, "batch", "request_id", "domain", 20)


@query("batch_scopes", f"WITH {_BATCH}, k AS (SELECT * FROM i WHERE place <= 20) SELECT batch, count(*)::BIGINT AS n, count(DISTINCT domain) = 1 AS in_scope FROM k GROUP BY batch")
def batch_scopes(spark, sf):
    """Batches capped at their first 20 requests."""
    return _batches(spark, sf).groupBy("batch").agg(F.count("*").alias("n"), F.bool_and("in_scope").alias("in_scope"))


@query("batch_attempts", f"WITH {_BATCH} SELECT i.batch, i.request_id AS place, 'item' || i.request_id AS scope, l.seq, l.engine, greatest(elapsed_ms, 0)::BIGINT AS elapsed_ms, l.error_code FROM log l JOIN i ON l.request_id = i.request_id AND i.place <= 20")
def batch_attempts(spark, sf):
    items = _batches(spark, sf).withColumn("scope", F.concat(F.lit("item"), F.col("request_id").cast("string")))
    return A.batch_attempts(log(spark, sf), items.withColumn("at", F.col("request_id")), "batch", "at").select("batch", "place", "scope", "seq", "engine", "elapsed_ms", "error_code")


@query("batch_quality", f"WITH {_LOG} SELECT request_id % 10 AS batch, bool_or(error_code <> 'SSRF_BLOCKED') AS evaluated, count(*) FILTER (error_code <> 'SSRF_BLOCKED')::BIGINT AS n_evaluated, count(*) FILTER (error_code = '')::BIGINT AS n_ok FROM log GROUP BY 1")
def batch_quality(spark, sf):
    children = log(spark, sf).select((F.col("request_id") % 10).alias("batch"), (F.col("error_code") != "SSRF_BLOCKED").alias("evaluated"), (F.col("error_code") == "").alias("ok"))
    return A.batch_quality(children, "batch")


@query("syndication_eligible", f"WITH {_LOG}, f AS (SELECT *, {_KNOWN} AS code FROM log WHERE error_code <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {_PRIORITY} DESC, seq DESC) AS k FROM f) SELECT request_id, request_id % 2 = 0 AND code IN ('PAYWALL_REMAINING', 'BOT_CHALLENGE', 'HTTP_BLOCKED') AS eligible FROM r WHERE k = 1")
def syndication_eligible(spark, sf):
    """Requests whose best failure may be answered by a syndicated article; every second one is for the outlet that has a policy for it."""
    failed = A.best_failure(log(spark, sf), "request_id", "seq").withColumn("domain", F.when(F.col("request_id") % 2 == 0, "bloomberg.com").otherwise("ft.com"))
    p = R.derived_policies(failed)
    return p.select("request_id", R.may_syndicate(F.col("domain"), F.col("error_code"), F.col("representation_mode")).alias("eligible"))


@query("best_failure", f"WITH {_LOG}, f AS (SELECT *, {_KNOWN} AS code FROM log WHERE error_code <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {_PRIORITY} DESC, seq DESC) AS k FROM f) SELECT request_id, code AS error_code, {_CLASS} AS failure_class, seq FROM r WHERE k = 1")
def best_failure(spark, sf):
    return A.best_failure(log(spark, sf), "request_id", "seq")


@query("first_success", f"WITH {_LOG}, o AS (SELECT request_id, min(seq) AS ok FROM log WHERE error_code = '' GROUP BY request_id) SELECT l.request_id, l.seq, l.error_code FROM log l LEFT JOIN o USING (request_id) WHERE ok IS NULL OR seq <= ok")
def first_success(spark, sf):
    return A.until_first_success(log(spark, sf), "request_id", "seq").select("request_id", "seq", "error_code")


_ITEMS = "items AS (SELECT event_id AS url, event_type AS domain, user_id % 2 AS run, event_id % 3 <> 0 AS raw_ok, event_id % 4 <> 0 AND event_id % 3 <> 0 AS ok, CASE WHEN event_id % 5 < 2 THEN 'easy' ELSE 'hard' END AS tier, value AS elapsed_sec FROM events)"


def items(spark, sf):
    i = F.col("event_id")
    return events(spark, sf).select(
        i.alias("url"), F.col("event_type").alias("domain"), (F.col("user_id") % 2).alias("run"), (i % 3 != 0).alias("raw_ok"), ((i % 4 != 0) & (i % 3 != 0)).alias("ok"),
        F.when(i % 5 < 2, "easy").otherwise("hard").alias("tier"), F.col("value").alias("elapsed_sec"),
    )


@query("eval_by_domain", f"WITH {_ITEMS} SELECT domain, count(*)::BIGINT AS total, count(*) FILTER (ok)::BIGINT AS n_ok, round(count(*) FILTER (ok) / count(*)::DOUBLE, 4) AS rate FROM items GROUP BY domain")
def eval_by_domain(spark, sf):
    return A.by_domain(items(spark, sf))


@query("eval_meta", f"WITH {_ITEMS} SELECT count(*)::BIGINT AS total, count(*) FILTER (raw_ok)::BIGINT AS raw_ok_count, count(*) FILTER (ok)::BIGINT AS ok_count, max(elapsed_sec) AS max_elapsed_sec, round(median(elapsed_sec) FILTER (tier = 'easy'), 3) AS easy_p50_sec, round(count(*) FILTER (raw_ok) / count(*)::DOUBLE, 4) AS raw_success_rate, round(count(*) FILTER (ok) / count(*)::DOUBLE, 4) AS success_rate FROM items")
def eval_meta(spark, sf):
    return A.run_meta(items(spark, sf))


@query("baseline_diff", f"WITH {_ITEMS}, c AS (SELECT domain, run, count(*) FILTER (ok)::BIGINT AS n FROM items GROUP BY ALL) SELECT b.domain, b.n AS baseline_ok, c.n AS current_ok, b.n - c.n AS drop FROM c AS b JOIN c ON b.domain = c.domain AND b.run = 0 AND c.run = 1 WHERE b.n - c.n >= 2")
def baseline_diff(spark, sf):
    i = items(spark, sf)
    return A.regressions(A.by_domain(i.where("run = 0")), A.by_domain(i.where("run = 1")))


@query("url_added_removed", "WITH b AS (SELECT DISTINCT user_id AS url FROM events WHERE event_id % 2 = 0 AND user_id % 3 <> 0), c AS (SELECT DISTINCT user_id AS url FROM events WHERE event_id % 2 = 1 AND user_id % 3 <> 1) SELECT url, 'added' AS change FROM (SELECT * FROM c EXCEPT SELECT * FROM b) UNION ALL SELECT url, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM c)")
def url_added_removed(spark, sf):
    e = events(spark, sf).select("event_id", F.col("user_id").alias("url"))
    return A.set_changes(e.where("event_id % 2 = 0 and url % 3 <> 0"), e.where("event_id % 2 = 1 and url % 3 <> 1"), "url")


@query("budget_cut", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 5")
def budget_cut(spark, sf):
    return S.within_budget(events(spark, sf), "user_id", ["ts", "event_id"], 5).select("user_id", "event_id")


@query("interval_throttle", "SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 7200000000, false) AS too_soon FROM events")
def interval_throttle(spark, sf):
    return S.too_soon(events(spark, sf), "user_id", "ts", "event_id", 7200).select("event_id", "too_soon")


_FRESH = "CASE WHEN event_id % 13 = 0 AND now < ts + INTERVAL 20 DAY THEN 'backoff' WHEN event_id % 17 = 0 THEN 'corrupt' WHEN now < ts OR event_id % 5 = 0 THEN 'expired' WHEN now - ts < INTERVAL 7 DAY THEN 'fresh' ELSE 'expired' END"


@query("freshness_state", f"SELECT event_id, {_FRESH} AS state FROM (SELECT *, TIMESTAMP '2024-01-15 00:00:00' AS now FROM events)")
def freshness_state(spark, sf):
    i, now = F.col("event_id"), F.lit("2024-01-15 00:00:00").cast("timestamp")
    retry = F.when(i % 13 == 0, F.col("ts") + F.expr("interval 20 days")).cast("timestamp")
    got = F.when(i % 17 != 0, F.col("ts")).cast("timestamp")
    return events(spark, sf).select("event_id", S.freshness(now, got, retry, i % 5 == 0).alias("state"))


@query("manifest_transition", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '2024-02-01T00:00:00Z' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS next_fetched_at, CASE WHEN event_id % 3 <> 0 THEN '2024-02-01T01:00:00Z' END AS next_revalidate_after, CASE WHEN event_id % 3 <> 0 AND event_id % 2 = 0 THEN 'v' || event_id ELSE '2024-02-01T00:00:00Z#sha256:' || left(md5(event_type), 12) END AS next_version FROM events")
def manifest_transition(spark, sf):
    i, now = F.col("event_id"), F.lit("2024-02-01 00:00:00").cast("timestamp")
    new = F.md5(F.col("event_type").cast("binary"))
    t = S.transition(i % 3 == 0, now, F.col("ts").cast("timestamp"), F.concat(F.lit("v"), i.cast("string")), F.when(i % 2 == 0, new).otherwise("x"), new)
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return events(spark, sf).select("event_id", text(t["next_fetched_at"]).alias("next_fetched_at"), text(t["next_revalidate_after"]).alias("next_revalidate_after"), t["next_version"].alias("next_version"))


@query("renewal_decisions", "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'disabled_cli' WHEN event_id % 7 = 0 THEN 'disabled_env' WHEN event_id % 5 = 0 THEN 'pinned' WHEN event_id % 3 = 0 THEN 'explicit_sites_js' ELSE '' END AS skip, CASE event_id % 4 WHEN 0 THEN 3600 WHEN 1 THEN event_id WHEN 2 THEN 30 ELSE 3600 END::BIGINT AS seconds, CASE event_id % 4 WHEN 0 THEN 'snap' WHEN 1 THEN 'alone' WHEN 2 THEN 'alone' END AS version FROM events")
def renewal_decisions(spark, sf):
    """Why a renewal is skipped, clamped settings, and manifests of whole, corrupt and absent snapshots."""
    i = F.col("event_id")
    skip = S.skip_reason(i % 11 == 0, F.when(i % 7 == 0, " OFF ").otherwise("on"), F.when(i % 5 == 0, "v1"), F.when(i % 3 == 0, "/rules.js"))
    setting = F.when(i % 4 == 1, (i + 0).cast("string")).when(i % 4 == 2, "-5").when(i % 4 == 3, "1h")
    seconds = F.when(i % 4 == 2, S.clamped(setting, 3600, 30)).otherwise(S.clamped(setting, 3600))
    snap = F.when(i % 4 == 0, '{"manifest": {"version": "snap"}}').when(i % 4 == 1, '{"manifest": [1]}').when(i % 4 == 2, "{broken")
    alone = F.when(i % 4 == 3, "[1, 2]").otherwise('{"version": "alone"}')
    return events(spark, sf).select("event_id", skip.alias("skip"), seconds.alias("seconds"), S.manifests(snap, alone, "version string")["version"].alias("version"))


_RUNNING = """WITH RECURSIVE n AS (SELECT user_id, event_id, epoch_us(ts) AS t, epoch_us(ts) + 36000000000 * (1 + event_id % 5) AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, true AS allowed, [e] AS running FROM n WHERE k = 1
  UNION ALL SELECT user_id, event_id, k, len(r) < 2, CASE WHEN len(r) < 2 THEN list_append(r, e) ELSE r END FROM (SELECT n.user_id, n.event_id, n.k, n.e, list_filter(f.running, lambda x: x > n.t) AS r FROM f JOIN n ON n.user_id = f.user_id AND n.k = f.k + 1))
SELECT event_id, allowed FROM f"""


@query("concurrency_bound", _RUNNING)
def concurrency_bound(spark, sf):
    """Events that run for ten to fifty hours, two of a user at a time."""
    e = events(spark, sf).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.withColumn("e", F.col("t") + F.lit(36_000_000_000) * (1 + F.col("event_id") % 5))
    return S.concurrent(spark, e, "user_id", "t", "event_id", "e").select("event_id", "allowed")


_COOL = f"""WITH RECURSIVE {_LOG}, n AS (SELECT request_id, seq, error_code, epoch_us(ts) AS t, row_number() OVER (PARTITION BY request_id ORDER BY ts, seq) AS k FROM log),
f AS (SELECT request_id, seq, k, t, true AS allowed, CASE WHEN error_code IN ('BOT_CHALLENGE', 'HTTP_BLOCKED') THEN t + 86400000000 END AS until FROM n WHERE k = 1
  UNION ALL SELECT n.request_id, n.seq, n.k, n.t, f.until IS NULL OR n.t >= f.until, CASE WHEN f.until IS NOT NULL AND n.t < f.until THEN f.until WHEN n.error_code IN ('BOT_CHALLENGE', 'HTTP_BLOCKED') THEN n.t + 86400000000 END FROM f JOIN n ON n.request_id = f.request_id AND n.k = f.k + 1)
SELECT seq, allowed FROM f"""


@query("cooldown_gate", _COOL)
def cooldown_gate(spark, sf):
    """Cool-downs of a day, as events are hours apart."""
    e = log(spark, sf).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return S.cooldown(spark, e, "request_id", "t", "error_code", "seq", 86_400).select("seq", "allowed")


_BUCKET = """WITH RECURSIVE n AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, k, t, true AS allowed, 1.0::DOUBLE AS tokens FROM n WHERE k = 1
  UNION ALL SELECT user_id, event_id, k, t, have >= 1.0, CASE WHEN have >= 1.0 THEN have - 1.0 ELSE have END FROM (SELECT n.user_id, n.event_id, n.k, n.t, least(2.0::DOUBLE, f.tokens + (n.t - f.t) / 1e6::DOUBLE * 0.00005::DOUBLE) AS have FROM f JOIN n ON n.user_id = f.user_id AND n.k = f.k + 1))
SELECT event_id, allowed FROM f"""


@query("token_bucket", _BUCKET)
def token_bucket(spark, sf):
    """A slow bucket, as events are hours apart."""
    e = events(spark, sf).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return S.token_bucket(spark, e, "user_id", "t", "event_id", 0.00005, 2.0).select("event_id", "allowed")


@query("session_windows", "WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k")
def session_windows(spark, sf):
    e = events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n", "total")


@query("hourly_windows", "SELECT event_type, strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS started, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def hourly_windows(spark, sf):
    e = events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.window("ts", "6 hours")).agg(F.count("*").alias("n")).select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


def _wired():
    """The orders have neither address nor attribution: every third one is of another host, and of four one names no agency and one names it too late."""
    k = F.col("o_orderkey")
    url = F.when(k % 3 == 0, "https://notwire.example/a").otherwise(F.concat(F.lit("https://news.wire.example/"), k.cast("string")))
    late = F.concat(F.repeat(F.lit("x"), 4000), F.lit("(Agency)"))
    return url.alias("url"), F.when(k % 4 == 1, "By a reporter").when(k % 4 == 2, late).otherwise("By a reporter (Agency)").alias("attribution_text")


@query("syndication_match", "SELECT o.o_orderkey AS orig_id, min(c.o_orderkey) AS cand_id, count(*)::BIGINT AS n_candidates FROM orders o JOIN orders c ON o.o_custkey = c.o_custkey AND o.o_orderkey <> c.o_orderkey WHERE abs(epoch_us(o.o_orderdate::TIMESTAMP) - epoch_us(c.o_orderdate::TIMESTAMP)) <= 172800000000 AND c.o_orderkey % 3 <> 0 AND c.o_orderkey % 4 IN (0, 3) GROUP BY 1")
def syndication_match(spark, sf):
    """All orders against all others, a title for each customer."""
    return _syndicated(spark, sf, F.col("o_custkey").cast("string"))


@query("syndication_hot_title", "SELECT o.o_orderkey AS orig_id, min(c.o_orderkey) AS cand_id, count(*)::BIGINT AS n_candidates FROM orders o JOIN orders c ON o.o_orderkey <> c.o_orderkey AND o.o_custkey % 2 = c.o_custkey % 2 WHERE abs(epoch_us(o.o_orderdate::TIMESTAMP) - epoch_us(c.o_orderdate::TIMESTAMP)) <= 172800000000 AND c.o_orderkey % 3 <> 0 AND c.o_orderkey % 4 IN (0, 3) GROUP BY 1")
def syndication_hot_title(spark, sf):
    """Two titles for all orders: each holds half of the rows."""
    return _syndicated(spark, sf, (F.col("o_custkey") % 2).cast("string"))


def _syndicated(spark, sf, name):
    title = T.normalize_title(F.concat(F.lit("Title: No. "), name, F.lit("!")))
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", title.alias("title_key"), F.col("o_orderdate").cast("timestamp").alias("published"), *_wired())
    originals = o.select(F.col("o_orderkey").alias("orig_id"), "url", "title_key", "published")
    candidates = o.select(F.col("o_orderkey").alias("cand_id"), "url", "title_key", "published", "attribution_text", F.col("o_orderkey").alias("seq"))
    return A.syndicated(originals, candidates, "wire.example", "(agency)", one_table=True)


@query("batch_summary", "SELECT conv_id, count(*)::BIGINT AS n_items, count(*) FILTER (length(text) >= 100)::BIGINT AS success, count(*) FILTER (length(text) < 100)::BIGINT AS failed FROM conversations GROUP BY conv_id")
def batch_summary(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    ok = F.length("text") >= 100
    return c.groupBy("conv_id").agg(F.count("*").alias("n_items"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"))


@query("shrink_guard", "SELECT e.event_type, e.n AS existing, c.n AS candidate, c.n < e.n * 0.8::DOUBLE AS rejected FROM (SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1) e JOIN (SELECT event_type, count(*)::BIGINT AS n FROM events WHERE event_id % 10 < CASE WHEN event_type < 'n' THEN 7 ELSE 9 END GROUP BY 1) c USING (event_type)")
def shrink_guard(spark, sf):
    e = events(spark, sf)
    kept = F.col("event_id") % 10 < F.when(F.col("event_type") < "n", 7).otherwise(9)
    n = e.groupBy("event_type").agg(F.count("*").alias("existing"), F.count_if(kept).alias("candidate"))
    return n.withColumn("rejected", F.col("candidate") < F.col("existing") * F.lit(0.8))


@query("discovery_datetimes", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS parsed FROM events")
def discovery_datetimes(spark, sf):
    """The three notations that feeds use, written and read again."""
    ts = F.col("ts").cast("timestamp")
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.concat(F.lit("Mon, "), F.date_format(ts, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(k == 1, F.concat(F.date_format(ts, "dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return events(spark, sf).select("event_id", F.date_format(T.discovery_datetime(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"))

"""Chains of candidates, gates over streams, interval matching, medians by selection, exclusion bitmaps, rule texts."""

import json
import random
import statistics
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagegrist.functions import urls as U
from pagegrist.operators import attempts, chain, state
from pagegrist.plans import registry
from pagegrist.sources import rules
from pagegrist.streaming import gates


def test_only_open_requests_go_on(spark):
    seen = []

    def stage(codes):
        def run(opened):
            seen.append(sorted(r.key for r in opened.select("key").collect()))
            rows = [(k, i, "e", 200, 10, c) for k, cs in codes.items() for i, c in enumerate(cs)]
            made = spark.createDataFrame(rows, "key string, place int, engine string, status int, elapsed_ms int, error_code string")
            return made.join(opened.select("key"), "key", "left_semi")

        return run

    requests = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",), ("a",), (None,)], "key string")
    first = {"a": ["NETWORK", "", "NETWORK"], "b": ["SSRF_BLOCKED", ""], "c": ["PAYWALL_REMAINING"], "d": ["NETWORK"], "x": [""]}
    r = chain.resolve(spark, requests, "key", [("one", stage(first)), ("two", stage({"c": ["NETWORK", "ODD"], "d": [None], "a": ["NETWORK"]})), ("three", stage({}))])
    assert seen == [["a", "b", "c", "d", "e"], ["c", "d", "e"], ["c", "e"]]
    assert r.stages == [("one", 5, 5, 2), ("two", 3, 3, 1), ("three", 2, 0, 0)]
    got = {x.key: (x.ok, x.stage, x.error_code, x.failure_class, x.n_attempts, x.n_stages, x.elapsed_ms) for x in r.outcomes.collect()}
    assert got == {
        "a": (True, "one", "", "", 2, 1, 20), "b": (False, "", "SSRF_BLOCKED", "config", 1, 1, 10), "c": (False, "", "PAYWALL_REMAINING", "strategy", 3, 2, 30),
        "d": (True, "two", "", "", 2, 2, 20), "e": (False, "", "NO_STRATEGY", "strategy", 0, 0, 0),
    }


def test_a_chain_that_is_done_stops(spark):
    def all_good(opened):
        return opened.selectExpr("key", "0 as place", "'e' as engine", "200 as status", "1 as elapsed_ms", "'' as error_code")

    def never(opened):
        raise AssertionError("no request is open")

    r = chain.resolve(spark, spark.createDataFrame([(1,), (2,)], "key int"), "key", [("good", all_good), ("never", never)])
    assert r.stages == [("good", 2, 2, 2), ("never", 0, 0, 0)] and r.outcomes.where("ok").count() == 2
    empty = chain.resolve(spark, spark.createDataFrame([], "key int"), "key", [("never", never)])
    assert empty.stages == [("never", 0, 0, 0)] and empty.outcomes.count() == 0


def test_stage_counts_add_up(spark, sf):
    rows = {r.stage: r for r in registry.queries()["candidate_chain_stages"](spark, sf).collect()}
    order = [rows[n] for n in ("guard", "direct", "newest", "first")]
    assert order[0].n_in == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert all(b.n_in == a.n_in - a.n_ended for a, b in zip(order, order[1:])) and all(r.n_ended for r in order)


SCHEMA = "domain string, seq long, ts timestamp, error_code string, end_us long"


def landed(spark, tmp_path, rows, files):
    """Rows dealt over files in an order that isn't that of their times; each file is a batch of its own."""
    for i in range(files):
        part = spark.createDataFrame([(d, s, datetime(2024, 1, 1) + timedelta(seconds=t), c, t * 1_000_000) for d, s, t, c in rows[i::files]], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    closing = spark.createDataFrame([(None, None, datetime(2200, 1, 1), None, 0)], SCHEMA)
    return closing


def judged(spark, tmp_path, rows, rule, files=3, late="10 days", **options):
    closing = landed(spark, tmp_path, rows, files)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with gates.stateful(spark):
        first = gates.judged(spark, stream, rule, late=late, **options)
        q = first.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        before = spark.read.schema(first.schema).parquet(str(tmp_path / "out")).count()
        closing.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # a later run goes on from the state
        q = first.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    return before, spark.read.schema(first.schema).parquet(str(tmp_path / "out")).collect()


def test_stream_judges_in_order_of_time_whatever_lands_first(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"d{i % 3}", i, rng.randrange(0, 40_000), rng.choice(["", "HTTP_BLOCKED", "NETWORK", None])) for i in range(150)]
    before, got = judged(spark, tmp_path, rows, gates.CoolDown(900), slot_seconds=1800)
    assert before == 0  # the watermark hadn't passed anything
    batch = spark.createDataFrame([(d, s, t * 1_000_000, c or "") for d, s, t, c in rows], "domain string, seq long, t long, error_code string")
    want = {r.seq: r.allowed for r in state.cooldown(spark, batch, "domain", "t", "error_code", "seq", 900).collect()}
    assert {r.seq: r.event == "allowed" for r in got if r.event != "reopened"} == want and not all(want.values())
    blocks = [(d, t) for d, s, t, c in rows if c == "HTTP_BLOCKED" and want[s]]
    assert sorted((r.domain, (r.ts - datetime(2024, 1, 1)).total_seconds()) for r in got if r.event == "reopened") == sorted((d, t + 900) for d, t in blocks)


def test_stream_leaves_late_attempts_out_and_keeps_state_between_runs(spark, tmp_path):
    rows = [("a", 1, 0, "HTTP_BLOCKED"), ("a", 2, 100, ""), ("a", 3, 20_000, ""), (None, 4, 20_001, ""), ("a", 5, 30_000, "HTTP_BLOCKED")]
    before, got = judged(spark, tmp_path, rows, gates.CoolDown(900), files=1, late="1 second", slot_seconds=60)
    assert before and {(r.domain, r.seq): r.event for r in got if r.seq} == {("a", 1): "allowed", ("a", 2): "refused", ("a", 3): "allowed", ("", 4): "allowed", ("a", 5): "allowed"}
    assert sum(r.event == "reopened" for r in got) == 2


def test_rules_of_gates_by_hand():
    bucket, s = gates.TokenBucket(1.0, 2.0), None
    out = []
    for t in (0, 0, 0, 500_000, 1_000_000, 9_000_000, 9_000_000, 9_000_000):
        s, ok = bucket.step(s, t, "", 0)
        out.append(ok)
    assert out == [True, True, False, False, True, True, True, False]
    most, s, out = gates.Concurrency(2), None, []
    for t, end in ((0, 10), (1, 5), (2, 9), (5, 20), (6, 7), (10, 11)):
        s, ok = most.step(s, t, "", end)
        out.append(ok)
    assert out == [True, True, False, True, False, True]


def _pairs(originals, candidates, width, same):
    out = {}
    for o, key, t in originals:
        hits = [(seq, c) for c, k, u, seq in candidates if k == key and abs(t - u) <= width and not (same and c == o)]
        if hits:
            out[o] = (min(hits)[1], len(hits))
    return out


@pytest.mark.parametrize("same", [True, False])
def test_interval_match_equals_all_pairs(spark, same):
    rng = random.Random(11)
    day = 86_400_000_000
    times = [rng.randrange(-4 * day, 12 * day) for _ in range(180)] + [2 * day * k for k in range(-2, 5)] * 2 + [2 * day + 1, 4 * day - 1]
    rows = [(i, rng.choice("abc"), t) for i, t in enumerate(times)]
    cands = [(i, k, t, rng.randrange(40)) for i, k, t in rows] if same else [(i + 50, rng.choice("abc"), rng.choice(times) + rng.choice((0, 2 * day, -2 * day, 1)), rng.randrange(40)) for i in range(150)]
    o = spark.createDataFrame([(i, "https://p.example/", k, t) for i, k, t in rows], "orig_id long, url string, title_key string, t long").withColumn("published", F.timestamp_micros("t"))
    c = spark.createDataFrame([(i, "https://w.example/", k, t, "Wire", s) for i, k, t, s in cands], "cand_id long, url string, title_key string, t long, attribution_text string, seq int").withColumn("published", F.timestamp_micros("t"))
    got = {r.orig_id: (r.cand_id, r.n_candidates) for r in attempts.syndicated(o, c, "w.example", "wire", one_table=same).collect()}
    assert got == _pairs(rows, cands, 2 * day, same)


def test_a_title_with_many_articles_stays_linear(spark):
    """One title, 60,000 articles over a year: all pairs would be 3.6e9, those within two days 4e7."""
    n = 60_000
    a = spark.range(n, numPartitions=4).selectExpr("id", "timestamp_micros(id * 525600000) as published")
    o = a.selectExpr("id as orig_id", "'https://p.example/' as url", "'t' as title_key", "published")
    c = a.selectExpr("id as cand_id", "'https://w.example/' as url", "'t' as title_key", "published", "'wire' as attribution_text", "id as seq")
    began = time.time()
    got = attempts.syndicated(o, c, "w.example", "wire", one_table=True).selectExpr("count(*) as n", "sum(n_candidates) as pairs", "sum(orig_id - cand_id) as far").first()
    near = 172_800_000_000 // 525_600_000
    assert got.n == n and got.pairs == 2 * (near * n - near * (near + 1) // 2)
    assert time.time() - began < 60


def test_median_is_exact(spark):
    rng = random.Random(2)
    cases = [[1.0], [1.0, 2.0], [5.0] * 9, [rng.gauss(0, 1) for _ in range(1001)], [rng.choice([1e-300, 1e300, -7.5, 0.1]) for _ in range(500)], [float(2**k) for k in range(-40, 40)], [0.1, 0.1, 0.1, 9.9], [rng.random() for _ in range(400)] + [1e9]]
    for values in cases:
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double").repartition(3)
        assert attempts.exact_median(df, "x") == statistics.median(values)
    assert attempts.exact_median(spark.createDataFrame([(None,)], "x double"), "x") is None


def test_exclusions_of_more_patterns_than_a_word_has_bits(spark):
    rng = random.Random(4)
    names = ["a.example", "b.a.example", "c.example", "www.c.example", "d.example", "none.example"]
    entries = [(i, f"e{i}", json.dumps({"domain": f"s{i}.example", "block_regex_general": f"/{{domain}}/{i % 140}", "excluded_domains": rng.sample(names[:5], rng.randrange(3))})) for i in range(150)]
    table = spark.createDataFrame(entries, "entry_seq int, name string, props string")
    domains = spark.createDataFrame([(n,) for n in [*names, "x.b.a.example", "example", "www.d.example"]], "domain string")
    bare = lambda d: d.removeprefix("www.")
    want = {}
    for (d,) in domains.collect():
        kept = []
        for i, _, p in entries:
            p = json.loads(p)
            if not any(bare(d) == bare(x) or bare(d).endswith("." + bare(x)) for x in p["excluded_domains"]):
                kept.append(p["block_regex_general"].replace("{domain}", p["domain"].replace(".", r"\.")))
        want[d] = list(dict.fromkeys(kept))
    assert {r.domain: r.patterns for r in rules.effective_patterns(domains, rules.global_patterns(table)).collect()} == want


def test_rule_texts_from_files(spark, tmp_path):
    for name, text in {"a.js": 'var defaultSites = {"A": {domain: "a.example", cs_param: {x: [1, {y: 2}]}}, "B": {domain: "b.example"}};', "b.js": "var defaultSites = {};", "c.js": '{"A": {domain: "c.example", exception: [{domain: "d.example", odd: 1}, {domain: "e.example", odd: 2}]}}'}.items():
        (tmp_path / name).write_text(text)
    files = spark.read.text(str(tmp_path), wholetext=True).withColumn("file", F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1))
    table = rules.read_rules(spark, files)
    assert sorted((r.file, r.entry_seq, r.name) for r in table.collect()) == [("a.js", 0, "A"), ("a.js", 1, "B"), ("c.js", 0, "A")]
    usage = {r.field: (r.n, r.status) for r in rules.field_usage(table).collect()}
    assert usage == {"domain": (5, "structural"), "cs_param": (1, "unmodeled"), "exception": (1, "structural"), "odd": (2, "unmodeled")}
    assert sorted((r.file, r.n_entries, r.n_domains, r.valid) for r in rules.usable(table, files, "file").collect()) == [("a.js", 2, 2, True), ("b.js", 0, 0, False), ("c.js", 1, 3, True)]


def test_zones_of_addresses(spark):
    cases = {"http://[fe80::1%25eth0]/": "private_ip:fe80::1%25eth0", "http://[fe80::1%eth0]:80/x": "private_ip:fe80::1%eth0", "http://[2606:2800:220:1::1%25a]/": "", "http://[::1%25]/": "private_ip:::1%25", "http://[fe80::1%a%b]/": ""}
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: r.s for r in df.select("url", U.safety(F.col("url")).alias("s")).collect()} == cases


def test_first_seen_gives_each_address_once(spark, sf):
    got = registry.queries()["stream_first_seen"](spark, sf).collect()
    assert len(got) == len({r.address for r in got})

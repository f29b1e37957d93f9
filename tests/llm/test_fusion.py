"""Language identification: every number of the fused odds in plain Python."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagegrist.llm import language_id as L


def brute(langs, table, pages):
    n, weight, pseudo = len(langs), L.WEIGHT, L.PSEUDO
    seen = []
    for r in pages:
        slots = L.triplets(L.visible(r.html or ""))
        likely = [float(sum(float(table[i][s]) for s in slots)) * min(len(slots), weight) / max(1, len(slots)) for i in range(n)]
        said = max(range(n), key=lambda i: (likely[i], -i)) if len(slots) else -1
        m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", (r.url or "").lower())
        host = m[1] if m else ""
        tail = re.search(r"\.([^.]+)$", host)
        tag = re.search(r"<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", r.html or "", re.S | re.I)
        declared = tag[1].lower() if tag and tag[1].lower() in langs else "other"
        seen.append((r.page_id, host, tail[1] if tail else "", declared, said, [x - max(likely) for x in likely]))
    by_host, by_suffix, whole, pairs = defaultdict(Counter), defaultdict(Counter), Counter(), Counter()
    for _, host, suffix, declared, said, _ in seen:
        if said >= 0:
            by_host[host][said] += 1
            by_suffix[suffix][said] += 1
            whole[said] += 1
            pairs[said, declared] += 1
    names = [*langs, "other"]
    out = []
    for page, host, suffix, declared, said, heard in seen:
        odds = []
        for i in range(n):
            spoken = math.log((pairs[i, declared] + pseudo / len(names)) / (sum(pairs[i, e] for e in names) + pseudo))
            prior = (whole[i] + 1) / (sum(whole.values()) + n)
            up = (by_suffix[suffix][i] + pseudo * prior) / (sum(by_suffix[suffix].values()) + pseudo)
            own, voted = int(said == i), int(said >= 0)
            odds.append(heard[i] + spoken + math.log((by_host[host][i] - own + pseudo * up) / (sum(by_host[host].values()) - voted + pseudo)))
        best = max(range(n), key=lambda i: (odds[i], -i))
        out.append((page, langs[best], 1 / sum(math.exp(x - odds[best]) for x in odds), langs[said] if said >= 0 else None, declared, host, suffix))
    return out


def test_fused_odds(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [
        (-1, None, None), (-2, "no address", "<p>"), (-3, "http://x.example.de/", "<html lang='xx'><p>Die der und</p></html>"), (-4, "https://u:p@WWW.a.example.com:80/x", '<HTML class=a LANG="DE"></html>'),
        (-5, "https://a.example.com/y", "<html lang=fr>" + "<p>the of and to in</p>" * 30), (-5, "https://a.example.com/y", "<html lang=fr>" + "<p>the of and to in</p>" * 30),
    ]
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").unionByName(spark.createDataFrame(odd, "page_id long, url string, html string"))
    langs, table = L.learn(docs)
    want = sorted(brute(langs, table, pages.collect()), key=repr)
    got = sorted((tuple(r) for r in L.identify(spark, pages, docs).select("page_id", "lang", "confidence", "text_lang", "declared", "host", "suffix").collect()), key=repr)
    assert [(w[0], w[1], *w[3:]) for w in want] == [(g[0], g[1], *g[3:]) for g in got]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-5)


def test_hot_host_and_names(spark, sf):
    """One host with most pages, and columns that the operator uses inside."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("url", F.when(F.col("page_id") % 3 > 0, "https://hot.example/a").otherwise(F.col("url")))
    clash = pages.select("*", *[F.lit(1).alias(c) for c in ("host", "suffix", "declared", "heard", "by_host", "up", "odds", "top", "spoken", "text_lang")])
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(L.identify(spark, clash, docs)) == rows(L.identify(spark, pages, docs))

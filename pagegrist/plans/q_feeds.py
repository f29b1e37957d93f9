"""Queries of feeds and sitemaps, which are made from pages, as there is no feed table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..sources import feeds
from .q_url import _CANON, _HOST, _PARTS, pages
from .registry import query


def bodies(spark, sf):
    """Ten pages make a feed: every third one Atom, every fourth a sitemap; some addresses repeat."""
    p = pages(spark, sf).select("page_id", "url", F.floor(F.col("page_id") / 10).alias("feed_id"))
    link = F.replace("url", F.lit("&"), F.lit("&amp;"))
    kind = F.when(F.col("feed_id") % 4 == 3, "sitemap").when(F.col("feed_id") % 3 == 2, "atom").otherwise("rss")
    n = F.col("page_id").cast("string")
    item = (
        F.when(F.col("kind") == "sitemap", F.concat(F.lit("<url><loc>"), link, F.lit("</loc><lastmod>2024-01-01</lastmod></url>")))
        .when(F.col("kind") == "atom", F.concat(F.lit("<entry><title>T"), n, F.lit('</title><link rel="self" href="x"/><link href="'), link, F.lit('"/><updated>2024-01-02</updated></entry>')))
        .otherwise(F.concat(F.lit("<item><title>T"), n, F.lit("</title><link>"), link, F.lit("</link><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item>")))
    )
    each = p.withColumn("kind", kind).withColumn("item", item)
    joined = each.groupBy("feed_id", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "item"))), lambda x: x["item"]), "").alias("items"))
    wrap = F.when(F.col("kind") == "sitemap", F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "items", F.lit("</urlset>"))).when(F.col("kind") == "atom", F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), "items", F.lit("</feed>"))).otherwise(F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")))
    return joined.select("feed_id", F.when(F.col("kind") == "sitemap", "sitemap").otherwise("feed").alias("kind"), wrap.alias("body"))


_KIND = "CASE WHEN (page_id // 10) % 4 = 3 THEN 'sitemap' ELSE 'feed' END"


@query("feed_entries", f"SELECT page_id // 10 AS feed_id, {_KIND} AS kind, (row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) - 1)::INT AS seq, CASE WHEN {_KIND} = 'feed' THEN 'T' || page_id ELSE '' END AS title, url FROM pages")
def feed_entries(spark, sf):
    return feeds.entries(spark, bodies(spark, sf)).select("feed_id", "kind", "seq", "title", "url")


@query("feed_entries_limited", f"SELECT feed_id, count(*)::BIGINT AS n FROM (SELECT page_id // 10 AS feed_id, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) AS k FROM pages) WHERE k <= 4 GROUP BY feed_id")
def feed_entries_limited(spark, sf):
    return feeds.entries(spark, bodies(spark, sf), 4).groupBy("feed_id").agg(F.count("*").alias("n"))


@query("feed_provenance", f"WITH {_PARTS} SELECT page_id // 10 AS feed_id, {_CANON} AS url, {_KIND} AS discovery_source FROM u")
def feed_provenance(spark, sf):
    return feeds.entries(spark, bodies(spark, sf)).select("feed_id", U.canonical(F.col("url")).alias("url"), F.col("kind").alias("discovery_source"))


def _responses(spark, sf):
    b = bodies(spark, sf).where("kind = 'feed'")
    k = F.col("feed_id") % 7
    status = F.when(k == 0, 404).otherwise(200)
    body = F.when(k == 1, F.lit("<html>no feed</html>")).when(k == 2, F.lit("<rss><broken>")).otherwise(F.col("body"))
    return b.select(F.lit("example.com").alias("source_domain"), F.col("feed_id").cast("string").alias("feed_url"), status.alias("status"), F.when(k == 1, "text/html").otherwise("application/rss+xml").alias("content_type"), body.alias("body"))


_HEALTH = f"""{_PARTS}, f AS (SELECT page_id // 10 AS feed_id, count(*)::INT AS n, count(DISTINCT CASE WHEN hostname = 'example.com' OR suffix(hostname, '.example.com') THEN url END)::INT AS m, list(url) FILTER (hostname = 'example.com' OR suffix(hostname, '.example.com')) AS urls FROM u WHERE (page_id // 10) % 4 <> 3 GROUP BY 1),
h AS (SELECT feed_id::VARCHAR AS feed_url, CASE feed_id % 7 WHEN 0 THEN 'http_error' WHEN 1 THEN 'non_feed' WHEN 2 THEN 'invalid_xml' ELSE 'valid_feed' END AS kind, CASE feed_id % 7 WHEN 0 THEN 'http_404' WHEN 1 THEN 'not_xml_or_atom' WHEN 2 THEN 'xml_parse_error' ELSE '' END AS reason,
  CASE WHEN feed_id % 7 > 2 THEN n ELSE 0 END AS entry_count, CASE WHEN feed_id % 7 > 2 THEN m ELSE 0 END AS publisher_url_count, CASE WHEN feed_id % 7 > 2 THEN n ELSE 0 END AS dated_entry_count, list_distinct(urls) AS urls FROM f)"""


@query("feed_health", f"WITH {_HEALTH} SELECT feed_url, kind, reason, entry_count, publisher_url_count, dated_entry_count FROM h")
def feed_health(spark, sf):
    return feeds.feed_health(spark, _responses(spark, sf)).select("feed_url", "kind", "reason", "entry_count", "publisher_url_count", "dated_entry_count")


@query("feed_source_summary", f"WITH {_HEALTH}, x AS (SELECT unnest(urls) AS url FROM h WHERE kind = 'valid_feed') SELECT 'example.com' AS source_domain, (SELECT count(*) FROM h)::BIGINT AS feed_count, (SELECT count(*) FROM h WHERE kind = 'valid_feed')::BIGINT AS valid_feed_count, count(DISTINCT url)::BIGINT AS unique_publisher_url_count, (count(*) - count(DISTINCT url))::BIGINT AS duplicate_publisher_url_count FROM x")
def feed_source_summary(spark, sf):
    return feeds.source_summary(feeds.feed_health(spark, _responses(spark, sf)))


@query("discovery_fallback", "WITH e AS (SELECT page_id // 20 AS target, CASE WHEN (page_id // 10) % 4 = 3 THEN 'sitemap' ELSE 'feed' END AS kind, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS key FROM pages), b AS (SELECT target, min(kind) AS kind FROM e GROUP BY target) SELECT target, kind, count(DISTINCT key)::BIGINT AS n FROM e JOIN b USING (target, kind) GROUP BY ALL")
def discovery_fallback(spark, sf):
    """Feeds before sitemaps; a target is two bodies."""
    e = feeds.entries(spark, bodies(spark, sf)).select(F.floor(F.col("feed_id") / 2).alias("target"), "kind", (F.col("feed_id") * 1000 + F.col("seq")).alias("seq"), "url")
    return feeds.discovered(e, {"feed": 0, "sitemap": 1}).groupBy("target", "kind").agg(F.count("*").alias("n"))


@query("sitemap_links", f"WITH {_PARTS} SELECT page_id, md5(url) AS link FROM u")
def sitemap_links(spark, sf):
    """Links of a Markdown page, by regular expression."""
    md = F.concat(F.lit("* [Title "), "page_id", F.lit("]("), "url", F.lit(") and text"))
    links = F.regexp_extract_all(md, F.lit(r"\[([^\]]+)\]\((https?://[^)]+)\)"), F.lit(2))
    return pages(spark, sf).select("page_id", F.explode(links).alias("l")).select("page_id", F.md5(F.col("l").cast("binary")).alias("link"))


@query("publisher_articles", f"WITH {_PARTS}, e AS (SELECT *, page_id // 10 AS feed FROM u WHERE (page_id // 10) % 4 <> 3) SELECT 'T' || page_id AS title, {_CANON} AS url, 'official_feed' AS discovery_source, feed::VARCHAR AS feed_url, CASE feed % 5 WHEN 0 THEN 'ai' WHEN 1 THEN 'markets' ELSE 'general' END AS feed_scope FROM e WHERE host = 'example.com' OR suffix(host, '.example.com')")
def publisher_articles(spark, sf):
    """Entries on the publisher's hosts; two in five feeds have a scope."""
    b = bodies(spark, sf).where("kind = 'feed'")
    e = feeds.entries(spark, b).select(F.col("feed_id").cast("string").alias("feed_url"), "title", "url", "published")
    ids = b.select(F.col("feed_id").cast("string").alias("feed_url"), F.col("feed_id"))
    k = F.col("feed_id") % 5
    scopes = ids.select("feed_url", F.when(k == 0, "ai").when(k == 1, "markets").alias("scope")).where("scope is not null")
    return feeds.publisher_articles(e, ids.select("feed_url", F.lit("example.com").alias("domain")), scopes).select("title", "url", "discovery_source", "feed_url", "feed_scope")


@query("sitemap_articles", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Story ' || page_id ELSE '' END AS title, 'https://www.wire.example/markets/story-' || page_id || '-2024-03-01' AS url, '2024-03-01' AS published FROM pages")
def sitemap_articles(spark, sf):
    """A daily page for each of the pages: a dated article linked twice, once of another spelling, one of another section and one of another host."""
    n = F.col("page_id").cast("string")
    at = F.concat(F.lit("https://www.wire.example/markets/story-"), n, F.lit("-2024-03-01"))
    md = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("* [old]("), at, F.lit(")\n* [ Story "), n, F.lit(" ]("), at, F.lit(") and [x](https://other.example/y)"))).otherwise(F.lit("no links"))
    links = F.array(F.concat(F.lit("https://www.wire.example/sports/game-"), n, F.lit("-2024-03-01")), at, F.concat(at, F.lit("?utm_source=feed")), F.lit("https://other.example/markets/a-2024-03-01"), at)
    return feeds.sitemap_articles(pages(spark, sf).select("page_id", md.alias("markdown"), links.alias("links"), F.lit("2024-03-01").alias("published")), "wire.example")


@query("health_report", f"WITH {_HEALTH} SELECT 'example.com' AS source_domain, count(*)::BIGINT AS feed_count, count(*) FILTER (kind = 'valid_feed')::BIGINT AS valid_feed_count, md5('[' || string_agg('{{\"feed_url\":\"' || feed_url || '\",\"kind\":\"' || kind || '\",\"reason\":\"' || reason || '\",\"entry_count\":' || entry_count || ',\"publisher_url_count\":' || publisher_url_count || ',\"dated_entry_count\":' || dated_entry_count || '}}', ',' ORDER BY feed_url) || ']') AS digest, 1::BIGINT AS source_count FROM h")
def health_report(spark, sf):
    r = feeds.health_report(feeds.feed_health(spark, _responses(spark, sf)))
    return r.select("source_domain", "feed_count", "valid_feed_count", F.md5(F.col("feeds").cast("binary")).alias("digest"), "source_count")

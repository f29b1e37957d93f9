"""Queries of the smaller helpers: TEI fields, registry health, derived policies, totals, rule manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import access, gate, html
from ..sources import feeds

from . import duck as D
from .q_feeds import _HEALTH, _responses
from .q_text import documents
from .q_url import _STATUS, _status, access_sql, pages
from .registry import query


def tei_author(xml):
    return T.strip(F.regexp_extract(T.blank(xml), r"(?s)<author[^>]*>.*?<persName>([^<]+)</persName>", 1))


def tei_date(xml):
    return F.regexp_extract(T.blank(xml), r'when="([0-9]{4}-[0-9]{2}-[0-9]{2})"', 1)


@query("tei_fields", "SELECT doc_id, 'By ' || source AS author, CASE WHEN doc_id % 4 = 0 THEN '' ELSE '2024-03-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') END AS date FROM documents")
def tei_fields(spark, sf):
    day = F.concat(F.lit("2024-03-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    xml = F.concat(F.lit("<TEI><author role='x'>\n<persName> By "), "source", F.lit(' </persName></author><date when="'), F.when(F.col("doc_id") % 4 == 0, "unknown").otherwise(day), F.lit('"/></TEI>'))
    return documents(spark, sf).select("doc_id", tei_author(xml).alias("author"), tei_date(xml).alias("date"))


@query("registry_health", f"WITH {_HEALTH}, s AS (SELECT 'example.com' AS domain UNION ALL SELECT 'example.org'), c AS (SELECT count(*)::BIGINT AS n, count(*) FILTER (kind = 'valid_feed')::BIGINT AS v, sum(dated_entry_count)::BIGINT AS d, sum(entry_count)::BIGINT AS e FROM h) SELECT domain, CASE WHEN domain = 'example.com' THEN n ELSE 0 END AS n_feeds, CASE WHEN domain = 'example.com' THEN v ELSE 0 END AS n_valid, CASE WHEN domain = 'example.com' AND d = e AND e > 0 THEN 'dated' WHEN domain = 'example.com' AND d > 0 THEN 'partly dated' ELSE 'undated' END AS date_quality FROM s, c")
def registry_health(spark, sf):
    """Sources with what the health report says of them; those without a report have zeros."""
    h = feeds.feed_health(spark, _responses(spark, sf)).groupBy(F.col("source_domain").alias("domain")).agg(
        F.count("*").alias("n_feeds"), F.count_if(F.col("kind") == "valid_feed").alias("n_valid"), F.sum("dated_entry_count").alias("d"), F.sum("entry_count").alias("e"))
    s = spark.createDataFrame([("example.com",), ("example.org",)], "domain string").join(h, "domain", "left").na.fill(0)
    quality = F.when((F.col("d") == F.col("e")) & (F.col("e") > 0), "dated").when(F.col("d") > 0, "partly dated").otherwise("undated")
    return s.select("domain", "n_feeds", "n_valid", quality.alias("date_quality"))


@query("health_sets", f"WITH {_HEALTH} SELECT kind = 'valid_feed' AS valid, count(*)::BIGINT AS n, min(feed_url) AS first_url, max(feed_url) AS last_url, sum(('0x' || left(md5(feed_url), 12))::BIGINT)::BIGINT AS digest FROM h GROUP BY 1")
def health_sets(spark, sf):
    """The sets of valid and other feeds, each by its size, ends and a sum of hashes, which no task has to gather."""
    h = feeds.feed_health(spark, _responses(spark, sf))
    number = F.conv(F.left(F.md5(F.col("feed_url").cast("binary")), F.lit(12)), 16, 10).cast("long")
    return h.groupBy((F.col("kind") == "valid_feed").alias("valid")).agg(F.count("*").alias("n"), F.min("feed_url").alias("first_url"), F.max("feed_url").alias("last_url"), F.sum(number).alias("digest"))


@query("feed_report_totals", f"WITH {_HEALTH} SELECT count(*)::BIGINT AS n_feeds, count(*) FILTER (kind = 'valid_feed')::BIGINT AS n_valid, sum(entry_count)::BIGINT AS entries, sum(publisher_url_count)::BIGINT AS publisher_urls FROM h")
def feed_report_totals(spark, sf):
    return feeds.feed_health(spark, _responses(spark, sf)).agg(F.count("*").alias("n_feeds"), F.count_if(F.col("kind") == "valid_feed").alias("n_valid"), F.sum("entry_count").alias("entries"), F.sum("publisher_url_count").alias("publisher_urls"))


@query("response_failures", f"WITH {access_sql(_STATUS)} SELECT page_id, CASE WHEN detected AND challenge THEN 'BOT_CHALLENGE' WHEN detected OR status IN (401, 403, 407, 429, 451) THEN 'HTTP_BLOCKED' WHEN status = 0 OR status >= 500 THEN 'NETWORK' WHEN status BETWEEN 200 AND 299 THEN 'EXTRACT_FAILED' ELSE 'HTTP_BLOCKED' END AS error_code FROM x")
def response_failures(spark, sf):
    p = access.access_columns(pages(spark, sf).select("page_id", "html", _status().alias("status"), F.lit("").alias("title")), "html", "title", "status")
    code, _ = access.response_failure(F.col("status"), F.col("html"), F.col("access_detected"), F.col("access_challenge"))
    return p.select("page_id", code.alias("error_code"))


@query("challenge_shells", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id % 2 = 0 WHEN 1 THEN doc_id % 2 = 0 ELSE false END AS shell FROM documents")
def challenge_shells(spark, sf):
    """Titles with rules of their own, and texts made to meet or miss them."""
    k, even = F.col("doc_id") % 3, F.col("doc_id") % 2 == 0
    title = F.when(k == 0, "Security  Verification").when(k == 1, "Access Denied").otherwise("News")
    made = F.when((k == 0) & even, "This challenge is waiting for you").when((k == 1) & even, "No permission to access").otherwise("Nothing")
    return documents(spark, sf).select("doc_id", access.challenge_shell(title, made, F.lit(False)).alias("shell"))


@query("structural_metrics_merged", f"WITH {D.tree()} SELECT page_id, CASE WHEN form_count = 0 THEN 2 ELSE form_count END AS form_count, CASE WHEN link_density = 0 THEN 0.5::DOUBLE ELSE link_density END AS link_density, nullif(cta_count, 0) AS cta_count FROM tr")
def structural_metrics_merged(spark, sf):
    """Metrics of the landed page, zeros filled from those that a live page reported."""
    r = html.page_records(spark, pages(spark, sf), "page_id").select("page_id", "form_count", "link_density", "cta_count")
    live = r.withColumns({"liveForms": F.lit(2), "liveDensity": F.lit(0.5), "liveCta": F.lit(None).cast("int")})
    return gate.merge_dom_metrics(live, {"liveForms": "form_count", "liveDensity": "link_density", "liveCta": "cta_count"}).select("page_id", "form_count", "link_density", "cta_count")


@query("pages_look_gated", f"WITH {D.tree()}, {access_sql('0')}, {D.page_gate('tr', 'x')} SELECT tr.page_id, html_chars < 200 OR g.teaser <> '' AS gated FROM tr JOIN g USING (page_id)")
def pages_look_gated(spark, sf):
    """Short pages and those whose structure is a teaser's."""
    r = html.page_records(spark, pages(spark, sf).withColumn("n", F.length("html")), "page_id", keep=("n",))
    m = gate.with_structure(gate.text_metrics(r.withColumn("t", T.strip(F.col("article_text"))), "t"))
    return m.select("page_id", ((F.col("n") < 200) | (gate.teaser_reason(F.col("t"), F.col("raw_title")) != "")).alias("gated"))


@query("page_content_prefilter", f"WITH {D.tree()}, {access_sql('0')}, l AS (SELECT *, {D.fold('html')} AS low FROM x) SELECT page_id, (length(l.html) >= 300 AND NOT detected AND (contains(low, '<article') OR contains(low, 'articlebody') OR contains(low, 'article-body') OR (ps >= 2 AND visible >= 100))) OR (length(l.html) >= 300 AND container_text_chars >= 250 AND link_density < 0.45::DOUBLE AND paragraph_count_dom < 2) AS has_content FROM l JOIN tr USING (page_id)")
def page_content_prefilter(spark, sf):
    """Whole prefilter: the string tests, then the tree only of pages that they leave open."""
    from .q_url import html_prefilter

    tested = html_prefilter(spark, sf).groupBy("page_id").agg(F.max("has_content").alias("has_content"))  # keeps the tests out of the filter below
    rest = pages(spark, sf).join(tested.where("not has_content"), "page_id", "left_semi").where(F.length("html") >= 300)
    tree = html.page_records(spark, rest, "page_id").select("page_id", ((F.col("container_text_chars") >= 250) & (F.col("link_density") < 0.45) & (F.col("paragraph_count_dom") < 2)).alias("by_tree"))
    return tested.join(tree, "page_id", "left").select("page_id", (F.col("has_content") | F.coalesce("by_tree", F.lit(False))).alias("has_content"))


@query("image_names", "SELECT page_id, format('img_{:03d}_', page_id % 1000) || left(md5(url), 8) || coalesce(nullif(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '[^/]([.](?:jpg|jpeg|png|gif|webp|svg))$', 1), ''), '.jpg') AS name FROM pages")
def image_names(spark, sf):
    return pages(spark, sf).select("page_id", T.image_filename((F.col("page_id") % 1000).cast("int"), F.col("url")).alias("name"))


@query("distinct_in_order", "SELECT conv_id, string_agg(role, '>' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id")
def distinct_in_order(spark, sf):
    """First occurrences of a list in encounter order."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return c.groupBy("conv_id").agg(F.array_join(F.array_distinct(listed), ">").alias("roles"))



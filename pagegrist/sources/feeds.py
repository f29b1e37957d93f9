"""Feeds and sitemaps that landed as rows: entries, health by feed, summaries by source."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import urls as U
from ..functions.text import blank
from ..session import ship

# Media types of feeds; elements that date an entry.
FEED_TYPES = frozenset(("application/rss+xml", "application/atom+xml"))
DATES = frozenset(("pubdate", "published", "updated", "date", "lastmod"))


def local(e) -> str:
    """The name of an element in lower case, whatever its namespace."""
    return str(e.tag).rpartition("}")[2].lower()


def _child(e, *names: str) -> str:
    """The text of the first child of one of these names."""
    for c in e:
        if local(c) in names:
            return (c.text or "").strip()
    return ""


class _FeedLinks(HTMLParser):
    """Addresses of link elements whose type is a feed's."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        href = (given.get("href") or "").strip()
        if tag == "link" and href and (given.get("type") or "").strip().lower() in FEED_TYPES:
            self.found.append(href)


def feed_links(spark: SparkSession, pages: DataFrame, key: str, html: str = "html", url: str = "url") -> DataFrame:
    """key, place, link: the resolved feed addresses that a page names; only pages with a link element go through Python."""
    ship(spark)
    kind = pages.schema[key].dataType.simpleString()
    slim = pages.select(F.col(key).alias("key"), F.left(blank(F.col(html)), F.lit(fixed.MAX_FEED_CHARS)).alias("html"), blank(F.col(url)).alias("url"))

    def links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for i, (page, base) in enumerate(zip(b.column("html").to_pylist(), b.column("url").to_pylist())):
                p = _FeedLinks()
                p.feed(page)
                p.close()
                for place, href in enumerate(p.found):
                    try:
                        rows.append((i, place, urljoin(base, href)))
                    except ValueError:  # an address that can't be taken apart
                        continue
            at, place, link = list(zip(*rows)) or ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(at, pa.int64())), pa.array(place, pa.int32()), pa.array(link, pa.string())], names=[key, "place", "link"])

    return slim.where(F.contains(F.lower("html"), F.lit("<link"))).mapInArrow(links, f"`{key}` {kind}, place int, link string")


def _atom_link(e) -> str:
    """The first link that has an address and stands for the entry itself."""
    links = ((str(c.attrib.get("rel") or "alternate").casefold(), str(c.attrib.get("href") or "").strip()) for c in e if local(c) == "link")
    return next((href for rel, href in links if href and rel == "alternate"), "")


def feed_entries(body: str, limit: int = 20) -> list[tuple[str, str, str]]:
    """(title, url, published) of RSS items, or of Atom entries where there is no item with an address."""
    root = _tree(body)
    if root is None:
        return []
    nodes = list(root.iter())
    items = ((_child(e, "title"), _child(e, "link"), _child(e, "pubdate")) for e in nodes if local(e) == "item")
    found = _first(items, limit)
    return found or _first(((_child(e, "title"), _atom_link(e), _child(e, "published", "updated")) for e in nodes if local(e) == "entry"), limit)


def sitemap_entries(body: str, limit: int = 20) -> list[tuple[str, str, str]]:
    root = _tree(body)
    if root is None:
        return []
    last = lambda e, n: next(((c.text or "").strip() for c in reversed(list(e)) if local(c) == n), "")
    return _first((("", last(e, "loc"), last(e, "lastmod")) for e in root.iter() if local(e) == "url"), limit)


def _first(rows, limit: int) -> list[tuple[str, str, str]]:
    out = []
    for r in rows:
        if r[1].startswith("http"):
            out.append(r)
            if len(out) >= limit:
                break
    return out


def _tree(body: str | None):
    try:
        return ElementTree.fromstring((body or "")[: fixed.MAX_FEED_CHARS])
    except (ElementTree.ParseError, ValueError, TypeError):
        return None


def health(body: str, domain: str) -> tuple[int, int, list[str]] | None:
    """(entries, dated entries, publisher addresses in order) of a feed; null of what isn't XML."""
    root = _tree(body)
    if root is None:
        return None
    entries, dated, found = 0, 0, []
    for e in root.iter():
        if local(e) not in ("item", "entry"):
            continue
        entries += 1
        dated += any(local(c) in DATES and bool((c.text or "").strip()) for c in e.iter())
        for c in e.iter():
            value = (c.attrib.get("href") or c.text or "").strip() if local(c) == "link" else ""
            if value.startswith("http") and _below(value, domain):
                found.append(value)
                break
    return entries, dated, found


def _below(url: str, domain: str) -> bool:
    from urllib.parse import urlparse

    try:
        host = (urlparse(url).hostname or "").casefold().removeprefix("www.")
    except ValueError:
        return False
    return host == domain or host.endswith(f".{domain}")


ENTRIES = "feed_id long, kind string, seq int, title string, url string, published string"


def entries(spark: SparkSession, feeds: DataFrame, limit: int = 20) -> DataFrame:
    """feed_id, kind (feed, sitemap), seq, title, url, published: one row per entry. feeds: feed_id, kind, body."""
    ship(spark)

    def parsed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for feed, kind, body in zip(*(b.column(c).to_pylist() for c in ("feed_id", "kind", "body"))):
                rows += [(feed, kind, i, *e) for i, e in enumerate((sitemap_entries if kind == "sitemap" else feed_entries)(body, limit))]
            names = ["feed_id", "kind", "seq", "title", "url", "published"]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, kinds)], names=names)

    return feeds.select(F.col("feed_id").cast("long").alias("feed_id"), "kind", "body").mapInArrow(parsed, ENTRIES)


def looks_like_feed(content_type, body):
    head = F.lower(F.left(F.ltrim(blank(body)), F.lit(512)))
    kind = F.lower(blank(content_type))
    return F.contains(kind, F.lit("xml")) | F.contains(kind, F.lit("rss")) | F.startswith(head, F.lit("<?xml")) | F.startswith(head, F.lit("<rss")) | F.startswith(head, F.lit("<feed"))


def feed_health(spark: SparkSession, responses: DataFrame) -> DataFrame:
    """Adds kind, reason, entry_count, publisher_url_count, dated_entry_count, article_urls to fetched responses.

    responses: source_domain, feed_url, status, content_type, body. Only bodies that look like feeds are parsed.
    """
    ship(spark)
    status = F.col("status")
    kind = F.when((status < 200) | (status >= 300), "http_error").when(~looks_like_feed(F.col("content_type"), F.col("body")), "non_feed")
    marked = responses.withColumn("kind", kind).withColumn("_id", F.xxhash64("source_domain", "feed_url"))

    def parsed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [health(body, d) if k is None else None for k, body, d in zip(*(b.column(c).to_pylist() for c in ("kind", "body", "source_domain")))]
            keep = [n for n in b.schema.names if n != "body"]
            cols = [b.column(n) for n in keep] + [pa.array([f[0] if f else 0 for f in found], pa.int32()), pa.array([f[1] if f else 0 for f in found], pa.int32()), pa.array([list(dict.fromkeys(f[2])) if f else [] for f in found], pa.list_(pa.string())), pa.array([f is not None for f in found])]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "entry_count", "dated_entry_count", "article_urls", "_parsed"])

    slim = marked.select("source_domain", "feed_url", F.col("status").cast("int").alias("status"), "kind", "body")
    ddl = "source_domain string, feed_url string, status int, kind string, entry_count int, dated_entry_count int, article_urls array<string>, _parsed boolean"
    out = slim.mapInArrow(parsed, ddl)
    reason = F.when(F.col("kind") == "http_error", F.concat(F.lit("http_"), F.col("status").cast("string"))).when(F.col("kind") == "non_feed", "not_xml_or_atom").when(~F.col("_parsed"), "xml_parse_error").otherwise("")
    return out.select("source_domain", "feed_url", "status", F.coalesce("kind", F.when(F.col("_parsed"), "valid_feed").otherwise("invalid_xml")).alias("kind"), reason.alias("reason"), "entry_count", F.size("article_urls").alias("publisher_url_count"), "dated_entry_count", "article_urls")


def source_summary(healths: DataFrame) -> DataFrame:
    """By source: feeds, valid feeds, distinct addresses and how many repeat across its feeds."""
    valid = F.col("kind") == "valid_feed"
    counts = healths.groupBy("source_domain").agg(F.count("*").alias("feed_count"), F.count_if(valid).alias("valid_feed_count"))
    seen = healths.where(valid).select("source_domain", F.explode("article_urls").alias("url")).groupBy("source_domain", "url").agg(F.count("*").alias("m"))
    seen = seen.groupBy("source_domain").agg(F.count("*").alias("unique_publisher_url_count"), (F.sum("m") - F.count("*")).alias("duplicate_publisher_url_count"))
    return counts.join(seen, "source_domain", "left").na.fill(0)


def discovered(entries: DataFrame, priorities: dict[str, int]) -> DataFrame:
    """Entries of each target's first source kind that has any, the first of each canonical key. entries: target, kind, seq, url."""
    rank = F.lit(len(priorities))
    for k, p in priorities.items():
        rank = F.when(F.col("kind") == k, p).otherwise(rank)
    ranked = entries.where("url is not null and url <> ''").withColumn("_p", rank).withColumn("_key", U.dedupe_key(F.col("url")))
    first = ranked.groupBy("target").agg(F.min("_p").alias("_best"))
    one = ranked.join(first, "target").where("_p = _best").groupBy("target", "_key").agg(F.min_by(F.struct("kind", "seq", "url"), F.struct("seq", "url")).alias("e"))
    return one.select("target", "e.kind", "e.seq", "e.url")


def publisher_articles(entries: DataFrame, domains: DataFrame, scopes: DataFrame) -> DataFrame:
    """Entries on their publisher's host or below it, their address in canonical form, with where they were found.

    entries: feed_url, title, url, published; domains: feed_url, domain; scopes: feed_url, scope, general where a feed has none.
    """
    said = scopes.groupBy(F.col("feed_url").alias("_f")).agg(F.min("scope").alias("_scope"))
    own = entries.join(domains, "feed_url").where(F.startswith("url", F.lit("http")) & U.under(U.host(F.col("url")), F.col("domain")))
    out = own.join(said, F.col("feed_url") == F.col("_f"), "left")
    return out.select("domain", "title", U.canonical(F.col("url")).alias("url"), "published", F.lit("official_feed").alias("discovery_source"), "feed_url", F.coalesce("_scope", F.lit("general")).alias("feed_scope"))


def sitemap_articles(pages: DataFrame, domain: str) -> DataFrame:
    """page_id, title, url, published: dated articles that a daily sitemap page links, the first of each key, with the title that Markdown gives.

    pages: page_id, markdown, links, published. A title belongs to the address that it is linked with; of several the last counts.
    """
    # one pass over the Markdown: each match is a title and the address that it is linked with
    found = F.transform(F.regexp_extract_all(blank(F.col("markdown")), F.lit(r"(\[[^\]]+\]\(https?://[^)]+\))"), F.lit(1)), lambda m: F.struct(F.regexp_extract(m, r"\]\(([^)]+)\)$", 1).alias("u"), F.trim(F.regexp_extract(m, r"^\[([^\]]+)\]", 1)).alias("t")))
    each = pages.withColumn("_named", found).select("page_id", "published", "_named", F.posexplode(F.array_distinct("links")).alias("_place", "_link"))
    good = each.where((U.host(F.col("_link")) == domain) & U.path(F.col("_link")).rlike(fixed.DATED_PATH))
    title = F.coalesce(F.try_element_at(F.filter("_named", lambda x: x["u"] == F.col("_link")), F.lit(-1))["t"], F.lit(""))
    one = good.withColumn("_title", title).groupBy("page_id", U.dedupe_key(F.col("_link")).alias("_key")).agg(F.min_by(F.struct("_title", "_link", "published"), "_place").alias("a"))
    return one.select("page_id", F.col("a._title").alias("title"), U.canonical(F.col("a._link")).alias("url"), F.col("a.published").alias("published"))


def health_report(healths: DataFrame) -> DataFrame:
    """One row a source with its feeds as JSON, and the totals over all sources: what the report holds, without article texts."""
    feeds = healths.groupBy("source_domain").agg(
        F.count("*").alias("feed_count"), F.count_if(F.col("kind") == "valid_feed").alias("valid_feed_count"),
        F.to_json(F.array_sort(F.collect_list(F.struct("feed_url", "kind", "reason", "entry_count", "publisher_url_count", "dated_entry_count")))).alias("feeds"),
    )
    totals = feeds.agg(F.count("*").alias("source_count"), F.sum("feed_count").alias("total_feed_count"), F.sum("valid_feed_count").alias("total_valid_feed_count"))
    return feeds.crossJoin(totals)  # one row

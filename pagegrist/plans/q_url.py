"""Queries of URL functions, registrable domains and page classification over pages."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..functions import urls as U
from ..operators import access
from ..session import ship, spread
from ..sources import feeds, tokens
from . import duck as D
from .registry import query


def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


_AUTH = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_HOST = f"regexp_replace(regexp_replace({_AUTH}, '^.*@', ''), ':[0-9]*$', '')"
_BARE = rf"regexp_replace(regexp_replace({_HOST}, '^www\.', ''), '\.+$', '')"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
_SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
_DEC = lambda x: f"url_decode(regexp_replace(replace({x}, '+', ' '), '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?$)', '%25\\1', 'g'))"
_ENC = lambda x: f"replace(url_encode({x}), '%20', '+')"
_KEPT = (
    f"list_filter(list_transform(list_filter(string_split(q, '&'), lambda kv: kv <> ''), lambda kv: {{'k': {_DEC("split_part(kv, '=', 1)")}, 'v': {_DEC("regexp_extract(kv, '^[^=]*=(.*)$', 1)")}}}), lambda z: lower(z.k) NOT IN ("
    + ", ".join(map(D.lit, fixed.TRACKING_PARAMETERS)) + ") AND NOT starts_with(lower(z.k), 'utm_') AND NOT starts_with(lower(z.k), 'syn-'))"
)
_CANON = f"s || '://' || a || coalesce(nullif(rtrim(regexp_replace(p, ';[^/]*$', ''), '/'), ''), '/') || CASE WHEN len({_KEPT}) = 0 THEN '' ELSE '?' || array_to_string(list_transform({_KEPT}, lambda z: {_ENC('z.k')} || '=' || {_ENC('z.v')}), '&') END"
_PARTS = f"u AS (SELECT page_id, url, {_SCHEME} AS s, {_AUTH} AS a, {_PATH} AS p, {_QUERY} AS q, {_HOST} AS hostname, {_BARE} AS host FROM pages)"


@query("url_parts", f"WITH {_PARTS} SELECT page_id, s AS scheme, hostname, host, p AS path, q AS query FROM u")
def url_parts(spark, sf):
    u = F.col("url")
    return pages(spark, sf).select("page_id", U.scheme(u).alias("scheme"), U.hostname(u).alias("hostname"), U.host(u).alias("host"), U.path(u).alias("path"), U.query(u).alias("query"))


#: What is put behind an address to tell spellings apart: parameters of the path, encoded names and values, campaign parameters.
_TAILS = (";v=1/x;p=2?q=a%20b&utm%5Fsource=x", "?q=a+b&Ref=1&r=%C3%A9~*", "?b&a=%2B%26=c&%67clid=1", "?p=100%&&x=%zz&SYN-1=2#f", "")
_ODD = f"u AS (SELECT page_id, {_SCHEME} AS s, {_AUTH} AS a, {_PATH} AS p, {_QUERY} AS q FROM (SELECT page_id, url FROM pages UNION ALL SELECT -page_id - 1, regexp_replace(url, '[?#].*$', '') || [{', '.join(map(D.lit, _TAILS))}][(page_id % {len(_TAILS)} + 1)::INT] FROM pages))"


@query("url_canonical", f"WITH {_ODD} SELECT page_id, {_CANON} AS canonical FROM u")
def url_canonical(spark, sf):
    """The pages' own addresses, and each with another tail."""
    p = pages(spark, sf).select("page_id", "url")
    tail = F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("page_id") % len(_TAILS) + 1).cast("int"))
    odd = p.select((-F.col("page_id") - 1).alias("page_id"), F.concat(F.regexp_replace("url", r"[?#].*$", ""), tail).alias("url"))
    return p.unionByName(odd).select("page_id", U.canonical(F.col("url")).alias("canonical"))


@query("url_dedupe_first", f"WITH {_PARTS}, k AS (SELECT page_id, url, s || '://' || a || p AS dedupe_key FROM u) SELECT min(page_id) AS page_id, dedupe_key, count(*)::BIGINT AS n FROM k GROUP BY dedupe_key")
def url_dedupe_first(spark, sf):
    """The first page of each key in order of id: an aggregate, so a hot key is combined before the shuffle."""
    return pages(spark, sf).groupBy(U.dedupe_key(F.col("url")).alias("dedupe_key")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


_RULES = [(r.lstrip("!").removeprefix("*."), "exception" if r[0] == "!" else "wildcard" if r[:2] == "*." else "exact", r.count(".") + 1) for r in fixed.PUBLIC_SUFFIXES]
_VALUES = ", ".join(f"({D.lit(b)}, '{k}', {n})" for b, k, n in _RULES)
_PSL = f"""{_PARTS}, r(base, kind, n) AS (VALUES {_VALUES}),
h AS (SELECT DISTINCT hostname AS h, string_split(hostname, '.') AS ls FROM u),
e AS (SELECT h, ls, i, array_to_string(ls[i:], '.') AS base FROM h, unnest(range(1, len(ls) + 1)) AS x(i)),
j AS (SELECT h, max(CASE WHEN kind = 'exact' THEN n WHEN kind = 'wildcard' AND i > 1 THEN n END) AS long, max(CASE WHEN kind = 'exception' THEN n - 1 END) AS cut FROM e JOIN r USING (base) GROUP BY h),
d AS (SELECT h.h, CASE WHEN regexp_matches(h.h, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') THEN h.h
        WHEN list_contains(ls, '') OR len(ls) <= coalesce(cut, long, 1) THEN NULL ELSE array_to_string(ls[len(ls) - coalesce(cut, long, 1):], '.') END AS registrable FROM h LEFT JOIN j ON h.h = j.h)"""


def with_domain(spark, sf):
    ship(spark)
    p = pages(spark, sf).withColumn("hostname", U.hostname(F.col("url")))
    return U.registrable(p, "hostname", U.suffix_rules(spark))


@query("registrable_domain", f"WITH {_PSL} SELECT page_id, hostname, registrable, coalesce(registrable, hostname) AS domain FROM u JOIN d ON u.hostname = d.h")
def registrable_domain(spark, sf):
    return with_domain(spark, sf).select("page_id", "hostname", "registrable", F.coalesce("registrable", U.presentation(F.col("hostname"))).alias("domain"))


@query("domain_counts", f"WITH {_PSL} SELECT registrable, count(*)::BIGINT AS n, count(DISTINCT hostname)::BIGINT AS n_hosts FROM u JOIN d ON u.hostname = d.h GROUP BY registrable")
def domain_counts(spark, sf):
    return with_domain(spark, sf).groupBy("registrable").agg(F.count("*").alias("n"), F.countDistinct("hostname").alias("n_hosts"))


@query("top_domains", f"WITH {_PSL} SELECT registrable, count(*)::BIGINT AS n FROM u JOIN d ON u.hostname = d.h GROUP BY registrable ORDER BY n DESC, registrable LIMIT 10")
def top_domains(spark, sf):
    return with_domain(spark, sf).groupBy("registrable").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "registrable").limit(10)


@query("one_domain_batches", f"WITH {_PSL} SELECT page_id // 10 AS batch, count(DISTINCT coalesce(registrable, hostname))::BIGINT AS n_domains, count(DISTINCT coalesce(registrable, hostname)) <= 1 AS one_domain FROM u JOIN d ON u.hostname = d.h GROUP BY 1")
def one_domain_batches(spark, sf):
    d = with_domain(spark, sf).withColumn("domain", F.coalesce("registrable", "hostname"))
    return d.groupBy(F.floor(F.col("page_id") / 10).alias("batch")).agg(F.countDistinct("domain").alias("n_domains")).withColumn("one_domain", F.col("n_domains") <= 1)


_HOSTS = lambda hosts: "(" + " OR ".join(f"hostname = {D.lit(h)} OR suffix(hostname, {D.lit('.' + h)})" for h in hosts) + ")"


@query("tracking_urls", f"WITH {_PARTS} SELECT page_id, {_HOSTS(U.TRACKING_HOSTS)} OR regexp_matches(url, {D.lit(U.TRACKING_URL)}) AS tracking, {_HOSTS(U.PROVIDER_HOSTS)} OR contains(lower(url), 'fortress-client') AS provider FROM u")
def tracking_urls(spark, sf):
    return pages(spark, sf).select("page_id", U.tracking(F.col("url")).alias("tracking"), U.subscription_provider(F.col("url")).alias("provider"))


@query("amp_flags", f"WITH {_PARTS}, l AS (SELECT page_id, hostname, q, rtrim(lower(p), '/') AS lp FROM u) SELECT page_id, starts_with(hostname, 'amp.') OR suffix(lp, '.amp') OR suffix(lp, '/amp') OR contains(lp, '/amp/') OR contains(lower(q), 'output=amp') AS amp FROM l")
def amp_flags(spark, sf):
    return pages(spark, sf).select("page_id", U.looks_amp(F.col("url")).alias("amp"))


#: Made-up authorities, as pages have none with an IP, and why they must not be followed.
_HOSTS_MADE = (
    ("10.1.2.3", "private_ip:10.1.2.3"), ("localhost", "localhost"), ("192.168.0.7:8080", "private_ip:192.168.0.7"), ("93.184.216.34", ""), ("www.example.org", ""), ("0.0.0.0", "unspecified"), ("a.localhost.", "localhost"),
    ("172.16.0.1", "private_ip:172.16.0.1"), ("172.32.0.1", ""), ("169.254.1.1", "private_ip:169.254.1.1"), ("224.0.0.1", "private_ip:224.0.0.1"), ("198.18.0.1", "private_ip:198.18.0.1"), ("192.0.0.9", ""), ("999.1.1.1", ""),
    ("[::1]", "private_ip:::1"), ("[::]:80", "private_ip:::"), ("[::ffff:127.0.0.1]", "private_ip:::ffff:127.0.0.1"), ("[64:ff9b::1]", "private_ip:64:ff9b::1"), ("[100::1]", "private_ip:100::1"), ("[fe80::1]", "private_ip:fe80::1"),
    ("[fd00:1::2]", "private_ip:fd00:1::2"), ("[ff02::1]", "private_ip:ff02::1"), ("[2001:db8::1]", "private_ip:2001:db8::1"), ("[2002:a00:1::1]", "private_ip:2002:a00:1::1"), ("[2001:0:1::1]", "private_ip:2001:0:1::1"), ("[2606:2800:220:1::1]", ""), ("u:p@[2a00:1450::5]:443", ""),
    ("[fe80::1%25eth0]", "private_ip:fe80::1%25eth0"), ("[fe80::2%eth0]:80", "private_ip:fe80::2%eth0"), ("[::1%25]", "private_ip:::1%25"), ("[2606:2800:220:1::1%25a]", ""),
)
_SAFE = "CASE WHEN s IN ('file', 'ftp', 'data', 'javascript') THEN 'blocked_scheme:' || s WHEN s NOT IN ('http', 'https') THEN 'unsupported_scheme:' || coalesce(nullif(s, ''), 'none') WHEN hostname = '' THEN 'empty_host' ELSE {} END"
_MADE_SAFE = f"[{', '.join(D.lit(x) for _, x in _HOSTS_MADE)}][(page_id % {len(_HOSTS_MADE)} + 1)::INT]"


@query("url_safety", f"WITH {_PARTS} SELECT page_id, {_SAFE.format(chr(39) * 2)} AS unsafe FROM u UNION ALL SELECT -page_id - 1, CASE WHEN s IN ('http', 'https') THEN {_MADE_SAFE} ELSE {_SAFE.format(chr(39) * 2)} END FROM u")
def url_safety(spark, sf):
    """The pages' own addresses, whose hosts are public names, and made-up ones."""
    p = pages(spark, sf).select("page_id", "url")
    made = F.element_at(F.array(*[F.lit(h) for h, _ in _HOSTS_MADE]), (F.col("page_id") % len(_HOSTS_MADE) + 1).cast("int"))
    both = p.unionByName(p.select((-F.col("page_id") - 1).alias("page_id"), F.concat(U.scheme(F.col("url")), F.lit("://"), made, F.lit("/x")).alias("url")))
    return both.select("page_id", U.safety(F.col("url")).alias("unsafe"))


@query("search_redirects", "SELECT page_id, url AS target FROM pages")
def search_redirects(spark, sf):
    """Wrapped as a search engine does it and unwrapped again."""
    wrapped = F.concat(F.lit("http://www.bing.com/news/apiclick.aspx?ref=x&url="), F.url_encode("url"), F.lit("&c=1"))
    return pages(spark, sf).select("page_id", U.unwrapped(wrapped).alias("target"))


@query("article_path_flags", f"WITH {_PARTS} SELECT page_id, regexp_matches(CASE WHEN page_id % 2 = 0 THEN '/Markets/a' || p || '-2024-01-0' || page_id % 10 || '/' ELSE p END, {D.lit(fixed.DATED_PATH)}) AS dated FROM u")
def article_path_flags(spark, sf):
    """Every second page gets the path of a dated article."""
    p = U.path(F.col("url"))
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/Markets/a"), p, F.lit("-2024-01-0"), (F.col("page_id") % 10).cast("string"), F.lit("/"))).otherwise(p)
    return pages(spark, sf).select("page_id", path.rlike(fixed.DATED_PATH).alias("dated"))


@query("publisher_filter", f"WITH {_PARTS} SELECT page_id, {_CANON} AS url, 'official_feed' AS discovery_source FROM u WHERE host = 'example.com' OR suffix(host, '.example.com')")
def publisher_filter(spark, sf):
    p = pages(spark, sf).where(F.startswith("url", F.lit("http")) & U.under(U.host(F.col("url")), F.lit("example.com")))
    return p.select("page_id", U.canonical(F.col("url")).alias("url"), F.lit("official_feed").alias("discovery_source"))


@query("page_title", f"SELECT page_id, {D.strip('split_part(split_part(r, ' + D.lit('|') + ', 1), ' + D.lit(' - ') + ', 1)')} AS title FROM (SELECT page_id, {D.norm('regexp_extract(html, ' + D.lit('(?i)<title[^>]*>([^<]+)</title>') + ', 1)')} AS r FROM pages)")
def page_title(spark, sf):
    return pages(spark, sf).select("page_id", T.title_of(F.col("html")).alias("title"))


@query("page_title_metadata", f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Meta ' || page_id ELSE {D.strip('split_part(split_part(r, ' + D.lit('|') + ', 1), ' + D.lit(' - ') + ', 1)')} END AS title FROM (SELECT page_id, {D.norm('regexp_extract(html, ' + D.lit('(?i)<title[^>]*>([^<]+)</title>') + ', 1)')} AS r FROM pages)")
def page_title_metadata(spark, sf):
    """Every third page has metadata with a title of its own."""
    n = F.col("page_id").cast("string")
    metadata = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<doc><title type='x'> Meta "), n, F.lit(" | site</title></doc>"))).when(F.col("page_id") % 3 == 1, "<doc><title></title></doc>")
    return pages(spark, sf).select("page_id", T.title_of(F.col("html"), metadata).alias("title"))


_VISIBLE = D.norm("regexp_replace(left(html, 400000), '<[^>]+>', ' ', 'g')")


@query("visible_text_len", f"SELECT page_id, {D.mlen(_VISIBLE)}::INT AS visible_chars, md5({_VISIBLE}) AS digest FROM pages")
def visible_text_len(spark, sf):
    visible = T.normalize_space(F.regexp_replace(F.left("html", F.lit(fixed.MAX_ACCESS_CHARS)), "<[^>]+>", " "))
    return pages(spark, sf).select("page_id", T.meaningful_length(visible).alias("visible_chars"), F.md5(visible.cast("binary")).alias("digest"))


def _n(tag):
    return f"len(regexp_extract_all(html, '(?i)<{tag}\\b'))::INT"


@query("tag_counts_regex", f"SELECT page_id, {_n('p')} AS n_p, {_n('a')} AS n_a, {_n('li')} AS n_li, {_n('script')} AS n_script, {_n('form')} AS n_form, {_n('img')} AS n_img FROM pages")
def tag_counts_regex(spark, sf):
    return pages(spark, sf).select("page_id", *[F.regexp_count("html", F.lit(rf"(?i)<{t}\b")).alias(f"n_{t}") for t in ("p", "a", "li", "script", "form", "img")])


def access_sql(status: str) -> str:
    """Access classification of pages with a made-up status."""
    r, m = "left(html, 400000)", lambda p: f"regexp_matches(left(html, 400000), {D.lit('(?is)' + p)})"
    hits = {n: "(" + " + ".join(f"{m(p)}::INT" for p in ps) + ")" for n, ps in fixed.PROVIDERS}
    end = r"(?:[^\p{L}\p{N}_]|$)"
    title = D.fold(D.norm(f"regexp_replace(regexp_extract({r}, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g')"))
    provider = "CASE " + " ".join(f"WHEN h_{i} = hits AND hits > 0 THEN '{n}'" for i, n in enumerate(hits)) + " ELSE '' END"
    bs = "status IN (401, 403, 407, 429, 451)"
    return f"""
i AS (SELECT page_id, html, {status} AS status, {title} AS title, {', '.join(f'{h} AS h_{i}' for i, h in enumerate(hits.values()))}, {m(fixed.MARKUP)} AS markup, {m(fixed.CAPTCHA)} AS captcha0, {m(fixed.PLAIN_CAPTCHA)} AS plain0,
  {m(fixed.CHALLENGE_FORM)} AS form, {m(fixed.CHALLENGE_SCRIPT)} AS script, {m(fixed.DENIED_TEXT)} AS denied, {m(fixed.DEFAULT_PAGES)} AS dflt, {m(fixed.META_REFRESH)} AS refresh, {m(fixed.CHALLENGE_BODY)} AS body,
  {D.mlen(_VISIBLE)} AS visible, {D.mlen(r)} AS chars, len(regexp_extract_all({r}, '(?i)<script\\b')) AS scripts, len(regexp_extract_all({r}, '(?i)<p\\b')) AS ps FROM pages),
t AS (SELECT *, greatest({', '.join(f'h_{i}' for i in range(len(hits)))}) AS hits, regexp_matches(title, {D.lit('(?i)' + fixed.CHALLENGE_TITLES + end)}) AS tc, regexp_matches(title, {D.lit('(?i)' + fixed.DENIED_TITLES + end)}) AS td FROM i),
c AS (SELECT *, {provider} AS provider, CASE WHEN NOT markup AND NOT tc THEN chars < 1800 AND plain0 ELSE captcha0 END AS captcha FROM t),
s AS (SELECT *, 0.0::DOUBLE + CASE WHEN {bs} OR status = 503 THEN 1.2::DOUBLE ELSE 0 END + CASE WHEN tc THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN td THEN 1.8::DOUBLE ELSE 0 END
  + CASE WHEN hits > 0 THEN 1.2::DOUBLE + least(hits, 2) * 0.6::DOUBLE ELSE 0 END + CASE WHEN captcha THEN 2.5::DOUBLE ELSE 0 END + CASE WHEN form THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN script THEN 1.8::DOUBLE ELSE 0 END
  + CASE WHEN denied THEN 1.4::DOUBLE ELSE 0 END + CASE WHEN visible < 900 AND scripts >= 2 AND ps <= 2 THEN 0.7::DOUBLE ELSE 0 END + CASE WHEN refresh THEN 0.5::DOUBLE ELSE 0 END AS score FROM c),
v AS (SELECT *, (tc AND (markup OR {bs} OR status = 503 OR body)) OR captcha OR form OR script OR (markup AND provider IN ('cloudflare', 'datadome', 'perimeterx', 'imperva', 'aws-waf') AND score >= 3.2::DOUBLE)
  OR (markup AND provider = 'akamai' AND hits >= 2 AND score >= 3.6::DOUBLE) AS challenge FROM s),
x AS (SELECT *, challenge OR ((td OR dflt) AND visible < 5000 AND (markup OR {bs} OR denied OR dflt)) OR (denied AND (markup OR visible < 1800)) OR ({bs} AND visible < 5000) OR (markup AND score >= 4.0::DOUBLE) AS detected FROM v)"""


_STATUS = "CASE page_id % 7 WHEN 0 THEN 403 WHEN 1 THEN 503 WHEN 2 THEN 0 WHEN 3 THEN 404 ELSE 200 END"


def _status():
    k = F.col("page_id") % 7
    return F.when(k == 0, 403).when(k == 1, 503).when(k == 2, 0).when(k == 3, 404).otherwise(200)


@query("access_control_class", f"WITH {access_sql(_STATUS)} SELECT page_id, detected, challenge, CASE WHEN detected THEN provider ELSE '' END AS provider, CASE WHEN NOT detected THEN '' ELSE coalesce(nullif(provider, ''), 'generic') || CASE WHEN challenge THEN '_challenge' ELSE '_http_block' END END AS reason, round(score, 6) AS score FROM x")
def access_control_class(spark, sf):
    p = spread(pages(spark, sf).select("page_id", "html")).select("page_id", "html", _status().alias("status"), F.lit("").alias("title"))
    a = access.access_columns(p, "html", "title", "status")
    return a.select("page_id", F.col("access_detected").alias("detected"), F.col("access_challenge").alias("challenge"), F.col("access_provider").alias("provider"), F.col("access_reason").alias("reason"), F.round("access_score", 6).alias("score"))


_BOT = "(" + " OR ".join(f"contains(b, '{m}')" for m in ("captcha", "cf-browser", "challenge", "turnstile", "cloudflare")) + ")"


@query("http_failures", f"WITH n AS (SELECT page_id, {_STATUS} AS status, lower(left(html, 2000)) AS b FROM pages) SELECT page_id, status, CASE WHEN status IN (401, 403) THEN CASE WHEN {_BOT} THEN 'BOT_CHALLENGE' ELSE 'HTTP_BLOCKED' END WHEN status = 429 THEN 'HTTP_BLOCKED' WHEN status >= 500 OR status = 0 THEN 'NETWORK' WHEN status = 200 THEN 'EXTRACT_FAILED' ELSE 'HTTP_BLOCKED' END AS error_code, CASE WHEN status IN (401, 403, 429) THEN 'bot' WHEN status >= 500 OR status = 0 THEN 'network' WHEN status = 200 THEN 'extract' ELSE 'strategy' END AS failure_class FROM n")
def http_failures(spark, sf):
    p = pages(spark, sf).select("page_id", "html", _status().alias("status"))
    code, kind = access.http_failure(F.col("status"), F.col("html"))
    return p.select("page_id", "status", code.alias("error_code"), kind.alias("failure_class"))


@query("html_prefilter", f"WITH {access_sql('0')}, l AS (SELECT *, {D.fold('html')} AS low FROM x) SELECT page_id, length(html) >= 300 AND NOT detected AND (contains(low, '<article') OR contains(low, 'articlebody') OR contains(low, 'article-body') OR (ps >= 2 AND visible >= 100)) AS has_content FROM l")
def html_prefilter(spark, sf):
    """The string tests of the content prefilter; what they leave open is for the tree metrics."""
    p = access.access_columns(pages(spark, sf).withColumn("title", F.lit("")), "html", "title")
    low = T.fold(F.col("html"))
    marked = F.contains(low, F.lit("<article")) | F.contains(low, F.lit("articlebody")) | F.contains(low, F.lit("article-body"))
    visible = T.meaningful_length(T.normalize_space(F.regexp_replace(F.left("html", F.lit(fixed.MAX_ACCESS_CHARS)), "<[^>]+>", " ")))
    prose = (F.regexp_count("html", F.lit(r"(?i)<p\b")) >= 2) & (visible >= fixed.MIN_CONTENT_CHARS)
    return p.select("page_id", ((F.length("html") >= 300) & ~F.col("access_detected") & (marked | prose)).alias("has_content"))


@query("feed_links", r"SELECT page_id, CASE page_id % 4 WHEN 0 THEN o || '/rss?a=1&b' WHEN 1 THEN 'https://feeds.example/x' WHEN 2 THEN o || regexp_replace(p, '[^/]*$', '') || 'atom.xml' END AS link FROM (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') AS o, coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') AS p FROM pages) WHERE page_id % 4 < 3")
def feed_links(spark, sf):
    """Resolved addresses of a page's feeds; pages have none, so three in four get a link, and all one that is no feed's."""
    k = F.col("page_id") % 4
    tag = F.when(k == 0, '<LINK rel=alternate type="application/rss+xml" title="a > b" href="/rss?a=1&amp;b">').when(k == 1, "<link href='https://feeds.example/x' type=' application/ATOM+xml '/>").when(k == 2, '<link type="application/atom+xml" href=" atom.xml ">').otherwise("")
    page = F.concat(F.lit('<link rel="stylesheet" type="text/css" href="s.css">'), tag, "html")
    return feeds.feed_links(spark, pages(spark, sf).select("page_id", "url", page.alias("html")), "page_id").select("page_id", "link")


@query("wrapped_links", "SELECT page_id, url AS target FROM pages")
def wrapped_links(spark, sf):
    """Addresses inside aggregator tokens: written as length-delimited fields, every third with an AMP address before, and read again."""
    field = lambda x, tag: F.concat(F.unhex(F.lit(tag)), F.unhex(F.lpad(F.hex((F.octet_length(x) % 128 + 128).cast("long")), 2, "0")), F.unhex(F.lpad(F.hex(F.floor(F.octet_length(x) / 128).cast("long")), 2, "0")), x.cast("binary"))
    amp = F.when(F.col("page_id") % 3 == 0, field(F.lit("https://amp.other.example/a"), "22")).otherwise(F.lit(b""))
    data = F.concat(F.unhex(F.lit("0813")), amp, field(F.col("url"), "22"), F.unhex(F.lit("d20100")))
    token = F.replace(F.translate(F.base64(data), "+/", "-_"), F.lit("="), F.lit(""))
    token = F.regexp_replace(token, r"\s", "")
    link = F.concat(F.lit("https://news.google.com/rss/articles/"), token, F.lit("?oc=5"))
    return tokens.decoded(pages(ship(spark), sf).select("page_id", link.alias("link")), "link", "target").select("page_id", "target")


@query("first_pages_per_domain", f"WITH {_PSL}, k AS (SELECT page_id, coalesce(registrable, hostname) AS domain, row_number() OVER (PARTITION BY coalesce(registrable, hostname) ORDER BY page_id) AS place FROM u JOIN d ON u.hostname = d.h) SELECT domain, page_id, place FROM k WHERE place <= 3")
def first_pages_per_domain(spark, sf):
    d = with_domain(spark, sf).select("page_id", F.coalesce("registrable", "hostname").alias("domain"))
    return d.withColumn("place", F.row_number().over(W.partitionBy("domain").orderBy("page_id")).cast("long")).where("place <= 3")


#: Labels set before the pages' hosts, with their IDNA forms.
_LABELS = (("bücher", "xn--bcher-kva"), ("straße", "strasse"), ("例え", "xn--r8jz45g"), ("ｗｗｗ", "www"), ("plain", "plain"), ("ÖL", "xn--l-0ga"))
_LABEL = f"[{', '.join(D.lit(a) for _, a in _LABELS)}][(page_id % {len(_LABELS)} + 1)::INT]"


@query("registrable_domain_idna", f"WITH {_PSL} SELECT page_id, {_LABEL} || '.' || hostname AS ascii, registrable FROM u JOIN d ON u.hostname = d.h")
def registrable_domain_idna(spark, sf):
    """Hosts in scripts of their own, with ideographic dots: their ASCII forms and registrable domains."""
    ship(spark)
    label = F.element_at(F.array(*(F.lit(a) for a, _ in _LABELS)), (F.col("page_id") % len(_LABELS) + 1).cast("int"))
    dot = F.element_at(F.array(*map(F.lit, "。．｡.")), (F.col("page_id") % 4 + 1).cast("int"))
    p = pages(spark, sf).select("page_id", F.concat(label, dot, U.hostname(F.col("url")), dot).alias("host"))
    return U.registrable(p, "host", U.suffix_rules(spark), idna=True).select("page_id", U.ascii_host(U.presentation(F.col("host"))).alias("ascii"), "registrable")

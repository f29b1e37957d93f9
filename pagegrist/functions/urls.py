"""URL functions as column expressions, and registrable domains from public suffix rules.

URLs are taken apart by regular expressions instead of a strict parser, so that odd addresses give empty parts
and never fail.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed
from .text import blank

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_REST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(blank(u), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(u: Column) -> Column:
    return F.lower(F.regexp_extract(blank(u), _AUTHORITY, 1))


def hostname(u: Column) -> Column:
    """Lower-case host without user, port or brackets."""
    return F.regexp_replace(F.regexp_replace(authority(u), r"^.*@", ""), r"(?:^\[|\](?::[0-9]*)?$|(?<!\]):[0-9]*$)", "")


def host(u: Column) -> Column:
    """The host as feeds and registries name it: without www. and final dots."""
    return F.regexp_replace(F.regexp_replace(hostname(u), r"^www\.", ""), r"\.+$", "")


def path(u: Column) -> Column:
    return F.regexp_extract(blank(u), _REST + r"([^?#]*)", 1)


def query(u: Column) -> Column:
    return F.regexp_extract(blank(u), r"^[^?#]*\?([^#]*)", 1)


def _decoded(x: Column) -> Column:
    """Form decoding: + is a space, a percent sign that starts no byte is itself."""
    return F.try_url_decode(F.regexp_replace(x, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(x: Column) -> Column:
    """Form encoding, with the tilde as it is and the asterisk encoded."""
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical(u: Column) -> Column:
    """Lower-case scheme and host, no path parameters, final slash, campaign parameters or fragment; other parameters in order.

    Query parameters are decoded and encoded again, so that spellings of one address meet.
    """
    pair = lambda kv: F.struct(_decoded(F.regexp_extract(kv, r"(?s)^([^=]*)", 1)).alias("k"), _decoded(F.regexp_extract(kv, r"(?s)^[^=]*=(.*)$", 1)).alias("v"))

    def kept(kv: Column) -> Column:
        name = F.lower(kv["k"])
        out = ~name.isin(*fixed.TRACKING_PARAMETERS)
        for p in fixed.TRACKING_PREFIXES:
            out = out & ~F.startswith(name, F.lit(p))
        return out

    given = F.transform(F.filter(F.split(query(u), "&"), lambda kv: kv != ""), pair)
    pairs = F.array_join(F.transform(F.filter(given, kept), lambda kv: F.concat(_encoded(kv["k"]), F.lit("="), _encoded(kv["v"]))), "&")
    trimmed = F.regexp_replace(F.regexp_replace(path(u), r";[^/]*$", ""), "/+$", "")
    return F.concat(scheme(u), F.lit("://"), authority(u), F.when(trimmed == "", "/").otherwise(trimmed), F.when(pairs == "", "").otherwise(F.concat(F.lit("?"), pairs)))


def dedupe_key(u: Column) -> Column:
    """Scheme, host and path: what makes two feed entries one article."""
    return F.concat(scheme(u), F.lit("://"), authority(u), path(u))


def looks_amp(u: Column) -> Column:
    low = F.regexp_replace(F.lower(path(u)), "/+$", "")
    return F.startswith(hostname(u), F.lit("amp.")) | low.rlike(r"(?:\.amp|/amp)$") | F.contains(low, F.lit("/amp/")) | F.contains(F.lower(query(u)), F.lit("output=amp"))


def is_ipv4(h: Column) -> Column:
    """Four numbers up to 255 without leading zeros."""
    return h.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}(?<!\.)$")


def _unzoned(h: Column) -> Column:
    """Without the zone of an IPv6 address: one percent sign and what follows, encoded or not."""
    return F.regexp_replace(h, r"%[^%]+$", "")


def is_ipv6(h: Column) -> Column:
    """Eight groups, or fewer around one gap; an IPv4 address can stand for the last two, and a zone can follow."""
    groups = F.regexp_replace(_unzoned(h), r"(?<=:)[0-9]{1,3}(?:\.[0-9]{1,3}){3}$", "0:0")
    n = F.regexp_count(groups, F.lit(r"[0-9a-f]+"))
    shape = groups.rlike(r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::)?(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?$")
    return shape & F.when(F.contains(groups, F.lit("::")), n <= 7).otherwise((n == 8) & F.contains(groups, F.lit(":")))


def _private_v6(h: Column) -> Column:
    """What lies outside the globally assigned 2000::/3 (site-local addresses too), and the special blocks inside it."""
    h = _unzoned(h)
    group = lambda i: F.conv(F.coalesce(F.nullif(F.get(F.split(h, ":"), F.lit(i)), F.lit("")), F.lit("0")), 16, 10).cast("int")
    a, b, c = group(0), group(1), group(2)
    assigned = (b == 0x3) | b.between(0x20, 0x3F) | ((b == 0x4) & (c == 0x112)) | h.isin("2001:1::1", "2001:1::2")
    special = ((a == 0x2001) & (b < 0x200) & ~assigned) | ((a == 0x2001) & (b == 0xDB8)) | (a == 0x2002)
    return F.startswith(h, F.lit("::")) | ~a.between(0x2000, 0x3FFF) | special


def safety(u: Column) -> Column:
    """Why an address must not be followed; empty where nothing speaks against it. Names aren't resolved."""
    s, h = scheme(u), F.regexp_replace(hostname(u), r"\.+$", "")
    octet = [F.try_to_number(F.regexp_extract(h, r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$", i), F.lit("999")).cast("int") for i in (1, 2, 3, 4)]
    a, b, c, d = octet
    private = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 192) & (b == 0) & (c == 0) & ~d.isin(9, 10)) | ((a == 192) & (b == 0) & (c == 2))
        | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    return (
        F.when(s.isin("file", "ftp", "data", "javascript"), F.concat(F.lit("blocked_scheme:"), s)).when(~s.isin("http", "https"), F.concat(F.lit("unsupported_scheme:"), F.when(s == "", "none").otherwise(s)))
        .when(h == "", "empty_host").when(h.isin("localhost", "localhost.localdomain") | F.endswith(h, F.lit(".localhost")), "localhost").when(h == "0.0.0.0", "unspecified")
        .when((is_ipv4(h) & private) | (is_ipv6(h) & _private_v6(h)), F.concat(F.lit("private_ip:"), h))
        .when(F.contains(h, F.lit(":")) & ~is_ipv6(h), F.concat(F.lit("invalid_ip:"), h)).otherwise("")
    )


def under(h: Column, domain: Column) -> Column:
    """A host that is the domain or lies below it."""
    return (h == domain) | F.endswith(h, F.concat(F.lit("."), domain))


def suffixes(h: Column) -> Column:
    """The host and all domains above it: an equality join with these replaces a test by ending."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


# Hosts and addresses of trackers and of subscription providers.
TRACKING_HOSTS = (
    "doubleclick.net", "googlesyndication.com", "google-analytics.com", "googletagmanager.com", "googleadservices.com", "scorecardresearch.com", "quantserve.com", "adnxs.com",
    "taboola.com", "outbrain.com", "criteo.com", "criteo.net", "segment.io", "segment.com", "mixpanel.com", "amplitude.com", "hotjar.com", "fullstory.com", "newrelic.com",
    "nr-data.net", "sentry.io", "clarity.ms", "chartbeat.com", "chartbeat.net", "parsely.com", "optimizely.com", "demdex.net", "omtrdc.net", "adsrvr.org", "rubiconproject.com",
    "pubmatic.com", "openx.net", "casalemedia.com", "amazon-adsystem.com",
)
PROVIDER_HOSTS = ("piano.io", "tinypass.com", "poool.fr", "zephr.com", "pelcro.com", "sophi.io", "cxense.com")
TRACKING_URL = (
    r"(?i)(?:/collect(?:\?|$)|/telemetry(?:\?|$)|/analytics(?:\?|$)|/pixel(?:\?|$)|"
    r"/beacon(?:\?|$)|/events?/track(?:\?|$)|/pageview(?:\?|$)|"
    r"[?&](?:utm_source|gclid|fbclid)=)"
)


def tracking(u: Column) -> Column:
    at = suffixes(F.regexp_replace(hostname(u), r"\.+$", ""))
    return F.arrays_overlap(at, F.array(*map(F.lit, TRACKING_HOSTS))) | blank(u).rlike(TRACKING_URL)


def subscription_provider(u: Column) -> Column:
    at = suffixes(F.regexp_replace(hostname(u), r"\.+$", ""))
    return F.arrays_overlap(at, F.array(*map(F.lit, PROVIDER_HOSTS))) | F.contains(F.lower(blank(u)), F.lit("fortress-client"))


def unwrapped(u: Column, engine: str = "bing.com") -> Column:
    """The address that a search redirect carries; null of one that carries none; others as they are."""
    target = F.try_url_decode(F.replace(F.regexp_extract(query(u), r"(?:^|&)url=([^&]*)", 1), F.lit("+"), F.lit("%20")))
    good = F.startswith(target, F.lit("http")) & ~F.contains(authority(target), F.lit(engine))
    return F.when(~F.contains(authority(u), F.lit(engine)), u).when(good, target)


def presentation(h: Column) -> Column:
    dotted = F.translate(F.trim(blank(h)), "。．｡", "...")
    return F.lower(F.regexp_replace(dotted, r"\.+$", ""))


def idna(h: str | None) -> str | None:
    """The IDNA form of a host; a label that has none stays."""
    if h is None or h.isascii():
        return h
    out = []
    for label in h.split("."):
        try:
            out.append(label.encode("idna").decode("ascii").lower() if label else label)
        except UnicodeError:
            out.append(label)
    return ".".join(out)


@F.pandas_udf(StringType())
def _idna(hosts: pd.Series) -> pd.Series:
    return hosts.map(idna)


def ascii_host(h: Column) -> Column:
    """IDNA form of a host; the only URL function that goes through Python."""
    return _idna(h)


def parse_suffix_rules(lines) -> list[tuple[str, str, int]]:
    """(base, kind, labels) of the lines of a public suffix list; comments and blank lines are skipped."""
    out = {}
    for line in lines:
        rule = line.strip().lower()
        if not rule or rule.startswith("//"):
            continue
        kind = "exception" if rule[0] == "!" else "wildcard" if rule.startswith("*.") else "exact"
        base = idna(rule.lstrip("!").removeprefix("*."))
        out[base, kind] = rule.count(".") + 1
    return [(b, k, n) for (b, k), n in out.items()]


def suffix_rules(spark: SparkSession, lines=fixed.PUBLIC_SUFFIXES) -> DataFrame:
    """base, kind (exact, wildcard, exception), n_labels of each rule of a list, which has a fixed, small size."""
    return spark.createDataFrame(parse_suffix_rules(lines), "base string, kind string, n_labels int")


def registrable(df: DataFrame, host_column: str, rules: DataFrame, name: str = "registrable", idna: bool = False) -> DataFrame:
    """Adds the registrable domain of a host: the longest suffix rule and one label more.

    Distinct hosts only are looked up, each of their suffixes by an equality join with the small rule table. A host
    that is a suffix, has an empty label or none gives null; an IP address stays as it is.
    """
    shown = presentation(F.col(host_column))
    hosts = df.select(F.col(host_column).alias("_host"), shown.alias("_shown")).distinct()
    hosts = hosts.withColumn("_ascii", ascii_host(F.col("_shown")) if idna else F.col("_shown"))
    each = hosts.select("_host", F.posexplode(suffixes(F.col("_ascii"))).alias("_skip", "_base"), F.size(F.split("_ascii", r"\.")).alias("_n"))
    matched = each.join(F.broadcast(rules), F.col("_base") == F.col("base"))  # a rule list has a fixed, small size
    length = F.when(F.col("kind") == "wildcard", F.when(F.col("_skip") > 0, F.col("n_labels"))).otherwise(F.col("n_labels"))
    best = matched.groupBy("_host").agg(F.max(F.when(F.col("kind") != "exception", length)).alias("_long"), F.max(F.when(F.col("kind") == "exception", F.col("n_labels") - 1)).alias("_cut"))
    labels = F.split("_shown", r"\.")
    n = F.greatest(F.lit(1), F.coalesce("_cut", "_long", F.lit(1)))
    found = hosts.join(best, "_host", "left").select(
        F.col("_host").alias("_key"),
        F.when(is_ipv4(F.col("_shown")) | is_ipv6(F.col("_shown")), F.col("_shown")).when(F.array_contains(labels, "") | (F.size(labels) <= n), None).otherwise(F.array_join(F.slice(labels, F.size(labels) - n, n + 1), ".")).alias(name),
    )
    return df.join(found, df[host_column].eqNullSafe(found["_key"]), "left").drop("_key")

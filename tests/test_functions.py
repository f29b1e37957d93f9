"""Text and URL functions against plain Python, with odd strings."""

import ipaddress
import math
import re
import statistics
import unicodedata

import pytest
from pyspark.sql import functions as F

from pagegrist.functions import fixed
from pagegrist.functions import text as T
from pagegrist.functions import urls as U

ODD = ["", " ", "a", "Straße ẞ", "A b c d", "x\r\ny\rz", "one.\n\n two!  \n \nthree", "“Quoted.”", "wait…", "a\x00b\x1cc", "अ। आ॥", "línea\nlínea\nLÍNEA\nlinea\nx", "3:45 and 5% of $7", "ABC rose", "​zero‍width", "l1\nl2\nl3 " * 30]


def column(spark, f, values=ODD):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def meaningful(x):
    return sum(not (c.isspace() or unicodedata.category(c)[0] == "C") for c in x)


def test_lengths(spark):
    assert column(spark, T.meaningful_length) == [meaningful(x) for x in ODD]
    want = [sum(unicodedata.category(c)[0] in "LN" for c in x) / meaningful(x) if meaningful(x) else 0.0 for x in ODD]
    assert column(spark, T.letter_number_ratio) == pytest.approx(want)


def test_spaces(spark):
    assert column(spark, T.normalize_space) == [re.sub(r"\s+", " ", x).strip() for x in ODD]
    assert column(spark, T.strip) == [x.strip() for x in ODD]
    assert column(spark, T.fold) == [x.lower().replace("ß", "ss") for x in ODD]


def test_paragraphs(spark):
    def want(x):
        raw = x.replace("\r\n", "\n").replace("\r", "\n")
        blocks = [b.strip() for b in re.split(r"\n\s*\n+", raw) if b.strip()]
        lines = [b.strip() for b in raw.split("\n") if b.strip()]
        return lines if len(blocks) <= 1 and len(lines) > 1 else blocks

    assert column(spark, T.paragraphs) == [want(x) for x in ODD]
    lengths = [[n for n in map(meaningful, want(x)) if n] for x in ODD]
    assert column(spark, T.paragraph_lengths) == lengths
    n = lambda x: T.paragraph_lengths(x)
    assert column(spark, lambda x: T.variance(n(x), T.mean(n(x)))) == pytest.approx([statistics.pvariance(v) if len(v) > 1 else 0.0 for v in lengths])


def test_endings(spark):
    def ends(x):
        x = x.rstrip()
        while x and x[-1] in fixed.CLOSING:
            x = x[:-1].rstrip()
        return bool(x) and x[-1] in fixed.TERMINAL

    assert column(spark, T.has_terminal_ending) == [ends(x) for x in ODD]
    assert column(spark, T.terminal_count) == [sum(c in fixed.TERMINAL for c in x) for x in ODD]


def test_cut_and_nulls(spark):
    got = column(spark, T.clean_text, ["Text one. Subscribe to continue reading now", "Already a subscriber? first", "Straße ist lang. 请登录后继续", None, "plain"])
    assert got[0] == "Text one." and got[1] == "Already a subscriber? first" and got[3] == "" and got[4] == "plain"
    assert got[2].startswith("Straße ist lang.")
    assert column(spark, T.meaningful_length, [None]) == [0]
    assert column(spark, T.slug, [None, "Hello,  World! - Ünï", "---"]) == ["article", "hello-world-ünï", "article"]


# Published test vectors of the public suffix algorithm.
VECTORS = {
    "COM": None, "example.COM": "example.com", "WwW.example.COM": "example.com", ".com": None, ".example": None, ".example.com": None, "example": None, "example.example": "example.example",
    "b.example.example": "example.example", "biz": None, "domain.biz": "domain.biz", "a.b.domain.biz": "domain.biz", "uk.com": None, "example.uk.com": "example.uk.com", "a.b.example.uk.com": "example.uk.com",
    "test.ac": "test.ac", "mm": None, "c.mm": None, "b.c.mm": "b.c.mm", "a.b.c.mm": "b.c.mm", "jp": None, "test.jp": "test.jp", "ac.jp": None, "www.test.ac.jp": "test.ac.jp", "kyoto.jp": None,
    "ide.kyoto.jp": None, "a.b.ide.kyoto.jp": "b.ide.kyoto.jp", "c.kobe.jp": None, "a.b.c.kobe.jp": "b.c.kobe.jp", "city.kobe.jp": "city.kobe.jp", "www.city.kobe.jp": "city.kobe.jp", "ck": None,
    "test.ck": None, "a.b.test.ck": "b.test.ck", "www.ck": "www.ck", "www.www.ck": "www.ck", "us": None, "test.ak.us": "test.ak.us", "k12.ak.us": None, "www.test.k12.ak.us": "test.k12.ak.us",
    "食狮.com.cn": "食狮.com.cn", "www.食狮.公司.cn": "食狮.公司.cn", "公司.cn": None, "shishi.中国": "shishi.中国", "中国": None, "xn--85x722f.xn--55qx5d.cn": "xn--85x722f.xn--55qx5d.cn",
    "xn--55qx5d.cn": None, "www.xn--85x722f.xn--fiqs8s": "xn--85x722f.xn--fiqs8s", "xn--fiqs8s": None, "93.184.216.34": "93.184.216.34", "2606:4700::1111": "2606:4700::1111", "999.1.1.1": "1.1", "a..com": None, "": None,
}


def test_registrable(spark):
    from pagegrist.session import ship

    ship(spark)
    df = spark.createDataFrame([(h,) for h in VECTORS], "host string")
    got = {r["host"]: r["registrable"] for r in U.registrable(df, "host", U.suffix_rules(spark), idna=True).collect()}
    assert got == VECTORS


def test_urls(spark):
    urls = ["HTTPS://Ex.COM/a/?utm_source=x&b=2&c&ref=1#f", "http://u:p@www.ex.com:80", "not a url", None, "http://[::1]/x", "https://amp.ex.com/a", "https://ex.com/a/amp/"]
    assert column(spark, U.canonical, urls[:2]) == ["https://ex.com/a?b=2&c=", "http://u:p@www.ex.com:80/"]
    spelt = ["https://e.com/a;p?q=a%20b&utm%5Fsource=x", "https://e.com/a?q=a+b", "https://e.com/a;x/b;y?z=%C3%A9~*%zz", "https://e.com/;p"]
    assert column(spark, U.canonical, spelt) == ["https://e.com/a?q=a+b", "https://e.com/a?q=a+b", "https://e.com/a;x/b?z=%C3%A9~%2A%25zz", "https://e.com/"]
    assert column(spark, U.host, urls) == ["ex.com", "ex.com", "", "", "::1", "amp.ex.com", "ex.com"]
    assert column(spark, U.looks_amp, urls) == [False, False, False, False, False, True, True]
    bad = ["file:///x", "gopher://x", "http://", "http://localhost/", "http://10.0.0.1/", "http://8.8.8.8/", "http://[fe80::1]/", "http://x.localhost", "nonsense", "http://172.20.1.1", "http://0.0.0.0/"]
    assert column(spark, U.safety, bad) == ["blocked_scheme:file", "unsupported_scheme:gopher", "empty_host", "localhost", "private_ip:10.0.0.1", "", "private_ip:fe80::1", "localhost", "unsupported_scheme:none", "private_ip:172.20.1.1", "unspecified"]


def test_addresses_of_networks(spark):
    """Every literal address as the standard library judges it."""
    v4 = ["8.8.8.8", "127.0.0.1", "10.0.0.1", "100.64.0.1", "172.15.0.1", "172.16.0.1", "192.0.0.8", "192.0.0.9", "192.0.2.1", "192.88.99.1", "198.17.0.1", "198.19.1.1", "198.51.100.1", "203.0.113.7", "223.1.1.1", "224.0.0.1", "240.0.0.1", "255.255.255.255", "0.1.2.3"]
    v6 = ["::1", "::", "::ffff:8.8.8.8", "::ffff:127.0.0.1", "64:ff9b::1", "64:ff9b:1::1", "100::1", "100:1::1", "200::1", "1fff::1", "2000::1", "2001::1", "2001:1::1", "2001:1::3", "2001:3::1", "2001:4:112::1", "2001:4:113::1", "2001:20::1", "2001:1ff::1", "2001:200::1", "2001:db8::1", "2002::1", "2606:4700::1111", "3fff::1", "3fff:1000::1", "4000::1", "fc00::1", "fdff::1", "fe80::1", "fec0::1", "ff02::1", "1:2:3:4:5:6:7:8"]

    def want(x):
        a = ipaddress.ip_address(x)
        bad = a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast or a.is_unspecified or getattr(a, "is_site_local", False)
        return f"private_ip:{x}" if bad else ""

    assert column(spark, U.safety, [f"http://{x}/a" for x in v4]) == [want(x) for x in v4]
    assert column(spark, U.safety, [f"http://[{x}]:80/a" for x in v6]) == [want(x) for x in v6]
    odd = ["1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1:2", "1:2:3:4:5:6:7:8:9", "1::2::3", "g::1", ":1", "1:2:3:4:5:6:7::8", *v4, *v6]

    def is_ip(x):
        try:
            return bool(ipaddress.ip_address(x))
        except ValueError:
            return False

    assert column(spark, lambda x: U.is_ipv4(x) | U.is_ipv6(x), odd) == [is_ip(x) for x in odd]


def test_datetimes(spark):
    got = column(spark, lambda x: F.date_format(T.discovery_datetime(x), "yyyy-MM-dd HH:mm"), ["Tue, 02 Jan 2024 03:04:05 GMT", "2 Jan 2024 03:04:05 +0200", "2024-01-02T03:04:05Z", "soon", "", None])
    assert got == ["2024-01-02 03:04", "2024-01-02 01:04", "2024-01-02 03:04", None, None, None]


def test_isfinite(spark):
    assert all(map(math.isfinite, column(spark, T.repeated_line_ratio)))

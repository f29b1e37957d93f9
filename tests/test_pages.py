"""Golden page layouts through the tree metrics and the gate, and the access classifier's cases."""

import pytest

from pagegrist.operators import access, gate, html
from pagegrist.sources import feeds, registries, rules, tokens

PROSE = "The council met on Tuesday and agreed on the plan after a long debate about roads, schools and the budget for next year. "
FULL = "<html><head><title>Plan agreed</title></head><body><nav><a href='/'>Home</a></nav><article>" + "".join(f"<p>{PROSE * 2}</p>" for _ in range(6)) + "</article></body></html>"
FLASH = "<html><head><title>Rate cut</title></head><body><article><p>The bank cut its rate by 0.25% at 14:30. Shares rose 3%. Analysts had expected the move after the weak data of last month and the quarter.</p></article></body></html>"
CHALLENGE = "<html><head><title>Just a moment...</title><script src='/cdn-cgi/challenge-platform/x'></script></head><body><form id='challenge-form' class='cf-turnstile'></form></body></html>"
TEASER = "<html><head><title>Deep dive</title></head><body><article><p>" + PROSE + "</p><p>Subscribe to continue reading.</p></article></body></html>"
SHELL = "<html><head><title>Sections</title></head><body><main><ul>" + "".join(f"<li><a href='/{i}'>Section number {i}</a></li>" for i in range(30)) + "</ul></main></body></html>"
GATED = "<html><body><article><h1>Story</h1><p>A first sentence that stands alone and just stops after a while without an end mark, as the rest of it is not to be had</p></article><script type='application/ld+json'>{\"@graph\": [{\"articleBody\": \"" + "word " * 400 + "\"}]}</script><div role='dialog' class='paywall-modal'><form><input type='password'></form><button>Sign in</button></div></body></html>"


def run(spark, pages):
    df = spark.createDataFrame([(i, p, "https://ex.com/a", 403 if p is CHALLENGE else 200) for i, p in enumerate(pages)], "id long, html string, url string, status int")
    records = html.page_records(spark, df, "id").join(df.select("id", "html", "status"), "id")
    return [r for r in gate.quality_gate(records, "article_text", "raw_title", "html", "status").orderBy("id").collect()]


def test_layouts(spark):
    full, flash, challenge, teaser, shell, gated, empty = run(spark, [FULL, FLASH, CHALLENGE, TEASER, SHELL, GATED, None])
    assert full.ok and full.score >= 0.52 and full.article_container_present and full.paragraph_count_dom == 6
    assert flash.ok and flash.reason == "pass"
    assert not challenge.ok and challenge.reason == "challenge_shell" and challenge.access_challenge and challenge.access_provider == "cloudflare"
    assert not teaser.ok and teaser.error_code == "PAYWALL_REMAINING" and teaser.paywall_suspected
    assert not shell.ok and shell.reason == "navigation_shell" and shell.link_density >= 0.55
    assert gated.jsonld_article_body_chars == 1600 and gated.reason == "teaser_schema_mismatch" and gated.modal_count == 1 and gated.password_input_count == 1
    assert not empty.ok


def test_tree():
    m, root = html.analyze("<body><p>a<p>b</p></b><br/>c &amp; d<script>var x='</p>'</script><div><img src='/i.png' width=100><img src='logo.png'></div></body>")
    assert root.text() == "a b c & d" and m["script_count"] == 1 and html.images(root, "https://e.com/x/") == ["https://e.com/i.png"]
    assert html.analyze("")[0]["tag_count"] == 0
    assert html.analyze("<div>" * 3000)[0]["dom_depth"] == 80


@pytest.mark.parametrize(("body", "title", "status", "detected", "reason"), [
    ("", "", 0, False, ""), ("<html><title>Access Denied</title>You don't have permission to access this page</html>", "", 403, True, "generic_http_block"), ("plain text of a page", "", 429, True, "generic_http_block"),
    ("please verify that you are a human", "", 200, True, "generic_challenge"), ("<p>An article about captcha design</p>", "News", 200, False, ""), ("<html>captcha-delivery.com</html>", "", 403, True, "datadome_challenge"),
    ("<html><title>访问验证</title></html>", "", 200, True, "generic_challenge"), ("<html>Apache2 Ubuntu Default Page</html>", "", 200, True, "generic_http_block"),
])
def test_access(spark, body, title, status, detected, reason):
    df = spark.createDataFrame([(body, title, status)], "html string, title string, status int")
    r = access.access_columns(df, "html", "title", "status").first()
    assert (r.access_detected, r.access_reason) == (detected, reason)
    assert r.asDict().keys() == {"html", "title", "status", "access_detected", "access_challenge", "access_provider", "access_reason", "access_score"}


def test_partial(spark):
    df = spark.createDataFrame([(PROSE * 3 + "Subscribe to read the rest.",)], "t string")
    r = gate.quality_gate(df, "t", allow_partial=True).first()
    assert r.ok and r.reason == "teaser_allowed_partial"


def test_literal():
    got = rules.parse_literal('var defaultSites = {"A": {domain: "a.b", block_regex: /x[/]y\\/z/gi, n: 3, t: true, l: ["p,q", \'r\'], o: {k: 1}}, // c\n"B": "skip", "C": {"group": [],},}; ')
    assert got == [(0, "A", {"domain": "a.b", "block_regex_str": "x[/]y\\/z", "n": 3, "t": True, "l": ["p,q", "r"], "o": {"k": 1}}), (1, "C", {"group": []})]
    assert rules.parse_literal("") == [] and rules.parse_literal('{"A": {x: "unclosed') == [(0, "A", {"x": "unclosed"})]


def test_feeds():
    rss = "<rss><channel><item><title> T </title><link>https://e.com/1</link><pubDate>d</pubDate></item><item><link>ftp://x</link></item></channel></rss>"
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>A</title><link rel='self' href='https://e.com/s'/><link href='https://e.com/2'/><updated>u</updated></entry></feed>"
    assert feeds.feed_entries(rss) == [("T", "https://e.com/1", "d")] and feeds.feed_entries(atom) == [("A", "https://e.com/2", "u")]
    assert feeds.sitemap_entries("<urlset><url><loc>https://e.com/3</loc><lastmod>m</lastmod></url></urlset>") == [("", "https://e.com/3", "m")]
    assert feeds.feed_entries("<broken") == [] and feeds.feed_entries(None) == [] and feeds.health("<x/>", "e.com") == (0, 0, [])


def test_tokens(spark):
    import base64

    from pyspark.sql import functions as F

    url = b"https://publisher.example/story"
    payload = b"\x08\x13\x22" + bytes([len(url)]) + url + b"\xd2\x01\x00"
    link = "https://news.google.com/rss/articles/" + base64.urlsafe_b64encode(payload).decode().rstrip("=") + "?oc=5"
    df = spark.createDataFrame([(link,), ("https://e.com/x",), ("https://news.google.com/articles/!!",), (None,)], "u string")
    assert [r["to"] for r in tokens.decoded(df, "u", "to").collect()] == [url.decode(), "https://e.com/x", "https://news.google.com/articles/!!", None]
    inner = b"\x0a" + bytes([len(url)]) + url
    nested = b"\x12" + bytes([len(inner)]) + inner
    assert list(tokens.payloads(nested + b"\x08\x01")) == [inner, url]  # the outer field first
    assert list(tokens.payloads(b"\x12\x7fshort")) == [] and list(tokens.payloads(b"")) == [] and list(tokens.payloads(b"\x80" * 12)) == []
    packed = lambda data: base64.urlsafe_b64encode(data).decode().rstrip("=")
    assert tokens.addresses(packed(b"\xff\xff https://open.example/a")) == ["https://open.example/a"]
    assert tokens.addresses(packed(b"\x22\x1dhttps://news.google.com/rss/x")) == [] and tokens.addresses("a" * 64_001) == [] and tokens.addresses(None) == [] and tokens.addresses("é") == []


def test_archives(spark, tmp_path):
    import io
    import zipfile

    def packed(*names):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
            for n in names:
                z.writestr(n, "text of " + n)
        return b.getvalue()

    assert registries.zip_member(packed("a/x.js", "b.txt"), "x.js") == "text of a/x.js" and registries.zip_member(packed("ax.js"), "x.js") is None
    assert registries.zip_member(packed("a/x.js", "b/x.js"), "x.js") is None and registries.zip_member(b"no zip", "x.js") is None
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.js", "0" * 1_000_000)
    assert registries.zip_member(bomb.getvalue(), "x.js") is None and registries.zip_member(packed(*(f"{i}.txt" for i in range(1000)), "x.js"), "x.js") is None
    for name, data in (("good.zip", packed("a/x.js")), ("bomb.zip", bomb.getvalue()), ("broken.zip", b"PK")):
        (tmp_path / name).write_bytes(data)
    read = registries.zip_texts(spark, spark.read.format("binaryFile").load(str(tmp_path)), "x.js").collect()
    assert {r.path.rpartition("/")[2]: r.text for r in read} == {"good.zip": "text of a/x.js", "bomb.zip": None, "broken.zip": None}


def test_sinks(spark, tmp_path):
    from pagegrist.sources import sinks

    df = spark.createDataFrame([("A  title", "https://e.com/1", "# A"), ("A  title", "https://e.com/2", "# B")], "title string, url string, md string")
    sinks.markdown_files(df, "title", "url", "md", str(tmp_path / "md"))
    back = spark.read.text(str(tmp_path / "md"))
    assert back.count() == 2 and {r.slug[:8] for r in back.collect()} == {"a-title-"} and back.select("slug").distinct().count() == 2
    assert [r.value for r in sinks.envelopes(df.selectExpr("title", "null as x").limit(1)).collect()] == ['{"title":"A  title","x":null}']
    hashes = [d.agg(sinks.content_hash(d["url"], d["md"]).alias("h")).first().h for d in (df, df.orderBy("url", ascending=False).repartition(2))]
    assert hashes[0] == hashes[1]


def test_registry_file(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"policies": [{"domain": "b.example", "coverage": "x"}, {"domain": "a.example"}]}')
    (tmp_path / "broken.json").write_text("{")
    got = registries.read_registry(spark, str(tmp_path), registries.DISCOVERY, "policies").orderBy("seq").collect()
    assert [(r.seq, r.domain) for r in got] == [(0, "b.example"), (1, "a.example")]


def test_mirror(spark, tmp_path):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "path string, hash string")
    assert registries.write_changed(old, new, str(tmp_path / "m")) == 2
    assert registries.write_changed(new, new, str(tmp_path / "n")) == 0 and not (tmp_path / "n").exists()

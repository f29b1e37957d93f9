"""Pages and documents with what the smallest tables don't have, against the queries' SQL."""

import duckdb
import pytest

from pagegrist.operators import html
from pagegrist.plans import registry


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """Some pages whose titles end within a reference, and documents that begin with quotes."""
    folder = str(tmp_path_factory.mktemp("odd"))
    pages = spark.read.parquet(f"{sf}/pages.parquet").where("page_id < 12")
    pages.selectExpr("page_id", "url", "regexp_replace(html, '</(title|h1)>', ' R&amp;D&amp&lt</$1>') as html").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 12 and text is not null")
    docs.selectExpr("doc_id", "concat('token = \"ab\" \\\\ ', text) as text", "lang", "source", "n_chars").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["article_markdown", "page_article", "page_gate", "page_html_metrics", "page_markdown"])
def test_query(spark, odd, name):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet/*.parquet'")
    df = registry.queries()[name](spark, odd)
    want = con.sql(registry.oracle_sql()[name])
    show = lambda v: round(v, 6) if isinstance(v, float) else v
    rows = lambda data, names: sorted(repr([show(r[names.index(c)]) for c in sorted(names)]) for r in data)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    assert got and got == rows(want.fetchall(), want.columns)


def test_references_end_with_a_semicolon():
    root = html.parse("<p title='a&amp;b&ampc'>R&amp;D &amp &lt x&#65;&#66 &nope; &ltx; &copy;</p><script>a&&b&amp;</script>")
    p, script = root.children
    assert p.text() == "R&D &amp &lt xA&#66 &nope; &ltx; ©" and p.attrs["title"] == "a&b&ampc"
    assert script.children == ["a&&b&amp;"]

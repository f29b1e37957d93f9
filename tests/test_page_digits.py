"""page_html_metrics against its SQL where the last digit is open to how it is reckoned, and on deep pages."""

import duckdb

from pagegrist.plans import registry


def _page(paragraphs, length: int) -> str:
    head, tail = "<html><head><title>T</title></head><body><nav><ul><li><a></a></li></ul></nav><article><h1>H</h1>", "</article><footer></footer></body></html>"
    body = "".join(paragraphs)
    return head + body + "<!--" + "-" * (length - len(head + body + tail) - 7) + "-->" + tail if length else head + body + tail


def test_digits_and_depth(spark, tmp_path):
    halves = [_page(["<p>" + "x" * n + "</p>"], 640 * k) for k in (1, 2, 3) for n in range(5, 290)]  # shown characters of 640, 1280, 1920: seven digits, the last a 5
    paragraphs = [["<p>" + "x" * (7 + (i * 1009 + k * 31) % (300 + 1700 * (k % 13))) + "</p>" for i in range(31 + k)] for k in range(40)]
    deep = ["<p><b>bold<br>" * n for n in (1, 37, 38, 39, 129)]
    pages = halves + [_page(p, 0) for p in paragraphs] + [_page([p], 0) for p in deep]
    spark.createDataFrame([(i, "https://e.com/a", p) for i, p in enumerate(pages)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = registry.queries()["page_html_metrics"](spark, str(tmp_path))
    want = con.sql(registry.oracle_sql()["page_html_metrics"])
    names = sorted(df.columns)
    rows = lambda data, columns: sorted([r[columns.index(c)] for c in ("page_id", *names)] for r in data)
    got, want = rows([tuple(r) for r in df.collect()], df.columns), rows(want.fetchall(), want.columns)
    assert len(got) == len(pages) and got == want
    assert max(r[1 + names.index("dom_depth")] for r in got) == 262

"""The declared language of a page whose opening tag stands far behind."""

from pyspark.sql import functions as F

from pagegrist.llm import language_id


def test_long_preamble(spark, sf):
    docs, pages = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "pages"))
    lang = docs.where("lang is not null").first().lang
    banner = "<!-- " + "x" * 5_000 + " -->" + " " * 5_000
    far = spark.createDataFrame([(-1, "http://x.example/", f'{banner}<HTML class="a"\n lang="{lang}"><p>a</p></html>')], "page_id long, url string, html string")
    got = language_id.identify(spark, pages.select("page_id", "url", "html").unionByName(far), docs).where(F.col("page_id") == -1).first()
    assert got.declared == lang

"""An address in brackets that is none must not be followed."""

from pyspark.sql import functions as F

from pagegrist.functions import urls


def test_invalid_literals(spark):
    bad = ["http://[fe80::10009%25eth0]/", "http://[1:2]/", "http://[::12345]:80/x"]
    good = ["http://[2606:4700::1111]/", "http://a.example:80/x:y", "https://8.8.8.8/"]
    df = spark.createDataFrame([(u,) for u in bad + good], "u string").select("u", urls.safety(F.col("u")).alias("s"))
    got = {r.u: r.s for r in df.collect()}
    assert all(got[u].startswith("invalid_ip:") for u in bad) and not any(got[u] for u in good)

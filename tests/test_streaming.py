"""Streams over landed files give what a batch gives."""

import pytest

from pagegrist.streaming import jobs


@pytest.fixture
def landed(spark, tmp_path):
    rows = [(i, i % 5, f"d{i % 3}.example", "e", 10 * i, "HTTP_BLOCKED" if i % 7 == 0 else "", f"2024-01-01 00:{i:02d}:00") for i in range(40)]
    df = spark.createDataFrame(rows, "seq long, request_id long, domain string, engine string, elapsed_ms long, error_code string, t string").selectExpr("* except (t)", "cast(t as timestamp) as ts")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), df


def drained(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_rates(spark, landed):
    path, df = landed
    got = drained(spark, jobs.rates(jobs.read_landed(spark, path, jobs.ATTEMPTS)), "rates", "complete")
    assert sum(r.n for r in got) == 40 and sum(r.n_failed for r in got) == 6


def test_sessions(spark, landed):
    path, _ = landed
    got = drained(spark, jobs.sessions(jobs.read_landed(spark, path, jobs.ATTEMPTS)), "sessions", "complete")
    assert sorted((r.domain, r.n) for r in got) == [("d0.example", 14), ("d1.example", 13), ("d2.example", 13)]


def test_first_seen(spark, tmp_path):
    spark.createDataFrame([(1, "https://e.com/a?utm_source=x"), (2, "https://e.com/a"), (3, "https://e.com/b")], "page_id long, url string").selectExpr("*", "timestamp'2024-01-01' as ts").coalesce(1).write.parquet(str(tmp_path / "p"))
    got = drained(spark, jobs.first_seen(jobs.read_landed(spark, str(tmp_path / "p"), "page_id long, url string, ts timestamp")), "firsts")
    assert {r.canonical for r in got} == {"https://e.com/a", "https://e.com/b"} and len(got) == 2

"""Syndicated candidates: no order is left out, and host and attribution count."""

from datetime import datetime

from pagegrist.operators import attempts
from pagegrist.plans import registry


def test_every_residue_class(spark, sf):
    """With two titles every order has candidates near it, though two thirds of them are of another host or without the agency's name."""
    got = registry.queries()["syndication_hot_title"](spark, sf).collect()
    assert {r.orig_id % 7 for r in got} == set(range(7)) and {r.cand_id % 7 for r in got} > {1}
    assert all(r.orig_id != r.cand_id and r.cand_id % 3 and r.cand_id % 4 in (0, 3) for r in got)


def test_host_and_attribution(spark):
    day = datetime(2024, 1, 1)
    cases = [
        (1, "https://wire.example/a", "text (AGENCY)", True), (2, "https://a.wire.example./a", "(agency)", True), (3, "https://notwire.example/a", "(agency)", False),
        (4, "https://wire.example.org/a", "(agency)", False), (5, "https://wire.example/a", "by us", False), (6, "https://wire.example/a", None, False),
        (7, "https://wire.example/a", "x" * 4000 + "(agency)", False), (8, "https://wire.example/a", "x" * 3992 + "(Agency)", True), (9, None, "(agency)", False),
    ]
    originals = spark.createDataFrame([(i, "https://paper.example/", str(i), day) for i, *_ in cases] + [(10, "", "1", day)], "orig_id int, url string, title_key string, published timestamp")
    candidates = spark.createDataFrame([(i, u, str(i), day, a, i) for i, u, a, _ in cases], "cand_id int, url string, title_key string, published timestamp, attribution_text string, seq int")
    got = {r.orig_id for r in attempts.syndicated(originals, candidates, "wire.example", "(Agency)").collect()}
    assert got == {i for i, _, _, ok in cases if ok}

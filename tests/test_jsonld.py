"""Strings under a field of JSON at any depth, against plain Python."""

import json

from pagegrist.operators import jsonld


def walked(value):
    if isinstance(value, dict):
        for k, v in value.items():
            if k.lower() == "articlebody" and isinstance(v, str):
                yield v
            else:
                yield from walked(v)
    elif isinstance(value, list):
        for v in value:
            yield from walked(v)


def test_strings_at_any_depth(spark):
    deep: object = {"articleBody": "deep"}
    for i in range(25):
        deep = [deep, i] if i % 2 else {"x": deep, "n": None}
    cases = [
        {"articleBody": "top"}, [{"ARTICLEBODY": "a"}, {"b": [{"articleBody": "c"}, {"articleBody": 5}, {"articleBody": None}]}], deep, {"articleBody": {"articleBody": "inner", "articleBody2": "no"}}, {"articleBody": ["listed", {"articleBody": "in list"}]},
        "articleBody", 5, None, [], {}, {"articleBody": ""}, {"articleBody": 'quote " and { brace'}, [["x"], [[]]],
    ]
    rows = [(i, json.dumps(c)) for i, c in enumerate(cases)] + [(90, "{broken"), (91, None), (92, "")]
    found = jsonld.strings_of(spark, spark.createDataFrame(rows, "i int, j string"), "i", "j", "articleBody").collect()
    assert sorted((r.i, r.value) for r in found) == sorted((i, v) for i, c in enumerate(cases) for v in walked(c))


def test_scripts_of_pages(spark):
    ld = '<script type="application/ld+json">{}</script>'.format
    pages = [
        (1, ld('{"articleBody": "one two"}') + ld('{"articleBody": "one  two three"}')), (2, "<script>{\"articleBody\": \"x\"}</script>"), (3, ld(json.dumps({"articleBody": "y" * jsonld.MAX_JSON_CHARS}))),
        (4, None), (5, "<p>ld+json</p>"), (6, "<SCRIPT data-x=1 TYPE='APPLICATION/LD+JSON;charset=utf-8'>\n{\"articleBody\": \"sechs\"}\n</SCRIPT >"), (7, ld("{]")),
    ]
    got = jsonld.article_body_chars(spark, spark.createDataFrame(pages, "page_id int, html string"), "page_id", "html").collect()
    assert {r.page_id: r.chars for r in got} == {1: 11, 6: 5}

"""No labelled language is dropped, however many there are."""

from pagegrist.llm import language_id


def test_every_language(spark):
    docs = spark.createDataFrame([(i, f"l{i:03d}", f"text of {i}") for i in range(300)], "doc_id long, lang string, text string").coalesce(1)
    langs, table = language_id.learn(docs)
    assert langs == [f"l{i:03d}" for i in range(300)] and len(table) == 300

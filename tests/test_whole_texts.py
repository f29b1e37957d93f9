"""Text queries on texts whose only quotes, line ends and other marks stand far behind."""

import hashlib

from pagegrist.plans import registry


def test_far_marks(spark, tmp_path):
    far = "a" * 400 + ' "B"\nc'
    spark.createDataFrame([(1, far)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "!" * 150 + "Word")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).first()
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    assert run("title_norm").digest == md5("a" * 400 + " b c")
    assert run("yaml_and_clips").escaped_digest == md5("a" * 400 + ' \\"B\\" c')
    assert run("slugs").slug == "word"

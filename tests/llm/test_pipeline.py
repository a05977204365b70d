import importlib.util

import pytest

if not importlib.util.find_spec("corpus_pipeline"):
    pytest.skip("no pipeline", allow_module_level=True)


def test_stages(spark, sf_dir):
    import corpus_pipeline
    from tracelens.llm.common import n_words, table
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs.count()
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == names and (k == 3 or 0 < docs.count() <= before)
    words = docs.agg(F.sum(n_words(F.col("text")))).first()[0]
    got = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert got.count() == docs.count() and words > 0

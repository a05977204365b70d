"""Results that must not depend on the order of rows, on white space around texts, or on how often an id occurs."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from tracelens.llm import exact_dedup, mixing, quality, toxicity  # noqa: E402
from tracelens.llm.common import Work, counted_off, cut, n_words  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def repeated_ids():
    """Rows that share doc_ids, with equal and with other texts."""
    texts = [" ".join(f"w{k}x{i}" for i in range(k)) for k in (3, 9, 40, 70, 7)]
    return [(d, t, "en", s, len(t)) for s in ("a", "b", "c") for d, t in zip((1, 1, 1, None, None), texts)] + [(1, texts[2], "en", "a", 1)] * 5


def test_mixture_is_a_function_of_the_rows(spark):
    rows = repeated_ids()
    found = []
    for some in (rows, rows[::-1], rows[7:] + rows[:7]):
        taken = mixing.mix(spark.createDataFrame(some, DOCS), block=8).documents
        found.append(sorted(tuple(r) for r in taken.select(F.coalesce("doc_id", F.lit(-1)), "print", "source", "size", "taken").collect()))
    assert found[0] == found[1] == found[2]


@pytest.mark.parametrize("before", ["", " ", "\n\t", "\r\n \x0b"])
def test_applied_texts_have_the_words_that_are_taken(spark, before):
    rows = [(i, before + "\n".join(f"w{i}_{k}" for k in range(10 + i)) + "\t", "en", s, 1) for i in range(12) for s in ("a", "b", "c")]
    docs = spark.createDataFrame(rows, DOCS)
    want = mixing.mix(docs, block=4).documents.groupBy("doc_id").agg(F.sum("taken").alias("n")).filter("n > 0")
    got = mixing.apply(docs, block=4).groupBy("doc_id").agg(F.sum(n_words(F.col("text"))).alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    texts = [r["text"] for r in mixing.apply(docs, block=4).collect()]
    assert all(t.split()[0].endswith("_0") for t in texts)


def test_rows_of_one_key_are_counted_off_over_partitions(spark):
    rows = spark.range(0, 3000, 1, 6).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("k"), F.col("id").alias("part"), F.monotonically_increasing_id().alias("uid"))
    with Work(spark):
        rows = cut(rows)
        got = counted_off(rows, ["k"], "uid", "n").orderBy("uid").collect()
    for key in ("hot", None):
        assert [r["n"] for r in got if r["k"] == key] == list(range(1, 1 + sum(r["k"] == key for r in got)))


def test_one_row_of_alike_ones_stays_whatever_their_order(spark):
    rows = [(4, "a b", "en", "s", 1), (4, "a  b", "en", "t", 2), (4, "a  b", "en", "r", 3), (4, " ab ", None, "z", 4), (None, "ab", "en", "s", 5), (7, None, "en", "s", 0), (7, "", "en", "s", 0)]
    for some in (rows, rows[::-1]):
        kept = exact_dedup.keep_first(spark.createDataFrame(some, DOCS)).collect()
        assert [tuple(r) for r in kept if r["doc_id"] == 4] == [(4, " ab ", None, "z", 4)] and sum(r["doc_id"] == 7 for r in kept) == 1 and len(kept) == 2


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_one_row_of_each_label_comes_to_the_driver(spark, label):
    docs = spark.createDataFrame([(i % 3, f"text {i}", "en", "s", 1) for i in range(300)], DOCS)
    labels = spark.createDataFrame([(i % 4, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    some = toxicity.labelled(docs, labels, "doc_id", "text", 50) if label == "toxic" else quality.one_of_each(docs, labels, label, 50, "doc_id", "text")
    assert 0 < some.count() <= 3

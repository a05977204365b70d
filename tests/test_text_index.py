"""Substring search through trigrams against a scan."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracelens.operators import search, text_index


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 40))) for _ in range(120)] + [None, "", "ab", "ABA bab", "aab" * 30]
    rows = spark.createDataFrame([(i, t, None if i % 3 else "Ab") for i, t in enumerate(texts)], "id long, text string, more string")
    folder = str(tmp_path_factory.mktemp("grams"))
    text_index.write_index(rows, "id", ["text", "more"], folder)
    return rows, folder


@pytest.mark.parametrize("query", ["", "  ", "a", "AB", "aba", "abab", "é b", "aabaabaab", "zzz", "ab ab", " ab "])
def test_the_index_finds_what_a_scan_finds(indexed, query):
    rows, folder = indexed
    got = text_index.search(rows, "id", ["text", "more"], query, folder)
    want = search.text_search(rows, ["text", "more"], query)
    assert got.columns == rows.columns and sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect())


def test_candidates_hold_the_rarest_grams_and_an_unknown_one_has_none(spark, indexed):
    rows, folder = indexed
    assert text_index.candidates(spark, folder, "ab") is None and text_index.candidates(spark, folder, "abz").count() == 0
    held = {r["key"] for r in text_index.candidates(spark, folder, "abab").collect()}
    texts = {r["id"]: r["t"] for r in rows.select("id", text_index.searched(rows, ["text", "more"]).alias("t")).collect()}
    assert held == {i for i, t in texts.items() if "aba" in t and "bab" in t}
    counts = spark.read.parquet(f"{folder}/counts").agg(F.sum("n")).first()[0]
    assert counts == sum(len({t[k : k + 3] for k in range(len(t) - 2)}) for t in texts.values())


def test_a_long_text_is_indexed_in_one_pass_and_postings_lie_together(spark, tmp_path):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdé") for _ in range(600_000)) + "\U0001f600\x00z"
    rows = spark.createDataFrame([(1, long), *[(i, "abc") for i in range(2, 400)]], "id long, text string")
    start = time.time()
    text_index.write_index(rows, "id", ["text"], str(tmp_path))
    assert time.time() - start < 60
    for query, want in (("\U0001f600\x00z", {1}), ("abc", set(range(1, 400))), ("xyz", set())):
        assert {r["id"] for r in text_index.search(rows, "id", ["text"], query, str(tmp_path)).collect()} == want
    held = spark.read.parquet(f"{tmp_path}/postings")
    assert held.filter("gram = 'abc'").count() < 20 and held.agg(F.sum("n")).first()[0] == len({long[k : k + 3] for k in range(len(long) - 2)}) + 398


def test_grams_of_texts_with_more_letters_than_a_number_holds():
    texts = ["".join(map(chr, range(0x10000 + 3000 * i, 0x10000 + 3000 * i + 3000))) for i in range(300)] + ["", "ab", "aaaa"]
    grams, count, which = text_index._grams(texts)
    found, at = [], 0
    for g, n in zip(grams, count):
        found += [(g, int(i)) for i in which[at : at + n]]
        at += n
    assert sorted(found) == sorted((t[k : k + 3], i) for i, t in enumerate(texts) for k in range(len(t) - 2) if t != "aaaa" or k == 0)

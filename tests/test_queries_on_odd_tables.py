"""Queries on small tables made for them, against their SQL in DuckDB."""

import hashlib
import time

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tracelens.operators import traces
from tracelens.plans import catalog


def against_sql(spark, folder, name, **tables):
    """The query's rows, which are those of its SQL on the same tables (name=columns)."""
    con = duckdb.connect()
    for t, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = catalog.queries()[name](spark, str(folder))
    got = [tuple(r) for r in df.collect()]
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def test_pages_that_differ_in_their_query_alone_share_an_artifact(spark, tmp_path):
    urls = ["https://a.example/x?page=2&ref=x", "https://a.example/x/", "https://b.example/y?page=1", "https://b.example/z", "https://c.example/#top", "https://c.example?page=3"]
    got = against_sql(spark, tmp_path, "artifact_cache", pages={"page_id": pa.array(range(6), pa.int64()), "url": urls, "html": ["<html>"] * 6})
    assert {r[0]: r[1] for r in got} == {0: True, 1: True, 2: True, 3: False, 4: True, 5: True}


def test_noise_is_told_by_its_bytes(spark, tmp_path):
    def few_odd(url):  # noise without a zero byte and with few bytes that are no text, of which some can't be decoded
        b = hashlib.md5(url.encode()).digest()
        odd = sum(not (0x20 <= x < 0x7F or x in b"\b\t\n\f\r") for x in b)
        return 0 not in b and 0 < odd <= 4

    odd = next(u for u in (f"https://a.example/{i}" for i in range(10**6)) if few_odd(u))
    got = against_sql(spark, tmp_path, "binary_bodies", pages={"page_id": pa.array(range(6), pa.int64()), "url": ["https://a.example/a", odd] + ["https://a.example/a"] * 3 + ["https://a.example/b"], "html": ["<html>é</html>"] * 6})
    assert {r[0]: r[2] for r in got} == {0: False, 1: False, 2: True, 3: False, 4: False, 5: True}


def test_gold_urls_of_large_groups(spark, tmp_path):
    """Groups of thousands of pages, in which comparing all golds with all found ones takes minutes."""
    n = 120_000
    urls = [f"https://www.host{i % 30}.example/{i % 30}/{i}/page?utm_source=x" for i in range(n)]
    urls[1], urls[2], urls[3], urls[5], urls[7] = "http://www.host0.example/0/0/page/more", "https://x.example", None, "http://x.example/a/b/c", "HTTPS://www.host6.example/6/36/page"
    start = time.time()
    got = against_sql(spark, tmp_path, "gold_url_hits", pages={"page_id": pa.array(range(n), pa.int64()), "url": urls, "html": [""] * n})
    assert {r[0]: r[1] for r in got} == {g: g in (0, 6) for g in range(0, 30, 2)} and time.time() - start < 100


def test_url_hits_are_those_of_arrays(spark):
    words = ["", "/", "a", "http://a.example", "https://a.example/x", "https://www.a.example/x/y/z", "https://b.example/x?q=1", "b.example/x", None, "https://b.example/x/"]
    pairs = [(10 * i + j, a, b) for i, a in enumerate(words) for j, b in enumerate(words)]
    rows = spark.createDataFrame(pairs, "g long, a string, b string")
    got = traces.url_hits(rows.select("g", F.col("a").alias("url")), rows.select("g", F.col("b").alias("url")), ["g"]).collect()
    one = lambda c: F.array_compact(F.array(c))
    want = rows.filter("a IS NOT NULL").select("g", traces.prefix_hit(one("a"), one("b")).alias("prefix"), traces.overlap(F.transform(one("a"), traces.T.normalize_url), F.transform(one("b"), traces.T.normalize_url)).alias("exact"))
    assert sorted((r["g"], r["prefix"], r["exact"]) for r in got) == sorted(tuple(r) for r in want.collect())

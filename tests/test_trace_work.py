"""How often the per-trace expressions work on the same value."""

from pyspark.sql import functions as F

from tracelens.operators import traces as O
from tracelens.plans.surrogates import traces


def test_urls_are_normalised_once(spark, sf_dir):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
        rows = traces(spark, sf_dir)
        # A parameter that is left out tells, twice, each place where a URL is normalised: the golds and the found ones, or the wanted one and the found ones.
        assert plan(O.per_trace_metrics(rows)).count("igshid") == 4
        assert plan(rows.select(O.find_seen(F.get("gold_urls", F.lit(0))).alias("hit"))).count("igshid") == 4
        assert "from_json(" not in plan(rows.select("retrievals"))
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_the_latest_search_that_shows_a_url(spark):
    result = "named_struct('url', {}, 'rank', {})"
    search = lambda i, *found: f"named_struct('retrieval_id', 'it{i}', 'search_query', 'q{i}', 'search_response', named_struct('results', array({', '.join(result.format(*x) for x in found)})))"
    a, b = ("'https://A.example/x/?utm_source=y'", 1), ("'https://a.example/x'", 2)
    other, none = ("'https://b.example'", 3), ("CAST(NULL AS STRING)", 4)
    rows = spark.sql(f"SELECT array({search(1, a)}, {search(2, other, b, a)}, {search(3, other, none)}) AS retrievals")
    hit = lambda url: rows.select(O.find_seen(F.lit(url)).alias("h")).first()["h"]
    assert hit("http://x.example") is None
    assert [hit("https://a.example/x/")[c] for c in ("retrieval_id", "search_query", "rank")] == ["it2", "q2", 2]
    assert [hit("https://b.example/")[c] for c in ("retrieval_id", "rank")] == ["it3", 3] and hit(None)["rank"] == 4

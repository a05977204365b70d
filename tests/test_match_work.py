"""What matching fetches costs, and what it makes of rows without keys."""

from tracelens.operators import judge as J
from tracelens.plans import catalog


def test_results_and_fetches_meet_once(spark, sf_dir):
    for name in ("fetch_match_alias", "fetch_match_best"):
        assert "Join" not in catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString(), name


def test_rows_without_keys_match_nothing(spark):
    results = spark.createDataFrame([("t", "r", None, None, None, 1), ("t", "r", None, None, None, 2), (None, "r", "d", 1, "u", 3), ("t", None, "d", 1, "u", 4), ("t", "", "d", 1, "u", 5), ("t", "r", "e", 7, "u", 6), ("t", "r", "e", 7, "u", 6)], "trace_id string, retrieval_id string, document_id string, rank int, url string, n int")
    fetches = spark.createDataFrame([("t", "r", "x", None, None, "f1"), ("t", "r", None, 7, "u", "f2"), ("t", "r", "", 7, "u", "f3"), (None, "r", "d", 1, "u", "f4"), ("t", None, "d", 1, "u", "f5"), ("t", "", "d", 1, "u", "f6"), ("t", "r", "y", 7, None, "f8"), ("t", "r", "z", 9, "u", None)], "trace_id string, retrieval_id string, document_id string, rank int, url string, fetch_id string").selectExpr("*", "1 AS iteration_num", "'failed' AS fetch_status")
    got = J.match_fetches(results, fetches)
    assert sorted((r["n"], r["fetch_id"], r["model_fetched_document"]) for r in got.filter("n < 6").collect()) == [(i, None, False) for i in range(1, 6)]
    assert [(r["fetch_id"], r["fetch_status"]) for r in got.filter("n = 6").collect()] == [("", "failed")] * 2

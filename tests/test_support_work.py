"""How often query_support reads the universe."""

from pyspark.sql import functions as F

from tracelens.operators import support as S
from tracelens.plans import catalog
from tracelens.plans.surrogates import judge_rows


def test_the_universe_meets_the_records_once(spark, sf_dir):
    for name in ("query_support", "support_report", "support_invariants"):
        assert "LeftSemi" not in catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString(), name


def test_records_of_other_queries_count_nowhere(spark, sf_dir):
    universe = spark.createDataFrame([("p0", "q1", True), ("p9", "none", False)], "provider_id string, query_id string, correct boolean")
    rows = judge_rows(spark, sf_dir).withColumns({"provider_id": F.lit("p0"), "query_id": F.when(F.col("seq") % 2 == 0, "q1").otherwise("q2")})
    got = {r["query_id"]: r["snippet_rows"] + r["page_rows"] for r in S.query_support(rows, universe).collect()}
    assert got == {"q1": rows.filter(S.valid()).filter("query_id = 'q1'").count(), "none": 0}

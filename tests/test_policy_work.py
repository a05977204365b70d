"""The rows that the simulator of policies works on."""

from tracelens.plans import catalog


def test_urls_are_not_multiplied_by_policies(spark, sf_dir):
    plan = catalog.queries()["policy_rows"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate") and "Generate" not in plan[plan.index("Aggregate") :]

"""The bootstrap's work beside the number of its queries."""

import time

from tracelens.operators import bootstrap


def test_draws_are_made_once_for_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "BLOCK", 20)
    monkeypatch.setattr(bootstrap, "HELD", 1 << 18)
    n, replicates = 2010, 2000
    rows = spark.createDataFrame([(f"{i:05}", i % 3, float(i)) for i in range(n)], "query_id string, g int, x double")
    start = time.time()
    got = {(r["rep"], r["g"]): (r["t"], r["x"]) for r in bootstrap.drawn_sums(rows, ["g"], ["x"], replicates).groupBy("rep", "g").agg({"times": "sum", "x": "sum"}).toDF("rep", "g", "t", "x").collect()}
    assert time.time() - start < 45 and len(got) == 3 * (replicates + 1)
    for rep in (0, 249, 250, 1999):
        drawn = [int(i) for some in bootstrap.drawn(bootstrap.SEED, rep, n) for i in some]
        for g in range(3):
            assert sorted(got[rep, g]) == sorted((float(sum(i % 3 == g for i in drawn)), float(sum(i for i in drawn if i % 3 == g))))


def test_pairs_and_cells_draw_once(spark):
    rows = spark.createDataFrame([(p, f"{i}", c) for p in ("p0", "p1", "p2") for i, c in ((1, "SMART"), (2, "NOOP"))], "provider_id string, query_id string, cell string")
    rows = rows.selectExpr("*", *[f"1L AS {v}" for v in bootstrap.VALUES])
    for found in (bootstrap.differences(rows, 10), bootstrap.cell_rates(rows, 10)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("FlatMapCoGroupsInArrow") == 1

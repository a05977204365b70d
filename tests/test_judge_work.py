"""What the judge's records rest on: how often traces are made, whose fetches a result sees, and blanks at both ends of a text."""

import glob
import gzip
import json
import random
import sys

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracelens import schema
from tracelens.functions import text as T
from tracelens.operators import judge as J
from tracelens.plans import catalog, surrogates


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_traces_are_made_once(spark, sf_dir):
    for name in ("judge_record_build", "judge_messages"):
        plan = _plan(catalog.queries()[name](spark, sf_dir))
        assert plan.count("collect_list") == 1 and plan.count("Join") == 1, name


def _trace(spark, *rows):
    return spark.createDataFrame([tuple(r.get(f, None) for f in ("trace_id", "retrievals", "fetches")) for r in rows], ", ".join(f"{n} {k}" for n, k in (("trace_id", "string"), ("retrievals", f"array<{schema.RETRIEVAL}>"), ("fetches", f"array<{schema.FETCH}>")))).withColumns({c: F.lit("x") for c in ("provider_id", "query_id", "question", "gold_answer", "final_answer")})


def test_the_fetch_that_counts(spark):
    result = lambda d, rank, url: {"document_id": d, "rank": rank, "url": url, "page_fetch": {"fetch_status": "success", "extracted_text": "own"}}
    fetch = lambda i, d, rank, url, status="success", turn=1, search="r": {"fetch_id": i, "source_document_id": d, "source_rank": rank, "url": url, "iteration_num": turn, "source_retrieval_id": search, "page_fetch": {"fetch_status": status, "extracted_text": f"page {i} {turn}"}}
    found = [result("a", 1, "u"), result("b", 2, "v"), result("c", 3, "w"), result(None, 4, "z"), result("e", 5, None), result("f", 6, "y")]
    search = {"retrieval_id": "r", "retrieval_index": 2, "search_query": "q", "search_response": {"results": found}}
    fetches = [
        fetch("f1", "a", 9, "x", "failed", 3), fetch("f2", "a", 9, "x", "success", 4), fetch("f2", "a", 9, "x", "success", 5), fetch("f3", "x", 1, "u", "success", 0), fetch("f4", "s2r2", 9, "x", "failed"), fetch("f5", "x", 9, "v"), fetch("f6", "x", 3, "x"), fetch("f7", "x", 9, "w", turn=0),
        fetch("f8", "", 4, "z"), fetch("f9", "f", 6, "y", search="other"), fetch(None, "e", 9, None),
    ]
    traces = _trace(spark, {"trace_id": "t", "retrievals": [search], "fetches": fetches}, {"trace_id": "u", "retrievals": [search], "fetches": None}, {"trace_id": "t", "retrievals": [search], "fetches": []}, {"trace_id": "v", "retrievals": None, "fetches": fetches}, {"trace_id": "w", "retrievals": [{"retrieval_id": "r"}], "fetches": fetches})
    rows = J.judge_records(traces).collect()
    got = [(r["rank"], r["fetch_id"], r["page_fetch"]["extracted_text"], r["page_fetch_source"]) for r in rows]
    own = [(i, None, "own", "search_result_auto_fetch") for i in range(1, 7)]
    tool = lambda i, f, turn=1: (i, f, f"page {f or None} {turn}", "fetch_tool")
    # Two fetches of one name give one record, and one without a name gives its page.
    assert got[:6] == [tool(1, "f2", 4), tool(2, "f4"), tool(3, "f7", 0), own[3], tool(5, ""), own[5]]
    assert got[6:] == own * 2 and [r["trace_id"] for r in rows] == ["t"] * 6 + ["u"] * 6 + ["t"] * 6


def test_strip_takes_all_blanks(spark):
    chars = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and (i < 0x3100 or i % 61 == 0)]
    texts = [f"{c}{c}a{c}b {c}" for c in chars] + ["", " \t", "é ", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["s"] for r in rows.select("i", T.strip(F.col("t")).alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == [t if t is None else t.strip() for t in texts]


def _exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_lines_of_reuse_are_shuffled_once(spark, sf_dir):
    lines = surrogates.sequenced_lines(spark, sf_dir, of_orders=False)
    classed = J.reuse_classes(surrogates.as_records(lines, *surrogates.LINE)).select(*lines.columns, "reuse_key", "reuse_class")
    found = surrogates.as_records(classed, "reuse_key", "reuse_class")
    assert len(_exchanges(found)) == 1 and "Join" not in _plan(found)
    # Records are made whole after the windows: nothing wide is shuffled or sorted.
    assert "kimi" not in _plan(found).split("Window")[1] and "judgment" not in _plan(found).split("Window")[1]


def test_lines_of_reuse_stay_for_the_join(spark, sf_dir):
    """With orders too many to be sent to all tasks, their keys go to where the lines are."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        query = catalog.queries()["judge_reuse_classes"](spark, sf_dir)
        # The lines, the orders' keys, and the counts.
        assert len(_exchanges(query)) == 3 and _plan(query).count("Join") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def _classes(records, cache):
    """reuse_class of each record by its place, one after the other in the order of seq."""
    key = lambda r: (r["query_id"], r["url"], "s") if r["query_id"] and r["url"] and r["judge_surface_class"] == "snippet_only" else None
    members = ["provider_id", "query_id", "retrieval_id", "rank", "url"]
    known, made, out = {}, set(), {}
    for r in sorted((r for r in cache if r["judgment"] and all(r[m] for m in members if m != "rank")), key=lambda r: r["seq"]):
        known[tuple(r[m] for m in members)] = r["messages"][0]["content"]
        made.add(key(r))
    made.discard(None)
    for r in sorted(records, key=lambda r: r["seq"]):
        hit = r["rank"] is not None and known.get(tuple(r[m] for m in members)) == r["messages"][0]["content"]
        out[r["document_id"]] = "exact_cache" if hit else "duplicate" if key(r) in made else "fresh"
        if key(r):
            made.add(key(r))
    return out


def test_classes_are_those_of_a_run_in_order(spark):
    draw = random.Random(4)
    pick = lambda *of: draw.choice(of)
    one = lambda i, seq: {"schema_version": schema.JUDGE_VERSION, "document_id": str(i), "seq": seq, "provider_id": pick("p", "p", "o", None), "query_id": pick("q", "r", "r", "", None), "retrieval_id": pick("i", "i", None), "rank": pick(1, 2, None), "url": pick("https://a.example", "https://b.example", None), "judge_surface_class": pick("snippet_only", "page_visible"), "judgment": pick({}, {"is_garbage": True}, None), "messages": [{"role": "user", "content": pick("x", "y")}]}
    order = draw.sample(range(1000), 600)
    rows = [one(i, s) for i, s in enumerate(order)]
    frame = lambda of: spark.createDataFrame([(json.dumps(r),) for r in of], "j string").select(F.from_json("j", schema.JUDGE).alias("j")).select("j.*").repartition(5)
    records, early = frame(rows[:400]), frame(rows[400:])
    got = lambda df: {r["document_id"]: r["reuse_class"] for r in df.collect()}
    for r in rows:
        r["judgment"] = r["judgment"] is not None
    assert got(J.reuse_classes(records, early)) == _classes(rows[:400], rows[400:])
    assert got(J.reuse_classes(records)) == got(J.reuse_classes(records, early.limit(0))) == _classes(rows[:400], [])
    own = J.reuse_classes(records, F.col("seq") % 3 == 0)
    assert got(own) == got(J.reuse_classes(records, records.filter("seq % 3 = 0"))) == _classes(rows[:400], [r for r in rows[:400] if r["seq"] % 3 == 0])
    assert set(got(own).values()) == {"exact_cache", "duplicate", "fresh"} and own.columns == [*records.columns, "reuse_key", "reuse_class"]
    # A cached row of a wider rank, and records that share a seq: each stays one.
    twice = records.unionByName(records)
    assert J.reuse_classes(twice, early.withColumn("rank", F.col("rank").cast("long"))).schema["rank"] == records.schema["rank"]
    assert J.reuse_classes(twice, F.lit(True)).count() == 800


@pytest.mark.parametrize("name", ["judge_run_stats", "judge_reuse_classes"])
def test_lines_against_sql(spark, tmp_path, name):
    """Lines that share order, number and part, lines of no order or of one that stands twice, and parts that reach into the next line's numbers."""
    draw = random.Random(9)
    rows = [(draw.choice([1, 1, 2, 3, 5, 6, 7]), draw.randint(1, 3), draw.choice([1, 2, 5, 7, 13, 21, 79, 83, 89, 97, 1_000_001, 1_000_002]), draw.randint(1, 9), float(draw.randint(1, 50)), draw.choice([0.01, 0.09]), 0.07, *draw.choice([("A", "F"), ("N", "O"), ("R", "F"), ("N", "F")])) for _ in range(900)]
    pq.write_table(pa.table(dict(zip(surrogates.LINE, map(list, zip(*rows))))), f"{tmp_path}/lineitem.parquet")
    pq.write_table(pa.table({"o_orderkey": [1, 2, 3, 5, 5, 8], "o_custkey": [1, 1, 2, 3, 4, 5]}), f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    df = catalog.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_records_of_a_run_are_whole(spark, sf_dir, tmp_path, monkeypatch):
    from tracelens.plans import io_queries

    monkeypatch.setattr(io_queries, "scratch", lambda _: str(tmp_path / "run"))
    stats = io_queries.judge_run_stats(spark, sf_dir).first()
    lines = [json.loads(x) for f in glob.glob(f"{tmp_path}/run/part-*") for x in gzip.open(f, "rt")]
    rows = surrogates.judge_rows(spark, sf_dir)
    want = sorted(json.dumps(json.loads(r[0]), sort_keys=True) for r in rows.select(F.to_json(F.struct(*[c for c in rows.columns if c != "seq"]), {"ignoreNullFields": "false"})).collect())
    own = {"seq", "reuse_key", "reuse_class"}
    assert sorted(json.dumps({k: v for k, v in x.items() if k not in own}, sort_keys=True) for x in lines) == want
    assert len({x["seq"] for x in lines}) == len(lines) == stats["written"] and all(own < set(x) for x in lines)
    assert sum(x["reuse_class"] == "fresh" for x in lines) == stats["fresh"]

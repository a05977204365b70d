"""Operators of the trace analytics: every query against its oracle, and small cases with expectations of their own."""

import difflib
import gzip
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tracelens import schema
from tracelens.functions import html as H
from tracelens.functions import render
from tracelens.functions import text as T
from tracelens.operators import automaton, bootstrap, judge, quantiles, sampling, search, support, traces, validation
from tracelens.operators import relational as R
from tracelens.plans import catalog
from tracelens.sources import jsonl, providers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def text(x):
    return F.lit(x).cast("string")


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in catalog.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_its_oracle(spark, sf_dir, con, name):
    norm = lambda v: None if v is None else round(float(v), 5) if isinstance(v, float) or hasattr(v, "as_tuple") else v
    rows, sql = catalog.queries()[name](spark, sf_dir), catalog.oracle_sql()[name]
    names = sorted(rows.columns)
    ours = sorted((tuple(norm(x) for x in r) for r in rows.select(*names).collect()), key=repr)
    columns = ",".join(f'"{c}"' for c in names)
    theirs = sorted((tuple(norm(x) for x in r) for r in con.sql(f"SELECT {columns} FROM ({sql})").fetchall()), key=repr)
    assert sorted(con.sql(sql).columns) == names and ours == theirs


@pytest.mark.parametrize("said, expected", [("E.U.A", "eu"), ("Forty-Seven", "fortyseven"), ("seven eleven", "7 11"), ("An Old Mill, the", "old mill"), ("New Delhi city", "new delhi city"), (None, "")])
def test_normalize_answer(spark, said, expected):
    assert one(spark, T.normalize_answer(text(said))) == expected


def test_grades(spark):
    assert one(spark, T.exact_match(text("An old mill!"), text("old   mill")))
    assert one(spark, T.token_f1(text("red red wine"), text("red wine glass"))) == pytest.approx(2 * 2 / 6)
    assert one(spark, T.token_f1(text("an"), text("the"))) == 1.0 and one(spark, T.token_f1(text("x"), text(""))) == 0.0
    assert one(spark, T.answer_in_text(text("7"), text("2,578"))) and not one(spark, T.answer_in_text(text(""), text("x"))) and not one(spark, T.answer_in_text(text("x"), text(None)))


@pytest.mark.parametrize("url, expected", [
    ("HTTPS://WWW.Shop.example/a/?utm_medium=m&b=2&gclid=1#top", "https://www.shop.example/a/?b=2"),
    ("shop.example/a/", "shop.example/a"),
    ("http://s.example/?q=a b&c", "http://s.example/?q=a+b&c="),
    ("http://s.example/x?q=%7Eme%2f*", "http://s.example/x?q=~me%2F%2A"),
    ("http://s.example/x?q=100%", "http://s.example/x?q=100%25"),
    ("", ""),
])
def test_normalize_url(spark, url, expected):
    assert one(spark, T.normalize_url(text(url))) == expected


def test_url_families(spark):
    assert one(spark, T.source_family(text("https://de.wikipedia.org/wiki/M%C3%BChle"))) == "de.wikipedia.org/wiki/m%c3%bchle"
    assert one(spark, T.source_family(text("https://www.a.example/B/c/d"))) == "a.example/b/c" and one(spark, T.source_family(text("nohost/x"))) == ""
    assert one(spark, T.root_domain(text("http://me@www.a.example:81/x"))) == "me@www.a.example:81"


def test_answers_and_cuts(spark):
    for said, answer, given in [("so\nFinal answer:  12   May", "12 May", True), ("just words", "just words", False), ("FINAL ANSWER: Unable to find it", "Unable to find it", False), (None, "", False)]:
        assert one(spark, T.final_answer(text(said))) == answer and one(spark, T.answered(text(said))) is given
    assert one(spark, T.truncate(text("ab  cd ef"), 6)) == "ab cd..." and one(spark, T.estimate_tokens(text("abc"))) == 1
    long = " ".join(f"word{i}" for i in range(90))
    fitted = one(spark, T.fit_query(text(long), 40, 100))
    assert len(fitted) <= 100 and long.startswith(fitted + " ")
    x = one(spark, T.excerpt_around(text("0123456789" * 5), F.array(F.lit("zz"), F.lit("789")), 11))
    assert (x["start"], x["end"], x["truncated"]) == (3, 14, True) and x["text"] == ("0123456789" * 5)[3:14]


def test_json_of_models(spark):
    shown = lambda s: one(spark, F.try_variant_get(T.parse_json_object(text(s)), "$.a", "int"))
    assert [shown(s) for s in ('{"a": 4}', '```json\n{"a": 4}\n```', 'well {"a": 4} so', "", "none")] == [4, 4, 4, None, None]
    digest = one(spark, T.hash_json(b=text(None), a=F.lit("é")))
    import hashlib

    assert digest == hashlib.sha256(json.dumps({"a": "é", "b": None}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_wilson(spark):
    assert [one(spark, x) for x in T.wilson(F.lit(8), F.lit(10))] == [49, 94] and [one(spark, x) for x in T.wilson(F.lit(0), F.lit(0))] == [0, 0]


def test_relational(spark):
    rows = spark.createDataFrame([("q1", 1, True), ("q1", 2, False), ("q2", 3, True), (None, 4, True)], "q string, line int, failed boolean")
    assert {r["q"]: r["failed"] for r in R.latest_by_key(rows, ["q"], "line").collect()} == {"q1": False, "q2": True}
    assert R.resume(rows, rows.filter("failed AND q IS NOT NULL"), ["q"]).count() == 1
    assert sorted(r["reuse_class"] for r in R.first_writer(rows.union(rows), F.col("q"), ["line"]).collect()) == ["duplicate"] * 4 + ["fresh"] * 2 + ["unkeyed"] * 2


PAGE = {"fetch_status": "success", "extractor": "reader", "extracted_text_chars": 60_000, "extracted_text": "In 1912 the mill in Nantes burned."}


def trace(**more):
    found = {"rank": 3, "url": "https://mill.example/story?utm_source=n", "snippet": "The mill in Nantes", "domain": "mill.example", "provider_metadata": json.dumps({"extra_snippets": ["It burned in 1912"], "age": "", "score": 1})}
    base = {"trace_id": "t", "query_id": "q", "provider_id": "p", "gold_answer": "1912", "gold_urls": ["https://mill.example/story"], "final_answer": "1913", "answered": True, "total_search_calls": 1, "retrievals": [{"search_query": "mill fire", "search_response": {"results": [found]}}]}
    return base | more


def rows_of(spark, *traces_):
    lines = [json.dumps(t) for t in traces_]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines, 1)], "line_num long, line string")
    return df.select("line_num", F.from_json("line", schema.TRACE).alias("t")).select("t.*", "line_num")


def test_metrics_of_a_trace(spark):
    tool = {"fetch_id": "f", "source_rank": 4, "url": "https://mill.example/story", "page_fetch": PAGE}
    empty = {"trace_id": "e", "query_id": "x", "provider_id": "p"}
    got = {r["trace_id"]: r for r in traces.per_trace_metrics(rows_of(spark, trace(), trace(trace_id="f", fetches=[tool]), empty)).collect()}
    t, f, e = got["t"], got["f"], got["e"]
    assert t["gold_url_exact_hit"] and t["gold_url_prefix_hit"] and t["answer_in_extra_snippets"] and not t["answer_in_snippet"] and t["wrong_with_answer_text_available"]
    assert t["provider_metadata_field_counts"] == {"extra_snippets": 1, "score": 1} and t["reformulation_rate"] is None and t["first_answer_page_rank"] is None
    assert f["answer_in_page"] and f["first_answer_page_rank"] == 4 and f["answer_page_mrr"] == 0.25 and f["fetch_status_counts"] == {"success": 1} and f["large_extract_50k_count"] == 1
    assert e["exact_match"] and not e["answered"] and e["abstained"] and e["result_count"] == 0 and e["snippet_chars_median"] == 0 and e["fetch_status_counts"] == {}
    v1 = {r["trace_id"]: r for r in traces.trace_metrics(rows_of(spark, trace(), trace(trace_id="g", gold_urls=["http://other.example"]))).collect()}
    assert v1["t"]["failure_mode"] == "reasoning_failure" and v1["g"]["failure_mode"] == "retrieval_failure" and v1["t"]["premature_termination"]


def test_hit_ranks_follow_the_searches(spark):
    hit = lambda rank: {"rank": rank, "snippet": "it was 1912"}
    t = trace(retrievals=[{"search_response": {"results": [hit(0), hit(6)]}}, {"search_response": {"results": [hit(1)]}}])
    assert traces.per_trace_metrics(rows_of(spark, t)).first()["first_answer_snippet_rank"] == 6
    empty_gold = traces.per_trace_metrics(rows_of(spark, trace(gold_urls=[""]))).first()
    assert empty_gold["gold_url_prefix_hit"] and not empty_gold["gold_url_exact_hit"]


def test_reliability(spark):
    r = traces.reliability(rows_of(spark, trace(failed=True), trace(), trace(query_id="r", failed=True), trace(query_id=None))).first()
    assert (r["trace_rows"], r["historical_failed_rows"], r["latest_failed_queries"], r["transient_failures_recovered"], r["latest_queries"]) == (4, 2, 1, 1, 2)


def test_reformulation_rate(spark, sf_dir):
    got = {r["conv_id"]: r["rate"] for r in catalog.queries()["reformulation_rate"](spark, sf_dir).collect()}
    chats = {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("role = 'user'").collect(), key=lambda r: (r["conv_id"], r["turn"], r["text"] or "")):
        chats.setdefault(r["conv_id"], []).append((r["text"] or "").lower())
    for c, q in chats.items():
        want = None if len(q) < 2 else sum(difflib.SequenceMatcher(None, a, b).ratio() < 0.7 for a, b in zip(q, q[1:])) / (len(q) - 1)
        assert got[c] == (want if want is None else pytest.approx(want))


def test_judge_surfaces_and_reuse(spark):
    base = {"schema_version": schema.JUDGE_VERSION, "provider_id": "p", "query_id": "q", "retrieval_id": "r", "rank": 1, "url": "http://a.example/x?utm_term=1", "judgment": {"contains_gold_answer": True}}
    rows = [base | {"seq": 1}, base | {"seq": 2, "rank": 3, "provider_id": "o", "url": "http://a.example/x"}, base | {"seq": 3, "page_fetch_source": "fetch_tool"}, base | {"seq": 4, "judgment_parse_error": "x"}, base | {"seq": 5, "retrieval_id": None}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", schema.JUDGE).alias("j")).select("j.*")
    got = {r["seq"]: r for r in df.select("seq", judge.valid().alias("v"), judge.valid(True).alias("rv"), judge.inferred_surface().alias("s"), judge.reuse_key().alias("k")).collect()}
    assert [got[i]["v"] for i in range(1, 6)] == [True, True, True, False, True] and not got[5]["rv"]
    assert got[1]["k"] == got[2]["k"] and got[3]["s"] == "page_visible" and got[3]["k"] is None and got[1]["s"] == "snippet_only"
    classes = {r["seq"]: r["reuse_class"] for r in judge.reuse_classes(df, df.filter("seq = 99")).collect()}
    assert classes == {1: "fresh", 2: "duplicate", 3: "fresh", 4: "duplicate", 5: "duplicate"}
    assert judge.exact_cache(df.filter("seq = 1"), df.filter("seq IN (1, 4)")).count() == 1


def test_judge_records(spark):
    tool = {"fetch_id": "f", "source_retrieval_id": "r1", "source_document_id": "s1r3", "source_rank": 3, "url": "https://mill.example/story", "page_fetch": PAGE}
    t = trace(fetches=[tool])
    t["retrievals"][0] |= {"retrieval_id": "r1"}
    t["retrievals"][0]["search_response"]["results"][0] |= {"document_id": "s1r3"}
    r = judge.judge_records(rows_of(spark, t)).first()
    assert r["page_fetch_source"] == "fetch_tool" and r["model_fetched_document"] and r["judge_surface_class"] == "page_visible" and r["document_id"] == "q::p::r1::r3" and not r["document_garbage_precheck"]["is_garbage"]


def test_render(spark):
    assert one(spark, render.escape(text("a<'b'&\"c\">"))) == "a&lt;&#x27;b&#x27;&amp;&quot;c&quot;&gt;"
    assert one(spark, render.fill(" {{ a }} {{{a}}} {{ none }}x", {"a": text("<")})) == "&lt; <  x".replace("  x", " x")


def test_entities_and_binary_bodies(spark):
    import html

    texts = ["&amp;amp;lt;", "a &lt;b&gt; &quot;c&quot; &apos; &nbsp;|", "&#65;&#x1F600;&#xE9;", "&#128;&#150;&#0;&#xD800;&#x110000;", "&nope; & &; &#; &#x;", "", "&copy;&euro;&Alpha;&alpha;", "x&amp;#38;lt;y"]
    bodies = [b"\x00a", b"", None, b"plain text\n\t", bytes(range(1, 32)) * 3, "é".encode() * 300, b"\xff\xfe" + b"a" * 50, b"a" * 4096 + b"\x00", b"a" * 4000 + b"\x01" * 2000]
    plain = set(range(32, 127)) | set(b"\n\r\t\b\f")

    def brute(body):
        head, shown = (body or b"")[:4096], (body or b"").decode("utf-8", "replace")[:4096]
        return bool(head) and (0 in head or sum(b not in plain for b in head) / len(head) > 0.30 or shown.count("\ufffd") / len(shown) > 0.02)

    def thrice(t):
        return html.unescape(html.unescape(html.unescape(t)))

    rows = spark.createDataFrame([(t, bodies[i % len(bodies)]) for i, t in enumerate([*texts, ""])], "t string, b binary")
    got = rows.select("t", H.unescaped(F.col("t")).alias("u"), "b", H.looks_binary(F.col("b")).alias("is")).collect()
    assert [r["u"] for r in got] == [thrice(r["t"]) for r in got]
    assert [r["is"] for r in got] == [brute(None if r["b"] is None else bytes(r["b"])) for r in got]


def test_payloads(spark):
    body = json.dumps({"data": [{"metadata": {"title": "Old", "description": "Told", "url": "http://a.example"}}, "junk", {"url": "http://b.example", "title": "T", "content": "C"}]})
    got = providers.parse(spark.createDataFrame([(1, body), (2, "not json")], "i int, payload string"), "firecrawl").collect()
    assert [(r["rank"], r["title"], r["snippet"], r["domain"]) for r in got] == [(1, "Old", "Told", "a.example"), (2, "T", "C", "b.example")]


def test_jsonl_sources(spark, tmp_path):
    (tmp_path / "brave_run.jsonl").write_text('{"q": "a"}\n\n{"q": "b", "provider_id": ""}\n')
    (tmp_path / "bad.jsonl").write_text('{"q": "a"}\n{broken\n')
    rows = jsonl.read_jsonl(spark, str(tmp_path / "brave_run.jsonl"), "q string, provider_id string")
    assert [(r["q"], r["line_num"]) for r in rows.orderBy("line_num").collect()] == [("a", 1), ("b", 3)]
    assert jsonl.provider_label(rows).first()["provider"] == "brave" and jsonl.line(rows, 3).first()["q"] == "b"
    with pytest.raises(Exception, match="bad JSON in line 2"):
        jsonl.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "q string").collect()
    assert jsonl.read_tolerant(spark, str(tmp_path / "bad.jsonl"), "q string", F.col("q") == "a").first()["cache_source_line_num"] == 1


def test_a_file_in_many_splits_keeps_its_line_numbers(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("".join(json.dumps({"i": i}) + "\n" for i in range(1, 3001)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = jsonl.read_jsonl(spark, str(tmp_path / "x.jsonl"), "i long")
        assert rows.filter("i <> line_num").count() == 0 and rows.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_other_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"queries": [{"query_id": "x"}, {"query_id": "y"}]}, indent=1))
    assert jsonl.read_array(spark, str(tmp_path / "a.json"), "queries", "query_id STRING").count() == 2
    (tmp_path / "s.tsv").write_text("provider\tquery_id\tem\tsemantic_match\nA\tq1\t0\t1\nA\tq2\t1\t0\n")
    assert [(r["provider_id"], r["correct"]) for r in jsonl.read_semantic(spark, str(tmp_path / "s.tsv"), 2).orderBy("query_id").collect()] == [("a", True), ("a", False)]
    with pytest.raises(ValueError):
        jsonl.read_semantic(spark, str(tmp_path / "s.tsv"), 3)
    (tmp_path / "p.json").write_text('{"c1": {"human_value": "true"}}')
    assert jsonl.read_progress(spark, str(tmp_path / "p.json")).first()["human_value"] == "true"
    (tmp_path / "l.txt").write_text(jsonl.POINTER + "\noid x\n")
    assert jsonl.pointers(spark, str(tmp_path / "l.txt")).count() == 1 and jsonl.settings("# no\nA='b'\n") == {"A": "b"}
    rows = spark.createDataFrame([("http://a.example/", None, [1]), ("http://a.example", None, [2])], "url string, b string, a array<int>")
    sinks.append_jsonl(rows.limit(1), str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).first()[0] == '{"a":[1],"b":null,"url":"http://a.example/"}'
    sinks.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["a", "b", "url"]
    sinks.write_artifacts(rows.select("url", F.lit("{}").alias("extraction")), str(tmp_path / "art"))
    files = list((tmp_path / "art").rglob("*.gz"))
    assert len(files) == 1 and json.loads(gzip.open(files[0]).read())["url"].startswith("http://a.example")
    table = sinks.pivot(spark.createDataFrame([("x", "u", 1), ("y", "v", 2)], "a string, b string, n int"), "a", "b", F.col("n"))
    assert sinks.markdown(table) == "| a | u | v |\n| --- | --- | --- |\n| x | 1 | -- |\n| y | -- | 2 |\n"


def test_sampling(spark):
    cells = spark.createDataFrame([("a", 1), ("b", 5), ("c", 4)], "k string, n long")
    assert {r["k"]: r["taken"] for r in sampling.apportion(cells, ["k"], 9).collect()} == {"a": 1, "b": 4, "c": 4}
    assert sum(r["taken"] for r in sampling.apportion(cells, ["k"], 10).collect()) == 10
    with pytest.raises(ValueError):
        sampling.apportion(cells, ["k"], 11)


def test_support_checks_raise(spark):
    rows = spark.createDataFrame([("p", "q", True, True, True, "SMART")], "provider_id string, query_id string, pre_support boolean, post_discovered boolean, trajectory boolean, cell string")
    with pytest.raises(Exception, match="disjoint is broken"):
        support.assert_checks(support.checks(rows)).collect()


def test_bootstrap_draws_with_replacement(spark, monkeypatch):
    """Sums of some blocks and tasks against draws one by one."""
    import hashlib

    monkeypatch.setattr(bootstrap, "BLOCK", 4)
    monkeypatch.setattr(bootstrap, "CHUNK", 2)
    monkeypatch.setattr(bootstrap, "DIGESTS", 1)
    rows = [(f"q{i}", g, float(i * k)) for i in range(11) for k, g in ((1, "a"), (10, "b"), (7, "b")) if i % k == 0 or g == "a"]
    got = bootstrap.drawn_sums(spark.createDataFrame(rows, "query_id string, g string, x double"), ["g"], ["x"], 3).groupBy("rep", "g").agg(F.sum("times").alias("n"), F.sum("x").alias("x"))
    got = {(r["rep"], r["g"]): (r["n"], r["x"]) for r in got.collect()}
    names = sorted({q for q, _, _ in rows})
    for rep in range(-1, 3):
        digests = [hashlib.md5(f"{bootstrap.SEED}:{rep}:{j}".encode()).hexdigest() for j in range(3)]
        picks = [int(h[8 * k : 8 * k + 8], 16) % 11 for h in digests for k in range(4)][:11] if rep >= 0 else range(11)
        for g in "ab":
            drawn = [x for p in picks for q, of, x in rows if q == names[p] and of == g]
            assert got.get((rep, g), (0, 0)) == (len(drawn), sum(drawn))
    assert len(list(bootstrap.drawn(bootstrap.SEED, 0, 11))) == 3


#: Whether the answers to a hundred questions, in order, are right, and the intervals that were published for them.
RIGHT = {
    "brave": "0011101000010100001001010010000100111001000110100001000001010010000000100000000001100000000000000000",
    "tavily": "0001101000010000011010010010000000111001101010001001000000010000100100010001000000000001001000000000",
    "firecrawl": "0000101000010001001001000010000100101011100110111001100000000000000000010010000000000000001010100001",
}
PUBLISHED = {"brave": (25, 17, 34), "tavily": (25, 17, 34), "firecrawl": (26, 18, 35)}


def test_intervals_of_draws_in_sequence_are_the_published_ones(spark, monkeypatch):
    import random

    monkeypatch.setattr(bootstrap, "WORDS", 1000)
    rows = spark.createDataFrame([(p, f"q{i:03}", int(flag)) for p, flags in RIGHT.items() for i, flag in enumerate(flags)], "provider_id string, query_id string, correct long")
    for v in bootstrap.VALUES:
        rows = rows.withColumn(v, F.col("correct"))
    got = bootstrap.intervals(rows, in_sequence=True).filter("metric = 'correct'").collect()
    assert {r["provider_id"]: (r["estimate"], r["low"], r["high"]) for r in got} == PUBLISHED
    rng = random.Random(7)
    want = [sum(int(RIGHT["brave"][rng.randrange(100)]) for _ in range(100)) for _ in range(600)]
    sums = bootstrap.drawn_sums(rows.filter("provider_id = 'brave'"), [], ["correct"], 600, 7, True).filter("rep >= 0").orderBy("rep").collect()
    assert [r["correct"] for r in sums] == want


@pytest.mark.parametrize("piece", [3, 2048])
def test_automaton_finds_what_texts_hold(spark, monkeypatch, piece):
    import random

    rng = random.Random(piece)
    monkeypatch.setattr(automaton, "PIECE", piece)
    monkeypatch.setattr(automaton, "BLOCK_BYTES", 40)
    letters = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    patterns = [(i, i % 2, letters(rng.randint(0, 7))) for i in range(60)]
    texts = [(j, letters(rng.randint(0, 60)), letters(rng.randint(0, 60))) for j in range(30)] + [(30, None, ""), (31, "", None)]
    got = automaton.found_in(spark.createDataFrame(patterns, "id long, form int, pattern string"), spark.createDataFrame(texts, "text_id long, x string, y string"), ["x", "y"])
    want = {(i, j) for i, form, p in patterns for j, *t in texts if p and p in (t[form] or "")}
    rows = [(r["id"], r["text_id"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert automaton.blocks(spark.createDataFrame(patterns, "id long, form int, pattern string")).select("block").distinct().count() > 3


def test_quantiles_of_hot_groups(spark):
    """One group with all rows, narrowed over values of very unlike sizes, against Spark's own percentile."""
    import numpy as np

    rng = np.random.default_rng(2)
    values = [*rng.exponential(1e3, 900), *rng.normal(0, 1e-9, 300), *[1e300, -1e300, 0.0, 7.0] * 30]
    wanted = {"a": ("x", 0.5, "linear"), "b": ("x", 0.9, "nearest"), "c": ("y", 0.025, "linear"), "d": ("x", 0.0, "linear"), "e": ("y", 1.0, "nearest")}
    for groups in (["g"], ["all", "few", None]):
        rows = spark.createDataFrame([(groups[i % len(groups)], None if i % 11 == 0 else float(v), float(i % 5)) for i, v in enumerate(values)], "g string, x double, y double")
        exact = rows.groupBy("g").agg(F.percentile("x", 0.5).alias("a"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY x)").alias("b"), F.percentile("y", 0.025).alias("c"), F.min("x").alias("d"), F.max("y").alias("e"))
        for few in (50, 10_000):
            got = quantiles.quantiles(rows, ["g"], wanted, few=few)
            assert sorted(map(repr, got.collect())) == sorted(map(repr, exact.collect()))


def test_containment_and_pages(spark):
    golds = spark.createDataFrame([(1, "seven"), (2, "old red mill"), (3, "the"), (4, None)], "g int, text string")
    texts = spark.createDataFrame([(1, "An old, red mill"), (2, "seventeen"), (3, None), (4, "bold red millstone, 7")], "t int, text string")
    assert {(r["g"], r["t"]) for r in search.containment(golds, texts, "g", "t").collect()} == {(2, 1), (2, 4), (1, 2), (1, 4)}
    got = search.page(texts, ["t"], 2, 3).collect()
    assert [r["t"] for r in got] == [4] and not got[0]["has_more"]
    assert validation.merge_labels(golds.withColumnRenamed("g", "case_id"), spark.createDataFrame([(1, "true")], "case_id int, human_value string")).filter("human_value = 'true'").count() == 1


def test_streams(spark, tmp_path):
    from tracelens.streaming import traces as S

    (tmp_path / "in").mkdir()
    kind = "k string, at timestamp, v int"
    for i, rows in enumerate([[("a", 1), ("b", 2)], [("a", 3)]]):
        (tmp_path / "in" / f"{i}.json").write_text("".join(json.dumps({"k": k, "at": f"2026-01-01T00:00:0{v}Z", "v": v}) + "\n" for k, v in rows))
        S.keep_latest(spark, str(tmp_path / "in"), kind, ["k"], "v", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {r["k"]: r["v"] for r in spark.read.parquet(str(tmp_path / "out" / "version=1")).collect()} == {"a": 3, "b": 2}
    q = S.first_rows(spark, str(tmp_path / "in"), kind, ["k"], "at").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination(120)
    assert sorted(r["k"] for r in spark.sql("SELECT k FROM firsts").collect()) == ["a", "b"]


def test_query_states_fill_every_cell(spark):
    rows = catalog.queries()["decision_partition"](spark, "/root/testdata/sf0.01").collect()
    assert {r["cell"] for r in rows if r["queries"]} == {"SMART", "MISSED", "BLIND", "NOOP"}

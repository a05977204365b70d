"""Templates, the judge's messages, and the artifact store."""

import gzip
import json
import re

import pytest
from pyspark.sql import functions as F

from tracelens.functions import render
from tracelens.functions import templates as TP
from tracelens.functions import text as T
from tracelens.operators import judge
from tracelens.sources import jsonl, sinks


def brute(nodes, scope):
    """A parsed template over plain Python values."""

    def at(path):
        value = scope
        for p in path:
            value = value.get(p) if isinstance(value, dict) else None
        return value

    out = ""
    for n in nodes:
        if isinstance(n, str):
            out += n
        elif isinstance(n, TP.Loop):
            out += "".join(brute(n.body, {**scope, n.item: x}).strip() for x in at(n.path) or [])
        else:
            v = "" if at(n.path) is None else str(at(n.path))
            out += v if n.raw else v.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#x27;")
    return out


SCOPE = "a string, n int, on boolean, s struct<x:string,deep:struct<y:double>>, m map<string,string>, xs array<struct<k:string,ys:array<int>>>"


@pytest.mark.parametrize("template", [
    " {{ a }}|{{{ a }}}|{{ n }}|{{ on }}|{{ none }}|{{ s.x }}|{{ s.deep.y }}|{{ s.none.y }}|{{ a.b }} ",
    "{% for x in xs %} [{{ x.k }}{% for y in x.ys %} ({{ y }}{{{ a }}}{{ x.k }}){% endfor %}] {% endfor %}end",
    "{% for y in none %}{{ y }}{% endfor %}{% for s in xs %}{{ s.k }}{% endfor %}{{ s.x }}",
    '{% include "one" %} and {% include "two" %}',
    "no marks { } % {{ a }}",
])
def test_templates_match_a_plain_reading(spark, template):
    includes = {"one": "<{{ a }}>", "two": '{% for x in xs %}{% include "one" %}{% endfor %}'}
    rows = [
        ("it's <b>", 3, True, ("&", (1.5,)), {"q": "v"}, [("k1", [1, 2]), (None, []), ("{{ a }}", None)]),
        (None, None, None, None, None, None),
        ("", 0, False, (None, None), {}, []),
    ]
    df = spark.createDataFrame(rows, SCOPE)
    got = [r["t"] for r in df.select(TP.render(template, TP.scope_of(df), includes).alias("t")).collect()]
    want = [brute(TP.parse(template, includes), r.asDict(recursive=True)).strip() for r in df.collect()]
    assert got == want


@pytest.mark.parametrize("template, message", [
    ("{% for x in xs %}", "not closed"), ("{% endfor %}", "not understood"), ("{% if x %}", "not understood"), ('{% include "none" %}', "none"), ('{% include "loop" %}', "loop"), ("{% for x in a %}{% endfor %}", "no array"),
])
def test_broken_templates_raise(spark, template, message):
    df = spark.createDataFrame([("a",)], "a string")
    with pytest.raises(ValueError, match=message):
        TP.render(template, TP.scope_of(df), {"loop": 'x{% include "loop" %}'})


def test_the_judge_sees_the_page_as_it_was_cut(spark):
    page = F.struct(*[F.lit(None).cast("string").alias(m) for m in render.PAGE_MEMBERS], F.col("t").alias("extracted_text"))
    rows = spark.createDataFrame([("short",), ("a text that is too long",), (None,)], "t string")
    for limit, want in ((6, ["short", "a text", ""]), (0, ["short", "a text that is too long", ""])):
        messages, cut = render.judge_prompt("{{ text_truncated }} {{{ document }}}", {"document": render.page_xml}, page, limit)
        got = rows.select(messages[1]["content"].alias("c"), cut.alias("cut")).collect()
        assert [re.search(r"<content>\n(.*?)\n", r["c"])[1] for r in got] == want
        assert [r["cut"] for r in got] == [False, limit > 0, False] and got[1]["c"].startswith("true" if limit else "false")


def test_a_fetch_under_the_alias_comes_after_one_by_id_and_before_others(spark):
    results = spark.createDataFrame([("t", "r", 2, "d1", 3, "u"), ("t", "r", 2, "d9", 4, "v"), ("t", "r", None, "d8", 4, "w")], "trace_id string, retrieval_id string, retrieval_index int, document_id string, rank int, url string")
    fetches = spark.createDataFrame([("t", "r", "s2r3", "x", 9, "alias", 1, "success"), ("t", "r", "other", "u", 9, "by_url", 0, "success"), ("t", "r", "s2r4", "y", 9, "alias4", 1, "failed"), ("t", "r", "d9", "y", 9, "own", 5, "failed")], "trace_id string, retrieval_id string, document_id string, url string, rank int, fetch_id string, iteration_num int, fetch_status string")
    got = {(r["document_id"], r["rank"]): r["fetch_id"] for r in judge.match_fetches(results, fetches).collect()}
    assert got == {("d1", 3): "alias", ("d9", 4): "own", ("d8", 4): None}


def test_artifacts_lie_where_the_reader_looks(spark, tmp_path):
    root = str(tmp_path / "pages")
    rows = spark.createDataFrame([("https://a.example/x?utm_source=q", 1, None), ("https://a.example/x/", 2, "e"), ("https://b.example/", 3, "é")], "url string, n int, t string")
    for _ in range(2):  # a second run writes the same files
        sinks.write_artifacts(rows, root)
    files = sorted(tmp_path.glob("pages/*/*/*"))
    digests = {r["d"] for r in rows.select(F.regexp_extract(T.artifact_path(F.col("url")), "([0-9a-f]{64})", 1).alias("d")).collect()}
    assert {f.name for f in files} == {f"{d}.json.gz" for d in digests} and len(files) == 2
    for f in files:
        d = f.name[:64]
        assert (f.parent.parent.name, f.parent.name) == (d[:2], d[2:4])
    assert {json.loads(gzip.decompress(f.read_bytes()))["n"] for f in files} == {1, 3}
    held = jsonl.read_artifacts(spark, root, "url string, n int, t string")
    found = {r["n"]: (r["digest"] in digests, r["t"]) for r in held.collect()}
    assert found == {1: (True, None), 3: (True, "é")}
    hits = jsonl.lookup_artifacts(rows.select("url").union(spark.createDataFrame([("https://c.example",)], "url string")), held).collect()
    assert sorted(r["hit"] for r in hits) == [False, True, True, True]

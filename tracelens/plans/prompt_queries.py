"""Templates, prompts and the judge's messages over the driver's tables, each with an independent oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.functions import render as R
from tracelens.functions import templates as TP
from tracelens.operators import judge as J
from tracelens.plans.judge_queries import judge_record_build
from tracelens.plans.surrogates import RESULTS_SQL, table, traces
from tracelens.plans.text_queries import _E
from tracelens.sources import sinks as K

KINDS = ["click", "error", "purchase", "signup", "view"]


def last_cells(spark: SparkSession, d: str) -> DataFrame:
    """Of the events of a user and type, which share a cell, the last one's value."""
    rows = table(spark, d, "events").filter(F.col("event_type").isin(KINDS))
    found = K.pivot(rows, "user_id", "event_type", F.round("value", 4), F.col("event_id"))
    return found.select("user_id", *[(F.col(k) if k in found.columns else F.lit(None).cast("double")).alias(k) for k in KINDS])


LAST_SQL = "SELECT user_id, " + ", ".join(f"round(max_by(value, event_id) FILTER (WHERE event_type = '{k}'), 4) AS {k}" for k in KINDS) + " FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type IN ('click', 'error', 'purchase', 'signup', 'view')) > 0"

PROMPT = """{% include "head" %}
{% for o in orders %}  <order id="{{ o.key }}">{% for l in o.lines %} {{ l.flag }}:{{{ l.note }}}{{ l.none }}; {% endfor %}</order>
{% endfor %}done={{ customer.open }}"""
INCLUDED = {"head": "<{{ customer.name }}> & {{{ customer.name }}}"}


def nested_templates(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders and their lines, by two loops, one in the other, with a template in front."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.concat(F.lit("<"), "l_returnflag").alias("flag"), F.concat(F.lit("&"), "l_linestatus").alias("note"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    orders = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    orders = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), "lines"))).alias("orders"))
    customer = F.struct(F.concat("c_name", F.lit("'s")).alias("name"), (F.col("c_acctbal") > 0).alias("open"))
    rows = table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", customer.alias("customer"), "orders")
    return rows.select("c_custkey", F.md5(TP.render(PROMPT, TP.scope_of(rows), INCLUDED).cast("binary")).alias("digest"))


NESTED_SQL = """
WITH l AS (SELECT l_orderkey, string_agg('&lt;' || l_returnflag || ':&' || l_linestatus || ';', '' ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS lines FROM lineitem GROUP BY 1),
o AS (SELECT o_custkey, string_agg('<order id="' || o_orderkey || '">' || coalesce(lines, '') || '</order>', '' ORDER BY o_orderkey) AS orders FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey, md5('<' || c_name || '&#x27;s> & ' || c_name || '''s' || chr(10) || coalesce(orders, '') || 'done=' || CASE WHEN c_acctbal > 0 THEN 'True' ELSE 'False' END) AS digest FROM customer LEFT JOIN o ON o_custkey = c_custkey
"""


def capped_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Pages as documents whose text is cut before the prompt is rendered."""
    members = [(F.lit("success") if m == "fetch_status" else F.lit(None).cast("string")).alias(m) for m in R.PAGE_MEMBERS]
    page = F.when(F.col("page_id") % 5 > 0, F.struct(*members, F.col("html").alias("extracted_text")))
    messages, cut = R.judge_prompt("{{ question }}|{{ text_truncated }}|{{{ document }}}", {"question": F.col("url"), "document": R.page_xml}, page, 700)
    content = messages[1]["content"]
    return table(spark, d, "pages").select("page_id", cut.alias("truncated"), F.md5(content.cast("binary")).alias("digest"), F.length(content).cast("long").alias("n"))


_EMPTY = " || ".join(f"'      <{m}></{m}>' || chr(10)" for m in R.PAGE_MEMBERS[2:])
CAPPED_SQL = f"""
WITH p AS (SELECT *, page_id % 5 > 0 AS has, page_id % 5 > 0 AND length(html) > 700 AS is_cut FROM pages),
x AS (SELECT page_id, is_cut, {_E('url')} || '|' || CASE WHEN is_cut THEN 'true' ELSE 'false' END || '|' || CASE WHEN has THEN '    <extracted_page>' || chr(10) || '      <fetch_backend></fetch_backend>' || chr(10) || '      <fetch_status>success</fetch_status>' || chr(10) || {_EMPTY}
  || '      <content>' || chr(10) || {_E('html[1:700]')} || chr(10) || '      </content>' || chr(10) || '    </extracted_page>' ELSE '' END AS content FROM p)
SELECT page_id, is_cut AS truncated, md5(content) AS digest, length(content) AS n FROM x
"""


def judge_messages(spark: SparkSession, d: str) -> DataFrame:
    """Each record's source, surface, precheck and signature, and whether its messages show the page's text, cut to four characters."""
    rows = J.judge_records(traces(spark, d), max_chars=4)
    content = F.col("messages")[1]["content"]
    shown = F.regexp_extract(content, r"(?s)<content>\n(.*?)\n      </content>", 1)
    return rows.select(
        "trace_id", "retrieval_id", F.col("rank").cast("long").alias("rank"), "page_fetch_source", "judge_surface_class", F.col("document_garbage_precheck.category").alias("category"), "effective_is_garbage", F.coalesce("fetch_id", F.lit("")).alias("fetch_id"),
        F.regexp_extract(content, "Page text cut: (true|false)", 1).alias("cut"), shown.alias("shown"), F.regexp_extract(content, "<snippet>(.*?)</snippet>", 1).alias("snippet"), F.regexp_extract(content, "Reference answer: ([0-9]+)", 1).alias("gold"), (F.col("judge_page_fetch_signature") != "").alias("signed"),
    )


MESSAGES_SQL = f"""
WITH {RESULTS_SQL}, r AS (SELECT o.o_orderkey, o.gold, res.*, 'host' || (l_suppkey % 7) || '/' || (l_partkey % 200) AS page_url FROM runs o JOIN res ON l_orderkey = o.o_orderkey),
f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY rk) AS fetch_no FROM r WHERE k = 0 AND l_returnflag = 'R'),
m AS (SELECT r.*, f.rk AS f_rk, f.l_quantity AS f_quantity, row_number() OVER (PARTITION BY r.l_orderkey, r.k, r.rk ORDER BY CASE WHEN f.rk = r.rk THEN 0 ELSE 1 END, 'f' || f.rk) AS best
  FROM r LEFT JOIN f ON r.k = 0 AND f.l_orderkey = r.l_orderkey AND (f.rk = r.rk OR f.page_url = r.page_url)),
p AS (SELECT *, CASE WHEN f_rk IS NOT NULL THEN 'fetch_tool' WHEN l_linestatus = 'F' THEN 'search_result_auto_fetch' ELSE 'none' END AS source,
  CASE WHEN f_rk IS NOT NULL THEN 'page ' || CAST(floor(f_quantity) AS BIGINT) WHEN l_linestatus = 'F' THEN 'holds ' || CAST(floor(l_discount * 100) AS BIGINT) ELSE '' END AS text FROM m WHERE best = 1)
SELECT 't' || o_orderkey AS trace_id, 'it' || (k + 1) AS retrieval_id, CAST(rk AS BIGINT) AS rank, source AS page_fetch_source, CASE WHEN source = 'none' THEN 'snippet_only' ELSE 'page_visible' END AS judge_surface_class,
  CASE WHEN source = 'search_result_auto_fetch' AND l_returnflag = 'N' THEN 'fetch_failed' ELSE '' END AS category, source = 'search_result_auto_fetch' AND l_returnflag = 'N' AS effective_is_garbage, coalesce('f' || f_rk, '') AS fetch_id,
  CASE WHEN length(text) > 4 THEN 'true' ELSE 'false' END AS cut, text[1:4] AS shown, 'quantity ' || CAST(floor(l_quantity) AS BIGINT) AS snippet, gold, source <> 'none' AS signed FROM p
"""

#: The records of judge_queries.judge_record_build, from the same rows.
BUILD_SQL = MESSAGES_SQL[: MESSAGES_SQL.index("SELECT 't' || o_orderkey AS trace_id")] + """SELECT 'p' || (o_orderkey % 3) AS provider_id, CASE WHEN source = 'none' THEN 'snippet_only' ELSE 'page_visible' END AS judge_surface_class, source AS page_fetch_source, CASE WHEN source = 'search_result_auto_fetch' AND l_returnflag = 'N' THEN 'fetch_failed' ELSE '' END AS category,
  count(*) AS n, count_if(source = 'fetch_tool') AS fetched, count(DISTINCT page_url) AS urls, TRUE AS signed FROM p GROUP BY 1, 2, 3, 4"""


def fetch_match_alias(spark: SparkSession, d: str) -> DataFrame:
    """Fetches under a result's id, or s{search}r{rank} as the model may name it, or another name with its URL or rank."""
    c, shown = F.col, lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    lines = table(spark, d, "lineitem").select(c("l_orderkey").alias("trace_id"), F.lit("it1").alias("retrieval_id"), (c("l_suppkey") % 3).cast("int").alias("retrieval_index"), c("l_linenumber").alias("rank"), "l_partkey", shown("u", c("l_suppkey") % 5).alias("url"))
    lines = J.by_trace(lines)  # what follows needs no other partitions
    results = lines.select("trace_id", "retrieval_id", "retrieval_index", F.when(c("l_partkey") % 3 > 0, shown("d", c("l_partkey"))).alias("document_id"), "rank", "url").distinct()
    under = F.when(c("l_partkey") % 12 == 0, shown("d", c("l_partkey") + 1)).when(c("l_partkey") % 8 == 0, shown("s", c("retrieval_index"), "r", c("rank"))).otherwise(shown("d", c("l_partkey")))
    fetches = lines.filter("l_partkey % 4 = 0").select("trace_id", "retrieval_id", under.alias("document_id"), "url", (c("rank") + 1).alias("rank"), shown("f", c("l_partkey"), "_", c("retrieval_index")).alias("fetch_id"), (c("l_partkey") % 5).cast("int").alias("iteration_num"), F.when(c("l_partkey") % 7 > 2, "success").otherwise("failed").alias("fetch_status")).distinct()
    found = J.match_fetches(results, fetches)
    return found.select("trace_id", F.coalesce("document_id", F.lit("-")).alias("document_id"), c("retrieval_index").cast("long").alias("search"), c("rank").cast("long").alias("rank"), "url", "fetch_id", "fetch_status", "model_fetched_document")


ALIAS_SQL = """
WITH l AS (SELECT *, l_suppkey % 3 AS i, 'u' || (l_suppkey % 5) AS url FROM lineitem),
r AS (SELECT DISTINCT l_orderkey AS trace_id, i, CASE WHEN l_partkey % 3 > 0 THEN 'd' || l_partkey END AS document_id, l_linenumber AS rank, url FROM l),
f AS (SELECT DISTINCT l_orderkey AS trace_id, CASE WHEN l_partkey % 12 = 0 THEN 'd' || (l_partkey + 1) WHEN l_partkey % 8 = 0 THEN 's' || i || 'r' || l_linenumber ELSE 'd' || l_partkey END AS document_id, url, l_linenumber + 1 AS rank, 'f' || l_partkey || '_' || i AS fetch_id, l_partkey % 5 AS it, CASE WHEN l_partkey % 7 > 2 THEN 'success' ELSE 'failed' END AS status FROM l WHERE l_partkey % 4 = 0),
m AS (SELECT r.*, f.fetch_id, f.status, row_number() OVER (PARTITION BY r.trace_id, r.i, r.document_id, r.rank, r.url ORDER BY CASE WHEN f.document_id = r.document_id THEN 0 WHEN r.i > 0 AND f.document_id = 's' || r.i || 'r' || r.rank THEN 1 ELSE 2 END, CASE WHEN f.status = 'success' THEN 0 ELSE 1 END, f.it, f.fetch_id) AS rn
  FROM r LEFT JOIN f ON f.trace_id = r.trace_id AND (f.document_id = r.document_id OR (r.i > 0 AND f.document_id = 's' || r.i || 'r' || r.rank) OR f.url = r.url OR f.rank = r.rank))
SELECT trace_id, coalesce(document_id, '-') AS document_id, CAST(i AS BIGINT) AS search, CAST(rank AS BIGINT) AS rank, url, fetch_id, status AS fetch_status, fetch_id IS NOT NULL AS model_fetched_document FROM m WHERE rn = 1
"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "last_cells": (last_cells, LAST_SQL),
    "nested_templates": (nested_templates, NESTED_SQL),
    "capped_prompts": (capped_prompts, CAPPED_SQL),
    "judge_messages": (judge_messages, MESSAGES_SQL),
    "judge_record_build": (judge_record_build, BUILD_SQL),
    "fetch_match_alias": (fetch_match_alias, ALIAS_SQL),
}

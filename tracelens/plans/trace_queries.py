"""Trace analytics over the surrogate traces, each with an oracle that computes the same from the flat tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.functions import text as T
from tracelens.operators import traces as O
from tracelens.plans.surrogates import RESULTS_SQL, table, traces

WITH = f"WITH {RESULTS_SQL}"


def per_trace_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = O.per_trace_metrics(traces(spark, d))
    return rows.select("trace_id", "answered", "failed", "abstained", "exact_match", F.round("f1", 6).alias("f1"), "gold_url_exact_hit", "gold_url_prefix_hit", "gold_domain_hit", "answer_in_title", "answer_in_snippet", "answer_in_extra_snippets", "answer_in_page", "answer_in_any_retrieved_text", F.col("first_answer_snippet_rank").cast("long").alias("first_answer_snippet_rank"), F.col("first_answer_page_rank").cast("long").alias("first_answer_page_rank"), F.round("answer_snippet_mrr", 6).alias("answer_snippet_mrr"), "wrong_with_answer_text_available", "gold_hit_but_no_answer_text", F.col("retrieval_count").cast("long").alias("retrieval_count"), F.col("result_count").cast("long").alias("result_count"), F.col("source_diversity").cast("long").alias("source_diversity"), "total_tokens")


PER_TRACE_SQL = f"""{WITH}
SELECT 't' || o_orderkey AS trace_id, given AS answered, bad AS failed, NOT given AND NOT bad AS abstained, em AS exact_match,
  round(CASE WHEN o_orderkey % 50 <> o_custkey % 50 THEN 0.0 WHEN o_orderkey % 2 = 0 THEN 2.0 / 3 ELSE 1.0 END, 6) AS f1, exact_hit AS gold_url_exact_hit, prefix_hit AS gold_url_prefix_hit, domain_hit AS gold_domain_hit,
  in_title AS answer_in_title, in_snippet AS answer_in_snippet, in_extra AS answer_in_extra_snippets, in_page AS answer_in_page, in_snippet OR in_page OR in_extra AS answer_in_any_retrieved_text, snippet_rank AS first_answer_snippet_rank, page_rank AS first_answer_page_rank,
  round(coalesce(1.0 / snippet_rank, 0.0), 6) AS answer_snippet_mrr, NOT em AND (in_snippet OR in_page OR in_extra) AS wrong_with_answer_text_available, prefix_hit AND NOT (in_snippet OR in_page OR in_extra) AS gold_hit_but_no_answer_text,
  searches AS retrieval_count, results AS result_count, domains AS source_diversity, CAST(floor(o_totalprice) AS BIGINT) + o_custkey % 1000 AS total_tokens FROM trace"""


def trace_shapes(spark: SparkSession, d: str) -> DataFrame:
    rows = O.per_trace_metrics(traces(spark, d))
    long = lambda c: F.col(c).cast("long").alias(c)
    return rows.select("trace_id", long("extracted_chars_max"), "extracted_chars_median", "snippet_chars_median", *[long(f"large_extract_{n}k_count") for n in (50, 100, 500)], long("search_query_count"), long("unique_search_query_count"), long("site_restricted_searches"), long("quoted_searches"), F.round("avg_search_query_chars", 6).alias("avg_search_query_chars"), long("iteration_count"), long("search_iteration_count"), long("answer_iteration"), long("multi_search_turn_count"), F.round("multi_search_turn_rate", 6).alias("multi_search_turn_rate"), "answered_after_first_search")


SHAPES_SQL = f"""{WITH}, page AS (SELECT l_orderkey, CAST(floor(l_extendedprice * 2) AS BIGINT) AS chars FROM res WHERE l_linestatus = 'F' UNION ALL SELECT l_orderkey, CAST(floor(l_extendedprice) AS BIGINT) FROM res WHERE k = 0 AND l_returnflag = 'R'),
p AS (SELECT l_orderkey, max(chars) AS top, median(chars) AS mid, count_if(chars > 50000) AS a, count_if(chars > 100000) AS b, count_if(chars > 500000) AS c FROM page GROUP BY l_orderkey),
s AS (SELECT l_orderkey, k, count(*) AS n, first('Part ' || l_partkey || CASE WHEN k = 1 THEN ' site:a.example' ELSE '' END ORDER BY rk) AS q FROM res GROUP BY l_orderkey, k),
t AS (SELECT l_orderkey, count(*) AS searches, count(DISTINCT lower(q)) AS uniq, count_if(k = 1) AS sites, avg(length(q)) AS len, count_if(n > 1) AS many FROM s GROUP BY l_orderkey),
m AS (SELECT l_orderkey, median(length('quantity ' || CAST(floor(l_quantity) AS BIGINT))) AS mid FROM res GROUP BY l_orderkey)
SELECT 't' || o_orderkey AS trace_id, coalesce(p.top, 0) AS extracted_chars_max, coalesce(p.mid, 0.0) AS extracted_chars_median, coalesce(m.mid, 0.0) AS snippet_chars_median, coalesce(a, 0) AS large_extract_50k_count, coalesce(b, 0) AS large_extract_100k_count, coalesce(c, 0) AS large_extract_500k_count,
  coalesce(t.searches, 0) AS search_query_count, coalesce(uniq, 0) AS unique_search_query_count, coalesce(sites, 0) AS site_restricted_searches, CAST(0 AS BIGINT) AS quoted_searches, round(coalesce(len, 0.0), 6) AS avg_search_query_chars, coalesce(t.searches, 0) + 1 AS iteration_count, coalesce(t.searches, 0) AS search_iteration_count,
  coalesce(t.searches, 0) + 1 AS answer_iteration, coalesce(many, 0) AS multi_search_turn_count, round(CAST(many AS DOUBLE) / t.searches, 6) AS multi_search_turn_rate, o_orderstatus <> 'P' AND coalesce(t.searches, 0) <= 1 AS answered_after_first_search
FROM orders o LEFT JOIN p ON p.l_orderkey = o_orderkey LEFT JOIN t ON t.l_orderkey = o_orderkey LEFT JOIN m ON m.l_orderkey = o_orderkey"""


def trace_modes(spark: SparkSession, d: str) -> DataFrame:
    return O.trace_metrics(traces(spark, d)).groupBy("provider_id", "topic", F.coalesce("failure_mode", F.lit("none")).alias("failure_mode")).agg(F.count("*").alias("n"), F.count_if("premature_termination").alias("premature"), F.sum("total_search_calls").alias("searches"), F.sum("source_diversity").alias("hosts"), F.count_if("gold_document_hit").alias("gold_hits"), F.round(F.sum("total_cost_usd"), 4).alias("cost"))


MODES_SQL = f"""{WITH}, h AS (SELECT o_orderkey, count(DISTINCT host) AS hosts FROM hits GROUP BY o_orderkey)
SELECT provider_id, o_orderpriority AS topic, CASE WHEN em THEN 'none' WHEN prefix_hit THEN 'reasoning_failure' ELSE 'retrieval_failure' END AS failure_mode, count(*) AS n, count_if(NOT em AND searches < 3) AS premature,
  CAST(sum(searches) AS BIGINT) AS searches, CAST(sum(coalesce(hosts, 0)) AS BIGINT) AS hosts, count_if(prefix_hit) AS gold_hits, round(CAST(sum(t.o_orderkey % 16 * 0.25) AS DOUBLE), 4) AS cost
FROM trace t LEFT JOIN h ON h.o_orderkey = t.o_orderkey GROUP BY 1, 2, 3"""


def provider_report(spark: SparkSession, d: str) -> DataFrame:
    rows = O.summarize_providers(traces(spark, d))
    long = ["trace_rows", "latest_queries", "historical_failed_rows", "latest_failed_queries", "transient_failures_recovered", "answered", "abstained", "exact_match", "gold_url_exact_hit", "gold_url_prefix_hit", "gold_domain_hit", "answer_in_snippet", "answer_in_extra_snippets", "answer_in_page", "answer_in_any_retrieved_text", "wrong_with_answer_text_available", "answer_after_first_search", "total_search_calls", "total_tokens", "max_tokens", "queries_over_100k_tokens", "queries_over_500k_tokens", "p90_extracted_chars", "max_extracted_chars", "large_extract_over_50000", "large_extract_over_100000", "large_extract_over_500000", "gold_source_family_hit", "gold_hit_but_no_answer_text", "answer_text_without_gold_prefix", "wrong_without_answer_text_available"]
    real = ["avg_f1", "avg_search_calls", "avg_source_diversity", "avg_tokens", "median_tokens", "total_wall_time_seconds", "avg_wall_time_seconds", "median_snippet_chars", "median_extracted_chars", "avg_result_count_per_search", "multi_search_turn_rate_avg", "avg_redundant_search_rate"]
    return rows.select("provider_id", *[F.col(c).cast("long").alias(c) for c in long], *[F.round(F.col(c).cast("double"), 4).alias(c) for c in real])


REPORT_SQL = f"""{WITH}, n AS (SELECT * FROM trace WHERE newest), page AS (
  SELECT provider_id, CAST(floor(l_extendedprice * 2) AS BIGINT) AS chars FROM n JOIN res ON l_orderkey = o_orderkey WHERE l_linestatus = 'F' UNION ALL SELECT provider_id, CAST(floor(l_extendedprice) AS BIGINT) FROM n JOIN res ON l_orderkey = o_orderkey WHERE k = 0 AND l_returnflag = 'R'),
p AS (SELECT provider_id, median(chars) AS median_extracted_chars, quantile_disc(chars, 0.9) AS p90_extracted_chars, max(chars) AS max_extracted_chars, count_if(chars > 50000) AS large_extract_over_50000, count_if(chars > 100000) AS large_extract_over_100000, count_if(chars > 500000) AS large_extract_over_500000 FROM page GROUP BY provider_id),
r AS (SELECT provider_id, median(length('quantity ' || CAST(floor(l_quantity) AS BIGINT))) AS median_snippet_chars, CAST(count(*) AS DOUBLE) / count(DISTINCT l_orderkey * 10 + k) AS avg_result_count_per_search FROM n JOIN res ON l_orderkey = o_orderkey GROUP BY provider_id),
sets AS (SELECT provider_id, o_orderkey, k, list(DISTINCT l_suppkey % 7 || '/' || l_partkey % 200) AS urls, least(count(*), 2) > 1 AS many, row_number() OVER (PARTITION BY o_orderkey ORDER BY k) AS at FROM n JOIN res ON l_orderkey = o_orderkey GROUP BY provider_id, o_orderkey, k),
turns AS (SELECT x.provider_id, x.o_orderkey, avg(CASE WHEN x.many THEN 1.0 ELSE 0.0 END) AS multi, avg(CASE WHEN y.k IS NULL THEN NULL WHEN len(list_intersect(x.urls, y.urls)) / CAST(len(list_distinct(list_concat(x.urls, y.urls))) AS DOUBLE) > 0.7 THEN 1.0 ELSE 0.0 END) AS again
  FROM sets x LEFT JOIN sets y ON y.o_orderkey = x.o_orderkey AND y.at = x.at + 1 GROUP BY 1, 2),
w AS (SELECT provider_id, round(coalesce(avg(multi), 0), 4) AS multi_search_turn_rate_avg, round(coalesce(avg(again), 0), 4) AS avg_redundant_search_rate FROM turns GROUP BY 1),
a AS (SELECT t.provider_id, count(*) AS trace_rows, count_if(t.bad) AS historical_failed_rows, count_if(t.bad AND NOT n.bad) AS transient_failures_recovered FROM trace t JOIN n ON n.provider_id = t.provider_id AND n.query_id = t.query_id GROUP BY t.provider_id),
m AS (SELECT *, in_snippet OR in_page OR in_extra AS text, CAST(floor(o_totalprice) AS BIGINT) + o_custkey % 1000 AS tokens, o_orderkey % 600 * 0.5 AS wall, CASE WHEN o_orderkey % 50 <> o_custkey % 50 THEN 0.0 WHEN o_orderkey % 2 = 0 THEN 2.0 / 3 ELSE 1.0 END AS f1 FROM n),
g AS (SELECT provider_id, count(*) AS latest_queries, count_if(bad) AS latest_failed_queries, count_if(given) AS answered, count_if(NOT given AND NOT bad) AS abstained, count_if(em) AS exact_match, count_if(exact_hit) AS gold_url_exact_hit, count_if(prefix_hit) AS gold_url_prefix_hit, count_if(domain_hit) AS gold_domain_hit,
  count_if(in_snippet) AS answer_in_snippet, count_if(in_extra) AS answer_in_extra_snippets, count_if(in_page) AS answer_in_page, count_if(text) AS answer_in_any_retrieved_text, count_if(NOT em AND text) AS wrong_with_answer_text_available, count_if(exact_hit) AS gold_source_family_hit, count_if(prefix_hit AND NOT text) AS gold_hit_but_no_answer_text, count_if(text AND NOT prefix_hit) AS answer_text_without_gold_prefix, count_if(NOT em AND NOT text) AS wrong_without_answer_text_available, count_if(given AND searches <= 1) AS answer_after_first_search,
  CAST(sum(searches) AS BIGINT) AS total_search_calls, CAST(sum(tokens) AS BIGINT) AS total_tokens, max(tokens) AS max_tokens, count_if(tokens > 100000) AS queries_over_100k_tokens, count_if(tokens > 500000) AS queries_over_500k_tokens, avg(f1) AS avg_f1, avg(searches) AS avg_search_calls, avg(domains) AS avg_source_diversity,
  avg(tokens) AS avg_tokens, median(tokens) AS median_tokens, sum(wall) AS total_wall_time_seconds, avg(wall) AS avg_wall_time_seconds FROM m GROUP BY provider_id)
SELECT * REPLACE (round(avg_f1, 4) AS avg_f1, round(avg_search_calls, 4) AS avg_search_calls, round(avg_source_diversity, 4) AS avg_source_diversity, round(avg_tokens, 4) AS avg_tokens, round(median_tokens, 4) AS median_tokens, round(CAST(total_wall_time_seconds AS DOUBLE), 4) AS total_wall_time_seconds, round(CAST(avg_wall_time_seconds AS DOUBLE), 4) AS avg_wall_time_seconds,
  round(median_snippet_chars, 4) AS median_snippet_chars, round(median_extracted_chars, 4) AS median_extracted_chars, round(avg_result_count_per_search, 4) AS avg_result_count_per_search) FROM g JOIN a USING (provider_id) JOIN p USING (provider_id) JOIN r USING (provider_id) JOIN w USING (provider_id)"""


def page_histograms(spark: SparkSession, d: str) -> DataFrame:
    return O.page_counts(traces(spark, d))


HISTOGRAMS_SQL = f"""{WITH}, x AS (SELECT provider_id, res.* FROM trace JOIN res ON l_orderkey = o_orderkey WHERE newest),
p AS (SELECT provider_id, CASE l_returnflag WHEN 'A' THEN 'success' WHEN 'N' THEN 'failed' ELSE 'empty' END AS status, CASE WHEN l_returnflag = 'A' THEN 'html' ELSE 'none' END AS ex FROM x WHERE l_linestatus = 'F' UNION ALL SELECT provider_id, 'success', 'reader' FROM x WHERE k = 0 AND l_returnflag = 'R')
SELECT provider_id, 'fetch_status' AS kind, status AS value, count(*) AS n FROM p GROUP BY 1, 3 UNION ALL SELECT provider_id, 'extractor', ex, count(*) FROM p GROUP BY 1, 3
UNION ALL SELECT provider_id, 'metadata', v, count(*) FROM x CROSS JOIN (VALUES ('extra_snippets'), ('flag')) m(v) GROUP BY 1, 3"""


def domain_report(spark: SparkSession, d: str) -> DataFrame:
    return O.domain_rows(traces(spark, d))


DOMAIN_SQL = f"""{WITH}, x AS (SELECT provider_id, gold, res.*, CASE WHEN l_suppkey % 7 = 0 THEN 'host0.example' ELSE 'host' || (l_suppkey % 7) || '.example' END AS domain, l_linestatus = 'F' AS has FROM trace JOIN res ON l_orderkey = o_orderkey WHERE newest)
SELECT provider_id, domain, count(*) AS result_count, count_if(has AND l_returnflag = 'A') AS fetch_success, count_if(has AND l_returnflag = 'N') AS fetch_failed, count_if(has AND l_returnflag NOT IN ('A', 'N')) AS fetch_empty,
  count_if(has AND contains('holds ' || CAST(floor(l_discount * 100) AS BIGINT), gold)) AS answer_in_page, CAST(sum(CASE WHEN has THEN floor(l_extendedprice * 2) ELSE 0 END) AS BIGINT) AS extract_chars_total, count_if(has AND floor(l_extendedprice * 2) > 100000) AS large_extract_100k FROM x GROUP BY 1, 2"""


def commonest_domains(spark: SparkSession, d: str) -> DataFrame:
    return O.top_domains(traces(spark, d), 5)


TOP_SQL = f"""{WITH}, x AS (SELECT provider_id, 'host' || (l_suppkey % 7) || '.example' AS domain, count(*) AS n, min(l_orderkey * 10000 + k * 100 + rk) AS first FROM trace JOIN res ON l_orderkey = o_orderkey WHERE newest AND l_suppkey % 7 <> 0 GROUP BY 1, 2)
SELECT provider_id, CAST(place AS INTEGER) AS place, domain, n FROM (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY n DESC, first) AS place FROM x) y WHERE place <= 5"""


def trace_reliability(spark: SparkSession, d: str) -> DataFrame:
    return O.reliability(traces(spark, d))


RELIABILITY_SQL = f"""{WITH}, n AS (SELECT * FROM runs WHERE newest)
SELECT r.provider_id, count(*) AS trace_rows, count_if(r.bad) AS historical_failed_rows, count_if(r.bad AND NOT n.bad) AS transient_failures_recovered, count_if(r.newest) AS latest_queries, count_if(r.newest AND r.bad) AS latest_failed_queries
FROM runs r JOIN n ON n.provider_id = r.provider_id AND n.query_id = r.query_id GROUP BY 1"""


def trace_pairs(spark: SparkSession, d: str) -> DataFrame:
    return O.pairwise_outcomes(O.per_trace_metrics(O.latest(traces(spark, d))))


PAIRS_SQL = f"""{WITH}, n AS (SELECT query_id, provider_id, em, in_snippet OR in_page OR in_extra AS text FROM trace WHERE newest)
SELECT a.provider_id AS provider_a, b.provider_id AS provider_b, CASE WHEN a.em AND b.em THEN 'both_correct' WHEN a.em THEN a.provider_id || '_correct_only' WHEN b.em THEN b.provider_id || '_correct_only' WHEN a.text <> b.text THEN 'both_wrong_one_has_answer_text' ELSE 'both_wrong' END AS outcome, count(*) AS n
FROM n a JOIN n b ON a.query_id = b.query_id AND a.provider_id < b.provider_id GROUP BY 1, 2, 3"""


def trace_multiway(spark: SparkSession, d: str) -> DataFrame:
    return O.multiway_outcomes(O.per_trace_metrics(O.latest(traces(spark, d))))


MULTIWAY_SQL = f"""{WITH}, q AS (SELECT query_id, count(*) AS p, count_if(em) AS r, count_if(in_snippet OR in_page OR in_extra) AS t, count_if(prefix_hit) AS g FROM trace WHERE newest GROUP BY query_id HAVING count(*) = 3)
SELECT outcome, count(*) AS n FROM (SELECT CASE r WHEN 3 THEN 'all_correct' WHEN 0 THEN 'all_wrong' WHEN 1 THEN 'one_provider_correct' ELSE 'two_providers_correct' END AS outcome FROM q
UNION ALL SELECT 'all_have_answer_text_but_different_correctness' FROM q WHERE t = 3 AND r IN (1, 2) UNION ALL SELECT 'only_one_provider_has_answer_text' FROM q WHERE t = 1 UNION ALL SELECT 'gold_alignment_exceeds_answer_text_support' FROM q WHERE g > t) x GROUP BY outcome"""


def trace_file_summary(spark: SparkSession, d: str) -> DataFrame:
    return O.file_summary(traces(spark, d)).select("provider_id", "latest_queries", "answered", "abstained", "failed", "exact_match", "gold_document_hit", "total_search_calls", "total_fetch_calls", "total_tokens", "total_wall_time_seconds", "total_cost_usd", "answered_pct", "gold_document_hit_pct")


FILE_SQL = f"""{WITH}, f AS (SELECT l_orderkey, count(*) AS n FROM res WHERE k = 0 AND l_returnflag = 'R' GROUP BY l_orderkey)
SELECT provider_id, count(*) AS latest_queries, count_if(given) AS answered, count_if(NOT given AND NOT bad) AS abstained, count_if(bad) AS failed, count_if(em) AS exact_match, count_if(prefix_hit) AS gold_document_hit, CAST(sum(searches) AS BIGINT) AS total_search_calls, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total_fetch_calls,
  CAST(sum(CAST(floor(o_totalprice) AS BIGINT) + o_custkey % 1000) AS BIGINT) AS total_tokens, round(CAST(sum(o_orderkey % 600 * 0.5) AS DOUBLE), 3) AS total_wall_time_seconds, round(CAST(sum(o_orderkey % 16 * 0.25) AS DOUBLE), 8) AS total_cost_usd,
  CAST(round_even(100.0 * count_if(given) / count(*), 1) AS DOUBLE) AS answered_pct, CAST(round_even(100.0 * count_if(prefix_hit) / count(*), 1) AS DOUBLE) AS gold_document_hit_pct
FROM trace LEFT JOIN f ON l_orderkey = o_orderkey WHERE newest GROUP BY provider_id"""


def consecutive_searches(spark: SparkSession, d: str) -> DataFrame:
    """W3 alone: overlap of consecutive orders' parts, an order's parts modulo 20 its URLs."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    searches = lines.groupBy("o_custkey", "l_orderkey").agg(F.collect_set(F.concat(F.lit("u"), (F.col("l_partkey") % 4).cast("string"))).alias("urls"))
    row = F.struct("l_orderkey", F.transform("urls", lambda u: F.struct(u.alias("url"))).alias("results"))
    rows = searches.groupBy("o_custkey").agg(F.array_sort(F.collect_list(row)).alias("s"))
    rows = rows.withColumn("r", F.transform("s", lambda x: F.struct(F.struct(x["results"].alias("results")).alias("search_response"))))
    return rows.select("o_custkey", F.round(O.redundant_rate(F.col("r")), 6).alias("rate"))


CONSECUTIVE_SQL = """WITH u AS (SELECT DISTINCT o_custkey, l_orderkey, l_partkey % 4 AS u FROM lineitem JOIN orders ON l_orderkey = o_orderkey), s AS (SELECT DISTINCT o_custkey, l_orderkey FROM u),
p AS (SELECT o_custkey, l_orderkey AS b, lag(l_orderkey) OVER (PARTITION BY o_custkey ORDER BY l_orderkey) AS a FROM s),
j AS (SELECT p.o_custkey, p.b, (SELECT count(*) FROM u x JOIN u y ON x.u = y.u WHERE x.l_orderkey = p.a AND y.l_orderkey = p.b) AS shared, (SELECT count(DISTINCT u) FROM u x WHERE x.l_orderkey IN (p.a, p.b)) AS whole FROM p WHERE a IS NOT NULL),
r AS (SELECT o_custkey, avg(CASE WHEN shared / CAST(whole AS DOUBLE) > 0.7 THEN 1.0 ELSE 0.0 END) AS rate FROM j GROUP BY o_custkey)
SELECT c.o_custkey, round(r.rate, 6) AS rate FROM (SELECT DISTINCT o_custkey FROM s) c LEFT JOIN r ON r.o_custkey = c.o_custkey"""


def reformulated(spark: SparkSession, d: str) -> DataFrame:
    """Difflib on the user's turns of a conversation. No SQL has it; a test compares it with Python."""
    rows = table(spark, d, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return rows.select("conv_id", O.reformulation_rate(F.transform("t", lambda x: x["text"])).alias("rate"))


def seen_results(spark: SparkSession, d: str) -> DataFrame:
    """The latest search of a run that has its gold URL, and the first result there."""
    rows = traces(spark, d).withColumn("hit", O.find_seen(F.get("gold_urls", F.lit(0))))
    return rows.filter("hit IS NOT NULL").select("trace_id", "hit.retrieval_id", F.col("hit.rank").cast("long").alias("rank"))


SEEN_SQL = f"""{WITH} SELECT 't' || o_orderkey AS trace_id, 'it' || (k + 1) AS retrieval_id, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY k DESC, rk) AS rn FROM hits WHERE host = gold_host AND item = gold_item) x WHERE rn = 1"""


def zipped_pages(spark: SparkSession, d: str) -> DataFrame:
    """Results and pages by position, the shorter ends both."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("r"), F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == "A", F.col("l_partkey")))).alias("p"))
    return rows.select("l_orderkey", F.explode(O.zip_pages(F.col("r"), F.col("p"))).alias("z")).select("l_orderkey", F.col("z.result.l_partkey").alias("part"), F.col("z.page_fetch").alias("page"))


ZIP_SQL = """WITH r AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem), p AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS i FROM lineitem WHERE l_returnflag = 'A')
SELECT r.l_orderkey, r.l_partkey AS part, p.l_partkey AS page FROM r JOIN p USING (l_orderkey, i)"""


def metric_counts(spark: SparkSession, d: str) -> DataFrame:
    """A4: every boolean metric's total, in long form for some."""
    return O.metric_totals(O.per_trace_metrics(O.latest(traces(spark, d)))).select("provider_id", "answered", "exact_match", "answer_in_title", "gold_domain_hit", "ceiling_hit", "answer_in_page")


COUNTS_SQL = f"{WITH} SELECT provider_id, count_if(given) AS answered, count_if(em) AS exact_match, count_if(in_title) AS answer_in_title, count_if(domain_hit) AS gold_domain_hit, count_if(FALSE) AS ceiling_hit, count_if(in_page) AS answer_in_page FROM trace WHERE newest GROUP BY provider_id"

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "per_trace_metrics": (per_trace_metrics, PER_TRACE_SQL),
    "trace_shapes": (trace_shapes, SHAPES_SQL),
    "trace_failure_modes": (trace_modes, MODES_SQL),
    "provider_report": (provider_report, REPORT_SQL),
    "page_histograms": (page_histograms, HISTOGRAMS_SQL),
    "domain_report": (domain_report, DOMAIN_SQL),
    "commonest_domains": (commonest_domains, TOP_SQL),
    "trace_reliability": (trace_reliability, RELIABILITY_SQL),
    "trace_pairwise": (trace_pairs, PAIRS_SQL),
    "trace_multiway": (trace_multiway, MULTIWAY_SQL),
    "trace_file_summary": (trace_file_summary, FILE_SQL),
    "consecutive_jaccard": (consecutive_searches, CONSECUTIVE_SQL),
    "reformulation_rate": (reformulated, None),
    "seen_result_latest_match": (seen_results, SEEN_SQL),
    "zipped_pages": (zipped_pages, ZIP_SQL),
    "metric_totals": (metric_counts, COUNTS_SQL),
}

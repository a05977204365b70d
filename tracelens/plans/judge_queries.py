"""Judge records, support, policies, validation and bootstrap over the surrogate records, each with an independent oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.operators import bootstrap as B
from tracelens.operators import judge as J
from tracelens.operators import sampling as A
from tracelens.operators import support as S
from tracelens.operators import validation as V
from tracelens.plans.surrogates import JUDGE_SQL, judge_rows, table, traces

WITH = f"WITH {JUDGE_SQL}"


def _universe(spark: SparkSession, d: str) -> DataFrame:
    """Queries of each provider with their correctness: every order that the provider's line names, and one without judge rows."""
    lines = table(spark, d, "lineitem").select(F.concat(F.lit("p"), (F.col("l_suppkey") % 3).cast("string")).alias("provider_id"), F.concat(F.lit("q"), F.col("l_orderkey").cast("string")).alias("query_id"), (F.col("l_orderkey") % 4 == 0).alias("correct")).distinct()
    silent = lines.filter("query_id LIKE '%7'").select("provider_id", F.concat("query_id", F.lit("x")).alias("query_id"), F.lit(True).alias("correct"))
    return lines.filter("query_id NOT LIKE '%9'").unionByName(silent)


UNIVERSE_SQL = """
uni AS (SELECT DISTINCT 'p' || (l_suppkey % 3) AS provider_id, 'q' || l_orderkey AS query_id, l_orderkey % 4 = 0 AS correct FROM lineitem WHERE l_orderkey % 10 <> 9 UNION ALL SELECT DISTINCT 'p' || (l_suppkey % 3), 'q' || l_orderkey || 'x', TRUE FROM lineitem WHERE l_orderkey % 10 = 7)"""
SUPPORT = f"""{WITH}, {UNIVERSE_SQL}, v AS (SELECT *, 'q' || q AS query_id, in_snippets OR (seen AND contains_gold) AS pre FROM judge WHERE valid),
pu AS (SELECT provider_id, query_id, url, bool_or(pre) AS pre, bool_or(NOT seen) AS fetched, bool_or(NOT seen AND in_page) AS page, bool_or(contains_gold) AS legacy, count_if(pre) AS pre_rows, count_if(seen) AS snippet_rows, count_if(NOT seen) AS page_rows, count_if(NOT seen AND in_page) AS page_gold_rows,
  count_if(pre AND rank = 1) AS rank1, count_if(seen AND contra) AS contra_rows, count_if(seen AND contains_gold) AS gold_rows FROM v GROUP BY ALL),
s AS (SELECT u.provider_id, u.query_id, u.correct, coalesce(bool_or(pre), FALSE) AS pre, coalesce(bool_or(page), FALSE) AS page, coalesce(bool_or(fetched), FALSE) AS fetched, coalesce(bool_or(legacy), FALSE) AS legacy, coalesce(bool_or(pre AND fetched), FALSE) AS opened_pre,
  coalesce(sum(pre_rows), 0) AS pre_rows, coalesce(sum(snippet_rows), 0) AS snippet_rows, coalesce(sum(page_rows), 0) AS page_rows, coalesce(sum(page_gold_rows), 0) AS page_gold_rows, coalesce(count_if(page), 0) AS page_urls, coalesce(sum(rank1), 0) AS rank1, coalesce(sum(contra_rows), 0) AS contra_rows, coalesce(sum(gold_rows), 0) AS gold_rows
  FROM uni u LEFT JOIN pu ON pu.provider_id = u.provider_id AND pu.query_id = u.query_id GROUP BY 1, 2, 3)"""


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return S.query_support(judge_rows(spark, d), _universe(spark, d))


def support_report(spark: SparkSession, d: str) -> DataFrame:
    rows = S.provider_support(_queries(spark, d))
    return rows.withColumns({c: F.round(c, 6) for c in ("contradiction_ratio", "rank1_share")})


SUPPORT_SQL = f"""{SUPPORT} SELECT provider_id, count(*) AS queries, count_if(pre) AS pre_support_q, count_if(NOT pre AND page) AS post_discovered_q, count_if(pre OR page) AS trajectory_q, count_if(legacy) AS legacy_q, CAST(sum(snippet_rows) AS BIGINT) AS snippet_rows, CAST(sum(page_rows) AS BIGINT) AS page_rows, CAST(sum(pre_rows) AS BIGINT) AS pre_rows,
  CAST(sum(page_gold_rows) AS BIGINT) AS page_gold_rows, CAST(sum(CASE WHEN NOT pre AND page THEN page_gold_rows ELSE 0 END) AS BIGINT) AS post_rows, CAST(sum(CASE WHEN NOT pre AND page THEN page_urls ELSE 0 END) AS BIGINT) AS post_urls,
  round(sum(contra_rows) / CAST(sum(gold_rows) AS DOUBLE), 6) AS contradiction_ratio, round(100 * sum(rank1) / CAST(sum(pre_rows) AS DOUBLE), 6) AS rank1_share FROM s GROUP BY provider_id"""
CELL = "CASE WHEN pre AND opened_pre THEN 'SMART' WHEN pre THEN 'MISSED' WHEN fetched THEN 'BLIND' ELSE 'NOOP' END"


def cell_partition(spark: SparkSession, d: str) -> DataFrame:
    return S.partition(_queries(spark, d)).withColumn("rate", F.round("rate", 4))


PARTITION_SQL = f"""{SUPPORT}, c AS (SELECT provider_id, cell FROM (SELECT DISTINCT provider_id FROM s) p CROSS JOIN (VALUES ('SMART'), ('MISSED'), ('BLIND'), ('NOOP')) x(cell)), t AS (SELECT *, {CELL} AS cell FROM s)
SELECT c.provider_id, c.cell, count(t.query_id) AS queries, count_if(t.correct) AS correct, round(count_if(t.correct) / nullif(CAST(count(t.query_id) AS DOUBLE), 0), 4) AS rate FROM c LEFT JOIN t ON t.provider_id = c.provider_id AND t.cell = c.cell GROUP BY 1, 2"""


def query_support(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select("provider_id", "query_id", "pre_support", "post_discovered", "trajectory", "legacy", "cell", "page_gold_urls", "snippet_rows", "page_rows")


QUERY_SQL = f"{SUPPORT} SELECT provider_id, query_id, pre AS pre_support, NOT pre AND page AS post_discovered, pre OR page AS trajectory, legacy, {CELL} AS cell, page_urls AS page_gold_urls, CAST(snippet_rows AS BIGINT) AS snippet_rows, CAST(page_rows AS BIGINT) AS page_rows FROM s"


def support_invariants(spark: SparkSession, d: str) -> DataFrame:
    return S.assert_checks(S.checks(_queries(spark, d)))


INVARIANTS_SQL = f"{SUPPORT} SELECT provider_id, count(*) > 0 AS complete, sum(CASE WHEN {CELL} IN ('SMART', 'MISSED', 'BLIND', 'NOOP') THEN 1 ELSE 0 END) = count(*) AS cells_partition, count_if(pre AND NOT pre AND page) = 0 AS disjoint, count_if(pre) + count_if(NOT pre AND page) = count_if(pre OR page) AS union_is_trajectory FROM s GROUP BY provider_id"


def complementarity_regions(spark: SparkSession, d: str) -> DataFrame:
    return S.complementarity(_queries(spark, d).select("provider_id", "query_id", F.col("pre_support").alias("correct")), ["p2", "p0", "p1"])


REGIONS_SQL = f"""{SUPPORT}, q AS (SELECT query_id, bool_or(provider_id = 'p2' AND pre) AS a, bool_or(provider_id = 'p0' AND pre) AS b, bool_or(provider_id = 'p1' AND pre) AS c FROM s GROUP BY query_id)
SELECT concat_ws('_', CASE WHEN a THEN 'p2' END, CASE WHEN b THEN 'p0' END, CASE WHEN c THEN 'p1' END) AS region, count(*) AS queries FROM q GROUP BY 1"""


def _policy(spark: SparkSession, d: str) -> DataFrame:
    rows = judge_rows(spark, d)
    return S.simulate(S.url_states(rows), S.imputed_tokens(rows))


def policy_rows(spark: SparkSession, d: str) -> DataFrame:
    return _policy(spark, d)


POLICY = f"""{WITH}, v AS (SELECT *, 'q' || q AS query_id, 'https://a.example/' || url AS u, NOT seen AND l_partkey % 7 <> 0 AS known FROM judge WHERE valid),
imp AS (SELECT provider_id, CAST(round_even(coalesce(median(nullif(tokens, 0)), median(tokens), 0), 0) AS BIGINT) AS imputed FROM v WHERE known GROUP BY provider_id),
st AS (SELECT provider_id, query_id, u, min(rank) AS rank, min(seq) AS first_seen, bool_or(in_snippets OR (seen AND contains_gold)) AS pre, bool_or(NOT seen AND in_page) AS page, bool_or(NOT seen) AS fetched, bool_or(seen AND contra) AS sc, bool_or(NOT seen AND contra) AS oc, max_by(tokens, seq * 100 + tokens) FILTER (WHERE known) AS tokens FROM v GROUP BY 1, 2, 3),
o AS (SELECT st.*, imputed, row_number() OVER (PARTITION BY st.provider_id, query_id ORDER BY rank, first_seen, u) AS rn FROM st LEFT JOIN imp ON imp.provider_id = st.provider_id),
f AS (SELECT provider_id, query_id, min(rn) FILTER (WHERE pre OR page) AS fa, min(rn) FILTER (WHERE page) AS fp, bool_or(pre) AS ap, bool_or(page) AS apg, bool_or(sc) AS asc_ FROM o GROUP BY 1, 2),
x AS (SELECT o.*, f.ap, f.apg, f.asc_, p.policy, CASE p.policy WHEN 'snippet_only' THEN FALSE WHEN 'fetch_rank_1' THEN rn = 1 WHEN 'fetch_top_3' THEN rn < 4 WHEN 'fetch_top_5' THEN rn < 6 WHEN 'observed_agent_policy' THEN fetched WHEN 'oracle_fetch_if_any_support' THEN coalesce(rn = fa, FALSE) ELSE NOT ap AND coalesce(rn = fp, FALSE) END AS sel
  FROM o JOIN f ON f.provider_id = o.provider_id AND f.query_id = o.query_id CROSS JOIN (VALUES ('snippet_only'), ('fetch_rank_1'), ('fetch_top_3'), ('fetch_top_5'), ('observed_agent_policy'), ('oracle_fetch_if_any_support'), ('oracle_fetch_if_needed')) p(policy)),
r AS (SELECT provider_id, query_id, policy, ap OR bool_or(page AND sel) AS captured, ap AS pre_support, bool_or(page AND sel) AS page_support, NOT ap AND bool_or(page AND sel) AS incremental, ap OR apg AS trajectory, count_if(sel) AS fetches, CAST(sum(CASE WHEN sel THEN coalesce(tokens, imputed) ELSE 0 END) AS BIGINT) AS tokens, count_if(sel AND tokens IS NULL) AS imputed_fetches,
  asc_ AS surface_contradiction, bool_or(sel AND (sc OR oc)) AS opened_contradiction, coalesce(string_agg(CASE WHEN sel THEN u END, ';' ORDER BY rn), '') AS selected_urls FROM x GROUP BY provider_id, query_id, policy, ap, apg, asc_)"""
POLICY_SQL = f"{POLICY} SELECT * FROM r"


def policy_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.summarize_policies(_policy(spark, d)).withColumns({c: F.round(c, 3) for c in ("avg_fetches", "support_per_fetch", "incremental_per_fetch")})


POLICY_SUMMARY_SQL = f"""{POLICY} SELECT provider_id, policy, count(*) AS queries, count_if(captured) AS support_captured, count_if(incremental) AS incremental_support, count_if(surface_contradiction) AS surface_contradictions, count_if(opened_contradiction) AS opened_contradictions, CAST(sum(fetches) AS BIGINT) AS fetches, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(imputed_fetches) AS BIGINT) AS imputed_fetches,
  CAST(round_even(100.0 * count_if(captured) / count(*), 0) AS BIGINT) AS support_captured_pct, CAST(round_even(CAST(sum(fetches) AS DOUBLE) / count(*), 2) AS DOUBLE) AS avg_fetches, CAST(round_even(count_if(captured) / nullif(CAST(sum(fetches) AS DOUBLE), 0), 3) AS DOUBLE) AS support_per_fetch, CAST(round_even(count_if(incremental) / nullif(CAST(sum(fetches) AS DOUBLE), 0), 3) AS DOUBLE) AS incremental_per_fetch,
  CAST(round_even(CAST(sum(tokens) AS DOUBLE) / count(*), 0) AS BIGINT) AS tokens_per_query FROM r GROUP BY provider_id, policy"""


def url_state_fold(spark: SparkSession, d: str) -> DataFrame:
    return S.url_states(judge_rows(spark, d)).select("provider_id", "query_id", "u", F.col("rank").cast("long").alias("rank"), "pre", "page", "fetched", "surface_contra", "opened_contra", "tokens")


STATE_SQL = f"{POLICY} SELECT provider_id, query_id, u, CAST(rank AS BIGINT) AS rank, pre, page, fetched, sc AS surface_contra, oc AS opened_contra, tokens FROM st"


def judge_validity(spark: SparkSession, d: str) -> DataFrame:
    return judge_rows(spark, d).groupBy("provider_id").agg(F.count("*").alias("n"), F.count_if(J.valid()).alias("valid"), F.count_if(J.valid(True)).alias("runner_valid"), F.count_if(J.effective_garbage()).alias("garbage"), F.count_if(J.inferred_surface() == "page_visible").alias("pages"))


VALIDITY_SQL = f"{WITH} SELECT provider_id, count(*) AS n, count_if(valid) AS valid, count_if(valid AND named) AS runner_valid, count_if(l_partkey % 13 = 0 OR (l_partkey % 17 = 0 AND l_partkey % 71 <> 0)) AS garbage, count_if(NOT seen) AS pages FROM judge GROUP BY provider_id"


def judge_summary(spark: SparkSession, d: str) -> DataFrame:
    return J.summary(judge_rows(spark, d), ["provider_id"]).select("provider_id", "records", "queries", F.round("avg_confidence", 3).alias("avg_confidence"), "contains_gold", "gold_in_snippets", "gold_in_extracted_page", "only_in_snippets", "only_in_page", "in_both", "contradicts_gold", "precheck_garbage", "judge_garbage", "execution_error", "parse_error", "contains_gold_pct", "in_both_pct")


SUMMARY_SQL = f"""{WITH} SELECT provider_id, count(*) AS records, count(DISTINCT q) AS queries, CAST(round_even(avg(CASE WHEN l_partkey % 71 <> 0 THEN l_partkey % 4 * 0.25 END), 3) AS DOUBLE) AS avg_confidence, count_if(contains_gold) AS contains_gold, count_if(in_snippets) AS gold_in_snippets, count_if(in_page) AS gold_in_extracted_page, count_if(in_snippets AND NOT in_page) AS only_in_snippets, count_if(in_page AND NOT in_snippets) AS only_in_page,
  count_if(in_snippets AND in_page) AS in_both, count_if(contra) AS contradicts_gold, count_if(l_partkey % 13 = 0) AS precheck_garbage, count_if(l_partkey % 17 = 0 AND l_partkey % 71 <> 0) AS judge_garbage, count_if(l_partkey % 79 = 0) AS execution_error, count_if(FALSE) AS parse_error,
  CAST(round_even(100.0 * count_if(contains_gold) / count(*), 1) AS DOUBLE) AS contains_gold_pct, CAST(round_even(100.0 * count_if(in_snippets AND in_page) / count(*), 1) AS DOUBLE) AS in_both_pct FROM judge GROUP BY provider_id"""


def _cache(spark: SparkSession, d: str) -> DataFrame:
    """Records of an earlier run: those of even orders, every third with another prompt."""
    rows = judge_rows(spark, d).filter("CAST(substr(query_id, 2) AS BIGINT) % 2 = 0")
    other = F.array(F.struct(F.lit("user").alias("role"), F.lit("other").alias("content")))
    return rows.withColumn("messages", F.when(F.expr("CAST(substr(query_id, 2) AS BIGINT) % 3 = 0"), other).otherwise(F.col("messages")))


def judge_exact_cache(spark: SparkSession, d: str) -> DataFrame:
    return J.exact_cache(judge_rows(spark, d), _cache(spark, d)).groupBy("provider_id").agg(F.count("*").alias("hits"))


CACHE = f"""{WITH}, full_key AS (SELECT *, 'https://a.example/' || url || '?utm_source=x' AS shown, CASE WHEN q % 3 = 0 THEN 'other' ELSE l_returnflag END AS cached_prompt FROM judge),
known AS (SELECT provider_id, q, rank, shown, max_by(cached_prompt, seq) AS cached_prompt FROM full_key WHERE valid AND named AND q % 2 = 0 GROUP BY 1, 2, 3, 4),
hit AS (SELECT DISTINCT j.seq, j.provider_id, j.l_returnflag, j.l_partkey, j.l_quantity, j.l_linestatus FROM full_key j JOIN known k ON k.provider_id = j.provider_id AND k.q = j.q AND k.rank = j.rank AND k.shown = j.shown WHERE j.named AND l_partkey % 83 <> 0 AND j.l_returnflag = k.cached_prompt)"""
CACHE_SQL = f"{CACHE}, h AS (SELECT j.provider_id FROM full_key j JOIN known k ON k.provider_id = j.provider_id AND k.q = j.q AND k.rank = j.rank AND k.shown = j.shown WHERE j.named AND l_partkey % 83 <> 0 AND j.l_returnflag = k.cached_prompt) SELECT provider_id, count(*) AS hits FROM h GROUP BY provider_id"


def fetch_match(spark: SparkSession, d: str) -> DataFrame:
    """J5 over lines: a line is a result of its order and number; every fourth part was fetched, under its document, URL or rank."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trace_id"), F.lit("it1").alias("retrieval_id"), F.col("l_linenumber").alias("rank"), "l_partkey", "l_suppkey", "l_returnflag").distinct()
    shown = lambda c: F.concat(F.lit("d"), F.col(c).cast("string"))
    results = lines.select("trace_id", "retrieval_id", F.when(F.col("l_partkey") % 3 != 0, shown("l_partkey")).alias("document_id"), F.col("rank").alias("rank"), F.concat(F.lit("u"), (F.col("l_suppkey") % 5).cast("string")).alias("url"), "l_partkey").distinct()
    fetches = lines.filter("l_partkey % 4 = 0").select("trace_id", "retrieval_id", F.when(F.col("l_partkey") % 8 == 0, shown("l_partkey")).otherwise("other").alias("document_id"), F.concat(F.lit("u"), (F.col("l_suppkey") % 5).cast("string")).alias("url"), (F.col("rank") + 1).alias("rank"), F.concat(F.lit("f"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string")).alias("fetch_id"), (F.col("l_suppkey") % 2).cast("int").alias("iteration_num"), F.when(F.col("l_returnflag") == "A", "success").otherwise("failed").alias("fetch_status")).distinct()
    found = J.match_fetches(results.select("trace_id", "retrieval_id", "document_id", "rank", "url").distinct(), fetches)
    return found.select("trace_id", F.coalesce("document_id", F.lit("-")).alias("document_id"), F.col("rank").cast("long").alias("rank"), "url", "fetch_id", "fetch_status", "model_fetched_document")


FETCH_SQL = """WITH r AS (SELECT DISTINCT l_orderkey AS trace_id, CASE WHEN l_partkey % 3 <> 0 THEN 'd' || l_partkey END AS document_id, l_linenumber AS rank, 'u' || (l_suppkey % 5) AS url FROM lineitem),
f AS (SELECT DISTINCT l_orderkey AS trace_id, CASE WHEN l_partkey % 8 = 0 THEN 'd' || l_partkey ELSE 'other' END AS document_id, 'u' || (l_suppkey % 5) AS url, l_linenumber + 1 AS rank, 'f' || l_partkey || '_' || l_suppkey AS fetch_id, l_suppkey % 2 AS it, CASE WHEN l_returnflag = 'A' THEN 'success' ELSE 'failed' END AS status FROM lineitem WHERE l_partkey % 4 = 0),
m AS (SELECT r.*, f.fetch_id, f.status, row_number() OVER (PARTITION BY r.trace_id, r.document_id, r.rank, r.url ORDER BY CASE WHEN f.document_id = r.document_id THEN 0 ELSE 1 END, CASE WHEN f.status = 'success' THEN 0 ELSE 1 END, f.it, f.fetch_id) AS rn
  FROM r LEFT JOIN f ON f.trace_id = r.trace_id AND (f.document_id = r.document_id OR f.url = r.url OR f.rank = r.rank))
SELECT trace_id, coalesce(document_id, '-') AS document_id, CAST(rank AS BIGINT) AS rank, url, fetch_id, status AS fetch_status, fetch_id IS NOT NULL AS model_fetched_document FROM m WHERE rn = 1"""


def judge_record_build(spark: SparkSession, d: str) -> DataFrame:
    """P12 over the surrogate traces: records by surface, source and precheck."""
    rows = J.judge_records(traces(spark, d))
    return rows.groupBy("provider_id", "judge_surface_class", "page_fetch_source", F.col("document_garbage_precheck.category").alias("category")).agg(F.count("*").alias("n"), F.count_if("model_fetched_document").alias("fetched"), F.count_distinct("normalized_url").alias("urls"), (F.count("judge_snippet_surface_signature") > 0).alias("signed"))


def judge_documents(spark: SparkSession, d: str) -> DataFrame:
    """Records nested by search, documents by rank; here each search's first and last rank and their number."""
    rows = J.by_retrieval(judge_rows(spark, d).filter("retrieval_id IS NOT NULL"))
    return rows.select("provider_id", "query_id", "retrieval_id", F.size("documents").cast("long").alias("n"), F.get("documents", F.lit(0))["rank"].cast("long").alias("first_rank"), F.array_join(F.transform("documents", lambda x: x["judge_surface_class"]), ",").alias("surfaces"))


DOCUMENTS_SQL = f"""{WITH} SELECT provider_id, 'q' || q AS query_id, 'it' || rank AS retrieval_id, count(*) AS n, CAST(min(rank) AS BIGINT) AS first_rank, string_agg(CASE WHEN seen THEN 'snippet_only' ELSE 'page_visible' END, ',' ORDER BY rank, CASE WHEN l_partkey % 83 <> 0 THEN 'https://a.example/' || url || '?utm_source=x' END NULLS FIRST, CASE WHEN seen THEN 'snippet_only' ELSE 'page_visible' END) AS surfaces
FROM judge WHERE named GROUP BY 1, 2, 3"""


def validation_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = J.unpivot(judge_rows(spark, d).filter(J.valid()))
    return rows.groupBy("provider_id", "judge_surface_class", "label", "value").agg(F.count("*").alias("n"), F.min("case_id").alias("first_case"))


CASES = f"""{WITH}, cases AS (SELECT provider_id, CASE WHEN seen THEN 'snippet_only' ELSE 'page_visible' END AS surface, x.label, x.value, provider_id || '__q' || q || '__' || CASE WHEN named THEN 'it' || rank ELSE '' END || '__r' || rank || '__' || CASE WHEN seen THEN 'snippet_only' ELSE 'page_visible' END || '__' || x.label AS case_id
  FROM judge, LATERAL (VALUES ('snippet_gold', in_snippets), ('page_gold', in_page), ('contradiction', contra)) x(label, value) WHERE valid)"""
CASES_SQL = f"{CASES} SELECT provider_id, surface AS judge_surface_class, label, value, count(*) AS n, min(case_id) AS first_case FROM cases GROUP BY 1, 2, 3, 4"


def _progress(cases: DataFrame) -> DataFrame:
    """Human labels made from the case's digest: a third true, a third false, some unclear, others none."""
    digest = F.conv(F.substring(F.md5(F.col("case_id").cast("binary")), 1, 4), 16, 10).cast("long") % 7
    rows = cases.groupBy("case_id").agg(F.max(digest).alias("h"))  # a value of the group: filters on it don't reach below
    h = F.col("h")
    value = F.when(h < 2, "true").when(h < 4, "false").when(h == 4, "unclear").otherwise("")
    return rows.select("case_id", value.alias("human_value"), F.when(h % 2 == 0, "p" + "attern").otherwise("").alias("pattern"))


def _case_rows(spark: SparkSession, d: str) -> DataFrame:
    return J.merged_cases(judge_rows(spark, d).filter(J.valid()))


CASE_ROWS = f"""{CASES}, c AS (SELECT case_id, provider_id, surface, label, bool_or(value) AS machine FROM cases GROUP BY 1, 2, 3, 4),
h AS (SELECT *, ('0x' || substr(md5(case_id), 1, 4))::BIGINT % 7 AS h FROM c), l AS (SELECT *, CASE WHEN h < 2 THEN TRUE WHEN h < 4 THEN FALSE END AS human, h <= 4 AS done, CASE WHEN h % 2 = 0 THEN 'pattern' ELSE 'unspecified' END AS pattern FROM h)"""


def agreement_report(spark: SparkSession, d: str) -> DataFrame:
    cases = _case_rows(spark, d)
    return V.agreement_report(cases, _progress(cases)).withColumn("agreement_rate", F.round("agreement_rate", 6))


AGREEMENT_SQL = f"""{CASE_ROWS}, g AS (SELECT CASE WHEN grouping(label) = 0 THEN 'label' WHEN grouping(provider_id) = 0 THEN 'provider' WHEN grouping(surface) = 0 THEN 'surface' ELSE 'all' END AS kind, coalesce(label, provider_id, surface, 'all') AS name, count(*) AS sampled, count_if(done) AS reviewed, count_if(human IS NOT NULL) AS clear, count_if(done AND human IS NULL) AS unclear, count_if(human = machine) AS agree, count_if(human <> machine) AS disagree,
  count_if(human <> machine AND pattern = 'pattern') AS a, count_if(human <> machine AND pattern <> 'pattern') AS b, round(CASE WHEN count_if(human IS NOT NULL) > 0 THEN count_if(human = machine) / CAST(count_if(human IS NOT NULL) AS DOUBLE) END, 6) AS agreement_rate FROM l GROUP BY GROUPING SETS ((label), (provider_id), (surface), ()))
SELECT kind, name, sampled, reviewed, clear, unclear, agree, disagree, agreement_rate, CASE WHEN a + b = 0 THEN '' WHEN a >= b THEN 'pattern' ELSE 'unspecified' END AS top_pattern FROM g"""


def quota_report(spark: SparkSession, d: str) -> DataFrame:
    cases = _case_rows(spark, d)
    return V.quotas(cases, _progress(cases), 5)


QUOTA_SQL = f"""{CASE_ROWS}, dims AS (SELECT p.provider_id, x.label, s.surface, m.machine FROM (SELECT DISTINCT provider_id FROM l) p CROSS JOIN (SELECT DISTINCT label FROM l) x CROSS JOIN (SELECT DISTINCT surface FROM l) s CROSS JOIN (VALUES (TRUE), (FALSE)) m(machine)),
leaf AS (SELECT dims.*, count(l.case_id) AS sampled, least(5, count(l.case_id)) AS target, count_if(l.done) AS reviewed FROM dims LEFT JOIN l ON l.provider_id = dims.provider_id AND l.label = dims.label AND l.surface = dims.surface AND l.machine = dims.machine GROUP BY 1, 2, 3, 4),
core AS (SELECT label, surface, machine, sum(sampled) AS sampled, sum(target) AS target, sum(reviewed) AS reviewed, sum(greatest(0, target - reviewed)) AS rest FROM leaf GROUP BY 1, 2, 3)
SELECT 'leaf' AS level, provider_id, label, surface, machine, sampled, target, reviewed, greatest(0, target - reviewed) AS remaining, reviewed >= target AS complete FROM leaf
UNION ALL SELECT 'core', NULL, label, surface, machine, CAST(sampled AS BIGINT), CAST(target AS BIGINT), CAST(reviewed AS BIGINT), CAST(greatest(0, target - reviewed) AS BIGINT), reviewed >= target FROM core
UNION ALL SELECT 'total', NULL, NULL, NULL, NULL, CAST(sum(sampled) AS BIGINT), CAST(sum(target) AS BIGINT), CAST(sum(least(reviewed, target)) AS BIGINT), CAST(sum(greatest(0, target - reviewed)) AS BIGINT), bool_and(reviewed >= target) FROM leaf"""


def balanced_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = J.unpivot(judge_rows(spark, d).filter(J.valid())).withColumnsRenamed({"judge_surface_class": "surface", "value": "machine"})
    return A.balanced_keys(rows, ["provider_id", "surface", "label"], "machine", "case_id", 8).select("case_id", "machine")


BALANCED_SQL = f"""{CASE_ROWS}, r AS (SELECT case_id, machine, provider_id, surface, label, md5('{A.SEED}:' || case_id) AS k, row_number() OVER (PARTITION BY provider_id, surface, label, machine ORDER BY md5('{A.SEED}:' || case_id), case_id) AS rn FROM c),
s AS (SELECT *, rn <= 4 AS chosen FROM r), n AS (SELECT provider_id, surface, label, 8 - count_if(chosen) AS lack FROM s GROUP BY 1, 2, 3),
t AS (SELECT s.*, lack, row_number() OVER (PARTITION BY s.provider_id, s.surface, s.label, chosen ORDER BY k, case_id) AS more FROM s JOIN n ON n.provider_id = s.provider_id AND n.surface = s.surface AND n.label = s.label)
SELECT case_id, machine FROM t WHERE chosen OR more <= lack"""


def bootstrap_metrics(spark: SparkSession, d: str) -> DataFrame:
    return B.intervals(_bootstrap_rows(spark, d)).withColumns({c: F.round(c, 6) for c in ("estimate", "low", "high")})


def _bootstrap_rows(spark: SparkSession, d: str) -> DataFrame:
    """Per provider and query, all providers' queries alike: users of events by type stand for the runs."""
    e = table(spark, d, "events")
    users, kinds = e.select("user_id").distinct(), spark.createDataFrame([("click",), ("view",), ("purchase",)], "provider_id string")
    n, value = F.count("event_id"), F.col("value")
    per = e.groupBy("user_id", F.col("event_type").alias("provider_id")).agg(n.alias("n"), F.count_if(value > 60).alias("high"), F.count_if(value > 30).alias("mid"), F.sum(F.floor("value").cast("long")).alias("tokens"))
    rows = users.crossJoin(F.broadcast(kinds)).join(per, ["user_id", "provider_id"], "left").na.fill(0)
    return rows.select("provider_id", F.lpad(F.col("user_id").cast("string"), 12, "0").alias("query_id"), (F.col("high") > 2).cast("long").alias("correct"), (F.col("high") / F.greatest("n", F.lit(1))).alias("token_f1"), (F.col("mid") > 3).cast("long").alias("pre_support"), F.col("high").alias("rank1_rows"), F.col("mid").alias("pre_rows"), (F.col("n") - F.col("mid")).alias("contra_rows"), F.col("n").alias("gold_rows"), (F.col("n") > 5).cast("long").alias("fetched"), F.col("n").alias("fetch_calls"), F.col("tokens").alias("tokens"), F.element_at(F.array(*[F.lit(c) for c in S.CELLS]), (F.col("n") % 4 + 1).cast("int")).alias("cell"))


BOOT = f"""WITH per AS (SELECT user_id, event_type AS provider_id, count(*) AS n, count_if(value > 60) AS high, count_if(value > 30) AS mid, CAST(sum(floor(value)) AS BIGINT) AS tokens FROM events GROUP BY 1, 2),
q AS (SELECT k.provider_id, u.user_id, u.pos, coalesce(n, 0) AS n, coalesce(high, 0) AS high, coalesce(mid, 0) AS mid, coalesce(tokens, 0) AS tokens FROM (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS pos FROM (SELECT DISTINCT user_id FROM events)) u CROSS JOIN (VALUES ('click'), ('view'), ('purchase')) k(provider_id) LEFT JOIN per ON per.user_id = u.user_id AND per.provider_id = k.provider_id),
size AS (SELECT count(DISTINCT pos) AS n FROM q), draw AS (SELECT rep, ('0x' || substr(h, 1 + 8 * k.range, 8))::BIGINT % n AS pos FROM (SELECT size.n, r.range AS rep, i.range AS i, md5('{B.SEED}:' || r.range || ':' || i.range) AS h FROM size, range({B.REPLICATES}) r, LATERAL (SELECT unnest(range((size.n + 3) // 4)) AS range) i) x, range(4) k WHERE 4 * i + k.range < n UNION ALL SELECT -1, unnest(range(n)) FROM size),
m AS (SELECT rep, provider_id, count(*) AS c, sum(CASE WHEN high > 2 THEN 1 ELSE 0 END) AS correct, sum(high / CAST(greatest(n, 1) AS DOUBLE)) / count(*) AS token_f1, sum(CASE WHEN mid > 3 THEN 1 ELSE 0 END) AS pre_support, 100 * sum(high) / nullif(CAST(sum(mid) AS DOUBLE), 0) AS rank1_share, sum(n - mid) / nullif(CAST(sum(n) AS DOUBLE), 0) AS contradiction_ratio, sum(CASE WHEN n > 5 THEN 1 ELSE 0 END) AS fetched, CAST(sum(n) AS DOUBLE) / count(*) AS fetch_calls, CAST(sum(tokens) AS DOUBLE) / count(*) AS tokens
  FROM draw JOIN q ON q.pos = draw.pos GROUP BY rep, provider_id),
long AS (SELECT rep, provider_id, x.metric, CAST(x.value AS DOUBLE) AS value FROM m, LATERAL (VALUES ('correct', CAST(correct AS DOUBLE)), ('token_f1', token_f1), ('pre_support', CAST(pre_support AS DOUBLE)), ('rank1_share', rank1_share), ('contradiction_ratio', contradiction_ratio), ('fetched', CAST(fetched AS DOUBLE)), ('fetch_calls', fetch_calls), ('tokens', tokens)) x(metric, value))"""
BOOTSTRAP_SQL = f"{BOOT} SELECT provider_id, metric, round(max(value) FILTER (WHERE rep = -1), 6) AS estimate, round(quantile_cont(value, 0.025) FILTER (WHERE rep >= 0), 6) AS low, round(quantile_cont(value, 0.975) FILTER (WHERE rep >= 0), 6) AS high FROM long GROUP BY 1, 2"


def bootstrap_pairs(spark: SparkSession, d: str) -> DataFrame:
    return B.differences(_bootstrap_rows(spark, d)).withColumns({c: F.round(c, 6) for c in ("estimate", "low", "high")})


PAIRS_SQL = f"{BOOT}, p AS (SELECT a.rep, a.provider_id AS provider_a, b.provider_id AS provider_b, a.metric, a.value - b.value AS value FROM long a JOIN long b ON a.rep = b.rep AND a.metric = b.metric AND a.provider_id < b.provider_id) SELECT provider_a, provider_b, metric, round(max(value) FILTER (WHERE rep = -1), 6) AS estimate, round(quantile_cont(value, 0.025) FILTER (WHERE rep >= 0), 6) AS low, round(quantile_cont(value, 0.975) FILTER (WHERE rep >= 0), 6) AS high FROM p GROUP BY 1, 2, 3"


def bootstrap_cells(spark: SparkSession, d: str) -> DataFrame:
    return B.cell_rates(_bootstrap_rows(spark, d)).withColumns({c: F.round(c, 6) for c in ("estimate", "low", "high")})


BOOT_CELLS_SQL = f"""{BOOT}, t AS (SELECT rep, provider_id, CASE n % 4 WHEN 0 THEN 'SMART' WHEN 1 THEN 'MISSED' WHEN 2 THEN 'BLIND' ELSE 'NOOP' END AS cell, count(*) AS c, sum(CASE WHEN high > 2 THEN 1 ELSE 0 END) AS ok FROM draw JOIN q ON q.pos = draw.pos GROUP BY 1, 2, 3)
SELECT provider_id, cell, CAST(max(c) FILTER (WHERE rep = -1) AS BIGINT) AS queries, CAST(max(ok) FILTER (WHERE rep = -1) AS BIGINT) AS correct, round(max(100.0 * ok / c) FILTER (WHERE rep = -1), 6) AS estimate, round(quantile_cont(100.0 * CAST(ok AS DOUBLE) / c, 0.025) FILTER (WHERE rep >= 0), 6) AS low, round(quantile_cont(100.0 * CAST(ok AS DOUBLE) / c, 0.975) FILTER (WHERE rep >= 0), 6) AS high FROM t GROUP BY 1, 2 HAVING count_if(rep = -1) > 0"""


def bootstrap_in_sequence(spark: SparkSession, d: str) -> DataFrame:
    """T7 with the draws of one Mersenne Twister, which SQL hasn't: tests hold it against Python's."""
    return B.intervals(_bootstrap_rows(spark, d), in_sequence=True).withColumns({c: F.round(c, 6) for c in ("estimate", "low", "high")})


def stratified_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return A.stratified(docs, ["lang", "source"], "doc_id", 100).select("doc_id", "lang", "source")


STRATIFIED = f"""WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), x AS (SELECT *, CAST(100 * n AS DOUBLE) / sum(n) OVER () AS x FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, n DESC, lang DESC, source DESC) AS rn, 100 - sum(least(n, floor(x))) OVER () AS rest FROM x),
a AS (SELECT lang, source, least(n, floor(x) + CASE WHEN rn <= rest THEN 1 ELSE 0 END) AS take FROM r),
s AS (SELECT doc_id, d.lang, d.source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5('{A.SEED}:' || doc_id), doc_id) AS k FROM documents) d JOIN a ON a.lang = d.lang AND a.source = d.source WHERE k <= take)"""
STRATIFIED_SQL = f"{STRATIFIED} SELECT * FROM s"


def sample_drift(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    sample = A.stratified(docs, ["lang", "source"], "doc_id", 100)
    parts = [A.drift(docs, sample, c).select(F.lit(c).alias("field"), F.col("value"), F.round("source_pct", 4).alias("source_pct"), F.round("sample_pct", 4).alias("sample_pct"), F.round("delta_pp", 4).alias("delta_pp")) for c in ("lang", "source")]
    return parts[0].unionByName(parts[1])


def _drift_sql(c: str) -> str:
    return f"SELECT '{c}' AS field, v AS value, round(coalesce(a, 0.0), 4) AS source_pct, round(coalesce(b, 0.0), 4) AS sample_pct, round(abs(coalesce(a, 0.0) - coalesce(b, 0.0)), 4) AS delta_pp FROM (SELECT {c} AS v, CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM documents) AS a FROM documents GROUP BY 1) FULL JOIN (SELECT {c} AS v, CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM s) AS b FROM s GROUP BY 1) USING (v)"


DRIFT_SQL = f"{STRATIFIED} {_drift_sql('lang')} UNION ALL {_drift_sql('source')}"


def list_prevalence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("flags"))
    return A.prevalence(rows, "flags").unionByName(A.distribution(rows, "flags").select(F.concat(F.lit("all "), "value").alias("value"), "n"))


PREVALENCE_SQL = "SELECT l_returnflag AS value, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT 'all ' || l_returnflag, count(*) FROM lineitem GROUP BY 1"


def merged_labels(spark: SparkSession, d: str) -> DataFrame:
    """K7: a new sample of cases that keeps the labels of the old sheet."""
    cases = _case_rows(spark, d).select("case_id", "machine")
    return V.merge_labels(cases, _progress(cases).filter("human_value <> ''")).groupBy("human_value").agg(F.count("*").alias("n"))


MERGED_SQL = f"{CASE_ROWS} SELECT CASE WHEN h < 2 THEN 'true' WHEN h < 4 THEN 'false' WHEN h = 4 THEN 'unclear' ELSE '' END AS human_value, count(*) AS n FROM l GROUP BY 1"

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "support_report": (support_report, SUPPORT_SQL),
    "cell_partition": (cell_partition, PARTITION_SQL),
    "query_support": (query_support, QUERY_SQL),
    "support_invariants": (support_invariants, INVARIANTS_SQL),
    "complementarity_regions": (complementarity_regions, REGIONS_SQL),
    "policy_rows": (policy_rows, POLICY_SQL),
    "policy_summary": (policy_summary, POLICY_SUMMARY_SQL),
    "url_state_fold": (url_state_fold, STATE_SQL),
    "judge_validity": (judge_validity, VALIDITY_SQL),
    "judge_summary": (judge_summary, SUMMARY_SQL),
    "judge_exact_cache": (judge_exact_cache, CACHE_SQL),
    "fetch_match_best": (fetch_match, FETCH_SQL),
    "judge_documents": (judge_documents, DOCUMENTS_SQL),
    "validation_cases": (validation_cases, CASES_SQL),
    "agreement_report": (agreement_report, AGREEMENT_SQL),
    "quota_report": (quota_report, QUOTA_SQL),
    "balanced_cases": (balanced_cases, BALANCED_SQL),
    "bootstrap_metrics": (bootstrap_metrics, BOOTSTRAP_SQL),
    "bootstrap_pairwise": (bootstrap_pairs, PAIRS_SQL),
    "bootstrap_cells": (bootstrap_cells, BOOT_CELLS_SQL),
    "bootstrap_in_sequence": (bootstrap_in_sequence, None),
    "stratified_documents": (stratified_documents, STRATIFIED_SQL),
    "sample_drift": (sample_drift, DRIFT_SQL),
    "list_prevalence": (list_prevalence, PREVALENCE_SQL),
    "merged_labels": (merged_labels, MERGED_SQL),
}

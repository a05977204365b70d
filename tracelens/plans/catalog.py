"""Every query of the trace analytics over the driver's tables, with its oracle.

The tables stand in for traces: an event is a run (event_type the provider, user_id the question, value its tokens, event_id the
line number), a page or document a retrieved result, a benchmark item a gold answer. A query in SQL that both engines read the
same is its own oracle text, run by two engines; {name} marks a table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelens.operators import bootstrap as B
from tracelens.operators import relational as R
from tracelens.operators.quantiles import LINEAR, quantiles
from tracelens.operators.sampling import apportion
from tracelens.operators.search import containment
from tracelens.plans import io_queries, judge_queries, prompt_queries, text_queries, trace_queries
from tracelens.plans.text_queries import norm_sql

FLAGSHIP = "provider_report"

RUNS = "SELECT event_type AS provider, user_id AS query_id, event_id AS line_num, value AS tokens, value > 60 AS correct, event_id % 7 = 0 AS failed FROM {events}"
LATEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider, query_id ORDER BY line_num DESC) AS rn FROM ({RUNS}) r) x WHERE rn = 1"
#: A URL's state for the fetch policies: rank, support before and after the fetch, contradiction, fetched, page tokens.
URLS = "SELECT user_id AS query_id, event_type AS provider, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS rn, event_id % 11 = 0 AS pre, event_id % 5 = 0 AS page, event_id % 13 = 0 AS contra, event_id % 4 = 0 AS fetched, CAST(floor(value) AS BIGINT) AS tokens FROM {events}"
STATES = f"SELECT provider, query_id, bool_or(pre) AS any_pre, bool_or(page) AS any_page, bool_or(fetched) AS any_fetched, bool_or(pre AND fetched) AS pre_fetched, count(*) AS n_urls FROM ({URLS}) u GROUP BY provider, query_id"

SQL = {
    "provider_summary": f"""
        SELECT provider, count(*) AS queries, count_if(correct) AS correct, count_if(failed) AS failed,
          round(avg(tokens), 4) AS avg_tokens, round(median(tokens), 4) AS median_tokens, round(max(tokens), 4) AS max_tokens,
          round(percentile_disc(0.9) WITHIN GROUP (ORDER BY tokens), 4) AS p90_tokens, count_if(tokens > 50) AS over_50, count_if(tokens > 90) AS over_90
        FROM ({LATEST}) l GROUP BY provider""",
    "reliability": f"""
        SELECT h.provider, count(*) AS runs, count_if(h.failed) AS failed_runs, count_if(l.failed AND l.line_num = h.line_num) AS latest_failed,
          count_if(h.failed AND NOT l.failed) AS recovered
        FROM ({RUNS}) h JOIN ({LATEST}) l ON h.provider = l.provider AND h.query_id = l.query_id GROUP BY h.provider""",
    "pairwise_outcomes": f"""
        SELECT a.provider AS provider_a, b.provider AS provider_b,
          CASE WHEN a.correct AND b.correct THEN 'both_correct' WHEN a.correct THEN 'a_only' WHEN b.correct THEN 'b_only' ELSE 'both_wrong' END AS outcome, count(*) AS n
        FROM ({LATEST}) a JOIN ({LATEST}) b ON a.query_id = b.query_id AND a.provider < b.provider GROUP BY 1, 2, 3""",
    "multiway_outcomes": f"""
        SELECT n_providers, n_correct, count(*) AS queries FROM (SELECT query_id, count(DISTINCT provider) AS n_providers, count_if(correct) AS n_correct FROM ({LATEST}) l GROUP BY query_id) q
        WHERE n_providers >= 3 GROUP BY n_providers, n_correct""",
    "complementarity": f"""
        SELECT region, count(*) AS queries FROM (SELECT query_id, concat_ws('_', max(CASE WHEN provider = 'click' AND correct THEN 'click' END), max(CASE WHEN provider = 'view' AND correct THEN 'view' END),
          max(CASE WHEN provider = 'signup' AND correct THEN 'signup' END)) AS region FROM ({LATEST}) l GROUP BY query_id) q GROUP BY region""",
    "best_single_and_oracle": f"""
        SELECT (SELECT max(n) FROM (SELECT count_if(correct) AS n FROM ({LATEST}) l GROUP BY provider) p) AS best_single, (SELECT count(*) FROM (SELECT query_id FROM ({LATEST}) l GROUP BY query_id HAVING bool_or(correct)) q) AS oracle_router""",
    "decision_partition": f"""
        WITH s AS (SELECT provider, query_id, CASE WHEN any_pre AND pre_fetched THEN 'SMART' WHEN any_pre THEN 'MISSED' WHEN any_fetched THEN 'BLIND' ELSE 'NOOP' END AS cell, any_page AS correct FROM ({STATES}) t),
        cells AS (SELECT p.provider, c.cell FROM (SELECT DISTINCT provider FROM s) p CROSS JOIN (SELECT 'SMART' AS cell UNION ALL SELECT 'MISSED' UNION ALL SELECT 'BLIND' UNION ALL SELECT 'NOOP') c)
        SELECT cells.provider, cells.cell, count(s.query_id) AS queries, coalesce(count_if(s.correct), 0) AS correct, round(coalesce(count_if(s.correct), 0) / nullif(CAST(count(s.query_id) AS DOUBLE), 0), 4) AS rate
        FROM cells LEFT JOIN s ON s.provider = cells.provider AND s.cell = cells.cell GROUP BY cells.provider, cells.cell""",
    "support_split": f"""
        SELECT provider, count_if(any_pre) AS pre_support, count_if(NOT any_pre AND any_page) AS post_discovered, count_if(any_pre OR any_page) AS trajectory, sum(n_urls) AS urls FROM ({STATES}) s GROUP BY provider""",
    "policy_ablation": f"""
        WITH u AS (SELECT *, min(CASE WHEN pre OR page THEN rn END) OVER (PARTITION BY provider, query_id) AS first_any, min(CASE WHEN page THEN rn END) OVER (PARTITION BY provider, query_id) AS first_page,
            max(CASE WHEN pre THEN 1 ELSE 0 END) OVER (PARTITION BY provider, query_id) AS has_pre FROM ({URLS}) x),
        p AS (SELECT 'snippet_only' AS policy UNION ALL SELECT 'fetch_rank_1' UNION ALL SELECT 'fetch_top_3' UNION ALL SELECT 'fetch_top_5' UNION ALL SELECT 'observed_agent_policy' UNION ALL SELECT 'oracle_fetch_if_any_support' UNION ALL SELECT 'oracle_fetch_if_needed'),
        s AS (SELECT u.*, p.policy, coalesce(CASE p.policy WHEN 'fetch_rank_1' THEN rn <= 1 WHEN 'fetch_top_3' THEN rn <= 3 WHEN 'fetch_top_5' THEN rn <= 5 WHEN 'observed_agent_policy' THEN fetched
            WHEN 'oracle_fetch_if_any_support' THEN rn = first_any WHEN 'oracle_fetch_if_needed' THEN has_pre = 0 AND rn = first_page ELSE FALSE END, FALSE) AS selected FROM u CROSS JOIN p),
        q AS (SELECT provider, policy, query_id, bool_or(pre) OR bool_or(page AND selected) AS captured, NOT bool_or(pre) AND bool_or(page AND selected) AS incremental, count_if(selected) AS fetches,
            sum(CASE WHEN selected THEN tokens ELSE 0 END) AS tokens, bool_or(contra AND selected) AS opened_contra FROM s GROUP BY provider, policy, query_id)
        SELECT provider, policy, count(*) AS queries, count_if(captured) AS captured, count_if(incremental) AS incremental, sum(fetches) AS fetches, sum(tokens) AS fetch_tokens, count_if(opened_contra) AS contradictions,
          round(count_if(captured) / nullif(CAST(sum(fetches) AS DOUBLE), 0), 4) AS support_per_fetch FROM q GROUP BY provider, policy""",
    "resume_anti_join": "SELECT o.o_orderkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey)",
    "semi_join_universe": "SELECT event_type, count(*) AS n FROM {events} e WHERE EXISTS (SELECT 1 FROM {customer} c WHERE c.c_custkey = e.user_id AND c.c_acctbal > 0) GROUP BY event_type",
    "incremental_reuse": """
        SELECT reuse_class, count(*) AS n FROM (SELECT CASE WHEN event_id = min(event_id) OVER (PARTITION BY user_id, event_type) THEN 'fresh' ELSE 'duplicate' END AS reuse_class FROM {events}) x GROUP BY reuse_class""",
    "first_hit_rank": "SELECT user_id, min_by(rn, event_id) FILTER (WHERE hit) AS first_hit, round(coalesce(1.0 / min_by(rn, event_id) FILTER (WHERE hit), 0.0), 6) AS mrr FROM (SELECT user_id, event_id, value > 80 AS hit, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM {events}) x GROUP BY user_id",
    "top_domains": "SELECT source AS domain, count(*) AS n, min(doc_id) AS first_pos FROM {documents} GROUP BY source ORDER BY n DESC, first_pos LIMIT 20",
    "first_n_per_group": "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM {documents}) x WHERE rn <= 8",
    "label_unpivot": "SELECT doc_id, 'quality' AS label, quality AS label_value FROM {labels} WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 'toxic', toxic FROM {labels} WHERE toxic IS NOT NULL",
    "agreement_grouping_sets": """
        SELECT d.lang, d.source, count(*) AS reviewed, count_if(l.quality = 1) AS agree, round(count_if(l.quality = 1) / CAST(count(*) AS DOUBLE), 4) AS rate
        FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id GROUP BY GROUPING SETS ((d.lang), (d.source), ())""",
    "quota_rollup": """
        SELECT d.lang, l.quality, l.toxic, count(*) AS n, least(5, count(*)) AS target FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id GROUP BY d.lang, l.quality, l.toxic""",
    "fill_counts": "SELECT count(*) AS n, count_if(text IS NOT NULL AND text <> '') AS with_text, count_if(coalesce(lang, '') <> '') AS with_lang, count(DISTINCT source) AS sources FROM {documents}",
    "balanced_sample": """
        SELECT quality, doc_id FROM (SELECT quality, doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS STRING)), doc_id) AS rn FROM {labels}) x WHERE rn <= 20""",
    "set_union_except": "SELECT 'both' AS part, count(*) AS n FROM (SELECT doc_id FROM {documents} INTERSECT SELECT doc_id FROM {labels}) x UNION ALL SELECT 'unlabelled', count(*) FROM (SELECT doc_id FROM {documents} EXCEPT SELECT doc_id FROM {labels}) y",
    "page_search": "SELECT page_id, url FROM {pages} WHERE lower(url) LIKE '%/a%' OR lower(html) LIKE '%license%' ORDER BY page_id LIMIT 50 OFFSET 5",
    "cost_rollup": "SELECT user_id, round(sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) * 0.002 + sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) * 0.008, 6) AS cost, count(*) AS calls FROM {events} GROUP BY user_id",
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _run(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    names = set(re.findall(r"\{(\w+)\}", sql))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})

    return query


def latest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last view before it: one window, not a join with all earlier events."""
    e, w = spark.read.parquet(f"{sf_dir}/events.parquet"), Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return e.select("user_id", "event_id", "event_type", seen.alias("source_event")).filter("event_type = 'purchase'").drop("event_type")


MATCH_SQL = """
SELECT q.user_id, q.event_id, max(s.event_id) AS source_event FROM events q LEFT JOIN events s ON s.user_id = q.user_id AND s.event_type = 'view' AND s.event_id < q.event_id
WHERE q.event_type = 'purchase' GROUP BY q.user_id, q.event_id"""


def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, docs = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = containment(items, docs, "item_id", "doc_id").groupBy("item_id").agg(F.count("*").alias("docs"))
    return items.select("item_id").join(found, "item_id", "left").na.fill(0, ["docs"])


CONTAINMENT_SQL = rf"""
WITH g AS (SELECT item_id, {norm_sql('text')} AS n, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS s FROM benchmark), t AS (SELECT doc_id, {norm_sql('text')} AS n, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS s FROM documents)
SELECT g.item_id, count(t.doc_id) AS docs FROM g LEFT JOIN t ON contains(t.n, g.n) OR contains(t.s, g.s) GROUP BY g.item_id"""


def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "user_id", "event_id", "value")
    return R.latest_by_key(events, ["event_type", "user_id"], "event_id")


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apportion(docs.groupBy("lang").agg(F.count("*").alias("n")), ["lang"], 100).select(F.col("lang").alias("cell"), "n", "taken")


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resamples of the users with replacement, the same for both metrics."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    users = events.groupBy(F.col("user_id").alias("query_id")).agg((F.count_if(F.col("value") > 60) - F.count_if(F.col("value") > 40)).alias("d"))
    means = B.drawn_sums(users, [], ["d"]).filter("rep >= 0").groupBy("rep").agg((F.sum("d") / F.sum("times")).alias("diff"))
    at = lambda p: F.round(F.percentile("diff", F.lit(p)), 6)
    return means.agg(at(0.025).alias("low"), at(0.975).alias("high"), F.count("*").alias("reps"))


BOOTSTRAP_SQL = f"""
WITH u AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS pos, count_if(value > 60) - count_if(value > 40) AS d, count(*) OVER () AS n FROM events GROUP BY user_id),
h AS (SELECT n, r.range AS rep, u.pos AS i, md5('{B.SEED}:' || r.range || ':' || u.pos) AS h FROM range({B.REPLICATES}) r CROSS JOIN u WHERE 4 * u.pos < n),
m AS (SELECT rep, avg(u.d) AS diff FROM (SELECT rep, ('0x' || substr(h, 1 + 8 * k.range, 8))::BIGINT % n AS pick FROM h, range(4) k WHERE 4 * i + k.range < n) r JOIN u ON u.pos = r.pick GROUP BY rep)
SELECT round(quantile_cont(diff, 0.025), 6) AS low, round(quantile_cont(diff, 0.975), 6) AS high, count(*) AS reps FROM m"""


def linear_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("provider"), "value")
    found = quantiles(events, ["provider"], {"low": ("value", 0.025, LINEAR), "high": ("value", 0.975, LINEAR)})
    return found.select("provider", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


PERCENTILES_SQL = "SELECT event_type AS provider, round(percentile_cont(0.025) WITHIN GROUP (ORDER BY value), 6) AS low, round(percentile_cont(0.975) WITHIN GROUP (ORDER BY value), 6) AS high FROM events GROUP BY event_type"


def median_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("provider"), F.floor("value").alias("size"))
    sizes = sizes.withColumn("some", F.nullif("size", F.lit(0)))
    found = quantiles(sizes, ["provider"], {"of_some": ("some", 0.5, LINEAR), "of_all": ("size", 0.5, LINEAR)})
    return found.select("provider", F.coalesce("of_some", "of_all", F.lit(0.0)).alias("imputed"))


IMPUTATION_SQL = "SELECT event_type AS provider, coalesce(median(nullif(floor(value), 0)), median(floor(value)), 0) AS imputed FROM events GROUP BY event_type"


def short_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of one and of two words, the first of each item: they may lie inside words, too."""
    first = F.filter(F.split("text", " "), lambda w: w != "")
    golds = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("words"), first.alias("w"))
    golds = golds.select((F.col("item_id") * 10 + F.col("words")).alias("answer_id"), F.array_join(F.slice("w", F.lit(1), F.col("words")), " ").alias("text"))
    found = containment(golds, spark.read.parquet(f"{sf_dir}/documents.parquet"), "answer_id", "doc_id")
    return found.groupBy("answer_id").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


SHORT_SQL = rf"""
WITH w AS (SELECT item_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM benchmark), i AS (SELECT item_id * 10 + k AS answer_id, array_to_string(w[1:k], ' ') AS text FROM w, (VALUES (1), (2)) v(k)),
g AS (SELECT answer_id, {norm_sql('text')} AS n, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS s FROM i), t AS (SELECT doc_id, {norm_sql('text')} AS n, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS s FROM documents)
SELECT answer_id, count(*) AS docs, min(doc_id) AS first_doc FROM g JOIN t ON g.n <> '' AND t.n <> '' AND (contains(t.n, g.n) OR contains(t.s, g.s)) GROUP BY answer_id"""


LATEST_SQL = "SELECT event_type, user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS rn FROM events) x WHERE rn = 1"
STRATA_SQL = """
WITH c AS (SELECT lang AS cell, count(*) AS n FROM documents GROUP BY lang), x AS (SELECT *, n * 100.0 / sum(n) OVER () AS x FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, n DESC, cell DESC) AS rn, 100 - sum(floor(x)) OVER () AS rest FROM x)
SELECT cell, n, CAST(least(n, floor(x) + CASE WHEN rn <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""


OWN: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "latest_runs": (latest_runs, LATEST_SQL),
    "latest_match": (latest_match, MATCH_SQL),
    "containment_join": (containment_join, CONTAINMENT_SQL),
    "stratified_sample": (stratified_sample, STRATA_SQL),
    "paired_bootstrap": (paired_bootstrap, BOOTSTRAP_SQL),
    "linear_percentiles": (linear_percentiles, PERCENTILES_SQL),
    "median_imputation": (median_imputation, IMPUTATION_SQL),
    "short_answers": (short_answers, SHORT_SQL),
}


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    found = {name: (_run(sql), re.sub(r"\{(\w+)\}", r"\1", sql)) for name, sql in SQL.items()}
    return found | OWN | trace_queries.QUERIES | judge_queries.QUERIES | text_queries.QUERIES | io_queries.QUERIES | prompt_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}

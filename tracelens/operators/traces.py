"""Trace analytics: nested traces unfolded, per-trace metrics without a shuffle, provider summaries as one aggregation each.

A trace is a row of schema.TRACE. Missing, null and empty members count alike, as the analytics define them.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tracelens.functions import text as T
from tracelens.operators.quantiles import LINEAR, NEAREST, quantiles
from tracelens.operators.relational import latest_by_key
from tracelens.schema import TRACE, TRACE_VERSION
from tracelens.workers import ship, stored

#: Page sizes that count as large, in characters, and token totals that do.
LARGE_PAGES, LARGE_TOKENS = (50_000, 100_000, 500_000), (100_000, 500_000)
#: Share of changed letters beyond which a query is a reformulation, and overlap beyond which a search is redundant.
REFORMULATED, REDUNDANT = 0.30, 0.70


def _list(column: Column, like: str) -> Column:
    return F.coalesce(column, F.array().cast(like))


def latest(traces: DataFrame) -> DataFrame:
    """The last row of each provider's query; rows without a query are no query's."""
    return latest_by_key(traces.filter("query_id <> ''"), ["provider_id", "query_id"], "line_num")


def results(traces: DataFrame, *more: str) -> DataFrame:
    """A row for every result, with its trace's keys (and more of its columns): retrieval_pos, retrieval_id, retrieval_index, search_query,
    result_pos, result."""
    keys = ["provider_id", "query_id", "trace_id", "line_num", "gold_answer", *more]
    rows = traces.select(*keys, F.posexplode("retrievals").alias("retrieval_pos", "retrieval"))
    known = "retrieval_index" in traces.schema["retrievals"].dataType.elementType.names
    index = F.col("retrieval.retrieval_index") if known else F.lit(None).cast("int")
    rows = rows.select(*keys, "retrieval_pos", F.col("retrieval.retrieval_id").alias("retrieval_id"), index.alias("retrieval_index"), F.col("retrieval.search_query").alias("search_query"), F.posexplode("retrieval.search_response.results").alias("result_pos", "result"))
    return rows


def _results(t: str = "retrievals") -> Column:
    return F.flatten(F.transform(F.filter(F.col(t), lambda r: r["search_response"]["results"].isNotNull()), lambda r: r["search_response"]["results"]))


def _shown_domain(domain: Column, url: Column) -> Column:
    return F.when(F.coalesce(domain, F.lit("")) != "", domain).otherwise(T.root_domain(url))


def page_fetches() -> Column:
    """All pages that a trace has fetched, with search results first: array of (page_fetch, rank, domain, source)."""
    rank = lambda c: F.when(c != 0, c)
    page = lambda p: F.struct(*[p[m].alias(m) for m in ("fetch_status", "extractor", "extracted_text_chars", "extracted_text")])
    auto = F.transform(F.filter(F.coalesce(_results(), F.array()), lambda r: r["page_fetch"].isNotNull()), lambda r: F.struct(page(r["page_fetch"]).alias("page_fetch"), rank(r["rank"]).alias("rank"), _shown_domain(r["domain"], r["url"]).alias("domain"), F.lit("search_result").alias("source")))
    tool = F.transform(F.filter(F.coalesce(F.col("fetches"), F.array()), lambda f: f["page_fetch"].isNotNull()), lambda f: F.struct(page(f["page_fetch"]).alias("page_fetch"), rank(f["source_rank"]).alias("rank"), _shown_domain(f["source_domain"], f["url"]).alias("domain"), F.lit("fetch_tool").alias("source")))
    return F.concat(auto, tool)


def extra_snippets(result: Column) -> Column:
    return extra_text(F.from_json(F.get_json_object(result["provider_metadata"], "$.extra_snippets"), "array<string>"))


def extra_text(found: Column) -> Column:
    """The extra snippets that are not empty, as one text."""
    return F.array_join(F.filter(_list(found, "array<string>"), lambda s: s.isNotNull() & (s != "")), " ")


def text_fields(result: Column) -> dict[str, Column]:
    """The texts of a result in which an answer is looked for."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    return {"title": empty(result["title"]), "snippet": empty(result["snippet"]), "extra_snippets": extra_snippets(result), "page": empty(result["page_fetch"]["extracted_text"])}


@F.pandas_udf(DoubleType())
def _reformulation_rate(queries: pd.Series) -> pd.Series:
    def one(q: object) -> float | None:
        texts = ["" if x is None else x.lower() for x in (q if q is not None else [])]
        if len(texts) < 2:
            return None
        changed = [1 - difflib.SequenceMatcher(None, a, b).ratio() > REFORMULATED for a, b in zip(texts, texts[1:])]
        return sum(changed) / len(changed)

    return queries.map(one).astype("float64")


def reformulation_rate(queries: Column) -> Column:
    """Share of consecutive queries that differ by more than REFORMULATED; null below two queries. difflib has no SQL form."""
    ship()
    return _reformulation_rate(queries)


def redundant_rate(retrievals: Column) -> Column:
    """Share of consecutive searches whose sets of URLs overlap by more than REDUNDANT (Jaccard); null below two searches."""
    sets = F.transform(retrievals, lambda r: F.array_distinct(F.filter(F.transform(F.coalesce(r["search_response"]["results"], F.array()), lambda x: x["url"]), lambda u: F.coalesce(u, F.lit("")) != "")))

    def again(i: Column) -> Column:
        a, b = F.get(sets, i), F.get(sets, i + 1)
        whole = F.size(F.array_union(a, b))
        return F.when((whole > 0) & (F.size(F.array_intersect(a, b)) / whole > REDUNDANT), 1).otherwise(0)

    n = F.size(F.coalesce(retrievals, F.array()))
    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 2), again), F.lit(0), lambda s, x: s + x)
    return F.when(n >= 2, total / (n - 1))


def query_features() -> dict[str, Column]:
    q = F.transform(F.coalesce(F.col("retrievals"), F.array()), lambda r: F.coalesce(r["search_query"], F.lit("")))
    n = F.size(q)
    return {
        "search_query_count": n,
        "unique_search_query_count": F.size(F.array_distinct(F.transform(F.filter(q, lambda x: x != ""), lambda x: T.strip(F.lower(x))))),
        "redundant_search_rate": redundant_rate(F.col("retrievals")),
        "site_restricted_searches": F.size(F.filter(q, lambda x: F.contains(F.lower(x), F.lit("site:")))),
        "quoted_searches": F.size(F.filter(q, lambda x: F.contains(x, F.lit('"')))),
        "avg_search_query_chars": F.when(n > 0, F.aggregate(q, F.lit(0), lambda s, x: s + F.length(x)) / n).otherwise(0.0),
    }


def iteration_features() -> dict[str, Column]:
    rows = F.coalesce(F.col("iterations"), F.array())
    search = F.filter(rows, lambda i: i["agent_decision"] == "search")
    many = F.size(F.filter(search, lambda i: F.size(F.coalesce(i["searches"], F.array())) > 1))
    return {
        "iteration_count": F.size(rows),
        "search_iteration_count": F.size(search),
        "answer_iteration": F.get(F.filter(rows, lambda i: i["agent_decision"] == "answer"), F.lit(0))["iteration_num"],
        "multi_search_turn_count": many,
        "multi_search_turn_rate": F.when(F.size(search) > 0, many / F.size(search)),
        "answered_after_first_search": F.coalesce(F.col("answered"), F.lit(False)) & (F.coalesce("total_search_calls", F.lit(0)) <= 1),
        "ceiling_hit": F.coalesce(F.col("ceiling_hit"), F.lit(False)),
    }


def _urls(r: Column) -> Column:
    return F.filter(F.transform(r, lambda x: x["url"]), lambda u: F.coalesce(u, F.lit("")) != "")


def overlap(a: Column, b: Column) -> Column:
    """Whether two arrays share an element that is not empty."""
    some = lambda c: F.filter(c, lambda x: x != "")
    return F.size(F.array_intersect(some(a), some(b))) > 0


def prefix_hit(gold: Column, retrieved: Column) -> Column:
    """Whether a gold URL begins with a retrieved one or the other way round, schemes aside. An empty one begins all."""
    return _normalized_prefix_hit(T.normalized_urls(gold), T.normalized_urls(retrieved))


def _normalized_prefix_hit(gold: Column, retrieved: Column) -> Column:
    bare = lambda c: F.transform(c, lambda u: F.regexp_replace(u, r"^.*?://", ""))
    g, r = bare(gold), bare(retrieved)
    return F.exists(g, lambda x: F.exists(r, lambda y: F.startswith(y, x) | F.startswith(x, y)))


def url_hits(gold: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Per group of golds (by, url) what prefix_hit says of them and the group's found URLs, and whether they share an address, a domain
    or a source family; null URLs don't count. Groups of any size: equal values meet by a join, and a URL's beginnings only at the
    lengths that the group's other side has."""

    def forms(rows: DataFrame) -> DataFrame:
        rows = rows.filter("url IS NOT NULL").select(*by, "url").distinct()
        u = F.col("url")
        rows = rows.select(*by, T.normalize_url(u).alias("exact"), T.root_domain(u).alias("domain"), T.source_family(u).alias("family"))
        return rows.withColumn("bare", F.regexp_replace("exact", r"^.*?://", ""))

    def values(rows: DataFrame, others: DataFrame, whole: str, begun: str) -> DataFrame:
        lengths = others.groupBy(*by).agg(F.collect_set(F.length("bare")).alias("lengths"))
        named = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("exact", "domain", "family")]
        same = F.filter(F.array(*named), lambda x: x["value"] != "")
        some = F.filter(F.coalesce("lengths", F.array().cast("array<int>")), lambda n: n <= F.length("bare"))
        begins = F.transform(some, lambda n: F.struct(F.lit(begun).alias("kind"), F.substr("bare", F.lit(1), n).alias("value")))
        own = F.array(F.struct(F.lit(whole).alias("kind"), F.col("bare").alias("value")))
        return rows.join(lengths, by, "left").select(*by, F.inline(F.concat(same, own, begins))).distinct()

    g, r = forms(gold), forms(found)
    both = values(g, r, "gold", "found").join(values(r, g, "found", "gold"), [*by, "kind", "value"])
    hit = lambda *kinds: F.bool_or(F.col("kind").isin(*kinds))
    hits = both.groupBy(*by).agg(hit("gold", "found").alias("prefix"), *[hit(k).alias(k) for k in ("exact", "domain", "family")])
    return g.select(*by).distinct().join(hits, by, "left").na.fill(False)


def median_of(values: Column) -> Column:
    """Middle value, or the mean of both; 0 for none."""
    s, n = F.array_sort(values), F.size(values)
    at = lambda i: F.get(s, i.cast("int"))
    return F.when(n == 0, 0.0).otherwise((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2.0)


def counts_of(values: Column) -> Column:
    """How often each value stands in the array, as a map."""
    kinds = F.array_sort(F.array_distinct(values))
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(values, lambda v: v == k))))


def filled_members(metadata: Column) -> Column:
    """The members of a JSON object that hold something: not null, '', [] or {}."""
    return F.filter(F.coalesce(F.json_object_keys(metadata), F.array().cast("array<string>")), lambda k: ~F.coalesce(F.try_element_at(F.from_json(metadata, "map<string,string>"), k), F.lit("")).isin("", "[]", "{}"))


def per_trace_metrics(traces: DataFrame) -> DataFrame:
    """One row per trace with every metric; all from the trace's own arrays, so nothing is shuffled."""
    rows = traces.withColumns({"__r": F.coalesce(_results(), F.array()), "__p": page_fetches(), "__gold": F.coalesce("gold_answer", F.lit("")), "__golds": F.filter(_list(F.col("gold_urls"), "array<string>"), lambda u: u.isNotNull())})
    gold = F.col("__gold")
    # What lambdas ask for again and again is a column of its own, made once a trace: the answer's forms, normalised URLs, which texts hold it.
    rows = rows.withColumns({"__norm": T.normalize_answer(gold), "__plain": T.simple_text(gold), "__found": _urls(F.col("__r"))})
    held = lambda text: T.holds(F.col("__norm"), F.col("__plain"), text)
    rows = rows.withColumns({
        "__snippet": F.transform("__r", lambda r: held(text_fields(r)["snippet"])),
        "__page": F.transform("__p", lambda p: held(p["page_fetch"]["extracted_text"])),
        "__gold_urls": T.normalized_urls(F.col("__golds")),
        "__found_urls": T.normalized_urls(F.col("__found")),
    })
    hit = lambda part: F.exists("__r", lambda r: held(text_fields(r)[part]))
    # The first hit gives the rank; a hit without a rank leaves it to the next.
    ranks = F.filter("__r", lambda r, i: F.get("__snippet", i) & (F.coalesce(r["rank"], F.lit(0)) != 0))
    pages = F.filter("__p", lambda p, i: F.get("__page", i) & p["rank"].isNotNull())
    chars = F.transform("__p", lambda p: F.coalesce(p["page_fetch"]["extracted_text_chars"], F.lit(0)))
    golds, found = F.col("__gold_urls"), F.col("__found_urls")
    rows = rows.withColumns({
        "answer_in_title": hit("title"),
        "answer_in_snippet": F.exists("__snippet", lambda x: x),
        "answer_in_extra_snippets": hit("extra_snippets"),
        "answer_in_page": F.exists("__page", lambda x: x),
        "first_answer_snippet_rank": F.get(ranks, F.lit(0))["rank"],
        "first_answer_page_rank": F.get(pages, F.lit(0))["rank"],
        "__chars": chars,
        "exact_match": T.exact_match(F.col("final_answer"), gold),
        "f1": T.token_f1(F.col("final_answer"), gold),
        "gold_url_prefix_hit": _normalized_prefix_hit(golds, found),
        "gold_url_exact_hit": overlap(golds, found),
        "gold_domain_hit": overlap(F.transform("__golds", T.root_domain), F.transform("__found", T.root_domain)),
        "gold_source_family_hit": overlap(F.transform(golds, T.normalized_family), F.transform(found, T.normalized_family)),
        "__queries": F.transform(F.coalesce(F.col("retrievals"), F.array()), lambda r: r["search_query"]),
    })
    support = F.col("answer_in_snippet") | F.col("answer_in_page") | F.col("answer_in_extra_snippets")
    wrong, zero = ~F.col("exact_match"), lambda c: F.coalesce(F.col(c), F.lit(0))
    given, failed = F.coalesce(F.col("answered"), F.lit(False)), F.coalesce(F.col("failed"), F.lit(False))
    mrr = lambda c: F.coalesce(1.0 / F.col(c), F.lit(0.0))
    out = {
        "answered": given,
        "failed": failed,
        "abstained": ~given & ~failed,
        "answer_in_any_retrieved_text": support,
        "answer_snippet_mrr": mrr("first_answer_snippet_rank"),
        "answer_page_mrr": mrr("first_answer_page_rank"),
        "gold_hit_but_no_answer_text": F.col("gold_url_prefix_hit") & ~support,
        "answer_text_without_gold_prefix": support & ~F.col("gold_url_prefix_hit"),
        "wrong_with_answer_text_available": wrong & support,
        "wrong_without_answer_text_available": wrong & ~support,
        "retrieval_count": F.size(F.coalesce(F.col("retrievals"), F.array())),
        "result_count": F.size("__r"),
        "source_diversity": F.size(F.array_distinct(F.filter(F.transform("__r", lambda r: r["domain"]), lambda d: F.coalesce(d, F.lit("")) != ""))),
        "total_search_calls": zero("total_search_calls"),
        "total_prompt_tokens": zero("total_prompt_tokens"),
        "total_completion_tokens": zero("total_completion_tokens"),
        "total_tokens": zero("total_prompt_tokens") + zero("total_completion_tokens"),
        "wall_time_seconds": F.coalesce(F.col("wall_time_seconds"), F.lit(0.0)),
        "snippet_chars_median": median_of(F.transform("__r", lambda r: F.length(F.coalesce(r["snippet"], F.lit(""))))),
        "extracted_chars_median": median_of(F.col("__chars")),
        "extracted_chars_max": F.coalesce(F.array_max("__chars"), F.lit(0)),
        **{f"large_extract_{n // 1000}k_count": F.size(F.filter("__chars", _over(n))) for n in LARGE_PAGES},
        "fetch_status_counts": counts_of(F.transform("__p", lambda p: _or(p["page_fetch"]["fetch_status"], "missing"))),
        "extractor_counts": counts_of(F.transform("__p", lambda p: _or(p["page_fetch"]["extractor"], "none"))),
        "provider_metadata_field_counts": counts_of(F.flatten(F.transform("__r", lambda r: filled_members(r["provider_metadata"])))),
        "reformulation_rate": reformulation_rate(F.col("__queries")),
        **query_features(),
        **iteration_features(),
    }
    keys = ["trace_id", "run_id", "query_id", "provider_id", "question", "failure_stage"]
    kept = ["exact_match", "f1", "gold_url_exact_hit", "gold_url_prefix_hit", "gold_domain_hit", "gold_source_family_hit", "answer_in_title", "answer_in_snippet", "answer_in_extra_snippets", "answer_in_page", "first_answer_snippet_rank", "first_answer_page_rank"]
    return rows.select(*keys, gold.alias("gold_answer"), F.coalesce("final_answer", F.lit("")).alias("final_answer"), *kept, *[c.alias(n) for n, c in out.items()])


def _over(n: int) -> Callable[[Column], Column]:
    return lambda c: c > n


def _or(value: Column, other: str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", other).otherwise(value)


def trace_metrics(traces: DataFrame) -> DataFrame:
    """The first version's metrics of every row, without taking the latest: failure mode and premature termination among them."""
    rows = traces.withColumns({"__r": F.coalesce(_results(), F.array()), "__q": F.transform(F.coalesce(F.col("retrievals"), F.array()), lambda r: r["search_query"])})
    rows = rows.withColumns({
        "exact_match": T.exact_match(F.col("final_answer"), F.coalesce("gold_answer", F.lit(""))),
        "f1": T.token_f1(F.col("final_answer"), F.coalesce("gold_answer", F.lit(""))),
        "__calls": F.when(F.coalesce("total_search_calls", F.lit(0)) != 0, F.col("total_search_calls")).otherwise(F.size("__q")).cast("long"),
        "gold_document_hit": prefix_hit(F.filter(_list(F.col("gold_urls"), "array<string>"), lambda u: u.isNotNull()), _urls(F.col("__r"))),
    })
    wrong = ~F.col("exact_match")
    return rows.select(
        "trace_id", "query_id", "provider_id", "model_id", "metadata.freshness", "metadata.topic", "metadata.search_results",
        _list(F.col("metadata.question_types"), "array<string>").alias("question_types"), "metadata.effective_year",
        F.coalesce("answered", F.lit(False)).alias("answered"), F.coalesce("ceiling_hit", F.lit(False)).alias("ceiling_hit"),
        "exact_match", "f1", F.col("__calls").alias("total_search_calls"), reformulation_rate(F.col("__q")).alias("reformulation_rate"), redundant_rate(F.col("retrievals")).alias("redundant_search_rate"),
        F.size(F.array_distinct(F.transform(_urls(F.col("__r")), T.root_domain))).alias("source_diversity"), "gold_document_hit",
        (wrong & (F.col("__calls") < F.coalesce("config.max_iterations", F.lit(10)))).alias("premature_termination"),
        F.when(wrong & F.col("gold_document_hit"), "reasoning_failure").when(wrong, "retrieval_failure").alias("failure_mode"),
        F.coalesce("total_prompt_tokens", F.lit(0)).alias("total_prompt_tokens"), F.coalesce("total_completion_tokens", F.lit(0)).alias("total_completion_tokens"), F.coalesce("total_cost_usd", F.lit(0.0)).alias("total_cost_usd"),
    )


def metric_totals(metrics: DataFrame, by: str = "provider_id") -> DataFrame:
    """How many rows have each boolean metric."""
    flags = [c for c, kind in metrics.dtypes if kind == "boolean"]
    return metrics.groupBy(by).agg(*[F.count_if(F.col(c)).alias(c) for c in flags])


def safe_mean(value: Column) -> Column:
    return F.coalesce(F.avg(F.when(~F.isnan(value.cast("double")), value.cast("double"))), F.lit(0.0))


def reliability(traces: DataFrame, now: DataFrame | None = None) -> DataFrame:
    """Rows, queries, failed rows in history, failed latest rows (of now, if it is known), and failed rows whose query did not fail at last."""
    now = (latest(traces) if now is None else now).select("provider_id", "query_id", F.coalesce("failed", F.lit(False)).alias("__last"))
    rows = traces.withColumn("__failed", F.coalesce("failed", F.lit(False))).join(now, ["provider_id", "query_id"], "left")
    counted = rows.groupBy("provider_id").agg(F.count("*").alias("trace_rows"), F.count_if("__failed").alias("historical_failed_rows"), F.count_if(F.col("__failed") & (F.col("__last") == False)).alias("transient_failures_recovered"))  # noqa: E712
    last = now.groupBy("provider_id").agg(F.count("*").alias("latest_queries"), F.count_if("__last").alias("latest_failed_queries"))
    return counted.join(last, "provider_id", "left").na.fill(0, ["latest_queries", "latest_failed_queries"])


def summarize_providers(traces: DataFrame) -> DataFrame:
    """One row per provider: totals, means, medians and thresholds over its latest traces, and its reliability."""
    now = stored(latest(traces))
    metrics = stored(per_trace_metrics(now).drop("question", "gold_answer", "final_answer"))
    counted = ["answered", "abstained", "exact_match", "gold_url_exact_hit", "gold_url_prefix_hit", "gold_domain_hit", "gold_source_family_hit", "answer_in_snippet", "answer_in_extra_snippets", "answer_in_page", "answer_in_any_retrieved_text", "gold_hit_but_no_answer_text", "answer_text_without_gold_prefix", "wrong_with_answer_text_available", "wrong_without_answer_text_available"]
    t = F.col("total_tokens")
    per_trace = metrics.groupBy("provider_id").agg(
        *[F.count_if(F.col(c)).alias(c) for c in counted],
        F.count_if("answered_after_first_search").alias("answer_after_first_search"),
        safe_mean(F.col("f1")).alias("avg_f1"),
        F.sum("total_search_calls").alias("total_search_calls"),
        safe_mean(F.col("total_search_calls")).alias("avg_search_calls"),
        safe_mean(F.col("source_diversity")).alias("avg_source_diversity"),
        safe_mean(F.col("reformulation_rate")).alias("avg_reformulation_rate"),
        safe_mean(F.col("redundant_search_rate")).alias("avg_redundant_search_rate"),
        safe_mean(F.col("multi_search_turn_rate")).alias("multi_search_turn_rate_avg"),
        F.sum(t).alias("total_tokens"), safe_mean(t).alias("avg_tokens"), F.max(t).alias("max_tokens"),
        *[F.count_if(t > n).alias(f"queries_over_{n // 1000}k_tokens") for n in LARGE_TOKENS],
        F.sum("wall_time_seconds").alias("total_wall_time_seconds"), safe_mean(F.col("wall_time_seconds")).alias("avg_wall_time_seconds"),
    )
    searches = now.select("provider_id", F.explode("retrievals").alias("s")).select("provider_id", F.coalesce(F.col("s.search_response.results"), F.array()).alias("r"))
    per_search = searches.groupBy("provider_id").agg(safe_mean(F.size("r")).alias("avg_result_count_per_search"))
    snippets = results(now).select("provider_id", F.length(F.coalesce("result.snippet", F.lit(""))).alias("n"))
    per_result = quantiles(snippets, ["provider_id"], {"median_snippet_chars": ("n", 0.5, LINEAR)})
    pages = now.select("provider_id", F.explode(page_fetches()).alias("p")).select("provider_id", F.coalesce("p.page_fetch.extracted_text_chars", F.lit(0)).alias("chars"))
    page_sizes = quantiles(pages, ["provider_id"], {"median_extracted_chars": ("chars", 0.5, LINEAR), "p90_extracted_chars": ("chars", 0.9, NEAREST)})
    per_page = pages.groupBy("provider_id").agg(F.max("chars").alias("max_extracted_chars"), *[F.count_if(F.col("chars") > n).alias(f"large_extract_over_{n}") for n in LARGE_PAGES])
    found = reliability(traces, now)
    for part in (per_trace, quantiles(metrics, ["provider_id"], {"median_tokens": ("total_tokens", 0.5, LINEAR)}), per_search, per_result, per_page, page_sizes):
        found = found.join(part, "provider_id", "left")
    return found.withColumn("p90_extracted_chars", F.col("p90_extracted_chars").cast("long")).na.fill(0)


def page_counts(traces: DataFrame) -> DataFrame:
    """provider_id, kind (fetch_status, extractor, metadata), value, n over the latest traces: the histograms in long form."""
    now = latest(traces)
    pages = now.select("provider_id", F.explode(page_fetches()).alias("p"))
    status = pages.select("provider_id", F.lit("fetch_status").alias("kind"), _or(F.col("p.page_fetch.fetch_status"), "missing").alias("value"))
    extractor = pages.select("provider_id", F.lit("extractor").alias("kind"), _or(F.col("p.page_fetch.extractor"), "none").alias("value"))
    members = results(now).select("provider_id", F.lit("metadata").alias("kind"), F.explode(filled_members(F.col("result.provider_metadata"))).alias("value"))
    return status.unionByName(extractor).unionByName(members).groupBy("provider_id", "kind", "value").agg(F.count("*").alias("n"))


def top_domains(traces: DataFrame, k: int = 20) -> DataFrame:
    """Each provider's k commonest domains, ties by where they were first seen."""
    rows = results(latest(traces)).filter("result.domain <> ''")
    place = F.struct("line_num", "retrieval_pos", "result_pos")
    counted = rows.groupBy("provider_id", F.col("result.domain").alias("domain")).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    # A row_number with a bound keeps only each provider's head in every task before the shuffle.
    place = F.row_number().over(Window.partitionBy("provider_id").orderBy(F.desc("n"), "first"))
    return counted.withColumn("place", place).filter(F.col("place") <= k).select("provider_id", "place", "domain", "n")


def domain_rows(traces: DataFrame) -> DataFrame:
    """Per provider and domain: results, outcomes of their own page fetches, answers in them, and characters."""
    rows = results(latest(traces)).select("provider_id", _shown_domain(F.col("result.domain"), F.col("result.url")).alias("domain"), "gold_answer", F.col("result.page_fetch").alias("p"))
    chars = F.coalesce("p.extracted_text_chars", F.lit(0))
    return rows.groupBy("provider_id", "domain").agg(
        F.count("*").alias("result_count"),
        *[F.count_if(F.col("p.fetch_status") == s).alias(f"fetch_{s}") for s in ("success", "failed", "empty")],
        F.count_if(T.answer_in_text(F.col("gold_answer"), F.col("p.extracted_text"))).alias("answer_in_page"),
        F.sum(chars).alias("extract_chars_total"),
        F.count_if(chars > 100_000).alias("large_extract_100k"),
    )


def pairwise_outcomes(metrics: DataFrame) -> DataFrame:
    """provider_a, provider_b, outcome, n over the queries that both providers have."""
    side = lambda n: metrics.select("query_id", F.col("provider_id").alias(f"provider_{n}"), F.col("exact_match").alias(f"em_{n}"), F.col("answer_in_any_retrieved_text").alias(f"text_{n}"))
    both = side("a").join(side("b"), "query_id").filter("provider_a < provider_b")
    wrong = F.when(F.col("text_a") != F.col("text_b"), "both_wrong_one_has_answer_text").otherwise("both_wrong")
    outcome = F.when(F.col("em_a") & F.col("em_b"), "both_correct").when(~F.col("em_a") & ~F.col("em_b"), wrong).when(F.col("em_a"), F.concat("provider_a", F.lit("_correct_only"))).otherwise(F.concat("provider_b", F.lit("_correct_only")))
    return both.groupBy("provider_a", "provider_b", outcome.alias("outcome")).agg(F.count("*").alias("n"))


def multiway_outcomes(metrics: DataFrame) -> DataFrame:
    """outcome, n over the queries of all providers: one label each by how many are right, and counters that may overlap."""
    per = metrics.groupBy("query_id").agg(F.count_distinct("provider_id").alias("p"), F.count_if("exact_match").alias("right"), F.count_if("answer_in_any_retrieved_text").alias("text"), F.count_if("gold_url_prefix_hit").alias("gold"))
    k = F.col("k")
    whole = metrics.agg(F.count_distinct("provider_id").alias("k"))
    rows = per.join(F.broadcast(whole), F.col("p") == k).filter("k >= 3")
    label = F.when(F.col("right") == k, "all_correct").when(F.col("right") == 0, "all_wrong").when(F.col("right") == 1, "one_provider_correct").when(F.col("right") == k - 1, "two_providers_correct").otherwise(F.concat(F.col("right").cast("string"), F.lit("_providers_correct")))
    more = [
        F.when((F.col("text") == k) & (F.col("right") != 0) & (F.col("right") != k), "all_have_answer_text_but_different_correctness"),
        F.when(F.col("text") == 1, "only_one_provider_has_answer_text"),
        F.when(F.col("gold") > F.col("text"), "gold_alignment_exceeds_answer_text_support"),
    ]
    return rows.select(F.explode(F.array_compact(F.array(label, *more))).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def file_summary(traces: DataFrame) -> DataFrame:
    """What a dashboard shows of a trace file: latest rows' counts, shares in per cent, averages and totals."""
    now = latest(traces)
    rows = trace_metrics(now).select("provider_id", "query_id", "exact_match", "gold_document_hit").join(now.select("provider_id", "query_id", "answered", "failed", "total_search_calls", "total_fetch_calls", "total_prompt_tokens", "total_completion_tokens", "wall_time_seconds", "total_cost_usd"), ["provider_id", "query_id"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    given, failed = F.coalesce(F.col("answered"), F.lit(False)), F.coalesce(F.col("failed"), F.lit(False))
    flags = {"answered": given, "abstained": ~given & ~failed, "failed": failed, "exact_match": F.col("exact_match"), "gold_document_hit": F.col("gold_document_hit")}
    tokens = zero("total_prompt_tokens") + zero("total_completion_tokens")
    found = rows.groupBy("provider_id").agg(F.count("*").alias("latest_queries"), *[F.count_if(c).alias(n) for n, c in flags.items()], F.sum(zero("total_search_calls")).alias("total_search_calls"), F.sum(zero("total_fetch_calls")).alias("total_fetch_calls"), F.sum(tokens).alias("total_tokens"), F.round(F.sum(zero("wall_time_seconds")), 3).alias("total_wall_time_seconds"), F.round(F.sum(zero("total_cost_usd")), 8).alias("total_cost_usd"))
    n = F.col("latest_queries")
    return found.withColumns({**{f"{c}_pct": T.per_cent(F.col(c), n) for c in flags}, "avg_search_calls": F.bround(F.col("total_search_calls") / n, 2), "avg_fetch_calls": F.bround(F.col("total_fetch_calls") / n, 2), "avg_tokens": F.bround(F.col("total_tokens") / n, 1)})


def find_seen(url: Column) -> Column:
    """Of a trace row: (retrieval_id, search_query, rank) of the first result with that URL in the latest search that has it."""
    # An array of one element binds its value: the wanted URL is normalised once a trace, and each result's once.
    one = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    listed = lambda r: F.coalesce(r["search_response"]["results"], F.array())
    place = lambda r, wanted: F.array_position(T.normalized_urls(F.transform(listed(r), lambda x: x["url"])), wanted)
    placed = lambda wanted: F.transform(F.reverse(F.coalesce(F.col("retrievals"), F.array())), lambda r: F.struct(r.alias("r"), place(r, wanted).alias("at")))
    last = F.get(F.filter(one(T.normalize_url(url), placed), lambda h: h["at"] > 0), F.lit(0))
    hit = lambda h: F.struct(h["r"]["retrieval_id"].alias("retrieval_id"), h["r"]["search_query"].alias("search_query"), F.get(listed(h["r"]), (h["at"] - 1).cast("int"))["rank"].alias("rank"), F.lit(True).alias("found"))
    return one(last, lambda h: F.when(h.isNotNull(), hit(h)))


def zip_pages(results_: Column, pages: Column) -> Column:
    """Results and page fetches by position; the shorter array ends both."""
    n = F.least(F.size(results_), F.size(pages))
    return F.arrays_zip(F.slice(results_, 1, n).alias("result"), F.slice(pages, 1, n).alias("page_fetch"))


def running_cost(search_cost: Column, prompt: Column, completion: Column, price_in: float, price_out: float) -> Column:
    return F.round(search_cost + prompt * price_in / 1000 + completion * price_out / 1000, 8)


def usage_totals() -> dict[str, Column]:
    """Sums over the iterations of what the model used."""
    add = lambda member: F.aggregate(F.coalesce(F.col("iterations"), F.array()), F.lit(0).cast("long"), lambda s, i: s + F.coalesce(i["llm_usage"][member], F.lit(0).cast("long")))
    return {"total_prompt_tokens": add("prompt_tokens"), "total_completion_tokens": add("completion_tokens")}


def compact(traces: DataFrame) -> DataFrame:
    """The narrow rows that lists show."""
    return trace_metrics(traces).select("trace_id", "query_id", "provider_id", "answered", "exact_match", "f1", "total_search_calls", "source_diversity", "gold_document_hit", "failure_mode")



def with_defaults(rows: DataFrame) -> DataFrame:
    """Rows with some of a trace's members as whole traces: an empty trace's values for the others."""
    empty = {"schema_version": F.lit(TRACE_VERSION), "answered": F.lit(False), "ceiling_hit": F.lit(False), "failed": F.lit(False), "final_response": F.lit(""), "final_answer": F.lit("")}
    zero = ["total_search_calls", "total_fetch_calls", "total_prompt_tokens", "total_completion_tokens", "total_cost_usd", "wall_time_seconds"]
    out = []
    for f in _trace_fields():
        kind = f.dataType
        default = empty.get(f.name, F.lit(0) if f.name in zero else F.array() if kind.typeName() == "array" else F.lit(None)).cast(kind)
        out.append((F.coalesce(F.col(f.name).cast(kind), default) if f.name in rows.columns else default).alias(f.name))
    return rows.select(*out)


def _trace_fields() -> list:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(TRACE).fields


def run_counts() -> list[Column]:
    """What a judge run wrote: rows by how they came about, errors and tokens."""
    c = F.col
    some = lambda x: F.coalesce(c(x), F.lit("")) != ""
    tokens = F.coalesce("page_fetch.extracted_text_tokens_estimate", F.lit(0))
    return [F.count(F.lit(1)).alias("written"), F.count_if(c("reuse_class") != "fresh").alias("reused"), F.count_if(c("reuse_class") == "fresh").alias("fresh"), F.count_if(some("execution_error")).alias("errors"), F.sum(tokens).alias("tokens")]


def run_stats(records: DataFrame) -> DataFrame:
    return records.agg(*run_counts())


def snippet_proxy(report: DataFrame) -> DataFrame:
    """provider_id and the greater of the answers seen in snippets and in extra snippets: a proxy for what the surface showed."""
    return report.select("provider_id", F.greatest("answer_in_snippet", "answer_in_extra_snippets").alias("surface"))


def least_hit_rank(results_: Column, hit: Callable[[Column], Column]) -> Column:
    """The least rank of the results that hit; ranks of 0 are none."""
    return F.array_min(F.transform(F.filter(results_, lambda r: hit(r) & (F.coalesce(r["rank"], F.lit(0)) != 0)), lambda r: r["rank"]))

"""Support of answers before and after a fetch, decision cells, and the simulator of fetch policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions import text as T
from tracelens.operators.judge import pre_support, url_id, valid
from tracelens.operators.quantiles import LINEAR, quantiles

CELLS = ["SMART", "MISSED", "BLIND", "NOOP"]
POLICIES = ["snippet_only", "fetch_rank_1", "fetch_top_3", "fetch_top_5", "observed_agent_policy", "oracle_fetch_if_any_support", "oracle_fetch_if_needed"]


def _yes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def query_support(records: DataFrame, universe: DataFrame) -> DataFrame:
    """One row per (provider_id, query_id) of the universe, with or without judge rows: counts of rows and URLs, flags, and the cell."""
    seen, opened, pre = F.col("judge_surface_class") == "snippet_only", F.col("judge_surface_class") == "page_visible", F.col("pre")
    rows = records.filter(valid())  # those of other queries find no partner in the universe at last
    rows = rows.withColumns({"u": url_id(), "pre": pre_support()})
    page_gold = opened & _yes("judgment.gold_answer_in_extracted_page")
    per_url = rows.groupBy("provider_id", "query_id", "u").agg(
        F.count_if(pre).alias("pre_rows"), F.count_if(seen).alias("snippet_rows"), F.count_if(opened).alias("page_rows"), F.count_if(page_gold).alias("page_gold_rows"), F.count_if(_yes("judgment.contains_gold_answer")).alias("legacy"),
        F.bool_or(opened | _yes("model_fetched_document")).alias("fetched"), F.count_if(pre & (F.col("rank") == 1)).alias("rank1_rows"), F.count_if(seen & _yes("judgment.contradicts_gold_answer")).alias("contra_rows"), F.count_if(seen & _yes("judgment.contains_gold_answer")).alias("gold_rows"),
    )
    sums = ["pre_rows", "snippet_rows", "page_rows", "page_gold_rows", "rank1_rows", "contra_rows", "gold_rows"]
    per = per_url.groupBy("provider_id", "query_id").agg(
        *[F.sum(c).alias(c) for c in sums], F.count_if(F.col("pre_rows") > 0).alias("pre_urls"), F.count_if(F.col("page_gold_rows") > 0).alias("page_gold_urls"), F.count_if("fetched").alias("fetched_urls"), F.count_if(F.col("legacy") > 0).alias("legacy_urls"), F.count_if(F.col("fetched") & (F.col("pre_rows") > 0)).alias("fetched_pre_urls"),
    )
    all_counts = [*sums, "pre_urls", "page_gold_urls", "fetched_urls", "legacy_urls", "fetched_pre_urls"]
    rows = universe.join(per, ["provider_id", "query_id"], "left").na.fill(0, all_counts)
    before, after = F.col("pre_urls") > 0, F.col("page_gold_urls") > 0
    cell = F.when(before & (F.col("fetched_pre_urls") > 0), "SMART").when(before, "MISSED").when(F.col("fetched_urls") > 0, "BLIND").otherwise("NOOP")
    return rows.withColumns({"pre_support": before, "post_discovered": ~before & after, "trajectory": before | after, "legacy": F.col("legacy_urls") > 0, "cell": cell})


def provider_support(queries: DataFrame) -> DataFrame:
    """Per provider: queries by support, judge rows by surface; rows of discovered pages, and their distinct URLs."""
    post = F.col("post_discovered")
    return queries.groupBy("provider_id").agg(
        F.count("*").alias("queries"), *[F.count_if(c).alias(f"{c}_q") for c in ("pre_support", "post_discovered", "trajectory", "legacy")], *[F.sum(c).alias(c) for c in ("snippet_rows", "page_rows", "pre_rows", "page_gold_rows")],
        F.sum(F.when(post, F.col("page_gold_rows")).otherwise(0)).alias("post_rows"), F.sum(F.when(post, F.col("page_gold_urls")).otherwise(0)).alias("post_urls"),
        T.rate(F.sum("contra_rows"), F.sum("gold_rows")).alias("contradiction_ratio"), T.rate(100 * F.sum("rank1_rows"), F.sum("pre_rows")).alias("rank1_share"),
    )


def partition(queries: DataFrame) -> DataFrame:
    """provider_id, cell, queries, correct, rate (null for none): all four cells of each provider."""
    cells = queries.select("provider_id").distinct().withColumn("cell", F.explode(F.array(*[F.lit(c) for c in CELLS])))
    counted = queries.groupBy("provider_id", "cell").agg(F.count("*").alias("queries"), F.count_if("correct").alias("correct"))
    rows = cells.join(counted, ["provider_id", "cell"], "left").na.fill(0, ["queries", "correct"])
    return rows.withColumn("rate", F.bround(T.rate(F.col("correct"), F.col("queries")), 4))


def checks(queries: DataFrame, expected: int | None = None) -> DataFrame:
    """Per provider whether the invariants hold: as many queries as expected, the cells their partition, supports disjoint."""
    n = F.count("*")
    cells = sum((F.count_if(F.col("cell") == c) for c in CELLS[1:]), F.count_if(F.col("cell") == CELLS[0]))
    return queries.groupBy("provider_id").agg((n == expected if expected is not None else n > 0).alias("complete"), (cells == n).alias("cells_partition"), (F.count_if(F.col("pre_support") & F.col("post_discovered")) == 0).alias("disjoint"), (F.count_if(F.col("pre_support") | F.col("post_discovered")) == F.count_if("trajectory")).alias("union_is_trajectory"))


def assert_checks(checked: DataFrame) -> DataFrame:
    """The same rows; reading them fails where an invariant is broken."""
    for c in ("complete", "cells_partition", "disjoint", "union_is_trajectory"):
        checked = checked.withColumn(c, F.coalesce(F.assert_true(F.col(c), F.concat(F.lit(f"{c} is broken for "), "provider_id")).cast("boolean"), F.col(c)))
    return checked


def complementarity(correct: DataFrame, order: list[str]) -> DataFrame:
    """region, queries: by which providers are right, in the given order; '' where none is."""
    flags = [F.max(F.when((F.col("provider_id") == p) & F.col("correct"), p)) for p in order]
    return correct.groupBy("query_id").agg(F.concat_ws("_", *flags).alias("region")).groupBy("region").agg(F.count("*").alias("queries"))


def url_states(records: DataFrame) -> DataFrame:
    """One row per provider, query and URL: least rank, first place, flags, and the tokens of the last page seen (null: none)."""
    seen, opened = F.col("judge_surface_class") == "snippet_only", F.col("judge_surface_class") == "page_visible"
    contra, tokens = _yes("judgment.contradicts_gold_answer"), F.col("page_fetch.extracted_text_tokens_estimate")
    rank = F.when(F.coalesce("rank", F.lit(0)) != 0, F.col("rank")).otherwise(1_000_000_000)
    known = opened & F.col("page_fetch").isNotNull()
    rows = records.filter(valid()).withColumns({"u": url_id(), "pre": pre_support()})
    return rows.groupBy("provider_id", "query_id", "u").agg(
        F.min(rank).alias("rank"), F.min("seq").alias("first_seen"), F.bool_or("pre").alias("pre"), F.bool_or(opened & _yes("judgment.gold_answer_in_extracted_page")).alias("page"), F.bool_or(opened | _yes("model_fetched_document")).alias("fetched"),
        F.bool_or(seen & contra).alias("surface_contra"), F.bool_or(opened & contra).alias("opened_contra"), F.max(F.when(known, F.struct("seq", F.coalesce(tokens, F.lit(0)).alias("tokens"))))["tokens"].alias("tokens"), F.bool_or(known).alias("known"),
    ).withColumn("tokens", F.when(F.col("known"), F.col("tokens")))


def imputed_tokens(records: DataFrame) -> DataFrame:
    """provider_id, imputed: the median of the known page sizes that are not 0, else of all, else 0."""
    t = F.coalesce("page_fetch.extracted_text_tokens_estimate", F.lit(0))
    known = (F.col("judge_surface_class") == "page_visible") & F.col("page_fetch").isNotNull()
    rows = records.filter(valid()).withColumn("t", F.when(known, t))
    rows = rows.select("provider_id", "t", F.nullif("t", F.lit(0)).alias("some"))
    found = quantiles(rows, ["provider_id"], {"of_some": ("some", 0.5, LINEAR), "of_all": ("t", 0.5, LINEAR)})
    return found.select("provider_id", F.bround(F.coalesce("of_some", "of_all", F.lit(0.0))).cast("long").alias("imputed"))


def simulate(states: DataFrame, imputed: DataFrame) -> DataFrame:
    """One row per provider, query and policy: what the policy would fetch, what that supports, and what it costs."""
    q = ["provider_id", "query_id"]
    w = Window.partitionBy(*q)
    rows = states.join(F.broadcast(imputed), "provider_id").withColumn("rn", F.row_number().over(w.orderBy("rank", "first_seen", "u")))
    rows = rows.withColumns({"first_any": F.min(F.when(F.col("pre") | F.col("page"), F.col("rn"))).over(w), "first_page": F.min(F.when(F.col("page"), F.col("rn"))).over(w), "any_pre": F.bool_or("pre").over(w)})
    rn, none = F.col("rn"), F.lit(False)
    chosen = [none, rn <= 1, rn <= 3, rn <= 5, F.col("fetched"), F.coalesce(rn == F.col("first_any"), none), F.coalesce(~F.col("any_pre") & (rn == F.col("first_page")), none)]
    # A query's URLs are aggregated for all policies at once; only the results are unfolded.
    cost, sums, policies = F.when(F.col("known"), F.col("tokens")).otherwise(F.col("imputed")), [], []
    rows = rows.withColumns({f"on{i}": c for i, c in enumerate(chosen)})
    for i, policy in enumerate(POLICIES):
        on = F.col(f"on{i}")
        found = {
            "page": F.bool_or(F.col("page") & on), "fetches": F.count_if(on), "tokens": F.sum(F.when(on, cost).otherwise(0)), "imputed": F.count_if(on & ~F.col("known")),
            "contra": F.bool_or(on & (F.col("surface_contra") | F.col("opened_contra"))), "urls": F.array_sort(F.collect_list(F.when(on, F.struct("rn", "u")))),
        }
        sums += [c.alias(f"{n}{i}") for n, c in found.items()]
        of = {n: F.col(f"{n}{i}") for n in found}
        policies.append(F.struct(
            F.lit(policy).alias("policy"), (F.col("pre") | of["page"]).alias("captured"), F.col("pre").alias("pre_support"), of["page"].alias("page_support"), (~F.col("pre") & of["page"]).alias("incremental"), (F.col("pre") | F.col("page")).alias("trajectory"), of["fetches"].alias("fetches"),
            of["tokens"].alias("tokens"), of["imputed"].alias("imputed_fetches"), F.col("surface_contra").alias("surface_contradiction"), of["contra"].alias("opened_contradiction"), F.array_join(F.transform(of["urls"], lambda x: x["u"]), ";").alias("selected_urls"),
        ))
    per = rows.groupBy(*q).agg(*[F.bool_or(c).alias(c) for c in ("pre", "page", "surface_contra")], *sums)
    return per.select(*q, F.inline(F.array(*policies)))


def summarize_policies(rows: DataFrame) -> DataFrame:
    """Per provider and policy: sums, shares, and rates per fetch, null where nothing is fetched."""
    n, flags = F.col("queries"), {"captured": "support_captured", "incremental": "incremental_support", "surface_contradiction": "surface_contradictions", "opened_contradiction": "opened_contradictions"}
    found = rows.groupBy("provider_id", "policy").agg(F.count("*").alias("queries"), *[F.count_if(c).alias(out) for c, out in flags.items()], F.sum("fetches").alias("fetches"), F.sum("tokens").alias("tokens"), F.sum("imputed_fetches").alias("imputed_fetches"))
    return found.withColumns({
        "support_captured_pct": F.bround(100 * F.col("support_captured") / n).cast("long"),
        "avg_fetches": F.bround(F.col("fetches") / n, 2),
        "support_per_fetch": F.bround(T.rate(F.col("support_captured"), F.col("fetches")), 3),
        "incremental_per_fetch": F.bround(T.rate(F.col("incremental_support"), F.col("fetches")), 3),
        "tokens_per_query": F.bround(F.col("tokens") / n).cast("long"),
    })

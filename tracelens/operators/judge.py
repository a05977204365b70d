"""Judge records: validity, surfaces, matching fetches, reuse of earlier judgments, and summaries. Rows are of schema.JUDGE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from tracelens import schema
from tracelens.functions import render as R
from tracelens.functions import text as T

#: Extractors that give no text.
UNSUPPORTED = ["binary_unsupported_v1", "office_unsupported_v1", "pdf_unsupported_v1"]
#: The members of a result that a record shows.
RESULT_MEMBERS = ["document_id", "rank", "title", "url", "snippet", "domain", "provider_metadata"]
KEY = ["provider_id", "query_id", "retrieval_id", "rank", "url"]


def _some(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _yes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def valid(runner: bool = False) -> Column:
    """Whether a judge row counts; the runner also asks for the search that it belongs to."""
    found = (F.col("schema_version") == schema.JUDGE_VERSION) & F.col("judgment").isNotNull() & ~_some("execution_error") & ~_some("judgment_parse_error") & _some("provider_id") & _some("query_id") & _some("url")
    return F.coalesce(found & _some("retrieval_id") if runner else found, F.lit(False))


def pre_support() -> Column:
    """Whether the snippets held the answer before any fetch."""
    return _yes("judgment.gold_answer_in_snippets") | ((F.col("judge_surface_class") == "snippet_only") & _yes("judgment.contains_gold_answer"))


def url_id() -> Column:
    return F.when(_some("normalized_url"), F.col("normalized_url")).otherwise(T.normalize_url(F.col("url")))


def garbage_precheck(page: Column) -> Column:
    """is_garbage, category: what the outcome of a page's fetch alone says. Without a fetch nothing is garbage."""
    of = lambda m: F.coalesce(page[m], F.lit(""))
    status, chars, kind = of("fetch_status"), F.coalesce(page["extracted_text_chars"], F.lit(0)), of("content_type")
    media = F.startswith(kind, F.lit("image/")) | F.startswith(kind, F.lit("audio/")) | F.startswith(kind, F.lit("video/"))
    category = F.when(status == "failed", "fetch_failed").when(of("extractor").isin(UNSUPPORTED), "unsupported_content").when((status == "empty") & (chars == 0), "empty_extraction").when((status == "success") & (chars == 0), "empty_success").when(media, "media_content").otherwise("")
    return F.struct((category != "").alias("is_garbage"), category.alias("category"))


def effective_garbage() -> Column:
    return _yes("document_garbage_precheck.is_garbage") | _yes("judgment.is_garbage")


def prompt() -> Column:
    """The contents of a record's messages, which the judge has seen."""
    return F.array_join(F.transform(F.coalesce("messages", F.array()), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")


def surface_class(source: Column, page: Column) -> Column:
    return F.when((source != "none") | page.isNotNull(), "page_visible").otherwise("snippet_only")


def inferred_surface() -> Column:
    """The surface of a record that doesn't say it: by its source, its page or its prompt."""
    source = _some("page_fetch_source") & (F.col("page_fetch_source") != "none")
    page = F.coalesce(F.col("page_fetch.fetch_status"), F.lit("")) != ""
    seen = F.when(source | page | F.contains(prompt(), F.lit("<extracted_page>")), "page_visible").otherwise("snippet_only")
    return F.when(_some("judge_surface_class"), F.col("judge_surface_class")).otherwise(seen)


def page_signature(content: Column) -> Column:
    """The digest of what the first page's tags hold, blanks stripped; of nothing where they aren't closed."""
    begin, end = "<extracted_page>", "</extracted_page>"
    rest = F.substr(content, F.instr(content, begin) + len(begin))
    inner = F.when(F.contains(rest, F.lit(end)), T.strip(F.substring_index(rest, end, 1))).otherwise("")
    return F.when(F.contains(content, F.lit(begin)), T.hash_json(extracted_page_xml=inner)).otherwise("")


def snippet_signature(result: Column, url: Column, extra: Column) -> Column:
    """url: the result's, normalised."""
    empty = lambda m: F.coalesce(result[m], F.lit(""))
    return T.hash_json(title=empty("title"), url=F.when(empty("url") == "", "").otherwise(url), domain=empty("domain"), snippet=empty("snippet"), extra_snippets=extra)


def reuse_key() -> Column:
    """query, URL, surface: records that share it can share a judgment. Null for a page without a signature."""
    surface, signature = inferred_surface(), F.when(_some("judge_page_fetch_signature"), F.col("judge_page_fetch_signature")).otherwise(page_signature(prompt()))
    shown = F.when(surface != "page_visible", surface).when(signature != "", F.concat(surface, F.lit(":"), signature))
    url = F.when(_some("normalized_url"), F.col("normalized_url")).when(_some("url"), T.normalize_url(F.col("url")))
    return F.when(_some("query_id") & url.isNotNull() & shown.isNotNull(), F.struct(F.col("query_id").alias("query_id"), url.alias("url"), shown.alias("surface")))


def _dealt(rows: DataFrame, key: str | Column) -> DataFrame:
    """Rows dealt out by a key, finer than a shuffle does: they are sorted, and take far more memory there than bytes in the shuffle."""
    return rows.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def by_trace(rows: DataFrame) -> DataFrame:
    return _dealt(rows, "trace_id")


def by_query(rows: DataFrame, query: str | Column = "query_id") -> DataFrame:
    """Rows dealt out by query; Spark leaves rows that are dealt out so already where they are."""
    return _dealt(rows, query)


def match_fetches(results: DataFrame, fetches: DataFrame) -> DataFrame:
    """Each result (trace_id, retrieval_id, document_id, rank, url) with its fetch_id and status, null without one.

    A fetch of that search by document id comes first; then, where results have retrieval_index, one under s{index}r{rank};
    without one, by URL or rank. Of several: a success, then the lowest iteration, then fetch_id. Results and fetches are
    dealt out together, once, by trace; in windows over a search and a key, results see the best fetch: no join.
    """
    on, kinds = ["trace_id", "retrieval_id"], dict(results.dtypes)
    columns = results.columns
    if "retrieval_index" not in columns:
        results = results.withColumn("retrieval_index", F.lit(None).cast("int"))
    given = (F.coalesce("retrieval_index", F.lit(0)) != 0) & (F.coalesce("rank", F.lit(0)) != 0)
    alias = F.when(given, F.concat(F.lit("s"), F.col("retrieval_index").cast("string"), F.lit("r"), F.col("rank").cast("string")))
    order = F.struct((F.coalesce(F.col("fetch_status"), F.lit("")) != "success").cast("int").alias("s"), F.coalesce("iteration_num", F.lit(0)).alias("i"), F.coalesce("fetch_id", F.lit("")).alias("f"), F.col("fetch_status").alias("status"))
    f = fetches.filter("trace_id IS NOT NULL AND retrieval_id <> '' AND document_id <> ''")
    f = f.select(*on, F.col("document_id").alias("k_document"), F.col("document_id").alias("k_alias"), F.col("url").alias("k_url"), F.col("rank").cast(kinds["rank"]).alias("k_rank"), order.alias("o"))
    r = results.withColumns({"k_document": F.col("document_id"), "k_alias": alias, "k_url": F.col("url"), "k_rank": F.col("rank"), "is_result": F.lit(True)})
    rows = by_trace(r.unionByName(f, allowMissingColumns=True))

    def best(key: str) -> Column:
        # Rows without the key share nothing.
        return F.when(F.col(key).isNotNull(), F.min("o").over(Window.partitionBy(*on, key)))

    rows = rows.withColumns({f"c_{key}": best(f"k_{key}") for key in ("document", "alias", "url", "rank")}).filter("is_result")
    c = F.coalesce("c_document", "c_alias", F.least("c_url", "c_rank"))
    rows = rows.select(*dict.fromkeys([*columns, "retrieval_index"]), c.alias("c"))
    return rows.select("*", F.col("c.f").alias("fetch_id"), F.col("c.status").alias("fetch_status"), F.col("c").isNotNull().alias("model_fetched_document")).drop("c")


#: What the judge is asked; callers may give a text of their own with the same names.
QUESTION = """Question: {{ question }}
Reference answer: {{ gold_answer }}
Given answer: {{ final_answer }}
Page text cut: {{ text_truncated }}

{{{ model_visible_document }}}"""


def _member(value: Column, kind: StructType, name: str, other: str) -> Column:
    """A struct's member; null of the type other where the struct has none of that name."""
    return value[name] if name in kind.names else F.lit(None).cast(other)


def _whole(page: Column, kind: StructType) -> Column:
    """A page with all of its schema's members."""
    whole = DataType.fromDDL(schema.PAGE)
    members = [_member(page, kind, f.name, f.dataType.simpleString()).cast(f.dataType).alias(f.name) for f in whole]
    return F.when(page.isNotNull(), F.struct(*members))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f asks for it: an array of one element binds it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _matched(traces: DataFrame) -> Column:
    """Of a trace row: its searches (retrieval_id, search_query, shown), shown an array of results, each with the page that counts and the fetch
    that match_fetches would choose among the trace's own. A trace is a row, so that nothing is shuffled, and no trace sees another's fetches."""
    fetch, search = (traces.schema[c].dataType.elementType for c in ("fetches", "retrievals"))
    own_page = search["search_response"].dataType["results"].dataType.elementType["page_fetch"].dataType
    empty = lambda c: F.coalesce(c, F.lit(""))

    def named(f: Column, at: Column) -> Column:
        asked, page = _member(f, fetch, "requested_document_id", "string"), f["page_fetch"]
        document = F.when(empty(f["source_document_id"]) != "", f["source_document_id"]).otherwise(asked)
        order = F.struct((empty(page["fetch_status"]) != "success").cast("int").alias("s"), F.coalesce(f["iteration_num"], F.lit(0)).alias("i"), empty(f["fetch_id"]).alias("f"), at.alias("at"))
        return F.struct(f["source_retrieval_id"].alias("retrieval_id"), document.alias("document_id"), f["url"].alias("url"), f["source_rank"].alias("rank"), order.alias("o"), asked.alias("asked"), f["iteration_num"].alias("iteration"), _whole(page, fetch["page_fetch"].dataType).alias("page"))

    def with_fetch(x: Column, index: Column, mine: Column, fetches: Column) -> Column:
        given = (F.coalesce(index, F.lit(0)) != 0) & (F.coalesce(x["rank"], F.lit(0)) != 0)
        alias = F.when(given, F.concat(F.lit("s"), index.cast("string"), F.lit("r"), x["rank"].cast("string")))
        kind = lambda f: F.when(f["document_id"] == x["document_id"], 0).when(f["document_id"] == alias, 1).when((f["url"] == x["url"]) | (f["rank"] == x["rank"]), 2)
        found = F.filter(F.transform(mine, lambda f: F.struct(kind(f).alias("p"), f["o"].alias("o"))), lambda c: c["p"].isNotNull())

        def record(f: Column) -> Column:
            page = F.when(f.isNotNull(), f["page"]).otherwise(_whole(x["page_fetch"], own_page))
            source = F.when(f.isNotNull(), "fetch_tool").when(x["page_fetch"].isNotNull(), "search_result_auto_fetch").otherwise("none")
            result = F.struct(*[x[m].alias(m) for m in RESULT_MEMBERS])
            return F.struct(result.alias("result"), page.alias("page_fetch"), source.alias("page_fetch_source"), f.isNotNull().alias("model_fetched_document"), f["o"]["f"].alias("fetch_id"), f["asked"].alias("asked"), f["iteration"].alias("fetch_iteration"))

        return _bound(F.get(fetches, F.array_min(found)["o"]["at"]), record)

    def searched(r: Column, fetches: Column) -> Column:
        index = _member(r, search, "retrieval_index", "int")
        mine = F.filter(fetches, lambda f: (f["retrieval_id"] == r["retrieval_id"]) & (f["retrieval_id"] != "") & (f["document_id"] != ""))
        results = _bound(mine, lambda m: F.transform(r["search_response"]["results"], lambda x: with_fetch(x, index, m, fetches)))
        return F.struct(r["retrieval_id"].alias("retrieval_id"), r["search_query"].alias("search_query"), results.alias("shown"))

    return _bound(F.transform("fetches", named), lambda fetches: F.transform("retrievals", lambda r: searched(r, fetches)))


def judge_records(traces: DataFrame, template: str = QUESTION, max_chars: int = 0) -> DataFrame:
    """A record for each result of each trace: its document id, the page that counts, its surface and precheck, its signatures, and
    the messages that the judge sees, with the page's text cut to max_chars (0: whole)."""
    from tracelens.operators.traces import extra_text

    keys = ["provider_id", "query_id", "trace_id", "question", "gold_answer", "final_answer"]
    rows = traces.select(*keys, F.explode(_matched(traces)).alias("s")).select(*keys, "s.retrieval_id", "s.search_query", F.explode("s.shown").alias("x")).select(*keys, "retrieval_id", "search_query", "x.*")
    result = lambda m: F.col(f"result.{m}")
    rows = rows.withColumns({"document_id": result("document_id"), "rank": result("rank"), "url": result("url"), "normalized_url": T.normalize_url(result("url")), "extras": F.from_json(F.get_json_object("result.provider_metadata", "$.extra_snippets"), "array<string>")})
    rows = rows.withColumns({"judge_surface_class": surface_class(F.col("page_fetch_source"), F.col("page_fetch")), "document_garbage_precheck": garbage_precheck(F.col("page_fetch"))})

    def document(shown: Column) -> Column:
        extra = F.filter("extras", lambda x: F.coalesce(x, F.lit("")) != "")
        return R.search_xml(F.col("search_query"), F.col("provider_id"), R.document_xml(F.col("result").withField("page_fetch", shown), extra))

    messages, _ = R.judge_prompt(template, {"question": F.col("question"), "gold_answer": F.col("gold_answer"), "final_answer": F.col("final_answer"), "model_visible_document": document}, F.col("page_fetch"), max_chars)
    rows = rows.withColumn("messages", messages)
    signature = F.when(F.col("judge_surface_class") == "page_visible", page_signature(prompt())).otherwise("")
    return rows.select(
        F.lit(schema.JUDGE_VERSION).alias("schema_version"), F.lit("document_support").alias("judge_type"), "provider_id", "query_id", "trace_id", "retrieval_id", "search_query", "rank", F.col("result.title").alias("title"), "url", F.col("result.domain").alias("domain"), F.col("document_id").alias("source_document_id"), T.document_id(F.col("query_id"), F.col("provider_id"), F.col("retrieval_id"), F.col("rank")).alias("document_id"),
        "normalized_url", "page_fetch_source", "judge_surface_class", "model_fetched_document", "fetch_id", F.col("asked").alias("fetch_tool_requested_document_id"), F.col("fetch_iteration").alias("fetch_tool_iteration_num"), "page_fetch", "document_garbage_precheck", F.col("document_garbage_precheck.is_garbage").alias("effective_is_garbage"),
        snippet_signature(F.col("result"), F.col("normalized_url"), extra_text(F.col("extras"))).alias("judge_snippet_surface_signature"), signature.alias("judge_page_fetch_signature"), "messages",
    )


def exact_cache(records: DataFrame, cache: DataFrame) -> DataFrame:
    """The records whose key a valid cached row has with the same prompt; of rows that share a key the last counts."""
    known = cache.filter(valid(True)).groupBy(*KEY).agg(F.max_by(prompt(), F.col("seq")).alias("cached_prompt"))
    return records.join(known, KEY).filter(prompt() == F.col("cached_prompt")).drop("cached_prompt")


def reuse_classes(records: DataFrame, cache: DataFrame | Column | None = None) -> DataFrame:
    """Each record as exact_cache, duplicate or fresh: what a run in the order of seq would do.

    cache: rows of an earlier run, a condition that tells which records are also such rows, or none. A cached judgment and a
    fresh one make their reuse key known to later records; a record without a key is fresh. Both kinds of key name the query,
    so records and cached rows are dealt out by query together, once, and see each other in windows: no join. All of a query's
    records meet in one task.
    """
    added = {"reuse_key": reuse_key(), "prompt__": prompt()}
    if isinstance(cache, DataFrame):
        kinds = {f.name: f.dataType for f in records.schema}
        known = cache.filter(valid(True)).select(*[F.col(c).try_cast(kinds[c]).alias(c) for c in KEY], "seq", *[c.alias(n) for n, c in added.items()], F.lit(True).alias("known__"))
        rows = by_query(records.withColumns(added | {"known__": F.lit(False), "record__": F.lit(True)}).unionByName(known, allowMissingColumns=True))
    else:
        rows = by_query(records).withColumns(added | {"known__": F.lit(False) if cache is None else F.coalesce(cache, F.lit(False)) & valid(True), "record__": F.lit(True)})
    alike = Window.partitionBy("query_id", "reuse_key")
    rows = rows.withColumns({"first__": F.min(F.when(F.col("record__"), F.col("seq"))).over(alike), "early__": F.lit(False) if cache is None else F.bool_or("known__").over(alike)})
    hit = F.lit(False)
    if cache is not None:
        # Of cached rows that share a key the last counts. A row without a rank shares none.
        rows = rows.withColumn("cached__", F.max_by("prompt__", F.when(F.col("known__"), F.col("seq"))).over(Window.partitionBy(*KEY)))
        hit = F.col("rank").isNotNull() & (F.col("prompt__") == F.col("cached__"))
    again = F.col("reuse_key").isNotNull() & (F.col("early__") | (F.col("first__") < F.col("seq")))
    return rows.filter("record__").withColumn("reuse_class", F.when(hit, "exact_cache").when(again, "duplicate").otherwise("fresh")).select(*records.columns, "reuse_key", "reuse_class")


#: The flags of a record, by name; a flag counts only where it is true.
FLAGS = {
    "contains_gold": "judgment.contains_gold_answer",
    "gold_in_snippets": "judgment.gold_answer_in_snippets",
    "gold_in_extracted_page": "judgment.gold_answer_in_extracted_page",
    "supports_model": "judgment.supports_model_answer",
    "contradicts_gold": "judgment.contradicts_gold_answer",
    "judge_garbage": "judgment.is_garbage",
    "precheck_garbage": "document_garbage_precheck.is_garbage",
    "effective_garbage": "effective_is_garbage",
}


def flags() -> dict[str, Column]:
    """Every flag, and whether a record is in error. The first version's supports_gold is never set in this one."""
    return {n: _yes(c) for n, c in FLAGS.items()} | {"supports_gold": F.lit(False), "execution_error": _some("execution_error"), "parse_error": _some("judgment_parse_error")}


def summary(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and shares of all flags, of answers seen in one surface alone or in both, and the mean confidence."""
    f = flags()
    f |= {"only_in_snippets": f["gold_in_snippets"] & ~f["gold_in_extracted_page"], "only_in_page": f["gold_in_extracted_page"] & ~f["gold_in_snippets"], "in_both": f["gold_in_snippets"] & f["gold_in_extracted_page"]}
    found = records.groupBy(*(by or [])).agg(F.count("*").alias("records"), F.count_distinct(F.when(_some("query_id"), F.col("query_id"))).alias("queries"), F.bround(F.coalesce(F.avg("judgment.confidence"), F.lit(0.0)), 3).alias("avg_confidence"), *[F.count_if(c).alias(n) for n, c in f.items()])
    return found.withColumns({f"{n}_pct": T.per_cent(F.col(n), F.col("records")) for n in f})


def by_retrieval(records: DataFrame) -> DataFrame:
    """provider, query, retrieval, and its documents as an array sorted by rank."""
    return records.groupBy("provider_id", "query_id", "retrieval_id").agg(F.array_sort(F.collect_list(F.struct("rank", "url", "judge_surface_class"))).alias("documents"))


#: The labels that people validate, by name.
LABELS = {"snippet_gold": "gold_answer_in_snippets", "page_gold": "gold_answer_in_extracted_page", "contradiction": "contradicts_gold_answer"}


def _stem() -> Column:
    return T.case_stem(F.col("provider_id"), F.col("query_id"), F.col("retrieval_id"), F.col("rank"), F.col("judge_surface_class"))


def _by_label(values: dict[str, str], value: str) -> Column:
    """label, value and case_id of each label, of a row with the stem and a column for each label's value."""
    return F.array(*[F.struct(F.lit(n).alias("label"), F.col(c).alias(value), T.stem_label(F.col("stem"), F.lit(n)).alias("case_id")) for n, c in values.items()])


def unpivot(records: DataFrame) -> DataFrame:
    """Validation cases: a row for each label of a record that has a value. The stem is made once for all labels."""
    keys = ["provider_id", "query_id", "retrieval_id", "rank", "judge_surface_class"]
    rows = records.select(*keys, _stem().alias("stem"), *[F.col(f"judgment.{c}").alias(c) for c in LABELS.values()])
    return rows.select(*keys, F.inline(_by_label(LABELS, "value"))).filter("value IS NOT NULL")


def merged_cases(records: DataFrame) -> DataFrame:
    """The cases of unpivot, each once: case_id, provider_id, surface, label and machine, whether any of its records says yes.

    Records of a stem meet before they are unfolded: a third of the rows is shuffled.
    """
    flags = [F.bool_or(f"judgment.{c}").alias(c) for c in LABELS.values()]
    rows = records.groupBy(_stem().alias("stem"), "provider_id", F.col("judge_surface_class").alias("surface")).agg(*flags)
    return rows.select("provider_id", "surface", F.inline(_by_label(LABELS, "machine"))).filter("machine IS NOT NULL").select("case_id", "provider_id", "surface", "label", "machine")

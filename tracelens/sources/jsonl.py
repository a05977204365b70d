"""JSON-lines sources and sinks with explicit schemas.

Line order means something in trace files (the last line of a query holds), so rows carry file and line_num. Files are read by
Spark's line reader in splits; each line's number is its place among the lines of its file, found from the splits' own line
counts, so a file of any size is read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.functions import text as T

#: Providers that a file's name may hold, in the order in which they are looked for, and what a pointer file begins with.
KNOWN_PROVIDERS = ["brave", "tavily", "firecrawl", "exa"]
POINTER = "version https://git-lfs.github.com/spec/v1"
#: Fixed value: what the id of a question begins with, before the digits of its digest.
QUESTION_PREFIX = "sealhard_"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_num, line: every line of the files, blank ones included."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    # A split's lines keep their order under at. One row per split: a file's bytes over the split size.
    splits = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = splits.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "n", "first"))).alias("s"))
    before = before.select("file", F.posexplode("s").alias("i", "x"), "s").select("file", F.col("x.block").alias("block"), F.col("x.first").alias("first"), F.aggregate(F.slice("s", 1, F.col("i")), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("base"))
    return rows.join(before, ["file", "block"]).select("file", (F.col("base") + F.col("at") - F.col("first") + 1).alias("line_num"), "line")


def read_jsonl(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    """Rows with file and line_num; blank lines count and are left out. FAILFAST: reading a bad line raises and names the line."""
    rows = numbered_lines(spark, path).filter(T.strip(F.col("line")) != "")
    parsed = F.from_json("line", schema, {"mode": "PERMISSIVE"})
    if mode == "FAILFAST":
        error = F.concat(F.lit("bad JSON in line "), F.col("line_num").cast("string"), F.lit(" of "), F.col("file"))
        checked = F.when(F.try_parse_json("line").isNull(), F.raise_error(error).cast("string")).otherwise(F.col("line"))
        parsed = F.from_json(checked, schema, {"mode": "PERMISSIVE"})
    else:
        rows = rows.filter(F.try_parse_json("line").isNotNull())
    return rows.select("file", "line_num", parsed.alias("row")).select("row.*", "file", "line_num")


def schema_type(schema: str) -> str:
    return schema if schema.lower().startswith("struct<") else f"struct<{', '.join(_colon(c) for c in _columns(schema))}>"


def _columns(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


def _colon(column: str) -> str:
    name, kind = column.split(None, 1)
    return f"{name.rstrip(':')}:{kind}"


def read_tolerant(spark: SparkSession, path: str, schema: str, keep: Column | None = None) -> DataFrame:
    """Rows that parse and that keep holds for, with their source and line; others are skipped."""
    rows = read_jsonl(spark, path, schema, "PERMISSIVE").withColumnsRenamed({"file": "cache_source", "line_num": "cache_source_line_num"})
    return rows if keep is None else rows.filter(keep)


def read_array(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """A JSON document's array of objects, as rows."""
    return spark.read.schema(f"{member} ARRAY<{schema_type(schema)}>").json(path, multiLine=True).select(F.inline(member))


def with_defaults(rows: DataFrame) -> DataFrame:
    """Source questions: query_id from the question's digest and source_index from the line, where the file has none."""
    return rows.withColumns({"query_id": F.coalesce("query_id", T.stable_id(QUESTION_PREFIX, F.col("question"))), "source_index": F.coalesce("source_index", F.col("line_num") - 1)})


def public_record(rows: DataFrame) -> DataFrame:
    """The columns of a question that are given away, with defaults."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    none = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)
    return rows.select("query_id", "source_index", empty("question"), empty("answer"), none("urls"), empty("freshness"), none("question_types"), empty("effective_year"), empty("search_results"), empty("topic"), empty("canary"), none("golds"))


def read_semantic(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """The audit's table: provider in lower case, flags as booleans. With expected, each provider must have as many rows."""
    rows = spark.read.schema("provider STRING, query_id STRING, em INT, semantic_match INT, gold_answer STRING, model_answer STRING, judgement_note STRING").csv(path, sep="\t", header=True, enforceSchema=False)
    rows = rows.filter("query_id <> ''").select(F.lower("provider").alias("provider_id"), "query_id", (F.coalesce("em", F.lit(0)) != 0).alias("em"), (F.coalesce("semantic_match", F.lit(0)) != 0).alias("correct"))
    if expected is not None:
        sizes = rows.groupBy("provider_id").agg(F.count("*").alias("n")).filter(F.col("n") != expected).take(1)
        if sizes:
            raise ValueError(f"{sizes[0]['provider_id']} has {sizes[0]['n']} rows, not {expected}")
    return rows


def read_query_support(spark: SparkSession, path: str, universe: DataFrame) -> DataFrame:
    """A per-query support file: flags as numbers, the cell in upper case; queries outside the universe go."""
    kinds = {"provider": "STRING", "query_id": "STRING", "pre_fetch_surface_support": "INT", "post_fetch_discovered_support": "INT", "trajectory_visible_support": "INT", "legacy_visible_support": "INT", "fetched_any_url": "INT", "fetched_pre_fetch_support_url": "INT", "decision_cell": "STRING", "semantic_correct": "INT", "pre_fetch_support_url_count": "INT", "page_extracted_gold_url_count": "INT", "fetched_url_count": "INT", "valid_snippet_rows": "INT", "valid_page_rows": "INT"}
    rows = spark.read.schema(", ".join(f"{k} {v}" for k, v in kinds.items())).csv(path, header=True)
    rows = rows.withColumns({"provider_id": F.lower("provider"), "decision_cell": F.upper(F.coalesce("decision_cell", F.lit("")))}).drop("provider").na.fill(0)
    return rows.join(universe.select("provider_id", "query_id").distinct(), ["provider_id", "query_id"], "left_semi")


def read_artifacts(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Page artifacts (gzipped JSON below two levels of digest prefixes), with the digest of their path."""
    rows = spark.read.schema(schema).json(f"{root}/*/*/*.json.gz", multiLine=True).withColumn("path", F.col("_metadata.file_path"))
    return rows.withColumn("digest", F.regexp_extract("path", r"([0-9a-f]{64})\.json\.gz$", 1))


def lookup_artifacts(urls: DataFrame, artifacts: DataFrame, backend: str = "local") -> DataFrame:
    """urls with hit: whether the cache has the page."""
    digest = F.regexp_extract(T.artifact_path(F.col("url"), backend), r"([0-9a-f]{64})", 1)
    known = artifacts.select("digest").distinct().withColumn("hit", F.lit(True))
    return urls.withColumn("digest", digest).join(known, "digest", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def page_summary(artifacts: DataFrame) -> DataFrame:
    """An artifact's summary, with defaults where it is silent."""
    c = F.col
    return artifacts.select(F.lit("page_fetch_summary_v1").alias("schema_version"), F.when(F.coalesce("fetch_backend", F.lit("")) == "", "local").otherwise(c("fetch_backend")).alias("fetch_backend"), "url", "normalized_url", "final_url", "reader_url", c("path").alias("artifact_path"), c("extraction.status").alias("fetch_status"), c("http.status").alias("http_status"), c("http.content_type").alias("content_type"), F.coalesce("http.truncated_by_max_bytes", F.lit(False)).alias("truncated_by_max_bytes"), c("extraction.method").alias("extractor"), F.coalesce("extraction.text_chars", F.lit(0)).alias("extracted_text_chars"), F.coalesce("extraction.tokens_estimate", F.lit(0)).alias("extracted_text_tokens_estimate"), c("extraction.text_sha256").alias("text_sha256"), "fetch_latency_ms", c("extraction.error").alias("error"), F.coalesce("extraction.text", F.lit("")).alias("extracted_text"))


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """People's labels: a JSON object by case_id, as rows. A file that doesn't parse has none."""
    kind = "MAP<STRING, STRUCT<human_value: STRING, human_disagreement_pattern: STRING, human_notes: STRING, updated_at: STRING>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    return rows.select(F.explode("m").alias("case_id", "v")).select("case_id", F.col("v.human_value").alias("human_value"), F.col("v.human_disagreement_pattern").alias("pattern"), F.col("v.human_notes").alias("notes"), F.col("v.updated_at").alias("updated_at"))


def pointers(spark: SparkSession, path: str) -> DataFrame:
    """The files that are pointers to a large file rather than the file: one short row each."""
    heads = numbered_lines(spark, path).filter("line_num = 1")
    return heads.filter(F.startswith("line", F.lit(POINTER))).select("file")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, modified of the files, newest first; no content is read."""
    rows = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return rows.orderBy(F.desc("modified"), "file")


def settings(text: str) -> dict[str, str]:
    """key=value lines of a settings file; comments and quotes go. The caller decides whether they override others."""
    out = {}
    for line in text.splitlines():
        key, sign, value = line.strip().partition("=")
        if sign and key.strip() and not key.startswith("#"):
            out[key.strip()] = value.strip().strip("\"'")
    return out


def provider_label(rows: DataFrame) -> DataFrame:
    """file, provider: that of the file's last row, else a known one in its name, else the name."""
    stem = F.lower(F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1))
    named = F.coalesce(*[F.when(F.contains(stem, F.lit(p)), p) for p in KNOWN_PROVIDERS], stem)
    last = rows.groupBy("file").agg(F.max_by("provider_id", "line_num").alias("last"))
    return last.select("file", F.when(F.coalesce("last", F.lit("")) != "", F.col("last")).otherwise(named).alias("provider"))


def line(rows: DataFrame, number: int) -> DataFrame:
    """The row of that line; reading none raises."""
    found = rows.filter(F.col("line_num") == number)
    if not found.take(1):
        raise LookupError(f"there is no line {number}")
    return found

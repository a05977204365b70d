"""Search services' answers as result rows, from their JSON as VARIANT. Fetching them is left to a live connector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.functions import text as T


def _text(v: Column, *paths: str) -> Column:
    """The first member that holds text."""
    found = [F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths]
    return F.coalesce(*found, F.lit(""))


def items(payload: Column, *paths: str) -> Column:
    """The first of the paths that is an array, without elements that are no objects; else an empty one."""
    arrays = [F.try_variant_get(payload, p, "array<variant>") for p in paths]
    found = F.coalesce(*arrays, F.array().cast("array<variant>"))
    return F.filter(found, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))


def _highlights(v: Column) -> Column:
    many = F.array_join(F.coalesce(F.try_variant_get(v, "$.highlights", "array<string>"), F.array().cast("array<string>")), " ")
    return F.when(many != "", many).otherwise(_text(v, "$.highlights", "$.text", "$.summary"))


#: Each service: where its results lie, and how title, URL and snippet are read from one.
PARSERS = {
    "brave": (["$.web.results"], ["$.title"], ["$.url"], lambda v: _text(v, "$.description")),
    "tavily": (["$.results"], ["$.title"], ["$.url"], lambda v: _text(v, "$.content")),
    "firecrawl": (["$.data", "$.data.web"], ["$.title", "$.metadata.title"], ["$.url", "$.metadata.url"], lambda v: _text(v, "$.description", "$.metadata.description", "$.markdown", "$.content")),
    "exa": (["$.results"], ["$.title"], ["$.url"], _highlights),
}


def parse(responses: DataFrame, provider: str, payload: str = "payload") -> DataFrame:
    """The columns of responses but the payload (JSON text), with rank, title, url, snippet, domain, metadata of every result."""
    paths, title, url, snippet = PARSERS[provider]
    rest = [c for c in responses.columns if c != payload]
    rows = responses.withColumn(payload, F.try_parse_json(payload)).select(*rest, F.posexplode(items(F.col(payload), *paths)).alias("pos", "v"))
    v = F.col("v")
    shown = T.normalize_url(_text(v, *url))
    return rows.select(*rest, (F.col("pos") + 1).alias("rank"), T.truncate(_text(v, *title), 300).alias("title"), shown.alias("url"), T.truncate(snippet(v), 1000).alias("snippet"), T.root_domain(shown).alias("domain"), F.to_json(v).alias("metadata"))

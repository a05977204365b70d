"""Sinks: JSON lines, CSV, gzipped artifacts, Markdown tables. Files come from committed jobs, so one writer at a time needs no lock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tracelens.functions import text as T
from tracelens.sources.artifacts import ArtifactStore
from tracelens.workers import ship


def append_jsonl(rows: DataFrame, path: str, mode: str = "append", compression: str = "none") -> None:
    """JSON lines with sorted keys; null members are written too."""
    json = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    rows.select(json.alias("value")).write.mode(mode).text(path, compression=compression)


def write_judgments(rows: DataFrame, path: str, resume: bool, counts: list[Column] | None = None) -> dict[str, int]:
    """Judge records: added to what is there if the run resumes, else anew. Returns the counts, aggregates of rows, taken as they are written.

    The files are gzipped, as every record names all of its members; readers of JSON lines see the same lines. The counts are those of one run of each task; a job that is started again starts them anew.
    """
    seen = Observation()
    append_jsonl(rows.observe(seen, *counts) if counts else rows, path, "append" if resume else "overwrite", "gzip")
    return seen.get if counts else {}


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header, columns sorted unless given; nested members as JSON. Without rows there is an empty file."""
    flat = [F.to_json(F.col(f.name), {"ignoreNullFields": "false"}).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f.name) for f in rows.schema.fields]
    rows.select(*flat).select(columns or sorted(rows.columns)).write.mode("overwrite").csv(path, header=True)


def write_json(rows: DataFrame, path: str) -> None:
    rows.select(sorted(rows.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_artifacts(rows: DataFrame, root: str, backend: str = "local", url: str = "url") -> None:
    """One gzipped JSON for each page, below two levels of its digest's prefixes, in place of an older one. Of several rows of a page
    the greatest, as JSON, is written."""
    ship()
    rows.sparkSession.dataSource.register(ArtifactStore)
    digest = F.regexp_extract(T.artifact_path(F.col(url), backend), "([0-9a-f]{64})", 1)
    value = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    files = rows.select(digest.alias("digest"), value.alias("value")).groupBy("digest").agg(F.max("value").alias("value"))
    files.write.format(ArtifactStore.name()).mode("append").save(root)


def pivot(rows: DataFrame, index: str, columns: str, value: Column, order: Column | None = None) -> DataFrame:
    """A table of one row per index and one column per value of columns; of rows that share a cell the last by order holds, else the greatest."""
    return rows.groupBy(index).pivot(columns).agg(F.max(value) if order is None else F.max_by(value, order)).orderBy(index)


def markdown(table: DataFrame, most: int = 1000) -> str:
    """A report's table as text. Reports are small: more than most rows raise."""
    found = table.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of over {most} rows")
    shown = lambda v: "--" if v is None else f"{v:g}" if isinstance(v, float) else str(v)
    lines = [table.columns, ["---"] * len(table.columns), *[[shown(v) for v in r] for r in found]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"

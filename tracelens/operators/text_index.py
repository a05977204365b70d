"""Substring search through an index of trigrams.

The index has for every three characters that follow each other in a row's lowered text the keys of the rows that hold them, each once:
a row (gram, n, keys) for the rows of some megabytes of text, in folders by the gram's hash and sorted by gram, and beside it how many
rows each gram has. A query reads the counts of its own grams, the postings of the rarest of them, and of the rows that have all these
it verifies each. Rows that can't hold the query are not read beyond their keys.
Queries of under three characters have no gram: they scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracelens.workers import ship

#: Characters of a gram, folders of postings, and grams of a query whose postings are met.
GRAM, BUCKETS, MET = 3, 16, 3
#: So many candidates go to every executor; more meet the rows by a shuffle.
FEW = 100_000
#: Characters whose grams are sorted at once, but for a single longer text.
SORTED = 1 << 22


def searched(rows: DataFrame, columns: list[str]) -> Column:
    """The text that is searched: the columns, joined by blanks and lowered."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def write_index(rows: DataFrame, key: str, columns: list[str], folder: str) -> None:
    """Postings and counts of rows' texts; key is unique and not null."""
    ship()
    kind = to_arrow_type(rows.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column("key").cast(kind), batch.column("text")
            for at, size in _slices(np.asarray(pc.utf8_length(texts))):
                grams, count, which = _grams(texts.slice(at, size).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), keys.slice(at, size).take(pa.array(which)))
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(count, pa.int32()), lists], ["gram", "n", "keys"])

    each = rows.select(F.col(key).alias("key"), F.make_valid_utf8(searched(rows, columns)).alias("text"))
    each = each.mapInArrow(run, f"gram string, n int, keys array<{rows.schema[key].dataType.simpleString()}>").withColumn("bucket", bucket(F.col("gram")))
    # A common gram's rows are spread over some files of its folder: the first key's hash is dealt beside it.
    dealt = each.repartition("bucket", F.pmod(F.xxhash64(F.get("keys", F.lit(0))), F.lit(4))).sortWithinPartitions("bucket", "gram")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    postings = rows.sparkSession.read.parquet(f"{folder}/postings")
    counts = postings.groupBy("gram").agg(F.sum("n").alias("n"))
    counts.withColumn("bucket", bucket(F.col("gram"))).repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/counts")


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, number) of texts of so many characters that are sorted together."""
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        n = max(1, int(np.searchsorted(ends, before + SORTED, "right")) - at)
        yield at, n
        at += n


def _grams(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different grams of texts, in how many texts each is, and these texts' numbers, gram by gram."""
    data = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    seen = np.zeros(0x110000, bool)
    seen[data] = True
    letters = np.flatnonzero(seen)
    base = max(1, len(letters))
    if len(texts) > 1 and base**GRAM * len(texts) >= 1 << 63:  # so many letters that gram and text don't fit a number
        half = len(texts) // 2
        (g, n, w), (h, m, v) = _grams(texts[:half]), _grams(texts[half:])
        return g + h, np.append(n, m), np.append(w, v + half)
    place = np.zeros(0x110000, np.int64)
    place[letters] = np.arange(len(letters))
    text, x = np.repeat(np.arange(len(texts)), [len(t) for t in texts]), place[data]
    last = len(x) - GRAM + 1
    code = np.zeros(max(last, 0), np.int64)
    for i in range(GRAM if last > 0 else 0):
        code = code * base + x[i : i + last]
    whole = text[: len(code)] == text[GRAM - 1 :] if last > 0 else np.zeros(0, bool)
    pairs = np.sort(code[whole] * len(texts) + text[: len(code)][whole])
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
    code, which = np.divmod(pairs, max(1, len(texts)))
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    parts = np.stack([code[first] // base ** (GRAM - 1 - i) % base for i in range(GRAM)], 1)
    shown = letters[parts].astype("<u4").tobytes().decode("utf-32-le") if len(first) else ""
    return [shown[i : i + GRAM] for i in range(0, len(shown), GRAM)], np.diff(np.append(first, len(code))), which


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _of(spark: SparkSession, folder: str, grams: list[str]) -> DataFrame:
    """The rows of some grams: only their folders are listed, and their pages read."""
    in_folders = spark.createDataFrame([(g,) for g in grams], "gram string").select(bucket(F.col("gram")).alias("b")).distinct()
    return spark.read.parquet(folder).filter(F.col("bucket").isin([r["b"] for r in in_folders.collect()]) & F.col("gram").isin(grams))


def candidates(spark: SparkSession, folder: str, query: str) -> DataFrame | None:
    """key of the rows that hold the query's rarest grams; None where the query has none."""
    wanted = query.strip().lower()
    grams = sorted({wanted[i : i + GRAM] for i in range(len(wanted) - GRAM + 1)})
    if not grams:
        return None
    counts = {r["gram"]: r["n"] for r in _of(spark, f"{folder}/counts", grams).collect()}
    rarest = sorted(grams, key=lambda g: (counts.get(g, 0), g))[:MET]
    found = _of(spark, f"{folder}/postings", rarest).select(F.explode("keys").alias("key"))
    return found.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") == len(rarest)).select("key")


def search(rows: DataFrame, key: str, columns: list[str], query: str, folder: str) -> DataFrame:
    """The rows whose text holds the query, as text_search finds them: same columns."""
    wanted = query.strip().lower()
    if not wanted:
        return rows
    some = candidates(rows.sparkSession, folder, query)
    if some is not None:
        # What is sought comes with the candidates, so that Spark looks for it in their rows alone and not before the join in all.
        some = some.select(F.col("key").alias("candidate__"), F.lit(wanted).alias("wanted__")).persist()
        near = F.broadcast(some) if some.count() <= FEW else some
        return rows.join(near, (F.col(key) == F.col("candidate__")) & F.contains(searched(rows, columns), F.col("wanted__")), "left_semi")
    return rows.filter(F.contains(searched(rows, columns), F.lit(wanted)))

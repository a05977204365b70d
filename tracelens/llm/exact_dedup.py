"""Exact deduplication over a persistent digest index, in DataFrame operations only.

The index is a table bucketed and sorted by digest, one row per digest ever seen, in one partition per batch. A batch is reduced
to one row per digest (partial aggregation, so a group of any size is combined before the shuffle), anti-joined with the index by
sort-merge (the index side needs no exchange, its buckets are the join's partitions), and what is new is appended: written as
the batch's own partition, so a batch that is repeated after a failure writes the same rows again and sees none of its own.
compact() makes one partition of all, whose bucket files are sorted as they stand.

Defined results. Null text counts as empty; empty texts are equal to each other. Of equal texts the row with the most code
points stays, then the smallest doc_id (null last); of rows equal in both, one. A digest that the index holds already has
no row that stays: keep_id names the earlier batch's. An empty table gives an empty result and leaves the index as it is.
Extra columns are neither read nor returned.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm.common import SPACE, Work, cut, join_groups, partitions, setting, unused


class DigestIndex:
    """Table name(digest, keep_id, batch): bucketed and sorted by digest, a partition for each batch."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark, self.name = spark, name or f"digest_index_{uuid.uuid4().hex}"
        if not spark.catalog.tableExists(self.name):
            n = buckets or partitions(spark)
            spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS")
        self.buckets = next(int(r[1]) for r in spark.sql(f"DESCRIBE EXTENDED {self.name}").collect() if r[0] == "Num Buckets")

    def rows(self, but: str | None = None) -> DataFrame:
        """digest, keep_id; without the rows of the batch but."""
        held = self.spark.table(self.name)
        return (held if but is None else held.filter(F.col("batch") != but)).select("digest", "keep_id")

    def put(self, fresh: DataFrame, batch: str) -> None:
        rows = fresh.select("digest", "keep_id", F.lit(batch).alias("batch")).repartition(self.buckets, "digest")
        with setting(self.spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):  # this batch's partition alone
            rows.write.insertInto(self.name, overwrite=True)

    def compact(self) -> None:
        """All batches as one: one sorted file a bucket, which later joins needn't sort. The new partition is whole before the old go."""
        old = [r[0].split("=", 1)[1] for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()]
        with Work(self.spark):
            self.put(cut(self.rows().groupBy("digest").agg(F.min("keep_id").alias("keep_id"))), f"compact_{uuid.uuid4().hex}")
        for b in old:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (batch = '{b}')")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, doc_id, digest (SHA-256 of the text without white space), n_chars."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(F.translate(text, SPACE, ""), 256))
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), digest.alias("digest"), F.length(text).alias("n_chars"))


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256; the index gets what is new, under the batch's name."""
    with Work(docs.sparkSession) as work:
        return work.keep(_decide(docs, index, batch or uuid.uuid4().hex, id_col, text_col).drop("uid"))


def _decide(docs: DataFrame, index: DigestIndex, batch: str, id_col: str, text_col: str) -> DataFrame:
    fp = cut(fingerprints(docs, id_col, text_col))
    first = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.col("uid").alias("uid")))
    groups = cut(fp.groupBy("digest").agg(F.count("*").alias("group_size"), first.alias("w")))
    known = index.rows(but=batch)
    fresh = groups.join(known.select("digest").hint("merge"), "digest", "left_anti").select("digest", F.col("w.id").alias("keep_id"))
    index.put(cut(fresh), batch)  # a table that is read may not be overwritten, not even another partition
    before = known.select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("old")).hint("merge")
    winners = groups.join(before, "digest", "left")
    winners = winners.select("digest", F.when(F.col("old"), F.col("old_id")).otherwise(F.col("w.id")).alias("keep_id"), "group_size", F.when(F.col("old").isNull(), F.col("w.uid")).alias("winner"))
    decided = join_groups(fp, winners, ["digest"], "group_size", fp.count())
    return decided.select("uid", "doc_id", "keep_id", "group_size", F.coalesce(F.col("uid") == F.col("winner"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that deduplicate drops: same columns."""
    sha, n, place, key, digest = unused(docs, "sha", "n", "place", "kept_id", "kept_sha")
    index = DigestIndex(docs.sparkSession)
    try:
        found = deduplicate(docs, index, id_col=id_col, text_col=text_col).filter("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(digest))
    finally:
        index.drop()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({sha: F.sha2(F.translate(text, SPACE, ""), 256), n: F.length(text)})
    rows = rows.join(found, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(sha) == F.col(digest)), "left_semi")
    # Rows that share doc_id and normalised text: the one with the most code points, then the first of all columns as JSON, once.
    with Work(docs.sparkSession) as work:
        many = work.keep(rows.groupBy(F.col(id_col).alias(key), F.col(sha).alias(digest)).count().filter("count > 1").select(key, digest))
    if not many.take(1):
        return rows.select(*docs.columns)
    same = F.col(id_col).eqNullSafe(F.col(key)) & (F.col(sha) == F.col(digest))
    whole = F.struct(*[F.col(c) for c in docs.columns])
    first = F.min_by(whole, F.struct((-F.col(n)).alias("n"), F.to_json(whole).alias("all")))
    some = rows.join(many, same, "left_semi").groupBy(id_col, sha).agg(first.alias(place)).select(f"{place}.*")
    return rows.join(many, same, "left_anti").select(*docs.columns).unionByName(some)

"""A corpus from raw documents, stage by stage. Each stage takes (spark, docs, sf_dir) and its rows go to Parquet before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelens.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from tracelens.llm.common import Work, remove, table
from tracelens.llm.queries import tokenizer_path


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accept(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join (five words, 0.8)."""
    return jaccard_join.keep_representatives(docs, width=5, threshold=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix to target weights takes them."""
    return mixing.apply(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of what is left."""
    return bpe.digests(docs, tokenizer_path())


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: Classifier, shuffled mix and tokenizer have no SQL form: tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's rows go as soon as the next has read them, and the last's stay until the driver ends."""
    docs = table(spark, sf_dir, "documents")
    with Work(spark) as work:
        before = None
        for i, (_, stage) in enumerate(STAGES[:-1]):
            folder = f"{work.folder}/stage-{i}"
            stage(spark, docs, sf_dir).write.parquet(folder)
            docs = spark.read.parquet(folder)
            if before:
                remove(spark, before)
            before = folder
        return work.keep(STAGES[-1][1](spark, docs, sf_dir))

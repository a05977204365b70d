"""Structured Streaming over append-only trace folders: an extension, as the analytics themselves are batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tracelens.operators.relational import latest_by_key


def first_rows(spark: SparkSession, folder: str, schema: str, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """New lines of a folder of JSON files, the first of each key within the watermark."""
    return spark.readStream.schema(schema).json(folder).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def keep_latest(spark: SparkSession, folder: str, schema: str, keys: list[str], order: str, out: str, checkpoint: str) -> StreamingQuery:
    """Latest row of each key, as a table that grows by versions: each batch writes out/version=n from the one before and its own rows.

    A batch that is repeated writes its own version anew, so a retry changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch
        if number:
            rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{out}/version={number - 1}").unionByName(batch)
        latest_by_key(rows, keys, order).write.mode("overwrite").parquet(f"{out}/version={number}")

    stream = spark.readStream.schema(schema).json(folder)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

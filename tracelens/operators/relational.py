"""Relational operators of the trace analytics on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by order: an aggregation with map-side maxima, not a window over whole groups. Rows without a key go."""
    return rows.dropna(subset=keys).groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("r")).select("r.*")


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has not been done."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def first_writer(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Each row's class: 'fresh' for the first of its reuse key, 'duplicate' for later ones, 'unkeyed' without a key.

    order must tell rows of one key apart; of rows that it leaves equal one is fresh.
    """
    spread = F.when(F.col("reuse_key").isNull(), F.xxhash64(*order))  # rows without a key are no group
    rank = F.row_number().over(Window.partitionBy("reuse_key", spread).orderBy(*order))
    keyed = rows.withColumn("reuse_key", key)
    kind = F.when(F.col("reuse_key").isNull(), "unkeyed").when(rank == 1, "fresh").otherwise("duplicate")
    return keyed.withColumn("reuse_class", kind)


def decision_cell(pre: Column, fetched: Column, overlap: Column) -> Column:
    return F.when(pre & overlap, "SMART").when(pre, "MISSED").when(fetched, "BLIND").otherwise("NOOP")

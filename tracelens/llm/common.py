"""Helpers shared by the training-data operators: lineage cuts, skew-safe joins, blob shuffles, components."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space: 0x20 and 0x09-0x0D.
SPACE = " \t\n\x0b\f\r"
#: The same as a Java regular-expression class body.
SPACE_CLASS = r"\x20\x09-\x0D"
#: A group with more than 1/HOT of all rows is hot. There are fewer than HOT such groups at any size.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers of a local master import this package; a cluster gets it with --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def remove(spark: SparkSession, folder: str, at_exit: bool = False) -> None:
    """Deletes a folder in any store that Spark writes to; at_exit: when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.deleteOnExit(path) if at_exit else store.delete(path, True)


#: After so many tables of a step the driver's memory is settled.
TABLES = 8


def settle(spark: SparkSession) -> None:
    """Collects what the driver has let go of, so that Spark drops its shuffles and broadcasts, and returns free memory to the system.

    Plans of a long step leave the JVM's C heap in pieces, which it keeps until told; one that lacks the command keeps them.
    """
    gc.collect()
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    named = jvm.java.lang.Class.forName
    kinds, given = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
    for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[k] = named(name)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    with suppress(Py4JJavaError):
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)


class Work:
    """Tables in one folder below the shared one. What cut() writes inside the with block goes when the block ends."""

    current: ContextVar = ContextVar("work", default=None)

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.made = spark, f"{shared_dir(spark)}/work-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Work:
        self.outer = Work.current.get()
        Work.current.set(self)
        return self

    def __exit__(self, *error: object) -> None:
        Work.current.set(self.outer)
        remove(self.spark, self.folder)
        if self.made >= TABLES:
            settle(self.spark)

    def keep(self, df: DataFrame) -> DataFrame:
        """Like cut(), but the table outlives the block: until the block around it, or the driver, ends."""
        Work.current.set(self.outer)
        try:
            return cut(df)
        finally:
            Work.current.set(self)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting inside the with block."""
    was = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def cut(df: DataFrame) -> DataFrame:
    """Computes df once, into a table in the shared folder: later plans read it there, also after a lost executor."""
    spark, work = df.sparkSession, Work.current.get()
    if work:
        work.made += 1
        path = f"{work.folder}/{work.made}"
    else:
        path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
        remove(spark, path, at_exit=True)
    # Shuffle files of a query that ends in a table are of no further use, also after a lost executor: they go with it.
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    if work and work.made % TABLES == 0:
        settle(spark)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each prolonged until it is none of df's columns in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def give_back() -> None:
    """Returns a Python worker's free memory to the system; allocators that can't are left alone."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """How many [^\\x20\\x09-\\x0D]+ the text has; 0 for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, f"[{SPACE_CLASS}]+"))).cast("long")


def one_of_each(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str, text_col: str) -> DataFrame:
    """id, text, y: at most `most` labelled ids, those of least hash, a row each however many documents or labels the id has.

    Of several documents the one whose text comes first by hash, then by itself, stands for the id; of several labels the least.
    """
    some = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.min(label).alias("y"))
    some = some.orderBy(F.xxhash64("id"), "id").limit(most)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text").alias("text")))
    return own.join(F.broadcast(some), "id").groupBy("id", "y").agg(first.alias("one")).select("id", F.col("one.text").alias("text"), "y")


#: So many ids go to every executor: a few megabytes. More are joined by a shuffle; the result is the same.
FEW_IDS = 200_000


def of_ids(rows: DataFrame, ids: DataFrame, key: str, but: bool = False) -> DataFrame:
    """The rows whose key is among ids (a computed table of one column, distinct); with but, the others."""
    (name,) = unused(rows, "wanted_id")
    ids = ids.select(F.col(ids.columns[0]).alias(name))
    ids = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
    return rows.join(ids, F.col(key) == F.col(name), "left_anti" if but else "left_semi")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows joined (inner, null-safe) with groups, which has one row per key and its row count in column size.

    Groups of over total / HOT rows, fewer than HOT of them, are broadcast, so that their rows stay where they are; all
    others are joined by a shuffle whose largest key holds 1 / HOT of the rows.
    """
    hot, cold = groups.filter(F.col(size) * HOT > total), groups.filter(F.col(size) * HOT <= total)
    mine = unused(rows, *[f"group_{k}" for k in keys])

    def on(other: DataFrame) -> tuple[DataFrame, Column]:
        renamed = other.withColumnsRenamed(dict(zip(keys, mine)))
        cond = F.lit(True)
        for k, m in zip(keys, mine):
            cond = cond & rows[k].eqNullSafe(renamed[m])
        return renamed, cond

    far, cond = on(hot)
    near = rows.join(F.broadcast(far), cond).drop(*mine)
    far, cond = on(hot.select(*keys))
    rest = rows.join(F.broadcast(far), cond, "left_anti")
    cold = cold.withColumnsRenamed(dict(zip(keys, mine)))
    cond = F.lit(True)
    for k, m in zip(keys, mine):
        cond = cond & rest[k].eqNullSafe(cold[m])
    return near.unionByName(rest.join(cold, cond).drop(*mine))


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, out: str, buckets: int) -> DataFrame:
    """Adds column out: the sum of value over the rows of the group before this one, in the order of the columns order.

    order[0] must be a long that spreads evenly over 0 .. 2^62. A group's rows are dealt over buckets of that range, so
    that one group may hold most rows: sums run within a bucket, and the buckets' own sums are run up beside them.
    """
    df = df.withColumn("__b", F.floor(F.col(order[0]) / F.lit((1 << 62) // buckets + 1)).cast("int"))
    sums = df.groupBy(*group, "__b").agg(F.sum(value).alias("__s"))
    w = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__b").alias("__c"), F.coalesce(F.sum("__s").over(w), F.lit(0)).alias("__base"))
    w = Window.partitionBy(*group, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("__local", F.coalesce(F.sum(value).over(w), F.lit(0)))
    cond = F.col("__b") == F.col("__c")
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    joined = local.join(bases, cond)
    return joined.withColumn(out, F.col("__base") + F.col("__local")).drop("__b", "__c", "__base", "__local", *[f"__g{i}" for i in range(len(group))])


def counted_off(df: DataFrame, keys: list[str], uid: str, out: str) -> DataFrame:
    """Adds column out: 1, 2, ... for the rows of each key, in the order of uid, a table's column of monotonically_increasing_id().

    Rows are counted off within each partition that uid names, after the rows of the key in earlier ones: no task has a whole key.
    """
    part, at, n, base, *its = unused(df.withColumn(out, F.lit(0)), "part", "at", "n", "base", *[f"its_{k}" for k in keys])
    df = df.withColumn(part, F.shiftright(uid, 33))
    earlier = Window.partitionBy(*its).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    pieces = df.groupBy(*[F.col(k).alias(i) for k, i in zip(keys, its)], F.col(part).alias(at)).agg(F.count("*").alias(n))
    pieces = pieces.withColumn(base, F.coalesce(F.sum(n).over(earlier), F.lit(0)))
    same = F.col(part) == F.col(at)
    for k, i in zip(keys, its):
        same = same & F.col(k).eqNullSafe(F.col(i))
    rows = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys, part).orderBy(uid)))
    return rows.join(pieces, same).withColumn(out, F.col(out) + F.col(base)).drop(part, at, n, base, *its)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), both longs: rows (node, root), root the least node that node reaches.

    Alternating large-star and small-star steps. Every step is an aggregation with map-side minima and a join, cut by a
    checkpoint; the driver sees one count a round.
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:  # each round but the last merges neighbours, so it ends
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "u")
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(small_least, F.col("a") == F.col("u"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        new = cut(small.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        if new.count() == e.count() and not new.join(e, ["a", "b"], "left_anti").take(1):
            break
        e = new
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


# Blobs: numpy records that travel as one binary value per map batch and target partition.


def scatter(records: np.ndarray, by: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """The records for each target partition, dealt by the high bits of the well-mixed 64-bit numbers in by."""
    if not len(records):
        return
    to = ((by >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    records, to = records[order], to[order]
    cuts = np.flatnonzero(np.diff(to)) + 1
    starts = np.concatenate(([0], cuts))
    for s, e in zip(starts, np.concatenate((cuts, [len(to)]))):
        columns = [np.ascontiguousarray(records[n][s:e]).tobytes() for n in records.dtype.names]
        yield int(to[s]), len(records[s:e]).to_bytes(8, "little") + b"".join(columns)


def gather(blobs: list[bytes], dtype: np.dtype) -> np.ndarray:
    counts = [int.from_bytes(b[:8], "little") for b in blobs]
    out, at = np.empty(sum(counts), dtype), 0
    for b, n in zip(blobs, counts):
        pos = 8
        for name in dtype.names:
            kind = dtype[name]
            out[name][at : at + n] = np.frombuffer(b, kind, n, pos)
            pos += n * kind.itemsize
        at += n
    return out


def deal(df: DataFrame, parts: int) -> DataFrame:
    """Rows (part, blob) to the partitions that they name."""
    return df.repartitionById(parts, F.col("part"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable, which the optimiser cannot copy into each use."""
    return F.transform(F.array(value), body)[0]

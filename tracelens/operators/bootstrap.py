"""Paired bootstrap of provider metrics: one matrix of drawn queries for all providers and metrics.

Rows are (provider_id, query_id, ...) with each provider holding every query. Draw 4j + k of replicate r is the k-th 32 bits of
md5(seed:r:j), modulo the number of queries, so that it is the same everywhere and needs no random state. In place of these, draws can
be those of one Mersenne Twister that is asked for all replicates in turn, as Python's random.Random(seed).randrange gives them: one
pass over its words notes the generator's state where each task's replicates begin. Queries are numbered and lie
in blocks. A task makes the draws of some replicates once, counts how often each query is drawn in each, and gives these counts out by
block, mostly a byte each. With a block's rows another task multiplies its counts with the rows' values. Only these sums leave it, a
row for each replicate and group; they are added up over the blocks, and metrics are ratios of them. Draws grow with the queries, and
are never shuffled.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.workers import ship

#: The seed and the number of replicates.
SEED, REPLICATES = 20260628, 10_000
#: Queries of a block and replicates of a task, digests or words that are held at once, and bytes of counts that are given out together.
BLOCK, CHUNK, DIGESTS, WORDS, HELD = 1 << 14, 250, 1 << 16, 1 << 16, 1 << 25


def _sum(column: str) -> Column:
    """The sum over a replicate's queries, each as often as it was drawn."""
    return F.sum(column).cast("double")


def _ratio(a: str, b: str, times: int = 1) -> Callable[[], Column]:
    return lambda: times * _sum(a) / F.nullif(_sum(b), F.lit(0.0))


def _mean(column: str) -> Callable[[], Column]:
    return lambda: _sum(column) / F.sum("times")


#: The registry: each metric as an aggregate over a provider's sums.
METRICS: dict[str, Callable[[], Column]] = {
    "correct": lambda: _sum("correct"),
    "token_f1": _mean("token_f1"),
    "pre_support": lambda: _sum("pre_support"),
    "rank1_share": _ratio("rank1_rows", "pre_rows", 100),
    "contradiction_ratio": _ratio("contra_rows", "gold_rows"),
    "fetched": lambda: _sum("fetched"),
    "fetch_calls": _mean("fetch_calls"),
    "tokens": _mean("tokens"),
}
VALUES = ["correct", "token_f1", "pre_support", "rank1_rows", "pre_rows", "contra_rows", "gold_rows", "fetched", "fetch_calls", "tokens"]


def numbered(queries: DataFrame) -> DataFrame:
    """query_id and pos of each query: its place in the order of query_id, by a distributed sort (RDD zipWithIndex)."""
    found = queries.select("query_id").distinct().orderBy("query_id")
    pairs = found.rdd.zipWithIndex().map(lambda r: (r[0][0], r[1]))
    return queries.sparkSession.createDataFrame(pairs, f"query_id {dict(found.dtypes)['query_id']}, pos long")


def drawn(seed: int, replicate: int, n: int) -> Iterator[np.ndarray]:
    """The numbers of the n queries that a replicate draws, some at a time."""
    for at in range(0, -(-n // 4), DIGESTS):
        some = range(at, min(at + DIGESTS, -(-n // 4)))
        bits = b"".join([hashlib.md5(b"%d:%d:%d" % (seed, replicate, j), usedforsecurity=False).digest() for j in some])
        yield np.frombuffer(bits, ">u4")[: n - 4 * at].astype(np.int64) % n


@dataclass(frozen=True)
class Start:
    """A Mersenne Twister before some words, and how many of the draws from them are of earlier replicates."""

    key: np.ndarray
    pos: int
    skip: int

    def draws(self, n: int) -> Iterator[np.ndarray]:
        """Draws below n without end: words are cut to n's bits, and those that are n or more are left out."""
        bits, skip = np.random.MT19937(), self.skip
        bits.state = {"bit_generator": "MT19937", "state": {"key": self.key, "pos": self.pos}}
        while True:
            found = bits.random_raw(WORDS) >> np.uint64(32 - n.bit_length())
            yield found[found < n][skip:].astype(np.int64)
            skip = 0


def starts(seed: int, n: int, replicates: int) -> dict[int, Start]:
    """Where the replicates of each task begin in the sequence of random.Random(seed)."""
    if n >= 1 << 32:
        raise ValueError("a draw is one word of 32 bits")
    *key, pos = random.Random(seed).getstate()[1]
    bits, found, before, wanted = np.random.MT19937(), {}, 0, 0
    bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, np.uint32), "pos": pos}}
    while wanted < replicates:
        state = bits.state["state"]
        more = int((bits.random_raw(WORDS) >> np.uint64(32 - n.bit_length()) < n).sum())
        while wanted < replicates and wanted * n < before + more:
            found[wanted] = Start(state["key"], int(state["pos"]), wanted * n - before)
            wanted += CHUNK
        before += more
    return found


def drawn_sums(rows: DataFrame, groups: list[str], values: list[str], replicates: int = REPLICATES, seed: int = SEED, in_sequence: bool = False) -> DataFrame:
    """rep, the groups, times (queries drawn) and the sums of values: partial ones, to be added by rep and groups. rep -1 has every query once.

    rows has query_id, any number of rows of each; values are numbers without nulls, groups are of any type that Arrow has. in_sequence:
    draws are those of one Mersenne Twister.
    """
    ship()
    spark = rows.sparkSession
    number = numbered(rows).persist()
    n = number.count()
    placed = rows.join(number, "query_id").select("pos", *groups, *[F.col(v).cast("double").alias(v) for v in values])
    kinds = ", ".join(f"`{g}` {dict(rows.dtypes)[g]}" for g in groups)
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    firsts = spark.range(0, replicates, CHUNK, max(1, -(-replicates // CHUNK))).select(F.col("id").alias("first"))
    begin = spark.sparkContext.broadcast(starts(seed, n, replicates) if in_sequence and n else {})

    def each(first: int, reps: range) -> Iterator[tuple[int, np.ndarray]]:
        """The counts of all queries in each replicate: (replicate, times each is drawn)."""
        if not in_sequence:
            for rep in reps:
                yield rep, sum((np.bincount(some, minlength=n) for some in drawn(seed, rep, n)), np.zeros(n, np.int64))
            return
        at, rep, times = 0, first, np.zeros(n, np.int64)
        for some in begin.value[first].draws(n):
            while len(some):
                part, some = some[: n - at], some[n - at :]
                times += np.bincount(part, minlength=n)
                at += len(part)
                if at == n:
                    yield rep, times
                    at, rep, times = 0, rep + 1, np.zeros(n, np.int64)
                    if rep == reps.stop:
                        return

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column("first").to_pylist():
                held: list[np.ndarray] = []
                reps = range(first, min(first + CHUNK, replicates))
                at = first
                for rep, times in each(first, reps) if n else ():
                    held.append(times.astype(np.min_scalar_type(int(times.max()))))
                    if rep + 1 == reps.stop or sum(x.nbytes for x in held) >= HELD:
                        yield from spread(at, held)
                        at, held = rep + 1, []

    def spread(at: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Of some replicates from `at` a row for each block: its queries' counts, replicate by replicate."""
        matrix = np.stack(held)
        for block in range(-(-n // BLOCK)):
            part = matrix[:, block * BLOCK : (block + 1) * BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([at], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["block", "at", "reps", "times"])

    def multiply(key: tuple, counts: pa.Table, held: pa.Table) -> pa.Table:
        pos = held.column("pos").to_numpy() % BLOCK
        matrix = np.stack([np.ones(len(pos)), *[held.column(v).to_numpy() for v in values]], 1)
        keys = list(zip(*[held.column(g).to_pylist() for g in groups])) or [()] * len(pos)
        member: dict[tuple, list[int]] = {}
        for i, k in enumerate(keys):
            member.setdefault(k, []).append(i)
        width, reps, whose, total = min(BLOCK, n - key[0].as_py() * BLOCK), [], [], [np.zeros((0, 1 + len(values)))]
        for at, size, raw in zip(counts.column("at").to_pylist(), counts.column("reps").to_pylist(), counts.column("times")):
            raw = np.frombuffer(raw.as_buffer(), f"<u{len(raw.as_buffer()) // (size * width)}").reshape(size, width)
            times = raw.astype(float)
            for k, m in member.items():
                total.append(times[:, pos[m]] @ matrix[m])
                reps += range(at, at + size)
                whose += [k] * size
        sums = np.concatenate(total)
        columns = [pa.array(reps, pa.int64()), *[pa.array([k[i] for k in whose], held.schema.field(g).type) for i, g in enumerate(groups)], *[pa.array(sums[:, i]) for i in range(sums.shape[1])]]
        return pa.Table.from_arrays(columns, ["rep", *groups, "times", *values])

    schema = ", ".join(["rep long", *([kinds] if kinds else []), "times double", *[f"`{v}` double" for v in values]])
    counted = firsts.mapInArrow(count, "block long, at long, reps long, times binary")
    sums = counted.groupBy("block").cogroup(placed.withColumn("block", block).groupBy("block")).applyInArrow(multiply, schema)
    once = placed.groupBy(*groups).agg(F.count("*").cast("double").alias("times"), *[F.sum(v).alias(v) for v in values])
    return sums.unionByName(once.select(F.lit(-1).cast("long").alias("rep"), *groups, "times", *values))


def replicated(rows: DataFrame, replicates: int, seed: int = SEED, in_sequence: bool = False) -> DataFrame:
    """rep, provider_id, metric, value: every metric of every replicate, in long form."""
    sums = drawn_sums(rows, ["provider_id"], VALUES, replicates, seed, in_sequence).filter("times > 0")
    found = sums.groupBy("rep", "provider_id").agg(*[m().alias(n) for n, m in METRICS.items()])
    return found.unpivot(["rep", "provider_id"], list(METRICS), "metric", "value")


def _interval(values: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """estimate (rep -1), low and high: the 2.5 and 97.5 percentiles, linear between ranks, over the replicates that have a value."""
    some = F.when((F.col("rep") >= 0) & ~F.isnan("value"), F.col("value"))  # as many as there are replicates
    return values.groupBy(*keys).agg(*more, F.max(F.when(F.col("rep") == -1, F.col("value"))).alias("estimate"), F.percentile(some, 0.025).alias("low"), F.percentile(some, 0.975).alias("high"))


def intervals(rows: DataFrame, replicates: int = REPLICATES, seed: int = SEED, in_sequence: bool = False) -> DataFrame:
    return _interval(replicated(rows, replicates, seed, in_sequence), ["provider_id", "metric"])


def differences(rows: DataFrame, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """The same for the difference of each pair of providers, on the same draws."""
    found = F.array_sort(F.collect_list(F.struct("provider_id", "value")))
    v = replicated(rows, replicates, seed).groupBy("rep", "metric").agg(found.alias("all"))  # the providers of one metric
    later = lambda a: F.filter("all", lambda b: b["provider_id"] > a["provider_id"])
    pairs = F.flatten(F.transform("all", lambda a: F.transform(later(a), lambda b: F.struct(a["provider_id"].alias("provider_a"), b["provider_id"].alias("provider_b"), (a["value"] - b["value"]).alias("value")))))
    both = v.select("rep", "metric", F.inline(pairs))
    return _interval(both, ["provider_a", "provider_b", "metric"])


def cell_rates(rows: DataFrame, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """queries, correct, and the share of correct ones in per cent with its interval, by provider and decision cell."""
    sums = drawn_sums(rows, ["provider_id", "cell"], ["correct"], replicates, seed).filter("times > 0")
    total = sums.groupBy("rep", "provider_id", "cell").agg(F.sum("times").alias("c"), F.sum("correct").alias("ok"))
    value = total.withColumn("value", 100.0 * F.col("ok") / F.col("c"))
    whole = [F.max(F.when(F.col("rep") == -1, F.col(c))).cast("long").alias(name) for c, name in (("c", "queries"), ("ok", "correct"))]
    return _interval(value, ["provider_id", "cell"], *whole).filter("queries IS NOT NULL")

"""Exact quantiles of groups of any size: ranks are searched by histograms that narrow, pass by pass.

A group of many values never meets in one task. Each wanted rank has a range of values that it lies in, at first all of the group's.
A pass counts the values of each range in BUCKETS parts of equal width, with the least and the greatest value of each; the
part that holds the rank is its next range. A range of one value is the answer. Counts are combined before they are shuffled, so a
pass moves some thousand numbers a group. Groups of few values are left to Spark's own percentile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelens.workers import stored

#: A group is searched if it has more rows than this and than a thousandth of all: there are fewer than a thousand such groups.
FEW, BUCKETS = 10_000, 1024
#: How a rank is taken: linear between the two values around it, or the least value with that share of values up to it.
LINEAR, NEAREST = "linear", "nearest"


def quantiles(rows: DataFrame, groups: list[str], wanted: dict[str, tuple[str, float, str]], few: int = FEW) -> DataFrame:
    """The groups and, for each name in wanted, the quantile (column, share, LINEAR or NEAREST) as a double.

    Null values don't count; a group without any has null. A null group is a group. Values must not be NaN.
    """
    columns = sorted({c for c, _, _ in wanted.values()})
    rows = stored(rows.select(*groups, *[F.col(c).cast("double").alias(c) for c in columns]))
    sizes = rows.groupBy(*groups).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = stored(sizes.filter(F.col("n") > max(few, total // 1000)).select(*groups))
    small = _joined(rows, hot, groups, "left_anti").groupBy(*groups).agg(*[_own(c, q, kind).alias(name) for name, (c, q, kind) in wanted.items()])
    if not hot.take(1):
        return small
    each = F.array(*[F.struct(F.lit(i).alias("which"), F.col(c).alias("value")) for i, c in enumerate(columns)])
    values = stored(_joined(rows, hot, groups, "left_semi").select(*groups, F.inline(each)).filter("value IS NOT NULL"))
    found = _searched(values, groups, {n: (columns.index(c), q, kind) for n, (c, q, kind) in wanted.items()})
    large = hot.join(found.withColumnsRenamed({g: f"its_{g}" for g in groups}), _same(groups), "left").select(*groups, *wanted)
    return small.unionByName(large)


def _own(column: str, q: float, kind: str):
    return F.percentile(column, F.lit(q)) if kind == LINEAR else F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")


def _same(groups: list[str]):
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"its_{g}"))
    return same


def _joined(rows: DataFrame, few: DataFrame, groups: list[str], how: str) -> DataFrame:
    """rows with few, fewer than a thousand groups with some rows each."""
    return rows.join(F.broadcast(few.withColumnsRenamed({g: f"its_{g}" for g in groups})), _same(groups), how)


def _named(name: str):
    return lambda e: F.struct(F.lit(name).alias("name"), e["rank"].alias("rank"), e["weight"].alias("weight"))


def _searched(values: DataFrame, groups: list[str], wanted: dict[str, tuple[int, float, str]]) -> DataFrame:
    """The groups and wanted quantiles of values (groups, which, value)."""
    whole = values.groupBy(*groups, "which").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    ranks = []
    for name, (which, q, kind) in wanted.items():
        at = F.lit(q) * (F.col("n") - 1) if kind == LINEAR else F.greatest(F.ceil(F.lit(q) * F.col("n")), F.lit(1)).cast("double") - 1
        ends = F.array(F.struct(F.floor(at).alias("rank"), (F.lit(1.0) - (at - F.floor(at))).alias("weight")), F.struct(F.ceil(at).alias("rank"), (at - F.floor(at)).alias("weight")))
        named = F.transform(ends, _named(name))
        ranks.append(F.when(F.col("which") == which, named))
    asked = stored(whole.select(*groups, "which", "lo", "hi", F.explode(F.flatten(F.array_compact(F.array(*ranks)))).alias("r")).select(*groups, "which", "r.*", "lo", "hi"))
    ranges = asked.select(*groups, "which", "rank", "lo", "hi", F.lit(0).cast("long").alias("below")).distinct()
    done, ranges = ranges.filter("lo = hi"), stored(ranges.filter("lo < hi"))
    while ranges.take(1):
        spans = ranges.select(*groups, F.col("which").alias("its_which"), "lo", "hi").distinct()
        rows = _joined(values, spans, groups, "inner").filter("which = its_which AND value BETWEEN lo AND hi")
        part = F.least(F.lit(BUCKETS - 1), F.floor((F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BUCKETS))
        counts = rows.groupBy(*groups, "which", "lo", "hi", part.alias("part")).agg(F.count("*").alias("m"), F.min("value").alias("least"), F.max("value").alias("most"))
        before = Window.partitionBy(*groups, "which", "lo", "hi").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0)))  # BUCKETS rows a range
        its = counts.withColumnsRenamed({g: f"its_{g}" for g in groups}).withColumnsRenamed({"which": "its_which", "lo": "its_lo", "hi": "its_hi"})
        at = (F.col("which") == F.col("its_which")) & (F.col("lo") == F.col("its_lo")) & (F.col("hi") == F.col("its_hi"))
        held = (F.col("rank") >= F.col("below") + F.col("before")) & (F.col("rank") < F.col("below") + F.col("before") + F.col("m"))
        narrowed = ranges.join(its, _same(groups) & at & held)
        narrowed = stored(narrowed.select(*groups, "which", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("before")).alias("below")))
        done, ranges = done.unionByName(narrowed.filter("lo = hi")), narrowed.filter("lo < hi")
    answers = done.select(*[F.col(g).alias(f"its_{g}") for g in groups], F.col("which").alias("its_which"), F.col("rank").alias("its_rank"), F.col("lo").alias("value"))
    got = asked.join(answers, _same(groups) & (F.col("which") == F.col("its_which")) & (F.col("rank") == F.col("its_rank")))
    return got.groupBy(*groups).agg(*[F.sum(F.when((F.col("name") == name) & (F.col("weight") > 0), F.col("value") * F.col("weight"))).alias(name) for name in wanted])

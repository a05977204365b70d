"""Stratified and balanced samples, and how far a sample's distributions lie from the population's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the seed of the order in which rows are drawn.
SEED = 20260509


def drawn(key: str, seed: int = SEED) -> Column:
    """The key by which rows are put in a random but repeatable order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def apportion(cells: DataFrame, keys: list[str], total: int, size: str = "n") -> DataFrame:
    """Largest remainders: taken is the floor of the exact share, then one more each by (fraction, size, keys), descending.

    No cell gives more than it has: what is left goes round again. Cells are few beside rows, one of each stratum; their ranks
    come from a range-partitioned sort, so that their number is not bounded by one task.
    """
    whole = cells.agg(F.sum(size).alias("w")).first()["w"] or 0
    if total > whole:
        raise ValueError(f"{total} rows are asked for, and there are {whole}")
    exact = cells.withColumn("x__", F.col(size) * F.lit(float(total)) / F.lit(whole or 1))
    exact = exact.withColumns({"taken": F.least(F.col(size), F.floor("x__").cast("long")), "r__": F.col("x__") - F.floor("x__")}).drop("x__")
    rest = total - (exact.agg(F.sum("taken").alias("t")).first()["t"] or 0)
    while rest > 0:
        open_ = exact.filter(F.col("taken") < F.col(size))
        more = open_.orderBy(F.desc("r__"), F.desc(size), *[F.desc(k) for k in keys]).limit(rest).select(*[F.col(k).alias(f"{k}__") for k in keys], F.lit(1).alias("more__"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}__"))
        given = more.count()
        exact = exact.join(more, same, "left").withColumn("taken", F.col("taken") + F.coalesce("more__", F.lit(0))).drop("more__", *[f"{k}__" for k in keys])
        rest -= given
    return exact.drop("r__")


def stratified(rows: DataFrame, strata: list[str], key: str, total: int, seed: int = SEED) -> DataFrame:
    """total rows, of each stratum as many as apportion gives it, in the seeded order of key: the same columns."""
    shares = apportion(rows.groupBy(*strata).agg(F.count("*").alias("n")), strata, total)
    shares = shares.select(*[F.col(s).alias(f"{s}__") for s in strata], "taken")
    same = F.lit(True)
    for s in strata:
        same = same & F.col(s).eqNullSafe(F.col(f"{s}__"))
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("draw__", key))
    # A row_number with a bound keeps only the head of each stratum in every task before the shuffle.
    head = rows.withColumn("draw__", drawn(key, seed)).withColumn("rank__", rank).filter(F.col("rank__") <= total)
    return head.join(F.broadcast(shares), same).filter("rank__ <= taken").select(*rows.columns)


def balanced(rows: DataFrame, cells: list[str], flag: str, key: str, cap: int, seed: int = SEED) -> DataFrame:
    """Of each cell cap rows, half of either flag as far as there are, the rest from what remains."""
    order = [drawn(key, seed), F.col(key)]
    most = cap // 2
    r = rows.withColumn("rank__", F.row_number().over(Window.partitionBy(*cells, flag).orderBy(*order))).filter(F.col("rank__") <= cap)
    r = r.withColumn("chosen__", F.col("rank__") <= F.when(F.col(flag), most).otherwise(cap - most))
    r = r.withColumn("lack__", cap - F.count_if("chosen__").over(Window.partitionBy(*cells)))
    r = r.withColumn("more__", F.row_number().over(Window.partitionBy(*cells, "chosen__").orderBy(*order)))
    return r.filter(F.col("chosen__") | (F.col("more__") <= F.col("lack__"))).select(*rows.columns)


def balanced_keys(rows: DataFrame, cells: list[str], flag: str, key: str, cap: int, seed: int = SEED) -> DataFrame:
    """As balanced, of keys with several rows each, whose flag says whether any of its rows says yes (null: no say): cells, key and flag.

    Most keys come too late in the seeded order to be taken, so each cell's bounds on it are found first, and only rows within
    these are merged and sorted. A bound is a place in the order before which, it included, cap keys of the flag stand. Rows are
    dealt out by their key's digest into parts; the first key of a part has its merged flag, as all its rows are there. A cell
    that shows too few firsts of a flag has no bound for it, and all its rows are merged.
    """
    parts = 64 * cap
    yes, place = F.col(flag), F.conv(F.substring(drawn(key, seed), 1, 15), 16, 10).cast("long")
    rows = rows.filter(yes.isNotNull()).select(*cells, key, flag, F.coalesce(place, F.lit(-1)).alias("place__"))
    part, first = F.pmod("place__", F.lit(parts)).alias("part__"), F.shiftleft("place__", 1) + F.when(yes, 0).otherwise(1)
    # Of the rows at one place a yes comes first: an odd minimum is a key without any.
    firsts = rows.groupBy(*cells, part).agg(F.min(F.when(yes, F.col("place__"))).alias("yes__"), F.min(first).alias("first__"))
    no = F.when(F.col("first__").bitwiseAND(1) == 1, F.shiftright("first__", 1))
    bound = lambda c: F.coalesce(F.get(F.sort_array(F.collect_list(c)), F.lit(cap - 1)), F.lit(2**62))
    bounds = firsts.groupBy(*[F.col(c).alias(f"{c}__") for c in cells]).agg(bound(F.col("yes__")).alias("last_yes__"), bound(no).alias("last_no__"))
    same = F.lit(True)
    for c in cells:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__"))
    # A yes settles its key alone; up to the last no, all of a key's rows stay.
    within = (F.col("place__") <= F.col("last_no__")) | (yes & (F.col("place__") <= F.col("last_yes__")))
    near = rows.join(F.broadcast(bounds), same & within).groupBy(*cells, key).agg(F.bool_or(flag).alias(flag))
    return balanced(near, cells, flag, key, cap, seed)


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """value, n: how often each value stands there; of a list every element counts. Null reads None."""
    c = F.col(column)
    value = F.explode(F.transform(c, lambda x: x.cast("string"))) if rows.schema[column].dataType.typeName() == "array" else c.cast("string")
    return rows.select(value.alias("value")).groupBy(F.coalesce("value", F.lit("None")).alias("value")).agg(F.count("*").alias("n"))


def prevalence(rows: DataFrame, column: str) -> DataFrame:
    """value, n: in how many rows' lists each value stands."""
    return rows.select(F.explode(F.array_distinct(F.transform(column, lambda x: x.cast("string")))).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def drift(population: DataFrame, sample: DataFrame, column: str) -> DataFrame:
    """value, source_pct, sample_pct, delta_pp over the values of either."""

    def shares(rows: DataFrame, name: str) -> DataFrame:
        n = rows.agg(F.count("*").alias("all"))
        return distribution(rows, column).join(F.broadcast(n)).select("value", (F.col("n") * 100.0 / F.col("all")).alias(name))

    both = shares(population, "source_pct").join(shares(sample, "sample_pct"), "value", "full").na.fill(0.0)
    return both.withColumn("delta_pp", F.abs(F.col("source_pct") - F.col("sample_pct")))


def max_delta(population: DataFrame, sample: DataFrame, column: str) -> DataFrame:
    return drift(population, sample, column).agg(F.round(F.max("delta_pp"), 2).alias("max_delta_pp"))

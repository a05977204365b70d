"""Agreement of human labels with the machine's, quotas of reviews, and labels carried over to a new sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.functions import text as T
from tracelens.workers import stored


def reviewed(cases: DataFrame, progress: DataFrame) -> DataFrame:
    """cases (case_id, provider_id, surface, label, machine) with done, human (null: unclear or none) and pattern."""
    rows = cases.join(progress.select("case_id", "human_value", "pattern"), "case_id", "left")
    return rows.withColumns({"done": F.coalesce("human_value", F.lit("")) != "", "human": T.human_bool(F.col("human_value")), "pattern": F.when(F.coalesce("pattern", F.lit("")) == "", "unspecified").otherwise(F.col("pattern"))})


def agreement_report(cases: DataFrame, progress: DataFrame) -> DataFrame:
    """kind, name and counts by label, by provider, by surface and over all; the commonest pattern of disagreement, ties by name."""
    rows = reviewed(cases, progress).withColumn("same", F.col("human") == F.col("machine"))
    # Cases are counted once by all that the report asks for; the rest works on these counts.
    n, asked = F.col("n"), ["label", "provider_id", "surface", "pattern", "done", "human", "same"]
    counts = stored(rows.groupBy(*asked).agg(F.count("*").alias("n")))
    dims = {"label": F.col("label"), "provider": F.col("provider_id"), "surface": F.col("surface"), "all": F.lit("all")}
    rows = counts.select("*", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("name")) for k, c in dims.items()])))
    of = lambda c: F.sum(F.when(c, n).otherwise(0))
    found = rows.groupBy("kind", "name").agg(F.sum("n").alias("sampled"), of(F.col("done")).alias("reviewed"), of(F.col("human").isNotNull()).alias("clear"), of(F.col("done") & F.col("human").isNull()).alias("unclear"), of(F.col("same")).alias("agree"), of(~F.col("same")).alias("disagree"))
    per = rows.filter(~F.col("same")).groupBy("kind", "name", "pattern").agg(F.sum("n").alias("n"))
    top = per.groupBy("kind", "name").agg(F.min(F.struct((-n).alias("n"), "pattern"))["pattern"].alias("top_pattern"))
    found = found.join(top, ["kind", "name"], "left").withColumn("top_pattern", F.coalesce("top_pattern", F.lit("")))
    return found.withColumn("agreement_rate", T.rate(F.col("agree"), F.col("clear")))


def quotas(cases: DataFrame, progress: DataFrame, target: int = 5) -> DataFrame:
    """level (leaf, core, total): every combination of the dimensions, with what is to review and what is left."""
    rows = reviewed(cases, progress)
    keys = ["provider_id", "label", "surface", "machine"]
    # Cases are counted once; the dimensions' values, and all levels, come from these few counts.
    counted = stored(rows.groupBy(*keys).agg(F.count("*").alias("sampled"), F.count_if("done").alias("reviewed")))
    one = lambda c: counted.select(c).distinct()
    both = rows.sparkSession.createDataFrame([(True,), (False,)], "machine boolean")
    # The product of the dimensions' few values, not of rows.
    dims = one("provider_id").crossJoin(one("label")).crossJoin(one("surface")).crossJoin(both)
    leaf = dims.join(counted, keys, "left").na.fill(0, ["sampled", "reviewed"]).withColumn("target", F.least(F.lit(target).cast("long"), "sampled"))
    left = F.greatest(F.lit(0).cast("long"), F.col("target") - F.col("reviewed"))
    leaf = leaf.withColumns({"remaining": left, "complete": F.col("reviewed") >= F.col("target")})
    sums = [F.sum(c).alias(c) for c in ("sampled", "target", "reviewed")]
    core = leaf.groupBy("label", "surface", "machine").agg(*sums).withColumns({"remaining": left, "complete": F.col("reviewed") >= F.col("target")})
    total = leaf.agg(F.sum("sampled").alias("sampled"), F.sum("target").alias("target"), F.sum(F.least("reviewed", "target")).alias("reviewed"), F.sum("remaining").alias("remaining"), F.bool_and("complete").alias("complete"))
    out = leaf.withColumn("level", F.lit("leaf"))
    for name, part in (("core", core), ("total", total)):
        out = out.unionByName(part.withColumn("level", F.lit(name)), allowMissingColumns=True)
    return out.select("level", *keys, "sampled", "target", "reviewed", "remaining", "complete")


def merge_labels(cases: DataFrame, old: DataFrame) -> DataFrame:
    """A new sheet of cases that keeps what the old one's people have entered, by case_id; '' where nothing was."""
    rows = cases.join(old.dropDuplicates(["case_id"]), "case_id", "left")
    return rows.na.fill("", [c for c in old.columns if c != "case_id"])

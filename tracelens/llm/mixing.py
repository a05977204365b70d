"""Mixing sources to target weights by a low-discrepancy schedule.

Sources by code point (null last) have cyclic weights and share epochs x all sizes; no target passes limit x its source's
size, the excess is reshared by weight until none is above. Slot n of the schedule is the point frac(n x golden ratio),
mapped through the cumulative target shares to a source; a source's slots are ranked, and rank r stands for one block of
equal token count in the source's shuffled order (hash of doc_id and seed), epoch after epoch. Slots that a source still
lacks for its target when the sequence ends, as one of few words does, follow it by source. The last block of a source
is cut at its target, so what is taken meets the target to the word, and no document is taken more than limit times.

Defined results. Null and empty texts have size 0 and take nothing. Sources whose sizes are all 0 have target 0. Ties in
the shuffle are broken by doc_id, then by a hash of the text. Repeated rows count each, and each is taken as often as its own
share says. An empty table gives an empty result. Extra columns are ignored. The result depends on the rows and the seed alone,
not on their order: only which of several equal rows has which of their shares is open.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import SPACE, Work, counted_off, cut, join_groups, n_words, running_total, unused

GOLDEN = (math.sqrt(5) - 1) / 2


@dataclass
class Mixture:
    documents: DataFrame  # uid, doc_id, print (a hash of the text), source, size, source_size, target, taken
    schedule: DataFrame  # slot, srank, place (rank among the source's slots), block, epoch, take


def targets(sources: DataFrame, weights: tuple = (5, 2, 1), epochs: float = 1.5, limit: float = 2.0) -> DataFrame:
    """sources (source, source_size, n_docs) with srank, weight and target. The rank is a distributed sort's."""
    spark = sources.sparkSession
    ranked = sources.orderBy(F.asc_nulls_last("source")).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    ranked = spark.createDataFrame(ranked, "source string, source_size long, n_docs long, srank long")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("srank") % len(weights)).cast("int"))
    ranked = cut(ranked.withColumn("weight", weight))
    cap = limit * F.col("source_size")
    budget = epochs * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # the level only rises, and each turn caps one source more at least
        capped = F.col("weight") * level > cap
        s = ranked.agg(F.sum(F.when(capped, cap).otherwise(0.0)).alias("c"), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        new = (budget - (s["c"] or 0.0)) / s["w"] if s["w"] else level
        if new <= level * (1 + 1e-12) or not budget:
            break
        level = new
    return ranked.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, block: int = 64, weights: tuple = (5, 2, 1), epochs: float = 1.5, limit: float = 2.0) -> Mixture:
    with Work(docs.sparkSession) as work:
        found = _mix(docs, id_col, text_col, source_col, seed, block, weights, epochs, limit)
        return Mixture(work.keep(found.documents), work.keep(found.schedule))


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, block: int, weights: tuple, epochs: float, limit: float) -> Mixture:
    key = F.xxhash64(F.lit(seed), F.col(id_col)).bitwiseAND(F.lit((1 << 62) - 1))
    rows = cut(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("print"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("key")))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = cut(targets(sources, weights, epochs, limit))
    total = sources.agg(F.sum("n_docs").alias("n"), F.sum("target").alias("t"), F.min(F.when(F.col("target") > 0, F.col("target"))).alias("least"), F.count("*").alias("k")).first()
    n_docs, tokens = total["n"] or 0, total["t"] or 0.0
    rows = join_groups(rows, sources.select("source", "source_size", "n_docs", "target", "srank"), ["source"], "n_docs", n_docs)
    rows = cut(rows.drop("n_docs"))

    schedule = cut(schedule_of(sources, tokens, total["least"] or 1.0, total["k"], block))
    # Where each document's tokens lie in its source's shuffled stream, cut at block edges.
    placed = running_total(rows.filter("size > 0"), ["srank"], ["key", "doc_id", "print", "uid"], "size", "start", 1 + n_docs // 1_000)
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = placed.select("uid", "srank", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest("start", F.col("block") * block)
    pieces = pieces.select("uid", "srank", "block", (begin - F.col("block") * block).alias("from"), (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - begin).alias("len"))
    used = pieces.join(schedule.select("srank", "block", "take"), ["srank", "block"])
    part = F.greatest(F.lit(0), F.least(F.col("from") + F.col("len"), F.col("take")) - F.col("from"))
    taken = used.groupBy("uid").agg(F.sum(part).alias("taken"))
    documents = rows.join(taken, "uid", "left").select("uid", "doc_id", "print", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return Mixture(documents, schedule)


def schedule_of(sources: DataFrame, tokens: float, least: float, n_sources: int, block: int) -> DataFrame:
    spark = sources.sparkSession
    needed = math.ceil(tokens / block)
    # Points beyond the needed ones let sources that the sequence serves late reach their targets; others' are dropped.
    # A source of few words is a block in every epoch, more than its share of the points: what it lacks is appended below.
    n = needed + min(needed, math.ceil(4 * tokens / max(least, 1.0))) + 4 * n_sources if tokens else 0
    share = F.col("target") / F.lit(tokens or 1.0)
    cells, buckets = 4 * n_sources + 1, 1 + n_sources // 4_000
    by_rank = (F.col("srank") * F.lit((1 << 62) // max(n_sources, 1))).alias("at")
    served = sources.filter("target > 0").select(F.lit(0).alias("all"), by_rank, "srank", "source_size", "target", share.alias("share"))
    spans = running_total(served, ["all"], ["at"], "share", "lo", buckets).withColumn("hi", F.col("lo") + F.col("share"))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.lit(cells), F.floor(F.col("hi") * cells)))))
    spans = spans.select("cell", "lo", "hi", "srank", "source_size", F.floor("target").alias("goal"))
    high, low = F.floor(F.col("id") / (1 << 20)), F.col("id") % (1 << 20)
    step = GOLDEN * (1 << 20) % 1.0
    u = F.pmod(high * F.lit(step) + low * F.lit(GOLDEN), F.lit(1.0))
    slots = spark.range(n).select(F.col("id").alias("slot"), u.alias("u")).withColumn("scell", F.floor(F.col("u") * cells))
    lookup = F.broadcast(spans) if n_sources <= 100_000 else spans
    slots = slots.join(lookup, (F.col("scell") == F.col("cell")) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    slots = slots.select((F.col("slot") * F.lit((1 << 62) // max(n, 1))).alias("at"), "slot", "srank", "source_size", "goal", F.lit(1).cast("long").alias("one"))
    blocks = F.ceil(F.col("source_size") / block)
    need = F.expr("goal div source_size") * blocks + F.ceil((F.col("goal") % F.col("source_size")) / block)
    had = slots.groupBy("srank").agg(F.count("*").alias("had"))
    late = served.select("all", "at", "srank", "source_size", F.floor("target").alias("goal")).join(had, "srank", "left")
    late = late.withColumns({"had": F.coalesce("had", F.lit(0).cast("long")), "need": need.cast("long")}).filter("need > had")
    late = running_total(late.withColumn("lack", F.col("need") - F.col("had")), ["all"], ["at"], "lack", "earlier", buckets)
    late = late.withColumn("after", F.lit(n) + F.col("earlier") - F.col("had"))
    late = late.withColumn("place", F.explode(F.sequence(F.col("had"), F.col("need") - 1))).withColumn("slot", F.col("after") + F.col("place"))
    slots = running_total(slots, ["srank"], ["at"], "one", "place", 1 + n // 4_000)
    columns = ["slot", "srank", "source_size", "goal", "place"]
    slots = slots.select(*columns).unionByName(late.select(*columns))
    slots = slots.withColumns({"block": F.col("place") % blocks, "epoch": F.floor(F.col("place") / blocks)})
    at = F.col("epoch") * F.col("source_size") + F.col("block") * block
    return slots.filter(at < F.col("goal")).select("slot", "srank", "place", "block", "epoch", F.least(F.lit(block), F.col("goal") - at).cast("long").alias("take"))


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs as the mix takes them, same columns: a document taken twice comes twice, one taken in part is cut after its words.

    A row is found again by its id and a hash of its text; rows that share both are numbered on either side, so that each has
    the share of one of them.
    """
    found = mix(docs, id_col, text_col, **options).documents
    spark, (key, hashed, size, place, taken, turn, left, many) = docs.sparkSession, unused(docs, "taken_id", "print", "size", "place", "taken", "turn", "left", "many")
    found = found.select(F.col("doc_id").alias(key), F.col("print").alias(hashed), F.col("uid").alias(place), F.col("size").alias(size), F.col("taken").alias(taken))
    with Work(spark) as work:
        alike = work.keep(found.groupBy(key, hashed).agg(F.count("*").alias(many)).filter(F.col(many) > 1))
    own, other = unused(docs, "own_id", "own_print")
    rows = docs.withColumns({own: F.col(id_col), other: F.xxhash64(text_col)})
    same = F.col(own).eqNullSafe(F.col(key)) & (F.col(other) == F.col(hashed))
    names = alike.select(F.col(key).alias(own), F.col(hashed).alias(other))
    both = counted_off(found.join(names, same, "left_semi"), [key, hashed], place, turn).drop(place).withColumnRenamed(turn, place)
    one = found.join(names, same, "left_anti").filter(F.col(taken) > 0)
    uid, rank = unused(rows, "uid", "rank")
    with Work(spark) as work:  # numbered once, whatever is read again
        again = work.keep(rows.join(alike, same, "left_semi").withColumn(uid, F.monotonically_increasing_id()))
    again = counted_off(again, [own, other], uid, rank).drop(uid)
    again = again.join(both.filter(F.col(taken) > 0), same & (F.col(rank) == F.col(place))).drop(rank)
    rows = rows.join(one, same).unionByName(again)
    turns = F.sequence(F.lit(0).cast("long"), F.floor((F.col(taken) - 1) / F.col(size)))
    rows = rows.withColumn(turn, F.explode(turns)).withColumn(left, F.col(taken) - F.col(turn) * F.col(size))
    # The text up to the word numbered left: split before each word, so that white space stays as it was.
    starts = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"
    head = F.array_join(F.slice(F.split(F.btrim(F.col(text_col), F.lit(SPACE)), starts), 1, F.col(left).cast("int")), "")
    text = F.when(F.col(left) >= F.col(size), F.col(text_col)).otherwise(head)
    return rows.withColumn(text_col, text).select(*docs.columns)

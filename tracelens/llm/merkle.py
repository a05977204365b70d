"""Merkle manifest of a dataset, with proofs from the preimages of a leaf's ancestors.

A row's leaf is the SHA-256 of its fields, each with its length. Within a group the leaves ascend by the order column, and every
`fan` consecutive nodes have a parent, the SHA-256 of their hexadecimal digests joined (the last parent of a level may have
fewer, even one), until one node is left, the group's subroot. The subroots, by group, make a tree in the same way.

Stored is each parent's preimage: its children's digests, joined. A leaf joins its ancestors' preimages; cutting its own 64
characters from one leaves its siblings, and writing another digest in their place gives what a changed leaf would make of the
parent. Preimages lie in blocks of some levels, one row for all parents of up to WIDTH nodes, so that a tree of any height takes
a join or two, not one for each level: a block of one tier is a node of the next. Leaves are numbered by a sort dealt over ranges
and by sums of the ranges' counts, so a group of any size is spread.

Defined results. A null field is `-`; null order columns come first, ties go by the leaf (equal leaves are equal rows, and each
has a place of its own). The null group is a group, and the first; groups are in the order of their UTF-8 bytes. A lone leaf is its
group's subroot, a lone subroot the root; then there are no siblings. An empty table has no root and gives an empty result. Long texts are
hashed where they are and never moved. Other columns are neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.llm.common import Work, cut, partitions

#: Most nodes below a block of preimages; digits of a digest.
WIDTH, DIGITS = 256, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass
class Manifest:
    leaves: DataFrame  # key, idx (place in the group), place, hash, and what came along
    blocks: list[DataFrame]  # preimages over the leaves, tier by tier
    groups: DataFrame | None  # key, subroot, path (the preimages above it)
    root: str | None
    fan: int


def digest(*fields: Column) -> Column:
    """The leaf of some fields: `-` for null, else the number of UTF-8 bytes, a colon and the value."""

    def told(c: Column) -> Column:
        s = c.cast("string")
        return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return F.sha2(F.concat(*[told(c) for c in fields]), 256)


def levels_of(fan: int) -> int:
    """How many levels of parents a block holds."""
    n = 1
    while fan ** (n + 1) <= WIDTH:
        n += 1
    return n


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with idx, the row's place within its key by the columns order, and total, the key's rows."""
    placed = df.repartitionByRange(partitions(df.sparkSession), "key", *order).sortWithinPartitions("key", *order)
    placed = cut(placed.withColumn("uid", F.monotonically_increasing_id()))
    part = F.shiftright("uid", 33)
    pieces = placed.groupBy("key", part.alias("part")).agg(F.min("uid").alias("first"), F.count("*").alias("n"))
    every = Window.partitionBy("key")  # as many rows as ranges, at most
    earlier = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumns({"base": F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first"), "total": F.sum("n").over(every)})
    pieces = pieces.select(F.col("key").alias("its_key"), "part", "base", "total")
    joined = placed.join(pieces, (F.col("key") == F.col("its_key")) & (part == F.col("part")))
    return joined.withColumn("idx", F.col("uid") + F.col("base")).drop("uid", "its_key", "part", "base")


def tiers(nodes: DataFrame, fan: int) -> list[DataFrame]:
    """Blocks of preimages over nodes (key, idx, total, hash), tier by tier: key, block, total, m (nodes below), pre1, pre2, ..., node."""
    levels, found = levels_of(fan), []
    width = fan**levels
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most:
        block = F.floor(F.col("idx") / width).alias("block")
        below = F.sort_array(F.collect_list(F.struct("idx", "hash")))
        rows = nodes.groupBy("key", block, "total").agg(F.transform(below, lambda x: x["hash"]).alias("hashes"))
        rows = rows.withColumn("m", F.size("hashes"))
        for k in range(levels):
            heads = F.sequence(F.lit(0), F.floor((F.size("hashes") - 1) / fan).cast("int"))
            joined = F.transform(heads, lambda i: F.array_join(F.slice("hashes", i * fan + 1, fan), ""))
            rows = rows.withColumn(f"pre{k + 1}", F.when(F.col("total") > fan**k, joined))
            rows = rows.withColumn("hashes", F.when(F.col("total") > fan**k, F.transform(f"pre{k + 1}", lambda x: F.sha2(x, 256))).otherwise(F.col("hashes")))
        found.append(cut(rows.withColumn("node", F.col("hashes")[0]).drop("hashes")))
        total = F.ceil(F.col("total") / width)
        nodes = found[-1].filter(F.col("total") > width).select("key", F.col("block").alias("idx"), total.alias("total"), F.col("node").alias("hash"))
        most = -(-most // width) if most > width else 0
    return found


def _roots(found: list[DataFrame], fan: int) -> DataFrame:
    """key, hash: the node that is left of each key."""
    width, out = fan ** levels_of(fan), None
    for rows in found:
        done = rows.filter(F.col("total") <= width).select("key", F.col("node").alias("hash"))
        out = done if out is None else out.unionByName(done)
    return out


def _path(idx: Column, fan: int) -> Column:
    """The preimages in a block over its node idx, from below, and the node's slot in each."""
    steps = []
    for k in range(levels_of(fan)):
        at = F.floor(idx / fan ** (k + 1)).cast("int")
        steps.append(F.struct(F.get(f"pre{k + 1}", at).alias("pre"), (F.floor(idx / fan**k) % fan).cast("int").alias("slot")))
    return F.array(*steps)


def _joined(nodes: DataFrame, blocks: DataFrame, idx: Column, fan: int) -> DataFrame:
    """nodes with path: from the block that holds each (node number idx), then what is above the block."""
    width = fan ** levels_of(fan)
    over = blocks.drop("m", "node", "total").withColumnsRenamed({"key": "block_key", "path": "above"})
    rows = nodes.join(over, (F.col("key") == F.col("block_key")) & (F.floor(idx / width) == F.col("block")))
    return _upwards(rows.drop("block_key"), idx, fan)


def _upwards(rows: DataFrame, idx: Column, fan: int) -> DataFrame:
    """rows, nodes (number idx) beside their blocks, with path in place of the blocks and of above."""
    levels = levels_of(fan)
    rows = rows.withColumn("within", _path(idx % fan**levels, fan)).drop("block", *[f"pre{k + 1}" for k in range(levels)])
    path = F.concat(F.filter("within", lambda x: x["pre"].isNotNull()), "above")
    return rows.withColumn("path", path).drop("within", "above")


def _above(found: list[DataFrame], ends: DataFrame, fan: int) -> DataFrame:
    """The blocks of the lowest tier with path, the preimages above each; ends (key, path, ...) has what is above a key's last node."""
    width = fan ** levels_of(fan)
    last, extra = None, [c for c in ends.columns if c not in ("key", "path")]
    for rows in reversed(found):
        above = ends.select("key", F.lit(0).cast("long").alias("block"), "path", *extra)
        held = rows.filter(F.col("total") <= width).join(above, ["key", "block"])
        if last is not None:
            held = held.unionByName(rows.filter(F.col("total") > width).join(last, ["key", "block"]))
        last = held
        if rows is not found[0]:
            below = F.explode(F.sequence(F.col("block") * width, F.col("block") * width + F.col("m") - 1))
            nodes = held.withColumn("idx", below).withColumnRenamed("path", "above").drop("m", "node", "total")
            last = cut(_upwards(nodes, F.col("idx"), fan).withColumnRenamed("idx", "block"))
    return last


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", fan: int = 2, **also: Column) -> Manifest:
    """The manifest of docs; the leaves carry the columns also."""
    # A key that is never null and sorts as the groups do: null, then by bytes.
    key = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("."), F.col(group).cast("string")))
    leaves = docs.select(key.alias("key"), F.col(order).alias("place"), digest(*[F.col(c) for c in fields]).alias("hash"), *[c.alias(n) for n, c in also.items()])
    leaves = cut(numbered(leaves, ["place", "hash", *also]))
    blocks = tiers(leaves, fan)
    if not blocks:
        return Manifest(leaves, [], None, None, fan)
    subroots = _roots(blocks, fan).select(F.lit("").alias("key"), F.col("key").alias("group"), "hash")
    subroots = cut(numbered(subroots, ["group"]))
    top = tiers(subroots, fan)
    nothing = F.array().cast("array<struct<pre:string,slot:int>>")
    ends = subroots.filter("idx = 0").select("key", nothing.alias("path"))
    groups = _joined(subroots, _above(top, ends, fan), F.col("idx"), fan)
    groups = cut(groups.select(F.col("group").alias("key"), F.col("hash").alias("subroot"), "path"))
    return Manifest(leaves, blocks, groups, _roots(top, fan).first()["hash"], fan)


def prove(manifest: Manifest) -> DataFrame:
    """The leaves with path (their ancestors' preimages, from below, and the slot in each) and subroot."""
    blocks = _above(manifest.blocks, manifest.groups, manifest.fan)
    return _joined(manifest.leaves, blocks, F.col("idx"), manifest.fan)


def siblings(path: Column) -> Column:
    """The digests beside a leaf and its ancestors: each preimage without the own slot."""
    return F.array_join(F.transform(path, lambda x: F.concat(_before(x), _after(x))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf makes: its digest is written into its slot, the parent's into the next, and so on."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(_before(x), node, _after(x)), 256))


def _before(x: Column) -> Column:
    return F.substring(x["pre"], F.lit(1), x["slot"] * DIGITS)


def _after(x: Column) -> Column:
    return F.substring(x["pre"], (x["slot"] + 1) * DIGITS + 1, F.length(x["pre"]))


def audit(docs: DataFrame, changed: Column, changes: dict[str, Column], fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", fan: int = 2) -> DataFrame:
    """Each row's leaf, subroot, root and proof, and what its leaf folds to; rows for which changed holds have the changes by then.

    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    with Work(docs.sparkSession) as work:
        now = digest(*[changes.get(c, F.col(c)) for c in fields])
        manifest = build(docs, fields, group, order, fan, now=F.when(F.coalesce(changed, F.lit(False)), now))
        if not manifest.root:
            return work.keep(docs.select(F.col(order).alias("doc_id"), *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified")).limit(0))
        rows = prove(manifest).select("place", "hash", "subroot", "path", F.coalesce("now", "hash").alias("now"))
        rows = rows.select(
            F.col("place").alias("doc_id"),
            F.col("hash").alias("leaf"),
            "subroot",
            F.lit(manifest.root).alias("root"),
            F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
            folded(F.col("now"), F.col("path")).alias("folded_root"),
        )
        return work.keep(rows.withColumn("verified", F.col("folded_root") == F.col("root")))

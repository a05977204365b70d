"""SimHash near-duplicates: exact comparison of all fingerprints in tiles, by exclusive-or and bit counts.

A text's words make shingles of `width` words, repeats included, joined by blanks; each is hashed by XXH64 (seed 42). A bit of
the fingerprint is 1 if it is set in over half of the hashes. Two fingerprints link when at most `radius` bits differ.

Equal fingerprints are one node. The nodes lie in cells by the number of their ones, from 0 to 64; two of cells further apart
than the radius can't link, so such cells never meet. A cell is cut into tiles of some TILE nodes by a hash, and each pair of tiles
of near cells is one row of work: it has two arrays of numbers, whatever their groups are. In it nodes of equal bit counts in each
quarter are a small tile; pairs of these whose counts by quarter differ beyond the radius are skipped, all others are compared by
numpy. Of the links that are found a row returns a spanning forest alone: no more than it
has nodes, however many of them agree. Connected components of all forests are those of all links.

Defined results. Null, empty and blank texts have fingerprint zero, and link like any other. Texts of fewer words than `width`
have one shingle of them all. Words are lower-cased for A-Z. Repeated rows, and rows that share a doc_id, give a row each; their
component is that of all links of the doc_id. A row of null doc_id links, and joins others, like any row, but its own component
is null and it names none. An empty table gives an empty result. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import Work, components, cut, give_back, join_groups, of_ids, partitions, setting, ship

SEED, BITS = 42, 64
#: Nodes of a tile, about, and those of a small tile that are compared at once.
TILE, SMALL = 1 << 15, 128
#: Texts that are hashed at once: at most so many bytes, but for a single longer one; and shingles of them.
BYTES, SHINGLES = 4 << 20, 1 << 18
_LANES = np.uint64(0x0101010101010101)


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """In how many hashes each bit is set, for each group of them; groups begin at starts, and none is empty."""
    # Eight counters of a byte each are summed as one number, so a sum has at most 255 terms: longer groups are cut.
    ends = np.append(starts[1:], len(hashes))
    pieces = -(-(ends - starts) // 255)
    group = np.repeat(np.arange(len(starts)), pieces)
    first = np.cumsum(pieces) - pieces
    at = starts[group] + 255 * (np.arange(len(group)) - first[group])
    counts = np.empty((len(at), 8, 8), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, at)
        counts[:, :, k] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.add.reduceat(counts.reshape(-1, BITS), first)


def _of_texts(texts: pa.Array, width: int) -> np.ndarray:
    """The fingerprint of each text."""
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    plain = pc.binary_join(words, pa.scalar(" ", pa.large_string())).cast(pa.large_binary())
    edges = np.frombuffer(plain.buffers()[1], "<i8", len(plain) + 1, 8 * plain.offset)
    data = plain.buffers()[2].to_pybytes() if plain.buffers()[2] else b""
    out = np.zeros(len(texts), np.uint64)
    # Words begin at the edges of texts that have any, and after blanks.
    some = np.flatnonzero(np.diff(edges))
    blanks = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    blanks = blanks[(blanks >= edges[0]) & (blanks < edges[-1])]
    begin = np.sort(np.concatenate([edges[some], blanks + 1]))
    end = np.sort(np.concatenate([blanks, edges[some + 1]]))
    bounds = np.append(np.searchsorted(begin, edges[some]), len(begin))
    n = np.diff(bounds)
    m = np.maximum(n - width + 1, 1)  # shingles of each text
    totals = np.zeros((len(some), BITS), np.int64)
    starts = np.cumsum(m) - m
    for at in range(0, int(m.sum()), SHINGLES):
        number = np.arange(at, min(at + SHINGLES, int(m.sum())))
        text = np.searchsorted(starts, number, "right") - 1
        word = bounds[text] + number - starts[text]
        last = np.minimum(word + width, bounds[text + 1]) - 1
        digest = xxhash.xxh64_digest
        hashes = np.frombuffer(b"".join([digest(data[x:y], SEED) for x, y in zip(begin[word].tolist(), end[last].tolist())]), ">u8").astype(np.uint64)
        new = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        totals[text[new]] += bit_counts(hashes, new)
    ones = 2 * totals > m[:, None]
    out[some] = np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and node (the fingerprint as a signed long) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
            size, at = np.asarray(pc.binary_length(texts)), 0
            found = []
            while at < len(texts):
                n = max(1, int(np.searchsorted(np.cumsum(size[at:]), BYTES, "right")))
                found.append(_of_texts(texts.slice(at, n), width))
                at += n
            node = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(node.view(np.int64), pa.int64())], ["doc_id", "node"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, node long")


def _small(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes by the bit counts of their quarters, where each small tile of equal counts begins (and the end), and its counts."""
    counts = np.bitwise_count(nodes.astype("<u8").view("<u2").reshape(-1, 4)).astype(np.int64)
    order = np.lexsort(counts.T)
    counts = counts[order]
    new = np.flatnonzero((counts[1:] != counts[:-1]).any(1)) + 1
    first = np.concatenate([[0], new]) if len(nodes) else np.zeros(0, np.int64)
    return nodes[order], np.append(first, len(nodes)), counts[first]


class _Forest:
    """Which nodes of two tiles belong together, and the links that made it so."""

    def __init__(self, nodes: np.ndarray):
        self.nodes, self.label, self.links = nodes, np.arange(len(nodes)), []

    def join(self, a: int, others: np.ndarray) -> None:
        mine, theirs = self.label[a], self.label[others]
        differ = theirs != mine
        if not differ.any():
            return
        labels, first = np.unique(theirs[differ], return_index=True)
        self.links += [(a, int(b)) for b in others[differ][first]]
        self.label[np.isin(self.label, labels)] = mine


def links_of(a: np.ndarray, b: np.ndarray, radius: int, one: bool = False) -> np.ndarray:
    """A spanning forest, as pairs of nodes, of the links between the tiles a and b; or within them, if they are one."""
    a, at_a, counts_a = _small(a)
    b, at_b, counts_b = (a, at_a, counts_a) if one else _small(b)
    base = 0 if one else len(a)
    forest = _Forest(a if one else np.concatenate([a, b]))
    for i, (x, y) in enumerate(zip(at_a[:-1], at_a[1:])):
        near = np.flatnonzero(np.abs(counts_a[i] - counts_b).sum(1) <= radius)
        size = at_b[near + 1] - at_b[near]
        where = np.repeat(at_b[near] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        for k in range(x, y, SMALL):
            linked = np.bitwise_count(a[k : min(k + SMALL, y), None] ^ b[where]) <= radius
            for n in np.flatnonzero(linked.any(1)):
                forest.join(k + n, base + where[linked[n]])
    return forest.nodes[np.array(forest.links, np.int64).reshape(-1, 2)]


def tile_links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b), a table, whose components are those of all links between nodes (one column node, distinct)."""
    spark = nodes.sparkSession
    ship(spark)
    celled = nodes.select("node", F.bit_count("node").alias("cell"))
    counts = celled.groupBy("cell").count().collect()  # 65 cells at most
    tiles = {r["cell"]: -(-r["count"] // TILE) for r in counts}
    near = [(c, d, n) for c in tiles for d, n in tiles.items() if c <= d <= c + radius]
    plan = F.broadcast(spark.createDataFrame(near, "cell int, other int, others int"))
    count = F.broadcast(spark.createDataFrame(list(tiles.items()), "cell int, tiles int"))
    spread = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    held = cut(celled.join(count, "cell").groupBy("cell", spread.alias("tile")).agg(F.collect_list("node").alias("nodes")))
    first = F.when(F.col("cell") == F.col("other"), F.col("tile")).otherwise(F.lit(0))
    pairs = held.select("cell", "tile").join(plan, "cell").select("cell", "tile", "other", F.explode(F.sequence(first, F.col("others") - 1)).alias("far"))
    work = pairs.join(held, ["cell", "tile"]).withColumnRenamed("nodes", "left")
    work = work.join(held.select(F.col("cell").alias("other"), F.col("tile").alias("far"), F.col("nodes").alias("right")), ["other", "far"])
    work = work.select("left", "right", ((F.col("cell") == F.col("other")) & (F.col("tile") == F.col("far"))).alias("one")).repartition(partitions(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, one in zip(batch.column("left"), batch.column("right"), batch.column("one").to_pylist()):
                found = links_of(*(np.asarray(v.values).view(np.uint64) for v in (x, y)), radius, one)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, i].view(np.int64), pa.int64()) for i in (0, 1)], ["a", "b"])

    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "32"):  # rows of half a megabyte
        return cut(work.mapInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, links): doc_id, fingerprint (hexadecimal), component_id of every row; and links between fingerprints, a forest of each two tiles'."""
    with Work(docs.sparkSession) as work:
        found, links = _near_duplicates(docs, width, radius, id_col, text_col)
        return work.keep(found), work.keep(links)


def _near_duplicates(docs: DataFrame, width: int, radius: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    named = cut(fingerprints(docs, width, id_col, text_col))
    classes = cut(named.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("g")))
    links = tile_links(classes.select("node"), radius)
    roots = cut(components(links))
    classes = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Rows of one doc_id belong together too.
    rows = join_groups(named, cut(classes), ["node"], "g", named.count()).select("doc_id", "node", "root")
    shared = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("root").alias("a"), F.max("root").alias("z")).filter("a <> z").select("doc_id", "a")
    shared = cut(shared)
    if shared.take(1):
        merged = components(rows.join(shared, "doc_id").select("a", F.col("root").alias("b")).distinct())
        into = merged.select(F.col("node").alias("root"), F.col("root").alias("into"))
        rows = rows.join(into, "root", "left").select("doc_id", "node", F.coalesce("into", "root").alias("root"))
    rows = cut(rows)
    ids = cut(rows.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("g")))
    found = join_groups(rows, ids, ["root"], "g", rows.count())
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), component.alias("component_id")), links


def keep_representatives(docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, that of least doc_id (rows of a null doc_id stay): same columns."""
    found, _ = near_duplicates(docs, width, radius, id_col, text_col)
    return of_ids(docs, cut(found.filter("component_id < doc_id").select("doc_id").distinct()), id_col, but=True)

"""N-gram Jaccard join by vertical partitioning.

A document is the set of its distinct shingles of `width` words, as 64-bit hashes; documents with one set are one class from
the start. The global n-gram order is that of the hashes. It is cut into fragments, more than two linked sets can differ in
shingles: so these agree in a whole fragment, and that fragment's digest is a key under which they meet. The number of fragments
goes by classes of set size; a set also uses the next class's fragments if a partner may lie there. A set with so many empty
fragments that the count of the others does not suffice also has its first shingles as keys, for partners of the same kind.
Under a key the set that meets the most others, over all its keys, is the centre (in a group of copies the one that the others
are closest to), and the others are its spokes. Keys of a thousandth of all documents or more are hot: their members are dealt
by key and set, and only counted by aggregations.

Pairs are counted by the same partitioning: the hash order is cut into fragments, the overlaps of the two sets are counted
fragment by fragment and summed per pair. Before any set is moved, pairs are dropped whose sizes by finer fragments (some three
shingles each) allow no link; a spoke stays if they allow twice the distance of a link. Linked spokes give components.

What could still join two components is compared without writing pairs. Around a centre, the difference of two sets is that of
their differences from it, counted over an inverted list of these; under a key, sets of which one was not counted against the
centre go by their sizes by fragment, and what these allow is verified like the spokes. In each such group the rows outside
its largest component (strays) or those that weren't counted, whichever are fewer, are compared with all members, in blocks of at
most `block` by `block` rows, so a group of any size is split over tasks. So every pair that could join two components is
verified or ruled out.

Defined results. Text is lower-cased for A-Z; words are [^\\x20\\x09-\\x0D]+. With fewer words than `width`, the sequence of all
words is the one shingle. Null, empty and blank texts have the empty set and link with nothing. Repeated rows, and rows that
share a doc_id, give a row each; their component is that of all links of the doc_id. A row of null doc_id links, and joins others,
like any row, but its own component is null and it names none. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import gc
import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.chunks import chunked
from tracelens.llm.common import Work, components, cut, deal, gather, give_back, join_groups, mix, of_ids, partitions, scatter, ship

#: A key, by 48 bits (that two keys share these costs a comparison only), and a member.
KEY = np.dtype([("high", "<u2"), ("low", "<u4"), ("node", "<u8")])
MASK = np.uint64((1 << 48) - 1)
#: Least ratio of neighbouring bounds of the classes of set size.
RATIO = 1.6
#: Fragments by which pairs are counted; the least number by which their overlap is bounded, and shingles in each beyond that.
COUNTED, BOUND, FINE = 8, 64, 2
#: Keys that a task deals out at once.
SENT = 500_000
#: Members, or queries, of one group that are compared in one task, at least; beyond, a thousandth of all documents.
BLOCK = 1000
SPREAD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a sequence of word hashes."""
    if not len(words):
        return words
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, np.uint64(n))
    for i in range(n):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + words[i : len(words) - n + 1 + i] * SPREAD[i % len(SPREAD)])
    return np.unique(out)


def sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The shingle set of each text in turn; words are lower-cased for A-Z."""
    for _, offsets, numbers, chunks in chunked(texts):
        known = np.array([xxhash.xxh3_64_intdigest(c) for c in chunks], np.uint64)
        none = chunks.index(b"") if b"" in chunks else -1
        for x, y in zip(offsets[:-1], offsets[1:]):
            some = numbers[x:y]
            yield shingles(known[some] if y - x > 1 or some[0] != none else known[:0], width)


@cache
def bounds(threshold: int) -> list[int]:
    """Where the classes of set size begin: partners are of one class, or of two neighbouring ones."""
    ratio, out = max(RATIO, 100 / threshold + 0.05), [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return out


@cache
def fragments(c: int, threshold: int) -> tuple[int, int]:
    """How many fragments class c has, and in how many of them two linked sets can differ at most."""
    low, high = bounds(threshold)[c], bounds(threshold)[c + 1] - 1
    differ = 2 * high * (100 - threshold) // (100 + threshold)
    m, least = differ + 1, max(1, low * threshold // 100)
    for _ in range(8):  # room for fragments that are empty in a set of the least size
        empty = m * math.exp(-least / m)
        m = max(m, min(2 * differ + 1, differ + 1 + math.ceil(empty + 3 * math.sqrt(empty))))
    return m, differ


def keys(s: np.ndarray, threshold: int) -> np.ndarray:
    """The 64-bit keys of a set: digests of its fragments in its class, and in the next one's if a partner may be there."""
    n, edges, out = len(s), bounds(threshold), []
    mixed, c = mix(s), bisect_right(edges, n) - 1
    for k in (c, c + 1) if n * 100 // threshold >= edges[c + 1] else (c,):
        m, differ = fragments(k, threshold)
        place = (s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        salt = np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        out.append(mix(np.add.reduceat(mixed, first) + mix(place[first] + salt)))
        if len(first) <= differ:  # too many empty fragments: partners of this kind meet under a first shingle
            out.append(mix(s[: n - -(-n * threshold // 100) + 1] ^ mix(np.array([salt]))))
    return np.concatenate(out)


def profile(s: np.ndarray) -> bytes:
    """A set's size by fragment, a byte each (255: that or more): BOUND fragments, doubled until FINE shingles are in each."""
    bits = max(BOUND.bit_length(), (len(s) // FINE).bit_length()) - 1
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def node_of(s: np.ndarray) -> int:
    """A set's name: a signed 64-bit hash of its sorted shingles."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)))


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def nodes(docs: DataFrame, width: int, threshold: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node, n of every row, with the set's size by fragment; node null for an empty set.

    Between them stand rows with counts of keys that are frequent among some thousand sets (often, not null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "node", "n", "hist", "often", "times"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

        def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
            value, count = np.unique(np.concatenate(held), return_counts=True)
            kept = count >= 8
            row = [None, None, None, None, value[kept].view(np.int64), count[kept]]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

        held, size, known = [], 0, set()
        for batch in batches:
            node, n, hist = [], [], []
            for s in sets(batch.column("text"), width):
                n.append(len(s))
                node.append(node_of(s) if len(s) else None)
                hist.append(profile(s) if len(s) else None)
                if len(s) and node[-1] not in known:
                    known.add(node[-1])
                    held.append(keys(s, threshold) & MASK)
                    size += len(held[-1])
                if size > 2_000_000:
                    yield frequent(held)
                    held, size, known = [], 0, set()
            none = [None] * len(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, k) for x, k in zip((node, n, hist, none, none), kinds[1:])]], names)
        if size:
            yield frequent(held)

    return _sets(docs, id_col, text_col).mapInArrow(run, "doc_id long, node long, n long, hist binary, often array<long>, times array<long>")


def hot_keys(named: DataFrame) -> np.ndarray:
    """The keys counted in a thousandth of all rows or more: at most a thousand times the mean number of keys of a set."""
    least = max(32, named.filter("often IS NULL").count() // 1000)
    each = named.filter("often IS NOT NULL").select(F.explode(F.arrays_zip("often", "times")).alias("x"))
    found = each.groupBy(F.col("x.often").alias("s")).agg(F.sum("x.times").alias("t")).filter(F.col("t") >= least)
    return np.sort(np.array([r["s"] for r in found.select("s").collect()], np.int64).view(np.uint64))


def met(docs: DataFrame, width: int, threshold: int, hot: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (key, node): the members of each key that has several, and of each hot key."""
    parts = partitions(docs.sparkSession)
    hot = docs.sparkSession.sparkContext.broadcast(hot)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()

        def flush(held: list[np.ndarray], owner: list[int]) -> pa.RecordBatch:
            key = np.concatenate(held)
            node = np.repeat(np.array(owner, np.int64).view(np.uint64), [len(k) for k in held])
            records = np.empty(len(key), KEY)
            records["high"], records["low"], records["node"] = key >> np.uint64(32), key & np.uint64(0xFFFFFFFF), node
            # Members of a cold key meet; those of a hot key are spread.
            part, blob = zip(*scatter(records, mix(np.where(np.isin(key, hot.value), key ^ node, key)), parts))
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blob, pa.binary())], ["part", "blob"])

        held, owner, size, known = [], [], 0, set()
        for batch in batches:
            for s in sets(batch.column("text"), width):
                node = node_of(s) if len(s) else None
                if node is not None and node not in known:
                    known.add(node)
                    held.append(keys(s, threshold) & MASK)
                    owner.append(node)
                    size += len(held[-1])
                if size > SENT:
                    yield flush(held, owner)
                    held, owner, size, known = [], [], 0, set()
        if size:
            yield flush(held, owner)
        del held
        give_back()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for batch in batches for x in batch.column("blob").to_pylist()]
        if not blobs:
            return
        r = gather(blobs, KEY)
        blobs.clear()
        key, node = r["high"].astype(np.uint64) << np.uint64(32) | r["low"], np.ascontiguousarray(r["node"])
        del r
        order = np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        same, often = key[1:] == key[:-1], np.isin(key, hot.value)
        some = often | np.concatenate([[False], same]) | np.concatenate([same, [False]])
        key, node, often = key[some], node[some], often[some]
        order = np.lexsort((node, key))
        key, node, often = key[order], node[order], often[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])]) if len(key) else often
        key, node, often = key[new], node[new], often[new]  # a set that two map batches sent
        last = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([[-1], last]))
        several = often | (np.repeat(count, count) > 1)
        key, node = key[several], node[several]
        for at in range(0, len(key), 1 << 16):
            some = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(x[some].view(np.int64), pa.int64()) for x in (key, node)], ["key", "node"])
        del key, node, often, order, same, several
        give_back()

    sent = _sets(docs, id_col, text_col).select("text").mapInArrow(send, "part int, blob binary")
    return deal(sent, parts).mapInArrow(meet, "key long, node long")


def _allowed(a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    """Whether sizes by fragment, along the last axis, allow a link."""
    most, both = np.minimum(a, b).sum(-1, dtype=np.int64), a.sum(-1, dtype=np.int64) + b.sum(-1, dtype=np.int64)
    return 100 * most >= threshold * (both - most)


def _allow(x: bytes, y: bytes, threshold: int) -> bool:
    """The same for two profiles: the finer one is summed to the other's fragments."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if (a == 255).any() or (b == 255).any():
        return True
    k = min(len(a), len(b))
    return bool(_allowed(a.reshape(k, -1).sum(1), b.reshape(k, -1).sum(1), threshold))


def _bounded(pairs: DataFrame, stats: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sizes, in all and by fragment, allow a link."""
    left = stats.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("hist").alias("ha"))
    right = stats.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("hist").alias("hb"))
    rows = pairs.join(left, "a").join(right, "b").filter(f"100 * least(na, nb) >= {threshold} * greatest(na, nb)").select("a", "b", "ha", "hb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_allow(x, y, threshold) for x, y in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def _blocks(rows: DataFrame, group: str, block: int) -> DataFrame:
    """The rows (group, node, root, far, ...) of groups that hold several components, dealt to cells (columns row and column) of them.

    Every pair of components has a stray, a row outside the largest one; every pair that matters has a far row. Whichever are
    fewer in a group are its queries. Members stand in each row of their column; queries, with query true, in each column of
    their row. A cell has at most about block members and block queries.
    """
    per = rows.groupBy(group, "root").agg(F.count("*").alias("m"), F.count_if("far").alias("f"))
    whole = per.groupBy(group).agg(F.sum("m").alias("g"), F.sum("f").alias("f"), F.max(F.struct("m", "root")).alias("top"), F.count("*").alias("k")).filter("k > 1 AND f > 0")
    strays = F.col("g") - F.col("top.m")
    down, across = (F.ceil(x / block).cast("int") for x in (F.least("f", strays), F.col("g")))
    # Rows of large groups stay where they are.
    rows = join_groups(rows, cut(whole.select(group, "g", F.col("top.root").alias("main"), (F.col("f") < strays).alias("by_far"), down.alias("down"), across.alias("across"))), [group], "g", rows.count())
    at = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    cell = lambda i, j, q: F.struct(i.alias("row"), j.alias("column"), F.lit(q).alias("query"))
    member = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda i: cell(i, at(F.col("across")), False))
    query = F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda j: cell(at(F.col("down")), j, True))
    asks = F.when(F.col("by_far"), F.col("far")).otherwise(F.col("root") != F.col("main"))
    cells = F.concat(member, F.when(asks, query).otherwise(F.array().cast("array<struct<row:int,column:int,query:boolean>>")))
    return rows.withColumn("cell", F.explode(cells)).select("*", "cell.*").drop("cell", "g", "main", "by_far", "down", "across")


def _by_cell(rows: DataFrame, group: str, parts: int) -> DataFrame:
    """Cells of _blocks together: dealt by a hash of the cell. Dealt by the group itself, the planner drops dealing and sorting as
    done by a join below, and that join may then run as another."""
    return rows.withColumn("h", F.xxhash64(group, "row", "column")).repartition(parts, "h").sortWithinPartitions("h", group, "row", "column")


def _cells(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """The rows of each cell in turn; the first three columns name the cell."""
    held: list[tuple] = []
    for batch in batches:
        for r in zip(*[batch.column(c).to_pylist() for c in columns]):
            if held and r[:3] != held[0][:3]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _under_keys(rows: DataFrame, stats: DataFrame, threshold: int, parts: int, block: int) -> DataFrame:
    """Pairs (a, b) of sets of different components under a key, one of them far at least, whose sizes by fragment allow a link."""
    columns = ["key", "row", "column", "node", "root", "far", "n", "hist", "query"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _cells(batches, columns):
            query = np.array([r[8] for r in held])
            node, root, far, n = (np.array([r[i] for r in held]) for i in (3, 4, 5, 6))
            coarse = np.array([np.frombuffer(r[7], np.uint8).reshape(BOUND, -1).sum(1) for r in held], np.int32)
            full = np.array([255 in r[7] for r in held])
            members, a, b = np.flatnonzero(~query), [], []
            for i in np.flatnonzero(query):
                j = members[(root[members] != root[i]) & (far[members] | far[i]) & (100 * np.minimum(n[members], n[i]) >= threshold * np.maximum(n[members], n[i]))]
                j = j[_allowed(coarse[j], coarse[i][None, :], threshold) | full[j] | full[i]]
                for k in j:
                    if _allow(held[i][7], held[k][7], threshold):
                        a.append(min(node[i], node[k]))
                        b.append(max(node[i], node[k]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], ["a", "b"])

    cells = _blocks(rows, "key", block).join(stats.select("node", "n", "hist"), "node")
    return _by_cell(cells, "key", parts).select(*columns).mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, stats: DataFrame, width: int, threshold: int, id_col: str, text_col: str, counted_from: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) that are linked: overlaps by fragment, summed per pair. Also all pairs that were counted, with their differences e.

    Counted are the pairs whose sizes by fragment allow a link, or the lower threshold counted_from.
    """
    pairs = cut(_bounded(pairs, stats, threshold if counted_from is None else counted_from))
    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    first = cut(stats.join(used, "node", "left_semi").select("first"))
    texts = _sets(docs, id_col, text_col)
    ids = first.filter("first IS NOT NULL").select(F.col("first").alias("doc_id"))
    nameless = texts.filter("doc_id IS NULL") if first.filter("first IS NULL").take(1) else None  # sets that rows without an id hold
    texts = of_ids(texts, ids, "doc_id")
    texts = texts.unionByName(nameless).select("text") if nameless is not None else texts.select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fragment, some = [], [], []
            for s in sets(batch.column("text"), width):
                if len(s):
                    at = np.searchsorted(s >> np.uint64(32), np.arange(1, COUNTED, dtype=np.uint64) * np.uint64((1 << 32) // COUNTED))
                    for f, part in enumerate(np.split(s, at)):
                        node.append(node_of(s))
                        fragment.append(f)
                        some.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(fragment, pa.int32()), pa.array(some, pa.binary())], ["node", "fragment", "some"])

    cuts = texts.mapInArrow(run, "node long, fragment int, some binary")
    cuts = cut(cuts.join(used, "node", "left_semi").groupBy("node", "fragment").agg(F.first("some").alias("some")))
    left = pairs.join(cuts.select(F.col("node").alias("a"), "fragment", F.col("some").alias("sa")), "a")
    both = left.join(cuts.select(F.col("node").alias("b"), "fragment", F.col("some").alias("sb")), ["b", "fragment"])

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, e = [], []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                odd = np.setxor1d(x, y, assume_unique=True)
                n.append((len(x) + len(y) - len(odd)) // 2)
                e.append(odd.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(n, pa.int64()), pa.array(e, pa.binary())], ["a", "b", "part", "e"])

    sums = both.select("a", "b", "sa", "sb").mapInArrow(overlap, "a long, b long, part long, e binary")
    counted = cut(sums.groupBy("a", "b").agg(F.sum("part").alias("inter"), F.collect_list("e").alias("e")))
    size = stats.select("node", "n")
    sums = counted.join(size.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    linked = sums.filter(100 * F.col("inter") >= threshold * (F.col("na") + F.col("nb") - F.col("inter")))
    return linked.select("a", "b", "inter"), counted


def _around(members: DataFrame, near: DataFrame, stats: DataFrame, threshold: int, parts: int, block: int) -> DataFrame:
    """Links (a, b, inter) between components among the members (centre, node, root) of each centre; near has what differs from it, e."""
    columns = ["centre", "row", "column", "node", "root", "n", "e", "query"]
    rows = members.withColumn("far", F.lit(True))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _cells(batches, columns):
            node, root, n = (np.array([h[i] for h in held], np.int64) for i in (3, 4, 5))
            differ = [np.frombuffer(b"".join(h[6] or []), "<u8") for h in held]  # the centre itself differs in nothing
            query, size = np.array([h[7] for h in held]), np.array([len(d) for d in differ], np.int64)
            members = np.flatnonzero(~query)
            if not len(members):
                continue
            element, owner = np.concatenate([differ[m] for m in members]), np.repeat(np.arange(len(members)), size[members])
            order = np.argsort(element, kind="stable")
            element, owner = element[order], owner[order]
            a, b, inter = [], [], []
            for i in np.flatnonzero(query):
                lo, hi = np.searchsorted(element, differ[i], "left"), np.searchsorted(element, differ[i], "right")
                met = np.bincount(np.concatenate([owner[x:y] for x, y in zip(lo, hi)] or [owner[:0]]), minlength=len(members))
                both = n[i] + n[members]
                shared = (both - (size[i] + size[members] - 2 * met)) // 2
                found = np.flatnonzero((100 * shared >= threshold * (both - shared)) & (root[members] != root[i]))
                _, at = np.unique(root[members[found]], return_index=True)
                for j in found[at]:
                    a.append(min(node[i], node[members[j]]))
                    b.append(max(node[i], node[members[j]]))
                    inter.append(shared[j])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, inter)], ["a", "b", "inter"])

    cells = _blocks(rows, "centre", block).join(near, ["centre", "node"], "left").join(stats.select("node", "n"), "node")
    return _by_cell(cells, "centre", parts).select(*columns).mapInArrow(links, "a long, b long, inter long")


def _pairs(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def join(docs: DataFrame, width: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, links): doc_id, n_shingles, node, component_id of every row, and the verified links between sets.

    threshold is in hundredths: two documents link when 100 * intersection >= threshold * union.
    """
    with Work(docs.sparkSession) as work:
        found, links = _join(docs, width, threshold, id_col, text_col)
        return work.keep(found), work.keep(links)


def _join(docs: DataFrame, width: int, threshold: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    parts = partitions(docs.sparkSession)
    named = cut(nodes(docs, width, threshold, id_col, text_col))
    hot = hot_keys(named)
    named = named.filter("often IS NULL").select("doc_id", "node", "n", "hist")
    block = max(BLOCK, named.count() // 1000)
    stats = named.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("hist").alias("hist"))
    stats = cut(stats)
    meets = cut(met(docs, width, threshold, hot, id_col, text_col))
    # The centre of a key: the set that meets most, over all its keys.
    sizes = meets.groupBy("key").agg(F.count("*").alias("g")).filter("g > 1")
    weighed = cut(meets.join(sizes, "key").select("key", "node", "g"))
    weight = weighed.groupBy("node").agg(F.sum("g").alias("w"))
    centre = weighed.join(weight, "node").groupBy("key").agg(F.max(F.struct("w", "node"))["node"].alias("centre"))
    placed = cut(weighed.select("key", "node").join(centre, "key"))
    spokes = cut(placed.filter("node <> centre").select("centre", "node").distinct())
    star = cut(spokes.select(*_pairs("node", "centre")).distinct())
    links, counted = verified(star, docs, stats, width, threshold, id_col, text_col, max(1, 2 * threshold - 100))
    links = cut(links)
    roots = cut(components(links.select("a", "b")))
    near = spokes.join(counted, (F.least("node", "centre") == F.col("a")) & (F.greatest("node", "centre") == F.col("b"))).select("centre", "node", "e")
    near = cut(near)
    # Around a centre: the sets that were counted against it, and itself.
    spoke = near.select("centre", "node")
    members = spoke.unionByName(spoke.select("centre", F.col("centre").alias("node")).distinct()).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    around = cut(_around(cut(members), near, stats, threshold, parts, block))
    roots = cut(components(links.unionByName(around).select("a", "b")))
    # Under a key: the sets that weren't counted against its centre (far), against those of other components.
    labelled = placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    flagged = labelled.join(spoke.withColumn("near", F.lit(True)), ["centre", "node"], "left").withColumn("far", F.col("near").isNull() & (F.col("node") != F.col("centre")))
    across = cut(_under_keys(cut(flagged.select("key", "node", "root", "far")), stats, threshold, parts, block).distinct())
    across = cut(across.join(star, ["a", "b"], "left_anti"))
    further, _ = verified(across, docs, stats, width, threshold, id_col, text_col)
    links = cut(links.unionByName(around).unionByName(further))
    # Rows of one set, and rows of one doc_id, belong together too: the graph is over sets, then over ids.
    roots = components(links.select("a", "b"))
    rows = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = rows.filter("doc_id IS NOT NULL AND root IS NOT NULL")
    shared = cut(ids.groupBy("doc_id").agg(F.min("root").alias("a"), F.max("root").alias("hi")).filter("a <> hi").select("doc_id", "a"))
    if shared.take(1):
        merged = components(ids.join(shared, "doc_id").select("a", F.col("root").alias("b")).distinct())
        rows = rows.join(merged.select(F.col("node").alias("root"), F.col("root").alias("into")), "root", "left").withColumn("root", F.coalesce("into", "root"))
    rows = cut(rows.select("doc_id", "n", "node", "root"))
    least = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("g"))
    found = join_groups(rows.filter("root IS NOT NULL"), least, ["root"], "g", max(1, rows.count())).select("doc_id", F.col("n").alias("n_shingles"), "node", "component_id")
    alone = rows.filter("root IS NULL").select("doc_id", F.col("n").alias("n_shingles"), "node", F.col("doc_id").alias("component_id"))
    found = found.unionByName(alone).withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return found, links


def keep_representatives(docs: DataFrame, width: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, that of least doc_id (rows of a null doc_id stay): same columns."""
    found, _ = join(docs, width, threshold, id_col, text_col)
    return of_ids(docs, cut(found.filter("component_id < doc_id").select("doc_id").distinct()), id_col, but=True)

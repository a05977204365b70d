"""Repeated passages by longest-previous-factor arrays.

A byte is removed if some window of `length` bytes over it also starts earlier: in a document of smaller doc_id, or earlier
in its own. Windows are judged on the input.

Equal windows hold the same k-grams, so also the k-gram of least hash: an anchor. Each document's anchors are found with
sliding minima; with an anchor goes a hash of its context, the bytes of all windows that can hold it. Where anchors meet:

- of equal contexts, all but the earliest lie wholly in windows that start earlier;
- of the earliest ones of different contexts under one anchor (the edges of repeated passages), the bytes are fetched, and a
  suffix array over them is built by prefix doubling up to `length`. In suffix order, the previous and the next smaller
  positions are found by pointer jumping along with the common prefix on the way, and the greater of both is the longest
  previous factor of a window (LPF, counted up to `length`): the window repeats where its LPF reaches `length`.

So texts meet only where something repeats, equal contexts are combined (in each map batch first), and the bytes that move for
suffix arrays are those around edges. Anchors that a thousandth of all documents or more hold are hot: their contexts are dealt
by anchor and context, their edges compared in blocks, and each block's first windows meet by a hash of the window itself. So no
task holds a hot group. Hashes are 64 bits for the anchor, 64 for the context and 64 for such windows.

Defined results. Null counts as empty. Texts shorter than `length` keep all bytes. Rows that share a doc_id are documents in
the order of their texts' SHA-256; rows equal in both are one document, and each gets its result. Null doc_id comes before
all others. An empty table gives an empty result. Extra columns are ignored. Long texts are read whole, in slices.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import Work, cut, deal, gather, mix, of_ids, partitions, scatter, ship

GRAM, SLICE = 32, 1 << 20
#: Documents over which hot anchors are counted, at least.
SEEN = 20_000
#: Contexts of one hot anchor that are compared in one task.
BLOCK = 1000
AGAIN = np.dtype([("ord", "<i8"), ("lo", "<u4"), ("hi", "<u4")])
ANCHOR = np.dtype([("hash", "<u8"), ("context", "<u8"), ("ord", "<i8"), ("pos", "<u4")])
BASE = 0x9E3779B97F4A7C15 | 1


class Roller:
    """Hashes of any substring of a buffer: sums of byte values times powers of an odd base, shifted to one origin."""

    def __init__(self, size: int):
        rng = np.random.default_rng(20)
        self.value = rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.power, self.inverse = self._powers(BASE, size), self._powers(pow(BASE, -1, 1 << 64), size)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        out, n = np.ones(size, np.uint64), 1
        while n < size:
            k = min(n, size - n)
            out[n : n + k] = out[:k] * np.array([pow(base, n, 1 << 64)], np.uint64)
            n += k
        return out

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.power[: len(data)], out=out[1:])
        return out


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over x[i : i + width], by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1]) if width > have else out


def anchors(roller: Roller, data: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple:
    """Anchor positions in a buffer, with hash, context hash and position's segment.

    Segment s is data[start[s] : end[s]]; only windows that start in [low[s], high[s]) choose anchors.
    """
    none = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    if len(data) < length:
        return none
    reach = length - GRAM  # how far an anchor lies from the start of its window, at most
    sums = roller.sums(data)
    n = len(data) - GRAM + 1
    h = mix((sums[GRAM:] - sums[:-GRAM]) * roller.inverse[:n])
    least = sliding(h, reach + 1, np.minimum)
    edge = np.zeros(len(least) + 1, np.int32)
    last = np.minimum(np.minimum(end - length + 1, high), len(least))
    some = last > low
    np.add.at(edge, low[some], 1)
    np.add.at(edge, last[some], -1)
    least[np.cumsum(edge[:-1]) == 0] = 0
    padded = np.concatenate([np.zeros(reach, np.uint64), least, np.zeros(reach, np.uint64)])
    at = np.flatnonzero((sliding(padded, reach + 1, np.maximum)[: len(h)] == h) & (h > 0))
    segment = np.searchsorted(start, at, "right") - 1
    left, right = np.minimum(reach, at - start[segment]), np.minimum(length, end[segment] - at)
    context = (sums[at + right] - sums[at - left]) * roller.inverse[at - left]
    context = mix(context ^ mix(left.astype(np.uint64) * np.uint64(1009) + right.astype(np.uint64)))
    return at, segment, h[at], context


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """ord, doc_id, text: ord is doc_id where that is unique and never null, else the documents' order."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    odd = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL")
    if not odd.take(1):
        return rows.select(F.col("doc_id").alias("ord"), "doc_id", "text")
    rows = rows.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    order = rows.select("doc_id", "sha").distinct().orderBy(F.asc_nulls_first("doc_id"), "sha").rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    order = cut(docs.sparkSession.createDataFrame(order, "k long, s string, ord long"))
    return rows.join(order, rows["doc_id"].eqNullSafe(order["k"]) & (rows["sha"] == order["s"])).select("ord", "doc_id", "text")


def _slices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[int, int, bytes, int, int]]:
    """(ord, first byte in its text, bytes, first and last window start within) of every slice of every text that has a window."""
    reach = length - GRAM
    for batch in batches:
        for key, x in zip(batch.column("ord").to_pylist(), batch.column("text")):
            text = (x.as_py() or "").encode()
            for a in range(0, len(text) - length + 1, SLICE):
                b = min(a + SLICE, len(text) - length + 1)  # windows that start in a .. b
                lo = max(0, a - reach)
                # Contexts end where the text does, not where the slice does: a slice holds whole contexts.
                yield key, lo, text[lo : b + length + reach], a - lo, b - lo


def _found(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[np.ndarray]:
    """The anchors of all texts, some megabyte of text at a time."""
    gc.disable()
    roller = Roller(2 * SLICE + 4 * length)

    def flush(held: list) -> np.ndarray:
        data = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
        size = np.array([len(x[2]) for x in held], np.int64)
        end = np.cumsum(size)
        start = end - size
        low, high = start + np.array([x[3] for x in held]), start + np.array([x[4] for x in held])
        at, segment, h, context = anchors(roller, data, start, end, low, high, length)
        out = np.empty(len(at), ANCHOR)
        out["hash"], out["context"] = h, context
        out["ord"] = np.array([x[0] for x in held], np.int64)[segment]
        out["pos"] = at - start[segment] + np.array([x[1] for x in held], np.int64)[segment]
        return out

    held, size = [], 0
    for x in _slices(batches, length):
        held.append(x)
        size += len(x[2])
        if size >= SLICE // 2:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def hot_anchors(rows: DataFrame, length: int) -> tuple[np.ndarray, int]:
    """The anchors that a thousandth of the documents or more hold, and how many documents there are.

    They are counted over a sixteenth of the documents (SEEN of them at least), by a hash of ord: this settles only which task
    an anchor's contexts go to, never a result. At most a thousand times a document's mean number of anchors come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _found(batches, length):
            value, count = np.unique(r["hash"], return_counts=True)
            often = count >= 2
            yield pa.RecordBatch.from_arrays([pa.array(value[often].view(np.int64)), pa.array(count[often].astype(np.int64))], ["hash", "n"])

    n = rows.count()
    share = min(1.0, max(1 / 16, SEEN / max(n, 1)))
    some = rows.select("ord", "text").filter(F.pmod(F.xxhash64("ord"), F.lit(1 << 20)) < int(share * (1 << 20)))
    counted = some.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    hot = counted.filter(F.col("n") >= max(16, int(share * n / 1000))).select("hash").collect()
    return np.sort(np.array([r["hash"] for r in hot], np.int64).view(np.uint64)), n


def _merged(r: np.ndarray) -> np.ndarray:
    """Spans (ord, lo, hi) in order, those that touch made one."""
    r = r[np.lexsort((r["hi"], r["lo"], r["ord"]))]
    if not len(r):
        return r
    # The reach of all spans before, by document: hi never falls within one, so a running maximum over (document, hi) is enough.
    doc = np.cumsum(np.concatenate([[True], r["ord"][1:] != r["ord"][:-1]])).astype(np.int64)
    reach = np.maximum.accumulate(doc << 33 | r["hi"].astype(np.int64))
    new = np.concatenate([[True], (doc[1:] << 33 | r["lo"][1:].astype(np.int64)) > reach[:-1]])
    at = np.flatnonzero(new)
    out = r[at].copy()
    out["hi"] = reach[np.concatenate([at[1:], [len(r)]]) - 1] & ((1 << 33) - 1)
    return out


def _spans(again: np.ndarray, length: int, parts: int) -> Iterator[tuple[int, bytes]]:
    """What anchors whose contexts stand earlier cover, dealt by document."""
    out = np.empty(len(again), AGAIN)
    pos = again["pos"].astype(np.int64)
    out["ord"], out["lo"], out["hi"] = again["ord"], np.maximum(0, pos - (length - GRAM)), pos + length
    out = _merged(out)
    return scatter(out, mix(out["ord"].view(np.uint64)), parts)


def _send(rows: DataFrame, length: int, parts: int, hot) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _found(batches, length):
            # Of equal contexts under an anchor the batch's earliest goes on; the others repeat it, wherever else it stands.
            order = np.lexsort((r["pos"], r["ord"], r["context"], r["hash"]))
            r = r[order]
            new = np.concatenate([[True], (r["hash"][1:] != r["hash"][:-1]) | (r["context"][1:] != r["context"][:-1])]) if len(r) else np.zeros(0, bool)
            first = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
            again = r[~new & ((r["ord"] != r["ord"][first]) | (r["pos"] != r["pos"][first]))]  # else one place, seen twice
            r = r[new]
            by = np.where(np.isin(r["hash"], hot.value), r["hash"] ^ mix(r["context"]), r["hash"])
            out = [(p, True, b) for p, b in scatter(r, mix(by), parts)] + [(p, False, b) for p, b in _spans(again, length, parts)]
            part, kind, blob = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.bool_()), pa.array(blob, pa.binary())], ["part", "kind", "blob"])

    return rows.select("ord", "text").mapInArrow(run, "part int, kind boolean, blob binary")


def _meet(sent: DataFrame, length: int, parts: int, hot) -> DataFrame:
    """Rows (ord, pos, hash) of edges: contexts that stand nowhere earlier, under an anchor whose contexts differ or that is hot.

    Between them stand blobs of what repeats (part, blob), dealt by document.
    """
    names, kinds = ["part", "blob", "ord", "pos", "hash"], (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())

    def rows(*columns: object) -> pa.RecordBatch:
        n = next(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        blobs = []
        for batch in batches:
            for part, kind, blob in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob").to_pylist()):
                if kind:
                    blobs.append(blob)
                else:
                    yield rows([part], [blob], None, None, None)
        if not blobs:
            return
        r = gather(blobs, ANCHOR)
        blobs.clear()
        order = np.argsort(r["hash"], kind="stable")
        h = r["hash"][order]
        same, often = h[1:] == h[:-1], np.isin(h, hot.value)
        r = r[order[often | np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
        r = r[np.lexsort((r["pos"], r["ord"], r["context"], r["hash"]))]
        if not len(r):
            return
        new_hash = np.concatenate([[True], r["hash"][1:] != r["hash"][:-1]])
        new_context = new_hash | np.concatenate([[True], r["context"][1:] != r["context"][:-1]])
        contexts = np.add.reduceat(new_context.astype(np.int64), np.flatnonzero(new_hash))
        many = np.repeat(contexts, np.diff(np.concatenate([np.flatnonzero(new_hash), [len(r)]]))) > 1
        many |= np.isin(r["hash"], hot.value)
        first = np.maximum.accumulate(np.where(new_context, np.arange(len(r)), 0))
        again = ~new_context & ~((r["ord"] == r["ord"][first]) & (r["pos"] == r["pos"][first]))  # else a repeated row's, not an earlier document's
        for part, blob in _spans(r[again], length, parts):
            yield rows([part], [blob], None, None, None)
        r = r[new_context & many]
        for at in range(0, len(r), 1 << 16):
            some = r[at : at + (1 << 16)]
            yield rows(None, None, some["ord"], some["pos"].astype(np.int64), np.ascontiguousarray(some["hash"]).view(np.int64))

    return deal(sent, parts).mapInArrow(run, "part int, blob binary, ord long, pos long, hash long")


def _by_document(blobs: DataFrame, edges: DataFrame, parts: int) -> DataFrame:
    """ord and cuts: all spans of each document, those that touch made one, as pairs of unsigned 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for batch in batches for x in batch.column("blob").to_pylist()]
        if not held:
            return
        r = _merged(gather(held, AGAIN))
        first = np.flatnonzero(np.concatenate([[True], r["ord"][1:] != r["ord"][:-1]]))
        pairs = np.stack([r["lo"], r["hi"]], 1).astype("<u8")
        for at in range(0, len(first), 4096):
            some, end = first[at : at + 4096], np.concatenate([first[1:], [len(r)]])[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(r["ord"][some]), pa.array([pairs[x:y].tobytes() for x, y in zip(some, end)], pa.binary())], ["ord", "cuts"])

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = np.empty(batch.num_rows, AGAIN)
            for c in ("ord", "lo", "hi"):
                r[c] = batch.column(c).to_numpy()
            r = _merged(r)
            out = list(scatter(r, mix(r["ord"].view(np.uint64)), parts))
            part, blob = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blob, pa.binary())], ["part", "blob"])

    both = blobs.unionByName(edges.mapInArrow(flat, "part int, blob binary"))
    return deal(both, parts).select("blob").mapInArrow(run, "ord long, cuts binary")


def suffix_classes(data: np.ndarray, length: int) -> np.ndarray:
    """For each suffix, the rank of its first `length` bytes among all, by prefix doubling from words of eight bytes."""

    def ranked(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        return np.unique(high * (int(low.max(initial=0)) + 1) + low, return_inverse=True)[1].astype(np.int64)

    def after(x: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([x[k:] + 1, np.zeros(min(k, len(x)), np.int64)])[: len(x)]

    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1)).copy().view(">u8").ravel().astype(np.uint64)
    rank, have = np.unique(words, return_inverse=True)[1].astype(np.int64), 8
    while have * 2 <= length:
        rank = ranked(rank, after(rank, have))
        have *= 2
    return ranked(rank, after(rank, length - have)) if have < length else rank


def smaller(text: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """For each place in suffix order, the common prefix with the nearest earlier place of smaller text position; 0 below least.

    common[i] is the common prefix of places i - 1 and i. A pointer that rests on a greater position jumps to where that
    one's points; the prefix on the way is the least of those passed. Pointers below least stop.
    """
    to, way = np.arange(len(text)) - 1, common.copy()
    active = np.flatnonzero((to >= 0) & (way >= least))
    way[way < least] = 0
    while len(active):
        active = active[text[to[active]] >= text[active]]
        j = to[active]
        jump, passed = to[j], np.minimum(way[active], way[j])
        ended = (jump < 0) | (passed < least)
        to[active], way[active] = jump, np.where(ended, 0, passed)
        active = active[~ended]
    return way


def longest_previous(group: np.ndarray, ords: np.ndarray, first: np.ndarray, contexts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(ord, start, LPF) of the windows of the contexts, in suffix order by group; LPF is 0 where it is below length."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    size = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(size) - size
    windows = np.maximum(0, size - length + 1)
    owner = np.repeat(np.arange(len(contexts)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    rank = suffix_classes(data, length)[begin[owner] + offset]
    g = np.unique(group, return_inverse=True)[1][owner].astype(np.int64) * (int(rank.max(initial=0)) + 1) + rank
    order = np.argsort(g, kind="stable")  # the suffix array of the windows, cut at length
    g, o, p = g[order], ords[owner][order], (first[owner] + offset)[order]
    # Text order: documents by ord, then bytes. One window that two contexts show has one position.
    text = (np.unique(ords, return_inverse=True)[1][owner].astype(np.int64) << 40 | (first[owner] + offset))[order]
    common = np.where(np.concatenate([[False], g[1:] == g[:-1]]), length, 0) if len(g) else np.zeros(0, np.int64)
    before = smaller(text, common, length)
    back = np.concatenate([common[1:], [0]])[::-1] if len(g) else common
    after = smaller(text[::-1], back, length)[::-1]
    return o, p, np.maximum(before, after)


def window_hashes(roller: Roller, contexts: list[bytes], length: int) -> np.ndarray:
    """A hash of each window of the contexts, in their order."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    size = np.array([len(c) for c in contexts], np.int64)
    begin, windows = np.cumsum(size) - size, np.maximum(0, size - length + 1)
    at = np.repeat(begin, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    sums = roller.sums(data)
    return mix((sums[at + length] - sums[at]) * roller.inverse[at])


def _runs(o: np.ndarray, p: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of windows as spans (ord, lo, hi) of bytes."""
    order = np.lexsort((p, o))
    o, p = o[order], p[order]
    new = np.concatenate([[True], (o[1:] != o[:-1]) | (p[1:] > p[:-1] + 1)]) if len(o) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(o)]]) - 1 if len(o) else at
    return o[at], p[at], p[last] + length


def _edges(rows: DataFrame, marks: DataFrame, length: int, parts: int, n_docs: int) -> DataFrame:
    """Rows (ord, lo, hi) of bytes to remove, from the marks that have a hash."""
    reach = length - GRAM
    limit = max(BLOCK, n_docs // 1000)
    edge = marks.filter("hash IS NOT NULL").select("ord", "pos", "hash")
    # Anchors of more edges than a block: at most a thousand times the mean number of edges of a document.
    large = cut(edge.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("hash", F.ceil(F.col("n") / limit).cast("int").alias("blocks")))
    some = bool(large.take(1))
    if some:
        edge = edge.join(large, "hash", "left").withColumn("block", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("ord", "pos"), "blocks").cast("int")).otherwise(-1))
    else:
        edge = edge.withColumn("block", F.lit(-1))
    wanted = cut(edge.groupBy("ord").agg(F.collect_list(F.struct("pos", "hash", "block")).alias("marks")))
    both = of_ids(rows.select("ord", "text"), wanted.select("ord"), "ord").join(wanted, "ord").select("ord", "text", "marks")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, x, marks in zip(batch.column("ord").to_pylist(), batch.column("text"), batch.column("marks").to_pylist()):
                text = x.as_py().encode()
                for m in marks:
                    lo = max(0, m["pos"] - reach)
                    for column, v in zip(out, (m["hash"], m["block"], key, lo, text[lo : m["pos"] + length])):
                        column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["hash", "block", "ord", "lo", "bytes"])

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ord", "lo", "hi", "window"]

        def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            h, block, o, lo, contexts = t["hash"].to_numpy(), t["block"].to_numpy(), t["ord"].to_numpy(), t["lo"].to_numpy(), t["bytes"].to_pylist()
            found, start, lpf = longest_previous(h, o, lo, contexts, length)
            found, start = found[lpf >= length], start[lpf >= length]
            split = block >= 0
            if split.any():  # of hot anchors' blocks the first of each class of windows meets those of other blocks
                o2, p2, w2, leads = _leading(o[split], lo[split], [c for c, s in zip(contexts, split) if s], length)
                found, start = np.concatenate([found, o2[~leads]]), np.concatenate([start, p2[~leads]])
                o2, p2, w2 = o2[leads], p2[leads], w2[leads]
            spans = _runs(found, start, length)
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in spans], pa.nulls(len(spans[0]), pa.int64())], names)
            if split.any():
                for at in range(0, len(o2), 1 << 16):
                    x = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(o2[x], pa.int64()), pa.array(p2[x], pa.int64()), pa.array(p2[x] + length, pa.int64()), pa.array(w2[x].view(np.int64), pa.int64())], names)

        held, size = [], 0  # rows come sorted by hash and block: groups are whole between their changes
        for batch in batches:
            while batch.num_rows:
                key = batch.column("hash").to_numpy() ^ batch.column("block").to_numpy().astype(np.int64)
                if size > 16_000:
                    if held[-1].column("hash")[-1].as_py() ^ held[-1].column("block")[-1].as_py() != key[0]:
                        yield from done(held)
                        held, size = [], 0
                        continue
                    change = int(np.argmax(key != key[0])) if (key != key[0]).any() else batch.num_rows
                else:
                    change = batch.num_rows
                held.append(batch.slice(0, change))
                size += change
                batch = batch.slice(change)
        if held:
            yield from done(held)

    ship(rows.sparkSession)
    fetched = both.mapInArrow(fetch, "hash long, block int, ord long, lo long, bytes binary")
    by = F.xxhash64("hash", "block") if some else F.col("hash")
    fetched = fetched.withColumn("by", by).repartition(parts, "by").sortWithinPartitions("hash", "block")
    found = fetched.mapInArrow(factors, "ord long, lo long, hi long, window long")
    if not some:
        return cut(found.drop("window"))
    found = cut(found)
    # Windows of hot anchors by their hash: all but the earliest repeat. Each block sends one of a class.
    first = F.min(F.struct("ord", "lo"))
    leads = found.filter("window IS NOT NULL")
    earliest = leads.groupBy("window").agg(first.alias("f"), F.count("*").alias("n")).filter("n > 1")
    across = leads.join(earliest, "window").filter("ord <> f.ord OR lo <> f.lo").select("ord", "lo", "hi")
    return cut(found.filter("window IS NULL").drop("window").unionByName(across))


def _leading(ords: np.ndarray, first: np.ndarray, contexts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(ord, start, hash, leads) of the windows of the contexts, each once; leads marks the earliest of those of one hash."""
    out: tuple[list, ...] = ([], [], [])
    at, reach = 0, max(1 << 18, 4 * length)
    roller = Roller(reach + 1)
    while at < len(contexts):  # as far as the roller reaches at a time
        n, size = at, 0
        while n < len(contexts) and size + len(contexts[n]) <= reach:
            size += len(contexts[n])
            n += 1
        some = contexts[at:n]
        windows = np.maximum(0, np.array([len(c) for c in some], np.int64) - length + 1)
        out[0].append(np.repeat(ords[at:n], windows))
        out[1].append(np.repeat(first[at:n], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows))
        out[2].append(window_hashes(roller, some, length))
        at = n
    o, p, w = (np.concatenate(x) for x in out)
    order = np.lexsort((p, o, w))
    o, p, w = o[order], p[order], w[order]
    new = np.concatenate([[True], w[1:] != w[:-1]]) if len(w) else np.zeros(0, bool)
    once = new | np.concatenate([[True], (o[1:] != o[:-1]) | (p[1:] != p[:-1])]) if len(w) else new
    return o[once], p[once], w[once], new[once]


def spans(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, cuts): ord, doc_id, text of every row, and per ord the spans of bytes to remove as pairs of 64-bit integers."""
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    ship(docs.sparkSession)
    parts = partitions(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col)
    hot, n_docs = hot_anchors(rows, length)
    hot = docs.sparkSession.sparkContext.broadcast(hot)
    with Work(docs.sparkSession) as work:
        marks = cut(_meet(_send(rows, length, parts, hot), length, parts, hot))
        edges = _edges(rows, marks, length, parts, n_docs)
        return rows, work.keep(_by_document(marks.filter("part IS NOT NULL").select("part", "blob"), edges, parts))


def deduplicate(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; else doc_id, kept (binary) and spans."""
    rows, by_doc = spans(docs, length, id_col, text_col)
    ids = by_doc.select("ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for x, cuts in zip(batch.column("text"), batch.column("cuts").to_pylist()):
                text, left, at = (x.as_py() or "").encode(), [], 0
                runs = [(lo, min(hi, len(text))) for lo, hi in np.frombuffer(cuts, "<u8").reshape(-1, 2).tolist()]
                for lo, hi in runs:
                    left.append(text[at:lo])
                    at = hi
                kept = b"".join([*left, text[at:]])
                for column, v in zip(out, (len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), None if digests_only else kept, None if digests_only else [{"lo": a, "hi": b} for a, b in runs])):
                    column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v, k) for v, k in zip(out, kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<lo:long,hi:long>>"
    touched = of_ids(rows, ids, "ord").join(by_doc, "ord").select("doc_id", "text", "cuts").mapInArrow(run, schema)
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<lo:long,hi:long>>")
    rest = of_ids(rows, ids, "ord", but=True).select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), (F.lit(None).cast("binary") if digests_only else text.cast("binary")).alias("kept"), none.alias("spans"))
    both = touched.unionByName(rest)
    return both.drop("kept", "spans") if digests_only else both

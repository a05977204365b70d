"""Periodic runs of words, by Main-Lorentz divide and conquer on interned word ids.

A run is a stretch of consecutive words whose smallest period is q (words q apart are identical), of at least
max(shortest, 2 * q) words, which no neighbouring word extends. Each text is halved again and again; a run lies in one half or
crosses the midpoint. Two Z-functions at the midpoint, of the right half forwards and of the left half backwards, each over
the whole segment, say for every other place how far the words there go on as at the midpoint; together they reach as far
as the distance, or the distance is no period. What they find is as long as the segment lets it be: stretches that would go on
beyond the segment belong to the midpoint there and are left to it. Of stretches found with several periods the smallest holds.

Midpoints of one level are treated together, texts as well: equal words are compared in numpy, step by step, for those
places alone that still agree, which in ordinary prose are few. Segments in which some agree for more than STEPS words have their
Z-functions computed in linear time. So a text of n words takes O(n log n), however periodic it is.

Defined results. Null, empty and blank texts have no words and no runs. Words are compared as they are, upper and lower case.
Repeated rows are treated one by one. A text is held whole in one task, in some 100 bytes a word. An empty table gives an
empty result. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.llm.chunks import chunked
from tracelens.llm.common import give_back, ship

#: So many equal words are compared step by step before a segment's Z-functions are computed.
STEPS = 16
#: Places whose midpoints are treated at once, but for a single longer segment.
PLACES = 1 << 20
RUN = "struct<start:long,length:long,period:long>"


def z_function(s: list[int]) -> list[int]:
    """How many items each suffix shares with the whole; s ends with an item that it has once."""
    z, left, right = [0] * len(s), 0, 0
    for i in range(1, len(s)):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while s[k] == s[i + k]:
            k += 1
        z[i] = k
        if k:
            left, right = i, i + k
    return z


def _agreement(w: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words agree from a and b on (back from a - 1 and b - 1: step -1), up to most and STEPS; and which pairs still do."""
    n, on, back = np.zeros(len(a), np.int64), np.arange(len(a)), step < 0
    for k in range(STEPS):
        on = on[most[on] > k]
        on = on[w[a[on] + step * k - back] == w[b[on] + step * k - back]]
        if not len(on):
            break
        n[on] = k + 1
    return n, on[most[on] > STEPS]


def _through_z(w: np.ndarray, lo: int, mid: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every place but mid, and how many words agree there with those at mid, backwards and forwards."""
    whole = w[lo:hi].tolist()
    half = mid - lo
    ahead = z_function([*whole[half:], -1, *whole, -2])[hi - mid + 1 : -1]
    back = z_function([*whole[:half][::-1], -1, *whole[::-1], -2])[half + 1 :]
    place = np.delete(np.arange(lo, hi), half)
    return place, np.array(back[::-1], np.int64)[place - lo], np.array(ahead, np.int64)[place - lo]


def _crossing(w: np.ndarray, lo: np.ndarray, hi: np.ndarray, shortest: int) -> list[np.ndarray]:
    """Start, end, period, and the segment's bounds, of all repetitions across the midpoints of some segments."""
    mid, size = (lo + hi) // 2, hi - lo
    segment = np.repeat(np.arange(len(lo)), size)
    place = np.arange(len(segment)) - np.repeat(np.cumsum(size) - size, size) + lo[segment]
    at = mid[segment]
    # A word equal to the midpoint's, or one before equal to that before the midpoint.
    same = w[place] == w[at]
    before = np.zeros(len(place), bool)
    before[1:] = (w[place[1:] - 1] == w[at[1:] - 1]) & (place[1:] > lo[segment[1:]])
    some = np.flatnonzero((same | before) & (place != at))
    segment, place, at = segment[some], place[some], at[some]
    ahead, far = _agreement(w, place, at, hi[segment] - np.maximum(place, at), 1)
    back, long = _agreement(w, place, at, np.minimum(place, at) - lo[segment], -1)
    deep = np.unique(segment[np.concatenate([far, long])])
    keep = ~np.isin(segment, deep)
    found = [(segment[keep], place[keep], back[keep], ahead[keep])]
    for i in deep:
        p, b, a = _through_z(w, int(lo[i]), int(mid[i]), int(hi[i]))
        found.append((np.full(len(p), i), p, b, a))
    segment, place, back, ahead = (np.concatenate(x) for x in zip(*found))
    at = mid[segment]
    period = np.abs(place - at)
    good = back + ahead >= np.maximum(period, shortest - period)
    segment, place, at, period = segment[good], place[good], at[good], period[good]
    return [np.minimum(place, at) - back[good], np.maximum(place, at) + ahead[good], period, lo[segment], hi[segment]]


def repetitions(w: np.ndarray, offsets: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of the runs of all texts, text i being w[offsets[i]:offsets[i + 1]]; by start, then period."""
    lo, hi, found = offsets[:-1], offsets[1:], []
    while True:
        large = hi - lo >= shortest
        lo, hi = lo[large], hi[large]
        if not len(lo):
            break
        group = np.cumsum(hi - lo) // PLACES
        for at in np.split(np.arange(len(lo)), np.flatnonzero(np.diff(group)) + 1):
            found.append(_crossing(w, lo[at], hi[at], shortest))
        mid = (lo + hi) // 2
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], hi[order]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, end, period, lo, hi = (np.concatenate(x) for x in zip(*found))
    # What would go on beyond its segment, in the same text, is found whole at the midpoint there.
    first, last = np.isin(lo, offsets), np.isin(hi, offsets)
    more = (start == lo) & ~first & (w[start - 1] == w[start - 1 + period])
    more |= (end == hi) & ~last & (w[np.minimum(end, len(w) - 1)] == w[end - period])
    start, end, period = start[~more], end[~more], period[~more]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    least = np.ones(len(start), bool)
    least[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[least], end[least], period[least]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def find(docs: DataFrame, shortest: int = 12, id_col: str = "doc_id", text_col: str | Column = "text") -> DataFrame:
    """doc_id, n_words, runs (start in words, length, period; by start, then period) and collapsed of every row of docs.

    collapsed: the words that no run contains after its first period, joined by single blanks.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, offsets, ids, chunks in chunked(batch.column("text"), lower=False):
                if b"" in chunks:  # texts without words have the empty chunk alone
                    none = ids == chunks.index(b"")
                    offsets = offsets - np.concatenate([[0], np.cumsum(none)])[offsets]
                    ids = ids[~none]
                start, end, period = repetitions(ids, offsets, shortest)
                edge = np.zeros(len(ids) + 1, np.int64)
                np.add.at(edge, start + period, 1)
                np.add.at(edge, end, -1)
                kept = np.cumsum(edge[:-1]) == 0
                texts = [b" ".join([chunks[i] for i in ids[x:y][kept[x:y]].tolist()]) for x, y in zip(offsets[:-1], offsets[1:])]
                owner = np.searchsorted(offsets, start, "right") - 1
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - offsets[owner], end - start, period)], ["start", "length", "period"])
                bounds = np.searchsorted(owner, np.arange(len(offsets)))
                columns = [batch.column("doc_id").slice(at, len(texts)), pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])
        give_back()

    text = F.col(text_col) if isinstance(text_col, str) else text_col
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, runs array<{RUN}>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli; then least start, then period), runs_sha256, collapsed_sha256."""
    rank = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.array_max(rank).alias("top"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    period = -F.col("top.period")
    milli = F.floor(1000 * F.col("top.length") / period)
    return rows.select("doc_id", "n_runs", (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

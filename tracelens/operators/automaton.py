"""Many patterns in many texts at once: an Aho-Corasick automaton over the patterns' bytes, walked by numpy in Arrow tasks.

The automaton is complete: each state has its successor for every byte, as one table of numbers, with the bytes that no pattern has
in one column. Texts are cut into pieces that overlap by a pattern's length less one byte, and all pieces of a batch take each
step together, so a step is one look-up in the table for every piece. Patterns come in blocks of a bounded number of states, and each
block passes over the texts once; no text meets a pattern that it doesn't hold.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracelens.workers import ship

#: Most bytes of the patterns of one block (a state each, and a few megabytes of table for a thousand), but for a single longer one.
BLOCK_BYTES = 1 << 17
#: Bytes of a piece, and of the texts that are walked at once but for a single longer one.
PIECE, WALKED = 2048, 1 << 22


@dataclass
class Automaton:
    columns: np.ndarray  # 256: the table's column of each byte
    table: np.ndarray  # state x column: the next state
    ends: np.ndarray  # the nearest state of each state's suffixes, itself included, where a pattern ends; 0: none
    further: np.ndarray  # the same of its shorter suffixes
    patterns: dict[int, list[int]]  # of a state: the patterns that end there
    longest: int


def build(patterns: list[bytes]) -> Automaton:
    """The automaton of patterns, none of them empty; equal ones are found each."""
    used = np.unique(np.frombuffer(b"".join(patterns), np.uint8))
    columns = np.zeros(256, np.int64)
    columns[used] = np.arange(1, len(used) + 1)
    children: list[dict[int, int]] = [{}]
    own: dict[int, list[int]] = {}
    for number, p in enumerate(patterns):
        at = 0
        for c in columns[np.frombuffer(p, np.uint8)].tolist():
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
            at = children[at][c]
        own.setdefault(at, []).append(number)
    table = np.zeros((len(children), len(used) + 1), np.int32)
    ends, further, suffix = (np.zeros(len(children), np.int32) for _ in range(3))
    queue = deque([0])
    while queue:  # by depth: a state's suffix is complete before the state
        at = queue.popleft()
        back = suffix[at]
        if at:
            table[at] = table[back]
            further[at] = ends[back]
            ends[at] = at if at in own else ends[back]
        for c, child in children[at].items():
            suffix[child] = table[at, c] if at else 0
            table[at, c] = child
            queue.append(child)
    return Automaton(columns, table, ends, further, own, max(map(len, patterns)))


def matches(a: Automaton, data: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
    """(text, pattern) of all texts data[offsets[i]:offsets[i + 1]] that hold a pattern."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // PIECE))
    text = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[text] + number * PIECE
    length = np.minimum(start + PIECE + a.longest - 1, offsets[text + 1]) - start
    order = np.argsort(-length, kind="stable")
    start, length, text = start[order], length[order], text[order]
    codes = a.columns[data]
    state, found = np.zeros(len(start), np.int64), set()
    live = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), "right")
    for step, n in enumerate(live.tolist()):  # the n longest pieces have this step
        state[:n] = a.table[state[:n], codes[start[:n] + step]]
        hits = a.ends[state[:n]]
        some = np.flatnonzero(hits)
        found.update(zip(text[some].tolist(), hits[some].tolist()))
    out: set[tuple[int, int]] = set()
    for i, end in found:
        while end:
            out.update((i, p) for p in a.patterns[end])
            end = int(a.further[end])
    return out


def blocks(patterns: DataFrame) -> DataFrame:
    """form, pattern, ids, block of patterns (id, form, pattern): blocks bounded by bytes, whatever their number."""
    each = patterns.groupBy("form", "pattern").agg(F.collect_set("id").alias("ids"))
    # Patterns are dealt by hash to groups of some blocks each, and counted off within a group.
    total = each.agg(F.sum(F.octet_length("pattern")).alias("n")).first()["n"] or 0
    each = each.withColumn("part", F.pmod(F.xxhash64("pattern"), F.lit(1 + total // (16 * BLOCK_BYTES))))
    before = Window.partitionBy("part").orderBy("pattern", "form").rowsBetween(Window.unboundedPreceding, -1)
    at = F.floor(F.coalesce(F.sum(F.octet_length("pattern")).over(before), F.lit(0)) / BLOCK_BYTES)
    return each.withColumn("block", F.concat_ws(":", "part", at)).drop("part")


def found_in(patterns: DataFrame, texts: DataFrame, forms: list[str]) -> DataFrame:
    """Rows (id, text_id), each once, of patterns (id, form, pattern) that texts hold; an empty pattern is in none.

    texts has text_id, unique, and a column for each form; a pattern is sought in that of its form. Each block of patterns comes to
    the driver, is made an automaton there and goes to all tasks. Null texts are empty.
    """
    ship()
    dealt = blocks(patterns.filter("pattern <> ''")).persist()
    id_kind, text_kind = dict(patterns.dtypes)["id"], dict(texts.dtypes)["text_id"]
    id_type, out = to_arrow_type(patterns.schema["id"].dataType), texts.select(F.lit(None).cast(id_kind).alias("id"), "text_id").limit(0)
    for (name,) in sorted(dealt.select("block").distinct().collect()):
        rows = dealt.filter(F.col("block") == name).select("form", "pattern", "ids").collect()
        machines = []
        for k, form in enumerate(forms):
            own = [r for r in rows if r["form"] == k]
            if own:
                machines.append((form, build([r["pattern"].encode() for r in own]), [r["ids"] for r in own]))
        shared = texts.sparkSession.sparkContext.broadcast(machines)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits: set[tuple] = set()
                for form, automaton, ids in shared.value:
                    for at, some in _pieces(batch.column(form)):
                        offsets = np.frombuffer(some.buffers()[1], "<i8", len(some) + 1, 8 * some.offset)
                        data = np.frombuffer(some.buffers()[2] or b"", np.uint8)
                        hits.update((at + i, x) for i, p in matches(automaton, data, offsets) for x in ids[p])
                which = pa.array([i for i, _ in hits], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x for _, x in hits], id_type), batch.column("text_id").take(which)], ["id", "text_id"])

        out = out.unionByName(texts.select("text_id", *forms).mapInArrow(run, f"id {id_kind}, text_id {text_kind}"))
    dealt.unpersist()
    return out if len(forms) == 1 else out.distinct()  # a pattern's forms may lie in two blocks


def _pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of some megabytes at a time."""
    whole = texts.fill_null("").cast(pa.large_string())
    size, at = np.asarray(pc.binary_length(whole)), 0
    while at < len(whole):
        n = max(1, int(np.searchsorted(np.cumsum(size[at:]), WALKED, "right")))
        yield at, whole.slice(at, n)
        at += n

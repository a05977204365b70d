"""Chat formatting as relational expressions: no Python on the executors.

A conversation's rows are put in the order of (turn, role, text), nulls first, so that ties and repeated rows have one order and
each row is a turn of its own. Adjacent turns of one role become one run, formatted as

    open role body text (join text)* close

Every mark that occurs inside a role or text is escaped by a backslash after its first character, one more than stand there
already; reading back takes one away. So a mark in the output is always the template's, and read_back() restores every row.
The loss mask is a list of [start, end) spans of code points in the output, one for each assistant text, marks left out.

A conversation's turns are collected as structs and sorted; slices of that array from one change of role to the next are its runs,
and each run's texts are joined. Where a text starts is a running sum over the runs' lengths, and over the texts' in a run, by
pieces, so that n turns take n times the square root of n steps at most.

Defined results. Null text and null role count as empty. A null conv_id is a conversation of its own. A table without rows
gives no rows. Extra columns are ignored. A conversation is one output value, so its turns meet in one row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import let


@dataclass(frozen=True)
class Template:
    open: str = "<s>"
    body: str = "[INST]"
    join: str = "[/INST]"
    close: str = "</s>"
    learned: str = "assistant"

    def marks(self) -> list[str]:
        return [self.open, self.body, self.join, self.close]

    def escape(self, text: Column) -> Column:
        places = "|".join(rf"(?<={re.escape(m[0])})(?=\\*{re.escape(m[1:])})" for m in self.marks())
        return F.regexp_replace(text, places, r"\\")

    def unescape(self, text: Column) -> Column:
        places = "|".join(rf"(?<={re.escape(m[0])})\\(?=\\*{re.escape(m[1:])})" for m in self.marks())
        return F.regexp_replace(text, places, "")


def running(values: Column) -> Column:
    """For each of an array's numbers, the sum of those before it: by pieces of about the square root of their number."""

    def by_pieces(v: Column) -> Column:
        n = F.size(v)
        size = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
        total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
        pieces = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda k: F.slice(v, k * size + 1, size))
        within = lambda p, base: F.transform(p, lambda _, i: base + total(F.slice(p, F.lit(1), i)))
        summed = lambda ps, sums: F.flatten(F.transform(ps, lambda p, k: let(total(F.slice(sums, F.lit(1), k)), lambda base: within(p, base))))
        return F.when(n == 0, F.array().cast("array<int>")).otherwise(let(pieces, lambda ps: let(F.transform(ps, total), lambda sums: summed(ps, sums))))

    return let(values, by_pieces)


def merged(turns: Column, template: Template) -> Column:
    """Runs of adjacent turns of one role, in order: head (the role) and texts, both escaped, and whether they are learned."""

    def by_starts(t: Column, starts: Column) -> Column:
        def run(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(t))
            texts = F.transform(F.slice(t, start + 1, end - start), lambda x: template.escape(x["text"]))
            return F.struct(template.escape(t[start]["role"]).alias("head"), (t[start]["role"] == template.learned).alias("learned"), texts.alias("texts"))

        return F.transform(starts, run)

    def runs(t: Column) -> Column:
        begins = F.transform(t, lambda x, i: F.when((i == 0) | (x["role"] != t[F.greatest(i - 1, F.lit(0))]["role"]), i))
        return let(F.array_compact(begins), lambda starts: by_starts(t, starts))

    return let(turns, runs)


def format_chats(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, formatted, loss_spans(start, end): one row per conversation."""
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    rows = chats.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    rows = rows.select("conv_id", merged(F.col("turns"), template).alias("runs"))
    before = lambda r: F.concat(F.lit(template.open), r["head"], F.lit(template.body))
    piece = lambda r: F.concat(before(r), F.array_join(r["texts"], template.join), F.lit(template.close))
    rows = rows.select("conv_id", "runs", F.transform("runs", piece).alias("pieces"))
    rows = rows.select("conv_id", "runs", "pieces", running(F.transform("pieces", lambda x: F.length(x))).alias("at"))

    def spans(r: Column, at: Column) -> Column:
        first, sizes = at + F.length(before(r)), F.transform(r["texts"], lambda x: F.length(x))
        starts = running(F.transform(sizes, lambda n: n + len(template.join)))
        return F.zip_with(sizes, starts, lambda n, x: F.struct((first + x).alias("start"), (first + x + n).alias("end")))

    none = F.array().cast("array<struct<start:int,end:int>>")
    learned = F.zip_with("runs", "at", lambda r, at: F.when(r["learned"], spans(r, at)).otherwise(none))
    return rows.select("conv_id", F.array_join("pieces", "").alias("formatted"), F.flatten(learned).alias("loss_spans"))


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted conversation holds, in order."""
    q = lambda m: rf"\Q{m}\E"

    def turns_of(run: Column) -> Column:
        parts = F.split(F.substr(run, F.lit(len(template.open) + 1)), q(template.body), 2)
        return let(parts, lambda p: F.transform(F.split(p[1], q(template.join)), lambda x: F.struct(template.unescape(p[0]).alias("role"), template.unescape(x).alias("text"))))

    runs = let(F.split(formatted, q(template.close)), lambda r: F.slice(r, 1, F.size(r) - 1))
    return F.flatten(F.transform(runs, turns_of))


def under_mask(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped. Four bytes a code point let each span be cut out without reading what stands before."""
    cut = lambda b: F.transform(spans, lambda s: template.unescape(F.decode(F.substr(b, 4 * s["start"] + 1, 4 * (s["end"] - s["start"])), "UTF-32")))
    return F.array_join(let(F.encode(formatted, "UTF-32"), cut), "")


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What op8 returns, computed from the output alone."""
    rows = formatted.select("conv_id", "formatted", read_back(F.col("formatted"), template).alias("turns"), under_mask(F.col("formatted"), F.col("loss_spans"), template).alias("loss"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

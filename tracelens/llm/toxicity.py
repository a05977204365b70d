"""Toxicity by a support vector machine on a subsequence string kernel with Nystrom landmarks.

The kernel of two words sums, over all subsequences of three letters that both have, decay ** (length spanned) in each, and
is normalised by its own values. A letter put in, left out or drawn apart costs one decay instead of the match. Words and
sentence labels come from labelled texts: a sentence takes its text's label, words are mined by how much oftener they occur
in toxic texts. The machine is linear (squared hinge, Newton) on Nystrom features K(w, L) K(L, L)^-1/2. A kernel with few
letters has its features at hand, so the trained machine folds into one weight per letter triple, and a word of any text is
scored in time of its triples, whatever the number of landmarks. A text's score is a logistic of its highest word.

Words are what ASCII white space parts, lowered, with digits read as the letters they stand for and marks dropped; runs of
single characters are read as one word too. Words of over WIDTH letters are scored in overlapping windows. Nothing but the
text enters a score.

The fit is bounded, not the scoring: it takes MAX_TEXTS labelled texts, one of each id, and of their words those of 3 to 40 letters,
MAX_WORDS of either kind at most, of a long word its first window, and LANDMARKS of each kind. The logistic is fitted to margins of
texts that the machine has not seen, if each half of the texts has ENOUGH toxic ones, else to those that it has.

Defined results. Null and empty texts have no words and get the lowest score. Rows without a label, and repeated rows, are
scored like others. Without labels of both kinds (or words that tell them apart) every row gets the share of toxic labels.
An empty table gives an empty result. Extra columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import gc
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.llm.chunks import chunked
from tracelens.llm.common import SPACE, Work, cut, one_of_each, ship
from tracelens.llm.rules import words_of

#: Most labelled texts, positive words, negative words and landmarks of each kind that the machine is fitted to.
MAX_TEXTS, MAX_WORDS, LANDMARKS = 8000, 3000, 300
ENOUGH = 50
DECAY, WIDTH, SYMBOLS, BEGIN, MAX_CHUNKS = 0.6, 14, 64, 63, 500_000
#: Three characters or more with single blanks between, and what a text that has such holds.
SINGLES = re.compile(rb"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
SPACED = r"(^|\s)\S[ \t]\S[ \t]\S(\s|$)|(^|\s)\S[ \t]\S[ \t]\S[ \t]"
#: Digits and marks that stand for letters.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _table() -> np.ndarray:
    out = np.zeros(0x300, np.uint8)
    for c in range(0x300):
        x = STANDS_FOR.get(chr(c), chr(c)).lower()[:1]
        if "a" <= x <= "z":
            out[c] = ord(x) - 96
        elif x.isdigit():
            out[c] = 27 + c % 10
        elif x.isalpha():
            out[c] = 37 + c % 26
    return out


TABLE = _table()


@cache
def triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    t = np.array([(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n)], np.int64).reshape(-1, 3)
    return t[:, 0], t[:, 1], t[:, 2], (DECAY ** (t[:, 2] - t[:, 0] + 1)).astype(np.float32)


def codes(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letter triples of equally long words (rows of symbols), and their weights."""
    i, j, k, weight = triples(c.shape[1])
    c = c.astype(np.int32)
    return (c[:, i] * SYMBOLS + c[:, j]) * SYMBOLS + c[:, k], weight


def norms(c: np.ndarray) -> np.ndarray:
    """The square root of each word's kernel with itself."""
    n, size = c.shape
    same = (c[:, :, None] == c[:, None, :]).astype(np.float32)
    d = np.arange(size)[:, None] - np.arange(size)[None, :]
    gap = np.where(d > 0, DECAY ** np.maximum(d, 0), 0).astype(np.float32).T
    b = same * DECAY**2
    for _ in range(2):
        b = (b.reshape(-1, size) @ gap).reshape(n, size, size).transpose(0, 2, 1).reshape(-1, size) @ gap
        b = b.reshape(n, size, size).transpose(0, 2, 1) * same
    return np.sqrt(b.sum((1, 2)))


def windows(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of words, symbols) for each length of window, a bounded number of windows at a time."""
    raw = np.frombuffer(("\v" + "\n\v".join(words)).lower().encode("utf-32-le", "surrogatepass"), "<u4")
    ends = raw == 10
    # A mark of its own (vertical tab, then BEGIN) begins each word: insults mostly do.
    symbols = np.where(raw == 11, BEGIN, np.where(raw < 0x300, TABLE[np.minimum(raw, 0x2FF)], 37 + raw % 26)).astype(np.uint8)
    owner = np.cumsum(ends)
    kept = (symbols > 0) & ~ends
    symbols, owner = symbols[kept], owner[kept]
    length = np.bincount(owner, minlength=len(words))
    start = np.cumsum(length) - length
    word, at, size = np.arange(len(words)), start, np.minimum(length, WIDTH)
    if (length > WIDTH).any():  # further windows every four letters, and one at the end
        long = np.flatnonzero(length > WIDTH)
        more = [(w, x) for w in long for x in [*range(4, length[w] - WIDTH, 4), length[w] - WIDTH]]
        word = np.concatenate([word, [w for w, _ in more]]).astype(np.int64)
        at = np.concatenate([at, [start[w] + x for w, x in more]]).astype(np.int64)
        size = np.concatenate([size, np.full(len(more), WIDTH)])
    for n in range(3, WIDTH + 1):
        these = np.flatnonzero(size == n)
        for k in range(0, len(these), 8192):
            some = these[k : k + 8192]
            yield word[some], symbols[at[some][:, None] + np.arange(n)]


@dataclass
class Machine:
    weights: np.ndarray  # by letter triple
    bias: float
    scale: float = 1.0  # of the logistic on a text's highest margin
    offset: float = 0.0
    floor: float = -2.0  # margin of a text without words

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.floor, np.float32)
        for word, c in windows(words):
            code, weight = codes(c)
            f = (self.weights[code] @ weight) / np.maximum(norms(c), 1e-9) + self.bias
            np.maximum.at(out, word, f)
        return out

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.offset, -30, 30)))


def features(words: list[str]) -> tuple[np.ndarray, list[dict[int, float]]]:
    """Which words have triples (their first window's), and these as normalised sparse features."""
    kept, rows, seen = [], [], set()
    for word, c in windows(words):
        code, weight = codes(c)
        for w, row, norm in zip(word, code, norms(c)):
            if w not in seen:
                seen.add(w)
                x: dict[int, float] = {}
                for u, v in zip(row.tolist(), weight.tolist()):
                    x[u] = x.get(u, 0.0) + v / float(norm)
                kept.append(int(w))
                rows.append(x)
    return np.array(kept, np.int64), rows


def train_words(positive: list[str], negative: list[str], cost: float = 10.0) -> Machine:
    """The machine for words of both kinds; landmarks are the first LANDMARKS of each."""
    known, rows = features(positive + negative)
    y = np.where(known < len(positive), 1.0, -1.0)
    order = np.argsort(known, kind="stable")
    rows, y = [rows[i] for i in order], y[order]
    marks = [*np.flatnonzero(y > 0)[:LANDMARKS], *np.flatnonzero(y < 0)[:LANDMARKS]]
    columns = {u: i for i, u in enumerate({u for m in marks for u in rows[m]})}
    dense = np.zeros((len(rows), len(columns)), np.float32)
    for i, x in enumerate(rows):
        for u, v in x.items():
            if u in columns:
                dense[i, columns[u]] = v
    landmark = dense[marks]
    value, vector = np.linalg.eigh((landmark @ landmark.T).astype(np.float64))
    root = vector[:, value > 1e-6] / np.sqrt(value[value > 1e-6])
    z = np.hstack([(dense @ landmark.T) @ root, np.ones((len(rows), 1))])
    balance = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    w = np.zeros(z.shape[1])
    for _ in range(30):
        inside = y * (z @ w) < 1
        a = z[inside] * (cost * balance[inside])[:, None]
        new = np.linalg.solve(a.T @ z[inside] + np.diag(np.r_[np.ones(len(w) - 1), 1e-6]), a.T @ y[inside])
        done = np.abs(new - w).max() < 1e-7
        w = new
        if done:
            break
    folded = landmark.T @ (root @ w[:-1])
    weights = np.zeros(SYMBOLS**3, np.float32)
    weights[list(columns)] = folded
    return Machine(weights, float(w[-1]))


def altered(words: list[str], seed: int = 11) -> list[str]:
    """The words with a letter put in, and with one doubled."""
    rng, out = np.random.default_rng(seed), []
    for w in words:
        if len(w) > 3:
            i, j = rng.integers(1, len(w), 2)
            out += [w[:i] + chr(97 + int(rng.integers(26))) + w[i:], w[:j] + w[j - 1] + w[j:]]
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_texts: int) -> DataFrame:
    """At most max_texts labelled rows (doc_id, text, y) that are not held out, those of least hash of doc_id."""
    return one_of_each(docs, labels.filter(~held_out(F.col("doc_id"))), "toxic", max_texts, id_col, text_col).withColumnRenamed("id", "doc_id")


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and offset of a logistic of margins, held back a little toward a scale of 1."""
    x, w = np.stack([x, np.ones(len(x))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([0.5, 1e-3]), x.T @ (y - p) - np.array([0.5, 1e-3]) * w)
    return float(max(w[0], 0.1)), float(w[1])


def _machine(rows: DataFrame, each: DataFrame) -> Machine | None:
    """The machine of some labelled texts (row, y, text) and their words (row, y, word, around); None where no word tells them apart."""
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return None
    # A word counts by texts, and in toxic ones by no more than its different surroundings: copies of one text say it once.
    texts = each.select("word", "y", "row").distinct().groupBy("word").agg(F.count_if(F.col("y") == 1).alias("texts"), F.count_if(F.col("y") == 0).alias("good"))
    apart = each.filter("y = 1").select("word", "around").distinct().groupBy("word").agg(F.count("*").alias("apart"))
    words = cut(texts.join(apart, "word", "left").select("word", F.least("texts", F.coalesce("apart", F.lit(0))).alias("bad"), "good"))
    ratio = ((F.col("bad") + 0.1) / bad) / ((F.col("good") + 0.1) / good)
    # A toxic text's first witnesses are the words that tell it best: those of at least half as many toxic surroundings as its
    # best one. What merely stands beside an insult is outvoted by the insult.
    told = words.filter((F.col("bad") >= 3) & (ratio > 8)).select("word", "bad")
    named = each.filter("y = 1").select("row", "word").distinct().join(told, "word")
    named = named.withColumn("top", F.max("bad").over(Window.partitionBy("row"))).filter("2 * bad >= top")
    found = named.groupBy("word").agg(F.count("*").alias("votes")).orderBy(F.desc("votes"), "word").limit(MAX_WORDS).collect()
    positive = [r["word"] for r in found]
    if not positive:
        return None
    clean = words.filter(f"good > 0 AND bad * {good} <= 2 * good * {bad}")
    frequent = clean.orderBy(F.desc("good"), "word").limit(MAX_WORDS // 2).collect()
    rare = clean.orderBy(F.xxhash64("word"), "word").limit(MAX_WORDS).collect()
    negative = list(dict.fromkeys(w["word"] for pair in zip(rare, frequent) for w in pair) | dict.fromkeys(r["word"] for r in rare))
    machine = train_words(positive + altered(positive), negative)
    for _ in range(2):
        # Each sentence's highest word speaks for it: of clean ones the highest are further negatives, and of toxic ones a
        # word that the machine does not place among the clean, however rare, is a further witness.
        top = cut(margins(rows, machine))
        hard = top.filter("y = 0 AND margin > -0.8").groupBy("word").agg(F.max("margin").alias("m")).orderBy(F.desc("m"), "word").limit(MAX_WORDS // 2).collect()
        more = top.filter("y = 1 AND margin > 0.3").groupBy("word").agg(F.max("margin").alias("m")).join(clean.select("word"), "word", "left_anti").orderBy(F.desc("m"), "word").limit(MAX_WORDS).collect()
        positive = list(dict.fromkeys(positive + [r["word"] for r in more]))
        negative = [w for w in dict.fromkeys(negative + [r["word"] for r in hard]) if w not in set(positive)]
        machine = train_words(positive + altered(positive), negative)
    return machine


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_texts: int = MAX_TEXTS) -> Machine | float:
    """The machine, or the share of toxic texts where none can be fitted. Its logistic is fitted to margins that machines of the
    other half of the texts give, so that it knows how unseen texts come out; with fewer than ENOUGH toxic texts in each half, to its own."""
    with Work(docs.sparkSession):
        rows = cut(labelled(docs, labels, id_col, text_col, max_texts).withColumn("row", F.xxhash64("doc_id")))
        bare = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), rf"[^\p{{L}}\p{{N}}{SPACE}@$]+", "")
        rows_of = rows.select("row", "y", words_of(bare).alias("w"))
        near = lambda i: F.xxhash64(F.get("w", i - 1), F.get("w", i + 1))
        placed = F.transform("w", lambda x, i: F.struct(x.alias("word"), near(i).alias("around")))
        each = cut(rows_of.select("row", "y", F.inline(F.array_distinct(placed))).filter("length(word) BETWEEN 3 AND 40"))
        machine = _machine(rows, each)
        if machine is None:
            return float(rows.agg(F.avg("y")).first()[0] or 0.0)
        few, seen = rows.filter("y = 1").count() < 2 * ENOUGH, []
        for half in () if few else (0, 1):
            other = F.pmod("row", F.lit(2)) != half
            m = _machine(rows.filter(other), each.filter(other))
            seen += margins(rows.filter(~other), m or machine).select("margin", "y").rdd.map(lambda r: (float(r[0]), float(r[1]))).collect()
        if few:
            seen = margins(rows, machine).select("margin", "y").rdd.map(lambda r: (float(r[0]), float(r[1]))).collect()
        seen = np.array(seen)
        machine.scale, machine.offset = _logistic(seen[:, 0], (seen[:, 1] > 0).astype(float))
    return machine


def _highest(texts: pa.Array, machine: Machine, known: dict[bytes, float]) -> tuple[list[float], list[str]]:
    """Each text's highest margin, and the word that has it."""
    out, best = [], []

    def learn(words: set[bytes]) -> None:
        new = list(words.difference(known))
        for k in range(0, len(new), 100_000):
            some = new[k : k + 100_000]
            known.update(zip(some, machine.margins([c.decode() for c in some]).tolist()))

    for at, offsets, numbers, chunks in chunked(texts):
        if len(known) > MAX_CHUNKS:
            known.clear()
        n = len(offsets) - 1
        lowered = pc.ascii_lower(pc.fill_null(texts.slice(at, n), ""))
        spaced = {int(i): [m[0].replace(b" ", b"").replace(b"\t", b"") for m in SINGLES.finditer(lowered[int(i)].as_buffer())] for i in np.flatnonzero(np.asarray(pc.match_substring_regex(lowered, SPACED)))}
        learn(set(chunks).union(*spaced.values()))
        each = np.array([known[c] for c in chunks])
        for i, (x, y) in enumerate(zip(offsets[:-1], offsets[1:])):
            some = numbers[x:y]
            top = int(some[np.argmax(each[some])])
            value, word = float(each[top]), chunks[top]
            for w in spaced.get(i, ()):
                if known[w] > value:
                    value, word = known[w], w
            out.append(value)
            best.append(word.decode())
    return out, best


def margins(rows: DataFrame, machine: Machine) -> DataFrame:
    """y, margin, word (the highest word) of each row (text, y)."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top, word = _highest(batch.column("text"), shared.value, {})
            yield pa.RecordBatch.from_arrays([batch.column("y").cast(pa.int32()), pa.array(top, pa.float64()), pa.array(word, pa.string())], ["y", "margin", "word"])

    return rows.select("y", "text").mapInArrow(run, "y int, margin double, word string")


def score(docs: DataFrame, machine: Machine | float, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        m = shared.value
        kept = sys.__dict__.setdefault("_tracelens_margins", {})
        key = None if isinstance(m, float) else hash((m.bias, m.weights.tobytes()))
        if key not in kept:
            kept.clear()
            kept[key] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                if isinstance(m, float):
                    value = np.full(part.num_rows, m)
                else:
                    value = m.score(np.array(_highest(part.column("text"), m, kept[key])[0]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(value, pa.float64())], ["doc_id", "score"])

    found = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""BPE encoding and decoding by a prefix-sharing trie.

A byte-pair encoding is the one sequence of tokens in which every token encodes to itself and every two neighbours encode
to themselves. So the last token of a prefix, with the place where it begins, is all that is needed to go on: a trie node
holds that state, and a word's tokens are read off by following it back from its leaf. Distinct words are inserted in sorted order, so
that nodes arise, and states propagate, depth first; a prefix that words share is encoded once.

Texts are cut at ASCII white space, which no token crosses; each distinct chunk goes through the tokenizer file's own
normaliser and pre-tokeniser, then through the trie. Special tokens in a text become their ids, as the library has it.

Defined results. Null counts as empty: no tokens, digests of the empty string. Repeated rows give repeated rows. Texts of
any length are read whole. Extra columns are ignored. An empty table gives an empty result.
Memory is bounded: the trie and the chunk table start anew beyond MAX_NODES and MAX_CHUNKS, which changes no result.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import struct
import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracelens.llm.chunks import chunked
from tracelens.llm.common import give_back, ship

MAX_NODES, MAX_CHUNKS = 500_000, 300_000
#: Letters up to U+00FF, closed by marks: the normaliser only lowers them, the pre-tokeniser cuts before the marks.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")


PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


#: What a tokenizer file must say for the shortcuts here to hold: how texts are made even, and where they are cut.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def read_spec(path: str) -> str:
    """The tokenizer file's text. A file of another make raises: its texts would be cut, lowered or joined otherwise."""
    text = open(path, encoding="utf-8").read()
    spec = json.loads(text)
    cut = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    model, added = spec["model"], spec["added_tokens"]
    holds = {
        "normalizer": (spec["normalizer"] or {}).get("normalizers") == NORMALIZER,
        "pre_tokenizer": len(cut) == 2 and cut[0] == SPLIT and cut[1]["type"] == "ByteLevel" and not cut[1]["add_prefix_space"] and not cut[1].get("use_regex", True),
        "decoder": spec["decoder"] is None,
        "post_processor": spec["post_processor"] is None,
        "model": model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")),
        "added_tokens": all(t["content"].startswith("<|") and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in added),
    }
    if wrong := [k for k, ok in holds.items() if not ok]:
        raise ValueError(f"this operator does not know the file's {', '.join(wrong)}")
    return text


def byte_characters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for characters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in shown)}


BYTES = byte_characters()


def plain(text: str) -> tuple[str, str] | None:
    """A chunk of letters and marks as the byte-level characters of its word, and its marks; None for other chunks."""
    if not (m := PLAIN.fullmatch(text)):
        return None
    word = m[1].lower()
    return word if word.isascii() else word.encode().decode("latin-1").translate(BYTES), m[2]


class Trie:
    """Encoder of pre-tokens (strings of byte-level characters) under ranked merges and an end-of-word suffix."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = "</w>"):
        self.vocab, self.suffix = vocab, suffix
        pairs = [tuple(m) if isinstance(m, (list, tuple)) else tuple(m.split(" ")) for m in merges]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.parts: dict[str, tuple[str, str]] = {}  # the merge that makes a token
        for p in pairs:
            self.parts.setdefault(p[0] + p[1], p)
        self.made = {t: self.rank[p] for t, p in self.parts.items()}
        self.starts = {t[:k] for t in (x.removesuffix(suffix) or x for x in vocab) for k in range(1, len(t) + 1)}
        self.own: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.good = {t for t in vocab if self.stands(t)}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.last, self.back, self.first = [""], [0], [0]  # by node; the root has no token

    def stands(self, token: str) -> bool:
        """Whether a token of the vocabulary encodes to itself: its halves do, side by side, until its own merge."""
        if (known := self.own.get(token)) is None:
            if token not in self.vocab:
                return False
            if (halves := self.parts.get(token)) is None:
                known = len(token.removesuffix(self.suffix) or token) == 1
            else:
                left, right = halves
                known = self.stands(left) and self.stands(right) and self.apart(left, right, self.made[token])
            self.own[token] = known
        return known

    def apart(self, left: str, right: str, until: int) -> bool:
        """Whether no merge crosses the border of two tokens before rank until.

        Going back in time, the half that was made later is undone. A merge across the border that ranks before what was
        undone last would have come first; one of equal rank comes first if it lies further left.
        """
        made, rank, parts, limit = self.made, self.rank, self.parts, until
        while True:
            if (crossing := rank.get((left, right))) is not None and crossing < limit:
                return False
            a, b = made.get(left, -1), made.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, parts[left][1]
            else:  # at equal rank the left one was merged first, so the right one is undone first
                limit, right = b + 1, parts[right][0]

    def fits(self, left: str, right: str) -> bool:
        if (known := self.pairs.get((left, right))) is None:
            if len(self.pairs) > MAX_NODES:
                self.pairs.clear()
            known = self.pairs[left, right] = self.apart(left, right, 1 << 60)
        return known

    def ending(self, path: list[int], word: str, end: int, tail: str, first: int) -> int:
        """Where the last token of word[:end] + tail begins; path has the nodes of the word's prefixes."""
        good, last, pairs = self.good, self.last, self.pairs
        begin = end
        while begin > first:
            begin -= 1
            token = word[begin:end] + tail if tail else word[begin:end]
            if token in good:
                if not begin:
                    return begin
                pair = (last[path[begin]], token)
                if (known := pairs.get(pair)) is None:
                    known = self.fits(*pair)
                if known:
                    return begin
        raise ValueError(f"no token ends {word[:end] + tail!r}")

    def insert(self, words: list[str]) -> dict[str, list[int]]:
        """The ids of sorted words. Nodes for prefixes arise depth first, each from its parent's state; leaves are not kept."""
        out, child, vocab, starts = {}, self.child, self.vocab, self.starts
        last, back, first, suffix = self.last, self.back, self.first, self.suffix
        before, path = "", [0]
        for word in words:
            n, k = len(word) - 1, 0
            most = min(len(path) - 1, n)
            while k < most and word[k] == before[k]:
                k += 1
            del path[k + 1 :]
            node = path[k]
            for i in range(k, n):
                at = node << 9 | ord(word[i])
                if (new := child.get(at)) is None:
                    f = first[node]
                    while word[f : i + 1] not in starts and f < i:  # what no token starts with, none does when it grows
                        f += 1
                    begin = self.ending(path, word, i + 1, "", f)
                    new = child[at] = len(last)
                    last.append(word[begin : i + 1])
                    back.append(path[begin])
                    first.append(f)
                node = new
                path.append(node)
            begin = self.ending(path, word, n + 1, suffix, first[node])
            ids, at = [vocab[word[begin:] + suffix]], path[begin]
            while at:
                ids.append(vocab[last[at]])
                at = back[at]
            ids.reverse()
            out[word] = ids
            before = word
        return out


class Encoder:
    """Chunks of text to ids and decoded bytes, under a tokenizer file's JSON."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        model = json.loads(spec)["model"]
        self.tok = Tokenizer.from_str(spec)
        self.trie = Trie(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.names = {i: t.encode() for t, i in (model["vocab"] | self.special).items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        """Empties the tables of chunks and words; what a next task needs of them it learns as fast."""
        self.ids: dict[bytes, bytes] = {b"": b""}
        self.shown: dict[bytes, bytes] = {b"": b""}
        self.trie.clear()

    def words(self, chunk: bytes) -> list[str | int]:
        """The pre-tokens of a chunk; an int is a special token's id."""
        text = chunk.decode()
        if pair := plain(text):
            return [x for x in pair if x]
        out: list[str | int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += [w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part))]
        return out

    def learn(self, chunks: set[bytes]) -> None:
        """Puts what is new into the tables."""
        if len(self.ids) > MAX_CHUNKS:  # short chunks are the frequent ones
            self.ids = {c: x for c, x in self.ids.items() if len(c) < 7}
            self.shown = {c: self.shown[c] for c in self.ids}
        if len(self.trie.last) > MAX_NODES:
            self.trie.clear()
        new = chunks.difference(self.ids)
        split = {c: parted(c) for c in new}
        bare = {x for pair in split.values() for x in pair if x}.difference(self.ids)
        parsed = {c: self.words(c) for c in bare}
        known = self.trie.insert(sorted({w for ws in parsed.values() for w in ws if isinstance(w, str)}))
        for c, ws in parsed.items():
            ids = known[ws[0]] if len(ws) == 1 and isinstance(ws[0], str) else [i for w in ws for i in (known[w] if isinstance(w, str) else [w])]
            self.ids[c] = PACK[len(ids)](*ids) if len(ids) < len(PACK) else np.array(ids, "<u4").tobytes()
            self.shown[c] = b" ".join([self.names[i] for i in ids])  # without a decoder in the file, tokens are joined by blanks
        for c, (base, tail) in split.items():
            if tail:
                self.ids[c], self.shown[c] = self.ids[base] + self.ids[tail], b" ".join(filter(None, (self.shown[base], self.shown[tail])))


def parted(chunk: bytes) -> tuple[bytes, bytes]:
    """A chunk and the marks behind its last letter: these are a pre-token of their own."""
    base = chunk.rstrip(b".,;:!?")
    return (base, chunk[len(base) :]) if base[-1:].isalpha() else (chunk, b"")


@contextmanager
def encoder(spec: str) -> Iterator[Encoder]:
    """This process's encoder for a task. The vocabulary stays for the next one (in sys, so that a pickled copy of this module
    finds it too); the tables go, as an idle worker keeps its memory."""
    gc.disable()  # the tables are millions of objects without cycles; scanning them takes longer than all else
    kept = sys.__dict__.setdefault("_tracelens_encoders", {})
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in kept:
        kept.clear()
        kept[key] = Encoder(spec)
    try:
        yield kept[key]
    finally:
        kept[key].forget()
        give_back()


def _joined(parts: list[bytes], numbers: np.ndarray, between: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text's chunks put together, so many at a time."""
    for at in range(0, len(numbers), size):
        some = [x for i in numbers[at : at + size].tolist() if (x := parts[i])]
        if some:
            yield between.join(some)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit), decoded_sha256 (UTF-8), row by row."""
    ship(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(spec.value) as e:
            yield from told(batches, e)

    def told(batches: Iterator[pa.RecordBatch], e: Encoder) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, offsets, numbers, chunks in chunked(batch.column("text"), keep="<|"):
                e.learn(set(chunks))
                ids, shown = [e.ids[c] for c in chunks], [e.shown[c] for c in chunks]
                out: tuple[list, list, list] = ([], [], [])
                for x, y in zip(offsets[:-1], offsets[1:]):
                    n, a, b = 0, hashlib.sha256(), hashlib.sha256()
                    for got in _joined(ids, numbers[x:y], b""):
                        a.update(got)
                        n += len(got) // 4
                    for i, got in enumerate(_joined(shown, numbers[x:y], b" ")):
                        b.update(b" " + got if i else got)
                    for column, v in zip(out, (n, a.hexdigest(), b.hexdigest())):
                        column.append(v)
                part = batch.slice(at, len(out[0]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int)."""
    ship(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(spec.value) as e:
            yield from told(batches, e)

    def told(batches: Iterator[pa.RecordBatch], e: Encoder) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, offsets, numbers, chunks in chunked(batch.column("text"), keep="<|"):
                e.learn(set(chunks))
                known = [e.ids[c] for c in chunks]
                ids = [np.frombuffer(b"".join(_joined(known, numbers[x:y], b"")), "<u4").astype(np.int32) for x, y in zip(offsets[:-1], offsets[1:])]
                part = batch.slice(at, len(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text from doc_id and ids: tokens joined by blanks, special ones too, as a file without a decoder has it."""
    ship(encoded.sparkSession)
    spec = encoded.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(spec.value) as e:
            names = e.names
        for batch in batches:
            texts = [b" ".join([names[i] for i in x.as_py() or []]).decode() for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")

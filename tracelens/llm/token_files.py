"""Token ids as flat files: unsigned integers, 64-bit document offsets, and a manifest with each part's base.

Documents are encoded where they lie and dealt by doc_id ranges (bounds from a quantile sketch of doc_id alone), sorted, and
each range is streamed to one part: PART.tokens (uint16 where the vocabulary allows, else uint32, little-endian),
PART.offsets (int64, one more than documents) and PART.docs (int64). A part is written under a name of its own and renamed
when whole, so a task that runs twice, or is lost half-way, leaves a right file or none. The parts' bases are prefix sums of
their token counts; manifest.json, written last, makes the set valid. Reading maps the files into memory.

Defined results. Null and empty texts are the end id alone. Documents come in ascending doc_id order, null first, equal ids
by their tokens. Repeated rows are repeated. An empty table gives a manifest without parts. Extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm.bpe import parted, plain, read_spec
from tracelens.llm.chunks import chunked
from tracelens.llm.common import partitions, shared_dir, ship

MAX_CHUNKS = 1_000_000


class _Chunks:
    """Chunk to its ids' bytes, by the library; the long ones are dropped beyond MAX_CHUNKS."""

    def __init__(self, spec: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.code, self.kind = Tokenizer.from_str(spec), {2: "H", 4: "I"}[np.dtype(kind).itemsize], kind
        self.pack = [struct.Struct(f"<{n}{self.code}").pack for n in range(32)]
        self.ids: dict[bytes, bytes] = {b"": b""}

    def learn(self, chunks: set[bytes]) -> None:
        if len(self.ids) > MAX_CHUNKS:
            self.ids = {c: x for c, x in self.ids.items() if len(c) < 7}
        known, pack, word_ids = self.ids, self.pack, self.tok.model.tokenize
        split = {c: parted(c) for c in chunks.difference(known)}
        new = []
        for c in {x for pair in split.values() for x in pair if x}.difference(known):
            text = c.decode()
            if (pair := plain(text)) and not pair[1]:  # one pre-token: straight to the library's model
                ids = [t.id for t in word_ids(pair[0])]
                known[c] = pack[len(ids)](*ids) if len(ids) < 32 else np.array(ids, self.kind).tobytes()
            else:
                new.append(text)
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            for c, e in zip(some, self.tok.encode_batch_fast(some, add_special_tokens=False)):
                ids = e.ids
                known[c.encode()] = pack[len(ids)](*ids) if len(ids) < 32 else np.array(ids, self.kind).tobytes()
        for c, (base, tail) in split.items():
            if tail:
                known[c] = known[base] + known[tail]


def _chunks(spec: str, kind: str) -> _Chunks:
    gc.disable()
    kept = sys.__dict__.setdefault("_tracelens_chunks", {})
    key = (hashlib.sha256(spec.encode()).hexdigest(), kind)
    if key not in kept:
        kept.clear()
        kept[key] = _Chunks(spec, kind)
    return kept[key]


def filesystem(uri: str):
    """A pyarrow file system and the path in it; local files are mapped into memory."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        kind, path = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
    else:
        kind, path = fs.LocalFileSystem(), uri
    return (fs.LocalFileSystem(use_mmap=True) if isinstance(kind, fs.LocalFileSystem) else kind), path


def write(docs: DataFrame, path: str, out: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes docs with the tokenizer file at path into the folder out (a new shared one by default), and returns it."""
    spark = docs.sparkSession
    ship(spark)
    text = read_spec(path)
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_str(text).get_vocab_size(with_added_tokens=True)
    kind = "<u2" if max(vocab, end_id + 1) <= 1 << 16 else "<u4"
    spec, closing = spark.sparkContext.broadcast(text), np.array([end_id], kind).tobytes()
    out = out or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = partitions(spark)
    bounds = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0]
    bounds = np.unique(np.array(bounds or [], np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _chunks(spec.value, kind)
        for batch in batches:
            for at, offsets, numbers, chunks in chunked(batch.column("text"), keep="<|"):
                known.learn(set(chunks))
                each = [known.ids[c] for c in chunks]
                ids = [b"".join([each[i] for i in numbers[x:y].tolist()]) + closing for x, y in zip(offsets[:-1], offsets[1:])]
                part = batch.slice(at, len(ids))
                keys = part.column("doc_id")
                to = np.searchsorted(bounds, keys.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right")
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), keys, pa.array(ids, pa.binary())], ["part", "doc_id", "ids"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(out)
        part, own, files, n, null, tokens = -1, uuid.uuid4().hex, [], 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if part < 0:
                part = batch.column("part")[0].as_py()
                fs.create_dir(root, recursive=True)
                files = [fs.open_output_stream(f"{root}/.{own}.{x}") for x in ("tokens", "offsets", "docs")]
                files[1].write(np.zeros(1, "<i8").tobytes())
            ids, keys = batch.column("ids"), batch.column("doc_id")
            lengths = np.array([len(x.as_buffer()) for x in ids], np.int64) // np.dtype(kind).itemsize
            ends = tokens + np.cumsum(lengths)
            for x in ids:
                files[0].write(x.as_buffer())
            files[1].write(ends.astype("<i8").tobytes())
            files[2].write(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            n, null, tokens = n + batch.num_rows, null + keys.null_count, int(ends[-1])
        if part >= 0:
            for f, x in zip(files, ("tokens", "offsets", "docs")):
                f.close()
                fs.move(f"{root}/.{own}.{x}", f"{root}/{part:06d}.{x}")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([null], pa.int64()), pa.array([tokens], pa.int64())], ["part", "n_docs", "n_null", "n_tokens"])

    dealt = rows.mapInArrow(encode, "part int, doc_id long, ids binary").repartitionById(len(bounds) + 1, F.col("part"))
    dealt = dealt.sortWithinPartitions("doc_id", "ids")
    done = sorted(dealt.mapInArrow(store, "part int, n_docs long, n_null long, n_tokens long").collect())
    manifest, base = {"kind": kind, "end_id": end_id, "parts": []}, 0
    for r in done:
        manifest["parts"].append(r.asDict() | {"base": base})
        base += r["n_tokens"]
    fs, root = filesystem(out)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return out


def read(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    ship(spark)
    fs, root = filesystem(out)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    kind = np.dtype(manifest["kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(out)
        for batch in batches:
            for r in batch.to_pylist():
                name = f"{root}/{r['part']:06d}"
                with fs.open_input_file(f"{name}.offsets") as f, fs.open_input_file(f"{name}.docs") as g, fs.open_input_file(f"{name}.tokens") as h:
                    for at in range(0, r["n_docs"], 4096):
                        n = min(4096, r["n_docs"] - at)
                        offsets = np.frombuffer(f.read_at(8 * (n + 1), 8 * at), "<i8")
                        keys = np.frombuffer(g.read_at(8 * n, 8 * at), "<i8")
                        size = kind.itemsize
                        tokens = np.frombuffer(h.read_at(int(offsets[-1] - offsets[0]) * size, int(offsets[0]) * size), kind)
                        crc = [zlib.crc32(tokens[a:b].astype("<u4")) for a, b in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0])]
                        keys = pa.array(keys, pa.int64(), mask=np.arange(at, at + n) < r["n_null"])
                        yield pa.RecordBatch.from_arrays([keys, pa.array(offsets[:-1] + r["base"], pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "part int, n_docs long, n_null long, base long"
    rows = [(p["part"], p["n_docs"], p["n_null"], p["base"]) for p in manifest["parts"]]
    listed = spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), partitions(spark))))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Texts cut at ASCII white space, and numbered by distinct chunk, in Arrow's own code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that are cut at once: at most so many, of at most so many bytes but for a single longer one.
ROWS, BYTES = 512, 8 << 20


def chunked(texts: pa.Array, lower: bool = True, keep: str | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
    """(first row, offsets, numbers, chunks) of some rows at a time: row i's chunks are numbers[offsets[i]:offsets[i + 1]].

    A null, empty or blank text has the empty chunk alone. lower is for A-Z; texts that hold the string keep are not lowered.
    """
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    at = 0
    while at < len(texts):
        n, total = 1, int(size[at])
        while at + n < len(texts) and n < ROWS and total + size[at + n] <= BYTES:
            total += int(size[at + n])
            n += 1
        some = pc.fill_null(texts.slice(at, n), "")
        if total >= 1 << 30:
            some = some.cast(pa.large_string())
        if lower:
            low = pc.ascii_lower(some)
            some = pc.if_else(pc.match_substring(some, keep), some, low) if keep else low
        parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(some))
        offsets = np.asarray(parts.offsets).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        yield at, offsets - offsets[0], np.asarray(coded.indices), coded.dictionary.cast(pa.large_binary()).to_pylist()
        at += n

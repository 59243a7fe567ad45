"""Words of whole columns of texts as 64-bit hashes, found and hashed in bulk.

A word is a run of bytes other than the six ASCII white-space characters, which is the same as a run of such
characters of UTF-8. Its hash is a polynomial of its bytes modulo 2^64, spread by a bijection; the sums of all bytes
of a stretch are made at once, and a word's hash is the difference of two of them. Stretches end at white space, so
memory follows STRETCH, or the longest word where that is longer, and the size of what is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

U = np.uint64
#: Bytes hashed at once, and bytes of text that a slice of a batch holds; a longer text is a slice of its own.
STRETCH, SLICE_BYTES = 1 << 18, 2_000_000
BASE = 0x9E3779B97F4A7C15
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A number for each byte, none of them zero; and the same with the capitals A-Z as small letters.
VALUE = mix(np.arange(1, 257, dtype=np.uint64)) | U(1)
LOWERED = VALUE.copy()
LOWERED[65:91] = VALUE[97:123]


def powers(base: int, n: int) -> np.ndarray:
    """base to the power of 0, 1, ... n - 1, modulo 2^64."""
    out = np.full(n, U(base))
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


class _Powers:
    """Powers of BASE and of its inverse, as many as were needed so far."""

    up = down = np.empty(0, np.uint64)

    @classmethod
    def first(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            cls.up, cls.down = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)
        return cls.up[:n], cls.down


@dataclass
class Words:
    """The words of several texts: hash and first byte of each, the texts' edges among the bytes, and the bytes."""

    hash: np.ndarray
    start: np.ndarray
    edges: np.ndarray
    data: np.ndarray

    def per_text(self) -> np.ndarray:
        """How many words each text has."""
        return np.diff(np.searchsorted(self.start, self.edges))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the edges of its values among them; a null has none."""
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    edges = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    held = column.buffers()[2] if len(column) else None
    data = np.frombuffer(held, np.uint8)[edges[0] : edges[-1]] if held is not None and edges[-1] > edges[0] else np.empty(0, np.uint8)
    return data, edges - edges[0]


def words(column: pa.Array, lower: bool = False) -> Words:
    """The words of a column of texts, in order; with ``lower``, A-Z count as a-z."""
    data, edges = _bytes(column)
    n, at, out = len(data), 0, []
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    while at < n:
        end = min(at + STRETCH, n)
        while end < n:  # to the next white space or edge, so that no word is cut
            ahead = WHITE[data[end : end + STRETCH]] | edge[end : min(end + STRETCH, n)]
            if ahead.any():
                end += int(ahead.argmax())
                break
            end = min(end + STRETCH, n)
        part, border = data[at:end], edge[at : end + 1]
        ink = ~WHITE[part]
        first, last = ink.copy(), ink.copy()
        first[1:] &= ~ink[:-1] | border[1:-1]
        last[:-1] &= ~ink[1:] | border[1:-1]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _Powers.first(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((LOWERED if lower else VALUE)[part] * up, out=total[1:])
        out.append((mix((total[stop] - total[start]) * down[start]), start + at))
        at = end
    hashed, start = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.uint64), np.empty(0, np.int64))
    return Words(hashed, start, edges, data)


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes of text, without rows that have no key (the first column) or no text."""
    for batch in batches:
        if batch.column(0).null_count or batch.column(text).null_count:
            batch = batch.filter(pa.compute.and_(batch.column(0).is_valid(), batch.column(text).is_valid()))
        ends = np.cumsum(pa.compute.binary_length(batch.column(text)).to_numpy(zero_copy_only=False)) if batch.num_rows else np.empty(0, np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()

"""Vectorised reading of texts inside Arrow tasks: words, word hashes and shingles of many documents at once.

A batch of texts is one byte buffer with document offsets. Words are runs of bytes of a table; their 64-bit hashes
come from prefix sums of ``byte * R**position`` modulo 2**64, so no word is touched by Python code. Work goes on in
slices of ``SLICE`` bytes (one document at least), which bounds memory whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 2 << 20
R = 0x9E3779B97F4A7C15 | 1
R_INV = pow(R, -1, 1 << 64)

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def blank_table() -> np.ndarray:
    """True for bytes of words of ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, bool)
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return t


def alnum_table() -> np.ndarray:
    """True for bytes of words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


@dataclass
class Words:
    """Words of some documents: bounds in ``data``, hashes, and ``first[d]:first[d + 1]`` of document ``d``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i below n."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SLICE + 1)
        for name, base in (("up", R), ("down", R_INV)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True) -> Words:
    data = lower_table()[data] if lower else data
    n = len(data)
    m = inside[data] if n else np.zeros(0, bool)
    begins, ends = np.empty(n, bool), np.empty(n, bool)
    if n:
        begins[0], begins[1:] = m[0], m[1:] & ~m[:-1]
        ends[-1], ends[:-1] = m[-1], m[:-1] & ~m[1:]
        edge = offsets[1:-1]
        at = edge[edge < n]
        begins[at] = m[at]
        last = edge[edge > 0] - 1
        ends[last] = m[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))
    return Words(data, offsets, start, end, h, np.searchsorted(start, offsets))


def shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words that stay within a document, and the first shingle of each document.

    The shingle at index ``i`` of a document starts at its word ``i``; a document of fewer words has none here.
    """
    n = len(w.hash)
    if n < width:
        return np.zeros(0, U), np.zeros(len(w.first), np.int64)
    total = np.zeros(n - width + 1, U)
    for k in range(width):
        total = (total * U(0xA24BAED4963EE407)) + w.hash[k : n - width + 1 + k]
    counts = np.maximum(np.diff(w.first) - width + 1, 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(w.first[:-1] - first[:-1], counts) + np.arange(first[-1])
    return mix(total[at]), first


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a text or binary column; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batch: pa.RecordBatch, column: str = "text", most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in slices of about ``most`` bytes of text at most (one row at least) with their bytes and offsets."""
    data, offsets = buffers(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to

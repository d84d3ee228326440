"""Vectorised word handling over Arrow string columns.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``; UTF-8 continuation bytes are never in
that set, so words can be cut on bytes. Words and word sequences are identified by 64-bit hashes:
a polynomial over a random byte table (mod 2^64) followed by an avalanche step. Two different
sequences among n share a hash with a chance of about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U = np.uint64
_R, _R_INV = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The avalanche step of splitmix64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]

_pow: dict[str, np.ndarray] = {"f": np.ones(1, U), "b": np.ones(1, U)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow["f"]) < n:
        for k, r in (("f", _R), ("b", _R_INV)):
            x = np.full(n, r, U)
            x[0] = 1
            _pow[k] = np.multiply.accumulate(x)
    return _pow["f"], _pow["b"]


def _rolling(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, independent of the place."""
    f, b = _powers(len(values) + 1)
    c = np.zeros(len(values) + 1, U)
    np.cumsum(values * f[: len(values)], out=c[1:])
    return mix((c[end] - c[start]) * b[start] + (end - start).astype(U))


@dataclass
class Words:
    """Words of a run of rows. doc: row of each word; first: index of the first word of each row, and
    the number of words at the end; start, end: byte places in data; text_at: byte places of rows."""

    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    text_at: np.ndarray

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the n-word windows, index of each window's first word)."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return _rolling(self.hash, at, at + n), at


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(byte places of rows, data) of a string column; null is the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return at - at[0], data[at[0] : at[-1]]


def words(at: np.ndarray, data: np.ndarray, lower: bool = False) -> Words:
    n = len(data)
    inside = ~_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
    begins[inner] = inside[inner]
    ends[inner - 1] = inside[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    h = _rolling((_BYTE_LOWER if lower else _BYTE)[data], start, end)
    return Words(h, doc, first, start, end, data, at)


def chunks(col: pa.Array, lower: bool = False, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) in runs of rows of about `size` bytes; a longer text is a
    run of its own, so whole texts are kept together."""
    at, data = _bytes(col)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, words(at[lo : hi + 1] - at[lo], data[at[lo] : at[hi]], lower)
        lo = hi


def unpack(blob: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(blob, dtype)


def split_by(shard: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """(shard, places in it in ascending order) for shards that have any."""
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(n + 1))
    return [(s, order[cut[s] : cut[s + 1]]) for s in range(n) if cut[s + 1] > cut[s]]


def word_counts(col: pa.Array) -> np.ndarray:
    """Number of words of each row, without hashes."""
    at, data = _bytes(col)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    inner = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    begins[inner] = inside[inner]
    return np.diff(np.concatenate([[0], np.cumsum(begins)])[at])

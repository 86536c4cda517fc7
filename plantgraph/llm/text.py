"""Vectorised text primitives shared by the training-data operators.

Spark hands Python workers whole Arrow string columns, whose bytes already lie end to end in one
buffer. Everything here works on that buffer with numpy: a batch is cut into slices of whole
documents (about ``SLICE_BYTES`` each, one long document may be more), words are found by a
256-entry separator table, and 64-bit word hashes come from prefix sums of a polynomial, a chunk of
bytes at a time, so temporary memory does not grow with a document's length.

Hashes are 64-bit fingerprints. They route and group; operators whose contract is exact on text
confirm on the bytes or words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
CHUNK_BYTES = 1 << 19

U = np.uint64
P = U(0x9E3779B97F4A7C15 | 1)
_MASK = (1 << 64) - 1
_INV = U(pow(int(P), -1, 1 << 64))
_SHINGLE = [U(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(1, 65)]

#: Separator tables: True where a byte separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
for _lo, _hi in ((0x30, 0x39), (0x61, 0x7A)):
    NOT_ALNUM[_lo : _hi + 1] = False
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of P and of its inverse, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        out = []
        for base in (P, _INV):
            a = np.full(size, base, U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; returns a new array."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Slice:
    """Some whole documents of a batch: ``data`` (uint8) with ``offs`` (document bounds in it)."""

    __slots__ = ("data", "first", "offs")

    def __init__(self, data: np.ndarray, offs: np.ndarray, first: int):
        self.data, self.offs, self.first = data, offs, first

    def __len__(self) -> int:
        return len(self.offs) - 1


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column's documents in order, as slices; a null document has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, obuf, dbuf = column.buffers()
    offs = np.frombuffer(obuf, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(dbuf, np.uint8) if dbuf is not None and dbuf.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield Slice(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], i)
        i = j


class Words:
    """Words of a slice: byte bounds ``start``/``end``, and ``first``: word bounds of documents."""

    __slots__ = ("data", "end", "first", "offs", "start")

    def __init__(self, s: Slice, separators: np.ndarray = SPACE, lower: bool = False):
        self.data = LOWER[s.data] if lower else s.data
        self.offs = s.offs
        n = len(self.data)
        edge = np.ones(n + 1, bool)
        gap = separators[self.data]
        np.logical_not(gap, out=gap)  # now True inside words
        edge[1:n] = gap[1:] != gap[:-1]
        edge[0] = edge[n] = True
        edge[s.offs] = True
        at = np.flatnonzero(edge)
        if n:
            inside = gap[at[:-1]]
            self.start = at[:-1][inside]
            self.end = at[1:][inside]
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, s.offs, "left")

    def __len__(self) -> int:
        return len(self.start)

    def doc_of(self) -> np.ndarray:
        """Document index of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return hashes(self.data, self.start, self.end)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for ascending, disjoint ranges, a chunk of bytes at a time."""
    out = np.zeros(len(start), U)
    i, n = 0, len(start)
    while i < n:
        j = max(int(np.searchsorted(end, start[i] + CHUNK_BYTES, "right")), i + 1)
        lo, hi = int(start[i]), int(end[j - 1])
        power, inverse = _powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, U)
        np.cumsum((data[lo:hi].astype(U) + U(1)) * power[: hi - lo], out=total[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (total[e] - total[s]) * inverse[s] ^ (e - s).astype(U) * U(0xA0761D6478BD642F)
        i = j
    return mix(out)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes (across documents too: mask those that cross)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = words[:n] * _SHINGLE[0]
    for j in range(1, k):
        out += words[j : n + j] * _SHINGLE[j]
    return mix(out)


def starts_within(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """True for each of the n positions from which a run of k stays in its document."""
    ok = np.zeros(n + 1, np.int32)
    last = np.maximum(first[1:] - k + 1, first[:-1])
    np.add.at(ok, first[:-1], 1)
    np.add.at(ok, last, -1)
    return np.cumsum(ok[:n]) > 0


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())

"""Vectorised text primitives for Arrow batches.

A batch's text column is one run of UTF-8 bytes; words, word hashes and window hashes of all
its documents are computed together with numpy. Words are runs of bytes other than space and
0x09-0x0D, which never occur inside a multi-byte character. Hashes are polynomial sums modulo
2**64 over random byte codes, finished with a mixing function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document forms a slice of its own.
SLICE_BYTES = 1 << 19

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, (2, 256), dtype=np.uint64) | _U(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_WIDE_BASES = (0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@dataclass
class Text:
    """The bytes of some documents, and where each begins (one more offset than documents)."""

    data: np.ndarray
    offsets: np.ndarray
    first: int  # row of the first document in its batch

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Text]:
    """The documents of a column in slices of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield Text(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def parts(text: Text, size: int, over: int) -> Iterator[tuple[Text, int]]:
    """A slice, and how many of its bytes count: all of them, but of a single document of more than ``size`` bytes, parts
    of that size, each followed by ``over`` bytes of the next."""
    n = len(text.data)
    if len(text) != 1 or n <= size:
        yield text, n
        return
    for at in range(0, n, size):
        data = text.data[at : at + size + over]
        yield Text(data, np.array([0, len(data)]), text.first), min(size, n - at)


@dataclass
class Words:
    """Words in text order: byte range, document (row in the slice), and each document's first word."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # one more than documents

    def __len__(self) -> int:
        return len(self.start)


def words(text: Text, breaks: np.ndarray = _SPACE) -> Words:
    """Runs of bytes that ``breaks`` (by byte value) does not mark."""
    n, docs = len(text.data), len(text)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, empty, np.zeros(docs + 1, np.int64))
    solid = ~breaks[text.data]
    edge = np.zeros(n + 1, bool)
    edge[text.offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, text.offsets, "left")
    return Words(start, end, np.repeat(np.arange(docs), np.diff(first)), first)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; other bytes stay."""
    return _LOWER[data]


def byte_sums(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums from which hashes_between() takes any byte range."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[which][data] * powers(_BASES[which], len(data)), out=sums[1:])
    return sums


def hashes_between(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range [start, end)."""
    raw = (sums[end] - sums[start]) * powers(inverse(_BASES[which]), len(sums))[start]
    return mix(raw + (end - start).astype(np.uint64) * _U(0x9FB21C651E98DF25))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """The same in one call."""
    return hashes_between(byte_sums(data, which), start, end, which)


def sums_of(hashes: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums from which span_hashes() takes any run of words."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_WIDE_BASES[which], len(hashes)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of words [start, end), with its length."""
    back = powers(inverse(_WIDE_BASES[which]), len(sums))[start]
    return mix((sums[end] - sums[start]) * back + (end - start).astype(np.uint64))


def window_starts(w: Words, size: int) -> np.ndarray:
    """The first word of every window of ``size`` words that lies within one document."""
    if len(w) < size:
        return np.zeros(0, np.int64)
    at = np.arange(len(w) - size + 1)
    return at[w.doc[at] == w.doc[at + size - 1]]


def code_points(text: Text) -> np.ndarray:
    """At each byte position, the number of code points before it (one more than bytes)."""
    out = np.zeros(len(text.data) + 1, np.int64)
    np.cumsum((text.data & 0xC0) != 0x80, out=out[1:])
    return out


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive positions ``first``."""
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return sums[first[1:]] - sums[first[:-1]]

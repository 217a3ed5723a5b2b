"""Range asymmetric numeral coding of token ids with one shared, static frequency table.

A block is coded by ``LANES`` interleaved coders: token i goes to lane i mod LANES. States are
64-bit in [2**31, 2**63) and give out 32-bit words. Every ``STRIDE`` steps the states and the
position in the words are noted as a checkpoint, so the parts of a block between checkpoints can
be decoded apart from each other, as can blocks.

Coding runs backwards, so that decoding runs forwards; the words of a step are laid down in lane
order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LANES = 512
STRIDE = 128
PRECISION = 20
_LOW = np.uint64(1 << 31)


@dataclass
class Table:
    """Frequencies that sum to 2**PRECISION, and what decoding needs from them."""

    freq: np.ndarray
    start: np.ndarray
    symbol: np.ndarray


def quantised(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Frequencies in proportion to ``counts`` that sum to 2**precision; at least 1 where a count is.

    What rounding leaves over goes to, or comes from, the most frequent symbols.
    """
    total, seen = int(counts.sum()), counts > 0
    if seen.sum() > 1 << precision:
        raise ValueError("more symbols than slots")
    freq = np.zeros(len(counts), np.int64)
    if not total:
        return freq
    freq[seen] = np.maximum(1, np.floor(counts[seen] / total * (1 << precision)).astype(np.int64))
    gap = (1 << precision) - int(freq.sum())
    for at in np.argsort(-freq, kind="stable"):
        if gap == 0:
            break
        step = gap if gap > 0 else max(gap, 1 - int(freq[at]))
        freq[at] += step
        gap -= step
    return freq


def table(freq: np.ndarray) -> Table:
    start = np.concatenate([[0], np.cumsum(freq)])[:-1]
    symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
    return Table(freq.astype(np.uint64), start.astype(np.uint64), symbol)


def encode(ids: np.ndarray, t: Table, lanes: int = LANES, stride: int = STRIDE, precision: int = PRECISION):
    """``words`` (uint32) and ``checkpoints`` (rows of a word position and the lanes' states)."""
    n = len(ids)
    steps = -(-n // lanes)
    freq, start = np.ones(steps * lanes, np.uint64), np.zeros(steps * lanes, np.uint64)
    freq[:n], start[:n] = t.freq[ids], t.start[ids]
    freq, start = freq.reshape(steps, lanes), start.reshape(steps, lanes)
    limit = freq << np.uint64(63 - precision)
    state = np.full(lanes, _LOW, np.uint64)
    out, marks, count = [], [], 0
    bits, mask = np.uint64(precision), np.uint64(0xFFFFFFFF)
    for k in range(steps - 1, -1, -1):
        live = n - k * lanes if k == steps - 1 else lanes
        s, f = state[:live], freq[k, :live]
        over = s >= limit[k, :live]
        if over.any():
            words = (s[over] & mask).astype(np.uint32)
            out.append(words[::-1])
            count += len(words)
            s[over] >>= np.uint64(32)
        q = s // f
        state[:live] = (q << bits) + (s - q * f) + start[k, :live]
        if k % stride == 0:
            marks.append((count, state.copy()))
    words = np.concatenate(out)[::-1] if out else np.zeros(0, np.uint32)
    rows = [np.concatenate([[np.uint64(count - c)], s]) for c, s in reversed(marks)]
    return np.ascontiguousarray(words), np.array(rows, np.uint64).reshape(len(rows), lanes + 1)


def decode(words: np.ndarray, checkpoints: np.ndarray, n: int, t: Table, stride: int = STRIDE, precision: int = PRECISION, parts: slice = slice(None)) -> np.ndarray:
    """The ids of a block, or of the ``parts`` (a slice over checkpoints) of it.

    Parts are independent, so they are decoded side by side: one step handles the lanes of all.
    """
    lanes = checkpoints.shape[1] - 1
    numbers = np.arange(len(checkpoints))[parts]
    if not len(numbers):
        return np.zeros(0, np.uint32)
    state = checkpoints[numbers, 1:].copy()
    at = checkpoints[numbers, 0].astype(np.int64)
    span = stride * lanes
    sizes = np.minimum(n - numbers * span, span)
    out = np.zeros((len(numbers), span), np.uint32)
    bits, mask, low = np.uint64(precision), np.uint64((1 << precision) - 1), _LOW
    padded = np.append(words, np.zeros(1, np.uint32))
    column = np.arange(lanes)
    for k in range(-(-int(sizes.max()) // lanes)):
        slot = state & mask
        symbol = t.symbol[slot]
        after = t.freq[symbol] * (state >> bits) + slot - t.start[symbol]
        live = column < (sizes - k * lanes)[:, None]
        need = (after < low) & live
        place = np.cumsum(need, axis=1)
        fill = padded[np.where(need, at[:, None] + place - 1, len(words))].astype(np.uint64)
        after = np.where(need, (after << np.uint64(32)) | fill, after)
        at += place[:, -1]
        state = np.where(live, after, state)
        out[:, k * lanes : (k + 1) * lanes] = symbol
    return np.concatenate([row[:size] for row, size in zip(out, sizes, strict=True)])

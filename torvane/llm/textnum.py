"""Words, hashes and windows of Arrow text columns as numpy arrays, over slices of bounded size.

Words are runs of bytes outside a set of ASCII separators, so UTF-8 needs no decoding. Hashes are 64 bits and the
same on every machine; two different inputs share one with a chance of about 2 ** -64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one slice holds, unless a single text is longer.
SLICE = 1 << 20

_ODD, _U = 0xD6E8FEB86659FD93, np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of the bytes that belong to words: all but those in the ranges, whose ends count."""
    table = np.ones(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = False
    return table


#: Words between white space, and words of letters, digits and everything beyond ASCII (after lower-casing).
SPACED = separators((0x20, 0x20), (0x09, 0x0D))
ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
AS_IS = np.arange(256, dtype=np.uint8)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2 ** 64, as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, _U), np.ones(1, _U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, SLICE + 1)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, b, _U)])) for b in (self.base, self.inverse))
        return self.up, self.down


_in_word, _in_window = _Powers(0x9E3779B185EBCA87), _Powers(0xC2B2AE3D27D4EB4F)


@dataclass
class Words:
    """The words of the texts at rows lo to hi of a batch: word j is data[start[j]:end[j]]; first[i] is text i's first word."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    low: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """Of each word, its text counted from lo."""
        return np.repeat(np.arange(self.hi - self.lo), self.count)

    def hashes(self) -> np.ndarray:
        up, down = _in_word(len(self.low) + 1)
        total = np.zeros(len(self.low) + 1, _U)
        np.cumsum(_BYTE[self.low] * up[: len(self.low)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])

    def windows(self, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether those words are in one text."""
        n = len(h)
        if n < k:
            return np.zeros(n, _U), np.zeros(n, bool)
        up, down = _in_window(n + 1)
        total = np.zeros(n + 1, _U)
        np.cumsum(h * up[:n], out=total[1:])
        out = np.zeros(n, _U)
        out[: n - k + 1] = mix((total[k:] - total[: n - k + 1]) * down[: n - k + 1] + _U(k))
        whole = np.repeat(self.first[1:], self.count) - np.arange(n) >= k
        return out, whole


def slices(column: pa.Array, table: np.ndarray, fold: np.ndarray = LOWER, size: int = SLICE) -> Iterator[Words]:
    """The words of a string column, some texts at a time; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    _, raw, body = column.buffers()
    offsets = np.frombuffer(raw, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1))
        own = data[offsets[lo] : offsets[hi]]
        yield words(lo, hi, own, offsets[lo : hi + 1] - offsets[lo], table, fold)
        lo = hi


def words(lo: int, hi: int, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: np.ndarray) -> Words:
    low = fold[data]
    inside, edge = table[low], np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(lo, hi, data, offsets, start, end, np.searchsorted(start, offsets), low)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of x[i:i+w] for each i; near the end, of what is left."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        if step >= len(out):
            break
        out = np.concatenate([np.minimum(out[:-step], out[step:]), out[-step:]])
        have += step
    if have < w:  # fewer values than the window
        out = np.minimum.accumulate(x[::-1])[::-1]
    return out

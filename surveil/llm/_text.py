"""Byte- and word-level helpers on Arrow string columns, vectorised with numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is the
same as the character class ``[^\\x20\\x09-\\x0D]+`` on UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: All ASCII but letters and digits.
IS_MARK = np.ones(256, bool)
IS_MARK[128:] = False
IS_MARK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False

_M64 = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix construction)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream64(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers that depend on the seed alone."""
    start = np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & _M64)
    return mix64(start + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Rolling:
    """Polynomial hashes modulo 2**64 of any stretch of a sequence of 64-bit values."""

    def __init__(self, seed: int):
        self.base = int(stream64(seed, 1)[0]) | 5
        self.back = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 12)
            for name, base in (("up", self.base), ("down", self.back)):
                p = np.full(size, np.uint64(base))
                p[0] = 1
                np.multiply.accumulate(p, out=p)
                setattr(self, name, p)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums, one longer than the values."""
        self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((sums[end] - sums[start]) * self.down[start])


BYTE_VALUE = {seed: stream64(seed, 256) for seed in (1, 2)}
_WORDS = {1: Rolling(11), 2: Rolling(12)}
_GRAMS = {1: Rolling(21), 2: Rolling(22)}


@dataclass
class Words:
    """The words of a run of documents. first[d]:first[d+1] are the words of document d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, seed: int = 1) -> np.ndarray:
        roll = _WORDS[seed]
        return roll.of(roll.sums(BYTE_VALUE[seed][self.data]), self.start, self.end)

    def canonical(self) -> Words:
        """The same words with one space between words and none elsewhere."""
        length = self.end - self.start
        gap = np.ones(len(length), np.int64)
        last = self.first[1:][np.diff(self.first) > 0] - 1
        gap[last] = 0
        start = np.zeros(len(length), np.int64)
        np.cumsum((length + gap)[:-1], out=start[1:])
        size = int(start[-1] + length[-1]) if len(length) else 0
        out = np.full(size, 0x20, np.uint8)
        put = np.zeros(size + 1, np.int8)
        put[start] += 1
        put[start + length] -= 1
        inside = np.cumsum(put[:-1], dtype=np.int8).astype(bool)
        keep = np.zeros(len(self.data) + 1, np.int8)
        keep[self.start] += 1
        keep[self.end] -= 1
        out[inside] = self.data[np.cumsum(keep[:-1], dtype=np.int8).astype(bool)]
        return Words(out, start, start + length, self.first)


def grams(values: np.ndarray, first: np.ndarray, n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of n values inside one document, and their hashes."""
    if len(values) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    roll = _GRAMS[seed]
    sums = roll.sums(values)
    ok = np.ones(len(values) - n + 1, bool)
    inner = first[1:-1]
    inner = inner[(inner > 0) & (inner < len(values))]
    if len(inner):  # no run may cross the first word of a document
        d = np.zeros(len(values) + 1, np.int32)
        np.add.at(d, np.maximum(inner - n + 1, 0), 1)
        np.add.at(d, inner, -1)
        ok = np.cumsum(d[: len(ok)]) == 0
    at = np.flatnonzero(ok)
    return at, roll.of(sums, at, at + n)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and each row's offset. Nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def doc_chunks(col: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about limit bytes: first row, last row + 1, bytes, offsets. A longer row comes alone."""
    data, off = text_bytes(col)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words_of(data: np.ndarray, off: np.ndarray, is_space: np.ndarray = IS_SPACE) -> Words:
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(data, z, z, np.zeros(len(off), np.int64))
    space = is_space[data]
    edge = np.zeros(n + 1, bool)  # a document begins or ends here
    edge[off] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = space[:-1]
    after[:-1] = space[1:]
    before |= edge[:-1]
    after |= edge[1:]
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    return Words(data, start, end, np.searchsorted(start, off))


def spread(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given lengths laid end to end: each item's group and place in it."""
    group = np.repeat(np.arange(len(length)), length)
    begin = np.cumsum(length) - length
    return group, np.arange(len(group)) - np.repeat(begin, length)


def strings(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """An Arrow string column over given UTF-8 bytes."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_string(), len(off) - 1, buffers).cast(pa.string())

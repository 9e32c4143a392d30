"""Vectorised work on UTF-8 columns: words, rolling hashes, hash tables (numpy)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Odd multipliers of the hashes.
BASE, BASE2, MIX = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xFF51AFD7ED558CCD)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or large_string column, end to end, and n + 1 offsets; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)  # not copied
    return data[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, size: int):
    """Ranges of documents of about ``size`` bytes; a longer document stands alone."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * MIX
    return x ^ (x >> U(29))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number of two, in this order: one to one in either, and no polynomial."""
    x = a * BASE
    x ^= x >> U(32)
    x += b
    x *= MIX
    return x ^ (x >> U(29))


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, with eight zeros behind the data."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


#: The low n bytes of a lane.
LANE_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
#: Bytes of a span from which on it is hashed by itself.
LONG_SPAN = 256


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span [start, end), eight bytes a step; another one for another ``key``."""
    size = end - start
    lane = lanes(data)
    out = combine(size.astype(U) * BASE2 + U(key), lane[start] & LANE_MASK[np.clip(size, 0, 8)])
    left = np.flatnonzero((size > 8) & (size <= LONG_SPAN))
    at = 8
    while len(left):
        out[left] = combine(out[left], lane[start[left] + at] & LANE_MASK[np.minimum(size[left] - at, 8)])
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(size > LONG_SPAN):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, salt=key.to_bytes(8, "little")).digest(), "little")
    return out


def same_spans(x: np.ndarray, x_start: np.ndarray, y: np.ndarray, y_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """True where the spans of this size from x_start and y_start on have the same bytes; x and y are lanes."""
    out = (x[x_start] ^ y[y_start]) & LANE_MASK[np.clip(size, 0, 8)] == 0
    left, at = np.flatnonzero(out & (size > 8) & (size <= LONG_SPAN)), 8
    while len(left):
        out[left] = (x[x_start[left] + at] ^ y[y_start[left] + at]) & LANE_MASK[np.minimum(size[left] - at, 8)] == 0
        at += 8
        left = left[out[left] & (size[left] > at)]
    for i in np.flatnonzero(out & (size > LONG_SPAN)):
        a, b, n = x_start[i], y_start[i], size[i]
        out[i] = x[a + n - 8] == y[b + n - 8] and np.array_equal(x[a : a + n - 7 : 8], y[b : b + n - 7 : 8])
    return out


def rolling(values: np.ndarray, k: int, key: np.uint64 = BASE) -> np.ndarray:
    """Hash of every k consecutive values, by start; shorter inputs give none.  Windows of powers of two are combined."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, done = np.full(n, key, U), 0
    power, part = 1, values
    while True:
        if k & power:
            out = combine(out, part[done : done + n])
            done += power
        if power * 2 > k:
            return out
        part = combine(part[:-power], part[power:])
        power *= 2


def white(data: np.ndarray) -> np.ndarray:
    """The six ASCII characters that separate words: 0x09-0x0D and 0x20."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and n + 1 offsets of the documents' words."""
    ink = ~white(data)
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    full = off[:-1][off[1:] > off[:-1]]
    first[full] = ink[full]
    ends = off[1:][off[1:] > off[:-1]] - 1
    last[ends] = ink[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def window_mask(word_off: np.ndarray, k: int) -> np.ndarray:
    """For each word start: True where k words from here lie in one document."""
    n = int(word_off[-1])
    mask = np.zeros(n, bool)
    size = np.diff(word_off)
    has = size >= k
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, word_off[:-1][has], 1)
    np.add.at(edge, word_off[1:][has] - k + 1, -1)
    if n:
        mask = np.cumsum(edge[:-1]) > 0
    return mask


def covered(hit: np.ndarray, k: int) -> np.ndarray:
    """True for each position within k from a hit, the hit's own included."""
    edge = np.zeros(len(hit) + 1, np.int32)
    at = np.flatnonzero(hit)
    edge[at] += 1
    np.add.at(edge, np.minimum(at + k, len(hit)), -1)
    return np.cumsum(edge[:-1]) > 0


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each row, end to end."""
    total = int(size.sum())
    before = np.cumsum(size) - size
    return flat[np.repeat(start - before, size) + np.arange(total)]


class HashTable:
    """Open addressing from 64-bit keys to 32-bit values, a whole array at a time."""

    def __init__(self, room: int = 1 << 16):
        self.bits, self.count = max(4, int(2 * room - 1).bit_length()), 0
        self.keys, self.values = np.zeros(1 << self.bits, U), np.zeros(1 << self.bits, np.int32)

    def _slot(self, keys):
        return ((keys * BASE) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where it is absent."""
        keys = np.where(keys == 0, U(1), keys)
        slot, mask = self._slot(keys), (1 << self.bits) - 1
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], np.int32(-1))
        left = np.flatnonzero((seen != keys) & (seen != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & mask
            seen, want = self.keys[slot], keys[left]
            hit = seen == want
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (seen != 0)
            left, slot = left[go], slot[go]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in the table yet."""
        keys = np.where(keys == 0, U(1), keys)
        self.count += len(keys)
        if 2 * self.count > len(self.keys):
            old = self.keys != 0
            k, v = self.keys[old], self.values[old]
            self.bits = int(4 * self.count - 1).bit_length()
            self.keys, self.values = np.zeros(1 << self.bits, U), np.zeros(1 << self.bits, np.int32)
            self._put(k, v)
        self._put(keys, values)

    def _put(self, keys, values):
        slot, mask = self._slot(keys), (1 << self.bits) - 1
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            own = self.keys[slot] == keys
            self.values[slot[own]] = values[own]
            keys, values, slot = keys[~own], values[~own], (slot[~own] + 1) & mask

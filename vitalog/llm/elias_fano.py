"""Elias-Fano lists of ascending 64-bit numbers, built and searched with numpy.

A number's low bits are packed side by side; its high bits are a unary code in a bitmap. Selecting
the zeros of the bitmap leads to the few numbers that share a query's high bits.
"""

from __future__ import annotations

import struct

import numpy as np

_LOW_LIMIT = 56


def _pack(low: np.ndarray, width: int) -> bytes:
    out = []
    for lo in range(0, len(low), 1 << 16):  # a multiple of 8 numbers fills whole bytes; bits above the width are left out
        part = low[lo:lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        out.append(np.packbits(np.unpackbits(part, axis=1, count=width, bitorder="little").ravel(), bitorder="little").tobytes())
    return b"".join(out)


def encode(values: np.ndarray) -> bytes:
    """Bytes of an ascending list (equal neighbours allowed)."""
    values = values.astype(np.uint64, copy=False)
    n = len(values)
    if not n:
        return struct.pack("<QQQ", 0, 0, 0)
    top = int(values[-1])
    width = min(max((top // n).bit_length() - 1, 0), _LOW_LIMIT)
    high = values >> np.uint64(width)
    length = n + int(high[-1]) + 1
    bitmap = np.zeros((length + 63) // 64 * 64, np.uint8)
    high += np.arange(n, dtype=np.uint64)
    bitmap[high.view(np.int64)] = 1
    del high
    bitmap = np.packbits(bitmap, bitorder="little").tobytes()
    return struct.pack("<QQQ", n, width, len(bitmap)) + bitmap + _pack(values, width)


class EliasFano:
    """A list in its encoded form over any buffer, a memory map among them."""

    def __init__(self, data) -> None:
        data = np.frombuffer(data, np.uint8) if isinstance(data, (bytes, memoryview)) else data
        self.n, self.width, size = struct.unpack("<QQQ", bytes(data[:24]))
        self.words = data[24:24 + size].view("<u8")
        self.low = data[24 + size:]
        self._counts: dict[bool, np.ndarray] = {}

    def all(self) -> np.ndarray:
        """The whole list."""
        if not self.n:
            return np.zeros(0, np.uint64)
        ones = np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))[:self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64)
        return high << np.uint64(self.width) | self._low(np.arange(self.n))

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        bit = at * self.width
        byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
        out = np.zeros(len(at), np.uint64)
        last = len(self.low) - 1
        for k in range((self.width + 14) // 8):
            out |= self.low[np.minimum(byte + k, last)].astype(np.uint64) << np.uint64(8 * k)
        return (out >> shift) & np.uint64((1 << self.width) - 1)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th one or zero of the bitmap, counted from 0."""
        if one not in self._counts:
            ones = np.bitwise_count(self.words).astype(np.int64)
            self._counts[one] = np.concatenate([[0], np.cumsum(ones if one else 64 - ones)])
        counts = self._counts[one]
        word = np.minimum(np.searchsorted(counts, k, side="right") - 1, len(self.words) - 1)
        rest, bits, place = k - counts[word], self.words[word] if one else ~self.words[word], np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            part = bits & np.uint64((1 << step) - 1)
            count = np.bitwise_count(part).astype(np.int64)
            skip = rest >= count
            rest = np.where(skip, rest - count, rest)
            place += np.where(skip, step, 0)
            bits = np.where(skip, bits >> np.uint64(step), part)
        return word * 64 + place

    def at(self, places: np.ndarray) -> np.ndarray:
        """The numbers at some places."""
        if not len(places):
            return np.zeros(0, np.uint64)
        high = (self._select(places, True) - places).astype(np.uint64)
        return high << np.uint64(self.width) | self._low(places)

    def _shared(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the numbers with the high bits of each key begin and end, and which keys have higher bits than any number."""
        most = len(self.words) * 64 - self.n - 1
        high = keys >> np.uint64(self.width)
        beyond = high > np.uint64(most)
        high = np.minimum(high, np.uint64(most)).astype(np.int64)
        last = self._select(high, False) - high
        first = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - (high - 1), 0)
        return first, last, beyond

    def _search(self, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first number between two places that share a key's high bits whose low bits are not below the key's; whether it is the key."""
        low, end = keys & np.uint64((1 << self.width) - 1), hi.copy()
        lo, hi = lo.copy(), hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            middle = (lo[open_] + hi[open_]) >> 1
            less = self._low(middle) < low[open_]
            lo[open_] = np.where(less, middle + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], middle)
        inside = lo < end
        equal = np.zeros(len(keys), bool)
        equal[inside] = self._low(lo[inside]) == low[inside]
        return lo, equal

    def successor(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first number not below each key, and whether it equals the key."""
        keys = keys.astype(np.uint64)
        if not self.n or not len(keys):
            return np.full(len(keys), self.n, np.int64), np.zeros(len(keys), bool)
        first, last, beyond = self._shared(keys)
        at, equal = self._search(keys, first, last)
        return np.where(beyond, self.n, at), equal & ~beyond

    def successor_within(self, keys: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`successor`, looking only at the places from ``begin`` up to ``end`` of each key; ``end`` where none is not below it."""
        keys = keys.astype(np.uint64)
        if not self.n or not len(keys):
            return end.copy(), np.zeros(len(keys), bool)
        first, last, beyond = self._shared(keys)
        at, equal = self._search(keys, np.clip(first, begin, end), np.clip(last, begin, end))
        return np.where(beyond, end, at), equal & ~beyond

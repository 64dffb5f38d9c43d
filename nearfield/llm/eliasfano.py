"""Elias-Fano sequences: monotone integers in near-minimal space, read in place."""

from __future__ import annotations

import numpy as np

SAMPLE = 256


class EliasFano:
    """n non-decreasing integers below universe.

    low: the low_bits least bits of each, packed. high: a bit vector in which the
    i-th one, at place p, says that the i-th value's other bits are p - i. samples:
    the place of every SAMPLE-th one, from which select starts.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray, universe: int | None = None) -> EliasFano:
        v = np.asarray(values).astype(np.uint64)
        n = len(v)
        universe = int(universe or (v[-1] + np.uint64(1) if n else 1))
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        place = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        length = n + (universe >> bits) + 1
        flags = np.zeros(-(-length // 64) * 64, np.uint8)
        flags[place] = 1
        high = np.packbits(flags, bitorder="little")
        low = np.zeros(-(-n * bits // 8) + 8, np.uint8)
        if bits:
            step = 1 << 18  # a multiple of 8 values fills whole bytes
            for a in range(0, n, step):
                part = v[a : a + step]
                on = ((part[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
                packed = np.packbits(on.ravel(), bitorder="little")
                low[a * bits // 8 : a * bits // 8 + len(packed)] = packed
        return cls(n, bits, low, high, place[::SAMPLE].astype(np.uint32 if length < 1 << 32 else np.uint64))

    def select(self, i: np.ndarray) -> np.ndarray:
        """Places of the i-th ones."""
        words = self.high.view("<u8")
        at = self.samples[i // SAMPLE].astype(np.int64)
        left = i % SAMPLE
        word = at >> 6
        bits = words[word] & (~np.uint64(0) << (at & 63).astype(np.uint64))
        ones = np.bitwise_count(bits).astype(np.int64)
        open_ = np.flatnonzero(left >= ones)
        while len(open_):
            left[open_] -= ones[open_]
            word[open_] += 1
            bits[open_] = words[word[open_]]
            ones[open_] = np.bitwise_count(bits[open_])
            open_ = open_[left[open_] >= ones[open_]]
        place = word << 6
        for width in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            up = left >= below
            left = np.where(up, left - below, left)
            bits = np.where(up, bits >> np.uint64(width), bits)
            place = np.where(up, place + width, place)
        return place

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.int64)
        upper = self.select(i.copy()) - i
        if not self.low_bits:
            return upper
        bit = i * self.low_bits
        byte = bit >> 3
        lower = np.zeros(len(i), np.uint64)
        for k in range((self.low_bits + 14) // 8):
            lower |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        lower = (lower >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)
        return (upper << self.low_bits) | lower.astype(np.int64)

    def all(self) -> np.ndarray:
        return self.get(np.arange(self.n))

    @property
    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.samples.nbytes

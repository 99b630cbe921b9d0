"""Elias-Fano coded monotone sequences with vectorised access and search.

The low bits of each value are packed side by side; the high bits are a bitmap
in unary.  A directory of ones before each 64-bit word of the bitmap makes
selection one binary search and a few word operations.  All arrays can be views
of memory-mapped files.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Values that are encoded at once.
_STEP = 1 << 16


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) one of each word."""
    at = np.zeros(len(word), np.int64)
    word, k = word.copy(), k.copy()
    for width in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(word & _U((1 << width) - 1)).astype(np.int64)
        beyond = k >= ones
        k -= np.where(beyond, ones, 0)
        step = np.where(beyond, width, 0)
        at += step
        word >>= step.astype(_U)
    return at


class EliasFano:
    """`n` values in non-decreasing order, below `universe`."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones
        self.mask = _U((1 << bits) - 1)

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, _U)
        size = (universe >> bits) + n + 1
        high = np.zeros(size // 64 + 1, _U)
        for at in range(0, n, _STEP):
            some = values[at : at + _STEP].astype(_U)
            if bits:
                part = some & _U((1 << bits) - 1)
                place = np.arange(at, at + len(some), dtype=_U) * _U(bits)
                word, off = (place >> _U(6)).astype(np.int64), place & _U(63)
                np.bitwise_or.at(low, word, part << off)
                over = off + _U(bits) > _U(64)
                np.bitwise_or.at(low, word[over] + 1, part[over] >> (_U(64) - off[over]))
            place = (some >> _U(bits)).astype(np.int64) + np.arange(at, at + len(some))
            np.bitwise_or.at(high, place >> 6, _U(1) << (place & 63).astype(_U))
        ones = np.zeros(len(high) + 1, np.int64)
        np.cumsum(np.bitwise_count(high), out=ones[1:])
        return cls(n, bits, low, high, ones)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], np.int64), self.low, self.high, self.ones]

    @classmethod
    def of(cls, head: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> EliasFano:
        return cls(int(head[0]), int(head[1]), low, high, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), _U)
        place = i.astype(_U) * _U(self.bits)
        word, off = (place >> _U(6)).astype(np.int64), place & _U(63)
        # a shift by 64 is avoided by shifting twice
        return (self.low[word] >> off | (self.low[word + 1] << (_U(63) - off)) << _U(1)) & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the places `i`."""
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _select_in_word(self.high[word], i - self.ones[word])
        return (place - i).astype(_U) << _U(self.bits) | self._low(i)

    def _smaller_high(self, h: np.ndarray) -> np.ndarray:
        """How many values have high bits below `h`: the ones before the h-th zero."""
        out = np.zeros(len(h), np.int64)
        some = np.flatnonzero(h > 0)
        k = h[some] - 1
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones if not hasattr(self, "_zeros") else self._zeros
        self._zeros = zeros
        word = np.searchsorted(zeros, k, "right") - 1
        word = np.minimum(word, len(self.high) - 1)
        out[some] = word * 64 + _select_in_word(~self.high[word], k - zeros[word]) - k
        return out

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each `x` in the sequence, -1 where it isn't there."""
        if not self.n:
            return np.full(len(x), -1, np.int64)
        h = (x >> _U(self.bits)).astype(np.int64)
        most = int(self.get(np.array([self.n - 1]))[0] >> _U(self.bits))
        inside = h <= most
        h = np.where(inside, h, 0)
        lo, hi = self._smaller_high(h), self._smaller_high(h + 1)
        hi = np.where(inside, hi, lo)
        want = x & self.mask
        end = hi.copy()
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            less = self._low(mid) < want[active]
            lo[active] = np.where(less, mid + 1, lo[active])
            hi[active] = np.where(less, hi[active], mid)
            active = active[lo[active] < hi[active]]
        hit = np.flatnonzero(lo < end)
        out = np.full(len(x), -1, np.int64)
        same = self._low(lo[hit]) == want[hit]
        out[hit[same]] = lo[hit[same]]
        return out

"""Elias-Fano sequences in numpy: monotone integers in about 2 + log2(universe / n) bits each.

The low bits of every value are packed side by side; the high bits are a bit string with one
set bit for each value and one clear bit for each step of the high part. ``access`` selects set
bits, ``next_geq`` selects clear bits. All queries are vectorised over arrays.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


_ONES, _HIGHS = _U(0x0101010101010101), _U(0x8080808080808080)
#: Place of the set bit with rank r (column) in a byte (row).
_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[:8] for byte in range(256)], np.uint64).ravel()


def _select_in_word(words: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Place of the set bit with the given rank in each word: the byte by the running sums of
    the bytes' set bits, all in one word, then a table."""
    ranks = ranks.astype(np.uint64)
    sums = words - ((words >> _U(1)) & _U(0x5555555555555555))
    sums = (sums & _U(0x3333333333333333)) + ((sums >> _U(2)) & _U(0x3333333333333333))
    sums = ((sums + (sums >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES
    before = (ranks * _ONES | _HIGHS) - sums & _HIGHS  # bytes whose sum is not over the rank
    place = np.bitwise_count(before).astype(np.uint64) << _U(3)
    inside = ranks - ((sums << _U(8)) >> place & _U(255))
    return (place + _IN_BYTE[((words >> place & _U(255)) << _U(3)) + inside]).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence of integers from 0 to 2**63 - 1."""

    def __init__(self, n: int, low_bits: int, high_size: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.high_size, self.low, self.high = n, low_bits, high_size, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate(([0], np.cumsum(ones)))  # set bits before each word
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.ascontiguousarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        high_size = n + (top >> bits) + 1
        high = np.zeros((high_size + 63) // 64, np.uint64)
        if n:
            at = (values >> _U(bits)).astype(np.int64) + np.arange(n)
            word = at >> 6
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            high[word[first]] = np.bitwise_or.reduceat(_U(1) << (at & 63).astype(np.uint64), first)
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits and n:
            rest = values & _U((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            word, off = at >> 6, (at & 63).astype(np.uint64)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low[word[first]] = np.bitwise_or.reduceat(rest << off, first)
            over = (at & 63) + bits > 64
            low[word[over] + 1] |= rest[over] >> (_U(64) - off[over])
        return cls(n, bits, high_size, low, high)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, self.high_size, len(self.low), len(self.high)], "<i8")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_buffer(cls, buffer, offset: int = 0) -> tuple[EliasFano, int]:
        """The sequence stored at ``offset``, without copying its bits, and the offset after it."""
        n, bits, size, n_low, n_high = np.frombuffer(buffer, "<i8", 5, offset).tolist()
        low = np.frombuffer(buffer, "<u8", n_low, offset + 40)
        high = np.frombuffer(buffer, "<u8", n_high, offset + 40 + 8 * n_low)
        return cls(n, bits, size, low, high), offset + 40 + 8 * (n_low + n_high)

    def _select(self, ranks: np.ndarray, ones: bool) -> np.ndarray:
        counts = self.ones if ones else self.zeros
        word = np.searchsorted(counts, ranks, "right") - 1
        bits = self.high[word]
        return word * 64 + _select_in_word(bits if ones else ~bits, ranks - counts[word])

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), np.uint64)
        at = index * self.low_bits
        word, off = at >> 6, (at & 63).astype(np.uint64)
        out = self.low[word] >> off
        over = (at & 63) + self.low_bits > 64
        out[over] |= self.low[word[over] + 1] << (_U(64) - off[over])
        return out & _U((1 << self.low_bits) - 1)

    def access(self, index: np.ndarray) -> np.ndarray:
        """The values at the given places."""
        index = np.asarray(index, np.int64)
        if not len(index):
            return np.zeros(0, np.uint64)
        high = (self._select(index, True) - index).astype(np.uint64)
        return (high << _U(self.low_bits)) | self._low(index)

    def next_geq(self, values: np.ndarray) -> np.ndarray:
        """Place of the first value not below each query; ``n`` if there is none."""
        values = np.asarray(values, np.uint64)
        out = np.full(len(values), self.n, np.int64)
        if not self.n:
            return out
        high = (values >> _U(self.low_bits)).astype(np.int64)
        steps = self.high_size - self.n  # clear bits
        ask = np.flatnonzero(high < steps)
        high, rest = high[ask], values[ask] & _U((1 << self.low_bits) - 1)
        # the values with this high part lie between clear bits number high - 1 and high
        begin = np.zeros(len(ask), np.int64)
        later = high > 0
        begin[later] = self._select(high[later] - 1, False) - (high[later] - 1)
        end = self._select(high, False) - high
        while len(live := np.flatnonzero(begin < end)):
            middle = (begin[live] + end[live]) >> 1
            less = self._low(middle) < rest[live]
            begin[live[less]] = middle[less] + 1
            end[live[~less]] = middle[~less]
        out[ask] = begin
        return out

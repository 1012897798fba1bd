"""Elias-Fano coded monotone sequences over flat buffers that can be memory-mapped."""

from __future__ import annotations

import numpy as np

_STEP = 1 << 16


def _pad(n: int) -> int:
    return -(-n // 8) * 8


def pack(values: np.ndarray, universe: int) -> bytes:
    """Code a non-decreasing uint64 sequence below ``universe``: the low bits of each value side
    by side, the high bits in unary. About ``2 + log2(universe / n)`` bits a value."""
    n = len(values)
    low = max(0, min(50, int(universe // max(1, n)).bit_length() - 1))
    lows = values & np.uint64((1 << low) - 1)
    parts = []
    if low:
        shifts = np.arange(low, dtype=np.uint64)
        for i in range(0, n, _STEP):  # _STEP * low is a whole number of bytes
            bits = (lows[i : i + _STEP, None] >> shifts) & np.uint64(1)
            parts.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
    low_bytes = b"".join(parts) + bytes(8)
    high = (values >> np.uint64(low)).astype(np.int64)
    unary = np.zeros(n + (int(high[-1]) if n else 0) + 1, np.uint8)
    unary[high + np.arange(n)] = 1
    high_bytes = np.packbits(unary, bitorder="little").tobytes()
    head = np.array([n, low, len(low_bytes), len(high_bytes)], np.int64).tobytes()
    return head + low_bytes.ljust(_pad(len(low_bytes)), b"\0") + high_bytes.ljust(_pad(len(high_bytes)), b"\0")


class Sequence:
    """A view of a packed sequence; only the high parts are decoded."""

    def __init__(self, buffer: np.ndarray, at: int = 0):
        n, self.low, n_low, n_high = (int(x) for x in buffer[at : at + 32].view(np.int64))
        self.n, start = n, at + 32
        self.lows = buffer[start : start + n_low]
        high = buffer[start + _pad(n_low) : start + _pad(n_low) + n_high]
        ones = np.flatnonzero(np.unpackbits(high, bitorder="little"))
        self.high = ones - np.arange(n)
        self.end = start + _pad(n_low) + _pad(n_high)

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low
        byte = bit >> 3
        word = np.zeros(len(i), np.uint64)
        for k in range(8):
            word |= self.lows[byte + k].astype(np.uint64) << np.uint64(8 * k)
        return (word >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        return (self.high[i].astype(np.uint64) << np.uint64(self.low)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value >= x (n if there is none): the high part leads to a short
        stretch, the low bits decide in it by halving."""
        top = (x >> np.uint64(self.low)).astype(np.int64)
        low = x & np.uint64((1 << self.low) - 1)
        left = np.searchsorted(self.high, top, "left")
        right = np.searchsorted(self.high, top, "right")
        while True:
            open_ = np.flatnonzero(left < right)
            if not len(open_):
                return left
            middle = (left[open_] + right[open_]) >> 1
            less = self._low(middle) < low[open_]
            left[open_[less]] = middle[less] + 1
            right[open_[~less]] = middle[~less]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of a value equal to x, else -1."""
        if not self.n:
            return np.full(len(x), -1)
        at = self.successor(x)
        inside = np.minimum(at, self.n - 1)
        return np.where((at < self.n) & (self.access(inside) == x), at, -1)

"""Vectorised word splitting and hashing over Arrow text buffers.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z
lower-cased. Each word gets a 64-bit hash: a polynomial over the ring modulo
2**64 with random byte values, so that all words of a block come from one
prefix sum, then a mixing step. Two of ten million different words share a
hash with a probability of a few in a million.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
# bytes that are no ASCII letter or digit and no part of a longer UTF-8 character
_MARKS = np.array([not (b >= 0x80 or chr(b).isalnum()) for b in range(256)])
_BLOCK = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_BLOCK, n) + 1
    have = _POWERS.get(0)
    if have is None or len(have[0]) < size:
        up = np.full(size, _R, np.uint64)
        down = np.full(size, _RINV, np.uint64)
        up[0] = down[0] = 1
        have = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        if size <= _BLOCK + 1:
            _POWERS[0] = have
    return have


def word_spans(data: np.ndarray, offsets: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the row that holds each; with ``marks``
    every byte that is no letter or digit separates words, not only white space."""
    if len(data) == 0:
        e = np.empty(0, np.int64)
        return e, e, e
    ws = (_MARKS if marks else WHITE)[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    word = ~ws
    begins = word.copy()
    begins[1:] &= ws[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= ws[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(ends) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, stops, rows


def hash_spans(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans (in order, not overlapping)."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(int(np.searchsorted(stops, base + _BLOCK, "right")), i + 1)
        span = data[base : stops[j - 1]]
        up, down = _powers(len(span))
        sums = np.zeros(len(span) + 1, np.uint64)
        np.cumsum(_BYTE[span] * up[: len(span)], out=sums[1:])
        s, e = starts[i:j] - base, stops[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the row that holds it."""
    starts, stops, rows = word_spans(data, offsets, marks)
    return hash_spans(data, starts, stops), rows


def hash_word(word: str) -> int:
    """The hash that ``word_hashes`` gives to one word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(hash_spans(data, np.array([0]), np.array([len(data)]))[0])

"""Leading eigenpairs of a symmetric matrix by contour integration.

The spectrum above the k-th largest eigenvalue is cut into intervals by inertia counts
(signs of a pivoted L D L^T factorisation of the shifted matrix). For each interval a
quadrature over a circle through its ends sums solves with the complex shifted matrix,
which filters a random block of vectors onto the eigenvectors inside; Rayleigh-Ritz in the
filtered subspace gives eigenpairs, which are filtered again until their residuals are at
rounding level. The inertia counts say how many there must be: an interval that gives
another number is repeated with a larger subspace. A last Rayleigh-Ritz step over all
intervals makes vectors of neighbouring intervals orthogonal.

Everything here has the size of one matrix (dimensions squared), whatever the table's rows.
"""

from __future__ import annotations

import numpy as np

NODES = 16  # quadrature nodes on the half circle
PER_INTERVAL = 4  # eigenvalues aimed at in one interval
MAX_ROUNDS = 60
_ALPHA = (1 + 17**0.5) / 8  # pivot threshold of the symmetric factorisation


def inertia(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of symmetric ``a`` above ``shift``: positive pivots of L D L^T with 1x1 and 2x2 pivots."""
    m = a - shift * np.eye(len(a))
    positive, k, n = 0, 0, len(a)
    while k < n:
        rest = m[k:, k:]
        size = n - k
        diagonal = np.abs(np.diagonal(rest))
        d = int(diagonal.argmax())
        off = np.abs(np.tril(rest, -1))
        i, j = np.unravel_index(int(off.argmax()), off.shape)
        if diagonal[d] >= _ALPHA * off[i, j]:
            if diagonal[d] == 0:
                break  # the rest is zero: eigenvalues at the shift
            swap = [d]
        else:
            swap = sorted((int(i), int(j)))
        for place, other in enumerate(swap):
            if other != place:
                rest[[place, other]] = rest[[other, place]]
                rest[:, [place, other]] = rest[:, [other, place]]
        width = len(swap)
        pivot, side = rest[:width, :width].copy(), rest[width:, :width].copy()
        positive += int(pivot[0, 0] > 0) if width == 1 else 1  # a 2x2 pivot has one eigenvalue of each sign
        if size > width:
            rest[width:, width:] -= side @ np.linalg.solve(pivot, side.T)
        k += width
    return positive


def intervals(a: np.ndarray, k: int, upper: float, finest: float) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) from the top down, together at least the ``k`` largest; an
    interval holds more than PER_INTERVAL only if they lie within ``finest``."""

    def split(low: float, high: float, above_low: int, above_high: int) -> None:
        if above_high >= k or above_low == above_high:
            return
        if above_low - above_high <= PER_INTERVAL and above_low <= k or high - low <= finest:
            out.append((low, high, above_low - above_high))
            return
        middle = (low + high) / 2
        above = inertia(a, middle)
        split(middle, high, above, above_high)
        split(low, middle, above_low, above)

    out: list[tuple[float, float, int]] = []
    split(-finest, upper, inertia(a, -finest), 0)
    return out


def _filtered(a: np.ndarray, block: np.ndarray, low: float, high: float) -> np.ndarray:
    """``block`` through the quadrature of the resolvent over the circle through ``low`` and ``high``."""
    x, weight = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(-0.5j * np.pi * (x - 1))
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(block)
    for w, t in zip(weight, turn):  # the lower half circle gives the conjugate
        shifted = (centre + radius * t) * np.eye(len(a)) - a
        out += 0.5 * w * (radius * t * np.linalg.solve(shifted, block)).real
    return out


def _ritz(a: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values and vectors (ascending) of the space that ``block`` spans."""
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > s[0] * 1e-14] if len(s) and s[0] > 0 else u
    u = np.linalg.qr(u)[0]
    values, small = np.linalg.eigh(u.T @ a @ u)
    return values, u @ small


def interval_pairs(a: np.ndarray, low: float, high: float, count: int, tolerance: float, rng: np.random.Generator) -> np.ndarray:
    """The ``count`` eigenvectors of ``a`` with eigenvalues in [low, high]."""
    size = min(len(a), 2 * count + 4)
    while True:
        block, best, last = rng.standard_normal((len(a), size)), None, np.inf
        for _ in range(MAX_ROUNDS):
            values, block = _ritz(a, _filtered(a, block, low, high))
            inside = np.flatnonzero((values >= low) & (values <= high))
            if len(inside) != count:
                continue
            residual = np.linalg.norm(a @ block[:, inside] - block[:, inside] * values[inside], axis=0).max()
            if residual < last:
                best = block[:, inside]
            if last <= tolerance and residual > last / 2:  # at rounding level
                return best
            last = min(last, residual)
        if size == len(a):
            # the block spans everything, so Ritz pairs are eigenpairs to rounding; eigenvalues at an end of the
            # interval may fall to either side: take those nearest to it
            off = np.maximum(np.maximum(low - values, values - high), 0)
            return block[:, np.argsort(off, kind="stable")[:count]]
        size = min(len(a), 2 * size)


def largest(a: np.ndarray, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of symmetric positive semidefinite ``a`` (descending) and unit eigenvectors (columns)."""
    n = len(a)
    k = min(k, n)
    scale = float(np.trace(a))
    if k == 0 or not scale > 0:
        return np.zeros(0), np.zeros((n, 0))
    a = (a + a.T) / (2 * scale)  # eigenvalues add up to 1
    rng = np.random.default_rng(seed)
    eps = np.finfo(float).eps
    cut = intervals(a, k, 1 + 1e-6, 1e-7)
    found = [interval_pairs(a, low, high, count, 20 * n * eps, rng) for low, high, count in cut]
    values, vectors = _ritz(a, np.concatenate(found, axis=1))
    values, vectors = values[::-1], vectors[:, ::-1]
    expected = sum(count for *_, count in cut)
    if len(values) < expected:
        raise ArithmeticError(f"{len(values)} of {expected} eigenvectors are independent")
    return values[:k] * scale, vectors[:, :k]

"""Contour-integration eigenpairs against LAPACK's, whitening against whole numbers in Python."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import feast, registry, whitening

RNG = np.random.default_rng(5)


def with_spectrum(values):
    q = np.linalg.qr(RNG.standard_normal((len(values), len(values))))[0]
    return (q * np.array(values, float)) @ q.T


SPECTRA = {
    "even": np.linspace(1, 2, 64),
    "falling": 10.0 ** -np.arange(0, 12, 0.25),
    "one large": np.r_[1e6, np.linspace(1, 3, 40)],
    "ties": np.r_[[5.0] * 6, [4.0] * 6, np.linspace(0, 1, 20)],
    "tie over the end": np.r_[[5.0] * 4, [3.0] * 9, np.zeros(10)],
    "low rank": np.r_[np.arange(1.0, 4), np.zeros(30)],
    "few": np.array([3.0, 1.0]),
    "one": np.array([2.0]),
    "near": 1 + np.arange(30) * 1e-9,
}


@pytest.mark.parametrize("name", SPECTRA)
def test_largest_pairs(name):
    a = with_spectrum(SPECTRA[name])
    want = np.sort(SPECTRA[name])[::-1][:8]
    values, vectors = feast.largest(a, 8)
    assert len(values) == len(want) and np.abs(values - want).max() <= 1e-13 * np.trace(a) + 1e-15
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-12
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() <= 1e-13 * max(np.trace(a), 1)


def test_single_vectors_agree_with_lapack():
    a = np.cov(RNG.standard_normal((400, 48)), rowvar=False)
    values, vectors = feast.largest(a, 8)
    exact, basis = np.linalg.eigh(a)
    np.testing.assert_allclose(values, exact[::-1][:8], rtol=1e-13)
    np.testing.assert_allclose(np.abs((vectors * basis[:, ::-1][:, :8]).sum(0)), 1, rtol=1e-12)


def test_inertia_counts_and_intervals():
    for _ in range(40):
        n = int(RNG.integers(1, 12))
        a = RNG.integers(-3, 4, (n, n)).astype(float)
        a = np.triu(a) + np.triu(a, 1).T
        if RNG.random() < 0.3:
            np.fill_diagonal(a, 0)  # needs pairs as pivots
        shift = float(RNG.uniform(-4, 4)) + 1e-3
        assert feast.inertia(a, shift) == int((np.linalg.eigvalsh(a) > shift).sum())
    values = np.linspace(0.001, 0.03, 64)
    cut = feast.intervals(with_spectrum(values), 8, 1.0, 1e-7)
    assert sum(c for *_, c in cut) >= 8 and all(c <= feast.PER_INTERVAL for *_, c in cut)
    for low, high, count in cut:
        assert count == int(((values > low) & (values <= high)).sum())
    assert [feast.largest(np.zeros((3, 3)), 2)[0].size, feast.largest(np.zeros((0, 0)), 2)[0].size] == [0, 0]


def brute(rows, k=8):
    """{(id, component): (n, deviation, |whitened|, explained)} by whole numbers and LAPACK."""
    fit = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n = len(fit)
    sums = [sum(x[j] for _, x in fit) for j in range(len(fit[0][1]))]
    centred = np.array([[float(Fraction(a) - Fraction(s, n)) for a, s in zip(x, sums)] for _, x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = []
    for (i, x), d in zip(fit, centred):
        for c in range(min(k, len(sums))):
            e = values[-1 - c]
            out.append((i, c + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), abs(d @ vectors[:, -1 - c]) / e**0.5, e / values.sum()))
    return out


def test_query_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(9)
    mix = rng.standard_normal((12, 12)) / 4
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(12) @ mix + 1]) for i in range(500)]
    rows += [(7, rows[7][1]), (None, rows[8][1])] * 2
    bad = [(600, None), (601, []), (602, [None] + [0.0] * 11), (603, [float("nan")] + [0.0] * 11), (604, [float("-inf")] + [0.0] * 11), (605, [1.0] * 5)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(6)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["op11_feast_whitening"](spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    got, want = sorted(map(tuple, got.collect()), key=order), sorted(brute(rows), key=order)
    assert [r[:4] for r in got] == [r[:4] for r in want] and len(got) == 8 * 504
    np.testing.assert_allclose([abs(r[4]) for r in got], [r[4] for r in want], rtol=1e-8, atol=1e-9)
    np.testing.assert_allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-12)
    errors = {r[6] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-10
    signs = {}  # one sign a component for all rows: the covariance with the first component's rows is that of whitened rows
    for r in got:
        signs.setdefault(r[1], []).append(r[4])
    w = np.array([signs[c] for c in range(1, 9)])
    assert np.abs(w @ w.T / w.shape[1] - np.eye(8)).max() < 1e-9


@pytest.mark.parametrize(
    ("rows", "components"),
    [([], 0), ([(1, None)], 0), ([(1, [0.5, 1.0])], 0), ([(1, [0.5, 1.0])] * 3, 0), ([(1, [0.5, 1.0]), (2, [0.25, 1.0])], 1),
     ([(1, [0.0, 1.0]), (2, [0.25, 2.0]), (3, [5.0, 0.0])], 2)],
)
def test_degenerate_tables(spark, rows, components):
    df = spark.createDataFrame([(*r, "x") for r in rows], "VEC_ID long, embedding array<double>, whitened string")
    got = whitening.whiten(df, id_col="VEC_ID").collect()
    assert len(got) == components * len(rows) and all(r["identity_error"] < 1e-9 for r in got)


def test_deviation_of_large_tables_is_exact_or_null():
    x = np.array([[100_000, 101_000], [99_000, 100_500]])
    n, sums = 10**7, (10**12 + 123, 10**12 - 77)
    want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x, n, sums) == [w if w < 2**63 else None for w in want] and None in whitening.deviations(x, n, sums)
    assert whitening.deviations(x, 2, (199_000, 201_500)) == [1000**2 + 500**2] * 2

"""Whitening against numpy's eigenvectors, exact polynomials and edge cases."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from dealgrid.llm import whitening as w
from dealgrid.llm.whitening import op13_whitening

SF = "/root/testdata/sf0.001"


def faddeev(matrix):
    """Coefficients of det(x - matrix) in fractions, from the constant up."""
    d = len(matrix)
    a = [[Fraction(int(v)) for v in row] for row in matrix]
    m = [[Fraction(0)] * d for _ in range(d)]
    c = [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][x] * m[x][j] for x in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        am = sum(a[i][x] * m[x][i] for i in range(d) for x in range(d))
        c.append(-am / k)
    return [int(x) for x in reversed(c)]


def gram(d, rank, size, seed):
    x = np.random.default_rng(seed).integers(-size, size, (d, rank))
    return (x.astype(object) @ x.T.astype(object)).reshape(d, d)


@pytest.mark.parametrize(("d", "rank", "size"), [(1, 1, 9), (2, 2, 5), (6, 6, 10**6), (7, 3, 50), (12, 12, 300)])
def test_characteristic_polynomial_is_exact(spark, d, rank, size):
    matrix = gram(d, rank, size, d)
    assert w.characteristic_polynomial(spark, matrix) == faddeev(matrix)


def test_polynomial_modulo_small_primes_with_pivoting():
    matrix = np.array([[0, 0, 3, 1], [0, 2, 0, 0], [3, 0, 0, 0], [1, 0, 0, 5]], object)
    for p in (2_147_483_647, 2_147_483_629, 101):
        assert w.polynomial_mod(matrix, p).tolist() == [c % p for c in faddeev(matrix)]


def test_roots_with_multiplicity_and_zeros(spark):
    matrix = np.diag([7, 7, 7, 3, 0, 0]).astype(object)
    p = w.characteristic_polynomial(spark, matrix)
    roots = w.largest_roots(p, 4)
    assert [(round(float(r.value()), 12), r.times) for r in roots] == [(7, 3), (3, 1)]
    assert w.largest_roots([0, 0, 1], 4) == []
    near = np.diag([10**9 + 1, 10**9, 1]).astype(object)
    roots = w.largest_roots(w.characteristic_polynomial(spark, near), 4)
    assert [round(float(r.value())) for r in roots] == [10**9 + 1, 10**9, 1]


def test_components_of_an_equal_root_are_orthonormal():
    basis, _ = np.linalg.qr(np.random.default_rng(2).normal(size=(5, 5)))
    matrix = np.diag([9, 9, 9, 4, 1]).astype(object)
    from decimal import Decimal

    found = np.array([[float(c) for c in v] for v in w.null_space(matrix, Decimal(9), 3)])
    assert np.allclose(found @ found.T, np.eye(3), atol=1e-14) and np.allclose(found[:, 3:], 0, atol=1e-14)


def test_query_equals_numpy(spark):
    got = op13_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(256 * np.array(e.embedding.tolist(), float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    z = (x - s / n) @ vectors[:, :4] / np.sqrt(values[:4])
    assert len(got) == 4 * len(x) and set(got.n) == {n}
    found = got.whitened.to_numpy().reshape(-1, 4)
    found = found * np.sign((found * z).sum(axis=0))
    assert np.abs(found - z).max() < 1e-10
    assert got.deviation.to_numpy().reshape(-1, 4)[:, 0].tolist() == ((n * x - s) ** 2).sum(1).tolist()
    assert np.allclose(got.explained.to_numpy()[:4], values[:4] / values.sum(), rtol=1e-12)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-12


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, -0.001], 7), (2, None, 7), (3, [1.0, None], 7), (4, [nan, 0.0], 7), (5, [-inf, 0.0], 7),
        (None, [0.25], 7), (6, [-0.0, 0.0], 7), (6, [-0.0, 0.0], 7),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int")
    out = w.whiten(table).collect()
    # integer vectors (128, -1), (64, 0), (0, 0) twice; n = 3, S = (192, -1)
    assert sorted({(r.vec_id or 0, r.deviation) for r in out}) == [(0, 1), (1, 192**2 + 4), (6, 192**2 + 1)]
    assert {r.n for r in out} == {3} and sorted(r.vec_id or 0 for r in out) == [0, 0, 1, 1, 6, 6, 6, 6]
    assert sum(r.explained for r in out if r.vec_id == 1) == pytest.approx(1)
    assert max(r.identity_error for r in out) < 1e-9
    assert w.whiten(table.limit(0)).count() == 0
    assert w.whiten(table.filter("vec_id = 6")).count() == 0  # no spread
    empty = spark.createDataFrame([(1, [])], "vec_id long, embedding array<float>")
    assert w.whiten(empty).count() == 0


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(1 << 40) * i, 1e30 if i == 3 else 0.0]) for i in range(5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {(r.vec_id, r.component): r for r in w.whiten(table).collect()}
    assert len(out) == 10 and all(r.deviation is None for r in out.values())  # beyond a long
    assert out[0, 1].explained + out[0, 2].explained == pytest.approx(1)
    x = np.array([[(1 << 48) * i, (1 << 63) - 1 if i == 3 else 0] for i in range(5)], object)
    n, s, matrix = w.scatter(w.integer_vectors(table).select("x"))
    assert (n, s) == (5, x.sum(axis=0).tolist())
    assert (matrix == 5 * (x.T @ x) - np.outer(x.sum(axis=0), x.sum(axis=0))).all()

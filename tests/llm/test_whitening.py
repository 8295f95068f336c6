"""Whitening against a dense eigenvalue decomposition and exact integer sums."""
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import types as T

from maskfold.llm.whitening import EPS, deviations, integer_vectors, jacobi_davidson, minres, whitening

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("id", T.StringType()), T.StructField("x", T.LongType()), T.StructField("component", T.StringType())])


@pytest.fixture(scope="module")
def make(spark):
    from maskfold.session import ship_package
    ship_package(spark)
    return lambda rows: spark.createDataFrame([(i, v, "a", 1, "b") for i, v in rows], SCHEMA).repartition(3)


class Dense:
    def __init__(self, m):
        self.m = m

    def __matmul__(self, columns):
        return self.m @ columns


@pytest.mark.parametrize("values", [
    np.linspace(3, 1, 5), np.linspace(3, 2.9, 64), np.geomspace(1e6, 1e-6, 90), [5.0] * 6 + [1.0] * 58, [5.0, 2.0] + [0.0] * 62,
    [1.0] * 30, np.repeat(np.linspace(3, 1, 40), 4), [2.0]])
def test_pairs_are_eigenpairs(values):
    d = len(values)
    turn = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]
    m = turn * np.asarray(values) @ turn.T
    m = (m + m.T) / 2
    found, vectors, residuals = jacobi_davidson(Dense(m), d, 8, float(np.sum(values)))
    top = max(values)
    assert np.allclose(found, sorted(values, reverse=True)[:8], rtol=0, atol=40 * d * EPS * top)
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-13
    assert np.linalg.norm(m @ vectors - vectors * found, axis=0).max() < 20 * d * EPS * top and (residuals <= 20 * d * EPS * top).all()


def test_minres_solves_indefinite_systems():
    draw = np.random.default_rng(3)
    ms = [m + m.T for m in draw.standard_normal((3, 20, 20))]
    b = draw.standard_normal((20, 3))
    b[:, 2] = 0
    x = minres(lambda c, which: np.stack([ms[w] @ c[:, i] for i, w in enumerate(which)], 1), b, 60, 1e-12)
    for j in range(2):
        assert np.linalg.norm(ms[j] @ x[:, j] - b[:, j]) < 1e-8
    assert not x[:, 2].any()


def rows(n, d, seed=1):
    draw = np.random.default_rng(seed)
    v = (draw.standard_normal((n, d)) * np.linspace(1, 0.2, d)).astype(np.float32) / 4
    return [(i, r.tolist()) for i, r in enumerate(v)]


ODD = [(900, None), (901, []), (902, [float("nan")] + [0.1] * 11), (903, [float("inf")] + [0.1] * 11), (904, [0.1] * 3),
       (905, [None] + [0.1] * 11), (None, [0.25] * 12), (7, [0.5] * 12), (7, [0.5] * 12), (906, [0.0] * 12), (907, [3e38] * 12)]


def test_whitening(make):
    given = rows(500, 12) + ODD
    kept = [(i, v) for i, v in given if v and len(v) == 12 and all(c is not None and isfinite(c) and abs(c) < 1e30 for c in v)]
    x = np.array([[floor(1024 * float(c)) + 100_000 for c in v] for _, v in kept])
    n, sums = len(x), x.sum(0)
    dev = (x - sums / n)
    cov = dev.T @ dev / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    got = whitening(make(given)).toPandas()
    assert len(got) == 8 * n and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    exact = [int(sum((Fraction(int(n)) * int(a) - int(s)) ** 2 for a, s in zip(r, sums))) for r in x]
    for k in range(8):
        own = got[got.component == k + 1]
        assert np.allclose(own.explained, values[k] / np.trace(cov), rtol=1e-10)
        want = dev @ vectors[:, k] / np.sqrt(values[k])
        sign = np.sign(np.dot(own[own.id < 500].sort_values("id").drop_duplicates("id").whitened, want[:500])) or 1
        want = sorted((-1 if i is None else i, e, round(sign * w, 7)) for (i, _), e, w in zip(kept, exact, want))
        have = sorted((-1 if np.isnan(i) else int(i), int(e), round(w, 7)) for i, e, w in zip(own.id, own.deviation_exact, own.whitened))
        assert [w[:2] for w in want] == [h[:2] for h in have]
        assert np.allclose([w[2] for w in want], [h[2] for h in have], atol=1e-6)


def test_tables_without_enough_variance(make):
    assert whitening(make([])).count() == 0
    assert whitening(make([(1, None)])).count() == 0
    assert whitening(make([(1, [0.5, 0.25])])).count() == 0  # one row has no variance
    assert whitening(make([(i, [0.5, 0.25]) for i in range(9)])).count() == 0
    got = whitening(make([(i, [i / 8, 0.25, -i / 8]) for i in range(9)])).toPandas()  # rank 1
    assert set(got.component) == {1} and len(got) == 9 and np.allclose(got.explained, 1) and got.identity_error[0] < 1e-12


def test_integers_are_exact_beyond_a_long():
    m = np.array([[2**50, -(2**50)], [2**40, 3]])
    n, sums = 10**9, [int(m[:, 0].sum()) * 5 * 10**8, int(m[:, 1].sum()) * 5 * 10**8]
    got = deviations(m, n, sums)
    assert got.tolist() == [[n * int(a) - s for a, s in zip(r, sums)] for r in m]


def test_integer_vectors_round_down(make):
    got = integer_vectors(make([(1, [-0.0001, 0.5]), (2, [1.0, -1.0])])).orderBy("id").collect()
    assert [list(r.x) for r in got] == [[99_999, 100_512], [101_024, 98_976]]

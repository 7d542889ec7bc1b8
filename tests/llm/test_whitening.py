import math
import random
from fractions import Fraction

import numpy as np
import pytest

from panelweave.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, d, seed=1, spread=1.0):
    rng = random.Random(seed)
    return [[rng.gauss(0, spread * (k + 1)) + 3 * rng.random() for k in range(d)] for _ in range(n)]


def whole(v):
    return tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)


def covariance(fit):
    n, d = len(fit), len(fit[0])
    mean = [Fraction(sum(x[j] for x in fit), n) for j in range(d)]
    return [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n for j in range(d)] for i in range(d)], mean


@pytest.fixture(scope="module")
def table(spark):
    good = vectors(150, 6)
    rows = [(i, v, 0) for i, v in enumerate(good)] + [(i, good[0], 1) for i in range(200, 260)]
    rows += [(300, None, 0), (301, [1.0, None, 2.0, 3.0, 4.0, 5.0], 0), (302, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], 0), (303, [float("inf")] + [0.0] * 5, 0), (None, good[3], None), (5, good[5], 0), (400, [1.0, 2.0], 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 AS n", "2 AS component", "3 AS x", "4 AS i")


def test_against_exact_fractions(table):
    source = {(r.vec_id, tuple(r.embedding or ())) for r in table.collect()}
    fit = sorted({whole(v) for _, v in source if len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)})
    cov, mean = covariance(fit)
    n, sums = len(fit), [sum(x[j] for x in fit) for j in range(6)]
    got = whitening.report(table).collect()
    assert len(got) == 6 * (150 + 60 + 2 + 1)
    v = np.array([[float(c) for c in row] for row in cov])
    values = np.linalg.eigvalsh(v)[::-1]
    by_id = {i: whole(v) for i, v in source if i is not None and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)}
    white = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-12
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-12)
        if r.vec_id == 400:
            assert r.whitened is None and r.deviation is None
        elif r.vec_id is not None:
            x = by_id[r.vec_id]
            assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            white[x, r.component] = r.whitened
    # each component's direction, from whitened = d . u / sqrt(e), satisfies V u = e u
    d = np.array([[float(a - m) for a, m in zip(x, mean, strict=True)] for x in fit])
    for k in range(1, 7):
        u = np.linalg.lstsq(d, np.array([white[x, k] for x in fit]), rcond=None)[0] * math.sqrt(values[k - 1])
        assert np.linalg.norm(u) == pytest.approx(1, abs=1e-10)
        assert np.abs(v @ u - values[k - 1] * u).max() < 1e-10 * values[0]


def test_cancellation(spark):
    """A common offset of 2^40 leaves plain second moments without a correct digit."""
    rng = random.Random(4)
    rows = [(i, [2.0**34 + rng.randint(0, 3) / 64, rng.random(), 5.0 * rng.random()]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fit = sorted({tuple(math.floor(64 * c) + 1_000_000 for c in v) for _, v in rows})
    cov, _ = covariance(fit)
    values = np.linalg.eigvalsh(np.array([[float(c) for c in row] for row in cov]))[::-1]
    got = whitening.report(df).where("vec_id = 0").orderBy("component").collect()
    assert [r.explained for r in got] == pytest.approx(values / values.sum(), rel=1e-12)
    assert got[0].identity_error < 1e-12


@pytest.mark.parametrize("d", [3, 20])
def test_components_to_double_precision(d):
    """Close and spread eigenvalues: vectors satisfy the equation to the last digits and are orthonormal."""
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = (q * np.geomspace(1, 1e-9, d)) @ q.T
    v = (v + v.T) / 2
    values, x = whitening.components((v, np.zeros_like(v)))
    exact = [[Fraction(c) for c in row] for row in v.tolist()]
    for k in range(d):
        u = [Fraction(c) for c in x[:, k].tolist()]
        residual = [float(sum(a * b for a, b in zip(row, u, strict=True)) - Fraction(float(values[k])) * c) for row, c in zip(exact, u, strict=True)]
        assert max(map(abs, residual)) < 4e-16
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-15


def test_products_are_exact():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((3000, 4)) * np.array([1.0, 1e8, 1e-7, 1.0])
    high, low = whitening.dot((a, np.zeros_like(a)), (a, np.zeros_like(a)))
    for i in range(4):
        for j in range(4):
            want = sum(Fraction(x) * Fraction(y) for x, y in zip(a[:, i].tolist(), a[:, j].tolist(), strict=True))
            size = sum(abs(Fraction(x) * Fraction(y)) for x, y in zip(a[:, i].tolist(), a[:, j].tolist(), strict=True))
            assert abs(Fraction(float(high[i, j])) + Fraction(float(low[i, j])) - want) < size / 2**90


def test_degenerate_tables(spark):
    assert whitening.report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.report(spark.createDataFrame([(1, [], 0), (2, None, 0)], SCHEMA)).collect() == []
    one = whitening.report(spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0)], SCHEMA)).collect()
    assert len(one) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in one)
    flat = whitening.report(spark.createDataFrame([(i, [float(i % 7), 2.0 * (i % 7), 1.0], 0) for i in range(50)], SCHEMA)).collect()
    assert {r.component for r in flat if r.whitened is not None} == {1}
    huge = whitening.report(spark.createDataFrame([(1, [3e38, 0.0], 0), (2, [-3e38, 1.0], 0), (3, [0.0, 5.0], 0)], SCHEMA)).collect()
    assert len(huge) == 6 and all(r.deviation is None for r in huge if r.vec_id < 3)

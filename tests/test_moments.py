"""Fits from merged moments against fits that see their whole training set."""

import numpy as np
import pytest

from panelweave.operators import models as M
from panelweave.operators import moments as MO


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 4)) * [1, 5, 0.1, 2] + [0, 100, 1e6, -3]
    y = 20 + x[:, 0] - 0.2 * x[:, 1] + 3 * (x[:, 2] - 1e6) + rng.standard_t(2, 300)
    fold = rng.integers(1, 5, 300)
    df = spark.createDataFrame([(int(f), v.tolist(), float(t)) for f, v, t in zip(fold, x, y, strict=True)], "fold int, x array<double>, y double").repartition(5).selectExpr("7 AS spec", "*")
    return x, y, fold, df


def same(got, want, tol):
    assert got.mean == pytest.approx(want.mean, rel=1e-9) and got.scale == pytest.approx(want.scale, rel=1e-7)
    assert got.coef == pytest.approx(want.coef, abs=tol) and got.intercept == pytest.approx(want.intercept, abs=tol)
    assert got.sigma == pytest.approx(want.sigma, rel=1e-5)


def test_ridge(data):
    x, y, fold, df = data
    got = MO.fold_fits(df, [1, 2, 3, 4, 9], "ridge", 2.0)
    assert set(got) == {(7, k) for k in (1, 2, 3, 4, 9)} and got[7, 9].n == 300
    for (_, k), f in got.items():
        same(f.model, M.fit("ridge", x[fold != k], y[fold != k], alpha=2.0), 1e-7)


def test_huber(data):
    x, y, fold, df = data
    for (_, k), f in MO.fold_fits(df, [1, 2, 3, 4], "huber", 1e-3).items():
        same(f.model, M.fit("huber", x[fold != k], y[fold != k], alpha=1e-3), 1e-5)


def test_principal_components(data):
    x, y, fold, df = data
    for (_, k), f in MO.fold_fits(df, [1, 2], "ridge", 0.5, n_components=2).items():
        a, b = x[fold != k], y[fold != k]
        mean, scale = M.standard(a)
        z = (a - mean) / scale
        v = M.principal(z, 2)
        coef, intercept = M.ridge(z @ v, b, 0.5)
        assert f.model.predict(x) == pytest.approx((x - mean) / scale @ v @ coef + intercept, abs=1e-6)


def test_one_fold_and_none(spark, data):
    df = data[3]
    assert MO.fold_fits(df.where("false"), [1]) == {}
    assert MO.fold_fits(df.where("fold = 1"), [1]) == {}


@pytest.mark.parametrize("kind", ["huber", "ridge"])
def test_strict_errors_like_the_grouped_ones(spark, kind):
    """Specs of different widths, missing features and targets, a column that never changes: the same predictions as from whole training sets."""
    from panelweave.operators import evaluate as E

    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        a, b = rng.standard_normal(3).tolist(), [*rng.standard_normal(2).tolist(), 1.0]
        y = 9 + 0.3 * a[0] - 0.2 * b[1] + 0.1 * float(rng.standard_t(2))
        rows.append((f"{i:05d}", f"{i % 9:02d}", 1 + i % 4, a if i % 17 else None, b if i % 19 else [float("nan"), 0.0, 1.0], y if i % 23 else None, 9.0 + 0.1 * a[1]))
    panel = spark.createDataFrame(rows, "fips string, state string, fold int, embeddings array<double>, mem array<double>, y_log double, pep_log double")
    specs = ["pep", "embeddings", "mem", "embeddings_mem", "embeddings_only"]
    keyed = lambda df: {(r.fips, r.model): (r.pred_log, r.sigma) for r in df.collect()}
    got, want = (keyed(E.strict_errors(panel, [1, 2, 3, 4], specs, kind, grouped=g, alpha=1e-2)) for g in (False, True))
    assert got.keys() == want.keys() and len(got) > 800
    assert max(abs(got[k][0] - want[k][0]) for k in got) < 1e-6 and max(abs(got[k][1] - want[k][1]) for k in got) < 1e-6
    few = keyed(E.strict_errors(panel, [1, 2, 3, 4], ["embeddings_mem"], kind, alpha=1e-2, n_components=2))
    assert len(few) > 200

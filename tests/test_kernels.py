"""Kernel models by landmarks against the regression on all rows at once."""

import numpy as np
import pytest

from panelweave.operators import kernels as K
from panelweave.operators import models as M


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((150, 3)) * [1, 5, 0.1] + [0, 100, 7]
    y = 12 + np.sin(x[:, 0]) + 0.1 * (x[:, 1] - 100) + rng.standard_normal(150) * 0.1
    fold = rng.integers(1, 4, 150)
    df = spark.createDataFrame([(i, 3, int(f), v.tolist(), float(t)) for i, (f, v, t) in enumerate(zip(fold, x, y, strict=True))], "id int, spec int, fold int, x array<double>, y double").repartition(4)
    return x, y, fold, df


@pytest.mark.parametrize("name", ["rbf", "laplacian", "cosine"])
def test_ridge_is_exact_with_all_rows_as_landmarks(data, name):
    x, y, fold, df = data
    got = {r.id: (r.raw, r.sigma) for r in K.held_out(df, [1, 2, 3], "kernel_ridge", name, 0.3).collect()}
    assert len(got) == 150
    for k in (1, 2, 3):
        a, b = x[fold != k], y[fold != k]
        want = K.kernel_ridge(a, b, x[fold == k], 0.3, name)
        assert [got[i][0] for i in np.flatnonzero(fold == k)] == pytest.approx(want, abs=1e-6)
        sigma = (b - K.kernel_ridge(a, b, a, 0.3, name)).std()
        assert {round(got[i][1], 6) for i in np.flatnonzero(fold == k)} == {round(sigma, 6)}


def test_repeated_rows_count_and_make_one_landmark(spark, data):
    x, y, fold, df = data
    twice = df.union(df.where("id < 40"))
    assert K.smallest(twice, 1000).count() == 150
    got = {r.id: r.raw for r in K.held_out(twice, [1], "kernel_ridge", "rbf", 0.3, gamma=0.4).distinct().collect()}
    more = np.concatenate([np.arange(150), np.arange(40)])
    at = more[fold[more] != 1]
    want = K.kernel_ridge(x[at], y[at], x[fold == 1], 0.3, "rbf", 0.4)
    assert [got[i] for i in np.flatnonzero(fold == 1)] == pytest.approx(want, abs=1e-6)


def test_few_landmarks_come_near(data):
    x, y, fold, df = data
    got = {r.id: r.raw for r in K.held_out(df, [1, 2, 3], "kernel_ridge", "rbf", 0.3, landmarks=40, centre=True).collect()}
    whole = {r.id: r.raw for r in K.held_out(df, [1, 2, 3], "kernel_ridge", "rbf", 0.3, centre=True).collect()}
    few, all_ = (np.array([g[i] for i in range(150)]) - y for g in (got, whole))
    assert all_.std() < few.std() < 1.5 * all_.std() < 0.9 * y.std()


def test_centred(data):
    x, y, fold, df = data
    got = {r.id: r.raw for r in K.held_out(df, [2], "kernel_ridge", "rbf", 0.3, centre=True).collect()}
    m = y[fold != 2].mean()
    assert [got[i] for i in np.flatnonzero(fold == 2)] == pytest.approx(m + K.kernel_ridge(x[fold != 2], y[fold != 2] - m, x[fold == 2], 0.3), abs=1e-6)


def test_huber_on_kernel_columns(data):
    x, y, fold, df = data
    df = df.cache()
    found = {r.id: r.raw for r in K.held_out(df, [1, 2], "kernel_huber", "rbf", 1e-2, landmarks=12).collect()}
    shifts = {3: np.array([0.0, *x.mean(0), y.mean()])}
    sites = K.sites_of(df, [1, 2], 3, shifts, "rbf", None, 12)
    for k in (1, 2):
        a, b = sites[3, k].columns(x[fold != k]), sites[3, k].columns(x[fold == k])
        assert a.shape[1] == 12
        want = M.fit("huber", a, y[fold != k], alpha=1e-2).predict(b)
        assert [found[i] for i in np.flatnonzero(fold == k)] == pytest.approx(want, abs=1e-5)
    assert set(found) == set(np.flatnonzero(fold < 3))


def test_width():
    x = np.random.default_rng(0).standard_normal((50, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert K.width_of(x, "rbf") == pytest.approx(1 / np.median(np.sort(d, 1)[:, 7]) ** 2)
    d = np.abs(x[:, None] - x[None]).sum(2)
    assert K.width_of(x, "laplacian") == pytest.approx(1 / np.median(np.sort(d, 1)[:, 7]))
    assert K.width_of(np.ones((9, 4)), "rbf") == pytest.approx(0.25) and K.width_of(x[:1], "rbf") == 1.0


def test_empty_and_one_fold(data):
    df = data[3]
    assert K.held_out(df.where("false"), [1]).count() == 0
    assert K.held_out(df.where("fold = 1"), [1]).count() == 0
    with pytest.raises(ValueError):
        K.held_out(df, [1], "kernel_forest")


def test_specs_of_different_lengths_together(spark, data):
    """Specs fitted at once, the shorter padded with zeros, as if each were alone."""
    from panelweave.operators import evaluate as E

    x, y, fold, df = data
    panel = df.selectExpr("CAST(id AS STRING) AS fips", "'00' AS state", "fold", "x AS embeddings", "slice(x, 1, 1) AS mem", "y AS y_log", "y - x[0] AS pep_log")
    got = {(r.model, int(r.fips)): r.pred_log for r in E.strict_errors(panel, [1, 2, 3], ["pep", "mem", "embeddings_only"], "kernel_ridge", alpha=0.3).collect()}
    for k in (1, 2, 3):
        at, test = fold != k, fold == k
        want = K.kernel_ridge(x[at], y[at], x[test], 0.3)
        assert [got["embeddings_only", i] for i in np.flatnonzero(test)] == pytest.approx(want, abs=1e-6)
        want = (y - x[:, 0])[test] + K.kernel_ridge(x[at, :1], x[at, 0], x[test, :1], 0.3)
        assert [got["mem", i] for i in np.flatnonzero(test)] == pytest.approx(want, abs=1e-6)
    assert len(got) == 450

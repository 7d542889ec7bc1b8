"""The tuners' objective against fits and scores made fold by fold in NumPy, and what the tuners find."""

import json
import math

import numpy as np
import pytest

from panelweave.operators import models as M
from panelweave.operators import objectives as O


@pytest.fixture(scope="module")
def data(spark):
    """Three of six columns matter."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((240, 6)) * [1, 2, 0.5, 1, 1, 3]
    pep = 9 + rng.standard_normal(240) * 0.2
    y = pep + 0.08 * x[:, 0] - 0.05 * x[:, 1] + 0.2 * x[:, 2] + 0.25 * rng.standard_normal(240)  # gains of some per cent, where the tanh still bends
    fold = rng.integers(1, 4, 240)
    rows = [(int(f), v.tolist(), float(a), float(b)) for f, v, a, b in zip(fold, x, y, pep, strict=True)]
    more = [(1, [float("nan")] * 6, 9.0, 9.0), (1, [0.0] * 6, None, 9.0), (None, [0.0] * 6, 9.0, 9.0), (2, None, 9.0, 9.0)]
    df = spark.createDataFrame(rows + more, "fold int, x array<double>, y_log double, pep_log double").repartition(4)
    return x, y, pep, fold, O.ready(df)


def plain(x, y, pep, fold, c, leak):
    base, kept, hard_base, hard_kept, treated = [], [], [], [], []
    for k in (1, 2, 3):
        a, t = fold != k, fold == k
        options = {"alpha": c.alpha} | ({"epsilon": c.epsilon} if c.kind == "huber" else {})
        pred = pep[t] + M.fit(c.kind, x[a, : c.k], (y - pep)[a], **options).predict(x[t, : c.k])
        ape = lambda p, t=t: np.abs(np.exp(p) - np.exp(y[t])) / np.exp(y[t]) * 100
        hard = ape(pep[t]) >= np.quantile(ape(pep[t]), 0.9)
        for m, b, w in ((np.ones(len(hard), bool), base, kept), (hard, hard_base, hard_kept)):
            p, q = ape(pep[t])[m].mean(), ape(pred)[m].mean()
            rel = 100 * (p - q) / p
            b.append(p)
            w.append(p * (1 - (rel * (1 - leak[k]) if rel > 0 else rel) / 100))
        treated.append(ape(pred).mean())
    g, h = (100 * (np.mean(b) - np.mean(w)) / np.mean(b) for b, w in ((base, kept), (hard_base, hard_kept)))
    low = 1 - (c.k - 1) / 5
    return np.mean(base), np.mean(treated), g, h, 0.7 * math.tanh(g / 5) + 0.2 * math.tanh(h / 5) + 0.1 * (2 * low - 1)


def test_scores(data):
    x, y, pep, fold, rows = data
    leak = {1: 0.1, 2: 0.0, 3: 0.4}
    several = [O.Candidate(1, "ridge", 2.0), O.Candidate(3, "huber", 1e-3), O.Candidate(6, "huber", 1e-2, 2.0), O.Candidate(4, "ridge", 0.1)]
    found = O.scores(rows, [1, 2, 3], several, leak, most=6)
    for c, r in zip(several, found, strict=True):
        want = plain(x, y, pep, fold, c, leak)
        assert (r["baseline"], r["treatment"], r["global_pct"], r["hard_pct"], r["objective"]) == pytest.approx(want, rel=1e-4, abs=1e-5)
        assert r["n_rows"] == 240


def test_sweep_finds_what_matters_and_stops(spark, data):
    rows = data[4]
    whole = O.k_sweep(rows, [1, 2, 3], {}, 6, kind="ridge", alpha=0.1, weights=(0.7, 0.2, 0.02))
    assert [r["k"] for r in whole] == [1, 2, 3, 4, 5, 6] and O.best_of(whole)["k"] == 3
    told = O.history(spark, whole)
    assert [r.k for r in told.where("selected").collect()] == [3]
    calm = O.k_sweep(rows, [1, 2, 3], {}, 6, strip=2, successive=1, kind="ridge", alpha=0.1, weights=(0.7, 0.2, 0.02))
    assert [r["objective"] for r in calm] == pytest.approx([r["objective"] for r in whole[: len(calm)]])
    with pytest.raises(ValueError):
        O.scores(rows, [1, 2, 3], [O.Candidate(7)], {})
    assert O.scores(rows.where("false"), [1], [O.Candidate(1)], {}) == []


def test_tuners(spark, data, tmp_path):
    rows = data[4]
    space = {"alpha": {"type": "float", "low": 1e-3, "high": 1e5, "log": True}, "kind": {"type": "fixed", "value": "ridge"}}
    found = O.tune_linear(rows, [1, 2, 3], 3, {}, space, f"file://{tmp_path}/linear", 3, 6).collect()
    assert len(found) == 18 and all(r.score is not None for r in found)
    best = max(found, key=lambda r: r.score)
    assert json.loads(best.params)["alpha"] < 50  # much shrinking is worse
    again = O.scores(rows, [1, 2, 3], [O.Candidate(3, **json.loads(best.params))], {})
    assert again[0]["objective"] == pytest.approx(best.score)
    with pytest.raises(ValueError):
        O.tune_linear(rows, [1], 3, {}, {"depth": {"type": "bool"}}, f"file://{tmp_path}/no", 1, 1)

    def rows_of(params):
        if params["columns"] == "bad":
            raise ValueError("no graph")
        return (rows if params["columns"] == "leading" else rows.selectExpr("fold", "slice(x, 4, 3) AS x", "y_log", "pep_log")), {}

    space = {"columns": {"type": "categorical", "choices": ["leading", "last", "bad"]}}
    found = O.tune_graph(spark, space, rows_of, [1, 2, 3], 3, f"file://{tmp_path}/graph", 1, 6, seed=1, kind="ridge", alpha=0.1).collect()
    by = {json.loads(r.params)["columns"]: r.score for r in found}
    assert by.get("bad") is None and by["leading"] > by["last"]

"""Soft ranks against the definition, gradients against differences, the penalty against NumPy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from panelweave.operators import losses as L


def test_soft_ranks():
    x = np.array([3.0, -1.0, 2.5, 10.0])
    assert L.soft_ranks(x, 1e-3)[0] == pytest.approx([3, 1, 2, 4])
    assert L.soft_ranks(x, 1e9)[0] == pytest.approx([2.5] * 4)
    rng = np.random.default_rng(1)
    for _ in range(20):
        x = rng.standard_normal(7)
        r = L.soft_ranks(x, 0.5)[0]
        assert r.sum() == pytest.approx(28) and (np.argsort(r, kind="stable") == np.argsort(x, kind="stable")).all()
        top = np.sort(r)[::-1].cumsum()
        assert (top <= np.arange(7, 0, -1).cumsum() + 1e-9).all()  # inside the permutahedron
        z = x / 0.5  # and nearer than other points of it
        for _ in range(30):
            other = rng.dirichlet(np.ones(5)) @ np.array([rng.permutation(7) + 1 for _ in range(5)])
            assert ((z - r) ** 2).sum() <= ((z - other) ** 2).sum() + 1e-9


@pytest.mark.parametrize("strength", [0.05, 0.5, 3.0])
def test_gradient(strength):
    rng = np.random.default_rng(2)
    s, d = rng.standard_normal(6), rng.random(6) * 5
    _, _, g = L.rank_loss(s, d, strength, True)
    h = 1e-6
    for i in range(6):
        e = np.eye(6)[i] * h
        slope = (L.rank_loss(s + e, d, strength, True)[0] - L.rank_loss(s - e, d, strength, True)[0]) / (2 * h)
        assert g[i] == pytest.approx(slope, abs=1e-5)


def test_losses_of_nodes(spark):
    rows = [(1, j, float(j), -float(j)) for j in range(5)] + [(2, 0, 1.0, 1.0), (2, 1, 2.0, 5.0), (3, 0, 1.0, 1.0), (2, 9, None, 1.0), (2, 8, 1.0, float("nan")), (None, 1, 1.0, 1.0)]
    got = {r.src: r for r in L.geo_rank_losses(spark.createDataFrame(rows, "src int, dst int, distance double, similarity double"), 1e-3).collect()}
    assert set(got) == {1, 2} and got[1].soft == pytest.approx(0, abs=1e-9) and got[1].hard == 0 and got[1].n == 5
    assert got[2].hard == 1.0 and got[2].soft == pytest.approx(1.0) and got[2].dst == [0, 1]


def test_dependence(spark):
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((40, 3)) + 1e4, rng.standard_normal((40, 2))
    b[:, 0] += a[:, 1] - 1e4
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)], "a array<double>, b array<double>").repartition(3)
    za, zb = ((m - m.mean(0)) / m.std(0) for m in (a, b))
    r = L.dependence(df, "a", "b").first()
    assert r.n == 40 and r.penalty == pytest.approx((((za.T @ zb) / 39) ** 2).mean())
    assert L.dependence(df.limit(1), "a", "b").first().penalty == 0 and L.dependence(df.where("false"), "a", "b").first() == (0, 0.0)


def test_losses_in_small_batches(spark, monkeypatch):
    """A task gives its nodes in batches of few neighbours, whatever it holds: memory follows from that bound."""
    made = {}
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, schema, **k: made.setdefault("f", f) and self)
    L.geo_rank_losses(spark.range(1).selectExpr("id AS src", "id AS dst", "1D AS distance", "1D AS similarity"), 0.1)
    rng = np.random.default_rng(4)
    n, k = 400, 600
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(x.ravel()))
    dst, d, s = np.tile(np.arange(k), (n, 1)), rng.random((n, k)), rng.random((n, k))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), lists(dst), lists(d), lists(s)], ["src", "dst", "d", "s"])
    parts = list(made["f"]([batch.slice(0, 0), batch.slice(3)]))
    assert max(sum(p["n"].to_pylist()) for p in parts) <= L.ENTRIES
    got = pa.Table.from_batches(parts).to_pylist()
    assert [r["src"] for r in got] == list(range(3, n))
    for i in (3, 200, 399):
        soft, hard, gradient = L.rank_loss(s[i], d[i], 0.1, True)
        assert (got[i - 3]["soft"], got[i - 3]["hard"], got[i - 3]["gradient"], got[i - 3]["dst"]) == (soft, hard, gradient.tolist(), list(range(k)))

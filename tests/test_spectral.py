"""The block iteration against a dense eigen-solve."""

from pathlib import Path

import numpy as np
import pytest

from panelweave.operators import graph as G
from panelweave.operators import spectral as S


def table(spark, w):
    return spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "src long, dst long, weight double").repartition(4)


def compare(spark, w, k, topk, **options):
    values, vectors = G.moran_basis(w, k, topk)
    dense = S.moran_basis_of(table(spark, w), k, topk).collect()
    assert sorted({(r.basis_index, round(r.eigenvalue, 9)) for r in dense}) == [(j, pytest.approx(v, abs=1e-8)) for j, v in enumerate(values)]
    rows = S.moran_basis_of(table(spark, w), k, topk, tol=1e-10, small=0, **options).collect()
    got = np.zeros((len(w), len(values)))
    for r in rows:
        got[r.node, r.basis_index] = r.basis_value
    assert {r.basis_index for r in rows} == set(range(len(values)))
    assert [next(r.eigenvalue for r in rows if r.basis_index == j) for j in range(len(values))] == pytest.approx(values, rel=1e-9)
    assert max(r.residual for r in rows) < 1e-8
    assert np.abs(got.T @ got - np.eye(len(values))).max() < 1e-10
    for j in range(len(values)):
        alone = all(abs(values[j] - v) > 1e-6 * values[0] for i, v in enumerate(values) if i != j)
        if alone and j + 1 < len(values):
            assert abs(got[:, j] @ vectors[:, j]) == pytest.approx(1, abs=1e-8)
    return got


def test_500_nodes(spark):
    rng = np.random.default_rng(3)
    points = rng.random((500, 2))
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    w = np.where((d < 0.12) & (d > 0), np.exp(-((d / 0.05) ** 2)), 0)
    compare(spark, w, 8, 12)


def test_small_and_odd_graphs(spark):
    rng = np.random.default_rng(5)
    w = rng.random((12, 12)) * (rng.random((12, 12)) < 0.4)
    w[:, 0] += 0.01  # every node has an edge
    compare(spark, w, 3, 12)
    two = np.zeros((6, 6))
    two[:3, :3] = two[3:, 3:] = 1
    compare(spark, two, 4, 6)
    assert S.moran_basis_of(spark.createDataFrame([], "src long, dst long, weight double"), 3, 4).collect() == []
    assert S.moran_basis_of(spark.createDataFrame([(1, 1, 2.0)], "src long, dst long, weight double"), 3, 4).collect() == []


def test_disk_of_a_long_iteration_is_bounded(spark, monkeypatch):
    """A graph without structure needs many blocks: rows stay short, tables of past steps go, what was shuffled goes, and the result is that of the dense solve."""
    rng = np.random.default_rng(11)
    v = rng.standard_normal((400, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    d = 1 - v @ v.T
    np.fill_diagonal(d, np.inf)
    w = np.where(d <= np.sort(d, axis=1)[:, 5:6], np.exp(-(d**2)), 0)
    shared = Path(spark.conf.get("spark.checkpoint.dir", None).removeprefix("file://")) / "panelweave"
    before, seen, longest, real = set(shared.rglob("*")), [], [], S.written

    def watched(df, name, *path):
        out = real(df, name, *path)
        tables = {x.parent for x in set(shared.rglob("_SUCCESS")) - before}
        seen.append(len(tables))
        if "q" in out.columns:
            longest.append(max(len(r.q) + (len(r.w) if "w" in out.columns else 0) for r in out.limit(1).collect()))
        return out

    monkeypatch.setattr(S, "written", watched)
    values, _ = G.moran_basis(w, 4, 12)
    rows = S.moran_basis_of(table(spark, w), 4, 12, small=0).collect()
    assert sorted({r.eigenvalue for r in rows}, reverse=True) == pytest.approx(values, rel=1e-9)
    assert max(r.residual for r in rows) <= 1e-8 * values[0]
    got = np.zeros((400, 4))
    for r in rows:
        got[r.node, r.basis_index] = r.basis_value
    a = (w + w.T) / 2
    a = a - a.mean(0) - a.mean(0)[:, None] + a.mean()
    assert np.linalg.norm(a @ got - got * values, axis=0).max() < 1e-7
    assert np.abs(got.T @ got - np.eye(4)).max() < 1e-9
    assert len(longest) > 20 and max(longest) <= 9 * 12
    assert max(seen) <= 4
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"

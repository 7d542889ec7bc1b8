"""The corrected model of a stream against the fit of all rows so far."""

import math

import numpy as np
import pytest

from panelweave.operators import models as M
from panelweave.streaming import online as N

BASE = M.Linear(np.array([1.0, -2.0]), np.array([2.0, 0.5]), np.array([0.5, -0.3]), 4.0, 0.1)


def wanted(x, y, alpha, fraction):
    z = (x - BASE.mean) / BASE.scale
    left = y - z @ BASE.coef - BASE.intercept
    coef, shift = M.ridge(z, left, alpha * len(y))
    length, most = math.hypot(np.linalg.norm(coef), shift), fraction * math.hypot(np.linalg.norm(BASE.coef), BASE.intercept)
    s = min(1.0, most / length)
    return coef * s, shift * s, (left - z @ coef * s).std(), s < 1


@pytest.mark.parametrize("fraction", [0.05, 10.0])
def test_stream_is_the_fit_of_all_rows_so_far(spark, tmp_path, fraction):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((90, 2)) * [2, 0.5] + [1, -2]
    y = (x - BASE.mean) / BASE.scale @ (BASE.coef + [0.2, 0.1]) + 4.3 + 0.1 * rng.standard_normal(90)
    src, table = str(tmp_path / "in"), N.states(spark, f"file://{tmp_path}/state")

    def file(low, high, more=()):
        rows = [(v.tolist(), float(t)) for v, t in zip(x[low:high], y[low:high], strict=True)]
        spark.createDataFrame(rows + list(more), "x array<double>, y double").coalesce(1).write.mode("append").parquet(src)

    def run():
        s = spark.readStream.schema("x array<double>, y double").option("maxFilesPerTrigger", 1).parquet(src)
        q = N.update_stream(s, BASE, f"file://{tmp_path}/state", str(tmp_path / "c"), "m", 1e-2, fraction)
        q.awaitTermination(200)
        assert q.exception() is None

    file(0, 30, [(None, 1.0), ([1.0, float("nan")], 1.0), ([1.0, 2.0], None), ([1.0], 2.0)])
    run()
    file(30, 70)
    file(70, 90)
    run()  # goes on from its checkpoint
    got = sorted(table.read(N.STATE).collect(), key=lambda r: r.batch)
    assert [r.n for r in got] in ([30.0, 70.0, 90.0], [30.0, 50.0, 90.0])
    for r in (got[0], got[2]):
        coef, shift, sigma, held = wanted(x[: int(r.n)], y[: int(r.n)], 1e-2, fraction)
        assert r.delta == pytest.approx(coef, abs=1e-9) and r.shift == pytest.approx(shift, abs=1e-9)
        assert r.sigma == pytest.approx(sigma, abs=1e-9) and r.shortened == held == (fraction < 1)
    for r in got:
        assert math.hypot(np.linalg.norm(r.delta), r.shift) <= fraction * math.hypot(np.linalg.norm(BASE.coef), BASE.intercept) * (1 + 1e-12)
    rows = spark.createDataFrame([([9.0, 9.0], 1e6)], "x array<double>, y double")
    assert not N.update(BASE, table, "m", 1e-2, fraction, rows, got[2].batch)  # the batch comes again
    assert N.latest(table)["n"] == 90
    now = N.corrected(BASE, N.latest(table))
    assert now.coef == pytest.approx(BASE.coef + got[2].delta) and N.corrected(BASE, None) is BASE


def test_batch_without_rows(spark, tmp_path):
    table = N.states(spark, f"file://{tmp_path}/state")
    assert N.update(BASE, table, "m", 1e-2, 0.05, spark.createDataFrame([], "x array<double>, y double"), 0)
    assert N.latest(table)["delta"] == [0.0, 0.0] and N.latest(table)["n"] == 0

"""Orders of samples: one to one for every size, the same by key, like a random order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import epochs as E


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_one_to_one(spark, n):
    got = [r[0] for r in spark.range(n).select(E.permuted(F.col("id"), n, "0 1")).collect()]
    assert sorted(got) == list(range(n))


def test_orders_differ_by_epoch_and_mix(spark):
    n = 2000
    a, b, again = (np.array([r[1] for r in spark.range(n).select("id", E.permuted(F.col("id"), n, k)).orderBy("id").collect()]) for k in ("0 1", "0 2", "0 1"))
    assert (a == again).all() and (a == b).sum() < 20
    for p in (a, b):
        assert abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.1 and abs(np.corrcoef(p[:-1], p[1:])[0, 1]) < 0.1
        assert (np.abs(np.diff(p)) == 1).sum() < 20


def test_modalities_agree(spark):
    a = spark.createDataFrame([(str(i), i) for i in range(50)] + [(None, 1)], "k string, v int")
    b = spark.createDataFrame([(str(i), -i) for i in range(20, 70)] + [("30", 5)], "k string, v int")
    common = E.common_samples({"a": a, "b": b}, ["k"])
    index, n = E.numbered(common, ["k"], per_bucket=7)
    assert n == 30 and sorted(r["index"] for r in index.collect()) == list(range(30))
    x, y = (E.in_order(f, index, n, ["k"], 4, 8).collect() for f in (a, b))
    at = {r.k: (r.position, r.batch) for r in x}
    assert len(x) == 30 and len(y) == 31 and all(at[r.k] == (r.position, r.batch) for r in y)
    assert sorted(p for p, _ in at.values()) == list(range(30)) and {b for _, b in at.values()} == {0, 1, 2, 3}
    plain = E.in_order(a, index, n, ["k"], 4, 8, shuffle=False).collect()
    assert {r.k: r.position for r in plain} == {r.k: r["index"] for r in index.collect()}
    made = {r.batch: r for r in E.collated(E.in_order(b, index, n, ["k"], 4, 8), "v").collect()}
    assert [made[i].n_samples for i in range(4)] == [8, 8, 8, 6] and sum(len(made[i]["values"]) for i in range(4)) == 31
    assert made[0].sample == sorted(made[0].sample) and set(made[3].sample) == set(range(6))
    with pytest.raises(ValueError):
        E.in_order(a, index, n, ["k"], 0, 0)


def test_nothing(spark):
    index, n = E.numbered(spark.createDataFrame([], "k string"), ["k"])
    assert n == 0 and index.count() == 0


def test_years():
    got = [E.year_of([2020, 2018, 2019, 2018], i, 3) for i in range(30)]
    assert all(sorted(got[i : i + 3]) == [2018, 2019, 2020] for i in range(0, 30, 3)) and len({tuple(got[i : i + 3]) for i in range(0, 30, 3)}) > 1
    with pytest.raises(ValueError):
        E.year_of([], 0)

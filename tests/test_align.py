import pytest
from pyspark.sql import functions as F

from panelweave.operators import align as A


def test_masks_and_missing_rows(spark):
    samples = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "fips string")
    x = spark.createDataFrame([("1", [1.0, 2.0]), ("2", [float("nan"), 1.0]), ("3", [float("inf"), 1.0]), ("9", [0.0, 0.0])], "fips string, x array<double>")
    got = {r.fips: r for r in A.with_modalities(samples, {"m": x}).collect()}
    assert {k: r.m_mask for k, r in got.items()} == {"1": True, "2": False, "3": False, "4": False} and got["4"].m is None
    with pytest.raises(Exception, match="several rows for 1"):
        A.with_modalities(samples, {"m": x.union(x)}).collect()


def test_weighted_deviation(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", 1.0, 1.0), ("a", 3.0, 3.0), ("b", 5.0, 2.0), ("large", 1e9, 1.0), ("large", 1e9 + 1, 1.0), ("large", 1e9 + 2, 1.0), ("null", 10.0, 1.0), ("null", 12.0, 1.0), ("null", None, 1.0)]
    rows += [("odd", 1.0, 1.0), ("odd", 5.0, 1.0), ("odd", nan, 9.0), ("odd", inf, 9.0), ("odd", 7.0, None), ("odd", 7.0, nan), ("odd", 100.0, -3.0), (None, 2.0, 1.0), (None, 4.0, 1.0), ("none", None, 1.0), ("zero", 1.0, 0.0), ("zero", 2.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, x double, w double")
    got = dict(map(tuple, A.weighted_deviations(df, ["k"], F.col("x"), F.col("w")).collect()))
    assert got == {"a": pytest.approx((0.25 * 1.5**2 + 0.75 * 0.5**2) ** 0.5), "b": 0.0, "large": pytest.approx((2 / 3) ** 0.5), "null": 1.0, "odd": 2.0, None: 1.0, "none": 0.0, "zero": 0.0}
    assert A.weighted_deviations(df.where("k = 'a'"), [], F.col("x"), F.col("w")).first().deviation == got["a"]


def test_runs_are_kept_apart(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    basis = spark.createDataFrame([(1, [0.5, 0.25])], "fips long, basis array<double>")
    edges = spark.createDataFrame([(1, 2, 0.0), (1, 3, 2.0), (2, 3, float("nan"))], "src long, dst long, weight double")
    for year in (2019, 2020):
        A.write_topology(folder, {"graph_tag": "a", "graph_kind": "k", "source_year": year}, basis, edges)
    assert [tuple(r) for r in A.topology_edges(spark, folder, "a", "k", 2020).collect()] == [("00001", "00003", 2.0)]
    assert sorted(tuple(r) for r in A.topology_basis(spark, folder, "a", "k", 2019).collect()) == [("00001", 0, 0.5), ("00001", 1, 0.25)]
    assert A.topology_edges(spark, folder, "b", "k", 2020).count() == 0


def test_feature_columns(spark):
    df = spark.createDataFrame([("1", 2020, 1.0, 2, "x", 3.0)], "fips string, year int, a double, b int, c string, label double")
    assert A.feature_columns(df) == ["a", "b"] and A.feature_columns(df, ("b",)) == ["a"]

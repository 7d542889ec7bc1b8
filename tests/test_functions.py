import math

import pytest
from pyspark.sql import functions as F

from panelweave.functions import dates, distributions as D, geography, measures as M, nulls, text, vectors as V


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {('string' if isinstance(v, str) or v is None else 'double')}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("value", "want"), [("1.5", 1.5), (" 2 ", 2.0), ("x", None), ("NaN", None), ("Infinity", None), ("", None), (None, None)])
def test_to_double(spark, value, want):
    assert one(spark, nulls.to_double(F.col("a")), a=value) == want


def test_bounds_keep_null(spark):
    a = F.lit(None).cast("double")
    row = spark.range(1).select(nulls.floored(a, 1.0), nulls.capped(a, 1.0), nulls.divide(F.lit(1), F.lit(0)), nulls.sum_if_any(a, a), nulls.sum_if_any(a, F.lit(2.0)), nulls.safe_ln(F.lit(0.0))).first()
    assert tuple(row) == (None, None, None, None, 2.0, None)


@pytest.mark.parametrize(("value", "want"), [("7", "00007"), ("123456", "123456"), ("ab", "000ab")])
def test_zfill(spark, value, want):
    assert one(spark, text.zfill(F.col("a"), 5), a=value) == want


@pytest.mark.parametrize(("value", "want"), [("'1001'", "01001"), (" 12345678 ", "12345"), ("abc", "abc")])
def test_code(spark, value, want):
    assert one(spark, text.canonical_code(F.col("a")), a=value) == want


@pytest.mark.parametrize(("value", "want"), [("Adams County", "adams"), ("Lake and Peninsula Borough", "lake and peninsula"), ("Carson City city", "carson city"), ("St. John's  County", "st john s"), ("Juneau City and Borough", "juneau city and")])
def test_county_name(spark, value, want):
    assert one(spark, text.county_name(F.col("a")), a=value) == want


def test_names(spark):
    assert one(spark, text.name_key(F.col("a")), a=" Doña Ana & Co., NM ") == "dona ana and co , nm"
    row = spark.createDataFrame([("Doña Ana County", "New Mexico")], "a string, b string").select(text.name_keys(F.col("a"), F.col("b")).alias("k")).first()
    assert row.k == ["dona ana county, new mexico", "dona ana, new mexico"]


@pytest.mark.parametrize(("value", "want"), [("202003", "2020-03-01"), ("2020-03", "2020-03-01"), ("2020-03-15", "2020-03-01"), ("202013", None), ("", None), (None, None)])
def test_month(spark, value, want):
    got = one(spark, dates.month_start(F.col("a")), a=value)
    assert (str(got) if got else None) == want


def test_strata(spark):
    values = [(4999.99,), (5000.0,), (24999.0,), (25000.0,), (50000.0,), (100000.0,), (250000.0,), (1000000.0,), (None,)]
    df = spark.createDataFrame(values, "p double").select(M.stratum(F.col("p")).alias("a"), M.stratum(F.col("p"), M.STRATA_5).alias("b"), M.stratum(F.col("p"), missing_on_top=True).alias("c"))
    rows = df.collect()
    assert [r.a for r in rows] == ["<5k", "5k-25k", "5k-25k", "25k-50k", "50k-100k", "100k-250k", "250k-1M", "1M+", None]
    assert [r.b for r in rows] == ["<5k", "5k-50k", "5k-50k", "5k-50k", "50k-250k", "50k-250k", "250k-1M", ">1M", None]
    assert rows[-1].c == "1M+"


def test_geography(spark):
    df = geography.with_geography(spark.createDataFrame([("1",), ("06",), ("72",), ("99",)], "state string"))
    assert [(r.region, r.division) for r in df.collect()] == [("south", "east_south_central"), ("west", "pacific"), ("territory", "territory"), ("unknown", "unknown")]


def test_measures(spark):
    row = spark.range(1).select(
        M.outcome(F.lit(0.1)), M.outcome(F.lit(-0.1)), M.outcome(F.lit(0.0)), M.adjusted_improvement(F.lit(0.2), F.lit(0.5)), M.adjusted_improvement(F.lit(-0.2), F.lit(0.5)),
        M.symmetric_ratio(F.lit(1.0), F.lit(2.0)), M.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)), M.crps(F.lit(0.0), F.lit(0.0), F.lit(1.0)),
    ).first()
    assert tuple(row)[:3] == ("win", "loss", "equal") and row[3] == pytest.approx(0.1) and row[4] == pytest.approx(-0.2) and row[5] == 2.0
    assert row[6] == pytest.approx(6371.0 * math.pi / 2) and row[7] == pytest.approx(0.233695, abs=1e-6)


def test_vectors(spark):
    df = spark.createDataFrame([("a", [3.0, 4.0]), ("a", [1.0, 0.0]), ("b", [0.0, 0.0])], "k string, v array<float>")
    p = {r.k: r.pooled for r in V.pooled(df, "k", "v").collect()}
    assert p["a"] == [2.0, 2.0, 3.0, 4.0] and p["b"] == [0.0] * 4
    assert df.select(V.l2_normalised(F.col("v")).alias("u")).first().u == pytest.approx([0.6, 0.8])
    assert df.where("k = 'b'").select(V.cosine(F.col("v"), F.col("v")).alias("c")).first().c is None
    with pytest.raises(Exception, match="wanted 3"):
        V.with_length(df, "v", 3).collect()


def test_tails():
    assert D.t_cdf(2.0, 10) == pytest.approx(0.963306, abs=1e-6) and D.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-6)
    for n, k, p in ((10, 7, 0.5), (30, 29, 0.95), (5, 0, 0.3), (5, 6, 0.3)):
        assert D.binom_upper(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(max(k, 0), n + 1)), abs=1e-12)
    assert D.clopper_pearson(0, 10)[0] == 0 and D.clopper_pearson(10, 10)[1] == 1 and D.clopper_pearson(5, 10) == pytest.approx((0.187086, 0.812914), abs=1e-6)


def test_ascii_fold_of_every_document(spark, tmp_path):
    import unicodedata

    from panelweave.plans import catalog

    rows = [(1, "Café in Zürich", "en"), (2, "São Tomé ﬁ ½ ß Ł ø", None), (3, "garçon", "fr"), (4, "中文 Ångström", "zh"), (5, None, "en"), (6, "", ""), (7, "plain", "de"), (7, "plain", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in catalog.queries()["ascii_fold_documents"](spark, str(tmp_path)).collect()]
    plain = lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if ord(c) < 128)
    assert sorted(got, key=str) == sorted(((i, plain(t)) for i, t, _ in rows), key=str)
    assert dict(got)[1] == "Cafe in Zurich" and dict(got)[3] == "garcon" and dict(got)[5] is None

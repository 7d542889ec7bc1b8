import math

import pytest
from pyspark.sql import functions as F

from panelweave.operators import panel as P
from panelweave.operators import relational as R


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_population(spark):
    raw = spark.createDataFrame([("1", "1", "100", "110", "5", "1"), ("1", "1", "999", "999", "9", "9"), ("01", "000", "1", "1", "1", "1"), ("1", "3", "x", "50", None, None)], "STATE string, COUNTY string, POPESTIMATE2020 string, POPESTIMATE2021 string, DOMESTICMIG2021 string, INTERNATIONALMIG2021 string").withColumn("seq", F.monotonically_increasing_id())
    got = rows(P.population_rows(raw, [2020, 2021], "seq"), "fips", "year")
    assert set(got) == {("01001", 2020), ("01001", 2021), ("01003", 2020), ("01003", 2021)}
    assert got["01001", 2021].pep_population == 110 and got["01001", 2021].pep_population_prev == 100 and got["01001", 2021].pep_net_migration == 6
    assert got["01003", 2020].pep_population is None and got["01003", 2021].pep_net_migration is None and got["01001", 2020].pep_births is None


def test_supervision(spark):
    truth = P.census_truth(spark.createDataFrame([("1001", "120", 1), ("1001", "7", 2), ("1003", "0", 3), ("1005", None, 4)], "fips string, n string, seq int"), "n", "seq")
    prev, anchor = (spark.createDataFrame([("01001", v)], f"fips string, {n} double") for v, n in ((100.0, "prev"), (110.0, "anchor")))
    r = P.supervision(truth, prev, anchor).first()
    assert (r.fips, r.label_delta, r.target_correction_level) == ("01001", 20.0, 10.0) and r.target_correction_log == pytest.approx(math.log(120 / 110))


def labour(spark):
    new, old = "LAUCN010010000000{}", "LAUUCN01001000000{}"
    data = [(new.format(f"{m:03d}"), y, f"M{k:02d}", str(v)) for m, v0 in ((3, 5.0), (4, 10.0), (5, 190.0), (6, 200.0)) for y, add in (("2020", 0), ("2021", 10)) for k, v in ((1, v0), (12, v0 + add), (13, 99))]
    data += [(new.format("003"), "2020", "M01", "7.0"), (new.format("003"), "2020", "Q01", "1"), (new.format("003"), "1999", "M01", "1"), (new.format("003"), "2020", "M02", "-"), (old.replace("LAUU", "LAUS").format("03"), "2020", "M05", "50")]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(data)], "series_id string, year string, period string, value string, seq int")


def test_labour(spark):
    m = P.labour_months(labour(spark), [2020, 2021], "U", "CN", ["03", "04", "05", "06"], "seq")
    got = rows(m, "fips", "year", "month", "measure")
    assert got["01001", 2020, 1, "3"].value == 7.0 and ("01001", 2020, 13, "3") not in got and ("01001", 2020, 5, "3") not in got
    f = rows(P.labour_features(m), "fips", "year")
    assert f["01001", 2021].laus_urate_dec_yoy == 10.0 and f["01001", 2020].laus_urate_dec_yoy is None
    assert f["01001", 2021].laus_emp_dec_yoy == pytest.approx(10 / 190) and f["01001", 2021].laus_unemp_to_lf_dec == pytest.approx(20 / 210)
    assert f["01001", 2021].laus_urate_q4_minus_q1 == 10.0
    same = rows(P.labour_features(m, yoy_offset=0), "fips", "year")
    assert same["01001", 2021].laus_urate_dec_yoy == 0.0 and same["01001", 2020].laus_emp_dec_yoy == 0.0
    annual = P.labour_months(labour(spark), [2020], "U", "CN", ["3"], "seq", with_annual=True)
    assert rows(annual, "month")[(13,)].value == 99.0


def test_housing(spark):
    cols = {n: [c] for n, c in P.INVENTORY.items()}
    raw = spark.createDataFrame([("202011", "1001", "10", "1", "2", "30", "100"), ("202012", "1001", "20", "3", None, "40", "150"), ("", "1001", "1", "1", "1", "1", "1")], "Month_Date_yyyymm string, county_fips string, active_listing_count string, new_listing_count string, pending_listing_count string, median_days_on_market string, median_listing_price string")
    inv = P.listing_months(raw, cols)
    hot = spark.createDataFrame([("01001", "2020-12-01", 5.0), ("01001", "2020-12-01", 7.0)], "fips string, d string, demand double").select("fips", F.to_date("d").alias("date"), "demand")
    r = P.housing_features(inv, hot, fill=False).first()
    assert (r.housing_active_inv, r.housing_new_listings, r.housing_pending, r.housing_demand_score) == (15.0, 4.0, 2.0, 6.0)
    assert r.housing_price_mom == pytest.approx(0.5) and r.housing_dom_mom == 10.0 and r.housing_price_yoy is None and r.housing_turnover == pytest.approx(0.4)
    assert P.housing_features(inv, hot).first().housing_price_yoy == 0.0
    with pytest.raises(ValueError):
        P.listing_months(raw.drop("county_fips"), cols)


def test_housing_prices_of_two_years(spark):
    """December is compared with December, whatever the other months' prices; without one of them, or with a price under 1, by the rules."""
    months = [("a", "2020-06-01", 900.0), ("a", "2020-12-01", 200.0), ("a", "2021-01-01", 1000.0), ("a", "2021-12-01", 300.0), ("b", "2020-11-01", 50.0), ("b", "2021-12-01", 60.0), ("c", "2020-12-01", 0.5), ("c", "2021-12-01", 3.0)]
    inv = spark.createDataFrame(months, "fips string, d string, price double").select("fips", F.to_date("d").alias("date"), *[F.lit(1.0).alias(n) for n in ("active", "new", "pending", "dom")], "price")
    hot = spark.createDataFrame([], "fips string, date date, demand double")
    got = {(r.fips, r.year): r.housing_price_yoy for r in P.housing_features(inv, hot, fill=False).collect()}
    assert got == {("a", 2020): None, ("a", 2021): pytest.approx(0.5), ("b", 2020): None, ("b", 2021): None, ("c", 2020): None, ("c", 2021): pytest.approx(2.0)}


def test_addresses(spark):
    base = "geoid string, ams_res string, ams_bus string, ams_oth string, res_vac string, bus_vac string, oth_vac string, nostat_res string, nostat_bus string, nostat_oth string"
    raw = spark.createDataFrame([("1001000100", "80", "10", "0", "5", "0", "0", "5", "0", "0"), ("1001000200", "100", "0", "0", "0", "0", "0", "0", "0", "0"), ("1001000300", *[None] * 9), ("1001000400", *["0"] * 9)], base)
    t = P.address_tracts(raw)
    assert t.count() == 2 and t.first().geoid == "01001000100" and t.first().fips == "01001"
    feats = P.address_features(t.withColumn("area", F.lit(2.0)).withColumn("land_area", F.lit(None).cast("double")), ["fips"]).first()
    assert feats.usps_flux_rate == pytest.approx(5 / 200) and feats.usps_comm_ratio == pytest.approx(10 / 200) and feats.usps_address_hhi == pytest.approx(0.5)
    assert feats.usps_coverage_ratio == pytest.approx(1.0) and feats.usps_total_res == 190 and feats.usps_vacancy_aging_ratio == pytest.approx(5.0)
    assert feats.usps_log_density_land == pytest.approx(math.log1p(200 / 4)) and feats.usps_log_density_iqr == pytest.approx(0.0)
    v = spark.createDataFrame([("a", 2020, 100.0), ("a", 2021, 150.0), ("a", 2023, 150.0)], "fips string, year int, usps_total_res double")
    assert sorted((r.year, r.usps_residency_velocity) for r in P.with_velocity(v).collect()) == [(2020, 0.0), (2021, 0.5), (2023, 0.0)]
    with pytest.raises(ValueError):
        P.address_tracts(raw.drop("ams_res"))


def test_merge(spark):
    base = spark.createDataFrame([("a", 2020, 9.0), ("b", 2020, 9.0), ("c", 2020, 9.0), ("a", 2021, 9.0)], "fips string, year int, label double")
    f = spark.createDataFrame([("a", 2020, 1.0, None), ("b", 2020, 3.0, None)], "fips string, year int, x double, y double")
    labels = spark.createDataFrame([("a", 2020, 1.0, 2.0, 3.0, 4.0)], "fips string, year int, label double, label_level double, label_prev double, label_delta double")
    got = rows(P.merged_panel(base, labels, [f]), "fips", "year")
    assert got["c", 2020].x == 2.0 and got["a", 2021].x == 0.0 and got["a", 2020].y == 0.0 and got["a", 2020].label == 1.0 and got["b", 2020].label is None


def test_checked_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    twice = spark.createDataFrame([(1, 5), (1, 6)], "k int, w int")
    with pytest.raises(Exception, match="repeated key"):
        R.many_to_one(a, twice, ["k"]).collect()
    with pytest.raises(Exception, match="repeated key"):
        R.one_to_one(a, twice, ["k"]).collect()
    assert R.many_to_one(twice, a, ["k"]).count() == 2


def test_work_lists(spark):
    work = spark.createDataFrame([("a", 2), ("b", 3)], "k string, n int")
    done = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert R.not_done(work, done.where("k = 'a'"), ["k"]).first().k == "b" and [r.k for r in R.partly_done(work, done, ["k"], "n").collect()] == ["b"]


def test_sampling(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 0)], "k string, i int")
    got = sorted((r.k, r.i) for r in R.evenly_spaced(df, "k", "i", 4).collect())
    assert got == [("a", 0), ("a", 3), ("a", 6), ("a", 9), ("b", 0)]
    assert sorted((r.k, r.i) for r in R.evenly_spaced(df, "k", "i", 1).collect()) == [("a", 0), ("b", 0)]

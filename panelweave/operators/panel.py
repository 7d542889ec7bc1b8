"""Builders of the entity x year panel: population, labour, housing, addresses, merge. Each is one lazy plan over all years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_start
from ..functions.nulls import capped, divide, finite, floored, safe_ln, sum_if_any, to_double
from ..functions.text import canonical_code, part, strip_zeros, zfill
from .relational import columns_from_codes, impute_all, impute_by, keep_first, keep_last, previous_year, years_from_columns

#: Series ids of labour statistics: an older layout with a seasonal letter and the county layout. Fixed values.
SERIES_OLD = r"^LAU([A-Z0-9])([A-Z0-9]{2})(\d{2})(\d{3})(\d{6})(\d{2})$"
SERIES_COUNTY = r"^LAU([A-Z0-9]{2})(\d{2})(\d{3})(\d{7})(\d{3})$"
POPULATION = {
    "pep_population": "POPESTIMATE", "pep_births": "BIRTHS", "pep_deaths": "DEATHS", "pep_domestic_migration": "DOMESTICMIG",
    "pep_international_migration": "INTERNATIONALMIG", "pep_residual": "RESIDUAL",
}
LABELS = ["label", "label_level", "label_prev", "label_delta"]


def counties_only(df: DataFrame, fips: str = "fips") -> DataFrame:
    return df.where(~F.col(fips).endswith("000"))


# population ------------------------------------------------------------------


def population_rows(raw: DataFrame, years: list[int], seq: str) -> DataFrame:
    """(fips, year, components) from a wide table with STATE, COUNTY and one column per measure and year; the first row of a county counts."""
    keyed = raw.withColumn("fips", F.concat(zfill(F.trim("STATE"), 2), zfill(F.trim("COUNTY"), 3)))
    once = keep_first(counties_only(keyed), ["fips"], seq)
    long = years_from_columns(once, ["fips"], POPULATION, years)
    before = previous_year(long, ["fips"], ["pep_population"])
    return before.withColumn("pep_net_migration", sum_if_any(F.col("pep_domestic_migration"), F.col("pep_international_migration")))


def census_truth(raw: DataFrame, value: str, seq: str) -> DataFrame:
    """(fips, truth) of positive finite counts, first row of a code."""
    rows = raw.select(canonical_code(F.col("fips")).alias("fips"), to_double(F.col(value)).alias("truth"), seq)
    return keep_first(rows.where("truth > 0"), ["fips"], seq).drop(seq)


def supervision(truth: DataFrame, previous: DataFrame, anchor: DataFrame, year: int = 2020) -> DataFrame:
    """Labels of the census year: truth (fips, truth) with previous (fips, prev) and anchor (fips, anchor), all positive."""
    rows = truth.join(previous, "fips").join(anchor, "fips").where("truth > 0 AND prev > 0 AND anchor > 0")
    return rows.select(
        "fips", F.lit(year).alias("year"), F.log("truth").alias("label"), F.col("truth").alias("label_level"), F.col("prev").alias("label_prev"),
        (F.col("truth") - F.col("prev")).alias("label_delta"), (F.log("truth") - F.log("anchor")).alias("target_correction_log"), (F.col("truth") - F.col("anchor")).alias("target_correction_level"),
    )


def accounted_anchor(pop: DataFrame) -> Column:
    """An anchor without the residual: previous level and all components of change."""
    c = F.col
    return c("pep_population_prev") + c("pep_births") - c("pep_deaths") + F.coalesce(c("pep_domestic_migration"), F.lit(0.0)) + F.coalesce(c("pep_international_migration"), F.lit(0.0))


# labour ----------------------------------------------------------------------


def series_parts(series: Column) -> dict[str, Column]:
    s = F.trim(series)
    both = lambda old, new: F.coalesce(part(s, SERIES_OLD, old), part(s, SERIES_COUNTY, new))
    return {
        "seasonal": part(s, SERIES_OLD, 1), "area_type": both(2, 1),
        "fips": F.concat(both(3, 2), both(4, 3)), "measure": strip_zeros(both(6, 5)),
    }


def labour_months(raw: DataFrame, years: list[int], seasonal: str, area_type: str, measures: list[str], seq: str, with_annual: bool = False) -> DataFrame:
    """(fips, year, month, measure, value): the last row of a key counts. Month 13 is the annual mean, left out unless asked for."""
    rows = raw.withColumns({**series_parts(F.col("series_id")), "y": F.trim("year").try_cast("int"), "month": part(F.trim("period"), r"^M(\d{2})$", 1).cast("int"), "x": to_double(F.col("value"))})
    most = 13 if with_annual else 12
    ok = F.col("y").isin(years) & (F.col("area_type") == area_type) & F.col("measure").isin([m.lstrip("0") or "0" for m in measures])
    ok = ok & (F.col("seasonal").isNull() | (F.col("seasonal") == seasonal)) & F.col("month").between(1, most) & F.col("x").isNotNull()
    rows = rows.where(ok).select("fips", F.col("y").alias("year"), "month", "measure", F.col("x").alias("value"), seq)
    return keep_last(rows, ["fips", "year", "month", "measure"], seq).drop(seq)


def labour_features(months: DataFrame, yoy_offset: int = 1) -> DataFrame:
    """Yearly features from monthly rate (3), unemployed (4), employed (5) and labour force (6)."""
    wide = columns_from_codes(months, ["fips", "year", "month"], "measure", "value", {"3": "rate", "4": "unemployed", "5": "employed", "6": "force"})
    at = lambda c, low, high: F.avg(F.when(F.col("month").between(low, high), F.col(c)))
    one = wide.groupBy("fips", "year").agg(
        F.avg("rate").alias("laus_urate_mean"), F.stddev_samp("rate").alias("laus_urate_std"), (at("rate", 10, 12) - at("rate", 1, 3)).alias("laus_urate_q4_minus_q1"),
        *[F.max(F.when(F.col("month") == 12, F.col(c))).alias(f"_{c}") for c in ("rate", "unemployed", "employed", "force")],
    )
    two = previous_year(one, ["fips"], ["_rate", "_employed", "_force"], yoy_offset)
    change = lambda c: finite(divide(F.col(c) - F.col(f"{c}_prev"), floored(F.abs(f"{c}_prev"), 1.0)))
    return two.select(
        "fips", "year", "laus_urate_mean", "laus_urate_std", "laus_urate_q4_minus_q1", (F.col("_rate") - F.col("_rate_prev")).alias("laus_urate_dec_yoy"),
        change("_employed").alias("laus_emp_dec_yoy"), change("_force").alias("laus_lf_dec_yoy"), divide(F.col("_unemployed"), floored(F.col("_force"), 1.0)).alias("laus_unemp_to_lf_dec"),
    )


# housing ---------------------------------------------------------------------

INVENTORY = {"active": "active_listing_count", "new": "new_listing_count", "pending": "pending_listing_count", "dom": "median_days_on_market", "price": "median_listing_price"}


def pick(df: DataFrame, names: list[str], required: bool = True) -> str | None:
    """The first of several column names that a table has, whatever the case."""
    has = {c.strip().lower(): c for c in df.columns}
    for n in names:
        if n.lower() in has:
            return has[n.lower()]
    if required:
        raise ValueError(f"none of the columns {names}")
    return None


def listing_months(raw: DataFrame, metrics: dict[str, list[str]], optional: set[str] = frozenset()) -> DataFrame:
    """(fips, date, metrics) from a listing table whose columns go by several names."""
    month, fips = pick(raw, ["month_date_yyyymm", "month_date", "date", "month"]), pick(raw, ["county_fips", "fips", "geoid"])
    found = {n: pick(raw, names, n not in optional) for n, names in metrics.items()}
    cols = [(to_double(F.col(c)) if c else F.lit(None).cast("double")).alias(n) for n, c in found.items()]
    rows = raw.select(canonical_code(F.col(fips)).alias("fips"), month_start(F.col(month)).alias("date"), *cols)
    return rows.where("date IS NOT NULL AND fips <> ''")


def housing_features(inventory: DataFrame, hotness: DataFrame, yoy_offset: int = 1, fill: bool = True) -> DataFrame:
    """Yearly features from monthly inventory (fips, date, INVENTORY, demand) and hotness (fips, date, demand). Prices are compared December with December."""
    hot = hotness.groupBy("fips", "date").agg(F.avg("demand").alias("_hot"))
    both = inventory.join(hot, ["fips", "date"], "left")
    both = both.withColumns({"year": F.year("date"), "month": F.month("date"), "demand": F.coalesce("_hot", F.col("demand") if "demand" in inventory.columns else F.lit(None).cast("double"))})
    dec = lambda c, m: F.max(F.when(F.col("month") == m, F.col(c)))
    year = both.groupBy("fips", "year").agg(
        F.avg("active").alias("housing_active_inv"), F.coalesce(F.sum("new"), F.lit(0.0)).alias("housing_new_listings"), F.coalesce(F.sum("pending"), F.lit(0.0)).alias("housing_pending"),
        F.avg("dom").alias("housing_dom"), F.avg("price").alias("housing_med_list_price"), F.avg("demand").alias("housing_demand_score"),
        (divide(dec("price", 12), floored(dec("price", 11), 1.0)) - 1).alias("housing_price_mom"), (dec("dom", 12) - dec("dom", 11)).alias("housing_dom_mom"), dec("price", 12).alias("_december"),
    )
    p = previous_year(year, ["fips"], ["_december"], yoy_offset)
    inv = floored(F.col("housing_active_inv"), 1.0)
    out = p.withColumns({
        "housing_price_yoy": divide(F.col("_december"), floored(F.col("_december_prev"), 1.0)) - 1,
        "housing_turnover": divide(F.col("housing_new_listings") + F.col("housing_pending"), inv),
        "housing_absorption": divide(F.col("housing_pending"), inv),
    }).drop("_december", "_december_prev")
    names = [c for c in out.columns if c.startswith("housing_")]
    out = out.withColumns({c: finite(F.col(c)) for c in names})
    return impute_all(out, names) if fill else out


# addresses -------------------------------------------------------------------


def address_tracts(raw: DataFrame) -> DataFrame:
    """Tract totals and ratios from counts by class; optional vacancy buckets may be absent, rows without any count go."""
    has = {c.lower(): c for c in raw.columns}
    n = lambda c: to_double(F.col(has[c])) if c in has else F.lit(None).cast("double")
    z = lambda c: F.coalesce(n(c), F.lit(0.0))
    needed = ["ams_res", "ams_bus", "ams_oth", "res_vac", "bus_vac", "oth_vac", "nostat_res", "nostat_bus", "nostat_oth"]
    missing = [c for c in needed if c not in has]
    if missing:
        raise ValueError(f"missing columns {missing}")
    some = F.coalesce(*[n(c) for c in needed]).isNotNull()
    total = {k: z(f"ams_{k}") + z(f"{k}_vac") + z(f"nostat_{k}") for k in ("res", "bus", "oth")}
    address = total["res"] + total["bus"] + total["oth"]
    short = F.coalesce(n("vac_3_res"), n("res_vac"), F.lit(0.0))
    longer = [c for c in ("vac_3_6_r", "vac_6_12r", "vac_12_24r", "vac_24_36r", "vac_36_res") if c in has]
    long = sum((z(c) for c in longer), F.lit(0.0)) if longer else F.greatest(z("res_vac") - short, F.lit(0.0))
    rows = raw.where(some).select(
        zfill(F.trim(F.col(has["geoid"])), 11).alias("geoid"), address.alias("addresses"), total["res"].alias("res"), total["bus"].alias("bus"), total["oth"].alias("oth"),
        divide(z("nostat_res") + z("nostat_bus") + z("nostat_oth"), address).alias("flux"), short.alias("short_vacancy"), long.alias("long_vacancy"), z("nostat_res").alias("nostat_res"),
    )
    return rows.where("addresses > 0").withColumn("fips", F.substring("geoid", 1, 5))


def address_features(tracts: DataFrame, keys: list[str]) -> DataFrame:
    """County composites from tracts (keys, addresses, area, land_area, flux, bus, oth, res, short_vacancy, long_vacancy, nostat_res): one aggregation, no second pass."""
    a, area = F.col("addresses"), F.col("area")
    land = F.greatest(F.coalesce(F.max("land_area"), F.lit(0.0)), F.sum(area), F.lit(1e-6))
    total, density = F.greatest(F.sum(a), F.lit(1.0)), F.log1p(a / F.greatest(area, F.lit(1e-6)))
    res = F.when(F.sum("res") > 0, F.sum("res")).otherwise(F.greatest(F.sum(a) - F.sum("bus") - F.sum("oth"), F.lit(0.0)))
    return tracts.groupBy(*keys).agg(
        F.coalesce(divide(F.sum(a * F.col("flux")), F.sum(a)), F.lit(0.0)).alias("usps_flux_rate"),
        (F.sum("bus") / total).alias("usps_comm_ratio"), (F.sum("oth") / total).alias("usps_inst_ratio"),
        capped(F.sum(area) / land, 1.05).alias("usps_coverage_ratio"), F.log1p(total / land).alias("usps_log_density_land"),
        (F.sum(a * a) / (total * total)).alias("usps_address_hhi"),
        F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.percentile(density, F.lit(0.75)) - F.percentile(density, F.lit(0.25))).alias("usps_log_density_iqr"),
        res.alias("usps_total_res"), (F.sum("bus") / F.greatest(res, F.lit(1.0))).alias("usps_b2r_ratio"),
        (F.sum("short_vacancy") / F.greatest(F.sum("long_vacancy"), F.lit(1.0))).alias("usps_vacancy_aging_ratio"),
        (F.sum("nostat_res") / F.greatest(res, F.lit(1.0))).alias("usps_dormancy_index"),
    )


def with_velocity(features: DataFrame) -> DataFrame:
    """Relative change of residences against the year before; 0 where there is none."""
    p = previous_year(features, ["fips"], ["usps_total_res"])
    moved = divide(F.col("usps_total_res") - F.col("usps_total_res_prev"), floored(F.col("usps_total_res_prev"), 1.0))
    return p.withColumn("usps_residency_velocity", F.coalesce(finite(moved), F.lit(0.0))).drop("usps_total_res_prev")


# merge -----------------------------------------------------------------------


def merged_panel(base: DataFrame, labels: DataFrame, features: list[DataFrame]) -> DataFrame:
    """Base (fips, year) with features of all sources, missing ones at their year's median, and labels as the supervision has them."""
    out = base
    for f in features:
        names = [c for c in f.columns if c not in ("fips", "year")]
        out = out.join(f, ["fips", "year"], "left").withColumns({c: finite(F.col(c)) for c in names})
        out = impute_by(out, ["year"], names)
    return out.drop(*LABELS).join(labels.select("fips", "year", *LABELS), ["fips", "year"], "left")


def with_logs(panel: DataFrame) -> DataFrame:
    """Logs of level and truth, and whether a truth is there."""
    truth = F.coalesce(F.col("label_level") > 0, F.lit(False))
    return panel.withColumns({"pep_log": safe_ln(F.col("pep_population")), "y_log": safe_ln(F.col("label_level")), "has_truth": truth})

"""What is known of a county, fold, year or tract, attached to rows of results: each side's keys are told apart first, so that no join multiplies rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import finite
from ..functions.text import zfill
from .align import trajectory_rows

COUNTY = ["state_abbr", "county", "region", "division", "aland_sqkm"]
FOLD = ["topology_leakage_proxy", "relative_error_improvement_pct", "adjusted_relative_improvement_pct"]
YEAR = ["fit_mode", "has_truth", "graph_tag", "graph_kind", "graph_train_loss", "basis_align_mean_abs_corr", "community_ari", "grassmann_sqdist", "topology_common_counties"]


def coded(df: DataFrame) -> DataFrame:
    """fips and state as text of five and two digits."""
    code = lambda c, n: zfill(F.trim(F.col(c).cast("string")), n)
    return df.withColumns({"fips": code("fips", 5), "state": code("state", 2)})


def _kept(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row for each key, the least by those of the names that are there, null first; combined before the shuffle, whatever a key's number of rows."""
    there = [n for n in names if n in df.columns]
    if not there:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(F.min(F.struct(*there)).alias("_one")).select(*keys, *[F.col("_one")[n].alias(n) for n in there])


def county_meta(errors: DataFrame, lookup: DataFrame, stratum: Column) -> DataFrame:
    """A row for each county of the errors (fips, state, y_level) with its stratum and what the lookup (fips, state and COUNTY) says of it; NULL where it is not in the lookup."""
    one = _kept(errors, ["fips"], ["state", "y_level"]).withColumn("pop_stratum", stratum)
    return coded(one).join(_kept(coded(lookup), ["fips", "state"], COUNTY), ["fips", "state"], "left")


def with_fold_leakage(errors: DataFrame, folds: DataFrame) -> DataFrame:
    """Errors with the leakage and improvements (FOLD) of their fold and model; NULL for a pair that folds lacks."""
    return errors.join(_kept(folds, ["fold", "model"], FOLD), ["fold", "model"], "left")


def with_counties(pairs: DataFrame, lookup: DataFrame) -> DataFrame:
    """Pairs (fips, state, region, division) with names and land area where all four agree with the lookup, else NULL."""
    keys = ["fips", "state", "region", "division"]
    return coded(pairs).join(_kept(coded(lookup), keys, [c for c in COUNTY if c not in keys]), keys, "left")


def with_year_metrics(safety: DataFrame, metrics: DataFrame) -> DataFrame:
    """Yearly safety rows with the columns of YEAR that the metrics have; where a year has several rows, one of them."""
    return safety.join(_kept(metrics, ["year"], YEAR), "year", "left")


def placed(counties: DataFrame, marks: DataFrame) -> DataFrame:
    """Counties (fips and any geometry columns) that have a mark, such as a cluster or a dominant modality, with it. A county with several marks has a row for each."""
    return counties.join(marks, "fips")


def tract_rows(tracts: DataFrame, addresses: DataFrame) -> DataFrame:
    """Tracts (geoid, area, land_area) that have addresses (as panel.address_tracts gives them), ready for panel.address_features; a tract that comes twice counts once."""
    code = zfill(F.trim(F.col("geoid").cast("string")), 11)
    one = _kept(tracts.withColumn("geoid", code), ["geoid"], ["area", "land_area"])
    return one.join(_kept(addresses, ["geoid"], [c for c in addresses.columns if c != "geoid"]), "geoid")


def full_trajectory(df: DataFrame, run: dict[str, object]) -> DataFrame:
    """Rows of a year's corrections with errors, whether the year has a truth, and what its run was.

    df: fips, year, y_log, pep_log, corrected_log, corrected_sigma_log and the flows. run: family_year, fit_mode,
    graph_tag, graph_kind, graph_counties, graph_train_loss, basis_align_mean_abs_corr. has_truth is the year's: true where any county has one.
    """
    names = {"family_year": "int", "fit_mode": "string", "graph_tag": "string", "graph_kind": "string", "graph_counties": "int", "graph_train_loss": "double", "basis_align_mean_abs_corr": "double"}
    if missing := sorted(set(names) - set(run)):
        raise ValueError(f"missing: {missing}")
    rows = trajectory_rows(df).withColumns({n: F.lit(run[n]).cast(t) for n, t in names.items()}).withColumn("state", F.substring("fips", 1, 2))
    truths = rows.groupBy("year").agg(F.bool_or(finite(F.col("y_log")).isNotNull()).alias("has_truth"))
    return rows.join(F.broadcast(truths), "year", "left")  # a row for each year

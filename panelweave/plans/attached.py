"""Lookups attached to results, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.measures import stratum
from ..operators import attach as A
from ..operators import panel as P
from . import base as B
from .registry import query
from .relational import STRATA_SQL_7, r

_LOOKUP = "look AS (SELECT fips, state, 'S' || state AS state_abbr, 'county ' || fips AS county, CAST(division % 2 AS INT) AS region, division, acctbal AS aland_sqkm FROM counties WHERE acctbal > 0)"


def lookup(s, d):
    """Counties with a positive balance, half of them twice and some with codes that have lost their zeros."""
    c = B.counties(s, d).where("acctbal > 0")
    rows = c.select(F.col("fips").cast("int").cast("string").alias("fips"), F.col("state").cast("int").cast("string").alias("state"), F.concat(F.lit("S"), "state").alias("state_abbr"), F.concat(F.lit("county "), "fips").alias("county"), (F.col("division") % 2).alias("region"), "division", F.col("acctbal").alias("aland_sqkm"))
    return rows.union(rows.where("CAST(fips AS INT) % 2 = 0"))


@query("WITH " + B.ERRORS + ", " + _LOOKUP + f", one AS (SELECT fips, min(state) AS state, min(truth) AS y_level FROM errors GROUP BY fips) SELECT o.fips, o.state, y_level, {STRATA_SQL_7.format(x='y_level / 1000')} AS pop_stratum, state_abbr, county, region, l.division, aland_sqkm FROM one o LEFT JOIN look l ON o.fips = l.fips AND o.state = l.state")
def county_meta_of_errors(s, d):
    e = B.errors(s, d).withColumnRenamed("truth", "y_level")
    return A.county_meta(e, lookup(s, d), stratum(F.col("y_level") / 1000)).select("fips", "state", "y_level", "pop_stratum", *A.COUNTY)


@query("WITH " + B.ERRORS + " SELECT fips, year, fold, model, round(ape, 6) AS ape, CASE WHEN model = 'mid' AND fold <> 2 THEN fold * 0.05::DOUBLE END AS topology_leakage_proxy FROM errors")
def errors_with_fold_leakage(s, d):
    e = B.errors(s, d)
    folds = e.where("model = 'mid' AND fold <> 2").select("fold", "model", (F.col("fold") * F.lit(0.05)).alias("topology_leakage_proxy"))  # a row for each county: one counts
    return A.with_fold_leakage(e, folds).select("fips", "year", "fold", "model", r("ape").alias("ape"), "topology_leakage_proxy")


@query("WITH " + B.PANEL + ", " + _LOOKUP + " SELECT p.fips, p.year, l.county, l.aland_sqkm FROM panel p LEFT JOIN look l ON p.fips = l.fips AND p.state = l.state AND l.region = 1 AND p.division = l.division")
def pairs_with_county_lookup(s, d):
    """Pairs that all say region 1: counties of region 0 find nothing."""
    p = B.panel(s, d).withColumn("region", F.lit(1))
    return A.with_counties(p, lookup(s, d)).select("fips", "year", "county", "aland_sqkm")


@query("WITH " + B.YEARLY + " SELECT year, count(*) AS n, CASE WHEN year <> 1995 THEN 'mode ' || year END AS fit_mode, CASE WHEN year <> 1995 THEN year / 10.0::DOUBLE END AS graph_train_loss FROM yearly GROUP BY year")
def year_safety_with_metrics(s, d):
    y = B.yearly(s, d)
    metrics = y.where("year <> 1995").select("year", F.concat(F.lit("mode "), F.col("year").cast("string")).alias("fit_mode"), (F.col("year") / 10.0).alias("graph_train_loss"), "level")
    return A.with_year_metrics(y.groupBy("year").agg(F.count(F.lit(1)).alias("n")), metrics).select("year", "n", "fit_mode", "graph_train_loss")


@query("WITH " + B.COUNTIES + ", m AS (SELECT fips, count(*) % 4 AS cluster FROM " + "(SELECT lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(5, length(CAST(o_custkey AS VARCHAR))) AS INT), '0') AS fips FROM orders) GROUP BY fips) SELECT c.fips, acctbal, CAST(cluster AS BIGINT) AS cluster FROM counties c JOIN m USING (fips)")
def counties_with_cluster(s, d):
    marks = B.orders(s, d).groupBy("fips").agg((F.count(F.lit(1)) % 4).alias("cluster"))
    return A.placed(B.counties(s, d).select("fips", "acctbal"), marks)


@query("WITH a AS (SELECT s_suppkey AS g, 10 + s_suppkey % 7 + s_nationkey AS addresses FROM supplier WHERE s_suppkey % 5 <> 0), t AS (SELECT DISTINCT c_custkey AS g, (1 + c_custkey % 9)::DOUBLE AS area FROM customer) SELECT lpad(CAST(g AS VARCHAR), 11, '0') AS geoid, area, addresses::DOUBLE AS addresses FROM t JOIN a USING (g)")
def tracts_with_addresses(s, d):
    """Suppliers as address counts, customers as tracts, some of them twice."""
    n = F.col
    raw = B.table(s, d, "supplier").where("s_suppkey % 5 <> 0").select(n("s_suppkey").cast("string").alias("GEOID"), F.lit(10).alias("AMS_RES"), (n("s_suppkey") % 7).alias("AMS_BUS"), n("s_nationkey").alias("AMS_OTH"), *[F.lit(0).alias(c) for c in ("RES_VAC", "BUS_VAC", "OTH_VAC", "NOSTAT_RES", "NOSTAT_BUS", "NOSTAT_OTH")])
    t = B.table(s, d, "customer").select(n("c_custkey").alias("geoid"), (1.0 + n("c_custkey") % 9).alias("area"), F.lit(5.0).alias("land_area"))
    return A.tract_rows(t.union(t.where("geoid % 3 = 0")), P.address_tracts(raw)).select("geoid", "area", "addresses")


@query("WITH " + B.PANEL + " SELECT fips, year, substr(fips, 1, 2) AS state, year % 2 = 0 AS has_truth, 2020 AS family_year, 'anchor' AS fit_mode, 'g' AS graph_tag, 0.25::DOUBLE AS graph_train_loss, CASE WHEN year % 2 = 0 THEN round(abs(base - truth) / truth * 100, 5) END AS pep_ape FROM panel")
def full_trajectory_rows(s, d):
    p = B.panel(s, d).select("fips", "year", F.when(F.col("year") % 2 == 0, F.log("truth")).alias("y_log"), F.log("base").alias("pep_log"), F.log("base").alias("corrected_log"))
    run = {"family_year": 2020, "fit_mode": "anchor", "graph_tag": "g", "graph_kind": "knn", "graph_counties": 5, "graph_train_loss": 0.25, "basis_align_mean_abs_corr": None}
    return A.full_trajectory(p, run).select("fips", "year", "state", "has_truth", "family_year", "fit_mode", "graph_tag", "graph_train_loss", r("pep_ape_pct", 5).alias("pep_ape"))

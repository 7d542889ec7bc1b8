"""Baseline against treatment: county and state pairs, tails, safety over years, leakage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.geography import with_geography
from ..functions.measures import STRATA_5, albers, ape, outcome, stratum, symmetric_ratio
from .relational import many_to_one, one_to_one, pearson

TOLERANCE = 1e-9


def county_pairs(errors: DataFrame, baseline: str, treatment: str, proxy: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per county: both models' errors, the fold's mean improvement, the leakage scale and the adjusted difference. proxy: (fold, leakage)."""
    keys = ["fips", "state", "fold"]
    of = lambda name: F.lower("model") == name.lower()
    base = errors.where(of(baseline)).select(*keys, "y_level", F.col("ape_pop_pct").alias("baseline_ape"), F.col("abs_err_log").alias("baseline_abs_log"), F.col("pred_level").alias("baseline_level"))
    treat = errors.where(of(treatment)).select(*keys, F.col("ape_pop_pct").alias("treatment_ape"), F.col("abs_err_log").alias("treatment_abs_log"), F.col("pred_level").alias("treatment_level"))
    both = one_to_one(base, treat, keys).join(F.broadcast(proxy.select("fold", F.col("leakage").alias("_leak"))), "fold", "left")  # one row per fold
    both = both.withColumn("leakage", F.coalesce("_leak", F.lit(0.0))).drop("_leak")
    both = both.withColumn("delta", F.col("baseline_ape") - F.col("treatment_ape")).withColumn("fold_mean_delta", F.avg("delta").over(W.partitionBy("fold")))
    scale = F.greatest(F.lit(0.0), F.when(F.col("fold_mean_delta") > 0, 1 - F.col("leakage")).otherwise(1.0))
    both = both.withColumn("adjustment_scale", scale).withColumn("adjusted_delta", F.col("delta") * F.col("adjustment_scale"))
    return both.withColumns({"outcome": outcome(F.col("adjusted_delta"), tolerance), "analysis_stratum": stratum(F.col("y_level"), STRATA_5)})


def with_blocks(pairs: DataFrame, centroids: DataFrame, side_km: float = 250.0) -> DataFrame:
    """Adds x, y in km and the id division:column:row of each county's block. A county without a centroid raises."""
    x, y = albers(F.col("lon"), F.col("lat"))
    both = pairs.join(centroids.select("fips", "lon", "lat"), "fips", "left")
    bad = F.raise_error(F.concat(F.lit("no centroid: "), F.col("fips")))
    both = both.withColumn("lon", F.when(F.col("lon").isNull(), bad.cast("double")).otherwise(F.col("lon"))).withColumns({"x_km": x / 1000, "y_km": y / 1000})
    return both.withColumn("block_id", block_id(F.col("division"), F.col("x_km"), F.col("y_km"), side_km))


def block_id(division, x_km, y_km, side_km: float):
    cell = lambda v: F.floor(v / side_km).cast("long").cast("string")
    return F.concat_ws(":", division, cell(x_km), cell(y_km))


def state_pairs(pairs: DataFrame, tolerance: float = TOLERANCE, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per state (and extra keys): sums, errors of the summed levels, shares of wins, outcomes."""
    keys = ["state", *extra]
    total = pairs.groupBy(*keys).agg(
        F.countDistinct("fips").alias("n_counties"), F.sum("y_level").alias("truth"), F.sum("baseline_level").alias("baseline_sum"), F.sum("treatment_level").alias("treatment_sum"),
        F.avg("baseline_ape").alias("baseline_mape"), F.avg("treatment_ape").alias("treatment_mape"), F.avg("adjusted_delta").alias("mean_adjusted_delta"),
        F.avg("leakage").alias("mean_leakage"), F.avg((F.col("outcome") == "win").cast("double")).alias("share_win"), F.avg((F.col("outcome") == "loss").cast("double")).alias("share_loss"),
    )
    total = total.withColumns({"baseline_state_ape": ape(F.col("baseline_sum"), F.col("truth")), "treatment_state_ape": ape(F.col("treatment_sum"), F.col("truth"))})
    rel = F.try_divide(F.col("baseline_state_ape") - F.col("treatment_state_ape"), F.greatest("baseline_state_ape", F.lit(1e-9)))
    adj = F.when(rel > 0, rel * (1 - F.col("mean_leakage"))).otherwise(rel)
    total = total.withColumns({"state_relative": rel, "state_adjusted": adj, "state_delta": F.col("baseline_state_ape") * adj})
    total = total.withColumns({"outcome_mean": outcome(F.col("mean_adjusted_delta"), tolerance), "outcome_state": outcome(F.col("state_delta"), tolerance)})
    return with_geography(total)


def state_stratum_pairs(pairs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    return state_pairs(pairs, tolerance, ("analysis_stratum",))


def tail_enrichment(pairs: DataFrame, share: float = 0.9, small: float = 25_000) -> DataFrame:
    """Per state: the share of small counties inside and outside the tail of the largest baseline errors."""
    cut = pairs.groupBy("state").agg(F.percentile("baseline_ape", F.lit(share)).alias("cutoff"))
    both = pairs.join(cut, "state").withColumn("_in", F.col("baseline_ape") >= F.col("cutoff")).withColumn("_small", (F.col("y_level") < small).cast("double"))
    return both.groupBy("state").agg(F.max("cutoff").alias("cutoff"), F.sum(F.col("_in").cast("long")).alias("n_tail"), F.avg(F.when(F.col("_in"), F.col("_small"))).alias("share_in"), F.avg(F.when(~F.col("_in"), F.col("_small"))).alias("share_out"))


def safety_rows(trajectory: DataFrame, anchor: int, last: int, log_bound: float = 0.25, growth_bound: float = 1.10) -> DataFrame:
    """Rows after the anchor year with the size of the correction and both growth ratios, and whether they keep their bounds."""
    rows = trajectory.where((F.col("year") > anchor) & (F.col("year") <= last)).withColumn("correction", F.abs(F.col("corrected_log") - F.col("pep_log")))
    rows = rows.withColumn("growth_ratio", symmetric_ratio(F.exp("corrected_log"), F.exp("pep_log")))
    return rows.withColumns({"in_bound": F.col("correction") <= log_bound, "growth_ok": F.col("growth_ratio") <= growth_bound})


def year_safety(trajectory: DataFrame, anchor: int, last: int, **bounds: float) -> DataFrame:
    rows = safety_rows(trajectory, anchor, last, **bounds)
    share = lambda c: F.avg(F.col(c).cast("double"))
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.avg("correction").alias("mean_correction"), F.max("correction").alias("max_correction"), share("in_bound").alias("share_in_bound"), share("growth_ok").alias("share_growth_ok"))


def metrics_table(errors: DataFrame, scales: DataFrame) -> DataFrame:
    """Per model: errors, and correlations guarded against constant sides, with predictions pulled to the baseline by the fold's scale (fold, model, scale)."""
    both = many_to_one(errors, scales.select("fold", "model", "scale"), ["fold", "model"]).withColumn("_s", F.coalesce("scale", F.lit(1.0)))
    both = both.withColumn("adjusted_correction", (F.col("pred_log") - F.col("pep_log")) * F.col("_s"))
    c = F.col
    return both.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ape_pop_pct").alias("mape_pop_pct"), F.avg("abs_err_log").alias("mae_log"),
        pearson(c("pred_log") - c("pep_log"), c("y_log") - c("pep_log")).alias("residual_corr"), pearson(c("pred_log"), c("y_log")).alias("signal_corr"),
        pearson(c("adjusted_correction"), c("y_log") - c("pep_log")).alias("adjusted_residual_corr"),
    )


def leakage_table(fold_metrics: DataFrame) -> DataFrame:
    """Per model: mean leakage and what it takes off the improvement."""
    return fold_metrics.groupBy("model").agg(F.avg("leakage").alias("mean_leakage"), F.avg("relative").alias("mean_relative"), F.avg("attributable").alias("mean_attributable"), F.avg("adjusted").alias("mean_adjusted"))


def best_contender(fold_summary: DataFrame, metric: str, baseline: str = "pep") -> DataFrame:
    """The model with the least metric besides the baseline; equal ones by name."""
    return fold_summary.where(F.col("model") != baseline).agg(F.min_by("model", F.struct(metric, "model")).alias("model"), F.min(metric).alias(metric))

"""Tests of an improvement: spatial HAC, sign flips, sign and majority tests, cluster bootstrap, and the suite that runs them.

Influence, blocks and block pairs are relational; what is left for the driver
are a few numbers per block, a bounded set.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window as W

from ..functions.distributions import binom_upper, clopper_pearson, t_cdf, t_quantile

RESULT = "hypothesis string, subset string, metric string, threshold double, test_name string, estimate double, ci_low double, ci_high double, p_value double, n_obs long, n_groups long, passed boolean, note string"


def influence(rows: DataFrame, numerator: str, denominator: str) -> DataFrame:
    """Adds psi, the influence of a row on 100 * mean(numerator) / mean(denominator), and its share of mass."""
    n, d = F.col(numerator).cast("double"), F.col(denominator).cast("double")
    t = rows.agg(F.count(F.lit(1)).alias("_n"), F.avg(n).alias("_mn"), F.avg(d).alias("_md"), F.sum(d).alias("_sd"))
    both = rows.crossJoin(F.broadcast(t))  # one row
    theta = F.try_divide(F.col("_mn"), F.col("_md"))
    both = both.withColumn("psi", F.try_divide(100 * (n - theta * d), F.col("_md") * F.col("_n")))
    return both.withColumn("mass", F.coalesce(F.try_divide(100 * n, F.col("_sd")), F.lit(0.0))).drop("_n", "_mn", "_md", "_sd")


def block_sums(rows: DataFrame, numerator: str, denominator: str) -> DataFrame:
    """Per block: summed influence and mass, mean place, division, size."""
    return influence(rows, numerator, denominator).groupBy("block_id").agg(F.sum("psi").alias("g"), F.sum("mass").alias("m"), F.avg("x_km").alias("x"), F.avg("y_km").alias("y"), F.min("division").alias("division"), F.count(F.lit(1)).alias("n"))


def hac_variance(blocks: DataFrame, bandwidth_km: float) -> DataFrame:
    """One row: number of blocks and the Bartlett variance over pairs of blocks of one division, never below 0."""
    a, b = blocks.select(F.col("block_id").alias("i"), F.col("g").alias("gi"), F.col("x").alias("xi"), F.col("y").alias("yi"), "division"), blocks.select(F.col("block_id").alias("j"), F.col("g").alias("gj"), F.col("x").alias("xj"), F.col("y").alias("yj"), "division")
    dist = F.sqrt(F.pow(F.col("xi") - F.col("xj"), 2) + F.pow(F.col("yi") - F.col("yj"), 2))
    k = F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.greatest(1 - dist / bandwidth_km, F.lit(0.0)))
    total = a.join(b, "division").agg(F.sum(F.col("gi") * k * F.col("gj")).alias("s"))
    n = blocks.agg(F.count(F.lit(1)).alias("n_blocks"))
    return n.crossJoin(total).select("n_blocks", F.greatest(F.lit(0.0), F.try_divide(F.col("n_blocks").cast("double"), F.col("n_blocks") - 1) * F.col("s")).alias("variance"))


def sign_flip(scores: np.ndarray, threshold: float = 0.0, draws: int = 20_000, seed: int = 0, exact_up_to: int = 20) -> float:
    """p = (1 + #{flipped mean >= mean}) / (N + 1): all signs for few blocks, seeded draws for more."""
    s = np.asarray(scores, float) - threshold
    n, seen = len(s), 0
    if n == 0:
        return float("nan")
    observed = s.mean() - 1e-12
    if n <= exact_up_to:
        bits = np.arange(1 << n)
        total = np.zeros(1 << n)
        for i in range(n):
            total += np.where(bits >> i & 1, s[i], -s[i])
        return float((1 + (total / n >= observed).sum()) / ((1 << n) + 1))
    rng = np.random.default_rng(seed)
    for at in range(0, draws, 4096):
        signs = rng.integers(0, 2, (min(4096, draws - at), n)) * 2 - 1
        seen += int((signs @ s / n >= observed).sum())
    return (1 + seen) / (draws + 1)


def sign_flip_all(scores: np.ndarray, threshold: float = 0.0) -> float:
    """sign_flip's p over all 2^n signs: sums of either half, one of them sorted, so that 25 blocks take 2^13 values and 40 take 2^20."""
    s = np.asarray(scores, float) - threshold
    n = len(s)
    if n == 0:
        return float("nan")

    def sums(x: np.ndarray) -> np.ndarray:
        out = np.zeros(1)
        for v in x:
            out = np.concatenate([out + v, out - v])
        return out

    left, right = sums(s[: n // 2]), np.sort(sums(s[n // 2 :]))
    seen = int((len(right) - np.searchsorted(right, (s.mean() - 1e-12) * n - left)).sum())
    return (1 + seen) / ((1 << n) + 1)


def weighted_flip(values: np.ndarray, weights: np.ndarray, threshold: float = 0.0, draws: int = 20_000, seed: int = 0) -> tuple[float, float]:
    """Weighted mean and one-sided p of seeded sign flips around the threshold."""
    w = np.asarray(weights, float) / np.sum(weights)
    c = w * (np.asarray(values, float) - threshold)
    rng, seen = np.random.default_rng(seed), 0
    for at in range(0, draws, 4096):
        signs = rng.integers(0, 2, (min(4096, draws - at), len(c))) * 2 - 1
        seen += int((signs @ c >= c.sum() - 1e-12).sum())
    return float(c.sum() + threshold), (1 + seen) / (draws + 1)


def hac_test(rows: DataFrame, numerator: str, denominator: str, threshold: float, bandwidth_km: float, alpha: float = 0.05, least_blocks: int = 41, seed: int = 0) -> dict:
    """Ratio estimate in percent with a spatial t-test; with few blocks a sign flip of their mass scores."""
    blocks = block_sums(rows, numerator, denominator).persist()
    try:
        t = rows.agg(F.count(F.lit(1)), F.avg(F.col(numerator).cast("double")), F.avg(F.col(denominator).cast("double"))).first()
        n_blocks, variance = hac_variance(blocks, bandwidth_km).first()
        theta = 100 * t[1] / t[2] if t[0] and t[2] else float("nan")
        out = {"estimate": theta, "n_obs": t[0], "n_groups": n_blocks, "threshold": threshold}
        if n_blocks < least_blocks:
            scores = [r.m * n_blocks for r in blocks.select("m").orderBy("m").collect()]  # under least_blocks rows
            p = sign_flip(np.array(scores), threshold, seed=seed)
            return out | {"test_name": "block_sign_flip", "p_value": p, "ci_low": None, "ci_high": None, "passed": bool(theta > threshold and p < alpha)}
        se, df = math.sqrt(variance or 0.0), n_blocks - 1
        p = (1 - t_cdf((theta - threshold) / se, df)) if se > 0 else float(theta <= threshold)
        q = t_quantile(1 - alpha / 2, df)
        return out | {"test_name": "spatial_hac_t", "p_value": p, "ci_low": theta - q * se, "ci_high": theta + q * se, "passed": bool(theta > threshold and p < alpha)}
    finally:
        blocks.unpersist()


@pandas_udf(DoubleType())
def binomial_tail(k: pd.Series, n: pd.Series, share: pd.Series) -> pd.Series:
    """P(X >= k) of n draws with a share each; null where one is null."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) or pd.isna(q) else binom_upper(int(a), int(b), float(q)) for a, b, q in zip(k, n, share, strict=True)], dtype=float)


@pandas_udf(StructType([StructField("low", DoubleType()), StructField("high", DoubleType())]))
def binomial_interval(k: pd.Series, n: pd.Series, alpha: pd.Series) -> pd.DataFrame:
    """The exact interval of a share of which k of n have been seen; null where there are no draws."""
    pairs = [(None, None) if pd.isna(a) or pd.isna(b) or b < 1 else clopper_pearson(int(a), int(b), float(q)) for a, b, q in zip(k, n, alpha, strict=True)]
    return pd.DataFrame(pairs, columns=["low", "high"], dtype=float)


def sign_counts(rows: DataFrame, value: str, tolerance: float = 1e-9) -> DataFrame:
    v = F.col(value)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return rows.agg(n(v > tolerance).alias("wins"), n(v < -tolerance).alias("losses"), n(F.abs(v) <= tolerance).alias("ties"))


def sign_test(rows: DataFrame, value: str, share: float = 0.5, tolerance: float = 1e-9, alpha: float = 0.05) -> dict:
    """Share of wins among those that are no ties, its exact tail and Clopper-Pearson interval."""
    wins, losses, ties = sign_counts(rows, value, tolerance).first()
    return _binomial(wins, wins + losses, share, alpha, "exact_sign", wins + losses + ties)


def majority_test(k: int, n: int, share: float, alpha: float = 0.05) -> dict:
    """Whether more than a share of n cases have a property that k have."""
    return _binomial(k, n, share, alpha, "exact_binomial", n)


def _binomial(k: int, n: int, share: float, alpha: float, name: str, n_obs: int) -> dict:
    if not n:
        return {"test_name": name, "estimate": None, "p_value": 1.0, "ci_low": None, "ci_high": None, "n_obs": n_obs, "n_groups": 0, "threshold": share, "passed": False}
    low, high = clopper_pearson(k, n, alpha)
    p = binom_upper(k, n, share)
    return {"test_name": name, "estimate": k / n, "p_value": p, "ci_low": low, "ci_high": high, "n_obs": n_obs, "n_groups": n, "threshold": share, "passed": bool(k / n > share and p < alpha)}


def drawn_clusters(sums: DataFrame, cluster: str, stratum: str, draws: int, seed: int = 0) -> DataFrame:
    """sums of every drawn cluster with its draw: as many clusters as a stratum has, with replacement, in each draw. A hash picks them, so that a repeated task draws the same."""
    numbered = sums.withColumn("_j", F.row_number().over(W.partitionBy(stratum).orderBy(cluster)))
    size = F.count(F.lit(1)).over(W.partitionBy(stratum))
    slots = numbered.select(F.col(stratum).alias("_stratum"), "_j", size.alias("_n")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    pick = F.pmod(F.xxhash64("_stratum", "draw", "_j", F.lit(seed)), F.col("_n")) + 1
    picked = slots.select("_stratum", "draw", pick.alias("_pick"))
    return picked.join(numbered, F.col("_stratum").eqNullSafe(F.col(stratum)) & (F.col("_pick") == F.col("_j"))).drop("_stratum", "_pick", "_j")


def cluster_bootstrap(rows: DataFrame, value: str, cluster: str, stratum: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """(draw, mean): in each stratum as many clusters as it has, drawn with replacement; the mean over all their rows."""
    sums = rows.groupBy(stratum, cluster).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    return drawn_clusters(sums, cluster, stratum, draws, seed).groupBy("draw").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean"))


def bootstrap_test(rows: DataFrame, value: str, cluster: str, stratum: str, threshold: float = 0.0, alpha: float = 0.05, draws: int = 2000, seed: int = 0) -> dict:
    """One-sided: the share of draws at or under the threshold."""
    d = cluster_bootstrap(rows, value, cluster, stratum, draws, seed).where("mean IS NOT NULL")
    r = d.agg(F.percentile("mean", F.lit(alpha / 2)), F.percentile("mean", F.lit(1 - alpha / 2)), F.sum((F.col("mean") <= threshold).cast("long")), F.count(F.lit(1))).first()
    est = rows.agg(F.avg(F.col(value).cast("double")), F.count(F.lit(1))).first()
    p = (1 + (r[2] or 0)) / (r[3] + 1)
    return {"test_name": "cluster_bootstrap", "estimate": est[0], "ci_low": r[0], "ci_high": r[1], "p_value": p, "n_obs": est[1], "n_groups": rows.select(cluster).distinct().count(), "threshold": threshold, "passed": bool(est[0] is not None and est[0] > threshold and p < alpha)}


def result_rows(spark: SparkSession, found: list[tuple[str, str, str, dict]]) -> DataFrame:
    """Uniform rows of test results; what is not finite becomes NULL."""

    def num(v: object) -> float | None:
        return float(v) if v is not None and math.isfinite(float(v)) else None

    rows = [(h, s, m, num(d.get("threshold")), d["test_name"], num(d.get("estimate")), num(d.get("ci_low")), num(d.get("ci_high")), num(d.get("p_value")), int(d.get("n_obs") or 0), int(d.get("n_groups") or 0), bool(d.get("passed")), d.get("note", "")) for h, s, m, d in found]
    return spark.createDataFrame(rows, RESULT)


def suite(pairs: DataFrame, states: DataFrame, safety: DataFrame, bandwidth_km: float = 500.0, hard_quantile: float = 0.9, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """County, hard cases, weighted states, state majority, strata, worst tail and both safety bounds."""
    from ..sources.sinks import written
    from .relational import tail

    spark, out = pairs.sparkSession, []
    # every test reads them again: written once, they are not computed for each
    pairs, states = written(pairs, "pairs"), written(states, "states")
    hac = lambda rows: hac_test(rows, "adjusted_delta", "baseline_ape", 0.0, bandwidth_km, alpha, seed=seed)
    out.append(("county", "all", "adjusted_improvement_pct", hac(pairs)))
    out.append(("hard_cases", f"q{hard_quantile:g}", "adjusted_improvement_pct", hac(tail(pairs, "baseline_ape", hard_quantile, True))))
    s = states.select("state", "state_delta", "truth").where("state_delta IS NOT NULL AND truth > 0").orderBy("state").collect()  # one row per state
    if s:
        est, p = weighted_flip(np.array([r.state_delta for r in s]), np.array([r.truth for r in s]), seed=seed)
        out.append(("state_weighted", "all", "state_delta", {"test_name": "weighted_sign_flip", "estimate": est, "p_value": p, "n_obs": len(s), "n_groups": len(s), "threshold": 0.0, "passed": est > 0 and p < alpha}))
    out.append(("state_majority", "all", "mean_adjusted_delta", sign_test(states, "mean_adjusted_delta", alpha=alpha)))
    for name in [r[0] for r in pairs.select("analysis_stratum").where("analysis_stratum IS NOT NULL").distinct().orderBy("analysis_stratum").collect()]:
        out.append(("stratum", name, "adjusted_improvement_pct", hac(pairs.where(F.col("analysis_stratum") == name))))
    worst = tail(pairs, "adjusted_delta", 1 - hard_quantile, False)
    r = worst.agg(F.sum((F.col("y_level") < 25_000).cast("long")), F.count(F.lit(1))).first()
    out.append(("worst_tail", "small_counties", "share", majority_test(r[0] or 0, r[1], 0.5, alpha)))
    r = safety.agg(F.sum(F.col("in_bound").cast("long")), F.sum(F.col("growth_ok").cast("long")), F.count(F.lit(1))).first()
    out.append(("safety", "correction", "share", majority_test(r[0] or 0, r[2], 0.95, alpha)))
    out.append(("safety", "growth", "share", majority_test(r[1] or 0, r[2], 0.95, alpha)))
    return result_rows(spark, out)

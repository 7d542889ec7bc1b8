"""Strict evaluation over (fold, spec), its rollups, and the recursion over later years."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.measures import adjusted_improvement, attributable, crps, log_ape, relative_improvement, stratum, stratum_rank
from ..functions.vectors import all_finite
from ..sources.sinks import written
from .kernels import KINDS, held_out, kernel_ridge
from .models import Linear, capped_delta, fit, fits, predicted
from .moments import fold_fits, model_rows
from .relational import pearson

#: Feature sets of the strict evaluation: name -> (blocks, whether the target is the residual to the baseline).
SPECS = {
    "pep": ((), True), "mem": (("mem",), True), "embeddings": (("embeddings",), True), "embeddings_mem": (("embeddings", "mem"), True),
    "embeddings_only": (("embeddings",), False), "embeddings_mem_only": (("embeddings", "mem"), False),
}


def work_list(panel: DataFrame, folds: list[int], specs: list[str]) -> DataFrame:
    """One copy of the panel's rows for every (fold, spec) except the baseline, with features, target and role."""
    parts = []
    for s in specs:
        blocks, residual = SPECS[s]
        if not blocks:
            continue
        x = F.concat(*[F.col(b).cast("array<double>") for b in blocks])
        target = F.col("y_log") - F.col("pep_log") if residual else F.col("y_log")
        parts.append(panel.select("*", F.lit(s).alias("model"), x.alias("x"), target.alias("target"), F.lit(residual).alias("residual")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.where(all_finite(F.col("x")) & F.col("y_log").isNotNull() & F.col("pep_log").isNotNull())
    out = out.withColumn("k", F.explode(F.array(*[F.lit(k) for k in folds])))
    return out.withColumns({"item": F.concat_ws("|", "k", "model"), "test": F.col("fold") == F.col("k")})


def spec_lengths(panel: DataFrame, specs: list[str]) -> dict[str, int]:
    """The number of features of each spec."""
    blocks = sorted({b for s in specs for b in SPECS[s][0]})
    widths = panel.select(*[F.max(F.size(b)).alias(b) for b in blocks]).first()
    return {s: sum(widths[b] or 0 for b in SPECS[s][0]) for s in specs}


def spec_rows(panel: DataFrame, specs: list[str], residual: dict[str, bool], length: dict[str, int]) -> DataFrame:
    """A row of the panel for each spec that has features: spec (its place in the list), x padded with zeros to one length, y. Nothing is copied by fold."""
    parts = []
    for i, s in enumerate(specs):
        x = F.concat(*[F.col(b).cast("array<double>") for b in SPECS[s][0]])
        pad = F.array_repeat(F.lit(0.0), max(length.values()) - length[s])
        y = F.col("y_log") - F.col("pep_log") if residual[s] else F.col("y_log")
        sound = panel.where(all_finite(x) & F.col("y_log").isNotNull() & F.col("pep_log").isNotNull() & (F.size(x) == length[s]))
        parts.append(sound.select("fips", "state", F.col("fold").cast("int").alias("fold"), "y_log", "pep_log", F.lit(i).alias("spec"), F.concat(x, pad).alias("x"), y.alias("y")))
    return reduce(DataFrame.unionByName, parts)


def strict_errors(panel: DataFrame, folds: list[int], specs: list[str], kind: str = "huber", grouped: bool = False, **options) -> DataFrame:
    """Out-of-fold predictions of every spec and the baseline: fips, state, fold, model, logs, sigma and errors.

    Ridge and Huber fits (options: alpha, epsilon, n_components) come from merged moments of all folds and specs, so that
    no task holds a training set; kernel_ridge and kernel_huber (options: name, alpha, epsilon, gamma, landmarks) from
    merged moments of kernel columns.
    Other kinds and options, or grouped, fit each (fold, spec) in one task of its own.
    """
    if kind not in KINDS and (grouped or kind not in ("huber", "ridge") or set(options) - {"alpha", "epsilon", "n_components"}):
        items = work_list(panel, folds, specs)
        models = fits(items.where(~F.col("test")), "item", "x", "target", kind, **options)
        scored = items.where("test").join(F.broadcast(models), "item")  # folds x specs rows
    else:
        named = [s for s in specs if SPECS[s][0]]
        length = spec_lengths(panel, named)
        rows = spec_rows(panel, named, {s: SPECS[s][1] for s in named}, length)
        known_folds = rows.where(F.col("fold").isNotNull())
        told = {"model": F.element_at(F.array(*map(F.lit, named)), F.col("spec") + 1), "residual": F.element_at(F.array(*[F.lit(SPECS[s][1]) for s in named]), F.col("spec") + 1)}
        if kind in KINDS:
            scored = held_out(known_folds, folds, kind, lengths=[length[s] for s in named], **options).withColumns(told)
        else:
            found = model_rows(fold_fits(known_folds, folds, kind, **options), panel.sparkSession).withColumns(told)
            scored = rows.join(F.broadcast(found.withColumnRenamed("k", "fold")), ["spec", "fold"])  # folds x specs rows
    raw = F.col("raw") if kind in KINDS else predicted(F.col("x"))
    pred = F.when(F.col("residual"), F.col("pep_log") + raw).otherwise(raw)
    own = scored.select("fips", "state", "fold", "model", "y_log", "pep_log", pred.alias("pred_log"), "sigma")
    known = panel.where("y_log IS NOT NULL AND pep_log IS NOT NULL")
    base_sigma = known.agg(F.greatest(F.stddev_pop(F.col("y_log") - F.col("pep_log")), F.lit(1e-6)).alias("sigma"))
    base = known.crossJoin(F.broadcast(base_sigma)).select("fips", "state", "fold", F.lit("pep").alias("model"), "y_log", "pep_log", F.col("pep_log").alias("pred_log"), "sigma")
    return with_errors(own.unionByName(base))


def with_errors(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "true_resid_log": F.col("y_log") - F.col("pep_log"), "pred_correction_log": F.col("pred_log") - F.col("pep_log"),
        "abs_err_log": F.abs(F.col("pred_log") - F.col("y_log")), "ape_pop_pct": log_ape(F.col("pred_log"), F.col("y_log")),
    })


def fold_metrics(errors: DataFrame, leak: DataFrame, graph_models: list[str]) -> DataFrame:
    """Per (fold, model): errors, correlations and the improvement over the baseline less what leaks. leak: (fold, share)."""
    m = errors.groupBy("fold", "model").agg(
        F.count(F.lit(1)).alias("n_test"), F.avg("abs_err_log").alias("mae_log"), F.avg("ape_pop_pct").alias("mape_pop_pct"),
        F.avg(crps(F.col("y_log"), F.col("pred_log"), F.col("sigma"))).alias("crps"),
        pearson(F.col("pred_correction_log"), F.col("true_resid_log")).alias("residual_corr"), pearson(F.col("pred_log"), F.col("y_log")).alias("signal_corr"),
    )
    m = m.join(leak, "fold", "left").withColumn("leakage", F.when(F.col("model").isin(graph_models), F.coalesce("share", F.lit(0.0))).otherwise(0.0)).drop("share")
    return with_improvement(m)


def with_improvement(metrics: DataFrame) -> DataFrame:
    """Adds the baseline's error of the same fold, the relative, attributable and adjusted improvement, and the adjusted error."""
    base = F.max(F.when(F.col("model") == "pep", F.col("mape_pop_pct"))).over(W.partitionBy("fold"))
    m = metrics.withColumn("pep_mape", base)
    m = m.withColumn("relative", relative_improvement(F.col("pep_mape"), F.col("mape_pop_pct")))
    m = m.withColumns({"attributable": attributable(F.col("relative"), F.col("leakage")), "adjusted": adjusted_improvement(F.col("relative"), F.col("leakage"))})
    return m.withColumn("adjusted_mape", F.col("pep_mape") * (1 - F.col("adjusted")))


def summary(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation over folds, per model."""
    aggs = [x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))]
    return metrics.groupBy("model").agg(F.count(F.lit(1)).alias("n_folds"), *aggs)


def state_rollup(errors: DataFrame) -> DataFrame:
    return errors.groupBy("model", "state").agg(F.count(F.lit(1)).alias("n"), F.avg("abs_err_log").alias("mae_log"), F.avg("ape_pop_pct").alias("mape_pop_pct"))


def strata_rollup(errors: DataFrame, level: str) -> DataFrame:
    keyed = errors.withColumns({"pop_stratum": stratum(F.col(level)), "stratum_rank": stratum_rank(F.col(level))})
    return keyed.groupBy("model", "pop_stratum", "stratum_rank").agg(F.countDistinct("fips").alias("n"), F.avg("abs_err_log").alias("mae_log"), F.avg("ape_pop_pct").alias("mape_pop_pct"))


def post_censal(panel: DataFrame, years: list[int], alpha: float = 1e-4, multiplier: float = 50.0, fraction: float = 0.05) -> DataFrame:
    """The recursion after the anchor year (years[0]).

    panel: fips, year, fold, x, pep_log, y_log (anchor year), flow (births - deaths + migration + residual). The anchor
    year is predicted out of fold. Each later year starts from last year's corrected level plus flow, corrects the
    anchor model by a bounded delta, and hands its corrected level on. Every year's state is written to the shared folder.
    """
    anchor = panel.where((F.col("year") == years[0]) & F.col("y_log").isNotNull() & F.col("pep_log").isNotNull() & all_finite(F.col("x")))
    train = anchor.select("fips", "fold", "x", (F.col("y_log") - F.col("pep_log")).alias("target"), "pep_log", "y_log")
    folds = [r[0] for r in train.where("fold > 0").select("fold").distinct().orderBy("fold").collect()]
    items = train.withColumn("k", F.explode(F.array(*[F.lit(k) for k in folds])))
    held = fits(items.where("fold <> k"), "k", "x", "target", "huber", alpha=alpha)
    oof = items.where("fold = k").join(F.broadcast(held), "k").select("fips", F.lit(years[0]).alias("year"), "pep_log", (F.col("pep_log") + predicted(F.col("x"))).alias("pred_log"), "sigma", F.exp("y_log").alias("level"))
    whole = fits(train.withColumn("k", F.lit(0)), "k", "x", "target", "huber", alpha=alpha).first()
    base = Linear(np.array(whole["mean"]), np.array(whole["scale"]), np.array(whole["coef"]), whole["intercept"], whole["sigma"])
    out = [written(oof, f"year_{years[0]}")]
    state = out[0].select("fips", "level")
    for year in years[1:]:
        now = panel.where((F.col("year") == year) & F.col("pep_log").isNotNull() & all_finite(F.col("x"))).join(state, "fips", "left")
        pseudo = F.when(F.col("level") + F.col("flow") > 0, F.log(F.col("level") + F.col("flow")))
        now = now.select("fips", F.lit(0).alias("k"), "x", "pep_log", pseudo.alias("pseudo_log"))
        made = now.where("pseudo_log IS NOT NULL").groupBy("k").applyInPandas(_delta(base, alpha, multiplier, fraction), "k int, delta array<double>, shift double, sigma_delta double")
        one = made.first()
        delta = Linear(base.mean, base.scale, np.array(one["delta"]), one["shift"], one["sigma_delta"]) if one else Linear(base.mean, base.scale, base.coef * 0, 0.0, 0.0)
        both = Linear(base.mean, base.scale, base.coef + delta.coef, base.intercept + delta.intercept, math.hypot(base.sigma, delta.sigma))
        lit = lambda m, which: F.when(F.col("pseudo_log").isNotNull(), which(both)).otherwise(which(m))
        arr = lambda v: F.array(*[F.lit(float(q)) for q in v])
        rows = now.withColumns({"mean": arr(base.mean), "scale": arr(base.scale), "coef": lit(base, lambda m: arr(m.coef)), "intercept": lit(base, lambda m: F.lit(float(m.intercept))), "sigma": lit(base, lambda m: F.lit(float(m.sigma)))})
        rows = rows.withColumn("pred_log", F.col("pep_log") + predicted(F.col("x")))
        level = F.exp(F.coalesce("pseudo_log", F.col("pep_log")) + F.col("pred_log") - F.col("pep_log"))
        out.append(written(rows.select("fips", F.lit(year).alias("year"), "pep_log", "pred_log", "sigma", level.alias("level")), f"year_{year}"))
        state = out[-1].select("fips", "level")
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found


def _delta(base: Linear, alpha: float, multiplier: float, fraction: float):
    def one(p: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(p["x"].to_numpy()).astype(float)
        d = capped_delta(base, x, p["pseudo_log"].to_numpy(float) - p["pep_log"].to_numpy(float) - base.predict(x), alpha, multiplier, fraction)
        return pd.DataFrame([(0, d.coef.tolist(), d.intercept, d.sigma)], columns=["k", "delta", "shift", "sigma_delta"])

    return one


def year_rollup(trajectory: DataFrame) -> DataFrame:
    """Per year: means, first model, whether any truth is there."""
    return trajectory.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.avg("abs_correction_log").alias("mean_correction"), F.max("abs_correction_log").alias("max_correction"), F.avg("ape_pop_pct").alias("mape_pop_pct"), F.bool_or("has_truth").alias("has_truth"))


def county_rollup(trajectory: DataFrame) -> DataFrame:
    """Per county: state of its first year, number of years, labelled years, mean and largest correction."""
    return trajectory.groupBy("fips").agg(F.min_by("state", "year").alias("state"), F.count(F.lit(1)).alias("n_years"), F.sum(F.col("has_truth").cast("int")).alias("n_labeled_years"), F.avg("abs_correction_log").alias("mean_correction"), F.max("abs_correction_log").alias("max_correction"))


def fitted(kind: str, x: np.ndarray, y: np.ndarray, new: np.ndarray, **options) -> tuple[np.ndarray, float]:
    """Prediction for new rows and sigma, for any of the models."""
    if kind == "kernel_ridge":
        return kernel_ridge(x, y, new, **options), max(float((y - kernel_ridge(x, y, x, **options)).std()), 1e-6)
    m = fit(kind, x, y, **options)
    return m.predict(new), m.sigma

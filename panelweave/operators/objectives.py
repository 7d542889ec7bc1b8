"""What the tuners maximise: the strict score of a candidate model on leading basis columns, for many candidates at once.

A candidate is a number of leading columns and the settings of a fit. All
candidates take their fits from the same merged moments (a block of the matrix
for its columns), the Huber ones share every pass, and one pass over the rows scores them:
rows meet the candidates' coefficients, one row for each candidate and fold. So a
sweep reads the panel as often for thirty candidates as for one.

The score: of each fold the mean percentage error of baseline and candidate, their relative improvement less
what leaks, the same over the hard cases (baseline errors from the fold's quantile on), both as means over
folds; then a weighted mean of their signed tanh and of the preference for few columns.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import log_ape
from ..functions.vectors import all_finite
from ..sources.sinks import written
from .models import predicted
from .moments import centred, components, huber_steps, merged, solved, target_scale
from .search import search
from .tuning import low_k, strips_stop

SCALE = 5.0  # per cent at which the tanh bends
HISTORY = "k int, kind string, alpha double, epsilon double, n_components int, global_pct double, hard_pct double, low_k double, predictive double, objective double, baseline double, treatment double, adjusted double, n_rows long, n_hard long"


@dataclass(frozen=True)
class Candidate:
    k: int
    kind: str = "huber"
    alpha: float = 1e-4
    epsilon: float = 1.35
    n_components: int | None = None


def ready(rows: DataFrame, quantile: float = 0.9) -> DataFrame:
    """fold, x, y (target: y_log - pep_log), y_log, pep_log, base_ape, hard; written once, read by every pass.

    rows: fold int, x array<double> (one length), y_log, pep_log. Rows with a null or not finite entry are out.
    """
    sound = rows.where(all_finite(F.col("x")) & F.col("fold").isNotNull() & all_finite(F.array("y_log", "pep_log")))
    ape = log_ape(F.col("pep_log"), F.col("y_log"))
    keyed = sound.select(F.col("fold").cast("int").alias("fold"), F.lit(0).alias("spec"), F.col("x").cast("array<double>").alias("x"), (F.col("y_log") - F.col("pep_log")).alias("y"), "y_log", "pep_log", ape.alias("base_ape"))
    cut = keyed.groupBy("fold").agg(F.percentile("base_ape", F.lit(quantile)).alias("cut"))
    return written(keyed.join(F.broadcast(cut), "fold").withColumn("hard", F.col("base_ape") >= F.col("cut")).drop("cut"), "ready")


def candidate_fits(rows: DataFrame, folds: list[int], candidates: list[Candidate], tol: float = 1e-8) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """By (place of the candidate, fold): mean, scale, coef and intercept over its leading columns, from the rows of other folds. rows as ``ready`` gives them."""
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        return {}
    width = first.d
    if bad := [c for c in candidates if not 1 <= c.k <= width or c.kind not in ("ridge", "huber")]:
        raise ValueError(f"not among {width} columns, or of an unknown kind: {bad[0]}")
    means = rows.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(width)], F.avg("y").alias("my")).first()
    shift = np.array([0.0, *means])
    own = {f: m for (_, f, _), m in merged(rows, width, {0: shift}).items()}
    part = [np.array([*range(c.k + 1), width + 1]) for c in candidates]
    scaling, loadings, fits, counts, alpha, epsilon = {}, {}, {}, {}, {}, {}
    for k in folds:
        whole = sum(m for f, m in own.items() if f != k)
        if not isinstance(whole, np.ndarray) or whole[0, 0] < 1.5:
            continue
        for i, c in enumerate(candidates):
            m = whole[np.ix_(part[i], part[i])]
            _, mu, cov = centred(m)
            scale = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
            scale = np.where(scale < 1e-8, 1.0, scale)
            scaling[i, k] = mu[:-1], scale
            loadings[i, k] = components(cov[:-1, :-1] / np.outer(scale, scale), min(c.n_components, c.k)) if c.n_components else None
            fits[i, k] = solved(m, scaling[i, k], c.alpha if c.kind == "ridge" else max(c.alpha * m[0, 0], 1e-8), loadings[i, k])
            counts[i, k], alpha[i, k], epsilon[i, k] = m[0, 0], c.alpha, c.epsilon
    robust = {key: f for key, f in fits.items() if candidates[key[0]].kind == "huber"}
    if robust:
        sigma = {k: v for (_, k), v in target_scale(rows, folds).items()}

        def again(weights: Callable) -> dict[tuple[int, int], np.ndarray]:
            def of_others(_: int, fold: int, z: np.ndarray):
                for j, (i, k) in enumerate(robust):
                    if k != fold:
                        yield j, *weights(i, k, z[:, part[i]])

            keys, sums = list(robust), {}
            for (_, _, j), m in merged(rows, width, {0: shift}, of_others).items():
                sums[keys[j]] = sums.get(keys[j], 0) + m[np.ix_(part[keys[j][0]], part[keys[j][0]])]
            return sums

        fits |= huber_steps(robust, scaling, loadings, counts, {key: sigma[key[1]] for key in robust}, alpha, epsilon, tol, again)
    return {(i, k): (scaling[i, k][0] + shift[1 : candidates[i].k + 1], scaling[i, k][1], f[0], float(f[1] + shift[-1])) for (i, k), f in fits.items()}


def improvement(base: float, treated: float) -> float:
    return 100 * (base - treated) / max(base, 1e-9)


def scores(rows: DataFrame, folds: list[int], candidates: list[Candidate], leak: dict[int, float], weights: tuple[float, float, float] = (0.7, 0.2, 0.1), most: int | None = None) -> list[dict]:
    """One record (columns HISTORY) for each candidate that some fold could fit, in order. leak: share by fold; most: the largest number of columns."""
    fits = candidate_fits(rows, folds, candidates)
    if not fits:
        return []
    width = max(len(f[2]) for f in fits.values())
    pad = lambda v, x: [*v.tolist(), *[x] * (width - len(v))]
    table = rows.sparkSession.createDataFrame([(i, k, pad(f[0], 0.0), pad(f[1], 1.0), pad(f[2], 0.0), f[3]) for (i, k), f in sorted(fits.items())], "i int, fold int, mean array<double>, scale array<double>, coef array<double>, intercept double")
    met = rows.join(F.broadcast(table), "fold")  # candidates x folds rows
    ape = log_ape(F.col("pep_log") + predicted(F.slice("x", 1, width)), F.col("y_log"))
    hard = lambda c: F.avg(F.when(F.col("hard"), c))
    found = met.groupBy("i", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("base_ape").alias("base"), F.avg(ape).alias("treated"), F.sum(F.col("hard").cast("long")).alias("n_hard"), hard(F.col("base_ape")).alias("base_hard"), hard(ape).alias("treated_hard")).collect()
    out = []
    for i, c in enumerate(candidates):
        own = sorted((r for r in found if r.i == i), key=lambda r: r.fold)
        if not own:
            continue
        at = lambda name, own=own: float(np.mean([r[name] for r in own]))
        kept = lambda a, b, own=own: float(np.mean([r[a] * (1 - _less(improvement(r[a], r[b]), leak.get(r.fold, 0.0)) / 100) for r in own]))
        adjusted, hard_adjusted = kept("base", "treated"), kept("base_hard", "treated_hard")
        pct, hard_pct, few = improvement(at("base"), adjusted), improvement(at("base_hard"), hard_adjusted), low_k(c.k, most or width)
        a, b = math.tanh(pct / SCALE), math.tanh(hard_pct / SCALE)
        out.append({
            **asdict(c), "global_pct": pct, "hard_pct": hard_pct, "low_k": few, "predictive": (weights[0] * a + weights[1] * b) / (weights[0] + weights[1]),
            "objective": (weights[0] * a + weights[1] * b + weights[2] * (2 * few - 1)) / sum(weights), "baseline": at("base"), "treatment": at("treated"), "adjusted": adjusted,
            "n_rows": sum(r.n for r in own), "n_hard": sum(r.n_hard for r in own),
        })
    return out


def _less(improved: float, leakage: float) -> float:
    """An improvement less the share that leaks; a worsening stays."""
    return improved * (1 - min(max(leakage, 0.0), 1.0)) if improved > 0 else improved


def k_sweep(rows: DataFrame, folds: list[int], leak: dict[int, float], most: int, strip: int = 0, successive: int = 2, **options) -> list[dict]:
    """Records for k = 1, 2, ... up to most. With a strip length, strips of that many are scored at once and the sweep ends where the predictive score fell at the end of ``successive`` strips in a row. options: fields of Candidate and weights."""
    weights = {"weights": options.pop("weights")} if "weights" in options else {}
    out: list[dict] = []
    length = strip or most
    for low in range(1, most + 1, length):
        out += scores(rows, folds, [Candidate(k, **options) for k in range(low, min(low + length, most + 1))], leak, most=most, **weights)
        if strip and strips_stop([-r["predictive"] for r in out], strip, successive):
            break
    return out


def best_of(records: Iterable[dict]) -> dict:
    """The record with the largest objective, the earlier of equal ones."""
    return max(records, key=lambda r: r["objective"])


def history(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Records as a table, and which of them is the best."""
    best = best_of(records)["k"] if records else None
    names = [c.split()[0] for c in HISTORY.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in records], HISTORY).withColumn("selected", F.col("k") == F.lit(best))


def tune_linear(rows: DataFrame, folds: list[int], k: int, leak: dict[int, float], space: dict[str, dict], folder: str, rounds: int, width: int, seed: int = 0, **options) -> DataFrame:
    """Trials over the settings of the fit at a fixed number of columns: (trial, params, score). A round of trials is fitted and scored together. rows as ``ready`` gives them."""
    known = {f.name for f in fields(Candidate)} - {"k"}
    if bad := set(space) - known:
        raise ValueError(f"unknown dimensions {sorted(bad)}")

    def objective(trials: DataFrame) -> DataFrame:
        asked = trials.orderBy("trial").collect()  # a round
        found = scores(rows, folds, [Candidate(k, **json.loads(t.params)) for t in asked], leak, **options)
        told = [(t.trial, r["objective"]) for t, r in zip(asked, found, strict=True)] if found else []
        return trials.sparkSession.createDataFrame(told, "trial long, score double")

    return search(rows.sparkSession, space, objective, folder, rounds, width, seed)


def tune_graph(spark: SparkSession, space: dict[str, dict], rows_of: Callable[[dict], tuple[DataFrame, dict[int, float]]], folds: list[int], most: int, folder: str, rounds: int, width: int, seed: int = 0, strip: int = 0, **options) -> DataFrame:
    """Trials over the settings of a graph: a trial's score is the best objective of a sweep over its basis columns.

    rows_of(params) builds the graph and gives its rows (as for ``ready``) and the leakage by fold. A graph that raises
    ArithmeticError or ValueError, or that gives no rows, is a trial that has failed.
    """

    def objective(trials: DataFrame) -> DataFrame:
        told = []
        for t in trials.orderBy("trial").collect():  # a round
            try:
                rows, leak = rows_of(json.loads(t.params))
                swept = k_sweep(ready(rows), folds, leak, most, strip, **options)
            except (ArithmeticError, ValueError):
                continue
            if swept:
                told.append((t.trial, best_of(swept)["objective"]))
        return spark.createDataFrame(told, "trial long, score double")

    return search(spark, space, objective, folder, rounds, width, seed)

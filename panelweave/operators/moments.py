"""Linear fits of every fold and spec from merged moments: no task, group or driver sees a training set.

A row of features x and target y adds to the sums n, x, y, xx', xy, yy of its
spec and fold. Partial sums of tasks merge by addition; what a fold trains on is all
sums less its own, so the panel is read once for all folds and never copied by
fold. Sums are taken of rows less a common shift (their rounded mean), so that
subtraction does not cancel. Standardised ridge fits, principal components and
their regressions need nothing else; a Huber fit repeats the pass, each time
with weights from the fits before (iteratively reweighted least squares, then
the minimum of the quadratic piece that the fit lies in), all
folds and specs at once. The driver holds one matrix of moments for each fold and spec.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import written
from .models import MAD, Linear

TIMES = 200
NEWTON = (3, 20)  # passes of a Huber fit that solve the loss's quadratic piece; those before and after reweight
Weights = Callable[[int, int, np.ndarray], Iterable[tuple[int, np.ndarray, np.ndarray | None]]]


@dataclass
class Fit:
    """A model of standardised features, with the loadings of its components where there are any."""

    model: Linear
    n: float


def features_of(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.concatenate([np.ones((len(x), 1)), x, batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)[:, None]], 1)


def merged(rows: DataFrame, width: int, shifts: dict[int, np.ndarray], weights: Weights | None = None) -> dict[tuple[int, int, int], np.ndarray]:
    """Sums of (1, x, y)(1, x, y)' less the spec's shift by (spec, own fold, -1), or with weights by (spec, own fold, k).

    rows: spec int, fold int, x array<double>, y double, all finite. weights(spec, fold, z) gives, for each fold k that
    trains on these rows, their weights and what is added to their targets' products beside them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], np.ndarray] = {}
        for b in batches:
            z = features_of(b, width)
            spec, fold = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("spec", "fold"))
            for s, f in np.unique(np.stack([spec, fold], 1), axis=0).tolist():
                own = z[(spec == s) & (fold == f)] - shifts[s]
                for k, w, more in [(-1, None, None)] if weights is None else weights(s, f, own):
                    m = (own if w is None else own * w[:, None]).T @ own
                    if more is not None:
                        v = own[:, :-1].T @ more
                        m[:-1, -1] += v
                        m[-1, :-1] += v
                    total[s, f, k] = total.get((s, f, k), 0) + m
        for key, m in total.items():
            i, j = (v.ravel() for v in np.indices(m.shape))
            yield pa.RecordBatch.from_arrays([*[pa.array([v] * len(i), pa.int32()) for v in key], pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m.ravel())], ["spec", "fold", "k", "i", "j", "v"])

    got = rows.select("spec", "fold", "x", "y").mapInArrow(run, "spec int, fold int, k int, i int, j int, v double").groupBy("spec", "fold", "k", "i", "j").agg(F.sum("v").alias("v")).collect()
    out: dict[tuple[int, int, int], np.ndarray] = {}
    for r in got:
        out.setdefault((r.spec, r.fold, r.k), np.zeros((width + 2, width + 2)))[r.i, r.j] = r.v
    return out


def centred(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """n, means (less the shift) and the covariance of (x, y), divisor n."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    return n, mean, m[1:, 1:] / n - np.outer(mean, mean)


def components(cov: np.ndarray, k: int) -> np.ndarray:
    """Loadings of the first k principal components, the largest of each positive."""
    values, vectors = np.linalg.eigh(cov)
    v = vectors[:, np.argsort(-values, kind="stable")[:k]]
    return v * np.where(v[np.abs(v).argmax(0), range(v.shape[1])] < 0, -1.0, 1.0)


def solved(m: np.ndarray, scaling: tuple[np.ndarray, np.ndarray], penalty: float, loadings: np.ndarray | None = None) -> tuple[np.ndarray, float, float]:
    """(coef, intercept, variance of what is left) of the ridge fit to weighted moments of z = (x - mean) / scale, or of its components; penalty counts for the sum of squares, the intercept is free. Coefficients are for z."""
    n, mean, cov = centred(m)
    centre, scale = scaling
    d = len(scale)
    to = np.eye(d) if loadings is None else loadings
    cxx = to.T @ (cov[:d, :d] / np.outer(scale, scale)) @ to
    cxy = to.T @ (cov[:d, d] / scale)
    small = np.linalg.solve(n * cxx + penalty * np.eye(len(cxx)), n * cxy)
    coef = to @ small
    intercept = mean[d] - float((mean[:d] - centre) / scale @ coef)
    left = cov[d, d] - 2 * small @ cxy + small @ cxx @ small
    return coef, intercept, float(max(left, 0.0))


def target_scale(rows: DataFrame, folds: list[int]) -> dict[tuple[int, int], float]:
    """By (spec, fold), max(MAD / 0.67449, deviation) of the targets that it trains on; medians are exact."""
    k = F.explode(F.array(*[F.lit(f) for f in folds]))
    train = rows.select("spec", "fold", "y").withColumn("k", k).where("fold <> k")
    middle = train.groupBy("spec", "k").agg(F.median("y").alias("m"), F.stddev_pop("y").alias("s"))
    off = train.join(F.broadcast(middle), ["spec", "k"])  # specs x folds rows
    return {(r.spec, r.k): max(r.d / MAD, r.s, 1e-6) for r in off.groupBy("spec", "k").agg(F.median(F.abs(F.col("y") - F.col("m"))).alias("d"), F.first("s").alias("s")).collect()}


def huber_steps(fits: dict, scaling: dict, loadings: dict, counts: dict, sigma: dict[tuple[int, int], float], alpha: float | dict, epsilon: float | dict, tol: float, again: Callable[[Callable], dict]) -> dict:
    """Huber fits from the least-squares ones, all at once: (coef, intercept, variance) by (spec, fold).

    again(weights) makes a pass over the rows: sums of weighted moments by (spec, fold), where weights(spec, fold, z) gives
    the weights of rows z = (1, features, target) and what is added to their targets' products beside them, or None.
    alpha and epsilon may differ by (spec, fold).
    """
    fits = dict(fits)
    alpha, epsilon = (v if isinstance(v, dict) else dict.fromkeys(fits, v) for v in (alpha, epsilon))
    for step in range(TIMES):
        now, whole = {key: f[:2] for key, f in fits.items()}, NEWTON[0] <= step < NEWTON[1]

        def weights(s: int, k: int, z: np.ndarray, now=now, whole=whole) -> tuple[np.ndarray, np.ndarray | None]:
            coef, intercept = now[s, k]
            u = (z[:, -1] - (z[:, 1:-1] - scaling[s, k][0]) / scaling[s, k][1] @ coef - intercept) / sigma[s, k]
            e = epsilon[s, k]
            far = np.abs(u) > e
            if whole:  # the minimum of the quadratic piece that holds this fit
                return (~far).astype(float), np.where(far, np.sign(u) * e * sigma[s, k], 0.0)
            return np.where(far, e / np.maximum(np.abs(u), 1e-300), 1.0), None

        moved = 0.0
        for key, m in again(weights).items():
            if m[0, 0] < len(m) - 1:  # too few rows inside for a piece of their own
                moved = 1.0
                continue
            new = solved(m, scaling[key], alpha[key] * counts[key], loadings[key])
            moved = max(moved, float(np.abs(np.append(new[0] - fits[key][0], new[1] - fits[key][1])).max()) / sigma[key])
            fits[key] = new
        if moved < tol:
            break
    return fits


def fold_fits(rows: DataFrame, folds: list[int], kind: str = "ridge", alpha: float = 1.0, epsilon: float = 1.35, n_components: int | None = None, tol: float = 1e-8) -> dict[tuple[int, int], Fit]:
    """A model for each (spec, fold) from the rows of all other folds. rows: spec int, fold int, x array<double> (one length), y double; rows that are not finite, or of no fold, must be out.

    ridge: alpha is added to the sum of squares. huber: mean of Huber losses at the scale of the training targets, plus
    alpha / 2 times the squared coefficients. With n_components the regression is on that many principal components of
    the standardised training features. A fold without training rows has no model.
    """
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        return {}
    width = first.d
    means = rows.groupBy("spec").agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(width)], F.avg("y").alias("my")).collect()
    shifts = {r.spec: np.array([0.0, *r[1:]]) for r in means}
    own = {key[:2]: m for key, m in merged(rows, width, shifts).items()}
    train = {(s, k): sum(m for (t, _), m in own.items() if t == s) - own.get((s, k), 0) for s in shifts for k in folds}
    train = {key: m for key, m in train.items() if m[0, 0] > 0.5}
    scaling, loadings, fits = {}, {}, {}
    for key, m in train.items():
        _, mu, cov = centred(m)
        scale = np.sqrt(np.maximum(np.diag(cov)[:width], 0))
        scale = np.where(scale < 1e-8, 1.0, scale)
        scaling[key] = mu[:width], scale
        loadings[key] = components(cov[:width, :width] / np.outer(scale, scale), min(n_components, width)) if n_components else None
        fits[key] = solved(m, scaling[key], alpha if kind == "ridge" else max(alpha * m[0, 0], 1e-8), loadings[key])
    if kind == "huber":
        rows = written(rows.select("spec", "fold", "x", "y"), "huber_rows")

        def again(weights: Callable) -> dict[tuple[int, int], np.ndarray]:
            def of_others(spec: int, fold: int, z: np.ndarray):
                for s, k in fits:
                    if s == spec and k != fold:
                        yield k, *weights(s, k, z)

            sums: dict[tuple[int, int], np.ndarray] = {}
            for (s, _, k), m in merged(rows, width, shifts, of_others).items():
                sums[s, k] = sums.get((s, k), 0) + m
            return sums

        counts = {key: m[0, 0] for key, m in train.items()}
        fits = huber_steps(fits, scaling, loadings, counts, target_scale(rows, folds), alpha, epsilon, tol, again)
        for key, m in train.items():  # what is left of the unweighted training rows
            _, mu, cov = centred(m)
            c = fits[key][0] / scaling[key][1]
            fits[key] = fits[key][0], fits[key][1], max(float(cov[width, width] - 2 * c @ cov[:width, width] + c @ cov[:width, :width] @ c), 0.0)
    return {
        key: Fit(Linear(scaling[key][0] + shifts[key[0]][1:-1], scaling[key][1], f[0], f[1] + shifts[key[0]][-1], max(f[2] ** 0.5, 1e-6)), float(train[key][0, 0])) for key, f in fits.items()
    }


def model_rows(fits: dict[tuple[int, int], Fit], spark: SparkSession) -> DataFrame:
    """spec, k and the columns of a model, one row for each spec and fold."""
    rows = [(*key, f.model.mean.tolist(), f.model.scale.tolist(), f.model.coef.tolist(), float(f.model.intercept), float(f.model.sigma), int(f.n)) for key, f in sorted(fits.items())]
    return spark.createDataFrame(rows, "spec int, k int, mean array<double>, scale array<double>, coef array<double>, intercept double, sigma double, n_train long")

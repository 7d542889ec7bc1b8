"""Kernel models of every fold and spec by landmarks, so that no task holds a kernel matrix of all rows.

Each (spec, fold) has landmarks: the distinct training features with the smallest
hashes, at most ``landmarks`` of them; they come from sketches of the smallest
hashes that tasks keep and merge. A row is its kernel columns against them, which
a task makes as it reads the row and never writes. Sums of products of those columns merge by
blocks of matrix rows, first over groups of tasks.
Ridge: f(x) = sum of c_j k(x, l_j), least sum of squares plus alpha times f's
squared norm, without an intercept. With no more distinct training features than
landmarks this is the exact kernel ridge regression. Huber: the columns are standardised
on the training rows and fitted as any others.

The kernel's width, where none is given, is the median distance of at most
SAMPLE features (the same sketch) to their NEAR-th nearest, themselves the first.
The driver holds sketches, landmarks and one matrix of moments for each fold and spec.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.sinks import written
from .models import standard
from .moments import centred, features_of, huber_steps, merged, solved, target_scale

NEAR, SAMPLE, LANDMARKS, MERGERS, BLOCK = 8, 1024, 256, 64, 32
KINDS = {"kernel_ridge", "kernel_huber"}


def distances(a: np.ndarray, b: np.ndarray, name: str) -> np.ndarray:
    """Squared Euclidean ones, for the laplacian kernel the sums of absolute differences."""
    if name == "laplacian":
        return sum((np.abs(a[:, j, None] - b[None, :, j]) for j in range(a.shape[1])), np.zeros((len(a), len(b))))
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def kernel(a: np.ndarray, b: np.ndarray, name: str, gamma: float) -> np.ndarray:
    """cosine, or exp(-gamma times the distance): squared Euclidean for rbf, absolute for laplacian."""
    if name == "cosine":
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        return unit(a) @ unit(b).T
    if name in ("rbf", "laplacian"):
        return np.exp(-gamma * distances(a, b, name))
    raise ValueError(f"unknown kernel {name}")


def width_of(x: np.ndarray, name: str) -> float:
    """gamma from the median distance to the NEAR-th nearest row, itself the first; where that is nothing, from the number of features."""
    if name == "cosine" or len(x) <= 1 or x.shape[1] == 0:
        return 1.0
    d = np.sort(distances(x, x, name), 1)[:, min(max(2, min(NEAR, max(2, len(x) - 1))), len(x)) - 1]
    middle = float(np.median(d if name == "laplacian" else np.sqrt(d)))
    if not np.isfinite(middle) or middle <= 1e-12:
        middle = float(x.shape[1]) if name == "laplacian" else float(np.sqrt(x.shape[1]))
    return 1 / max(middle, 1e-6) if name == "laplacian" else 1 / max(middle**2, 1e-6)


def kernel_ridge(x: np.ndarray, y: np.ndarray, new: np.ndarray, alpha: float = 1.0, name: str = "rbf", gamma: float | None = None) -> np.ndarray:
    """The exact regression on all rows at once, standardised on x: for few rows and for tests."""
    mean, scale = standard(x)
    a, b = (x - mean) / scale, (new - mean) / scale
    g = gamma or width_of(a, name)
    return kernel(b, a, name, g) @ np.linalg.solve(kernel(a, a, name, g) + max(alpha, 1e-12) * np.eye(len(a)), y)


def kernel_features(x: np.ndarray, new: np.ndarray, name: str = "rbf", gamma: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Kernel columns against the standardised rows of x, standardised in turn on them."""
    mean, scale = standard(x)
    a, b = (x - mean) / scale, (new - mean) / scale
    g = gamma or width_of(a, name)
    ka, kb = kernel(a, a, name, g), kernel(b, a, name, g)
    mean, scale = standard(ka)
    return (ka - mean) / scale, (kb - mean) / scale


@dataclass
class Site:
    """What makes kernel columns of features: their scaling, the landmarks (scaled) and the kernel."""

    mean: np.ndarray
    scale: np.ndarray
    points: np.ndarray
    name: str
    gamma: float

    def columns(self, x: np.ndarray) -> np.ndarray:
        return kernel((x[:, : len(self.mean)] - self.mean) / self.scale, self.points, self.name, self.gamma)


def smallest(rows: DataFrame, most: int) -> DataFrame:
    """(spec, fold, h, x): of each spec and fold the distinct features with the ``most`` smallest hashes. A task keeps that many and no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], dict[int, list[float]]] = {}
        for b in batches:
            spec, fold, h = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for s, f in np.unique(np.stack([spec, fold], 1), axis=0).tolist():
                own = kept.setdefault((s, f), {})
                at = np.flatnonzero((spec == s) & (fold == f))
                _, first = np.unique(h[at], return_index=True)
                for i in at[first[:most]].tolist():
                    own.setdefault(int(h[i]), b.column(3)[i].as_py())
                for v in sorted(own)[most:]:
                    del own[v]
        out = [(s, f, h, x) for (s, f), own in kept.items() for h, x in own.items()]
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())), strict=True)], ["spec", "fold", "h", "x"])

    hashed = rows.select("spec", "fold", F.xxhash64("x").alias("h"), "x")
    found = hashed.mapInArrow(run, "spec int, fold int, h long, x array<double>").groupBy("spec", "fold", "h").agg(F.first("x").alias("x"))
    return found.withColumn("n", F.row_number().over(W.partitionBy("spec", "fold").orderBy("h"))).where(F.col("n") <= most).drop("n")


def sites_of(rows: DataFrame, folds: list[int], width: int, shifts: dict[int, np.ndarray], name: str, gamma: float | None, landmarks: int, lengths: list[int] | None = None) -> dict[tuple[int, int], Site]:
    """Scaling, landmarks and kernel width of each (spec, fold), all from the rows of other folds."""
    own = {key[:2]: m for key, m in merged(rows, width, shifts).items()}
    drawn: dict[tuple[int, int], list[tuple[int, list[float]]]] = {}
    for r in smallest(rows, max(SAMPLE, landmarks)).collect():  # at most that many for each spec and fold
        drawn.setdefault((r.spec, r.fold), []).append((r.h, r.x))
    sites = {}
    for s in shifts:
        for k in folds:
            m = sum(m for (t, f), m in own.items() if t == s and f != k)
            if not isinstance(m, np.ndarray) or m[0, 0] < 0.5:
                continue
            d = lengths[s] if lengths else width
            _, mu, cov = centred(m)
            scale = np.sqrt(np.maximum(np.diag(cov)[:d], 0))
            scale = np.where(scale < 1e-8, 1.0, scale)
            mean = mu[:d] + shifts[s][1 : d + 1]
            points = dict(p for (t, f), ps in drawn.items() if t == s and f != k for p in ps)
            sample = (np.array([points[h] for h in sorted(points)[: max(SAMPLE, landmarks)]], float).reshape(-1, width)[:, :d] - mean) / scale
            sites[s, k] = Site(mean, scale, sample[:landmarks], name, gamma or width_of(sample[:SAMPLE], name))
    return sites


def lifted(rows: DataFrame, width: int, sites: dict[tuple[int, int], Site], shifts: dict[int, np.ndarray], weights: Callable | None = None) -> dict[tuple[int, int], np.ndarray]:
    """By (spec, fold k), sums of (1, columns, y)(1, columns, y)' over the rows of other folds, y less the spec's shift; weights as for ``moments.huber_steps``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            z = features_of(b, width)
            spec, fold = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("spec", "fold"))
            for (s, k), site in sites.items():
                x = z[(spec == s) & (fold != k)]
                if len(x):
                    own = np.concatenate([x[:, :1], site.columns(x[:, 1:-1]), x[:, -1:] - shifts[s][-1]], 1)
                    w, more = weights(s, k, own) if weights else (None, None)
                    m = (own if w is None else own * w[:, None]).T @ own
                    if more is not None:
                        v = own[:, :-1].T @ more
                        m[:-1, -1] += v
                        m[-1, :-1] += v
                    total[s, k] = total.get((s, k), 0) + m
        part = TaskContext.get().partitionId() % MERGERS
        for (s, k), m in total.items():
            blocks = [m[i : i + BLOCK].ravel() for i in range(0, len(m), BLOCK)]
            yield pa.RecordBatch.from_arrays([*[pa.array([v] * len(blocks), pa.int32()) for v in (s, k, part)], pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.list_(pa.float64()))], ["spec", "k", "part", "i", "v"])

    def added(t: pa.Table) -> pa.Table:
        v = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1).sum(0)
        return t.slice(0, 1).set_column(4, "v", pa.array([v], pa.list_(pa.float64())))

    schema = "spec int, k int, part int, i int, v array<double>"
    got = rows.select("spec", "fold", "x", "y").mapInArrow(run, schema)
    got = got.groupBy("spec", "k", "i", "part").applyInArrow(added, schema).groupBy("spec", "k", "i").applyInArrow(added, schema).collect()
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in got:
        n = len(sites[r.spec, r.k].points) + 2
        out.setdefault((r.spec, r.k), np.zeros((n, n)))[r.i * BLOCK : (r.i + 1) * BLOCK] = np.reshape(r.v, (-1, n))
    return out


def ridge_on(m: np.ndarray, site: Site, level: float, alpha: float) -> np.ndarray:
    """Weights of the landmarks for the targets in m plus a level. Directions in which the landmarks' own kernel matrix vanishes are left out."""
    values, vectors = np.linalg.eigh(kernel(site.points, site.points, site.name, site.gamma))
    keep = values > 1e-10 * max(values.max(), 1e-300)
    to = vectors[:, keep] / np.sqrt(values[keep])
    target = m[1:-1, -1] + level * m[1:-1, 0]
    return to @ np.linalg.solve(to.T @ m[1:-1, 1:-1] @ to + max(alpha, 1e-12) * np.eye(keep.sum()), to.T @ target)


def spread(m: np.ndarray, coef: np.ndarray) -> float:
    """Deviation of y - columns . coef over the rows that m sums, at least 1e-6."""
    _, _, cov = centred(m)
    c = np.append(-coef, 1.0)
    return max(float(max(c @ cov @ c, 0.0)) ** 0.5, 1e-6)


def held_out(rows: DataFrame, folds: list[int], kind: str = "kernel_ridge", name: str = "rbf", alpha: float = 1.0, epsilon: float = 1.35, gamma: float | None = None, landmarks: int = LANDMARKS, centre: bool = False, lengths: list[int] | None = None, tol: float = 1e-8) -> DataFrame:
    """rows with raw (the prediction for y by the model of all other folds) and sigma (deviation of that model's training residuals).

    rows: spec int, fold int, x array<double> (one length), y double, all finite, and any other columns but raw and sigma.
    Rows of other folds than ``folds`` train and get no prediction; a fold without training rows gets none either. Rows
    with equal features count as often as they stand there, and make one landmark. centre takes the training mean off
    the targets of a ridge fit. lengths: how many leading features count, by spec. Without centring
    predictions fall to 0 far from all landmarks, which matters where they are few and the targets are not near 0.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, raw double, sigma double"
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        return rows.selectExpr("*", "CAST(NULL AS DOUBLE) AS raw", "CAST(NULL AS DOUBLE) AS sigma")
    width = first.d
    rows = written(rows, "kernel_rows")  # read by every pass
    means = rows.groupBy("spec").agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(width)], F.avg("y").alias("my")).collect()
    shifts = {r.spec: np.array([0.0, *r[1:]]) for r in means}
    sites = sites_of(rows, folds, width, shifts, name, gamma, landmarks, lengths)
    sums = lifted(rows, width, sites, shifts)
    found: dict[tuple[int, int], tuple[np.ndarray, float, float]] = {}
    if kind == "kernel_ridge":
        for (s, k), m in sums.items():
            middle = m[0, -1] / m[0, 0] if centre else -shifts[s][-1]  # what is taken off the targets in m
            c = ridge_on(m, sites[s, k], -middle, alpha)
            found[s, k] = c, middle + shifts[s][-1], spread(m, c)
    else:
        scaling, fits = {}, {}
        for key, m in sums.items():
            _, mu, cov = centred(m)
            scale = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
            scaling[key] = mu[:-1], np.where(scale < 1e-8, 1.0, scale)
            fits[key] = solved(m, scaling[key], max(alpha * m[0, 0], 1e-8))
        counts = {key: m[0, 0] for key, m in sums.items()}
        fits = huber_steps(fits, scaling, dict.fromkeys(sums), counts, target_scale(rows, folds), alpha, epsilon, tol, lambda w: lifted(rows, width, sites, shifts, w))
        for (s, k), f in fits.items():
            c = f[0] / scaling[s, k][1]
            found[s, k] = c, f[1] - float(scaling[s, k][0] @ c) + shifts[s][-1], spread(sums[s, k], c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spec, fold = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("spec", "fold"))
            x = features_of(b, width)[:, 1:-1]
            raw, sigma, told = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x), bool)
            for (s, k), (c, intercept, left) in found.items():
                at = (spec == s) & (fold == k)
                if at.any():
                    raw[at], sigma[at], told[at] = sites[s, k].columns(x[at]) @ c + intercept, left, True
            t = pa.Table.from_batches([b]).append_column("raw", pa.array(raw)).append_column("sigma", pa.array(sigma)).filter(pa.array(told))
            yield from t.to_batches()

    return rows.mapInArrow(run, schema)

"""Regression kernels in NumPy, run once per work item inside grouped Arrow functions."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAD = 0.67449


@dataclass
class Linear:
    """A standardised linear model: prediction = (x - mean) / scale . coef + intercept."""

    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    intercept: float
    sigma: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.coef + self.intercept


def standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), x.std(0)
    return mean, np.where(scale < 1e-8, 1.0, scale)


def principal(x: np.ndarray, k: int) -> np.ndarray:
    """Loadings of the first k components of centred x; signs so that the largest loading is positive."""
    v = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:k].T
    return v * np.where(v[np.abs(v).argmax(0), range(v.shape[1])] < 0, -1.0, 1.0)


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 500, tol: float = 1e-10, memory: int = 12) -> np.ndarray:
    """Minimises a smooth function with the two-loop recursion and a backtracking search."""
    value, g = f(x)
    past: deque = deque(maxlen=memory)
    for _ in range(steps):
        if np.abs(g).max() < tol:
            break
        d, used = -g, []
        for s, y, r in reversed(past):
            a = r * (s @ d)
            d = d - a * y
            used.append(a)
        if past:
            s, y, _ = past[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y, r), a in zip(past, reversed(used), strict=True):
            d = d + s * (a - r * (y @ d))
        slope = g @ d
        if slope >= 0:
            past.clear()
            d, slope = -g, -(g @ g)
        step = 1.0
        while True:
            new = x + step * d
            v, h = f(new)
            if v <= value + 1e-4 * step * slope or step < 1e-14:
                break
            step /= 2
        s, y = new - x, h - g
        if s @ y > 1e-18:
            past.append((s, y, 1 / (s @ y)))
        if abs(value - v) <= 1e-16 * max(1.0, abs(value)) and np.abs(h).max() < 1e-8:
            x, g = new, h
            break
        x, value, g = new, v, h
    return x


def residual_scale(y: np.ndarray) -> float:
    return max(float(np.median(np.abs(y - np.median(y)))) / MAD, float(y.std()), 1e-6)


def huber_loss(x: np.ndarray, y: np.ndarray, alpha: float, epsilon: float, skew: float, scale: float) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Value and gradient in (coef, intercept): quadratic up to epsilon, linear beyond, positive and negative residuals weighted by e^(skew/2), e^(-skew/2)."""
    n = len(y)
    up, down = np.exp(skew / 2), np.exp(-skew / 2)

    def f(p: np.ndarray) -> tuple[float, np.ndarray]:
        u = (y - x @ p[:-1] - p[-1]) / scale
        w = np.where(u >= 0, up, down)
        far = np.abs(u) > epsilon
        rho = np.where(far, epsilon * (np.abs(u) - epsilon / 2), u * u / 2)
        psi = w * np.where(far, epsilon * np.sign(u), u) * scale / n
        return float(scale**2 * (w * rho).mean() + alpha / 2 * p[:-1] @ p[:-1]), np.append(-(x.T @ psi) + alpha * p[:-1], -psi.sum())

    return f


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Closed form; the intercept is not shrunk."""
    mx, my = x.mean(0), y.mean()
    a = (x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1])
    coef = np.linalg.solve(a, (x - mx).T @ (y - my))
    return coef, float(my - mx @ coef)


def huber(x: np.ndarray, y: np.ndarray, alpha: float = 1e-4, epsilon: float = 1.35, skew: float = 0.0) -> tuple[np.ndarray, float]:
    epsilon, skew = max(epsilon, 1.0), float(np.clip(skew, -4, 4))
    start = ridge(x, y, max(alpha * len(y), 1e-8))
    p = lbfgs(huber_loss(x, y, alpha, epsilon, skew, residual_scale(y)), np.append(*start))
    return p[:-1], float(p[-1])


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float, l1_ratio: float, rounds: int = 2000, tol: float = 1e-10) -> tuple[np.ndarray, float]:
    """Coordinate descent on ||y - Xb||^2 / (2n) + alpha (l1 |b| + (1 - l1) |b|^2 / 2)."""
    n, d = x.shape
    if l1_ratio < 1e-9:
        return ridge(x, y, alpha * n)
    mx, my = x.mean(0), y.mean()
    z, r, b = x - mx, y - my, np.zeros(d)
    size = (z * z).sum(0) / n
    for _ in range(rounds):
        moved = 0.0
        for j in range(d):
            if size[j] == 0:
                continue
            rho = z[:, j] @ r / n + size[j] * b[j]
            new = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0) / (size[j] + alpha * (1 - l1_ratio))
            if new != b[j]:
                r = r - z[:, j] * (new - b[j])
                moved, b[j] = max(moved, abs(new - b[j])), new
        if moved < tol:
            break
    return b, float(my - mx @ b)


def fit(kind: str, x: np.ndarray, y: np.ndarray, **options) -> Linear:
    """Standardises on these rows and fits: huber, ridge or elastic_net."""
    mean, scale = standard(x)
    z = (x - mean) / scale
    coef, intercept = {"huber": huber, "ridge": lambda a, b, alpha=1.0: ridge(a, b, alpha), "elastic_net": elastic_net}[kind](z, y, **options)
    sigma = max(float((y - z @ coef - intercept).std()), 1e-6)
    return Linear(mean, scale, np.asarray(coef, float), float(intercept), sigma)


def capped_delta(base: Linear, x: np.ndarray, y: np.ndarray, alpha: float, multiplier: float = 50.0, fraction: float = 0.05) -> Linear:
    """A correction to a fitted model, on the base's scaling, no longer than a fraction of it."""
    z = (x - base.mean) / base.scale
    coef, intercept = huber(z, y, alpha * multiplier)
    length, most = np.sqrt(coef @ coef + intercept**2), fraction * np.sqrt(base.coef @ base.coef + base.intercept**2)
    shrink = min(1.0, most / length) if length > 0 else 1.0
    coef, intercept = coef * shrink, intercept * shrink
    return Linear(base.mean, base.scale, coef, intercept, max(float((y - z @ coef - intercept).std()), 1e-6))


MODEL = "mean array<double>, scale array<double>, coef array<double>, intercept double, sigma double, n_train long"


def fits(rows: DataFrame, key: str, features: str, target: str, kind: str, **options) -> DataFrame:
    """One model per value of ``key``: (key, MODEL). A group is the training set of one work item."""

    def one(k: tuple, p: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(p[features].to_numpy()).astype(float), p[target].to_numpy(float)
        m = fit(kind, x, y, **options)
        return pd.DataFrame([(k[0], m.mean.tolist(), m.scale.tolist(), m.coef.tolist(), m.intercept, m.sigma, len(y))], columns=[key, "mean", "scale", "coef", "intercept", "sigma", "n_train"])

    return rows.select(key, features, target).groupBy(key).applyInPandas(one, f"{key} {dict(rows.dtypes)[key]}, {MODEL}")


def predicted(features: Column, prefix: str = "") -> Column:
    """The prediction of a model whose columns stand in the same row: stays inside the JVM."""
    z = F.zip_with(F.zip_with(features.cast("array<double>"), F.col(f"{prefix}mean"), lambda v, m: v - m), F.col(f"{prefix}scale"), lambda v, s: v / s)
    return F.aggregate(F.zip_with(z, F.col(f"{prefix}coef"), lambda v, c: v * c), F.col(f"{prefix}intercept"), lambda a, v: a + v)

"""Scalar measures: errors, bounds, classes, scores."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .nulls import divide

#: Population classes: (least population, label, rank). Fixed values.
STRATA_7 = ((0, "<5k", 0), (5_000, "5k-25k", 1), (25_000, "25k-50k", 2), (50_000, "50k-100k", 3), (100_000, "100k-250k", 4), (250_000, "250k-1M", 5), (1_000_000, "1M+", 6))
STRATA_5 = ((0, "<5k", 0), (5_000, "5k-50k", 1), (50_000, "50k-250k", 2), (250_000, "250k-1M", 3), (1_000_000, ">1M", 4))
EARTH_KM = 6371.0


def stratum(c: Column, strata=STRATA_7, missing_on_top: bool = False) -> Column:
    """Label of the class of a population. A missing one has none, or the top one."""
    return _pick(c, strata, 1, missing_on_top)


def stratum_rank(c: Column, strata=STRATA_7, missing_on_top: bool = False) -> Column:
    return _pick(c, strata, 2, missing_on_top)


def _pick(c: Column, strata, at: int, missing_on_top: bool) -> Column:
    out = F.when(c.isNull(), F.lit(strata[-1][at] if missing_on_top else None))
    for low, high in zip(strata, strata[1:], strict=False):
        out = out.when(c < high[0], F.lit(low[at]))
    return out.otherwise(F.lit(strata[-1][at]))


def outcome(delta: Column, tolerance: float = 1e-9) -> Column:
    """win, loss or equal."""
    return F.when(delta > tolerance, "win").when(delta < -tolerance, "loss").when(delta.isNotNull(), "equal")


def ape(predicted: Column, truth: Column) -> Column:
    """Absolute percentage error on levels."""
    return F.abs(predicted - truth) / F.greatest(F.abs(truth), F.lit(1e-9)) * 100


def log_ape(predicted: Column, truth: Column) -> Column:
    """The same for logarithms of levels."""
    return ape(F.exp(predicted), F.exp(truth))


def symmetric_ratio(a: Column, b: Column) -> Column:
    r = divide(a, b)
    return F.greatest(r, divide(F.lit(1.0), r))


def relative_improvement(base: Column, model: Column) -> Column:
    return (base - model) / F.greatest(base, F.lit(1e-9))


def attributable(relative: Column, leakage: Column) -> Column:
    return F.greatest(relative, F.lit(0.0)) * leakage


def adjusted_improvement(relative: Column, leakage: Column) -> Column:
    """What is left of an improvement once the share that leaks between folds is taken off."""
    return relative - attributable(relative, leakage)


def tanh_score(percent: Column, scale: float = 5.0) -> Column:
    return F.tanh(percent / scale)


def centred(unit: Column) -> Column:
    return 2 * unit - 1


def scalarised(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of objectives."""
    total = sum(w for _, w in parts) or 1.0
    out = F.lit(0.0)
    for c, w in parts:
        out = out + c * (w / total)
    return out


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """Metres of one degree of latitude and of longitude: the usual series of the ellipsoid."""
    r = F.radians(lat)
    north = 111132.92 - 559.82 * F.cos(2 * r) + 1.175 * F.cos(4 * r) - 0.0023 * F.cos(6 * r)
    east = 111412.84 * F.cos(r) - 93.5 * F.cos(3 * r) + 0.118 * F.cos(5 * r)
    return north, east


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """x and y in metres, equal-area conic for the conterminous states (parallels 29.5 and 45.5, origin 23 N 96 W, GRS80)."""
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    p1, p2, p0, l0 = (math.radians(v) for v in (29.5, 45.5, 23.0, -96.0))

    def m(p: float) -> float:
        return math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)

    def q(p: float) -> float:
        s = math.sin(p)
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    n = (m(p1) ** 2 - m(p2) ** 2) / (q(p2) - q(p1))
    c = m(p1) ** 2 + n * q(p1)
    rho0 = a * math.sqrt(c - n * q(p0)) / n
    s = F.sin(F.radians(lat))
    qs = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    rho, theta = a * F.sqrt(c - n * qs) / n, n * (F.radians(lon) - l0)
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


@pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if x is None or x != x else 0.5 * (1 + math.erf(x / math.sqrt(2))))


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def crps(truth: Column, mean: Column, sigma: Column) -> Column:
    """Continuous ranked probability score of a normal forecast."""
    z = (truth - mean) / sigma
    return F.greatest(F.lit(0.0), sigma * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / math.sqrt(math.pi)))

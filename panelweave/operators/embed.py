"""Embeddings of tables and tiles: a denoising auto-encoder in one task per family, principal components, statistics of tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.vectors import doubles
from .models import principal, standard
from .spatial import quantile_of


def family_tag(base: Column, end: Column) -> Column:
    return F.concat(base, F.lit("_y"), end.cast("string"), F.lit("_nowcast"))


def family_label(start: Column, end: Column) -> Column:
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("->", start.cast("string"), end.cast("string")))


def source_split(source: Column, end: Column) -> Column:
    return F.when(source == end, "eval").otherwise("pqval")


def families(base: str, anchor: int, years: list[int]) -> list[tuple[str, int, int]]:
    """(tag, family end, source year): a family of a year holds the years from the anchor on."""
    return [(f"{base}_y{end}_nowcast", end, y) for end in years for y in years if anchor <= y <= end]


def train_dae(x: np.ndarray, d: int, hidden: int | None = None, swap: float = 0.15, steps: int = 400, rate: float = 3e-3, seed: int = 0):
    """A denoising auto-encoder: cells are swapped with those of other rows, a code of d numbers restores them and tells which were swapped. Gives the encoder."""
    rng, (n, c) = np.random.default_rng(seed), x.shape
    h = hidden or max(2 * d, c)
    init = lambda a, b: rng.normal(0, np.sqrt(2 / a), (a, b))
    p = [init(c, h), np.zeros(h), init(h, d), np.zeros(d), init(d, h), np.zeros(h), init(h, c), np.zeros(c), init(h, c), np.zeros(c)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for t in range(1, steps + 1):
        rows = rng.integers(0, n, min(n, 256))
        mask = rng.random((len(rows), c)) < swap
        clean = x[rows]
        noisy = np.where(mask, x[rng.integers(0, n, (len(rows), c)), np.arange(c)], clean)
        a1 = noisy @ p[0] + p[1]
        r1 = np.maximum(a1, 0)
        z = r1 @ p[2] + p[3]
        a2 = z @ p[4] + p[5]
        r2 = np.maximum(a2, 0)
        out, logit = r2 @ p[6] + p[7], r2 @ p[8] + p[9]
        g_out = 2 * (out - clean) / clean.size
        g_logit = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - mask) / clean.size
        g_r2 = (g_out @ p[6].T + g_logit @ p[8].T) * (a2 > 0)
        g_z = g_r2 @ p[4].T
        g_r1 = (g_z @ p[2].T) * (a1 > 0)
        grads = [noisy.T @ g_r1, g_r1.sum(0), r1.T @ g_z, g_z.sum(0), z.T @ g_r2, g_r2.sum(0), r2.T @ g_out, g_out.sum(0), r2.T @ g_logit, g_logit.sum(0)]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return lambda q: np.maximum(q @ p[0] + p[1], 0) @ p[2] + p[3]


def embedded(panel: DataFrame, family: str, id_: str, features: str, d: int, method: str = "pca", seed: int = 0) -> DataFrame:
    """(family, id, embedding) of every family of rows: standardised, then components or the auto-encoder's code."""

    def one(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(p[features].to_numpy()).astype(float)
        mean, scale = standard(x)
        z = (x - mean) / scale
        code = train_dae(z, d, seed=seed)(z) if method == "dae" else z @ principal(z, d)
        return pd.DataFrame({family: key[0], id_: p[id_], "embedding": [r.astype(np.float32).tolist() for r in code]})

    kinds = dict(panel.dtypes)
    return panel.select(family, id_, features).groupBy(family).applyInPandas(one, f"{family} {kinds[family]}, {id_} {kinds[id_]}, embedding array<float>")


def tile_statistics(tiles: DataFrame, tile: str = "tile") -> DataFrame:
    """Adds a vector of mean, deviation, quantiles and active share of each tile: input for components where no network is at hand."""
    v = doubles(F.col(tile))
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    # squares of what is left of the mean, so that a large one does not cancel; the mean is worked out once a tile
    var = F.element_at(F.transform(F.array(mean), lambda m: F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n), 1)
    active = F.size(F.filter(v, lambda x: x > 0)) / n
    return tiles.withColumn("stats", F.array(mean, F.sqrt(F.greatest(var, F.lit(0.0))), *[quantile_of(v, q) for q in (0.05, 0.25, 0.5, 0.75, 0.95)], active))


def items(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds item_index and item_count of each bag."""
    w = W.partitionBy(*keys)
    return rows.withColumns({"item_index": (F.row_number().over(w.orderBy(order)) - 1).cast("int"), "item_count": F.count(F.lit(1)).over(w).cast("int")})


def expected_items(bags: DataFrame, cap: int) -> DataFrame:
    """How many rows each (family_tag, source_year) should have: bag sizes up to a cap."""
    return bags.groupBy("family_tag", "source_year").agg(F.sum(F.least("item_count", F.lit(cap))).alias("n"))

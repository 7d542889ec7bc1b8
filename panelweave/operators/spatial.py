"""Rasters and polygons as rows: pixels (key, row, col, value), vertices (key, ring, seq, lon, lat)."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, FloatType
from pyspark.sql.window import Window as W

from ..functions.measures import albers

TILE = 32
#: Territory counties that are left out up to 2020. Fixed values.
LEGACY_TERRITORIES = ("60010", "60020", "60050", "66010", "69100", "69110", "69120", "78010", "78020", "78030")


@pandas_udf(BinaryType())
def packed(values: pd.Series) -> pd.Series:
    """gzip of a one-dimensional float32 .npy."""

    def one(v: object) -> bytes | None:
        if v is None:
            return None
        f = io.BytesIO()
        np.save(f, np.asarray(v, np.float32))
        return gzip.compress(f.getvalue(), mtime=0)

    return values.map(one)


@pandas_udf(ArrayType(FloatType()))
def unpacked(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else np.load(io.BytesIO(gzip.decompress(b))).ravel().tolist())


def pixels_of(rasters: DataFrame, keys: list[str], values: str = "values", width: str = "width") -> DataFrame:
    """Rows of a raster stored as one array, row by row."""
    long = rasters.select(*keys, F.col(width).alias("_w"), F.posexplode(values).alias("_i", "value"))
    return long.select(*keys, F.expr("_i div _w").cast("int").alias("row"), (F.col("_i") % F.col("_w")).cast("int").alias("col"), F.col("value").cast("double").alias("value"))


def county_tensors(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """One row per county that has a valid pixel: tight bounds, shape, counts, and its values row by row (missing as 0)."""
    box = pixels.where("value IS NOT NULL AND NOT isnan(value)").groupBy(*keys).agg(F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("col").alias("left"), F.max("col").alias("right"), F.count(F.lit(1)).alias("valid_pixels"))
    inside = pixels.join(box, keys).where("row BETWEEN top AND bottom AND col BETWEEN left AND right")
    value = F.coalesce(F.nanvl("value", F.lit(None).cast("double")), F.lit(0.0)).cast("float")
    rows = inside.groupBy(*keys, "top", "bottom", "left", "right", "valid_pixels").agg(F.array_sort(F.collect_list(F.struct("row", "col", value.alias("v")))).alias("_p"))
    return rows.select(*keys, (F.col("bottom") - F.col("top") + 1).alias("height"), (F.col("right") - F.col("left") + 1).alias("width"), "valid_pixels", "top", "left", F.transform("_p", lambda x: x["v"]).alias("values"))


def log_normalised(value: Column) -> Column:
    """Light: log1p over 9, within 0 and 1."""
    return F.least(F.greatest(F.log1p(F.greatest(value, F.lit(0.0))) / 9, F.lit(0.0)), F.lit(1.0))


def clip_normalised(pixels: DataFrame, keys: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Gas: between the county's own low and high quantiles, scaled to 0..1."""
    q = pixels.groupBy(*keys).agg(F.percentile("value", F.lit(low)).alias("_lo"), F.percentile("value", F.lit(high)).alias("_hi"))
    scaled = F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return pixels.join(q, keys).withColumn("value", F.coalesce(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))).drop("_lo", "_hi")


def tiles(pixels: DataFrame, keys: list[str], size: int = TILE) -> DataFrame:
    """Square tiles from the tight corner of each key, padded with 0; tiles of nothing but 0 go. (keys, tile_row, tile_col, tile_index, tile, p95)"""
    corner = pixels.groupBy(*keys).agg(F.min("row").alias("_t"), F.min("col").alias("_l"))
    p = pixels.join(corner, keys).withColumns({"_r": F.col("row") - F.col("_t"), "_c": F.col("col") - F.col("_l")})
    p = p.withColumns({"tile_row": F.expr(f"_r div {size}").cast("int"), "tile_col": F.expr(f"_c div {size}").cast("int"), "_at": (F.col("_r") % size) * size + F.col("_c") % size})
    g = p.groupBy(*keys, "tile_row", "tile_col").agg(F.max(F.abs("value")).alias("_m"), F.map_from_entries(F.collect_list(F.struct("_at", F.coalesce("value", F.lit(0.0)).alias("v")))).alias("_px"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.coalesce(F.try_element_at("_px", i.cast("bigint") if dict(p.dtypes)["_at"] == "bigint" else i), F.lit(0.0)))
    g = g.where("_m > 0").withColumn("tile", filled)
    index = F.row_number().over(W.partitionBy(*keys).orderBy("tile_row", "tile_col")) - 1
    return g.withColumn("p95", quantile_of(F.col("tile"), 0.95)).withColumn("tile_index", index).drop("_m", "_px")


def quantile_of(values: Column, q: float) -> Column:
    """Linear quantile of the elements of an array."""
    s = F.array_sort(values)
    at = (F.size(values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(values) - 1))
    return a + (b - a) * (at - low)


def resampled(height: int, width: int, metres: tuple[float, float], target: float) -> tuple[int, int]:
    """Shape of a raster once its pixels measure ``target`` metres."""
    return max(1, round(height * metres[0] / target)), max(1, round(width * metres[1] / target))


def bilinear(grid: np.ndarray, height: int, width: int) -> np.ndarray:
    """A grid at another resolution, pixel centres aligned."""
    h, w = grid.shape
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    top = grid[y0][:, x0] * (1 - fx) + grid[y0][:, x1] * fx
    return top * (1 - fy) + (grid[y1][:, x0] * (1 - fx) + grid[y1][:, x1] * fx) * fy


def nearest(grid: np.ndarray, height: int, width: int) -> np.ndarray:
    h, w = grid.shape
    return grid[np.minimum((np.arange(height) + 0.5) * h / height, h - 1).astype(int)][:, np.minimum((np.arange(width) + 0.5) * w / width, w - 1).astype(int)]


def resample(tensors: DataFrame, key: str, target: float) -> DataFrame:
    """(key, height, width, values) at ``target`` metres a pixel. tensors: key, height, width, values, metres_y, metres_x."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for r in p.itertuples(index=False):
                g = np.asarray(r.values, float).reshape(r.height, r.width)
                h, w = resampled(r.height, r.width, (r.metres_y, r.metres_x), target)
                out.append((getattr(r, key), h, w, bilinear(g, h, w).ravel().tolist()))
            yield pd.DataFrame(out, columns=[key, "height", "width", "values"])

    return tensors.select(key, "height", "width", "values", "metres_y", "metres_x").mapInPandas(run, f"{key} {dict(tensors.dtypes)[key]}, height int, width int, values array<double>")


def areas(vertices: DataFrame, key: str) -> DataFrame:
    """(key, area_sqkm, x, y): signed shoelace over closed rings in equal-area coordinates, so that holes (wound the other way) take away."""
    x, y = albers(F.col("lon"), F.col("lat"))
    v = vertices.select(key, "ring", "seq", x.alias("x"), y.alias("y"))
    ring = W.partitionBy(key, "ring").orderBy("seq")
    first = W.partitionBy(key, "ring").orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(first))
    v = v.withColumns({"xn": nxt("x"), "yn": nxt("y"), "x0": F.first("x").over(first), "y0": F.first("y").over(first)})
    # relative to a vertex, so that large coordinates do not cancel
    ax, ay, bx, by = F.col("x") - F.col("x0"), F.col("y") - F.col("y0"), F.col("xn") - F.col("x0"), F.col("yn") - F.col("y0")
    cross = ax * by - bx * ay
    per = v.groupBy(key, "ring").agg((F.sum(cross) / 2).alias("a"), (F.sum((ax + bx) * cross) / 6).alias("mx"), (F.sum((ay + by) * cross) / 6).alias("my"), F.first("x0").alias("x0"), F.first("y0").alias("y0"))
    per = per.withColumns({"mx": F.col("mx") + F.col("x0") * F.col("a"), "my": F.col("my") + F.col("y0") * F.col("a")})
    t = per.groupBy(key).agg(F.sum("a").alias("a"), F.sum("mx").alias("mx"), F.sum("my").alias("my"))
    return t.select(key, (F.abs("a") / 1e6).alias("area_sqkm"), F.try_divide(F.col("mx"), F.col("a")).alias("x"), F.try_divide(F.col("my"), F.col("a")).alias("y"))


def activity_weights(stats: DataFrame, threshold: float = 0.01, cap_quantile: float = 0.995, gamma: float = 0.5, floor: float = 1e-6) -> DataFrame:
    """Sampling probability of each county from its number of active tiles (p95 over a threshold), capped at a quantile, to a power, never under a floor. stats: fips, p95."""
    n = stats.groupBy("fips").agg(F.sum((F.col("p95") >= threshold).cast("double")).alias("n"))
    cap = F.broadcast(n.agg(F.percentile("n", F.lit(cap_quantile)).alias("cap")))  # one row
    w = n.crossJoin(cap).withColumn("w", F.greatest(F.pow(F.least("n", "cap"), F.lit(gamma)), F.lit(floor)))
    total = F.broadcast(w.agg(F.sum("w").alias("t")))  # one row
    return w.crossJoin(total).select("fips", "n", (F.col("w") / F.col("t")).alias("probability"))


def capped_items(items: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """At most k random items of each key; the same seed draws the same."""
    order = F.xxhash64(*items.columns, F.lit(seed))
    return items.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("_r") <= k).drop("_r")


def without_legacy(df: DataFrame, fips: str = "fips") -> DataFrame:
    return df.where(~((F.col("year") <= 2020) & F.col(fips).isin(*LEGACY_TERRITORIES)))

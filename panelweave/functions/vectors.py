"""Vectors as arrays: everything is computed in double, whatever the column stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalised(v: Column, least: float = 1e-12) -> Column:
    """v over its length; a vector shorter than ``least`` is divided by that."""
    length = F.greatest(norm(v), F.lit(least))
    return F.transform(doubles(v), lambda x: x / length)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def standardised(v: Column, mean: Column, scale: Column) -> Column:
    """(v - mean) / scale; scales under 1e-8 count as 1."""
    centred = F.zip_with(doubles(v), mean, lambda x, m: x - m)
    return F.zip_with(centred, scale, lambda x, s: x / F.when(s < 1e-8, 1.0).otherwise(s))


def all_finite(v: Column) -> Column:
    return F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def with_length(df: DataFrame, v: str, d: int) -> DataFrame:
    """Raises when a vector has not d elements: arrays have no fixed length of their own."""
    bad = F.raise_error(F.concat(F.lit(f"{v}: wanted {d} elements, found "), F.size(v).cast("string")))
    return df.withColumn(v, F.when(F.size(v) != d, bad).otherwise(F.col(v)))


def pooled(items: DataFrame, key: str, v: str) -> DataFrame:
    """Element-wise mean and maximum of the vectors of a key, and both one after the other."""
    long = items.select(key, F.posexplode(doubles(F.col(v))).alias("pos", "x"))
    at = long.groupBy(key, "pos").agg(F.avg("x").alias("mean"), F.max("x").alias("max"))
    rows = at.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "max"))).alias("p"))
    mean, top = F.transform("p", lambda s: s["mean"]), F.transform("p", lambda s: s["max"])
    return rows.select(key, mean.alias("mean"), top.alias("max"), F.concat(mean, top).alias("pooled"))


def column_moments(df: DataFrame, v: str) -> DataFrame:
    """One row: element-wise mean and population deviation of all vectors."""
    long = df.select(F.posexplode(doubles(F.col(v))).alias("pos", "x"))
    at = long.groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    rows = at.agg(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))).alias("p"))
    return rows.select(F.transform("p", lambda x: x["m"]).alias("mean"), F.transform("p", lambda x: x["s"]).alias("scale"))

"""Missing values: NaN and infinities become NULL at the boundary, division and casts never raise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(c: Column) -> Column:
    """A number, or NULL where the text is none or not finite."""
    return finite(F.trim(c.cast("string")).try_cast("double"))


def finite(c: Column) -> Column:
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def is_finite(c: Column) -> Column:
    return F.coalesce(finite(c).isNotNull(), F.lit(False))


def divide(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def floored(c: Column, least: float) -> Column:
    """max(c, least) that keeps NULL."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(least)))


def capped(c: Column, most: float) -> Column:
    """min(c, most) that keeps NULL."""
    return F.when(c.isNotNull(), F.least(c, F.lit(most)))


def clipped(c: Column, least: float, most: float) -> Column:
    return capped(floored(c, least), most)


def sum_if_any(*cs: Column) -> Column:
    """Row sum of what is there; NULL only if all are missing."""
    none = reduce(lambda a, b: a & b, (c.isNull() for c in cs))
    total = reduce(lambda a, b: a + b, (F.coalesce(c.cast("double"), F.lit(0.0)) for c in cs))
    return F.when(~none, total)


def total_or_zero(c: Column) -> Column:
    """Aggregate: the sum, 0 for a group without values."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def safe_ln(c: Column) -> Column:
    """ln of positive numbers, else NULL."""
    return F.when(c > 0, F.log(c))

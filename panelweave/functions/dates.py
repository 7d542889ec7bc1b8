"""Dates of monthly series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(c: Column) -> Column:
    """First day of the month of 'yyyyMM', 'yyyy-MM' or any timestamp text; NULL where none fits."""
    s = F.trim(c.cast("string"))
    found = (
        F.when(s.rlike(r"^\d{6}$"), F.try_to_timestamp(s, F.lit("yyyyMM")))
        .when(s.rlike(r"^\d{4}-\d{2}$"), F.try_to_timestamp(s, F.lit("yyyy-MM")))
        .otherwise(s.try_cast("timestamp"))
    )
    return F.trunc(found, "month")

"""States, regions and divisions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import zfill

#: Census divisions in their usual order, each with its region and its states' codes. Fixed values.
DIVISIONS = (
    ("new_england", "northeast", "09 23 25 33 44 50"),
    ("middle_atlantic", "northeast", "34 36 42"),
    ("east_north_central", "midwest", "17 18 26 39 55"),
    ("west_north_central", "midwest", "19 20 27 29 31 38 46"),
    ("south_atlantic", "south", "10 11 12 13 24 37 45 51 54"),
    ("east_south_central", "south", "01 21 28 47"),
    ("west_south_central", "south", "05 22 40 48"),
    ("mountain", "west", "04 08 16 30 32 35 49 56"),
    ("pacific", "west", "02 06 15 41 53"),
    ("territory", "territory", "72"),
)
DIVISION_OF = {s: d for d, _, states in DIVISIONS for s in states.split()}
REGION_OF = {s: r for _, r, states in DIVISIONS for s in states.split()}
UNKNOWN = "unknown"


def looked_up(c: Column, table: dict[str, str], default: str | None) -> Column:
    """The entry of a small constant table, or a default."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(pairs, c), F.lit(default))


def region(state: Column) -> Column:
    return looked_up(state, REGION_OF, UNKNOWN)


def division(state: Column) -> Column:
    return looked_up(state, DIVISION_OF, UNKNOWN)


def with_geography(df: DataFrame, state: str = "state") -> DataFrame:
    """Adds region and division of a two-digit state code."""
    df = df.withColumn(state, zfill(F.trim(F.col(state).cast("string")), 2))
    return df.withColumns({"region": region(F.col(state)), "division": division(F.col(state))})

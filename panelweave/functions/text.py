"""Strings: codes, names, series ids."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Suffixes taken from county names, in the order in which they are tried. Fixed values.
COUNTY_SUFFIXES = ("county", "parish", "borough", "census area", "municipality", "city and borough", "city", "municipio")


def zfill(c: Column, n: int) -> Column:
    """Pads with zeros to n characters; never shortens."""
    return F.when(F.length(c) < n, F.lpad(c, n, "0")).otherwise(c)


def canonical_code(c: Column, n: int = 5) -> Column:
    """A code without blanks and quotes; padded if it is all digits; at most n characters."""
    plain = F.trim(F.translate(F.trim(c.cast("string")), "'\"", ""))
    return F.substring(F.when(plain.rlike("^[0-9]+$"), zfill(plain, n)).otherwise(plain), 1, n)


def strip_zeros(c: Column) -> Column:
    """Without leading zeros; nothing left is '0'."""
    left = F.regexp_replace(F.trim(c), "^0+", "")
    return F.when(left == "", F.lit("0")).otherwise(left)


def part(c: Column, pattern: str, group: int) -> Column:
    """A group of a pattern, NULL where it does not match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def first_part(c: Column, *choices: tuple[str, int]) -> Column:
    """The group of the first pattern that matches."""
    return F.coalesce(*[part(c, p, g) for p, g in choices])


def county_name(c: Column, suffixes: tuple[str, ...] = COUNTY_SUFFIXES) -> Column:
    """Lower case, signs to spaces, suffixes off in their order (several may go), single spaces."""
    out = F.regexp_replace(F.lower(F.trim(c)), r"(?U)[^\w\s]", " ")
    for s in suffixes:
        out = F.regexp_replace(out, f" {s}$", "")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


@pandas_udf(StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, then ASCII alone."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def name_key(c: Column) -> Column:
    """A folded name: '&' as and; letters, digits, commas and single spaces."""
    folded = F.replace(F.trim(F.lower(ascii_fold(c))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9, ]+", " "), " +", " "))


def name_keys(county: Column, state: Column) -> Column:
    """The key 'county, state' and, where the county has a suffix, the one without it."""
    full, place = name_key(county), name_key(state)
    short = F.trim(F.regexp_replace(full, f" +({'|'.join(COUNTY_SUFFIXES)})$", ""))
    return F.array_distinct(F.array_compact(F.array(F.concat_ws(", ", full, place), F.when(short != "", F.concat_ws(", ", short, place)))))


def joined_states(c: Column) -> Column:
    """Aggregate: the distinct values in order, joined by commas."""
    return F.array_join(F.array_sort(F.collect_set(c)), ",")

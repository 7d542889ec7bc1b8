"""Relational building blocks: keyed dedup, checked joins, lookups, previous year, imputation, reshaping, work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SMALL_ROWS = 100_000


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def keep_first(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return keep_one(df, keys, [F.asc(seq)])


def keep_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return keep_one(df, keys, [F.desc(seq)])


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """Marks a dimension for broadcast if it has no more than ``most`` rows; else leaves the choice to the optimizer."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def unique_on(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, whose keys must be unique: a repeated one raises when the rows are read."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    said = F.raise_error(F.concat_ws(" ", F.lit("repeated key:"), *[F.col(k).cast("string") for k in keys]))
    first = df.columns[0]
    kind = df.schema[first].dataType
    checked = F.when(F.col("_n") > 1, said.cast(kind)).otherwise(F.col(first))
    return df.withColumn("_n", n).withColumn(first, checked).drop("_n")


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    return left.join(unique_on(right, keys), keys, how)


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return unique_on(left, keys).join(unique_on(right, keys), keys, how)


def lookup(df: DataFrame, table: DataFrame, keys: list[str], value: str, default: object, out: str | None = None) -> DataFrame:
    """Adds ``value`` from a dimension, a default where the key is not there."""
    name = out or value
    both = df.join(table.select(*keys, F.col(value).alias("_v")), keys, "left")
    return both.withColumn(name, F.coalesce("_v", F.lit(default))).drop("_v")


def previous_year(df: DataFrame, keys: list[str], values: list[str], offset: int = 1, suffix: str = "_prev") -> DataFrame:
    """Adds each value of ``offset`` years before, NULL over a gap. offset 0 compares a year with itself."""
    before = df.select(*keys, (F.col("year") + offset).alias("year"), *[F.col(v).alias(v + suffix) for v in values])
    return df.join(before, [*keys, "year"], "left")


def all_joined(frames: list[DataFrame], keys: list[str], how: str = "full") -> DataFrame:
    """Frames joined on common keys, one after the other."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, keys, how)
    return out


def conditional_means(df: DataFrame, keys: list[str], value: str, when: dict[str, Column]) -> DataFrame:
    """One pass for what would be a chain of filtered aggregates and outer joins."""
    return df.groupBy(*keys).agg(*[F.avg(F.when(c, F.col(value))).alias(name) for name, c in when.items()])


def impute_by(df: DataFrame, keys: list[str], columns: list[str], default: float = 0.0) -> DataFrame:
    """Missing values become the exact median of their group, then a default."""
    medians = df.groupBy(*keys).agg(*[F.median(c).alias(f"_{c}") for c in columns])
    both = df.join(medians, keys, "left")
    return both.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}"), F.lit(default)) for c in columns}).drop(*[f"_{c}" for c in columns])


def impute_all(df: DataFrame, columns: list[str], default: float = 0.0) -> DataFrame:
    """Missing values become the exact median over all rows, then a default."""
    medians = df.agg(*[F.median(c).alias(f"_{c}") for c in columns])
    both = df.crossJoin(F.broadcast(medians))  # one row
    return both.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}"), F.lit(default)) for c in columns}).drop(*[f"_{c}" for c in columns])


def top_k(df: DataFrame, key: str, value: str, k: int, tie: str, largest: bool = True) -> DataFrame:
    """The k rows of each key with the largest (or smallest) value; equal values by ``tie``."""
    order = F.desc(value) if largest else F.asc(value)
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order, F.asc(tie)))).where(F.col("_r") <= k).drop("_r")


def scaled_rank(order: list[Column], *keys: str) -> Column:
    """(row number - 1) / (n - 1) in a stable order; 1.0 where there is one row."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    r = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return F.when(n == 1, 1.0).otherwise((r - 1) / (n - 1))


def average_rank(value: str, *keys: str) -> Column:
    """Rank with ties at their mean."""
    return F.rank().over(W.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, value)) - 1) / 2


def pearson(a: Column, b: Column) -> Column:
    """Correlation; NULL where one side does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def robust_scale(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """max(MAD / 0.67449, population deviation, 1e-6) of each key: two passes of exact medians."""
    mid = df.groupBy(*keys).agg(F.median(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    dev = df.join(mid, keys).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("_m"))).alias("mad"), F.max("_s").alias("std"))
    return dev.withColumn("scale", F.greatest(F.col("mad") / 0.67449, F.col("std"), F.lit(1e-6)))


def tail(df: DataFrame, value: str, share: float, upper: bool, keys: list[str] | None = None) -> DataFrame:
    """Rows at or beyond a quantile, ties included."""
    if keys:
        both = df.join(df.groupBy(*keys).agg(F.percentile(value, F.lit(share)).alias("_q")), keys)
    else:
        both = df.crossJoin(F.broadcast(df.agg(F.percentile(value, F.lit(share)).alias("_q"))))  # one row
    return both.where((F.col(value) >= F.col("_q")) if upper else (F.col(value) <= F.col("_q"))).drop("_q")


def years_from_columns(df: DataFrame, keys: list[str], stems: dict[str, str], years: list[int]) -> DataFrame:
    """Columns like POP2020, POP2021 as rows (keys, year, one column per stem) in a single scan; absent columns are NULL."""
    has = {c.upper(): c for c in df.columns}
    rows = [F.struct(F.lit(y).alias("year"), *[(F.col(has[f"{s}{y}".upper()]).try_cast("double") if f"{s}{y}".upper() in has else F.lit(None).cast("double")).alias(n) for n, s in stems.items()]) for y in years]
    return df.select(*keys, F.explode(F.array(*rows)).alias("_y")).select(*keys, "_y.*")


def columns_from_codes(df: DataFrame, keys: list[str], code: str, value: str, names: dict[str, str]) -> DataFrame:
    """Measure codes as columns."""
    wide = df.groupBy(*keys).pivot(code, list(names)).agg(F.first(value, ignorenulls=True))
    return wide.select(*keys, *[F.col(c).alias(n) for c, n in names.items()])


def evenly_spaced(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """At most k rows of each key, at the rounded positions of an even spacing; halves go to the even place."""
    ranked = df.withColumns({"_i": F.row_number().over(W.partitionBy(key).orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(W.partitionBy(key))})
    if k == 1:
        return ranked.where("_i = 0").drop("_i", "_n")
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (k - 1)).cast("int"))
    return ranked.where((F.col("_n") <= k) | F.array_contains(places, F.col("_i"))).drop("_i", "_n")


def not_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The part of a work list that a table does not have yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def partly_done(work: DataFrame, done: DataFrame, keys: list[str], expected: str) -> DataFrame:
    """Keys of which a table has some rows but not the expected number."""
    have = done.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
    return work.join(have, keys).where(F.col("found") != F.col(expected))

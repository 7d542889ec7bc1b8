"""Modalities, coordinates and graphs brought onto one list of samples, and the tables a graph run is kept in."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import nulls
from ..functions.text import zfill
from ..sources.sinks import append_checked

#: Columns of a panel that are no features (fixed names of the data model).
NOT_FEATURES = ("fips", "year", "county_name", "state_abbr", "label", "label_level", "label_prev", "label_delta", "target_correction_log", "target_correction_level")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def single_row(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key; a key with several raises. A dense modality must be like that, a bag need not."""
    said = F.concat(F.lit("several rows for "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    n = F.count(F.lit(1))
    alone = [F.when(n > 1, F.raise_error(said).cast(df.schema[v].dataType)).otherwise(F.first(v)).alias(v) for v in values]
    return df.groupBy(*keys).agg(*alone)


def with_modalities(samples: DataFrame, modalities: dict[str, DataFrame], key: str = "fips") -> DataFrame:
    """samples with every modality's vector x (NULL where it has none) and a mask: the vector is there and all of it is finite."""
    out = samples
    for name, df in modalities.items():
        one = single_row(df.select(key, F.col("x").alias(name)), [key], [name])
        out = out.join(one, key, "left").withColumn(f"{name}_mask", F.col(name).isNotNull() & F.coalesce(F.forall(name, lambda v: finite(v)), F.lit(False)))
    return out


def in_every(samples: DataFrame, others: list[DataFrame], key: str = "fips") -> DataFrame:
    """Samples that all the others have too."""
    for o in others:
        samples = samples.join(o.select(key).distinct(), key, "left_semi")
    return samples


def coordinates_for(samples: DataFrame, coordinates: DataFrame, key: str = "fips") -> DataFrame:
    """samples with lat, lon and valid; (0, 0, false) where there are no coordinates."""
    both = samples.join(coordinates.select(key, "lat", "lon"), key, "left").withColumn("valid", F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return both.withColumns({c: F.when(F.col("valid"), F.col(c)).otherwise(F.lit(0.0)) for c in ("lat", "lon")})


def coordinate_order(df: DataFrame, first: str, second: str) -> DataFrame:
    """One row, mode: latlon_01, latlon_10 or xy, from the largest absolute values (NaN and NULL do not count)."""
    size = lambda c: F.max(F.when(finite(F.col(c)), F.abs(c)))
    known = df.agg(size(first).alias("a"), size(second).alias("b"))
    return known.select(F.when((F.col("a") <= 90) & (F.col("b") <= 180), "latlon_01").when((F.col("b") <= 90) & (F.col("a") <= 180), "latlon_10").otherwise("xy").alias("mode"))


def hard_rank(value: str, group: str, tie: str, descending: bool = False) -> Column:
    """1, 2, ... in order of a value within a group, ties by another column."""
    v = F.col(value)
    return F.row_number().over(W.partitionBy(group).orderBy(v.desc() if descending else v.asc(), tie))


def weighted_deviations(df: DataFrame, keys: list[str], x: Column, w: Column) -> DataFrame:
    """keys and deviation: population standard deviation of x under weights w, 0 for at most one value; 0 too where all weights are 0.

    Rows whose x or weight is not finite do not count, nor do their weights; weights under 0 count as 0. Means come first,
    of distances to the group's least value, then squares of what is left: large means do not cancel. The rows meet their
    group's least value and mean by key, which are one row a group.
    """
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    known = df.select(*own, nulls.finite(x).alias("_x"), F.when(nulls.finite(w).isNotNull(), F.greatest(nulls.finite(w), F.lit(0.0))).alias("_w"))
    known = known.withColumn("_w", F.when(F.col("_x").isNotNull(), F.col("_w"))).withColumn("_x", F.when(F.col("_w").isNotNull(), F.col("_x")))
    names = [f"_k{i}" for i in range(len(keys))]

    def met(rows: DataFrame, of: DataFrame) -> DataFrame:
        of = of.withColumnsRenamed({n: f"{n}_" for n in names})
        return rows.join(of, reduce(and_, [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names], F.lit(True))).drop(*[f"{n}_" for n in names])

    least = known.groupBy(*names).agg(F.min("_x").alias("_least"))
    near = met(known, least).withColumn("_x", F.col("_x") - F.col("_least")).drop("_least")
    means = near.groupBy(*names).agg(F.try_divide(F.sum(F.col("_w") * F.col("_x")), F.sum("_w")).alias("_m"))
    square = F.try_divide(F.sum(F.col("_w") * F.pow(F.col("_x") - F.col("_m"), 2)), F.sum("_w"))
    out = met(near, means).groupBy(*names).agg(F.when(F.count("_x") <= 1, 0.0).otherwise(F.coalesce(F.sqrt(square), F.lit(0.0))).alias("deviation"))
    return out.withColumnsRenamed(dict(zip(names, keys, strict=True)))


def geography_colour(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with red, green, blue in [0, 1]: hue follows longitude, brightness latitude, both scaled over all rows (their bounds are one row)."""
    ends = df.agg(F.min(lat).alias("_lat0"), F.max(lat).alias("_lat1"), F.min(lon).alias("_lon0"), F.max(lon).alias("_lon1"))
    scaled = lambda c, name: (F.col(c) - F.col(f"_{name}0")) / F.greatest(F.col(f"_{name}1") - F.col(f"_{name}0"), F.lit(1e-9))
    bright = 0.35 + 0.6 * scaled(lat, "lat")

    def channel(n: int) -> Column:
        k = (n + scaled(lon, "lon") * 6) % 6
        return bright - bright * 0.75 * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    both = df.crossJoin(F.broadcast(ends))
    return both.withColumns({"red": channel(5), "green": channel(3), "blue": channel(1)}).select(*df.columns, "red", "green", "blue")


def feature_columns(df: DataFrame, more: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns that are features, in order."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [n for n, t in df.dtypes if n not in (*NOT_FEATURES, *more) and (t in numeric or t.startswith("decimal"))]


def trajectory_rows(df: DataFrame) -> DataFrame:
    """Levels, residuals and percentage errors of a year's corrections (y_log, pep_log, corrected_log); errors only where the truth is finite."""
    level = {"truth_level": F.exp("y_log"), "pep_level": F.exp("pep_log"), "corrected_level": F.exp("corrected_log")}
    rows = df.withColumns(level).withColumns({"resid_true": F.col("y_log") - F.col("pep_log"), "resid_pred": F.col("corrected_log") - F.col("pep_log")})
    off = lambda c: F.when(finite(F.col("truth_level")), F.abs(F.col(c) - F.col("truth_level")) / F.greatest(F.abs("truth_level"), F.lit(1e-9)) * 100)
    return rows.withColumns({"pep_ape_pct": off("pep_level"), "corrected_ape_pct": off("corrected_level")}).withColumn("delta_ape_pct", F.col("corrected_ape_pct") - F.col("pep_ape_pct"))


# graph runs ------------------------------------------------------------------

RUN = ["graph_tag", "graph_kind", "source_year"]


def write_topology(folder: str, run: dict[str, object], basis: DataFrame, edges: DataFrame) -> None:
    """Three tables of one run: run (one row), basis (fips, basis array -> one row per index), edges (src, dst, weight) without zero weights."""
    spark = basis.sparkSession
    tag = [F.lit(run[k]).alias(k) for k in RUN]
    long = basis.select(*tag, "fips", F.posexplode("basis").alias("basis_index", "basis_value"))
    kept = edges.where("weight <> 0").select(*tag, F.col("src").alias("src_fips"), F.col("dst").alias("dst_fips"), F.col("weight").alias("edge_weight"))
    append_checked(long, f"{folder}/basis")
    append_checked(kept, f"{folder}/edges")
    # the run's row comes last: a run without one is not complete
    append_checked(spark.range(1).select(*tag, *[F.lit(v).alias(k) for k, v in run.items() if k not in RUN]), f"{folder}/run")


def topology_edges(spark: SparkSession, folder: str, tag: str, kind: str, year: int) -> DataFrame:
    """Edges of one run, codes padded, without weights that are not finite; the filters reach the scan."""
    df = spark.read.parquet(f"{folder}/edges").where((F.col("graph_tag") == tag) & (F.col("source_year") == year) & (F.col("graph_kind") == kind))
    code = lambda c: zfill(F.trim(F.col(c).cast("string")), 5).alias(c)
    return df.select(code("src_fips"), code("dst_fips"), F.col("edge_weight").cast("double").alias("edge_weight")).where(finite(F.col("edge_weight")))


def topology_basis(spark: SparkSession, folder: str, tag: str, kind: str, year: int) -> DataFrame:
    df = spark.read.parquet(f"{folder}/basis").where((F.col("graph_tag") == tag) & (F.col("source_year") == year) & (F.col("graph_kind") == kind))
    return df.select(zfill(F.trim(F.col("fips").cast("string")), 5).alias("fips"), "basis_index", "basis_value")


def with_topology(metrics: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Yearly metrics (year) with what is known of that year's runs."""
    runs = spark.read.parquet(f"{folder}/run").withColumnRenamed("source_year", "year")
    return metrics.join(runs, "year", "left")

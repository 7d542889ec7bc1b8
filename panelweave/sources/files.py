"""Text and columnar files as all-string or typed frames, with column choice and predicates that reach the scan."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def clean_header(df: DataFrame) -> DataFrame:
    """Column names trimmed and lower-cased."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def in_file_order(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Adds a number that follows file name, then place in the file, for keep-first and keep-last."""
    return df.withColumn(seq, F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row")))


def read_tsv(spark: SparkSession, *paths: str) -> DataFrame:
    """All strings; files or folders, .gz too."""
    return in_file_order(clean_header(spark.read.csv(list(paths), sep="\t", header=True, inferSchema=False)))


def read_csv(spark: SparkSession, *paths: str, encoding: str = "UTF-8") -> DataFrame:
    return in_file_order(spark.read.csv(list(paths), header=True, inferSchema=False, encoding=encoding))


def read_latin1(spark: SparkSession, *paths: str) -> DataFrame:
    return read_csv(spark, *paths, encoding="ISO-8859-1")


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV by its suffix."""
    kind = Path(path).suffix.lower()
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind in (".csv", ".tsv", ".txt"):
        return spark.read.csv(path, header=True, inferSchema=False, sep="," if kind == ".csv" else "\t")
    raise ValueError(f"neither parquet nor text: {path}")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def removed(spark: SparkSession, path: str) -> bool:
    """Deletes a file or a folder with what is in it; whether there was one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))


def read_optional(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A table, or an empty one of a schema where there is none."""
    return spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()


def row_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def run_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()


def coordinates(df: DataFrame) -> DataFrame:
    """(fips, lat, lon) from a gazetteer with geoid, intptlat, intptlong; rows without finite numbers go."""
    from ..functions.nulls import to_double
    from ..functions.text import canonical_code

    df = clean_header(df)
    rows = df.select(canonical_code(F.col("geoid")).alias("fips"), to_double(F.col("intptlat")).alias("lat"), to_double(F.col("intptlong")).alias("lon"))
    return rows.where("lat IS NOT NULL AND lon IS NOT NULL").dropDuplicates(["fips"])


def _at(path: str):
    """A path and its file system as Spark sees them, wherever the driver runs."""
    spark = SparkSession.active()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def matching(folder: str, pattern: str) -> list[str]:
    fs, p = _at(f"{folder.rstrip('/')}/{pattern}")
    return sorted(s.getPath().toString().removeprefix("file:") for s in fs.globStatus(p) or [])


def discover(folder: str, patterns: list[str]) -> str | None:
    """The first file, by name, of the first pattern that has one."""
    for p in patterns:
        if found := matching(folder, p):
            return found[0]
    return None


def for_year(names: list[str], year: int) -> list[str]:
    """Names that hold a year as a token of its own."""
    return [n for n in names if re.search(rf"(?<!\d){year}(?!\d)", n)]


def read_json(path: str, required: bool = True) -> dict:
    fs, p = _at(path)
    if not fs.exists(p) and not required:
        return {}
    out = json.loads(SparkSession.active().read.text(path, wholetext=True).first().value)
    if not isinstance(out, dict):
        raise ValueError(f"not a mapping: {path}")
    return out


def write_text(text: str, path: str) -> None:
    fs, p = _at(path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_runs(folder: str, required: list[str], **wanted: object) -> list[dict]:
    """JSON payloads of a folder that have all required fields and the wanted values."""
    runs = [read_json(p) for p in matching(folder, "*.json")]
    return [r for r in runs if all(k in r for k in required) and all(r.get(k) == v for k, v in wanted.items())]

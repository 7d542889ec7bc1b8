"""Writing tables: overwrite, schema-checked append, one part per year, repeats that change nothing, run records."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.relational import not_done, partly_done
from .files import exists, write_text


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share, from spark.checkpoint.dir; where that is unset, a local one on a local master and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or "file:///tmp/checkpoints/panelweave").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/panelweave/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df by way of a table in the shared folder, at a path of its own: a cut of lineage that survives lost executors."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, what an execution has shuffled is deleted when it ends, not when the driver happens to collect its garbage: for iterations over written tables."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def overwrite_by(df: DataFrame, path: str, *columns: str) -> None:
    """One folder per value, for instance per year."""
    df.repartition(*columns).write.mode("overwrite").option("compression", "zstd").partitionBy(*columns).parquet(path)


def shape(schema: StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema]


def append_checked(df: DataFrame, path: str) -> None:
    """Appends; a schema that differs from the table's raises."""
    spark = df.sparkSession
    if exists(spark, path) and shape(spark.read.parquet(path).schema) != shape(df.schema):
        raise ValueError(f"schema differs: {shape(df.schema)} against {shape(spark.read.parquet(path).schema)}")
    df.write.mode("append").option("compression", "zstd").parquet(path)


def append_new(df: DataFrame, path: str, keys: list[str], expected: DataFrame | None = None) -> DataFrame:
    """Appends the rows whose keys the table lacks and gives them. With expected (keys, n) a partly written key raises."""
    spark = df.sparkSession
    if not exists(spark, path):
        append_checked(df, path)
        return df
    have = spark.read.parquet(path)
    if expected is not None and not (bad := partly_done(expected, have, keys, "n")).isEmpty():
        raise ValueError(f"partly written: {bad.first()}")
    new = written(not_done(df, have, keys), "append")
    append_checked(new, path)
    return new


def sorted_inside(df: DataFrame, *columns: str) -> DataFrame:
    return df.sortWithinPartitions(*columns)


def write_json(payload: dict, path: str) -> None:
    write_text(json.dumps(payload, indent=2, sort_keys=True, default=str), path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(most).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])

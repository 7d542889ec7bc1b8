"""Frames that stand for the panel on the driver's tables, and the same as SQL.

county = customer, state = nation, division = region, level = yearly order
totals in whole cents (exact in both engines), baseline = the year before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import zfill

PRIORITY = "substring(o_orderpriority, 1, 1)"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cents(c) -> F.Column:
    return F.round(c * 100).cast("long")


def counties(spark: SparkSession, d: str) -> DataFrame:
    """fips, state, division: the dimension."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    both = c.join(n, c.c_nationkey == n.n_nationkey)
    return both.select(zfill(F.col("c_custkey").cast("string"), 5).alias("fips"), zfill(F.col("c_nationkey").cast("string"), 2).alias("state"), F.col("n_regionkey").cast("int").alias("division"), F.col("c_acctbal").alias("acctbal"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    """fips, year, month, code, cents of every order."""
    o = table(spark, d, "orders")
    return o.select(
        zfill(F.col("o_custkey").cast("string"), 5).alias("fips"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
        F.substring("o_orderpriority", 1, 1).alias("code"), cents(F.col("o_totalprice")).alias("cents"), F.col("o_orderkey").alias("orderkey"), F.col("o_orderdate").alias("orderdate"),
    )


def yearly(spark: SparkSession, d: str) -> DataFrame:
    """fips, year, level (whole cents as double), n."""
    return orders(spark, d).groupBy("fips", "year").agg(F.sum("cents").cast("double").alias("level"), F.count(F.lit(1)).alias("n"))


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """state, year, month, level, n."""
    o, c = orders(spark, d), counties(spark, d).select("fips", "state")
    return o.join(c, "fips").groupBy("state", "year", "month").agg(F.sum("cents").cast("double").alias("level"), F.count(F.lit(1)).alias("n"))


def panel(spark: SparkSession, d: str) -> DataFrame:
    """fips, state, division, year, truth and base (the year before), where both are there; fold is the division's number from 1."""
    y = yearly(spark, d)
    before = y.select("fips", (F.col("year") + 1).alias("year"), F.col("level").alias("base"))
    both = y.select("fips", "year", F.col("level").alias("truth")).join(before, ["fips", "year"]).where("truth > 0 AND base > 0")
    return both.join(counties(spark, d), "fips").withColumn("fold", F.col("division") + 1)


def errors(spark: SparkSession, d: str) -> DataFrame:
    """panel rows for three models: pep = the year before, mid = half way to the truth's rounding, far = three quarters of it."""
    p = panel(spark, d)
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(w).alias("w")) for m, w in (("pep", 0.0), ("mid", 0.5), ("far", -0.25))]))
    e = p.withColumn("_m", models).select("*", "_m.model", "_m.w").drop("_m")
    e = e.withColumn("pred", F.col("base") + F.col("w") * (F.col("truth") - F.col("base"))).where("pred > 0").drop("w")
    return e.withColumn("ape", F.abs(F.col("pred") - F.col("truth")) / F.col("truth") * 100)


ORDERS = """orders_ AS (SELECT lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(5, length(CAST(o_custkey AS VARCHAR))) AS INT), '0') AS fips, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month,
  substr(o_orderpriority, 1, 1) AS code, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderkey AS orderkey, o_orderdate AS orderdate FROM orders)"""
COUNTIES = """counties AS (SELECT lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(5, length(CAST(c_custkey AS VARCHAR))) AS INT), '0') AS fips, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS state,
  CAST(n_regionkey AS INT) AS division, c_acctbal AS acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
YEARLY = ORDERS + """, yearly AS (SELECT fips, year, CAST(sum(cents) AS DOUBLE) AS level, count(*) AS n FROM orders_ GROUP BY fips, year)"""
MONTHLY = ORDERS + ", " + COUNTIES + """, monthly AS (SELECT state, year, month, CAST(sum(cents) AS DOUBLE) AS level, count(*) AS n FROM orders_ JOIN counties USING (fips) GROUP BY state, year, month)"""
PANEL = YEARLY + ", " + COUNTIES + """, panel AS (SELECT y.fips, y.year, y.level AS truth, b.level AS base, c.state, c.division, c.acctbal, c.division + 1 AS fold
  FROM yearly y JOIN yearly b ON y.fips = b.fips AND y.year = b.year + 1 JOIN counties c ON c.fips = y.fips WHERE y.level > 0 AND b.level > 0)"""
ERRORS = PANEL + """, errors AS (SELECT *, abs(pred - truth) / truth * 100 AS ape FROM (SELECT p.*, m.model, base + w * (truth - base) AS pred
  FROM panel p CROSS JOIN (VALUES ('pep', 0.0::DOUBLE), ('mid', 0.5::DOUBLE), ('far', -0.25::DOUBLE)) AS m(model, w)) WHERE pred > 0)"""

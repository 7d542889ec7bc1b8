r"""Exact duplicates, combined in three steps so that no hot text meets one task.

Texts are equal when they are identical after deleting blanks (U+0020, U+0009
to U+000D). Grouping is always by the whole normalised text next to its
digest: (1) each map task combines its own rows (partial aggregation), (2) the
groups meet by digest and the task's salt, (3) the salt winners meet by digest.
The decision travels back the same way: digest -> (digest, salt) -> rows, and no
text goes along to the comparison. There every row has a salt of its own, drawn
once and written with its digest and rank, so that copies without an id, or with
one id, are spread like others. Digests that stand for two texts raise an error.

The row with the most code points in its original text stays, then the
smallest doc_id. Null text counts as empty; a null doc_id comes after all
others and stays (keep_id null) only where a class has no other at its length.
Rows that share doc_id and length with the one that stays are ties and all
carry kept; ``kept_rows`` leaves one of them, the least by all its columns that
can be ordered (maps and variants cannot).
Texts of any length are compared whole. Extra columns go along whatever their
names; only those named like a result are replaced. An empty table gives an
empty result.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, staged, text_of

SALTS = 32
TOP = 9223372036854775807
#: rank = code points * UNIT + (TOP + 1 - doc_id, 0 for null): one number that hash aggregation can keep in place.
UNIT = Decimal(10) ** 20


def normal(text: Column) -> Column:
    return F.regexp_replace(text, f"{BLANKS}+", "")


def rank_of(n: Column, doc_id: Column) -> Column:
    left = F.coalesce(F.lit(Decimal(TOP) + 1).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return (n.cast("decimal(10,0)") * F.lit(UNIT).cast("decimal(21,0)") + left).cast("decimal(38,0)")


def doc_of(rank: Column) -> Column:
    left = F.pmod(rank, F.lit(UNIT).cast("decimal(21,0)"))
    return F.when(left > 0, (F.lit(Decimal(TOP) + 1).cast("decimal(20,0)") - left).cast("long"))


def salted(df: DataFrame, text: str, salt: Column, row: list[str]) -> DataFrame:
    """_digest, _salt, _rank and _norm of every row; _row holds the row's columns named."""
    t, doc = text_of(text), F.col("doc_id").cast("long")
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in row]).alias("_row"), salt.cast("int").alias("_salt"), rank_of(F.length(t), doc).alias("_rank"), normal(t).alias("_norm"))
    return out.withColumn("_digest", F.sha2(F.col("_norm").cast("binary"), 256))


def classes(df: DataFrame, text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per class of equal texts: _digest, keep_id, group_size and _rank of the row that stays."""
    rows = salted(df.select("doc_id", text), text, F.pmod(F.spark_partition_id(), F.lit(salts)), ["doc_id"])
    by_salt = rows.groupBy("_digest", "_salt", "_norm").agg(F.max("_rank").alias("_rank"), F.count(F.lit(1)).alias("_size"))
    whole = by_salt.groupBy("_digest", "_norm").agg(F.max("_rank").alias("_rank"), F.sum("_size").alias("_size"))
    one = whole.groupBy("_digest").agg(F.max("_rank").alias("_rank"), F.max("_size").alias("group_size"), F.count(F.lit(1)).alias("_texts"))
    sure = F.when(F.col("_texts") > 1, F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long")).otherwise(F.col("group_size"))
    return one.select("_digest", doc_of(F.col("_rank")).alias("keep_id"), sure.alias("group_size"), "_rank")


def with_classes(df: DataFrame, text: str = "text", salts: int = SALTS, row: list[str] | None = None) -> DataFrame:
    """df, or its columns row, with keep_id, group_size, kept and text_sha256."""
    had = [c for c in row or df.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    rows = staged(salted(df, text, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)), had).drop("_norm"), "dedup_rows")
    found = classes(df, text, salts).select(F.col("_digest").alias("_d"), "keep_id", "group_size", F.col("_rank").alias("_best"))
    # a class goes to each of its salts before it meets the rows
    pairs = rows.select("_digest", "_salt").distinct()
    spread = pairs.join(found, pairs["_digest"] == found["_d"]).select("_d", F.col("_salt").alias("_s"), "keep_id", "group_size", "_best")
    both = rows.join(spread, (rows["_digest"] == spread["_d"]) & (rows["_salt"] == spread["_s"]))
    return both.select("_row.*", "keep_id", "group_size", (F.col("_rank") == F.col("_best")).alias("kept"), F.col("_digest").alias("text_sha256"))


def kept_rows(df: DataFrame, text: str = "text", salts: int = SALTS) -> DataFrame:
    """df without copies: one row of each class. Rows meet the classes by digest and rank, so that of a hot class one row alone finds a partner; texts move once."""
    winners = classes(df, text, salts).select(F.col("_digest").alias("_d"), F.col("_rank").alias("_best"))
    rows = salted(df, text, F.lit(0), df.columns).drop("_norm", "_salt")
    met = rows.join(winners.hint("merge"), (rows["_digest"] == winners["_d"]) & (rows["_rank"] == winners["_best"]))
    ordered = F.struct(*[F.col(f"_row.`{f.name}`") for f in df.schema if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))])
    return met.groupBy("_digest", "_rank").agg(F.min_by("_row", ordered).alias("_row")).select("_row.*")


def report(df: DataFrame) -> DataFrame:
    return with_classes(df.select("doc_id", "text"), row=["doc_id"])


SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, length(t) AS n, first_value(length(t)) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS most,
  first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, cast(group_size AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM keep_id AND n = most AS kept, sha256(norm) AS text_sha256 FROM r
"""

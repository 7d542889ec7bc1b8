"""Orders in which samples are seen: each once an epoch, the same in all modalities, without sorting a table.

Samples are numbered once (0 to n - 1). An epoch's order is a keyed permutation
of that range, worked out for each row alone: a swap-or-not shuffle, whose rounds pair
a number with another one and swap them or not by a hash of the pair, so that it is one to one whatever n is.
A row's place needs n, the seed and the epoch and nothing of other rows.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.sinks import written

ROUNDS = 48
PER_BUCKET = 100_000


def permuted(index: Column, n: int, key: str, rounds: int = ROUNDS) -> Column:
    """Where the permutation named by ``key`` puts a number of [0, n). Equal keys give equal orders; the key names seed and epoch."""
    if n <= 1:
        return index.cast("long")
    rng = random.Random(key)
    steps = F.array(*[F.struct(F.lit(rng.randrange(n)).cast("long").alias("k"), F.lit(rng.getrandbits(63)).cast("long").alias("h")) for _ in range(rounds)])

    def step(x: Column, s: Column) -> Column:
        other = F.pmod(s["k"] - x, F.lit(n).cast("long"))
        return F.when(F.pmod(F.xxhash64(s["h"], F.greatest(x, other)), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(steps, index.cast("long"), step)


def numbered(samples: DataFrame, keys: list[str], per_bucket: int = PER_BUCKET) -> tuple[DataFrame, int]:
    """(keys, index) of the distinct samples, numbered from 0 without a gap, and how many they are. Rows with a null key are no samples.

    Samples are dealt to buckets of about ``per_bucket`` by hash and numbered inside them; one running sum goes over the buckets.
    """
    known = samples.select(*keys).dropna().distinct()
    n = known.count()
    buckets = max(1, -(-n // per_bucket))
    dealt = written(known.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets))), "samples")
    starts = dealt.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy().orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # a row for each bucket
    starts = starts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_b").orderBy(*keys)) - 1
    found = dealt.withColumn("_i", inside).join(starts, "_b").select(*keys, (F.col("_start") + F.col("_i")).alias("index"))
    return written(found, "numbered"), n


def common_samples(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """The keys that every modality has."""
    first, *rest = frames.values()
    out = first.select(*keys).dropna().distinct()
    for f in rest:
        out = out.join(f.select(*keys), keys, "left_semi")
    return out


def in_order(frame: DataFrame, index: DataFrame, n: int, keys: list[str], epoch: int, batch: int, seed: int = 0, shuffle: bool = True) -> DataFrame:
    """frame's rows whose samples are numbered, with position (0 to n - 1) and batch (position / size, the last may be smaller) of an epoch. Several rows of a sample share its place. Call it for each modality with the same index."""
    if batch < 1:
        raise ValueError("a batch holds at least one sample")
    at = permuted(F.col("index"), n, f"{seed} {epoch}") if shuffle else F.col("index")
    return frame.join(index, keys).withColumn("position", at).drop("index").withColumn("batch", F.floor(F.col("position") / F.lit(batch)).cast("long"))


def year_of(years: list[int], step: int, seed: int = 0) -> int:
    """The year of a step: every cycle visits each year once, in an order of its own."""
    known = sorted(set(years))
    if not known:
        raise ValueError("at least one year is required")
    cycle, at = divmod(step, len(known))
    return random.Random(f"years {seed} {cycle}").sample(known, len(known))[at]


def collated(placed: DataFrame, value: str) -> DataFrame:
    """A row for each batch: its samples' number, and for each of its rows, in order of position, the value and the place of its sample in the batch. A batch's rows stand in one row: its size bounds it where samples have few rows."""
    rows = placed.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("position", F.col(value).alias("v")))).alias("_r"), F.min("position").alias("_low"), F.countDistinct("position").alias("n_samples"))
    return rows.select("batch", "n_samples", F.transform("_r", lambda r: r["v"]).alias("values"), F.transform("_r", lambda r: (r["position"] - F.col("_low")).cast("int")).alias("sample"))

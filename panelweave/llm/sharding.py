r"""Sharding by a minimax contiguous partition.

Equal texts form an atomic group. Groups are ordered by digest; that order is
cut into ``shards`` runs whose largest byte total is as small as possible: a
binary search tries capacities, a greedy pass checks each. Under the smallest
feasible capacity the cuts are then laid as evenly as it allows.

The order itself never reaches the driver. The search runs over totals of
digest blocks. A block of several groups gives every cut a lower and an upper
bound, and so the capacity; while the two differ, the blocks in which a cut may
fall are split 256 ways and read again. The first round has 65,536 totals, a
later one at most 256 for each of the few blocks around each cut, whatever the
size of the table.

Null text counts as empty (0 bytes, size 8, one group with ''). Repeated rows
are rows of one group; ties in digest go by doc_id. Texts of any length are
sized and hashed whole; a group is never cut, so one larger than an equal share
sets the capacity. Extra columns, whatever their names, are not read. An empty
table gives an empty result. With fewer groups than shards some are empty.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import staged, text_of

FIRST, STEP = 4, 2  # hex digits of the first blocks, and those added by a round
BUCKETS, ROWS_A_BUCKET = 64, 20_000


class Order:
    """Blocks in order of digest: (prefix, total, groups)."""

    def __init__(self, blocks: list[tuple[str, int, int]], shards: int):
        self.blocks, self.shards = sorted(blocks), shards
        self.ends = [0, *accumulate(b[1] for b in self.blocks)]
        self.total = self.ends[-1]

    def sure(self, x: int, capacity: int) -> int:
        """The farthest end of a block that a shard which begins at x surely reaches."""
        return self.ends[bisect_right(self.ends, x + capacity) - 1]

    def hoped(self, x: int, capacity: int) -> int:
        """How far it may reach at best, if blocks of several groups can be cut anywhere."""
        i = bisect_right(self.ends, x + capacity) - 1
        return self.ends[i] if i == len(self.blocks) or self.blocks[i][2] == 1 else x + capacity

    def cuts(self, capacity: int, reach, x: int = 0, shards: int | None = None) -> list[int]:
        out = []
        for _ in range(self.shards if shards is None else shards):
            x = reach(x, capacity)
            out.append(x)
        return out

    def fits(self, capacity: int, reach, x: int = 0, shards: int | None = None) -> bool:
        n = self.shards if shards is None else shards
        return x >= self.total or n > 0 and self.cuts(capacity, reach, x, n)[-1] >= self.total

    def smallest(self, reach) -> int:
        low, high = -(-self.total // self.shards), self.total
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.fits(mid, reach) else (mid + 1, high)
        return low

    def open(self, low: int, high: int) -> list[str]:
        """Prefixes of the blocks of several groups in which a cut may fall."""
        out = set()
        for a, b in zip(self.cuts(low, self.sure), self.cuts(high, self.hoped), strict=True):
            for i in range(max(bisect_right(self.ends, a) - 1, 0), min(bisect_left(self.ends, b) + 1, len(self.blocks))):
                if self.blocks[i][2] > 1:
                    out.add(self.blocks[i][0])
        return sorted(out)

    def even_cuts(self, capacity: int) -> list[str]:
        """Prefixes at which shards 1, 2, ... begin: the end nearest to an equal share of the rest that keeps the rest feasible."""
        x, out = 0, []
        for left in range(self.shards, 1, -1):
            ideal = x + (self.total - x) / left
            i = bisect_left(self.ends, ideal)
            near = sorted({self.ends[j] for j in (i - 1, i) if 0 <= j < len(self.ends)}, key=lambda e: abs(e - ideal))
            ok = [e for e in near if x <= e <= x + capacity and self.fits(capacity, self.sure, e, left - 1)]
            x = ok[0] if ok else self.sure(x, capacity)
            at = bisect_left(self.ends, x)
            out.append(self.blocks[at][0] if at < len(self.blocks) else "g")
        return out


def sized(df: DataFrame, text: str = "text") -> list[Column]:
    t = text_of(text).cast("binary")
    return [(F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.sha2(t, 256).alias("_digest")]


def partition(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest capacity and the digest prefixes at which shards begin. groups: (_digest, total), one row per group."""

    def read(n: int, within: list[str] | None) -> list[tuple[str, int, int]]:
        g = groups if within is None else groups.join(F.broadcast(groups.sparkSession.createDataFrame([(p,) for p in within], "_p string")), F.substring("_digest", 1, n - STEP) == F.col("_p"), "left_semi")
        return [tuple(r) for r in g.groupBy(F.substring("_digest", 1, n).alias("p")).agg(F.sum("total"), F.count(F.lit(1))).collect()]

    n, order = FIRST, Order(read(FIRST, None), shards)
    while True:
        low, high = order.smallest(order.hoped), order.smallest(order.sure)
        if low >= high:
            return high, order.even_cuts(high)
        fine = order.open(low, high)
        # blocks that stayed closed in an earlier round have shorter prefixes; they are split to this round's depth step by step
        depth = min(len(p) for p in fine)
        now = [p for p in fine if len(p) == depth]
        n = depth + STEP
        gone = set(now)
        order = Order([b for b in order.blocks if b[0] not in gone] + read(n, now), shards)


def assign(df: DataFrame, shards: int = 24, text: str = "text") -> DataFrame:
    """df's doc_id with size, text_crc32, law, shard, slot, grown_shard."""
    rows = staged(df.select("doc_id", *sized(df, text)), "shard_rows")
    groups = staged(rows.groupBy("_digest").agg(F.sum("size").alias("total")), "shard_groups")
    _, cuts = partition(groups, shards)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("_digest") >= c).cast("int")
    n = rows.count()
    buckets = max(BUCKETS, -(-n // (shards * ROWS_A_BUCKET)))
    placed = rows.withColumn("shard", shard).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_digest"), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("shard").orderBy("_bucket")) - F.col("_n")
    offsets = counts.select(F.col("shard").alias("_s"), F.col("_bucket").alias("_b"), before.alias("_before"))
    place = F.row_number().over(W.partitionBy("shard", "_bucket").orderBy("_digest", "doc_id")) - 1
    numbered = placed.withColumn("_place", place)
    both = numbered.join(offsets, (F.col("shard") == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return both.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + F.col("_place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

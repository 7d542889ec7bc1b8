"""Agreement of embeddings with geography: soft-rank loss over each node's neighbours with its gradient, and the linear dependence penalty.

A node's neighbours, few by construction, are one list; their ranks by similarity should be their ranks
by distance. Soft ranks are the projection of the scaled values on the permutahedron, found
by pooling adjacent violators; with little strength they are the ranks themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import finite

ENTRIES = 50_000  # neighbours that a task works on at a time, or one node's
LOSS = "n long, soft double, hard double, dst array<{0}>, gradient array<double>"


def pooled(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest sequence that does not rise, and the number of the block that each entry is in: one pass with merging of adjacent violators."""
    sums, sizes = [], []
    for v in y.tolist():
        sums.append(v)
        sizes.append(1)
        while len(sums) > 1 and sums[-1] * sizes[-2] > sums[-2] * sizes[-1]:
            s, n = sums.pop(), sizes.pop()
            sums[-1] += s
            sizes[-1] += n
    block = np.repeat(np.arange(len(sizes)), sizes)
    return (np.array(sums) / np.array(sizes))[block], block


def soft_ranks(x: np.ndarray, strength: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rising soft ranks from 1, the order of x from the largest, and the blocks in that order."""
    order = np.argsort(-x, kind="stable")
    z = x[order] / strength
    flat, block = pooled(z - np.arange(len(x), 0, -1))
    out = np.empty(len(x))
    out[order] = z - flat
    return out, order, block


def back(g: np.ndarray, order: np.ndarray, block: np.ndarray, strength: float) -> np.ndarray:
    """What a gradient by soft ranks is by the values: less its mean in each block."""
    s = g[order]
    s = s - (np.bincount(block, s) / np.bincount(block))[block]
    out = np.empty(len(g))
    out[order] = s / strength
    return out


def rank_loss(similarity: np.ndarray, distance: np.ndarray, strength: float, normalised: bool) -> tuple[float, float, np.ndarray]:
    """Mean squared difference of soft ranks (nearest and most similar first), of hard ranks, and the soft one's gradient by similarity."""
    n, unit = len(similarity), max(len(similarity) - 1.0, 1.0) if normalised else 1.0
    a, order, block = soft_ranks(-similarity, strength)
    b, _, _ = soft_ranks(distance, strength)
    off = (a - b) / unit
    hard = lambda v: np.argsort(np.argsort(v, kind="stable"), kind="stable")
    return float((off**2).mean()), float((((hard(-similarity) - hard(distance)) / unit) ** 2).mean()), -back(2 * off / n / unit, order, block, strength)


def geo_rank_losses(pairs: DataFrame, strength: float = 1.0, normalised: bool = True) -> DataFrame:
    """Per node with at least two neighbours: n, soft and hard loss, and the soft loss's gradient by the similarity to each neighbour.

    pairs: src, dst, distance, similarity; a node's neighbours must be few (nearest ones, or those within a radius, as the
    neighbour operators give them), for they are one list. Pairs with a null or not finite entry are out; equal values rank in
    order of dst.
    """
    sound = pairs.where(finite(F.col("distance")).isNotNull() & finite(F.col("similarity")).isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull())
    lists = sound.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", F.col("distance").cast("double").alias("d"), F.col("similarity").cast("double").alias("s")))).alias("_l"))
    lists = lists.where(F.size("_l") >= 2).select("src", F.col("_l.dst").alias("dst"), F.col("_l.d").alias("d"), F.col("_l.s").alias("s"))
    least = max(strength, 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, begin = b.column(1).value_lengths().to_numpy().cumsum(), 0
            while begin < b.num_rows:
                so_far = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, so_far + ENTRIES, side="right")))
                rows = b.slice(begin, end - begin)
                at = np.r_[0, ends[begin:end] - so_far]
                d, s = (rows.column(i).flatten().to_numpy() for i in (2, 3))
                found = [rank_loss(s[i:j], d[i:j], least, normalised) for i, j in zip(at, at[1:])]
                gradient = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([f[2] for f in found])))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(at), pa.int64()), pa.array([f[0] for f in found]), pa.array([f[1] for f in found]), rows.column(1), gradient], ["src", "n", "soft", "hard", "dst", "gradient"])
                begin = end

    kinds = dict(pairs.dtypes)
    return lists.mapInArrow(run, f"src {kinds['src']}, {LOSS.format(kinds['dst'])}")


def dependence(rows: DataFrame, a: str, b: str, eps: float = 1e-6) -> DataFrame:
    """One row, n and penalty: the mean over pairs of entries of two array columns of their squared correlation, divisor n - 1 for products and n for deviations. Null or not finite entries count as 0; one row or none gives 0."""
    first = rows.select(F.size(a).alias("p"), F.size(b).alias("q")).where("p > 0 AND q > 0").first()
    if first is None:
        return rows.agg(F.count(F.lit(1)).alias("n"), F.lit(0.0).alias("penalty"))
    p, q = first
    names = [f"a{i}" for i in range(p)] + [f"b{j}" for j in range(q)]
    flat = rows.select(*[F.coalesce(finite(F.col(c)[i].cast("double")), F.lit(0.0)).alias(f"{x}{i}") for c, x, m in ((a, "a", p), (b, "b", q)) for i in range(m)])
    means = flat.agg(*[F.avg(n).alias(f"m_{n}") for n in names])
    off = flat.crossJoin(F.broadcast(means)).select(*[(F.col(n) - F.col(f"m_{n}")).alias(n) for n in names])  # one row of means
    sums = off.agg(F.count(F.lit(1)).alias("n"), *[F.greatest(F.sqrt(F.avg(F.col(n) * F.col(n))), F.lit(eps)).alias(f"s_{n}") for n in names], *[F.sum(F.col(f"a{i}") * F.col(f"b{j}")).alias(f"c_{i}_{j}") for i, j in product(range(p), range(q))])
    squares = F.array(*[F.pow(F.col(f"c_{i}_{j}") / F.col(f"s_a{i}") / F.col(f"s_b{j}") / F.greatest(F.col("n") - 1, F.lit(1)), 2) for i, j in product(range(p), range(q))])
    total = F.aggregate(squares, F.lit(0.0), lambda x, y: x + y)
    return sums.select("n", F.when(F.col("n") > 1, total / (p * q)).otherwise(0.0).alias("penalty"))

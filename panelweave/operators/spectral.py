"""Moran bases of graphs of any size: block Lanczos whose operator is a product with the edge table.

The matrix is never built. Edges are the symmetrised row-top-k of the weights;
a product of the doubly centred matrix with a block of vectors is one join of
edges with vector rows, one sum by node, and a subtraction of the mean. New
blocks are made orthogonal to all before them twice, from inner products that
tasks sum up for their own rows. What reaches the driver is the projected
matrix, whose size follows from the number of vectors alone; a task holds a
batch of rows. Every block is a written table, so a lost executor costs no more
than one step.

The basis has a bounded number of vectors for each node: when it is full, the
best Ritz vectors take its place and the iteration goes on from them (a thick
restart). A table goes as soon as the next one is written, and what a step has
shuffled goes with the step, so that disk does not grow with the steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.files import removed
from ..sources.sinks import new_path, shuffles_removed, written

SPARE = 8  # vectors of a block beyond those asked for
STEPS = 300
BLOCKS, KEPT = 8, 4  # blocks of a basis at most, and how many blocks' worth of Ritz vectors a restart keeps
SMALL = 5120  # nodes up to which the matrix (210 MB) is solved in one task; all counties of a country are fewer


def symmetric_top(edges: DataFrame, row_topk: int) -> DataFrame:
    """(src, dst, weight) of the symmetrised matrix that keeps each row's largest weights, ties by dst, without its diagonal. Weights that are not positive are no edges; repeated edges add up."""
    best = edges.where("weight > 0").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    best = best.withColumn("_r", F.row_number().over(W.partitionBy("src").orderBy(F.desc("weight"), "dst"))).where(F.col("_r") <= row_topk).drop("_r").where("src <> dst")
    half = best.withColumn("weight", F.col("weight") / 2)
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _array(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _lists(x: np.ndarray) -> pa.Array:
    ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32) if x.shape[1] else np.zeros(len(x) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x, np.float64).ravel()))


def inner_products(rows: DataFrame, q: int, w: int, change: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Q'W, W'W and the sums of W's columns, over rows (q, w) of arrays; change(q, w) gives another w first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((q + w + 1, w))
        for b in batches:
            x, y = _array(b, "q", q), _array(b, "w", w)
            y = y if change is None else change(x, y)
            total += np.concatenate([x.T @ y, y.T @ y, y.sum(0)[None]])
        i, j = (k.ravel() for k in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    got = rows.select("q", "w").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((q + w + 1, w))
    for r in got:
        out[r.i, r.j] = r.v
    return out[:q], out[q : q + w], out[-1]


def product(edges: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """nodes (node, q) with w = the matrix times the last width columns of q, not centred."""
    last = nodes.select(F.col("node").alias("dst"), F.slice("q", -width, width).alias("_v"))
    met = edges.join(last, "dst").groupBy(F.col("src").alias("node")).agg(F.array(*[F.sum(F.col("weight") * F.col("_v")[i]) for i in range(width)]).alias("w"))
    return nodes.join(met, "node", "left").withColumn("w", F.coalesce("w", F.array_repeat(F.lit(0.0), width)))


def orthonormal(rows: DataFrame, n: int, q: int, w: int) -> tuple[Callable[..., DataFrame], np.ndarray, np.ndarray]:
    """From rows (node, q, w): the coefficients Q'W and the factor R with which W - mean - Q Q'W = new R, after what writes (node, q with the new columns) to a path; ``turn`` puts Q turn in Q's place there."""
    h1, _, sums = inner_products(rows, q, w)
    mean = sums / n
    step = lambda x, y: y - mean - x @ h1
    h2, g, rest = inner_products(rows, q, w, step)
    left = g - h2.T @ h2 - np.outer(rest, rest) / n
    values, vectors = np.linalg.eigh((left + left.T) / 2)
    kept = values > max(float(np.trace(g)), 0.0) * 1e-24 + 1e-28
    scale = vectors[:, kept] / np.sqrt(values[kept])
    again = rest / n
    both = h1 + h2

    def extended(path: str, turn: np.ndarray | None = None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y = _array(b, "q", q), _array(b, "w", w)
                new = (y - mean - again - x @ both) @ scale
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("node")), _lists(np.concatenate([x if turn is None else x @ turn, new], 1))], ["node", "q"])

        kind = rows.schema["node"].dataType.simpleString()
        return written(rows.select("node", "q", "w").mapInArrow(run, f"node {kind}, q array<double>"), "basis", path)

    return extended, both, (vectors[:, kept] * np.sqrt(values[kept])).T


def _dense(s: DataFrame, nodes: DataFrame, k: int, eps: float, schema: str) -> DataFrame:
    """The same from one matrix; s is symmetric. A row without a partner keeps its node."""

    def one(rows: pa.Table) -> pa.Table:
        names = rows["src"].unique().sort()
        n = len(names)
        w = np.zeros((n, n))
        known = rows.filter(pc.is_valid(rows["dst"]))
        w[pc.index_in(known["src"], names).to_numpy(), pc.index_in(known["dst"], names).to_numpy()] = known["weight"].to_numpy()
        mean = w.mean(0)
        a = w - mean - mean[:, None] + mean.mean()
        del w
        values, vectors = np.linalg.eigh(a)
        top = [i for i in np.argsort(values)[::-1][:k] if values[i] > eps]
        x = vectors[:, top] * np.where(vectors[np.abs(vectors[:, top]).argmax(0), top] < 0, -1.0, 1.0)
        off = np.linalg.norm(a @ x - x * values[top], axis=0)
        m = len(top)
        columns = [names.take(pa.array(np.repeat(np.arange(n), m))), pa.array(np.tile(np.arange(m), n), pa.int32()), pa.array(x.ravel()), pa.array(np.tile(values[top], n)), pa.array(np.tile(off, n))]
        return pa.table([c if isinstance(c, pa.Array) else c.combine_chunks() for c in columns], names=["node", "basis_index", "basis_value", "eigenvalue", "residual"])

    rows = nodes.select(F.col("node").alias("src")).join(s, "src", "left").select("src", "dst", "weight", F.lit(0).alias("_g"))
    return rows.groupBy("_g").applyInArrow(lambda t: one(t.drop(["_g"])), schema)


def moran_basis_of(
    edges: DataFrame, k: int, row_topk: int, eps: float = 1e-9, tol: float = 1e-8, steps: int = STEPS, seed: int = 0, small: int = SMALL, blocks: int = BLOCKS, kept: int = KEPT
) -> DataFrame:
    """(node, basis_index, basis_value, eigenvalue, residual): the k largest eigenpairs over eps of the doubly centred matrix of an edge table.

    Vectors have unit length, their largest entry is positive. residual is the length of
    what the matrix makes of a vector less eigenvalue times the vector; the iteration ends when it is under tol times the
    largest eigenvalue for all k, when the vectors span all that the matrix reaches, or after ``steps`` blocks. A basis of
    ``blocks`` blocks is brought down to ``kept`` blocks' worth of its best vectors. A graph of
    at most ``small`` nodes (they are counted) is solved as a dense matrix in one task.
    """
    spark = edges.sparkSession
    s = written(symmetric_top(edges, row_topk), "symmetric")
    ends = written(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct(), "nodes")
    kind = ends.schema["node"].dataType.simpleString()
    schema = f"node {kind}, basis_index int, basis_value double, eigenvalue double, residual double"
    n = ends.count()
    width = min(k + SPARE, max(n - 1, 0))
    if not width:
        return spark.createDataFrame([], schema)
    if n <= small:
        return _dense(s, ends, k, eps, schema)
    with shuffles_removed(spark):
        return _lanczos(s, ends, n, width, k, eps, tol, steps, seed, max(blocks, kept + 2) * width, kept * width)


def _lanczos(s: DataFrame, nodes: DataFrame, n: int, width: int, k: int, eps: float, tol: float, steps: int, seed: int, most: int, kept: int) -> DataFrame:
    """The same from a basis of at most ``most`` vectors, of which a restart keeps ``kept``."""
    spark, kind = s.sparkSession, nodes.schema["node"].dataType.simpleString()
    at = new_path(spark, "lanczos")
    start = F.array(*[F.xxhash64("node", F.lit(seed), F.lit(j)) / float(1 << 63) for j in range(width)])
    extended, _, first = orthonormal(nodes.select("node", F.array().cast("array<double>").alias("q"), start.alias("w")), n, 0, width)
    rows = extended(f"{at}/basis0")
    total = width = len(first)
    t = np.zeros((0, 0))
    for step in range(1, steps + 1):
        made = written(product(s, rows, width), "product", f"{at}/product{step}")
        removed(spark, f"{at}/basis{step - 1}")
        extended, h, r = orthonormal(made, n, total, width)
        grown = np.zeros((total, total))
        grown[: len(t), : len(t)] = t
        grown[:, total - width :] = h
        grown[total - width :, :] = h.T
        grown[total - width :, total - width :] = (h[total - width :] + h[total - width :].T) / 2
        t = grown
        values, y = np.linalg.eigh(t)
        order = np.argsort(values)[::-1]
        top = order[:k]
        residual = np.linalg.norm(r @ y[total - width :, top], axis=0) if len(r) else np.zeros(len(top))
        if not len(r) or step == steps or (residual <= tol * max(abs(values).max(initial=0.0), eps)).all() and len(top) == min(k, n - 1):
            break
        turn = None
        if total + len(r) > most:
            turn, t = y[:, order[:kept]], np.diag(values[order[:kept]])
        rows = extended(f"{at}/basis{step}", turn)
        removed(spark, f"{at}/product{step}")
        width = len(r)
        total = len(t) + width
    held = values[top] > eps
    top, residual = top[held], residual[held]
    ritz = y[:, top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("node")), _lists(_array(b, "q", len(ritz)) @ ritz)], ["node", "v"])

    vectors = written(made.select("node", "q").mapInArrow(run, f"node {kind}, v array<double>"), "moran")
    removed(spark, at)
    if not len(top):
        return spark.createDataFrame([], f"node {kind}, basis_index int, basis_value double, eigenvalue double, residual double")
    size = [F.max_by(F.sign(F.col("v")[j]), F.round(F.abs(F.col("v")[j]), 12)).alias(f"s{j}") for j in range(len(top))]
    signs = vectors.agg(*size).first()
    about = F.array(*[F.struct(F.lit(j).alias("basis_index"), (F.col("v")[j] * F.lit(float(signs[j] or 1.0))).alias("basis_value"), F.lit(float(values[i])).alias("eigenvalue"), F.lit(float(residual[j])).alias("residual")) for j, i in enumerate(top)])
    return vectors.select("node", F.explode(about).alias("x")).select("node", "x.*")

r"""Whitening of embeddings from a compensated covariance.

An entry c becomes the whole number floor(64 * c) + 1000000; each distinct
vector of those is one row of the fit list. Two passes over the written fit
list give the sums and the centred outer products. Both are accumulated in
double-double by error-free transformations: a block of centred rows is cut
into slices of 21 bits, so that every product of two slices is a matrix product
without rounding, and what those give is added with the error of each addition
kept. A task hands on the high and low part of its matrix, one row of the matrix
to a record; the parts merge by matrix row, in double-double again. Only
the merged matrix, whose size follows from the number of dimensions alone,
reaches the driver. There a tridiagonal divide-and-conquer eigen-solve (LAPACK's
syevd behind numpy.linalg.eigh) gives the components; two corrections whose
residuals are in double-double bring them to double precision.

The covariance of the whitened fit list is then measured the same way, centred,
in two more passes; its distance from the identity is identity_error.

Rows without a vector, and rows with a null or non-finite entry, are dropped, as
asked for. A vector of another length than the commonest one of the fit list
(ties: the longer) is not fitted; its rows have null deviation and whitened. A
null or repeated vec_id is carried along, repeated rows are all returned.
Entries beyond 2^46 count as 2^46, which is where their floor is no longer exact.
A component without variance has null whitened and does not count in
identity_error. A deviation beyond a long is null. Equal eigenvalues keep the
solver's order. An empty table gives an empty result, extra columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

COMPONENTS = 16
SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 46
BITS, BLOCK, SLICES = 21, 1024, 5  # 2 * 21 bits and 2^10 rows stay below 2^53; five slices hold 105 bits
PART = "i int, high array<double>, low array<double>"

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b rounded, and what the rounding left."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(x: Pair, y: Pair) -> Pair:
    """x + y in double-double."""
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def sliced(x: Pair) -> list[Pair]:
    """Whole numbers of at most BITS bits and their unit, a power of two for each column, whose products sum up to x."""
    high, low = x
    most = np.abs(high).max(axis=0, initial=0.0)
    unit = np.ldexp(1.0, np.frexp(most)[1])
    out = []
    for _ in range(SLICES):
        unit = unit * 2.0**-BITS
        t = np.rint(high / unit)
        out.append((t, unit))
        high, low = two_sum(high - t * unit, low)
    return out


def dot(a: Pair, b: Pair) -> Pair:
    """The transpose of a times b in double-double: products of slices are exact, their sum is compensated."""
    total = (np.zeros((a[0].shape[1], b[0].shape[1])),) * 2
    for at in range(0, len(a[0]), BLOCK):
        x = sliced((a[0][at : at + BLOCK], a[1][at : at + BLOCK]))
        y = x if b is a else sliced((b[0][at : at + BLOCK], b[1][at : at + BLOCK]))
        for p, (left, unit) in enumerate(x):
            for right, other in y[: SLICES - p]:
                part = (left.T @ right) * unit[:, None] * other
                total = add(total, (part, np.zeros_like(part)))
    return total


def exact(x: Pair, i: int) -> Fraction:
    return Fraction(float(x[0][i])) + Fraction(float(x[1][i]))


def halves(values: list[Fraction]) -> Pair:
    """Fractions as double-double."""
    high = [float(v) for v in values]
    return np.array(high), np.array([float(v - Fraction(h)) for v, h in zip(values, high, strict=True)])


def centred(x: np.ndarray, centre: Pair) -> Pair:
    s, e = two_sum(x, -centre[0])
    return two_sum(s, e - centre[1])


def matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """The vectors of a batch, all of one length, as an integer matrix."""
    lists = batch.column(batch.schema.get_field_index(name))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def accumulated(fit: DataFrame, width: int, left: Callable[[np.ndarray], Pair], right: Callable[[np.ndarray], Pair] | None = None) -> Pair:
    """Sum over the fit list of left(x) transposed times right(x) (left itself where right is None), merged over all tasks in double-double."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = matrix(b, "x", width)
            for at in range(0, len(x), BLOCK):
                rows = x[at : at + BLOCK]
                a = left(rows)
                got = dot(a, a if right is None else right(rows))
                total = got if total is None else add(total, got)
        if total is not None:
            yield records(range(len(total[0])), total)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, Pair] = {}
        for b in batches:
            for i, high, low in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                got = high.values.to_numpy(), low.values.to_numpy()
                rows[i] = add(rows[i], got) if i in rows else got
        if rows:
            yield records(list(rows), tuple(np.array([r[k] for r in rows.values()]) for k in (0, 1)))

    got = fit.select("x").mapInArrow(parts, PART).repartition("i").mapInArrow(merged, PART).orderBy("i").collect()
    return np.array([r.high for r in got]), np.array([r.low for r in got])


def records(rows: list[int] | range, x: Pair) -> pa.RecordBatch:
    lists = [pa.array(list(half), pa.list_(pa.float64())) for half in x]
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *lists], ["i", "high", "low"])


def ones(x: np.ndarray) -> Pair:
    return np.ones((len(x), 1)), np.zeros((len(x), 1))


def components(v: Pair) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the symmetric matrix v.

    numpy.linalg.eigh reduces to tridiagonal form and divides and conquers. A
    correction takes the residuals of that solution in double-double: it makes
    vectors unit and orthogonal, and turns each against the others by what the
    residual says, where their eigenvalues are apart.
    """
    values, vectors = np.linalg.eigh(v[0])
    x = vectors, np.zeros_like(vectors)
    apart = 0.0
    for _ in range(2):
        r = dot(x, x)
        r = add((np.eye(len(values)), np.zeros_like(r[0])), (-r[0], -r[1]))[0]
        s = dot(x, dot(v, x))
        values = np.diag(s[0]) / (1 - np.diag(r))
        off = s[0] - np.diag(np.diag(s[0]))
        apart = 2 * (np.linalg.norm(off, 2) + np.linalg.norm(v[0], 2) * np.linalg.norm(r, 2)) if len(values) else 0.0
        gap = values[None, :] - values[:, None]
        far = np.abs(gap) > apart
        e = np.where(far, (s[0] + values[None, :] * r) / np.where(far, gap, 1.0), r / 2)
        step = dot((x[0].T, x[1].T), (e, np.zeros_like(e)))
        x = add(x, step)
    order = np.argsort(-values, kind="stable")
    return values[order], x[0][:, order]


@dataclass
class Model:
    """What a fit of a bounded number of dimensions gives; it goes to the tasks."""

    n: int
    sums: list[int]
    centre: Pair
    values: np.ndarray
    weights: np.ndarray  # one column for each component with variance
    trace: float
    identity_error: float | None = None

    @property
    def width(self) -> int:
        return len(self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x.astype(np.float64), self.centre)[0] @ self.weights

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2, exactly; None where it does not fit into a long."""
        whole = [s // self.n for s in self.sums]
        rest = [s - self.n * m for s, m in zip(self.sums, whole, strict=True)]
        y = x - np.array(whole, np.int64)
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if most * most * self.width < 1 << 63:
            return ((self.n * y - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        big = [sum((self.n * a - b) ** 2 for a, b in zip(row, rest, strict=True)) for row in y.tolist()]
        return [v if v < 1 << 63 else None for v in big]


def quantised(df: DataFrame, column: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """vec_id and x (array of long) of the rows whose vector has finite entries only."""
    limit = float(LARGEST)

    def whole(c: Column) -> Column:
        return F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), c.cast("double"))) * F.lit(float(SCALE))).cast("long") + F.lit(SHIFT)

    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))

    v = F.col(column)
    return df.where(v.isNotNull() & F.forall(v, finite)).select(F.col(id_column).alias("vec_id"), F.transform(v, whole).alias("x"))


def fitted(rows: DataFrame, k: int = COMPONENTS) -> Model | None:
    """The model of the distinct vectors of rows; None where there are none. rows: as quantised() gives."""
    fit = staged(rows.select("x").distinct(), "fit_list")
    first = fit.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if first is None or first.width == 0:
        return None
    width, n = first.width, first.n
    fit = fit.where(F.size("x") == width)

    def plain(x: np.ndarray) -> Pair:
        return x.astype(np.float64), np.zeros(x.shape)

    total = accumulated(fit, width, ones, plain)
    sums = [int(exact((total[0][0], total[1][0]), i)) for i in range(width)]
    centre = halves([Fraction(s, n) for s in sums])
    products = accumulated(fit, width, lambda x: centred(x.astype(np.float64), centre))
    v = tuple(np.array(half) for half in zip(*(halves([exact((h, low), j) / n for j in range(width)]) for h, low in zip(*products, strict=True)), strict=True))
    values, vectors = components(v)
    trace = float(sum((exact((v[0][i], v[1][i]), i) for i in range(width)), Fraction(0)))
    values, vectors = values[:k], vectors[:, :k]
    full = values > max(values[0], 0.0) * width * np.finfo(float).eps
    model = Model(n, sums, centre, values, vectors[:, full] / np.sqrt(values[full]), trace)
    if full.any():
        model.identity_error = identity_error(fit, model)
    return model


def identity_error(fit: DataFrame, model: Model) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""

    def own(x: np.ndarray) -> Pair:
        w = model.whitened(x)
        return w, np.zeros_like(w)

    total = accumulated(fit, model.width, ones, own)
    mean = halves([exact((total[0][0], total[1][0]), i) / model.n for i in range(model.weights.shape[1])])
    high, low = accumulated(fit, model.width, lambda x: centred(model.whitened(x), mean))
    return max(abs(float(exact((h, w), j) / model.n - (i == j))) for i, (h, w) in enumerate(zip(high, low, strict=True)) for j in range(len(h)))


def report(df: DataFrame, column: str = "embedding", id_column: str = "vec_id", k: int = COMPONENTS) -> DataFrame:
    """A row for each remaining row of df and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = quantised(df, column, id_column)
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fitted(rows, k)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    width, m, known = model.width, len(model.values), model.weights.shape[1]
    share = [float(v) / model.trace if model.trace else None for v in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                fits = pc.equal(pc.list_value_length(part.column(1)), width).to_numpy(zero_copy_only=False)
                x = matrix(part.filter(pa.array(fits)), "x", width)
                white = np.full((part.num_rows, m), np.nan)
                white[np.ix_(fits, range(known))] = model.whitened(x)
                deviation = np.full(part.num_rows, None, object)
                deviation[fits] = model.deviation(x)
                blank = np.tile(np.arange(m) >= known, (part.num_rows, 1)) | ~fits[:, None]
                rows_of = np.repeat(np.arange(part.num_rows), m)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), part.num_rows)), pa.array(np.full(len(rows_of), model.n)),
                    pa.array(deviation.tolist(), pa.int64()).take(pa.array(rows_of)), pa.array(white.ravel(), pa.float64(), mask=blank.ravel()),
                    pa.array(share * part.num_rows, pa.float64()), pa.array([model.identity_error] * len(rows_of), pa.float64()),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)

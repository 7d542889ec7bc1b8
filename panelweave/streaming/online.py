"""A fitted model that a stream keeps correcting, never by more than a fraction of its own length.

A micro batch adds its sums of products, on the base model's scaling, to those of all
batches before; the correction is the ridge fit to the base's residuals over all of
them, shortened where it is longer than ``fraction`` of the base's coefficients. It starts from the base every time, so that corrections
do not add up beyond the bound. The state is one row for each batch in a ledger, under the stream's name
and the batch's number: a batch that comes again changes nothing, and a stream that restarts goes on from the last row.
Sums are partial by task; no task, and not the driver, sees a batch's rows together.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.vectors import all_finite
from ..operators.models import Linear
from ..operators.moments import merged, solved
from ..sources.ledger import Ledger

STATE = "batch long, n double, sums array<double>, delta array<double>, shift double, sigma double, shortened boolean"


def states(spark: SparkSession, folder: str) -> Ledger:
    return Ledger(spark, folder, ["batch"], 1)


def correction(base: Linear, m: np.ndarray, alpha: float, fraction: float) -> tuple[np.ndarray, float, float, bool]:
    """delta, shift, deviation of what is left and whether the bound held it back, from sums of (1, x - mean, y)(1, x - mean, y)' with y the target."""
    n, d = m[0, 0], len(base.mean)
    to = np.eye(d + 2)
    to[1:-1, -1] = -base.coef / base.scale
    to[0, -1] = -base.intercept
    r = to.T @ m @ to  # the same sums with y less the base's prediction
    delta, shift, _ = solved(r, (np.zeros(d), base.scale), alpha * n)
    length, most = math.hypot(float(np.linalg.norm(delta)), shift), fraction * math.hypot(float(np.linalg.norm(base.coef)), base.intercept)
    held = length > most
    shrink = most / length if held else 1.0
    delta, shift = delta * shrink, shift * shrink
    c = np.array([-shift, *(-delta / base.scale), 1.0])
    mean = float(r[0] @ c / n)
    return delta, shift, max(math.sqrt(max(float(c @ r @ c / n) - mean * mean, 0.0)), 1e-6), held


def update(base: Linear, table: Ledger, name: str, alpha: float, fraction: float, rows: DataFrame, batch: int) -> bool:
    """Takes in a batch (x array<double>, y); False where it is in the table. Rows with a null or not finite entry are out; a batch without others commits the state as it was."""
    if any(e.batch == f"{name}-{batch}" for e in table.entries()):
        return False
    d = len(base.mean)
    sound = rows.where(all_finite(F.col("x")) & all_finite(F.array("y")) & (F.size("x") == d)).select(F.lit(0).alias("spec"), F.lit(0).alias("fold"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"))
    m = merged(sound, d, {0: np.array([0.0, *base.mean, 0.0])}).get((0, 0, -1), np.zeros((d + 2, d + 2)))
    if last := latest(table):
        m = m + np.reshape(last["sums"], m.shape)
    delta, shift, sigma, held = correction(base, m, alpha, fraction) if m[0, 0] else (np.zeros(d), 0.0, 0.0, False)
    row = (batch, float(m[0, 0]), m.ravel().tolist(), delta.tolist(), float(shift), float(sigma), bool(held))
    return table.append(f"{name}-{batch}", rows.sparkSession.createDataFrame([row], STATE))


def latest(table: Ledger) -> dict | None:
    """The last state."""
    found = table.read(STATE).orderBy(F.desc("batch")).limit(1).collect()
    return found[0].asDict() if found else None


def corrected(base: Linear, state: dict | None) -> Linear:
    """The base with the last correction; deviations add as for independent errors."""
    if state is None:
        return base
    return Linear(base.mean, base.scale, base.coef + np.array(state["delta"]), base.intercept + state["shift"], math.hypot(base.sigma, state["sigma"]))


def update_stream(rows: DataFrame, base: Linear, folder: str, checkpoint: str, name: str, alpha: float = 5e-3, fraction: float = 0.05) -> StreamingQuery:
    """Starts the stream over rows (x, y); one writer for each folder."""
    take = partial(update, base, states(rows.sparkSession, folder), name, alpha, fraction)
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: take(df, n) and None).trigger(availableNow=True).start()

"""Objectives of the tuners on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import objectives as O
from . import base as B
from .registry import query
from .relational import r
from .storage import folder

LEAK = {k: 0.05 * k for k in range(1, 6)}


def basis_rows(s, d):
    """Year 2000 with four columns, the first the log of the baseline."""
    x = F.array(F.log("base"), F.col("acctbal") / 1000, F.col("division") * 1.0, F.pow(F.log("base") - 12, 2))
    return B.panel(s, d).where("year = 2000").select("fold", x.alias("x"), F.log("truth").alias("y_log"), F.log("base").alias("pep_log"))


_ONE = "WITH " + B.PANEL + """, p AS (SELECT fold, ln(base) AS x, ln(truth) - ln(base) AS y, ln(truth) AS t, abs(base - truth) / truth * 100 AS ape FROM panel WHERE year = 2000),
 f AS (SELECT DISTINCT fold AS k FROM p), m AS (SELECT k, count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) AS c FROM f JOIN p ON fold <> k GROUP BY k),
 q AS (SELECT fold AS k, quantile_cont(ape, 0.9) AS cut FROM p GROUP BY fold),
 e AS (SELECT fold, ape, ape >= cut AS hard, abs(exp(x + my + (x - mx) / sx * (n * c / sx) / (n + 0.5)) - exp(t)) / exp(t) * 100 AS tape FROM p JOIN m ON fold = m.k JOIN q ON fold = q.k),
 g AS (SELECT fold, count(*) AS n, avg(ape) AS b, avg(tape) AS a, sum(CASE WHEN hard THEN 1 ELSE 0 END) AS nh, avg(CASE WHEN hard THEN ape END) AS bh, avg(CASE WHEN hard THEN tape END) AS ah FROM e GROUP BY fold),
 i AS (SELECT *, 100 * (b - a) / b AS rel, 100 * (bh - ah) / bh AS relh FROM g),
 j AS (SELECT *, CASE WHEN rel > 0 THEN rel * (1 - 0.05 * fold) ELSE rel END AS adj, CASE WHEN relh > 0 THEN relh * (1 - 0.05 * fold) ELSE relh END AS adjh FROM i),
 z AS (SELECT avg(b) AS baseline, avg(a) AS treatment, avg(b * (1 - adj / 100)) AS adjusted, avg(bh) AS bh, avg(bh * (1 - adjh / 100)) AS adjustedh, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(nh) AS BIGINT) AS n_hard FROM j)
 SELECT round(baseline, 4) AS baseline, round(treatment, 4) AS treatment, round(adjusted, 4) AS adjusted, n_rows, n_hard,
 round(0.7 * tanh(100 * (baseline - adjusted) / baseline / 5) + 0.2 * tanh(100 * (bh - adjustedh) / bh / 5) + 0.1, 6) AS objective FROM z"""


@query(_ONE)
def ridge_objective_one_column(s, d):
    found = O.scores(O.ready(basis_rows(s, d)), list(LEAK), [O.Candidate(1, "ridge", 0.5)], LEAK, most=4)
    t = O.history(s, found)
    return t.select(*[r(c, 4).alias(c) for c in ("baseline", "treatment", "adjusted")], "n_rows", "n_hard", r("objective").alias("objective"))


@query()
def basis_k_sweep(s, d):
    """Every number of leading columns, Huber, with the best marked."""
    return O.history(s, O.k_sweep(O.ready(basis_rows(s, d)), list(LEAK), LEAK, 4, alpha=1e-3))


@query()
def linear_model_trials(s, d):
    """Two rounds of an adaptive search over the settings of the fit at two columns."""
    space = {"kind": {"type": "categorical", "choices": ["ridge", "huber"]}, "alpha": {"type": "float", "low": 1e-5, "high": 1.0, "log": True}}
    return O.tune_linear(O.ready(basis_rows(s, d)), list(LEAK), 2, LEAK, space, folder(s, "linear_trials"), 2, 6)

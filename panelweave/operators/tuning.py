"""Search over parameters: seeded random trials as a table, stopping rules, the best trial laid over a configuration."""

from __future__ import annotations

import copy
import json
import math
import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def draw(space: dict[str, dict], rng: random.Random) -> dict:
    """One set of parameters. Kinds: int, float (log, step), categorical, bool, fixed; any other raises."""
    out = {}
    for name, s in sorted(space.items()):
        kind = s.get("type")
        if kind == "fixed":
            out[name] = s["value"]
        elif kind == "bool":
            out[name] = rng.random() < 0.5
        elif kind == "categorical":
            out[name] = rng.choice(s["choices"])
        elif kind in ("int", "float"):
            low, high, step = s["low"], s["high"], s.get("step")
            x = math.exp(rng.uniform(math.log(low), math.log(high))) if s.get("log") else rng.uniform(low, high + (kind == "int"))
            if step:
                x = low + round((x - low) / step) * step
            out[name] = max(low, min(high, int(x) if kind == "int" else x))
        else:
            raise ValueError(f"unknown kind {kind!r} of {name}")
    return out


def validated(space: dict, known: set[str], retired: set[str] = frozenset()) -> dict:
    for name in space:
        if name in retired:
            raise ValueError(f"retired dimension {name}")
        if name not in known:
            raise ValueError(f"unknown dimension {name}")
    return space


def trials(spark: SparkSession, space: dict, n: int, objective: Callable[[dict], float], seed: int = 0, first: int = 0) -> DataFrame:
    """(trial, params, score): every trial is a task of its own; one that fails has no score."""
    rows = [(i, json.dumps(draw(space, random.Random(seed * 1_000_003 + i)), sort_keys=True)) for i in range(first, first + n)]

    def one(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        try:
            score = float(objective(json.loads(p["params"][0])))
        except (ArithmeticError, ValueError):
            score = math.nan
        return pd.DataFrame([(key[0], p["params"][0], None if math.isnan(score) else score)], columns=["trial", "params", "score"])

    todo = spark.createDataFrame(rows, "trial long, params string").repartition(min(n, 200), "trial")
    return todo.groupBy("trial").applyInPandas(one, "trial long, params string, score double")


def best(found: DataFrame, largest: bool = True) -> DataFrame:
    """The best trial; the earlier of equal ones."""
    done = found.where("score IS NOT NULL")
    return done.orderBy(F.desc("score") if largest else F.asc("score"), "trial").limit(1)


def generalisation_loss(scores: list[float]) -> float:
    """How much worse (in percent) the last score is than the best so far; smaller is better."""
    return 100 * (scores[-1] / min(scores) - 1) if scores and min(scores) > 0 else 0.0


def should_stop(scores: list[float], patience: int, most_loss: float) -> bool:
    """No improvement for ``patience`` values, or a loss over a bound. Smaller scores are better."""
    if not scores:
        return False
    since = len(scores) - 1 - min(range(len(scores)), key=scores.__getitem__)
    return since >= patience or generalisation_loss(scores) > most_loss


def strips_stop(scores: list[float], strip: int, successive: int) -> bool:
    """The score at the end of each of the last ``successive`` strips is worse than at the end of the one before."""
    ends = scores[strip - 1 :: strip]
    return len(ends) > successive and all(ends[-i] > ends[-i - 1] for i in range(1, successive + 1))


def overlaid(config: dict, params: dict) -> dict:
    """A configuration with dotted parameters put in place; a path that is not there raises."""
    out = copy.deepcopy(config)
    for path, value in params.items():
        at = out
        *way, last = path.split(".")
        for step in way:
            at = at[step]
        if last not in at:
            raise KeyError(path)
        at[last] = value
    return out


def low_k(k: int, most: int) -> float:
    return 1 - (k - 1) / max(most - 1, 1)


def score_of(global_pct: float, hard_pct: float, k: int, most: int, weights: tuple[float, float, float]) -> float:
    """Weighted tanh of both improvements and the preference for few components."""
    parts = (math.tanh(global_pct / 5), math.tanh(hard_pct / 5), 2 * low_k(k, most) - 1)
    return sum(w * p for w, p in zip(weights, parts, strict=True)) / sum(weights)

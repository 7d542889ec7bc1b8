"""Adaptive search: a tree-structured Parzen estimator that asks for trials in rounds, which tasks evaluate.

Of the finished trials the best quarter gives one density for each parameter,
the others a second one; of some candidates drawn from the first, the one with
the largest ratio of both is asked for. Trials that are asked for and not yet
told count among the others, so that a round's trials differ. Spaces are typed
as for random search (int, float with log or step, categorical, bool, fixed).
The trials are a table that is appended to atomically, a round a batch: a search
that starts again reads it and goes on. The table is as long as the budget.
"""

from __future__ import annotations

import json
import math
import random
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ledger import Ledger
from ..sources.sinks import written
from .tuning import draw

TRIALS = "trial long, params string, score double"
GOOD, STARTUP, CANDIDATES = 0.25, 8, 32


class Density:
    """Of one parameter: a mixture of a normal around each value, and the whole range once; or smoothed counts of choices."""

    def __init__(self, spec: dict, values: list):
        self.spec, self.values = spec, values
        self.number = spec["type"] in ("int", "float")
        if self.number:
            self.low, self.high = self._inner(spec["low"]), self._inner(spec["high"])
            self.at = sorted(map(self._inner, values))
            span = max(self.high - self.low, 1e-12)
            self.widths = [min(max(max(self._gaps(i)), span / min(100, 1 + len(self.at))), span) for i in range(len(self.at))]
        else:
            self.choices = [False, True] if spec["type"] == "bool" else spec["choices"]
            self.counts = Counter(map(repr, values))

    def _inner(self, x: float) -> float:
        return math.log(x) if self.spec.get("log") else float(x)

    def _gaps(self, i: int) -> tuple[float, float]:
        return (self.at[i] - (self.at[i - 1] if i else self.low), (self.at[i + 1] if i + 1 < len(self.at) else self.high) - self.at[i])

    def log(self, value: object) -> float:
        if not self.number:
            return math.log((self.counts[repr(value)] + 1) / (len(self.values) + len(self.choices)))
        x, total = self._inner(value), 1 / max(self.high - self.low, 1e-12)
        for m, s in zip(self.at, self.widths, strict=True):
            # of a normal that is cut at the ends of the range
            inside = 0.5 * (math.erf((self.high - m) / (s * math.sqrt(2))) - math.erf((self.low - m) / (s * math.sqrt(2))))
            total += math.exp(-0.5 * ((x - m) / s) ** 2) / (s * math.sqrt(2 * math.pi) * max(inside, 1e-12))
        return math.log(total / (len(self.at) + 1))

    def draw(self, rng: random.Random) -> object:
        if not self.number:
            return rng.choices(self.choices, [self.counts[repr(c)] + 1 for c in self.choices])[0]
        k = rng.randrange(len(self.at) + 1)
        if k == len(self.at):
            return draw({"x": self.spec}, rng)["x"]
        while not self.low <= (x := rng.gauss(self.at[k], self.widths[k])) <= self.high:
            pass
        x, low, step = math.exp(x) if self.spec.get("log") else x, self.spec["low"], self.spec.get("step")
        if step:
            x = low + round((x - low) / step) * step
        x = round(x) if self.spec["type"] == "int" else x
        return max(low, min(self.spec["high"], x))


def ask(space: dict[str, dict], told: list[tuple[dict, float | None]], pending: list[dict], seed: int, largest: bool = True) -> dict:
    """The next set of parameters. told: parameters and scores of finished trials, None where one failed; pending: what has been asked for and not told."""
    rng = random.Random(f"ask {seed}")  # mixed by a hash: neighbouring numbers give like first draws
    done = sorted(((p, s) for p, s in told if s is not None and math.isfinite(s)), key=lambda x: x[1], reverse=largest)
    if len(done) < STARTUP:
        return draw(space, rng)
    cut = max(2, math.ceil(GOOD * math.sqrt(len(done)) * 2)) if len(done) > 16 else max(2, math.ceil(GOOD * len(done)))
    good, rest = [p for p, _ in done[:cut]], [p for p, _ in done[cut:]] + [p for p, s in told if s is None or not math.isfinite(s)] + pending
    out = {}
    for name, spec in sorted(space.items()):
        if spec["type"] == "fixed":
            out[name] = spec["value"]
            continue
        above, below = (Density(spec, [p[name] for p in some]) for some in (good, rest))
        drawn = [above.draw(rng) for _ in range(CANDIDATES)]
        out[name] = max(drawn, key=lambda v: above.log(v) - below.log(v))
    return out


def asked(space: dict[str, dict], told: list[tuple[dict, float | None]], n: int, seed: int, largest: bool = True) -> list[dict]:
    """A round of n trials, each made with the round's earlier ones pending."""
    out: list[dict] = []
    for i in range(n):
        out.append(ask(space, told, out, seed * 1_000_003 + len(told) + i, largest))
    return out


def search(spark: SparkSession, space: dict[str, dict], objective: Callable[[DataFrame], DataFrame], folder: str, rounds: int, width: int, seed: int = 0, largest: bool = True) -> DataFrame:
    """Rounds of ``width`` trials; the table of all trials (trial, params, score).

    objective(trials: trial, params as JSON) gives (trial, score) and may join them with any table: Spark evaluates a
    round as one job. A trial without a row, or with a score that is not finite, has failed. Rounds that the table in
    ``folder`` has are not run again.
    """
    table = Ledger(spark, folder, ["trial"], 1)
    for i in range(rounds):
        if any(e.batch == f"round{i}" for e in table.entries()):
            continue
        found = table.read(TRIALS).orderBy("trial").collect()  # as long as the budget
        told = [(json.loads(r.params), r.score) for r in found]
        todo = [(i * width + j, json.dumps(p, sort_keys=True)) for j, p in enumerate(asked(space, told, width, seed, largest))]
        trials = spark.createDataFrame(todo, "trial long, params string")
        scored = written(objective(trials).select("trial", F.col("score").cast("double").alias("score")), "scores")
        table.append(f"round{i}", trials.join(scored, "trial", "left").select("trial", "params", "score"))
    return table.read(TRIALS)

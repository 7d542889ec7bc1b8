"""The Parzen search against random search, and as rounds over a table."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from panelweave.operators import search as S
from panelweave.operators.tuning import draw

SPACE = {"x": {"type": "float", "low": -5.0, "high": 5.0}, "rate": {"type": "float", "low": 1e-5, "high": 1.0, "log": True}, "k": {"type": "int", "low": 1, "high": 40, "step": 1}, "kind": {"type": "categorical", "choices": ["a", "b", "c"]}, "on": {"type": "bool"}, "c": {"type": "fixed", "value": 3}}


def score(p):
    """Planted optimum at x = 1.3, rate = 1e-2, k = 12, kind b, on."""
    return -((p["x"] - 1.3) ** 2) - (math.log10(p["rate"]) + 2) ** 2 - ((p["k"] - 12) / 8) ** 2 - (p["kind"] != "b") - 0.5 * (not p["on"])


def test_better_than_random_at_equal_budget():
    wins, gain = 0, []
    for seed in range(20):
        told = []
        for _ in range(15):
            told += [(p, score(p)) for p in S.asked(SPACE, told, 4, seed)]
        rng = random.Random(seed)
        plain = max(score(draw(SPACE, rng)) for _ in range(60))
        wins += max(s for _, s in told) > plain
        gain.append(max(s for _, s in told) - plain)
    assert wins >= 15 and sum(gain) > 0


def test_types_bounds_and_pending():
    told = [(p, score(p)) for p in S.asked(SPACE, [], 30, 1)] + [(draw(SPACE, random.Random(5)), None), (draw(SPACE, random.Random(6)), float("nan"))]
    some = S.asked(SPACE, told, 25, 2)
    assert S.asked(SPACE, told, 25, 2) == some and len({json.dumps(p, sort_keys=True) for p in some}) > 20
    for p in some:
        assert -5 <= p["x"] <= 5 and 1e-5 <= p["rate"] <= 1 and type(p["k"]) is int and 1 <= p["k"] <= 40 and p["kind"] in "abc" and type(p["on"]) is bool and p["c"] == 3
    step = {"x": {"type": "float", "low": 0.0, "high": 1.0, "step": 0.25}}
    assert {p["x"] for p in S.asked(step, [({"x": v / 4}, -abs(v - 2)) for v in (0, 1, 2, 3, 4)] * 3, 30, 1)} <= {0.0, 0.25, 0.5, 0.75, 1.0}
    low = S.ask(SPACE, [(p, -score(p)) for p, s in told if s is not None and s == s], [], 3, largest=False)
    assert set(low) == set(SPACE)
    with pytest.raises(ValueError, match="unknown kind"):
        S.ask({"x": {"type": "nope"}}, [], [], 1)


def test_rounds_resume_from_the_table(spark, tmp_path):
    space, calls = {"x": {"type": "float", "low": 0.0, "high": 10.0}}, []

    def objective(trials):
        calls.append(trials.count())
        x = F.get_json_object("params", "$.x").cast("double")
        return trials.where("trial % 5 <> 3").select("trial", (-F.abs(x - 7)).alias("score"))

    folder = f"file://{tmp_path}/trials"
    first = S.search(spark, space, objective, folder, 2, 5).collect()
    again = S.search(spark, space, objective, folder, 4, 5).collect()
    assert calls == [5] * 4 and sorted(r.trial for r in again) == list(range(20)) and set(first) <= set(again)
    assert all((r.score is None) == (r.trial % 5 == 3) for r in again)

"""Cross-validation folds of whole states, balanced over divisions. Only state counts reach the driver."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geography import DIVISION_OF, DIVISIONS, REGION_OF, UNKNOWN


def balanced(counts: dict[str, int], n_splits: int, by_region: bool = False, division_of: dict[str, str] = DIVISION_OF, region_of: dict[str, str] = REGION_OF, order: list[str] | None = None) -> dict[str, int]:
    """state -> fold from 1. Divisions in their order, large states first; each goes where its primary group, region and division are rarest, then to the smallest fold."""
    folds = range(1, max(2, min(n_splits, len(counts))) + 1)
    if len(counts) < 2:
        raise ValueError("folds need two states at least")
    out: dict[str, int] = {}
    size, held = Counter(), Counter()
    seen: dict[tuple[str, int], Counter] = {(kind, j): Counter() for kind in ("region", "division") for j in folds}
    for name in order or [d for d, _, _ in DIVISIONS]:
        for s in sorted((s for s in counts if division_of.get(s, UNKNOWN) == name), key=lambda s: (-counts[s], s)):
            d, r = division_of.get(s, UNKNOWN), region_of.get(s, UNKNOWN)

            def cost(j: int) -> tuple:
                regions, divisions = seen["region", j][r], seen["division", j][d]
                return (regions if by_region else divisions, regions, divisions, size[j], held[j], j)

            j = min(folds, key=cost)
            out[s] = j
            size[j] += counts[s]
            held[j] += 1
            seen["region", j][r] += 1
            seen["division", j][d] += 1
    return out


def grouped(counts: dict[str, int], n_splits: int) -> dict[str, int]:
    """state -> fold from 1: large states first, each to the smallest fold."""
    folds = range(1, max(2, min(n_splits, len(counts))) + 1)
    size, out = Counter(), {}
    for s in sorted(counts, key=lambda s: (-counts[s], s)):
        j = min(folds, key=lambda j: (size[j], j))
        out[s] = j
        size[j] += counts[s]
    return out


def state_folds(panel: DataFrame, n_splits: int, state: str = "state", strategy: str = "region_balanced", by_region: bool = False, **tables) -> DataFrame:
    """(state, fold). States outside the known divisions have no row: they always train."""
    counts = {r[0]: r[1] for r in panel.where(F.col(state).isNotNull()).groupBy(state).agg(F.countDistinct("fips")).collect()}
    if strategy not in ("region_balanced", "group_kfold"):
        raise ValueError(f"unknown strategy {strategy}")
    found = balanced(counts, n_splits, by_region, **tables) if strategy == "region_balanced" else grouped(counts, n_splits)
    return panel.sparkSession.createDataFrame(sorted(found.items()), f"{state} string, fold int")


def with_folds(panel: DataFrame, folds: DataFrame, state: str = "state") -> DataFrame:
    """fold -1 for states that are never held out."""
    return panel.join(F.broadcast(folds), state, "left").withColumn("fold", F.coalesce("fold", F.lit(-1)))

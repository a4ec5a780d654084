"""Recommendations for a table of workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame

from meterwise.operators import placement as pl
from meterwise.settings import SERVING_OPTIONS, PlacementWeights, ServingOption


def placement_report(
    workloads: DataFrame,
    options: tuple[ServingOption, ...] = SERVING_OPTIONS,
    weights: PlacementWeights = PlacementWeights(),
) -> dict[str, DataFrame]:
    judged = pl.judge(pl.valid_workloads(workloads), options, weights)
    return {
        "recommendations": pl.explain(judged),
        "ranked": pl.rankings(judged),
        "rejected": pl.eliminations(judged),
        "preferences": pl.preference_rows(judged),
        "advice": pl.advice(judged, options, weights),
        "conflicts": pl.conflicts(judged),
        "invalid": pl.invalid_workloads(workloads),
    }

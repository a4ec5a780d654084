"""The usage report over invocation logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.operators import anomalies, costing, invocations, percentiles, totals
from meterwise.settings import UsageThresholds


def usage_report(
    parsed: DataFrame,
    prices: DataFrame,
    overrides: DataFrame | None = None,
    thresholds: UsageThresholds = UsageThresholds(),
    only: tuple[str, ...] | None = None,
) -> dict[str, DataFrame]:
    """The sections of the report, or those named in `only`, each as its own table.

    `parsed` comes from `invocations.parse`. Several sections read the costed rows: write them to
    a table first, or cache them, when parsing is what costs most.
    """
    inv = invocations.usable(parsed)
    costed = costing.with_cost(inv, prices, overrides)
    sections = {
        "window": lambda: totals.covered_window(inv),
        "groups": lambda: totals.all_groupings(costed),
        "unpriced_models": lambda: costing.unpriced_models(costed),
        "percentiles": lambda: percentiles.percentiles(inv, thresholds),
        "outliers": lambda: percentiles.outliers(inv, thresholds),
        "anomalies": lambda: anomalies.with_rates(anomalies.detect(costed, thresholds)),
        "most_expensive": lambda: totals.most_expensive(costed, thresholds.top_requests),
        "skipped_records": lambda: invocations.issue_counts(parsed),
        "usable": lambda: invocations.usable_share(parsed),
    }
    return {name: build() for name, build in sections.items() if only is None or name in only}


def group_section(report: dict[str, DataFrame], grouping: str) -> DataFrame:
    """One grouping of the report in its own order: dearest first, times in order."""
    rows = report["groups"].filter(F.col("grouping") == grouping)
    if grouping in ("hour", "day"):
        return rows.orderBy("key")
    return rows.orderBy(F.desc("cost_usd"), F.desc("requests"), "key")

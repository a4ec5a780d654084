"""The scan for idle endpoints over all regions at once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from meterwise.operators import endpoints as ep
from meterwise.settings import IdleThresholds


def endpoint_scan(
    endpoints: DataFrame,
    configs: DataFrame,
    targets: DataFrame,
    points: DataFrame,
    hosting: DataFrame,
    serverless: DataFrame,
    start: dt.datetime,
    end: dt.datetime,
    thresholds: IdleThresholds = IdleThresholds(),
) -> dict[str, DataFrame]:
    """Findings, dearest waste first, with totals and counts per verdict."""
    hours = (end - start).total_seconds() / 3600
    variants = ep.inventory(endpoints, configs, targets, end)
    measured = ep.with_traffic(variants, ep.invocations(points, start, end), start, end)
    findings = ep.with_cost(ep.classify(measured, hours, thresholds), hosting, serverless, hours, thresholds)
    return {
        "findings": ep.ordered(findings),
        "totals": ep.scan_totals(findings),
        "counts": ep.verdict_counts(findings),
    }

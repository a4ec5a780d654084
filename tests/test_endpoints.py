"""Endpoint verdicts, costs and remedies, one variant at a time."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from meterwise.plans.endpoints import endpoint_scan
from meterwise.settings import IdleThresholds
from meterwise.sinks.reports import FINDING_COLUMNS, write_findings_csv

END = dt.datetime(2026, 9, 23, 12, tzinfo=dt.timezone.utc)
START = END - dt.timedelta(days=14)
OLD = START - dt.timedelta(days=30)
HOURS = 336
MEMORY = "struct<memory_mb:int,max_concurrency:int>"


def scan(spark, thresholds=IdleThresholds(), *, status="InService", created=OLD, count=1, kind="ml.m5.large", serverless=None,
         model="m", minimum=None, calls=None, config="c"):
    memory = None if serverless is None else (serverless, 1)
    endpoints = spark.createDataFrame(
        [("us-east-1", "e", status, created, config, [("v", count, memory)])],
        f"region string, endpoint string, status string, created_at timestamp, config_name string, variants array<struct<variant_name:string,current_instance_count:int,serverless:{MEMORY}>>",
    )
    configs = spark.createDataFrame(
        [("us-east-1", "c", [("v", kind, model, None)])],
        f"region string, config_name string, variants array<struct<variant_name:string,instance_type:string,model_name:string,serverless:{MEMORY}>>",
    )
    targets = spark.createDataFrame(
        [] if minimum is None else [("us-east-1", "endpoint/e/variant/v", "d", minimum, 4)],
        "region string, resource_id string, scalable_dimension string, min_capacity int, max_capacity int",
    )
    points = spark.createDataFrame(
        [("us-east-1", "e", "v", "Invocations", START + dt.timedelta(hours=h), float(x)) for h, x in enumerate(calls or [])],
        "region string, endpoint string, variant string, metric string, ts timestamp, value double",
    )
    hosting = spark.createDataFrame(
        [("us-east-1", k, Decimal(p)) for k, p in (("ml.m5.large", "0.1"), ("ml.g5.xlarge", "1.5"), ("ml.m5.4xlarge", "0.9"))],
        "region string, instance_type string, usd_per_hour decimal(12,6)",
    )
    per_second = spark.createDataFrame([("us-east-1", 2, Decimal("0.00004"))], "region string, memory_gb int, usd_per_second decimal(18,10)")
    return endpoint_scan(endpoints, configs, targets, points, hosting, per_second, START, END, thresholds)


def finding(spark, *args, **options):
    return scan(spark, *args, **options)["findings"].first()


@pytest.mark.parametrize(
    ("options", "verdict"),
    [
        ({}, "idle"), ({"calls": [0, 0]}, "idle"), ({"calls": [HOURS]}, "healthy"), ({"calls": [HOURS - 1]}, "underused"),
        ({"calls": [HOURS], "count": 2}, "underused"), ({"serverless": 2048}, "not_applicable"), ({"minimum": 0}, "not_applicable"),
        ({"minimum": 1}, "idle"), ({"status": "Failed"}, "not_billing"), ({"status": "Brand new"}, "not_billing"),
        ({"created": END - dt.timedelta(days=11)}, "too_new"), ({"created": END - dt.timedelta(days=11.2)}, "idle"),
        ({"created": None}, "too_new"), ({"count": 0}, "not_applicable"), ({"count": None}, "not_applicable"),
    ],
)
def test_verdicts(spark, options, verdict):
    assert finding(spark, **options).verdict == verdict


def test_unknown_and_zero_read_differently(spark):
    unknown, zero = finding(spark), finding(spark, calls=[0])
    assert unknown.invocations is None and unknown.datapoints == 0 and "no data at all" in unknown.evidence
    assert zero.invocations == 0 and "zero invocations" in zero.evidence


@pytest.mark.parametrize(
    ("options", "monthly", "waste", "remedy"),
    [
        ({"count": 2}, "146.00", "146.00", "delete"),
        ({"count": 4, "calls": [HOURS + 1]}, "292.00", "146.00", "reduce_instance_count"),
        ({"calls": [10]}, "73.00", None, "move_to_serverless"),
        ({"calls": [10], "kind": "ml.g5.xlarge"}, "1095.00", None, "move_to_async_scale_to_zero"),
        ({"calls": [10], "kind": "ml.m5.4xlarge"}, "657.00", None, "move_to_async_scale_to_zero"),
        ({"calls": [HOURS]}, "73.00", "0.00", "none"),
        ({"kind": "ml.unpriced.large"}, None, None, "delete"),
        ({"serverless": 1024}, None, "0.00", "none"),
        ({"config": None}, None, "0.00", "delete"),
    ],
)
def test_cost_and_remedy(spark, options, monthly, waste, remedy):
    row = finding(spark, **options)
    assert (row.monthly_usd, row.wasted_monthly_usd, row.remedy) == (
        None if monthly is None else Decimal(monthly), None if waste is None else Decimal(waste), remedy,
    )


def test_serverless_comparison_fills_an_unknown_waste(spark):
    assumed = IdleThresholds(seconds_per_invocation=2.0, serverless_memory_gb=2)
    row = finding(spark, assumed, calls=[168])
    assert row.serverless_monthly_usd == Decimal("0.03") and row.wasted_monthly_usd == Decimal("72.97") and row.no_estimate_reason is None
    assert finding(spark, assumed, calls=[HOURS]).serverless_monthly_usd is None
    with pytest.raises(ValueError):
        IdleThresholds(seconds_per_invocation=2.0)


def test_components_keep_the_verdict_and_add_a_caveat(spark):
    assert "hosts inference components" in finding(spark, model=None).evidence
    assert "hosts inference components" not in finding(spark, model=None, calls=[HOURS]).evidence


def test_totals_counts_and_file(spark, tmp_path):
    report = scan(spark, calls=[10])
    total = report["totals"].first()
    assert (total.findings_without_a_waste_estimate, total.totals_are_complete, total.monthly_usd) == (1, False, Decimal("73.00"))
    assert {r.verdict: r["count"] for r in report["counts"].collect()}["underused"] == 1 and report["counts"].count() == 6
    write_findings_csv(report["findings"], str(tmp_path / "csv"))
    assert tuple(spark.read.option("header", True).csv(str(tmp_path / "csv")).columns) == FINDING_COLUMNS

"""Placement of workloads at, and one step past, the limits."""

from __future__ import annotations

import pytest

from meterwise.plans.placement import placement_report

SCHEMA = (
    "workload_id int, payload_mb double, response_mb double, processing_seconds double, traffic string, latency_p99_ms double, "
    "zero_idle_cost boolean, immediate_response boolean, needs_notification boolean, gpu_required boolean, model_count int"
)
DEFAULTS = dict(
    payload_mb=1.0, response_mb=1.0, processing_seconds=1.0, traffic="steady", latency_p99_ms=None, zero_idle_cost=False,
    immediate_response=False, needs_notification=False, gpu_required=False, model_count=1,
)


def place(spark, **changes):
    row = {**DEFAULTS, **changes}
    return placement_report(spark.createDataFrame([(1, *row.values())], SCHEMA))


@pytest.mark.parametrize(
    ("changes", "winner"),
    [
        ({}, "real_time"), ({"traffic": "bursty-idle"}, "serverless"), ({"traffic": "scheduled-batch"}, "batch_transform"),
        ({"payload_mb": 25.0}, "real_time"), ({"payload_mb": 25.1}, "batch_transform"), ({"payload_mb": 100.1}, "async"),
        ({"payload_mb": 1024.0}, "async"), ({"payload_mb": 1024.5}, None), ({"processing_seconds": 61.0}, "batch_transform"),
        ({"processing_seconds": 3601.0}, None), ({"traffic": "bursty-idle", "gpu_required": True, "immediate_response": True}, "real_time"),
        ({"zero_idle_cost": True, "gpu_required": True, "immediate_response": True}, None), ({"needs_notification": True}, "batch_transform"),
        ({"latency_p99_ms": 999.0, "traffic": "bursty-idle"}, "real_time"), ({"latency_p99_ms": 1000.0, "traffic": "bursty-idle"}, "serverless"),
        ({"traffic": "bursty-idle", "immediate_response": True, "zero_idle_cost": True}, "serverless"),
    ],
)
def test_winner(spark, changes, winner):
    assert place(spark, **changes)["recommendations"].first().recommended == winner


def test_words(spark):
    report = place(spark, payload_mb=2048.0, response_mb=4.5, processing_seconds=7200.0, immediate_response=True, zero_idle_cost=True)
    said = {(r.option, r.constraint_id): (r.requirement, r.limit, r.actual) for r in report["rejected"].collect()}
    assert said["async", "request_payload_over_limit"] == ("requests of up to 2048 MB (2 GB)", "1024 MB (1 GB)", "2048 MB (2 GB)")
    assert said["real_time", "processing_time_over_limit"] == ("requests that run for 7200 s (2 hours)", "60 s", "7200 s (2 hours)")
    assert said["batch_transform", "no_inline_response"] == ("answers go back on the same call", None, None)
    conflicts = report["conflicts"].orderBy("place").collect()
    assert [(c.constraint_id, len(c.eliminated)) for c in conflicts] == [
        ("processing_time_over_limit", 4), ("request_payload_over_limit", 4), ("no_inline_response", 2), ("cannot_scale_to_zero", 1),
        ("response_payload_over_limit", 1),
    ]


@pytest.mark.parametrize(
    ("changes", "ids"),
    [
        ({"traffic": "bursty-idle", "latency_p99_ms": 2000.0}, ["provisioned_concurrency"]),
        ({"traffic": "bursty-idle", "immediate_response": True, "gpu_required": True, "model_count": 3}, ["multi_model_endpoint", "inference_components"]),
        ({"model_count": 2, "immediate_response": True}, ["inference_components"]),
        ({"zero_idle_cost": True, "traffic": "scheduled-batch"}, ["inference_components_scale_to_zero"]),
        ({"zero_idle_cost": True, "immediate_response": True, "gpu_required": True}, ["inference_components_scale_to_zero"]),
        ({"zero_idle_cost": True, "traffic": "scheduled-batch", "needs_notification": True}, []),
    ],
)
def test_advice(spark, changes, ids):
    assert [r.advice_id for r in place(spark, **changes)["advice"].collect()] == ids


def test_reasons_and_runners_up(spark):
    row = place(spark, traffic="bursty-idle", latency_p99_ms=500.0, model_count=3)["recommendations"].first()
    assert row.recommended == "real_time" and row.deciding_factors == ["tight_latency_favours_real_time", "many_models_favour_real_time"]
    assert row.runners_up == ["Serverless inference meets every requirement too (score 1 against 3)"]
    assert [(r.option, r.reasons) for r in row.rejections] == [("async", ["no_inline_response"]), ("batch_transform", ["no_inline_response"])]


def test_level_scores_fall_to_less_standing_infrastructure(spark):
    report = place(spark, traffic="other", immediate_response=True)
    row = report["recommendations"].first()
    assert row.recommended == "serverless" and "level with Real-time endpoint" in row.headline
    assert row.deciding_factors == ["tie_break_on_less_standing_infrastructure"] and row.caveats == []


def test_invalid_rows_are_set_aside(spark):
    report = place(spark, payload_mb=-1.0)
    assert report["invalid"].first().problem == "payload_mb: missing or below zero"
    assert report["recommendations"].count() == 0
    assert place(spark, model_count=0)["invalid"].count() == 1 and place(spark, latency_p99_ms=0.0)["invalid"].count() == 1

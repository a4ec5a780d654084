"""Call-pattern detectors against loops over small traffic."""

from __future__ import annotations

import datetime as dt
import os
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from meterwise.kept import _held, released
from meterwise.operators import anomalies, percentiles, spacing
from meterwise.operators.spacing import spaced
from meterwise.settings import NO_IDENTITY, UsageThresholds

START = dt.datetime(2026, 9, 24, 12, tzinfo=dt.timezone.utc)
SCHEMA = "ts timestamp, request_id string, model_id string, identity_arn string, input_tokens bigint, source string, cost_usd decimal(20,6)"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def call(second, identity="a", tokens=100, model="m", n=0, cost=None):
    return (START + dt.timedelta(seconds=second), f"r{n:06d}", model, identity, tokens, "s", cost)


def utc(moment):
    return moment.replace(tzinfo=dt.timezone.utc)


def loop(items, width, needed, first_only=False):
    """Spans found by moving two ends over sorted (time, source, id, cost)."""
    items, start, until, spans = sorted(items), 0, None, []
    for end, item in enumerate(items):
        while item[0] - items[start][0] > dt.timedelta(seconds=width):
            start += 1
        size = end - start + 1
        if size < needed or (until is not None and items[start][0] <= until):
            continue
        spans.append((items[start][0], item[0], size, round(sum(x[3] for x in items[start : end + 1]), 6)))
        until = item[0]
        if first_only:
            break
    return spans


@pytest.fixture(scope="module")
def traffic(spark):
    rng, rows = random.Random(11), []
    for caller in range(6):
        at = 0
        for n in range(700):
            at += rng.choice([0, 0, 1, 2, 3, 10] if caller < 4 else [0, 1])
            at += 400 if rng.random() < 0.01 else 0
            cents = rng.randrange(1000)
            rows.append((at, f"c{caller}" if caller else "", rng.randrange(3), f"m{rng.randrange(2)}", rng.randrange(10**9), cents))
    table = spark.createDataFrame(rows, "at int, identity_arn string, input_tokens bigint, model_id string, n bigint, cents int").select(
        (F.lit(START).cast("timestamp") + F.make_dt_interval(secs=F.col("at"))).alias("ts"),
        F.concat(F.lit("r"), "n").alias("request_id"), "model_id", "identity_arn", "input_tokens",
        F.lit("s").alias("source"), F.when(F.col("cents") % 7 > 0, (F.col("cents") / 1000).cast("decimal(20,6)")).alias("cost_usd"),
    ).cache()
    return rows, table


def grouped(rows, key):
    groups = defaultdict(list)
    for at, who, tokens, model, n, cents in rows:
        cost = cents / 1000 if cents % 7 else 0
        groups[key(who or NO_IDENTITY, model, tokens)].append((START + dt.timedelta(seconds=at), "s", f"r{n}", cost))
    return groups


THRESHOLDS = UsageThresholds(burst_window_seconds=7, burst_count=8, repeat_count=5)


@pytest.mark.parametrize("blocks", [spacing.BLOCK_GAPS, (4, 16)])
def test_bursts_equal_a_loop(traffic, monkeypatch, blocks):
    rows, table = traffic
    monkeypatch.setattr(spacing, "BLOCK_GAPS", blocks)
    monkeypatch.setattr(anomalies, "_BLOCK_WINDOWS", 2)
    want = sorted((who, *s) for (who,), items in grouped(rows, lambda w, m, t: (w,)).items() for s in loop(items, 7, 8))
    got = sorted(
        (r.identity_arn, utc(r.window_start), utc(r.window_end), r.request_count, float(r.cost_usd))
        for r in anomalies.bursts(table, THRESHOLDS).collect()
    )
    assert len(want) > 100 and got == want


def test_repeated_shapes_equal_a_loop(traffic):
    rows, table = traffic
    want = sorted((*key, *s) for key, items in grouped(rows, lambda w, m, t: (w, m)+(t,)).items() for s in loop(items, 7, 5, True))
    got = sorted(
        (r.identity_arn, r.model_id, int(r.detail.split("size of ")[1].split(" ")[0]), utc(r.window_start), utc(r.window_end), r.request_count, float(r.cost_usd))
        for r in anomalies.repeated_shapes(table, THRESHOLDS).collect()
    )
    assert want and got == want


@pytest.mark.parametrize("seed", range(3))
def test_spacing_in_blocks_equals_a_walk(spark, monkeypatch, seed):
    monkeypatch.setattr(spacing, "BLOCK_GAPS", (3, 9))
    rng = random.Random(seed)
    points = {(k, rng.randrange(4000) if k != "dense" else rng.randrange(800)) for k in ("x", "y", "dense") for _ in range(500)}
    want = set()
    for key in ("x", "y", "dense"):
        last = None
        for at in sorted(a for k, a in points if k == key):
            if last is None or at > last + 10:
                want.add((key, at))
                last = at
    table = spark.createDataFrame(sorted(points), "k string, at bigint")
    assert {tuple(r) for r in spaced(table, ["k"], 10).collect()} == want


def test_loop_of_one_size_is_a_repeated_shape(spark):
    rows = [call(2 * n, tokens=8192, n=n) for n in range(40)]
    found = anomalies.detect(frame(spark, rows)).collect()
    assert [(r.kind, r.request_count) for r in found] == [("repeated_shape", 20)]
    assert (found[0].window_end - found[0].window_start).total_seconds() == 38


def test_growing_sizes_are_no_finding(spark):
    assert anomalies.detect(frame(spark, [call(2 * n, tokens=1000 + 250 * n, n=n) for n in range(40)])).count() == 0


def test_exactly_the_threshold_and_the_inclusive_width(spark):
    at_width = [call(n, tokens=n, n=n) for n in range(59)] + [call(60, tokens=99, n=99)]
    assert anomalies.bursts(frame(spark, at_width)).count() == 1
    assert anomalies.bursts(frame(spark, at_width[:-1] + [call(60.001, tokens=99, n=99)])).count() == 0


def test_equal_timestamps_count_up_to_the_trigger(spark):
    rows = [call(0, tokens=n, n=n, cost=None) for n in range(200)]
    found = anomalies.bursts(frame(spark, rows)).collect()
    assert [(r.request_count, float(r.cost_usd)) for r in found] == [(60, 0.0)]


def test_rate_jump_against_own_median(spark):
    quiet = [call(60 * m, tokens=m, n=m) for m in range(12)]
    storm = [call(1200 + n / 2, tokens=1000 + n, n=100 + n) for n in range(40)]
    found = anomalies.rate_jumps(frame(spark, quiet + storm)).collect()
    assert [(r.request_count, r.window_start.minute) for r in found] == [(40, 20)]
    assert anomalies.rate_jumps(frame(spark, storm)).count() == 0


def test_callers_are_judged_apart(spark):
    rows = [call(n, identity=f"u{n % 2}", tokens=n, n=n) for n in range(100)]
    assert anomalies.bursts(frame(spark, rows)).count() == 0


def test_no_rows(spark):
    assert anomalies.detect(frame(spark, [])).count() == 0


def test_rates_of_a_window_without_length(spark):
    found = anomalies.with_rates(anomalies.bursts(frame(spark, [call(0, tokens=n, n=n) for n in range(60)]))).first()
    assert (found.duration_seconds, found.calls_per_minute) == (0, 60)


def test_outliers_run_nothing_before_they_are_asked_for(spark, traffic):
    _, table = traffic
    spark.sparkContext.setJobGroup("building", "no job is to carry this")
    percentiles.outliers(table.withColumn("output_tokens", F.col("input_tokens")))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("running", "")


def test_what_the_detectors_keep_is_released(spark, traffic):
    _, table = traffic
    with released(spark):
        before = len(_held.get(spark.sparkContext.applicationId, []))
        found = anomalies.detect(table, THRESHOLDS).collect()
        kept = _held[spark.sparkContext.applicationId][before:]
        # calls once for all three detectors; points, steps and the findings of bursts; those of repeated shapes
        assert found and len(kept) == 5
    assert not any(os.path.isdir(re.sub("^file:/*(?=/)", "", f)) for f in kept)


def test_a_walk_that_never_meets_another_one(spark, monkeypatch):
    """Points in two interleaved rows, so that every entry of a block keeps its own last pick."""
    monkeypatch.setattr(spacing, "BLOCK_GAPS", (4, 16))
    points = [("k", 11 * n + shift) for n in range(400) for shift in (0, 3, 5)]
    table = spark.createDataFrame(points, "k string, at bigint")
    assert sorted(r.at for r in spaced(table, ["k"], 10).collect()) == [11 * n for n in range(400)]


def test_small_groups_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(spacing, "_POINTS_A_TASK", 30)
    rows = [(f"k{k}", at) for k in range(40) for at in (0, 5, 11, 5000)]
    found = spaced(spark.createDataFrame(rows, "k string, at bigint"), ["k"], 10)
    assert found.select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(map(tuple, found.collect())) == sorted((f"k{k}", at) for k in range(40) for at in (0, 11, 5000))

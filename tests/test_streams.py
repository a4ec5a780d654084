"""Stream verdicts on hand-made shards."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from meterwise.operators import keys, shards as sh
from meterwise.plans.streams import stream_scan

START = dt.datetime(2026, 9, 23, tzinfo=dt.timezone.utc)
END = START + dt.timedelta(minutes=100)
FULL_BYTES, FULL_RECORDS = 1048576 * 60, 1000 * 60
NAMES = ("IncomingBytes", "IncomingRecords", "WriteProvisionedThroughputExceeded")


def build(spark, shards, mode="PROVISIONED", metrics=("ALL",), records=None):
    """shards: (peak fraction of bytes, of records, throttled, observed minutes, extra columns)."""
    points, listed = [], []
    for n, (by_bytes, by_records, throttled, minutes, *extra) in enumerate(shards):
        listed.append(("s", f"shard-{n}", *(extra[0] if extra else (None, None, None, None))))
        for m in range(minutes):
            values = (by_bytes * FULL_BYTES, by_records * FULL_RECORDS, throttled if m == 0 else 0)
            points += [("s", f"shard-{n}", name, START + dt.timedelta(minutes=m), float(v)) for name, v in zip(NAMES, values)]
    streams = spark.createDataFrame([("s", "us-east-1", mode, list(metrics))], "stream string, region string, capacity_mode string, enabled_metrics array<string>")
    shard_rows = spark.createDataFrame(
        listed, "stream string, shard_id string, ending_sequence_number string, parent_shard_id string, adjacent_parent_shard_id string, closed_at timestamp"
    )
    point_rows = spark.createDataFrame(points, "stream string, shard_id string, metric string, ts timestamp, value double")
    return stream_scan(streams, shard_rows, point_rows, START, END, records=records)


def verdict(spark, shards, **options):
    return build(spark, shards, **options)["streams"].first()


HOT = [(0.98, 0.2, 412000, 100)] + [(f, 0.01, 0, 100) for f in (0.04, 0.05, 0.06, 0.07, 0.08, 0.09, 0.1)]


@pytest.mark.parametrize(
    ("shards", "options", "expected"),
    [
        (HOT, {}, "skew"),
        ([(0.98, 0.9, 10, 100)] + [(0.04, 0.8, 0, 100)] * 7, {}, "mixed"),
        ([(0.9, 0.1, 5, 100)] * 4, {}, "capacity"),
        ([(0.9, 0.1, 5, 100)], {}, "capacity"),
        ([(0.3, 0.1, 5, 100)] * 4, {}, "bursty"),
        ([(0.3, 0.1, 0, 100)] * 4, {}, "healthy"),
        ([(0.0, 0.0, 0, 100)] * 4, {}, "no_traffic"),
        ([(0.0, 0.0, 9, 100)] * 4, {}, "bursty"),
        ([(0.3, 0.1, 0, 0)] * 2, {}, "no_traffic"),
        (HOT, {"metrics": ("IncomingBytes",)}, "no_shard_metrics"),
        (HOT, {"metrics": NAMES}, "skew"),
        (HOT[:1] + [(0.5, 0.5, 0, 49)] * 3, {}, "capacity"),
    ],
)
def test_verdicts(spark, shards, options, expected):
    assert verdict(spark, shards, **options).verdict == expected


def test_skew_in_numbers(spark):
    row = verdict(spark, HOT, mode="ON_DEMAND")
    assert (row.hottest_shard_id, row.shard_count, row.throttled_records) == ("shard-0", 8, 412000)
    assert row.hottest_share == pytest.approx(0.98 / 1.47) and row.max_to_mean == pytest.approx(0.98 / 1.47 * 8)
    assert row.evidence[0] == "412,000 records were throttled" and row.remedy.startswith("scaling cannot help")


def test_excluded_shards_still_count_their_throttling(spark):
    report = build(spark, [(0.3, 0.1, 0, 100), (0.3, 0.1, 0, 100), (0.9, 0.1, 7, 49), (0, 0, 0, 0)])
    row = report["streams"].first()
    assert (row.throttled_records, row.shard_count) == (7, 2)
    reasons = {r.shard_id: r.excluded_reason for r in report["shards"].collect()}
    assert reasons["shard-0"] is None and reasons["shard-2"].startswith("seen for only 49%") and reasons["shard-3"].startswith("no data")


def test_closed_and_split_shards(spark):
    late, early = START + dt.timedelta(minutes=5), START - dt.timedelta(minutes=5)
    report = build(spark, [
        (0.3, 0.1, 0, 100), (0.3, 0.1, 0, 100, ("49", None, None, late)), (0.9, 0.1, 1, 100, ("49", None, None, early)),
        (0.2, 0.1, 0, 100, (None, "shard-1", None, None)),
    ])
    row = report["streams"].first()
    assert (row.open_shard_count, row.resharded, row.throttled_records) == (2, True, 0)
    assert report["shards"].count() == 3


def test_top_keys_of_the_hottest_shard(spark):
    rows = [("s", "shard-0", START + dt.timedelta(seconds=i), "hot" if i % 25 < 22 else f"k{i % 25}") for i in range(1000)]
    rows += [("s", "shard-0", START - dt.timedelta(seconds=9), "old"), ("s", "shard-1", START, "other")]
    records = spark.createDataFrame(rows, "stream string, shard_id string, ts timestamp, partition_key string")
    report = build(spark, HOT, records=records)
    found = report["top_keys"].orderBy("rank").collect()
    assert [(r.partition_key, r["count"], r.share) for r in found][:2] == [("hot", 880, 0.88), ("k22", 40, 0.04)]
    assert report["sampled_shards"].first().shard_id == "shard-0"
    assert keys.key_shares(records.limit(0)).count() == 0


def test_gini_against_the_definition(spark):
    rng = random.Random(2)
    groups = {"even": [1.0] * 7, "one": [0.0] * 9 + [5.0], "zero": [0.0] * 4, "single": [3.0], "mix": [rng.choice([rng.random(), 0.5]) for _ in range(200)]}
    table = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, x double")
    got = {r.g: r.gini for r in sh.gini(table, "g", "x").collect()}
    for g, xs in groups.items():
        pairs = sum(abs(a - b) for a in xs for b in xs)
        assert got[g] == pytest.approx(pairs / (2 * len(xs) ** 2 * (sum(xs) / len(xs))) if sum(xs) else 0.0, abs=1e-12)
    with pytest.raises(Exception, match="must not be negative"):
        sh.gini(table.withColumn("x", -F.col("x")), "g", "x").collect()

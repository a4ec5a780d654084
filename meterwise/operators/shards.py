"""Per-shard traffic, how close each shard is to its limits, and how unevenly a stream is loaded."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterwise.functions.text import percent
from meterwise.kept import kept
from meterwise.settings import (
    BYTES_METRIC, RECORDS_METRIC, SHARD_BYTES_PER_MINUTE, SHARD_METRICS, SHARD_RECORDS_PER_MINUTE,
    THROTTLE_METRIC, SkewThresholds,
)

_KEYS = ["stream", "shard_id"]


def window_minutes(start: dt.datetime, end: dt.datetime) -> int:
    return max(1, math.ceil((end - start).total_seconds() / 60))


def in_window(points: DataFrame, start: dt.datetime, end: dt.datetime, metrics: tuple[str, ...]) -> DataFrame:
    """Datapoints of some metrics from `start` up to but not including `end`."""
    return points.filter(
        F.col("metric").isin(*metrics) & (F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end))
    )


def traffic(points: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """One row per shard: sums, busiest minute, and the minutes with any data."""

    def of(metric: str, value: str = "value") -> Column:
        return F.when(F.col("metric") == metric, F.col(value))

    def or_zero(value: Column) -> Column:
        return F.coalesce(value, F.lit(0.0))

    counts = [F.count(of(m)) for m in SHARD_METRICS]
    return in_window(points, start, end, SHARD_METRICS).groupBy(*_KEYS).agg(
        or_zero(F.sum(of(BYTES_METRIC))).alias("total_bytes"),
        or_zero(F.sum(of(RECORDS_METRIC))).alias("total_records"),
        or_zero(F.sum(of(THROTTLE_METRIC))).alias("throttled_records"),
        or_zero(F.max(of(BYTES_METRIC))).alias("peak_bytes"),
        or_zero(F.max(of(RECORDS_METRIC))).alias("peak_records"),
        F.greatest(*counts).alias("observed_minutes"),
    )


def shards_in_window(shards: DataFrame, start: dt.datetime) -> DataFrame:
    """Shards that could take writes in the window: open, or closed after it began."""
    return shards.filter(F.col("closed_at").isNull() | (F.col("closed_at") >= F.lit(start)))


def is_open() -> Column:
    return F.col("ending_sequence_number").isNull()


def open_shards(shards: DataFrame) -> DataFrame:
    return shards.filter(is_open())


def resharding(shards: DataFrame) -> DataFrame:
    """Per stream: open shards, and whether any shard closed or came out of a split or merge."""
    child = F.col("parent_shard_id").isNotNull() | F.col("adjacent_parent_shard_id").isNotNull()
    return shards.groupBy("stream").agg(
        F.count_if(is_open()).alias("open_shard_count"),
        F.bool_or(~is_open() | child).alias("resharded"),
    )


def utilisation(
    shards: DataFrame,
    measured: DataFrame,
    minutes: int,
    thresholds: SkewThresholds = SkewThresholds(),
) -> DataFrame:
    """Score every shard's busiest minute against the write limits.

    Shards without datapoints stay, with nothing measured. A shard seen for too little of the
    window is scored but does not count in the statistics.
    """
    zero = F.lit(0.0)
    names = ("total_bytes", "total_records", "throttled_records", "peak_bytes", "peak_records")
    rows = shards.select(*_KEYS, is_open().alias("is_open")).join(measured, _KEYS, "left")
    rows = rows.select(
        *_KEYS, "is_open",
        *[F.coalesce(F.col(c), zero).alias(c) for c in names],
        F.coalesce("observed_minutes", F.lit(0)).alias("observed_minutes"),
    )
    coverage = F.least(F.lit(1.0), F.col("observed_minutes") / F.lit(minutes))
    by_bytes = F.col("peak_bytes") / SHARD_BYTES_PER_MINUTE
    by_records = F.col("peak_records") / SHARD_RECORDS_PER_MINUTE
    reason = F.when(F.col("observed_minutes") == 0, "no data for this shard in the window").when(
        coverage < thresholds.minimum_coverage,
        F.concat(F.lit("seen for only "), percent(coverage), F.lit(" of the window, too little to compare")),
    )
    scored = rows.select(
        *_KEYS, "is_open", "total_bytes", "total_records", "throttled_records", "observed_minutes",
        coverage.alias("coverage"),
        by_bytes.alias("by_bytes"), by_records.alias("by_records"),
        F.greatest(by_bytes, by_records).alias("utilisation"),
        F.when(by_records > by_bytes, "records").otherwise("bytes").alias("binding"),
        reason.isNull().alias("counted"), reason.alias("excluded_reason"),
    )
    # Totals by partial aggregation and a join, not a window: a stream with very many shards is
    # then neither buffered in one task nor sorted there.
    totals = scored.groupBy("stream").agg(F.sum("total_bytes").alias("stream_bytes"))
    share = F.when(F.col("stream_bytes") > 0, F.col("total_bytes") / F.col("stream_bytes")).otherwise(0.0)
    return scored.join(totals, "stream").withColumn("share_of_bytes", share).drop("stream_bytes")


def gini(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Gini coefficient of `value` per `key`: 0 when even, towards 1 when one row has it all.

    Needs the rank of every value in its group. Equal values are first counted, then dealt out by
    range of (key, value) into parts of about equal size, however close the values lie; a rank is the
    rank within the part and the size of the lower parts. A negative value is an error.
    """
    x = F.col(value)
    checked = F.when(x < 0, F.raise_error(F.lit(f"{value} must not be negative"))).otherwise(x)
    counted = rows.groupBy(key, checked.cast("double").alias("x")).agg(F.count("*").alias("m"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # kept, so that both uses see the same ranges
    counted = counted.repartitionByRange(parts, key, "x").withColumn("part", F.spark_partition_id())
    counted = kept(counted)
    in_part = Window.partitionBy(key, "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("below", F.sum("m").over(in_part) - F.col("m"))
    sizes = counted.groupBy(key, "part").agg(F.sum("m").alias("size"))
    lower = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    offsets = sizes.select(key, "part", (F.sum("size").over(lower) - F.col("size")).alias("offset"))
    m, first = F.col("m"), F.col("below") + F.col("offset")
    rank_sum = m * first + m * (m + 1) / 2
    sums = ranked.join(offsets, [key, "part"]).groupBy(key).agg(
        F.sum(rank_sum * F.col("x")).alias("weighted"),
        F.sum(m * F.col("x")).alias("total"),
        F.sum("m").alias("n"),
    )
    n, total = F.col("n"), F.col("total")
    coefficient = 2 * F.col("weighted") / (n * total) - (n + 1) / n
    return sums.select(key, F.when(total > 0, F.greatest(F.lit(0.0), coefficient)).otherwise(0.0).alias("gini"))


def statistics(scored: DataFrame, thresholds: SkewThresholds = SkewThresholds()) -> DataFrame:
    """How unevenly each stream's counted shards are loaded; streams with too few are left out."""
    counted = scored.filter("counted")
    share = F.col("share_of_bytes")
    mean = F.avg(share)
    basic = counted.groupBy("stream").agg(
        F.count("*").alias("shard_count"),
        F.when(mean > 0, F.max(share) / mean).otherwise(1.0).alias("max_to_mean"),
        F.when(mean > 0, F.stddev_pop(share) / mean).otherwise(0.0).alias("variation"),
        F.when(F.sum(share) > 0, F.max(share) / F.sum(share)).otherwise(0.0).alias("hottest_share"),
        F.min_by("shard_id", F.struct(-share, F.col("shard_id"))).alias("hottest_shard_id"),
        F.avg("utilisation").alias("mean_utilisation"),
        F.max("utilisation").alias("max_utilisation"),
    )
    return basic.filter(F.col("shard_count") >= thresholds.minimum_shards).join(
        gini(counted, "stream", "share_of_bytes"), "stream"
    )

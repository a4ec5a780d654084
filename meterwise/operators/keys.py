"""Which partition keys fill the hottest shard of a stream."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterwise.operators.small import first_rows
from meterwise.settings import SkewThresholds


def hottest_open_shard(scored: DataFrame) -> DataFrame:
    """Per stream, the open shard with the largest share; a stream without one has no row."""
    return scored.filter("is_open").groupBy("stream").agg(
        F.min_by("shard_id", F.struct(-F.col("share_of_bytes"), F.col("shard_id"))).alias("shard_id")
    )


def sample_records(
    records: DataFrame, hottest: DataFrame, start: dt.datetime, order: list[str],
    thresholds: SkewThresholds = SkewThresholds(),
) -> DataFrame:
    """The first records of each hottest shard since `start`, up to the sample size.

    Hot shards are what this looks at, so a stream's records are ranked in parts first.
    """
    rows = records.filter(F.col("ts") >= F.lit(start)).join(hottest, ["stream", "shard_id"], "left_semi")
    return first_rows(rows, ["stream"], order, thresholds.sample_records).drop("rn")


def key_shares(sample: DataFrame) -> DataFrame:
    """How often each key occurs in its stream's sample."""
    counts = sample.filter("partition_key IS NOT NULL").groupBy("stream", "partition_key").agg(
        F.count("*").alias("count")
    )
    totals = counts.groupBy("stream").agg(F.sum("count").alias("total"))
    return counts.join(totals, "stream").select(
        "stream", "partition_key", "count", (F.col("count") / F.col("total")).alias("share")
    )


def top_keys(sample: DataFrame, thresholds: SkewThresholds = SkewThresholds()) -> DataFrame:
    """The most frequent keys per stream, and of those the ones large enough to name."""
    order = Window.partitionBy("stream").orderBy(F.desc("count"), "partition_key")
    return (
        key_shares(sample)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= thresholds.sample_keys)
        .filter(F.col("share") >= thresholds.sample_minimum_share)
    )

"""The scan of all streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.kept import kept
from meterwise.operators import keys, shards as sh, streams as st
from meterwise.operators.endpoints import verdict_counts
from meterwise.settings import STREAM_VERDICTS, SkewThresholds


def stream_scan(
    streams: DataFrame,
    shards: DataFrame,
    points: DataFrame,
    start: dt.datetime,
    end: dt.datetime,
    thresholds: SkewThresholds = SkewThresholds(),
    records: DataFrame | None = None,
    record_order: tuple[str, ...] = ("ts", "partition_key"),
    names: list[str] | None = None,
) -> dict[str, DataFrame]:
    """Shard scores, statistics and verdicts of every stream; top keys when `records` is given.

    Tables that several results read are kept in the shared folder: run it inside `kept.released` to have them removed.
    """
    # Inventories and scores are read by several results: each is worked out once.
    streams = kept(st.named_streams(streams, names))
    measurable = streams.filter(F.size(st.missing_metrics(F.col("enabled_metrics"))) == 0).select("stream")
    relevant = kept(sh.shards_in_window(shards, start).join(streams.select("stream"), "stream", "left_semi"))
    # Datapoints are read only for streams that emit all the metrics.
    watched = relevant.join(measurable, "stream", "left_semi")
    scored = kept(sh.utilisation(watched, sh.traffic(points, start, end), sh.window_minutes(start, end), thresholds))
    statistics = sh.statistics(scored, thresholds)
    diagnosed = st.diagnose(streams, scored, statistics, thresholds)
    counted = sh.resharding(relevant).withColumnRenamed("open_shard_count", "open_shards_listed")
    full = diagnosed.join(counted, "stream", "left").withColumn("resharded", F.coalesce("resharded", F.lit(False)))
    described = F.col("open_shard_count") if "open_shard_count" in streams.columns else F.lit(0)
    full = full.withColumn(
        "open_shard_count", F.when(described > 0, described).otherwise(F.coalesce("open_shards_listed", F.lit(0)))
    ).drop("open_shards_listed")
    report = {
        "streams": st.ordered(full),
        "shards": scored,
        "counts": verdict_counts(diagnosed, STREAM_VERDICTS),
    }
    if records is not None:
        hottest = keys.hottest_open_shard(scored)
        sample = keys.sample_records(records, hottest, start, list(record_order), thresholds)
        report["sampled_shards"] = hottest
        report["top_keys"] = keys.top_keys(sample, thresholds)
    return report

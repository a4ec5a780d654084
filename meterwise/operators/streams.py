"""What is wrong with each stream, if anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.functions.text import fixed, percent, thousands
from meterwise.settings import SHARD_METRICS, STREAM_PROBLEMS, SkewThresholds

STATISTICS = (
    "shard_count", "max_to_mean", "variation", "hottest_share", "hottest_shard_id",
    "mean_utilisation", "max_utilisation", "gini",
)


def missing_metrics(enabled: Column) -> Column:
    """Needed shard metrics a stream does not emit; `ALL` stands for every one."""
    needed = F.array(*[F.lit(m) for m in SHARD_METRICS])
    have = F.coalesce(enabled, F.array().cast("array<string>"))
    return F.when(F.array_contains(have, "ALL"), F.array().cast("array<string>")).otherwise(
        F.array_except(needed, have)
    )


def capacity_mode(mode: Column) -> Column:
    return F.when(mode.isin("PROVISIONED", "ON_DEMAND"), mode).otherwise("PROVISIONED")


def diagnose(
    streams: DataFrame, scored: DataFrame, statistics: DataFrame, thresholds: SkewThresholds = SkewThresholds()
) -> DataFrame:
    """One row per stream: verdict, headline, evidence, remedy, statistics.

    Throttling counts all shards, the statistics only the comparable ones.
    """
    sums = scored.groupBy("stream").agg(
        F.sum("throttled_records").alias("throttled_records"),
        F.max("utilisation").alias("peak_utilisation"),
    )
    rows = (
        streams.withColumn("missing_metrics", missing_metrics(F.col("enabled_metrics")))
        .withColumn("capacity_mode", capacity_mode(F.col("capacity_mode")))
        .join(sums, "stream", "left")
        .join(statistics, "stream", "left")
        .withColumn("throttled_records", F.coalesce("throttled_records", F.lit(0.0)))
    )
    t = thresholds
    throttled = F.col("throttled_records") > 0
    traffic = F.coalesce(F.col("peak_utilisation") > 0, F.lit(False))
    concentrated = (F.col("max_to_mean") >= t.max_to_mean) & (F.col("gini") >= t.gini)
    mean = F.col("mean_utilisation")
    verdict = (
        F.when(F.size("missing_metrics") > 0, "no_shard_metrics")
        .when(~traffic & ~throttled, "no_traffic")
        .when(~throttled, "healthy")
        .when(F.col("shard_count").isNull(), "capacity")
        .when(concentrated & (mean <= t.headroom), "skew")
        .when(concentrated, "mixed")
        .when(mean >= t.near_capacity, "capacity")
        .otherwise("bursty")
    )
    judged = rows.withColumn("verdict", verdict).withColumn(
        "is_problem", F.col("verdict").isin(*STREAM_PROBLEMS)
    )
    headline, evidence, remedy = _messages(t)
    return judged.withColumns({"headline": headline, "evidence": evidence, "remedy": remedy}).drop(
        "peak_utilisation"
    )


def _messages(t: SkewThresholds) -> tuple[Column, Column, Column]:
    verdict = F.col("verdict")
    provisioned = F.col("capacity_mode") == "PROVISIONED"
    single = F.col("shard_count").isNull()

    def text(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    rejected = text(thousands(F.col("throttled_records")), " records were throttled")
    gini, times = fixed(F.col("gini"), 2), fixed(F.col("max_to_mean"), 1)
    mean, top = percent(F.col("mean_utilisation")), percent(F.col("max_utilisation"))
    hottest = text(
        F.col("hottest_shard_id"), " takes ", percent(F.col("hottest_share")), " of the bytes of ",
        F.col("shard_count").cast("string"), " shards, ", times, " times the mean",
    )
    average = text("at its peak the mean shard uses ", mean, " of its write limit")

    headline = (
        F.when(verdict == "no_shard_metrics", "Per-shard metrics are switched off: skew is not measurable")
        .when(verdict == "no_traffic", "Nothing was written in this window")
        .when(verdict == "healthy", "Writes were not throttled")
        .when(verdict == "skew", "Key skew: one shard is full and the others are not")
        .when(verdict == "mixed", "Key skew on a stream that is busy anyway")
        .when((verdict == "capacity") & single, "Full, with too few shards for skew to matter")
        .when((verdict == "capacity") & provisioned, "Too few shards for an even load")
        .when(verdict == "capacity", "More load than the stream has scaled to")
        .otherwise("Throttled by spikes shorter than one datapoint")
    )
    evidence = (
        F.when(verdict == "no_shard_metrics", F.array(text("not emitted per shard: ", F.array_join("missing_metrics", ", "))))
        .when(verdict == "no_traffic", F.array(F.lit("per-shard metrics are on and show no incoming data")))
        .when(
            verdict == "healthy",
            F.array_compact(
                F.array(
                    F.lit("no throttled writes"),
                    F.when(~single, text("the busiest shard peaks at ", top, " of its limit, the mean at ", mean)),
                    F.when(F.col("gini") >= t.gini, text("uneven load (Gini ", gini, ") that has not hurt yet")),
                )
            ),
        )
        .when(
            verdict == "skew",
            F.array(
                rejected, hottest, text("Gini ", gini, ", coefficient of variation ", fixed(F.col("variation"), 2)), average
            ),
        )
        .when(verdict == "mixed", F.array(rejected, hottest, average))
        .when((verdict == "capacity") & single, F.array(rejected, F.lit("too few comparable shards to rank")))
        .when(verdict == "capacity", F.array(rejected, text("the load is even (Gini ", gini, ", busiest shard ", times, " times the mean)"), average))
        .otherwise(
            F.array(rejected, text("the load is even (Gini ", gini, ") and the busiest minute reaches only ", top, " of a limit"))
        )
    )
    keys = "choose a key with more distinct values, or salt the busy one and merge downstream"
    remedy = (
        F.when(verdict == "no_shard_metrics", text("enable enhanced monitoring for ", F.array_join("missing_metrics", " "), " and look again later"))
        .when(verdict == "no_traffic", "check the producers and the window if traffic was expected")
        .when(verdict == "healthy", "none needed")
        .when((verdict == "skew") & provisioned, f"more shards cannot help, one key stays on one shard: {keys}")
        .when(verdict == "skew", f"scaling cannot help, one key stays on one shard: {keys}")
        .when((verdict == "mixed") & provisioned, f"add shards, and {keys}")
        .when(verdict == "mixed", f"let the stream scale to the new peak, and {keys}")
        .when((verdict == "capacity") & provisioned, "add shards")
        .when((verdict == "capacity") & single, "retry with backoff until the stream has scaled out")
        .when(verdict == "capacity", "ramp up more slowly, retry with backoff, or ask for higher limits")
        .when(provisioned, "batch and spread out the writes; failing that, add shards")
        .otherwise("batch and spread out the writes; the stream does not scale on spikes")
    )
    return headline, evidence, remedy


def ordered(diagnosed: DataFrame) -> DataFrame:
    """Problems first, then the most throttled, then by name."""
    return diagnosed.orderBy(F.when(F.col("is_problem"), 0).otherwise(1), F.desc("throttled_records"), "stream")


def problems(diagnosed: DataFrame) -> DataFrame:
    return diagnosed.filter("is_problem")


def with_verdict(judged: DataFrame, verdict: str) -> DataFrame:
    return judged.filter(F.col("verdict") == verdict)


def named_streams(streams: DataFrame, names: list[str] | None) -> DataFrame:
    return streams.filter(F.col("stream").isin(names)) if names else streams

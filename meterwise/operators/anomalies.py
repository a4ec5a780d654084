"""Call patterns that look like something has gone wrong, from metadata alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterwise.functions.text import short_number, thousands
from meterwise.kept import kept
from meterwise.operators.invocations import identity_label
from meterwise.operators.small import first_rows
from meterwise.operators.spacing import spaced
from meterwise.settings import UsageThresholds

COLUMNS = (
    "kind", "identity_arn", "window_start", "window_end", "request_count", "cost_usd", "detail",
    "model_id",
)
_MICRO = 1_000_000
# Blocks of a caller's time line, in windows: an event is repeated in the next block only when it
# lies in the last window of its own, so one row in this many is sent twice.
_BLOCK_WINDOWS = 16


def calls_of(costed: DataFrame) -> DataFrame:
    """What the detectors read of each call, kept in the shared folder until it is released."""
    calls = costed.select(
        identity_label().alias("identity_arn"), "model_id", "input_tokens", "request_id", "source",
        F.unix_micros("ts").alias("at"),
        F.coalesce("cost_usd", F.lit(0).cast("decimal(20,6)")).alias("cost_usd"),
    )
    return kept(calls)


def _dense_moments(calls: DataFrame, keys: list[str], width: int, needed: int) -> DataFrame:
    """Moments (keys, at) at which at least `needed` calls lie within the `width` up to then.

    Calls at one moment are counted map-side first. Only `needed` of them can matter, so a storm of
    equal timestamps stays small. A caller's time line is cut into blocks that overlap by one
    window; the test is a look `needed - 1` calls back, which costs the same for any density.
    """
    moments = calls.groupBy(*keys, "at").agg(F.count(F.lit(1)).alias("n"))
    size = _BLOCK_WINDOWS * width
    own = F.floor(F.col("at") / size)
    tail = F.col("at") >= (own + 1) * size - width
    blocked = moments.select(
        *keys, "at", own.alias("own"), F.least("n", F.lit(needed)).cast("int").alias("n"),
        F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))).alias("block"),
    )
    each = blocked.select(
        *keys, "at", "block", (F.col("own") == F.col("block")).alias("mine"),
        F.explode(F.array_repeat(F.lit(0), F.col("n"))),
    )
    order = Window.partitionBy(*keys, "block").orderBy("at")
    back = F.lag("at", needed - 1).over(order) if needed > 1 else F.col("at")
    seen = each.select(*keys, "at", "mine", back.alias("back"))
    return seen.filter(F.col("mine") & (F.col("back") >= F.col("at") - width)).select(*keys, "at").distinct()


def _measured(calls: DataFrame, found: DataFrame, keys: list[str], width: int, needed: int) -> DataFrame:
    """Start, count and cost of each finding: the calls up to its first triggering call.

    Findings of one key are more than a window apart, so every call belongs to at most one. The
    join is on the key and a one-window slot, so a caller is spread over its slots.
    """
    slots = F.array(F.floor(F.col("at") / width) - 1, F.floor(F.col("at") / width))
    found = kept(found)
    targets = found.select(*keys, F.col("at").alias("end"), F.explode(slots).alias("slot"))
    rows = calls.withColumn("slot", F.floor(F.col("at") / width)).join(targets, [*keys, "slot"])
    rows = rows.filter((F.col("at") <= F.col("end")) & (F.col("at") >= F.col("end") - width))
    early = F.col("at") < F.col("end")
    spans = rows.groupBy(*keys, "end").agg(
        F.count_if(early).alias("before"),
        F.min("at").alias("start"),
        F.sum(F.when(early, F.col("cost_usd"))).alias("early_cost"),
    )
    # Of the calls at the very moment of the trigger, those needed to reach it, in read order.
    moment = rows.filter(~early).select(*keys, "end", "source", "request_id", "cost_usd")
    last = first_rows(moment, [*keys, "end"], ["source", "request_id", "cost_usd"], max(1, needed)).select(
        *keys, "end", "cost_usd", "rn"
    )
    count = F.greatest(F.col("before") + 1, F.lit(needed))
    totals = (
        last.join(spans, [*keys, "end"])
        .filter(F.col("rn") <= count - F.col("before"))
        .groupBy(*keys, "end", "start", "before", "early_cost")
        .agg(F.sum("cost_usd").alias("last_cost"))
    )
    return totals.select(
        *keys,
        F.timestamp_micros("start").alias("window_start"),
        F.timestamp_micros("end").alias("window_end"),
        count.alias("request_count"),
        (F.coalesce("early_cost", F.lit(0)) + F.col("last_cost")).cast("decimal(20,6)").alias("cost_usd"),
    )


def bursts(costed: DataFrame, thresholds: UsageThresholds = UsageThresholds(), calls: DataFrame | None = None) -> DataFrame:
    """Callers making many calls in a short time; one finding per burst, at its first trigger."""
    width, needed = thresholds.burst_window_seconds * _MICRO, thresholds.burst_count
    calls, keys = calls or calls_of(costed), ["identity_arn"]
    moments = _dense_moments(calls, keys, width, needed)
    found = _measured(calls, spaced(moments, keys, width), keys, width, needed)
    detail = F.format_string(
        f"%d calls within {thresholds.burst_window_seconds}s; the threshold is {needed}",
        F.col("request_count"),
    )
    return found.select(
        F.lit("burst").alias("kind"), "identity_arn", "window_start", "window_end",
        "request_count", "cost_usd", detail.alias("detail"),
        F.lit(None).cast("string").alias("model_id"),
    )


def repeated_shapes(costed: DataFrame, thresholds: UsageThresholds = UsageThresholds(), calls: DataFrame | None = None) -> DataFrame:
    """The same caller, model and input size again and again; the first trigger of each."""
    width, needed = thresholds.burst_window_seconds * _MICRO, thresholds.repeat_count
    calls = (calls or calls_of(costed)).filter("input_tokens IS NOT NULL")
    keys = ["identity_arn", "model_id", "input_tokens"]
    first = _dense_moments(calls, keys, width, needed).groupBy(*keys).agg(F.min("at").alias("at"))
    found = _measured(calls, first, keys, width, needed)
    detail = F.concat(
        F.col("request_count").cast("string"), F.lit(" calls to "), "model_id",
        F.lit(" with the same input size of "), thousands(F.col("input_tokens")),
        F.lit(f" tokens within {thresholds.burst_window_seconds}s"),
    )
    return found.select(
        F.lit("repeated_shape").alias("kind"), "identity_arn", "window_start", "window_end",
        "request_count", "cost_usd", detail.alias("detail"), "model_id",
    )


def rate_jumps(costed: DataFrame, thresholds: UsageThresholds = UsageThresholds(), calls: DataFrame | None = None) -> DataFrame:
    """Clock windows far above a caller's own median; quiet windows without calls do not count."""
    width = thresholds.burst_window_seconds
    slots = (
        (calls or calls_of(costed))
        .groupBy("identity_arn", F.floor(F.col("at") / (width * _MICRO)).alias("slot"))
        .agg(F.count(F.lit(1)).alias("request_count"), F.sum("cost_usd").alias("cost_usd"))
    )
    baseline = (
        slots.groupBy("identity_arn")
        .agg(F.percentile("request_count", F.lit(0.5)).alias("median"), F.count("*").alias("windows"))
        .filter(F.col("windows") >= thresholds.jump_minimum_windows)
        .select("identity_arn", "median")
    )
    multiple = F.col("request_count") / F.col("median")
    start = F.timestamp_seconds(F.col("slot") * width)
    detail = F.concat(
        F.col("request_count").cast("string"), F.lit(" calls where a usual window has "),
        short_number(F.col("median")), F.lit(": "),
        F.bround(multiple, 0).cast("bigint").cast("string"), F.lit("-fold"),
    )
    return (
        slots.filter(F.col("request_count") >= thresholds.jump_minimum_count)
        .join(baseline, "identity_arn")
        .filter(multiple >= thresholds.jump_multiple)
        .select(
            F.lit("rate_jump").alias("kind"), "identity_arn", start.alias("window_start"),
            F.timestamp_seconds((F.col("slot") + 1) * width).alias("window_end"),
            "request_count", F.col("cost_usd").cast("decimal(20,6)").alias("cost_usd"),
            detail.alias("detail"), F.lit(None).cast("string").alias("model_id"),
        )
    )


def detect(costed: DataFrame, thresholds: UsageThresholds = UsageThresholds()) -> DataFrame:
    """All three detectors, largest count first."""
    calls = calls_of(costed)
    return (
        bursts(costed, thresholds, calls)
        .unionByName(rate_jumps(costed, thresholds, calls))
        .unionByName(repeated_shapes(costed, thresholds, calls))
        .orderBy(F.desc("request_count"), "window_start", "identity_arn", "kind", "model_id")
    )


def duration_seconds() -> Column:
    return (F.unix_micros("window_end") - F.unix_micros("window_start")) / F.lit(_MICRO)


def calls_per_minute() -> Column:
    """The rate over the flagged window; a window of no length counts as one minute."""
    minutes = duration_seconds() / 60
    return F.when(minutes <= 0, F.col("request_count").cast("double")).otherwise(
        F.col("request_count") / minutes
    )


def with_rates(findings: DataFrame) -> DataFrame:
    return findings.select(
        "*", duration_seconds().alias("duration_seconds"), calls_per_minute().alias("calls_per_minute")
    )

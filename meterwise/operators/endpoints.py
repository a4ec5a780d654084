"""Endpoint variants: inventory, traffic, verdict, cost, remedy."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.functions.text import fixed, percent, short_number, thousands
from meterwise.operators.shards import in_window
from meterwise.settings import (
    ACCELERATED_FAMILIES, BILLING_STATUSES, ENDPOINT_STATUSES, ENDPOINT_VERDICTS, INVOCATIONS_METRIC,
    SERVERLESS_MAX_MEMORY_GB, SIZE_MEMORY_GB, WASTE_VERDICTS, IdleThresholds,
)

KEYS = ["region", "endpoint", "variant"]


def known_status(status: Column) -> Column:
    return F.when(status.isin(*ENDPOINT_STATUSES), status).otherwise("Unknown")


def inventory(endpoints: DataFrame, configs: DataFrame, targets: DataFrame, window_end: dt.datetime) -> DataFrame:
    """One row per variant: counts come from the endpoint, types from its configuration, and the
    smallest capacity from the scaling target registered under the variant's resource id."""
    running = endpoints.select(
        "region", "endpoint", known_status(F.col("status")).alias("status"),
        # Without a creation time nothing is known of its past.
        F.coalesce("created_at", F.lit(window_end)).alias("created_at"),
        "config_name", F.inline("variants"),
    ).select(
        "region", "endpoint", "status", "created_at", "config_name",
        F.col("variant_name").alias("variant"),
        F.coalesce("current_instance_count", F.lit(0)).alias("instance_count"),
        F.col("serverless.memory_mb").alias("running_memory_mb"),
        F.concat_ws("/", F.lit("endpoint"), "endpoint", F.lit("variant"), "variant_name").alias("resource_id"),
    )
    configured = configs.select("region", "config_name", F.inline("variants")).select(
        "region", "config_name", F.col("variant_name").alias("variant"),
        F.when(F.trim("instance_type") != "", F.col("instance_type")).alias("instance_type"),
        F.col("serverless.memory_mb").alias("configured_memory_mb"),
        (F.coalesce("model_name", F.lit("")) == "").alias("hosts_components"),
    ).dropDuplicates(["region", "config_name", "variant"])
    limits = targets.groupBy("region", "resource_id").agg(F.min(F.coalesce("min_capacity", F.lit(0))).alias("min_capacity"))
    return (
        running.join(configured, ["region", "config_name", "variant"], "left")
        .join(limits, ["region", "resource_id"], "left")
        .select(
            *KEYS, "status", "created_at", "instance_type", "instance_count",
            F.coalesce("running_memory_mb", "configured_memory_mb").alias("serverless_memory_mb"),
            F.coalesce("hosts_components", F.lit(False)).alias("hosts_components"),
            F.coalesce(F.col("min_capacity") == 0, F.lit(False)).alias("can_scale_to_zero"),
        )
    )


def bills() -> Column:
    return F.col("status").isin(*BILLING_STATUSES)


def is_serverless() -> Column:
    return F.col("serverless_memory_mb").isNotNull()


def needs_metrics() -> Column:
    """Whether traffic can change the verdict at all."""
    return bills() & ~is_serverless() & ~F.col("can_scale_to_zero")


def invocations(points: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Invocations per variant. A variant without datapoints has no row: unknown, not zero."""
    return in_window(points, start, end, (INVOCATIONS_METRIC,)).groupBy(*KEYS).agg(
        F.sum("value").alias("invocations"), F.count("value").alias("datapoints")
    )


def with_traffic(variants: DataFrame, measured: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Join traffic to the variants that need it, and add window coverage and density."""
    span = (end - start).total_seconds()
    # NULL keys never match, so variants settled without traffic are not looked up.
    asked = variants.withColumn("lookup", F.when(needs_metrics(), F.col("variant")))
    joined = asked.join(
        measured.withColumnRenamed("variant", "lookup"), ["region", "endpoint", "lookup"], "left"
    ).withColumn("datapoints", F.when(needs_metrics(), F.coalesce("datapoints", F.lit(0))))
    since = F.greatest(F.col("created_at"), F.lit(start))
    existed = (F.lit(end).cast("timestamp").cast("double") - since.cast("double")) / F.lit(span)
    coverage = F.greatest(F.lit(0.0), F.least(F.lit(1.0), existed)) if span > 0 else F.lit(0.0)
    observed = F.coalesce("invocations", F.lit(0.0))
    density = F.when(
        needs_metrics() & (F.col("instance_count") > 0),
        F.try_divide(observed, F.lit(span / 3600) * F.col("instance_count")),
    )
    return joined.select(
        *variants.columns, "invocations", "datapoints",
        coverage.alias("window_coverage"), density.alias("invocations_per_instance_hour"),
    )


def classify(measured: DataFrame, hours: float, thresholds: IdleThresholds = IdleThresholds()) -> DataFrame:
    """Add `verdict` and the sentence behind it."""
    observed = F.coalesce("invocations", F.lit(0.0))
    density, limit = F.col("invocations_per_instance_hour"), thresholds.invocations_per_instance_hour
    verdict = (
        F.when(~bills(), "not_billing")
        .when(is_serverless() | F.col("can_scale_to_zero"), "not_applicable")
        .when(F.col("window_coverage") < thresholds.minimum_coverage, "too_new")
        .when(F.col("datapoints").isNull(), "too_new")
        .when(F.col("instance_count") <= 0, "not_applicable")
        .when(observed <= 0, "idle")
        .when(density < limit, "underused")
        .otherwise("healthy")
    )

    def text(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    span = f"{hours:.0f} hours"
    rate = text(thousands(observed), f" invocations in {span}, ", fixed(density, 3), " per instance-hour")
    evidence = (
        F.when(~bills(), text("status ", F.col("status"), ": instances do not bill as usual"))
        .when(is_serverless(), text("serverless with ", F.col("serverless_memory_mb").cast("string"), " MB costs nothing while idle"))
        .when(F.col("can_scale_to_zero"), "autoscaling may go down to zero instances")
        .when(
            F.col("verdict") == "too_new",
            text("created ", F.to_date("created_at").cast("string"), ", covering ", percent(F.col("window_coverage")), " of the window"),
        )
        .when(F.col("instance_count") <= 0, "no instances, so none are idle")
        .when(
            F.col("verdict") == "idle",
            text(
                F.when(F.col("invocations").isNull(), "no data at all").otherwise("zero invocations"),
                f" in {span} on ", F.col("instance_count").cast("string"), " x ", F.coalesce("instance_type", F.lit("unknown type")),
            ),
        )
        .when(F.col("verdict") == "underused", text(rate, f", below {limit:g}"))
        .otherwise(text(rate, f", not below {limit:g}"))
    )
    caveat = F.when(
        F.col("hosts_components") & F.col("verdict").isin(*WASTE_VERDICTS),
        "; hosts inference components, whose own scaling is not known here",
    ).otherwise("")
    judged = measured.withColumn("verdict", verdict)
    return judged.withColumns(
        {"evidence": F.concat(evidence, caveat), "is_waste": F.col("verdict").isin(*WASTE_VERDICTS)}
    )


def justified_instances(hours: float, thresholds: IdleThresholds) -> Column:
    """Instances the traffic would justify: at least one, at most what there is."""
    count = F.col("instance_count")
    each = thresholds.invocations_per_instance_hour * hours
    if each <= 0:
        return F.greatest(F.lit(1), count)
    needed = F.ceil(F.coalesce("invocations", F.lit(0.0)) / F.lit(each))
    return F.greatest(F.lit(1), F.least(count, needed)).cast("int")


def instance_family(instance_type: Column) -> Column:
    parts = F.split(instance_type, r"\.")
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).otherwise("")


def approximate_memory_gb(instance_type: Column) -> Column:
    sizes = F.create_map(*[F.lit(x) for pair in SIZE_MEMORY_GB.items() for x in pair])
    parts = F.split(instance_type, r"\.")
    return F.when(F.size(parts) >= 3, F.try_element_at(sizes, F.get(parts, F.lit(2))))


def with_cost(
    judged: DataFrame, hosting: DataFrame, serverless: DataFrame, hours: float,
    thresholds: IdleThresholds = IdleThresholds(),
) -> DataFrame:
    """Add monthly cost, waste, remedy and the reason where an amount is unknown."""
    t, count = thresholds, F.col("instance_count")
    priced = judged.join(
        hosting.groupBy("region", "instance_type").agg(F.max("usd_per_hour").alias("hourly")),
        ["region", "instance_type"], "left",
    )
    hourly = F.col("hourly").cast("decimal(18,6)")
    monthly = F.round(hourly * count * t.hours_per_month, 2).cast("decimal(20,2)")
    justified = justified_instances(hours, t)
    surplus = F.greatest(F.lit(0), count - justified)
    unpriceable = F.coalesce("instance_type", F.lit("")).eqNullSafe("") | (count <= 0)
    zero = F.lit(0).cast("decimal(20,2)")
    underused, idle = F.col("verdict") == "underused", F.col("verdict") == "idle"
    cost = F.when(~is_serverless() & ~unpriceable, monthly)
    waste = (
        F.when(is_serverless() | unpriceable, zero)
        .when(hourly.isNull(), F.lit(None).cast("decimal(20,2)"))
        .when(idle, monthly)
        .when(underused & (surplus > 0), F.round(hourly * surplus * t.hours_per_month, 2).cast("decimal(20,2)"))
        .when(~underused, zero)
    )
    reason = (
        F.when(is_serverless(), "serverless bills per request, so nothing stands idle")
        .when(unpriceable, "no instances to price")
        .when(hourly.isNull(), F.concat(F.lit("not on the price list of "), "region", F.lit(": "), "instance_type"))
        .when(underused & (surplus == 0), "one instance is already more than the traffic needs")
    )
    small = ~instance_family(F.col("instance_type")).isin(*ACCELERATED_FAMILIES) & (
        approximate_memory_gb(F.col("instance_type")) <= t.serverless_memory_limit_gb
    )
    remedy = (
        F.when(idle, "delete")
        .when(~underused, "none")
        .when(surplus > 0, "reduce_instance_count")
        .when(F.coalesce(small, F.lit(False)), "move_to_serverless")
        .otherwise("move_to_async_scale_to_zero")
    )
    why = (
        F.when(idle, ". Suggested: delete it unless somebody still needs it")
        .when(
            underused & (surplus > 0),
            F.format_string(". Suggested: about %d of %d instances are enough", justified, count),
        )
        .when(
            F.coalesce(underused & small, F.lit(False)),
            f". Suggested: serverless, if the model fits into {SERVERLESS_MAX_MEMORY_GB} GB",
        )
        .when(underused, ". Suggested: an asynchronous endpoint that scales to zero")
        .otherwise("")
    )
    rows = priced.select(
        *judged.columns, F.col("hourly").alias("instance_hour_usd"), cost.alias("monthly_usd"),
        waste.alias("wasted_monthly_usd"), reason.alias("no_estimate_reason"), remedy.alias("remedy"), why.alias("why"),
    ).withColumn("evidence", F.concat("evidence", "why")).drop("why")
    return _serverless_comparison(rows, serverless, hours, t)


def _serverless_comparison(rows: DataFrame, serverless: DataFrame, hours: float, t: IdleThresholds) -> DataFrame:
    """What the same traffic would cost per request, on the caller's assumptions only."""
    missing = F.lit(None).cast("decimal(20,2)")
    if t.seconds_per_invocation is None or hours <= 0:
        return rows.withColumn("serverless_monthly_usd", missing)
    prices = serverless.filter(F.col("memory_gb") == t.serverless_memory_gb).groupBy("region").agg(
        F.max("usd_per_second").alias("per_second")
    )
    monthly_calls = F.coalesce("invocations", F.lit(0.0)) * (t.hours_per_month / hours)
    estimate = F.when(
        F.col("remedy") == "move_to_serverless",
        F.round(monthly_calls * t.seconds_per_invocation * F.col("per_second").cast("double"), 2).cast("decimal(20,2)"),
    )
    joined = rows.join(prices, "region", "left").withColumn("serverless_monthly_usd", estimate)
    fills = F.col("wasted_monthly_usd").isNull() & F.col("serverless_monthly_usd").isNotNull() & F.col("monthly_usd").isNotNull()
    saved = F.greatest(F.lit(0).cast("decimal(20,2)"), (F.col("monthly_usd") - F.col("serverless_monthly_usd")).cast("decimal(20,2)"))
    note = F.when(
        F.col("serverless_monthly_usd").isNotNull(),
        F.concat(
            F.lit(f". At {t.seconds_per_invocation:g} s and {t.serverless_memory_gb} GB, serverless would cost about $"),
            F.format_number("serverless_monthly_usd", 2), F.lit(" a month"),
        ),
    ).otherwise("")
    return joined.select(
        *[c for c in rows.columns if c not in ("wasted_monthly_usd", "no_estimate_reason", "evidence")],
        F.when(fills, saved).otherwise(F.col("wasted_monthly_usd")).alias("wasted_monthly_usd"),
        F.when(~fills, F.col("no_estimate_reason")).alias("no_estimate_reason"),
        F.concat("evidence", note).alias("evidence"),
        "serverless_monthly_usd",
    )


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc(F.coalesce("wasted_monthly_usd", F.lit(0))), "endpoint", "variant", "region")


def only_waste(findings: DataFrame) -> DataFrame:
    return findings.filter("is_waste")


def scan_totals(findings: DataFrame) -> DataFrame:
    """Money totals, and how many wasteful variants have no amount."""
    zero = F.lit(0).cast("decimal(20,2)")
    unknown = F.count_if(F.col("is_waste") & F.col("wasted_monthly_usd").isNull())
    return findings.agg(
        F.coalesce(F.sum("monthly_usd"), zero).alias("monthly_usd"),
        F.coalesce(F.sum("wasted_monthly_usd"), zero).alias("wasted_monthly_usd"),
        unknown.alias("findings_without_a_waste_estimate"),
        (unknown == 0).alias("totals_are_complete"),
        F.count("*").alias("findings"),
    )


def verdict_counts(judged: DataFrame, verdicts: tuple[str, ...] = ENDPOINT_VERDICTS) -> DataFrame:
    """Rows per verdict, those without any included: one row of counters, unfolded."""
    counters = [F.count_if(F.col("verdict") == v).alias(v) for v in verdicts]
    pairs = F.array(*[F.struct(F.lit(v).alias("verdict"), F.col(v).alias("count")) for v in verdicts])
    return judged.agg(*counters).select(F.inline(pairs))

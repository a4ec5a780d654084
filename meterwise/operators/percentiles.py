"""Token percentiles per model, and the requests beyond them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.settings import UsageThresholds


def _directions(inv: DataFrame, *keep: str) -> DataFrame:
    """One row per request and direction that has a count."""
    pairs = F.array(
        F.struct(F.lit("input").alias("direction"), F.col("input_tokens").alias("tokens")),
        F.struct(F.lit("output").alias("direction"), F.col("output_tokens").alias("tokens")),
    )
    return inv.select("model_id", *keep, F.inline(pairs)).filter("tokens IS NOT NULL")


def _rank(p: float) -> Column:
    """Nearest rank: a value that occurred, never one between two."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY tokens)").cast("bigint")


def percentiles(inv: DataFrame, thresholds: UsageThresholds = UsageThresholds()) -> DataFrame:
    """p50, p95, p99 and maximum per model and direction, busiest first.

    The aggregate keeps value counts and merges them map-side, so one model holding most of the
    rows still arrives at the reducer as its distinct token counts.
    """
    return (
        _directions(inv)
        .groupBy("model_id", "direction")
        .agg(
            F.count("*").alias("requests"),
            _rank(0.5).alias("p50"), _rank(0.95).alias("p95"), _rank(0.99).alias("p99"),
            F.max("tokens").alias("max_tokens"),
        )
        .withColumn("sample_is_meaningful", F.col("requests") >= thresholds.minimum_samples)
        .orderBy("direction", F.desc("requests"), "model_id")
    )


def outliers(inv: DataFrame, thresholds: UsageThresholds = UsageThresholds()) -> DataFrame:
    """Requests strictly above their model's percentile, where the model has enough samples.

    The smallest cut-off of each direction, a single value, thins the log out where it lies; what is
    left meets the cut-offs in a plain join.
    """
    cutoffs = (
        _directions(inv)
        .groupBy("model_id", "direction")
        .agg(F.count("*").alias("n"), _rank(thresholds.outlier_percentile).alias("cutoff"))
        .filter(F.col("n") >= thresholds.minimum_samples)
        .select("model_id", "direction", "cutoff")
    )
    rows = _directions(inv, "request_id", "identity_arn", "ts", "source")
    smallest = {d: cutoffs.filter(F.col("direction") == d).agg(F.min("cutoff")).scalar() for d in ("input", "output")}
    least = F.when(F.col("direction") == "input", smallest["input"]).otherwise(smallest["output"])
    return (
        rows.filter(F.col("tokens") > least).join(cutoffs, ["model_id", "direction"])
        .filter(F.col("tokens") > F.col("cutoff"))
        .select(
            "request_id", "model_id", "identity_arn", "ts",
            F.col("direction").alias("kind"), "tokens", "cutoff", "source",
        )
        .orderBy(F.desc("tokens"), "request_id")
    )

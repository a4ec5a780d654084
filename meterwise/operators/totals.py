"""Totals over costed invocations, grouped in every way the report needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.operators.invocations import identity_label

_TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
MEASURES = (
    "requests", *_TOKENS, "total_tokens", "cost_usd", "unpriced_requests", "cost_is_complete",
)


def _first() -> list[Column]:
    """Measures over invocation rows; missing counts add nothing, unpriced rows add no cost."""
    return [
        F.count(F.lit(1)).alias("requests"),
        *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in _TOKENS],
        F.sum("cost_usd").alias("cost_usd"),
        F.count_if(F.col("cost_usd").isNull()).alias("unpriced_requests"),
    ]


def _again() -> list[Column]:
    """The same measures over rows that are already sums."""
    names = ("requests", *_TOKENS, "cost_usd", "unpriced_requests")
    return [F.sum(c).alias(c) for c in names]


def _finished(sums: DataFrame, keys: list[str]) -> DataFrame:
    zero = F.lit(0)
    filled = sums.select(
        *keys,
        *[F.coalesce(F.col(c), zero).alias(c) for c in ("requests", *_TOKENS)],
        F.coalesce("cost_usd", zero.cast("decimal(20,6)")).alias("cost_usd"),
        F.coalesce("unpriced_requests", zero).alias("unpriced_requests"),
    )
    return filled.select(
        *keys, "requests", *_TOKENS,
        (F.col(_TOKENS[0]) + F.col(_TOKENS[1]) + F.col(_TOKENS[2]) + F.col(_TOKENS[3])).alias("total_tokens"),
        "cost_usd", "unpriced_requests",
        (F.col("unpriced_requests") == 0).alias("cost_is_complete"),
    )


def grand_total(costed: DataFrame) -> DataFrame:
    return _finished(costed.agg(*_first()), [])


def grouped(costed: DataFrame, key: Column, by_cost: bool = True) -> DataFrame:
    """Totals by any key expression: dearest first, or by key where the key is a time."""
    sums = costed.groupBy(key.alias("key")).agg(*_first())
    order = (
        [F.desc("cost_usd"), F.desc("requests"), F.asc("key")] if by_cost else [F.asc("key")]
    )
    return _finished(sums, ["key"]).orderBy(*order)


def by_model(costed: DataFrame) -> DataFrame:
    return grouped(costed, F.col("model_id"))


def by_identity(costed: DataFrame) -> DataFrame:
    return grouped(costed, identity_label())


def by_hour(costed: DataFrame) -> DataFrame:
    return grouped(costed, F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ssxxx"), False)


def by_day(costed: DataFrame) -> DataFrame:
    return grouped(costed, F.date_format("ts", "yyyy-MM-dd"), False)


def all_groupings(costed: DataFrame) -> DataFrame:
    """The grand total and all four groupings in one pass: grouping, key, measures.

    The log is reduced to (model, identity, hour) sums once, with map-side combining; only those
    sums are multiplied by the grouping sets.
    """
    base = costed.groupBy(
        F.col("model_id"),
        identity_label().alias("identity"),
        F.date_trunc("hour", "ts").alias("hour"),
    ).agg(*_first())
    base = base.withColumn("day", F.to_date("hour"))
    sets = base.groupingSets(
        [[], [F.col("model_id")], [F.col("identity")], [F.col("hour")], [F.col("day")]],
        F.col("model_id"), F.col("identity"), F.col("hour"), F.col("day"),
    ).agg(F.grouping_id().alias("gid"), *_again())
    # grouping_id has a bit set for every column that is not part of the set.
    name = (
        F.when(F.col("gid") == 7, "model").when(F.col("gid") == 11, "identity")
        .when(F.col("gid") == 13, "hour").when(F.col("gid") == 14, "day").otherwise("all")
    )
    key = (
        F.when(F.col("gid") == 7, F.col("model_id")).when(F.col("gid") == 11, F.col("identity"))
        .when(F.col("gid") == 13, F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ssxxx"))
        .when(F.col("gid") == 14, F.col("day").cast("string")).otherwise("all")
    )
    return _finished(sets.withColumns({"grouping": name, "key": key}), ["grouping", "key"])


def covered_window(inv: DataFrame) -> DataFrame:
    return inv.agg(F.min("ts").alias("window_start"), F.max("ts").alias("window_end"))


def most_expensive(costed: DataFrame, k: int = 10) -> DataFrame:
    """The k dearest priced requests; metadata only."""
    return (
        costed.filter("cost_usd IS NOT NULL")
        .orderBy(F.desc("cost_usd"), F.asc("request_id"))
        .limit(max(0, k))
    )

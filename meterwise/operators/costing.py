"""What each invocation cost at list price, or why that cannot be said."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.functions.text import model_key, model_scope, service_key, strip
from meterwise.settings import TOKEN_KINDS

RATES = "decimal(12,6)"
MONEY = "decimal(20,6)"


def rate_table(prices: DataFrame) -> DataFrame:
    """Long prices (region, service_name, rate_kind, usd_per_mtok) to one row per look-up key.

    A service is found by its own name or by the words its name reduces to; where two services of a
    region reduce to the same words, the first by name is used.
    """
    kinds = [k + s for k in TOKEN_KINDS for s in ("", "_global")]
    wide = prices.groupBy("region", "service_name").agg(
        *[
            F.max(F.when(F.col("rate_kind") == k, F.col("usd_per_mtok").cast(RATES))).alias(f"rate_{k}")
            for k in kinds
        ]
    )
    keys = F.array(
        F.concat(F.lit("name:"), "service_name"),
        F.concat(F.lit("words:"), service_key(F.col("service_name"))),
    )
    rates = [f"rate_{k}" for k in kinds]
    return (
        wide.select("region", "service_name", *rates, F.explode(keys).alias("price_key"))
        .groupBy("region", "price_key")
        .agg(F.min_by(F.struct("service_name", *rates), "service_name").alias("r"))
        .select("region", "price_key", "r.*")
    )


def with_cost(inv: DataFrame, prices: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Add `service_name`, `cost_usd` and `no_price_reason`.

    `overrides` (model_id, service_name) names a price for models the words cannot reach. The joins
    carry no hints: the planner sizes prices and overrides in bytes and splits hot models.
    """
    # An id without words has the key "words:", which no service has, so the words are worked out once.
    rates = rate_table(prices).filter(F.col("price_key") != "words:")
    regions = prices.select("region").distinct().select("region", F.lit(True).alias("region_priced"))
    key = F.concat(F.lit("words:"), model_key(F.col("model_id")))
    keyed = inv
    if overrides is not None:
        # An id is looked up as it is written, then trimmed and in lower case.
        named = overrides.groupBy("model_id").agg(F.min("service_name").alias("service"))
        exact = named.select(F.col("model_id"), F.col("service").alias("exact_service"))
        lower = named.select(
            F.col("model_id").alias("lower_id"), F.col("service").alias("lower_service")
        )
        keyed = keyed.join(exact, "model_id", "left").join(
            lower, F.lower(strip(F.col("model_id"))) == F.col("lower_id"), "left"
        )
        service = F.coalesce("exact_service", "lower_service")
        key = F.coalesce(F.concat(F.lit("name:"), service), key)
    keyed = keyed.select(*inv.columns, key.alias("price_key"))
    priced = keyed.join(rates, ["region", "price_key"], "left").join(regions, "region", "left")
    cost, reason = _cost()
    return priced.select(
        *inv.columns, "service_name", cost.alias("cost_usd"), reason.alias("no_price_reason")
    )


def _cost() -> tuple[Column, Column]:
    is_global = model_scope(F.col("model_id")) == "global"
    zero = F.lit(Decimal(0)).cast("decimal(32,6)")
    micro, lacks, named = zero, F.lit(False), []
    for kind in TOKEN_KINDS:
        tokens = F.col(f"{kind}_tokens")
        charged = F.coalesce(tokens > 0, F.lit(False))
        rate = F.coalesce(F.when(is_global, F.col(f"rate_{kind}_global")), F.col(f"rate_{kind}"))
        # Decimals, so that a total does not depend on the order rows are added in.
        micro = micro + F.when(charged, tokens.cast("decimal(19,0)") * rate).otherwise(zero)
        lacks = lacks | (charged & rate.isNull())
        named.append(F.when(charged & rate.isNull(), F.lit(kind)))
    found = F.col("service_name").isNotNull()
    usd = (F.round(micro, 0).cast("decimal(24,0)") * F.lit(Decimal("0.000001"))).cast(MONEY)
    where = F.when(F.coalesce(F.col("region"), F.lit("")) == "", "an unnamed region").otherwise(F.col("region"))
    reason = (
        F.when(F.col("region_priced").isNull(), F.concat(F.lit("region without rates: "), where))
        .when(~found, F.concat(F.lit("not on the price list of "), where, F.lit(": "), "model_id"))
        .when(
            lacks,
            F.concat(F.lit("price list of "), where, F.lit(" lacks a rate for "), F.concat_ws(", ", *named)),
        )
    )
    return F.when(found & ~lacks, usd), reason


def unpriced_models(costed: DataFrame) -> DataFrame:
    """Models with at least one request that has no cost, so that a total is a floor."""
    return costed.filter("cost_usd IS NULL").select("model_id").distinct()

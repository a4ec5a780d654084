"""Price tables out of published offer documents (region, document)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.operators.small import once

# Shape and vocabulary of an offer document.
_OFFER = (
    "products map<string, struct<productFamily string, attributes map<string,string>>>, "
    "terms struct<OnDemand map<string, map<string, struct<priceDimensions map<string, "
    "struct<unit string, pricePerUnit map<string,string>>>>>>>"
)
_TOKEN_USAGE = (
    "_(InputTokenCount|OutputTokenCount|CacheReadInputTokenCount|CacheWriteInputTokenCount)(_Global)?-Units$"
)
_TOKEN_KINDS = {
    "InputTokenCount": "input", "OutputTokenCount": "output",
    "CacheReadInputTokenCount": "cache_read", "CacheWriteInputTokenCount": "cache_write",
}
_NOT_ON_DEMAND = "Batch|Reserved|LatencyOptimized|TPM|ProvisionedThroughput"
_TOKEN_UNIT = "1M tokens"
_HOSTING = "Hosting"
_SERVERLESS_FAMILY = "ML Serverless"
_SERVERLESS_USAGE = r"ServerlessInf:Mem-([0-9]+)GB$"


def read_offers(spark: SparkSession, path: str) -> DataFrame:
    """Offer documents under `path`, one file per region, named after it."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("region"),
        F.col("value").alias("document"),
    )


def _offered(offers: DataFrame, wanted: Callable[[Column], Column]) -> DataFrame:
    """(region, product, rates) of the wanted products; rates are their on-demand (term, dimension, usd, unit).

    A document is parsed once, and the terms of a product are looked up in the row that holds it: products are
    thinned out before they leave the document, and nothing is shuffled.
    """
    parsed = once(offers, F.col("region"), F.from_json("document", _OFFER).alias("offer"))
    products = F.map_filter("offer.products", lambda sku, product: F.coalesce(wanted(product), F.lit(False)))
    rows = parsed.select("region", F.col("offer.terms.OnDemand").alias("terms"), F.explode(products).alias("sku", "product"))

    def rate(term: Column, dimension: Column) -> Column:
        price = dimension["value"]["pricePerUnit"]["USD"].try_cast("decimal(24,12)")
        return F.struct(term.alias("term"), dimension["key"].alias("dimension"), price.alias("usd"), dimension["value"]["unit"].alias("unit"))

    rates = F.flatten(
        F.transform(
            F.map_entries(F.col("terms")[F.col("sku")]),
            lambda t: F.transform(F.map_entries(t["value"]["priceDimensions"]), lambda d: rate(t["key"], d)),
        )
    )
    return rows.select("region", "product", rates.alias("rates"))


def _first_price(offered: DataFrame, *columns: Column) -> DataFrame:
    """The columns, and as usd and unit the price of each product's first term and dimension by code."""
    return offered.select("region", *columns, F.inline(F.array(F.array_min("rates")))).filter("usd > 0")


def _usage(product: Column) -> Column:
    return F.coalesce(product["attributes"]["usagetype"], F.lit(""))


def token_prices(offers: DataFrame) -> DataFrame:
    """(region, service_name, rate_kind, usd_per_mtok): plain on-demand rates per million tokens."""
    names = F.create_map(*[F.lit(x) for pair in _TOKEN_KINDS.items() for x in pair])
    usage = _usage(F.col("product"))
    kind = F.concat(
        names[F.regexp_extract(usage, _TOKEN_USAGE, 1)], F.when(F.regexp_extract(usage, _TOKEN_USAGE, 2) != "", "_global").otherwise("")
    )
    offered = _offered(offers, lambda p: ~_usage(p).rlike(_NOT_ON_DEMAND) & _usage(p).rlike(_TOKEN_USAGE))
    rates = offered.select(
        "region", F.trim(F.col("product.attributes")["servicename"]).alias("service_name"), kind.alias("rate_kind"), F.inline("rates")
    )
    return (
        rates.filter((F.col("service_name") != "") & F.contains("unit", F.lit(_TOKEN_UNIT)))
        .groupBy("region", "service_name", "rate_kind")
        .agg(F.max("usd").cast("decimal(12,6)").alias("usd_per_mtok"))
    )


def hosting_prices(offers: DataFrame) -> DataFrame:
    """(region, instance_type, usd_per_hour) of hosting instances."""
    attributes = F.col("product.attributes")
    named = F.when(attributes["instanceName"] != "", attributes["instanceName"])
    name = F.replace(
        F.coalesce(named, attributes["instanceType"], F.lit("")), F.lit(f"-{_HOSTING}"), F.lit("")
    )
    offered = _offered(offers, lambda p: p["attributes"]["component"] == _HOSTING)
    return (
        _first_price(offered, name.alias("instance_type"))
        .filter(F.col("instance_type").startswith("ml."))
        .groupBy("region", "instance_type")
        .agg(F.max(F.round("usd", 6)).cast("decimal(12,6)").alias("usd_per_hour"))
    )


def serverless_prices(offers: DataFrame) -> DataFrame:
    """(region, memory_gb, usd_per_second) of on-demand serverless inference."""

    def wanted(product: Column) -> Column:
        hosting = F.coalesce(product["attributes"]["component"] == _HOSTING, F.lit(False))
        return ~hosting & (product["productFamily"] == _SERVERLESS_FAMILY) & _usage(product).rlike(_SERVERLESS_USAGE)

    memory = F.regexp_extract(_usage(F.col("product")), _SERVERLESS_USAGE, 1).cast("int").alias("memory_gb")
    return (
        _first_price(_offered(offers, wanted), memory)
        .filter(F.lower("unit").isin("second", "seconds"))
        .groupBy("region", "memory_gb")
        .agg(F.max(F.round("usd", 10)).cast("decimal(18,10)").alias("usd_per_second"))
    )

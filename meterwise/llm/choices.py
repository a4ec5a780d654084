"""Production parameters that more than one query uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIX = {"budget_percent": 60, "max_epochs": 3, "seed": 17}

# (domain, language, source, weight); every other node has weight 1.
MIX_WEIGHTS = (
    ("d0", None, None, 3), ("d1", None, None, 2), ("d0", "en", None, 2), ("d1", "de", None, 4), ("d0", "en", "src1", 3),
)


def mix_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MIX_WEIGHTS, "domain string, language string, source string, weight bigint")


def mix_domain(source: str = "source") -> Column:
    """Five sources make a domain; a source without a number has none."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9]{1,9})", 1)
    return F.when(number != "", F.concat(F.lit("d"), F.floor(number.cast("int") / 5).cast("string")))

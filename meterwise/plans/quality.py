"""From a table to its quality rules, and from rules to a verdict on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterwise.operators.evaluate import evaluate
from meterwise.operators.profile import dataset_summary, profile, with_ratios
from meterwise.operators.rules import derive_rules
from meterwise.operators.ruletext import document
from meterwise.settings import QualityShape
from meterwise.sources.tables import Loaded, read_table


def quality_report(
    loaded: Loaded, strictness: str = "balanced", shape: QualityShape = QualityShape(), heading: str = ""
) -> dict[str, DataFrame]:
    """Profile, dataset summary, rules, the rule document, and the rules applied to the table."""
    profiled = profile(loaded.table, shape, loaded.sampled, loaded.total_row_count)
    rules = derive_rules(profiled, strictness, shape)
    return {
        "dataset": dataset_summary(profiled),
        "columns": with_ratios(profiled),
        "rules": rules,
        "document": document(rules, heading or f"{loaded.source_format}, {strictness}"),
        "checks": evaluate(loaded.table, rules),
    }


def quality_report_of(
    spark: SparkSession, path: str, strictness: str = "balanced", sample: int | None = None
) -> dict[str, DataFrame]:
    return quality_report(read_table(spark, path, sample), strictness, heading=path)

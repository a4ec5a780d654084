"""Writing results: one folder per section, JSON lines or CSV, and rule documents as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.operators.ruletext import document

# Fixed value: column order of the findings file.
FINDING_COLUMNS = (
    "region", "endpoint", "variant", "status", "verdict", "instance_type", "instance_count",
    "invocations", "invocations_per_instance_hour", "estimated_monthly_usd",
    "estimated_wasted_monthly_usd", "remedy", "evidence",
)


def write_sections(sections: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Every table of a report as JSON under `path`/name; each is written by its own tasks."""
    for name, table in sections.items():
        table.write.mode(mode).option("ignoreNullFields", "false").json(f"{path.rstrip('/')}/{name}")


def nested(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, row): all tables of a report as JSON text in one table."""
    parts = [
        table.select(F.lit(name).alias("section"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
        for name, table in sections.items()
    ]
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def finding_rows(findings: DataFrame) -> DataFrame:
    """Findings under their published names, in the fixed order."""
    density = F.round("invocations_per_instance_hour", 6)
    return findings.withColumns(
        {
            "invocations_per_instance_hour": density,
            "estimated_monthly_usd": F.col("monthly_usd"),
            "estimated_wasted_monthly_usd": F.col("wasted_monthly_usd"),
        }
    ).select(*FINDING_COLUMNS)


def write_findings_csv(findings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    finding_rows(findings).write.mode(mode).option("header", True).csv(path)


def write_rule_document(rules: DataFrame, path: str, heading: str, mode: str = "errorifexists") -> None:
    """The rule document as one text file; it has a few lines per profiled column."""
    document(rules, heading).select(F.rtrim("document", F.lit("\n"))).coalesce(1).write.mode(mode).text(path)

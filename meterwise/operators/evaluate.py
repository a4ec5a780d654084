"""Applying a rule table to a DataFrame."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.operators.profile import column, distinct_counts

# Rule data types and what they cast to.
_CASTS = {
    "Boolean": "boolean", "Date": "date", "Timestamp": "timestamp", "Integer": "int",
    "Double": "double", "Float": "float", "Long": "bigint",
}
_DISTINCT_RULES = ("IsUnique", "Uniqueness", "IsPrimaryKey", "DistinctValuesCount")


def failing(rule: Row, schema: T.StructType) -> Column:
    """Whether a row breaks a rule that is judged row by row. Nulls are for completeness to judge."""
    value, field = column(rule["column"]), schema[rule["column"]]
    if rule["rule_type"] == "IsComplete":
        return value.isNull()
    if rule["rule_type"] == "ColumnDataType":
        return value.isNotNull() & value.cast("string").try_cast(_CASTS[rule["low"]]).isNull()
    if rule["rule_type"] == "ColumnLength":
        size = F.octet_length(value)
        return ~F.coalesce(size.between(int(rule["low"]), int(rule["high"])), F.lit(True))
    if rule["op"] == "in":
        return ~F.coalesce(value.cast("string").isin(*rule["values"]), F.lit(True))
    low, high = Decimal(rule["low"]), Decimal(rule["high"])
    if isinstance(field.dataType, T.IntegralType):
        bounds = value.cast("decimal(38,0)").between(F.lit(low), F.lit(high))
    else:
        bounds = value.cast("double").between(float(low), float(high))
    return ~F.coalesce(bounds, F.lit(True))


def by_row(rule: Row) -> bool:
    return rule["rule_type"] in ("IsComplete", "ColumnValues", "ColumnLength", "ColumnDataType")


def listed_rules(rules: DataFrame) -> list[Row]:
    """The rule table in order. It is a program: as long as the schema it was written for, whatever the data."""
    return rules.orderBy("rule_no").collect()


def evaluate(table: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per rule: `measured`, `failing_rows` where rows are judged, and `passed`.

    All row rules, counts and completeness come from a single aggregate over the table; distinct
    counts, if a rule needs them, from one more pass. The rule table itself is a few rows per
    column and is read on the driver to build that aggregate.
    """
    listed = listed_rules(rules)
    distinct = distinct_counts(
        table, [r["column"] for r in listed if r["rule_type"] in _DISTINCT_RULES]
    ) if any(r["rule_type"] in _DISTINCT_RULES for r in listed) else {}

    measures, structs = [F.count(F.lit(1)).alias("rows")], []
    names = {r["column"] for r in listed if r["column"] is not None}
    present = {}
    for i, name in enumerate(sorted(names)):
        measures.append(F.count(column(name)).alias(f"n{i}"))
        present[name] = F.col(f"n{i}")
    rows = F.col("rows")
    for r in listed:
        kind, name, bad = r["rule_type"], r["column"], F.lit(None).cast("bigint")
        unique = F.lit(distinct.get(name)).cast("bigint")
        if by_row(r):
            key = f"bad{r['rule_no']}"
            measures.append(F.count_if(failing(r, table.schema)).alias(key))
            bad = F.col(key)
            measured, passed = bad.cast("double"), bad == 0
        elif kind == "RowCount":
            measured, passed = rows, rows.between(int(r["low"]), int(r["high"]))
        elif kind == "ColumnCount":
            measured = F.lit(len(table.columns))
            passed = measured == int(r["low"])
        elif kind == "Completeness":
            measured = F.coalesce(F.try_divide(present[name], rows), F.lit(1.0))
            passed = measured >= float(r["low"])
        elif kind == "DistinctValuesCount":
            measured, passed = unique, unique.between(int(r["low"]), int(r["high"]))
        elif kind == "Uniqueness":
            measured = F.try_divide(unique, present[name])
            passed = F.coalesce(measured >= float(r["low"]), F.lit(True))
        else:  # IsUnique, IsPrimaryKey
            measured = F.try_divide(unique, present[name])
            passed = unique == present[name]
            if kind == "IsPrimaryKey":
                passed = passed & (present[name] == rows)
        structs.append(
            F.struct(
                F.lit(r["rule_no"]).alias("rule_no"), F.lit(kind).alias("rule_type"),
                F.lit(name).cast("string").alias("column"), F.lit(r["rule_text"]).alias("rule_text"),
                measured.cast("double").alias("measured"), bad.alias("failing_rows"),
                passed.alias("passed"),
            )
        )
    return table.agg(*measures).select(F.inline(F.array(*structs)))


def failing_rows(table: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows breaking at least one row rule, with the broken rules' numbers."""
    listed = [r for r in listed_rules(rules) if by_row(r)]
    broken = F.array_compact(
        F.array(*[F.when(failing(r, table.schema), F.lit(r["rule_no"])) for r in listed])
    ) if listed else F.array().cast("array<int>")
    return table.withColumn("broken_rules", broken).filter(F.size("broken_rules") > 0)

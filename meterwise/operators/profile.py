"""Column profiles of any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.settings import QualityShape

# Type names as the profile reports them.
_TYPE_NAMES = {
    "boolean": "bool", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64",
    "float": "float", "double": "double", "string": "string", "date": "date32[day]",
    "timestamp": "timestamp[us]", "timestamp_ntz": "timestamp[us]", "binary": "binary",
}
# Strings longer than this are told apart by their SHA-256 digest, to keep the shuffle narrow.
_INLINE_BYTES = 64


def column_kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(data_type, T.StringType):
        return "string"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return "other"


def type_name(data_type: T.DataType) -> str:
    if isinstance(data_type, T.DecimalType):
        return f"decimal128({data_type.precision}, {data_type.scale})"
    return _TYPE_NAMES.get(data_type.simpleString(), data_type.simpleString())


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def countable(data_type: T.DataType) -> bool:
    """Whether values of a type can be told apart: anything but nested types."""
    return not isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.NullType))


def _value_key(field: T.StructField) -> Column:
    value = column(field.name)
    if isinstance(field.dataType, T.BinaryType):
        return F.sha2(value, 256)
    if isinstance(field.dataType, T.StringType):
        return F.when(
            F.octet_length(value) > _INLINE_BYTES, F.concat(F.lit("#"), F.sha2(value, 256))
        ).otherwise(F.concat(F.lit("="), value))
    return value.cast("string")


def distinct_counts(table: DataFrame, names: list[str] | None = None) -> dict[str, int]:
    """Exact distinct counts, nulls left out, of all wanted columns in one pass.

    Every value becomes a (column, value) row; duplicates are removed before the shuffle and again
    after it, so a value holding most of a column costs nothing extra.
    """
    fields = [
        (i, f) for i, f in enumerate(table.schema.fields)
        if countable(f.dataType) and (names is None or f.name in names)
    ]
    if not fields:
        return {}
    pairs = F.array(
        *[F.struct(F.lit(i).alias("column_no"), _value_key(f).alias("value")) for i, f in fields]
    )
    counts = (
        table.select(F.inline(pairs))
        .filter("value IS NOT NULL")
        .distinct()
        .groupBy("column_no")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    found = {row["column_no"]: row["n"] for row in counts}
    return {f.name: found.get(i, 0) for i, f in fields}


def value_counts(table: DataFrame, names: list[str]) -> DataFrame:
    """(column_no, value, count) of the named columns; meant for those with few distinct values."""
    fields = [(i, f) for i, f in enumerate(table.schema.fields) if f.name in names]
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("column_no"), column(f.name).cast("string").alias("value"))
            for i, f in fields
        ]
    )
    return (
        table.select(F.inline(pairs))
        .filter("value IS NOT NULL")
        .groupBy("column_no", "value")
        .agg(F.count("*").alias("count"))
    )


def profile(
    table: DataFrame,
    shape: QualityShape = QualityShape(),
    sampled: bool = False,
    total_row_count: int | None = None,
) -> DataFrame:
    """One row per column, in column order.

    Three passes, each reading only what it needs: distinct counts, plain statistics, and value
    counts of the columns whose distinct count turned out small.
    """
    fields = table.schema.fields
    distinct = distinct_counts(table)
    limit = max(shape.value_set_size, shape.shown_values)
    listed = [
        f.name for f in fields
        if column_kind(f.dataType) in ("string", "integer", "boolean") and 0 < distinct.get(f.name, 0) <= limit
    ]
    measures, structs = [F.count(F.lit(1)).alias("rows")], []
    for i, f in enumerate(fields):
        value, kind = column(f.name), column_kind(f.dataType)
        measures.append(F.count(value).alias(f"n{i}"))
        none = F.lit(None)
        low = high = mean = spread = none.cast("double")
        short = long = none.cast("int")
        if kind in ("integer", "float"):
            measures += [
                F.min(value).cast("double").alias(f"lo{i}"), F.max(value).cast("double").alias(f"hi{i}"),
                F.avg(value).cast("double").alias(f"m{i}"),
                F.stddev_pop(value.cast("double")).alias(f"s{i}"),
            ]
            low, high, mean, spread = (F.col(f"{p}{i}") for p in ("lo", "hi", "m", "s"))
        if kind == "string":
            size = F.octet_length(value)
            measures += [F.min(size).alias(f"lo{i}"), F.max(size).alias(f"hi{i}")]
            short, long = F.col(f"lo{i}"), F.col(f"hi{i}")
        structs.append(
            F.struct(
                F.lit(i).alias("column_no"), F.lit(f.name).alias("name"), F.lit(kind).alias("kind"),
                F.lit(type_name(f.dataType)).alias("source_type"),
                F.col("rows").alias("row_count"), (F.col("rows") - F.col(f"n{i}")).alias("null_count"),
                F.lit(distinct.get(f.name)).cast("bigint").alias("distinct_count"),
                low.alias("minimum"), high.alias("maximum"), mean.alias("mean"), spread.alias("stddev"),
                short.alias("min_length"), long.alias("max_length"),
            )
        )
    stats = table.agg(*measures).select(F.inline(F.array(*structs)))
    if listed:
        counts = value_counts(table, listed)
    else:
        counts = table.sparkSession.createDataFrame([], "column_no int, value string, count bigint")
    ordered = F.array_sort(
        F.collect_list(F.struct((-F.col("count")).alias("rank"), F.col("value"), F.col("count")))
    )
    top = counts.groupBy("column_no").agg(
        F.transform(ordered, lambda v: F.struct(v["value"].alias("value"), v["count"].alias("count"))).alias("top_values")
    )
    known = F.lit(total_row_count).cast("bigint") if sampled else F.col("row_count")
    return stats.join(top, "column_no", "left").select(
        *stats.columns,
        F.coalesce("top_values", F.array().cast("array<struct<value:string,count:bigint>>")).alias("top_values"),
        F.lit(sampled).alias("sampled"),
        known.alias("total_row_count"),
    )


def with_ratios(profiled: DataFrame) -> DataFrame:
    """Completeness, null rate, uniqueness and the flags derived from them."""
    present = F.col("row_count") - F.col("null_count")
    completeness = F.when(F.col("row_count") == 0, 1.0).otherwise(F.try_divide(present, F.col("row_count")))
    return profiled.select(
        "*",
        present.alias("non_null_count"),
        completeness.alias("completeness"),
        F.round(1 - completeness, 6).alias("null_rate"),
        F.try_divide("distinct_count", present).alias("uniqueness"),
        (F.col("null_count") == 0).alias("is_complete"),
        F.coalesce((present > 0) & (F.col("distinct_count") == present), F.lit(False)).alias("is_distinct"),
    )


def dataset_summary(profiled: DataFrame) -> DataFrame:
    return profiled.groupBy("row_count", "sampled", "total_row_count").agg(
        F.count("*").alias("column_count")
    ).withColumn("row_count_is_known", F.col("total_row_count").isNotNull())

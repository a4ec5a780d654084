"""Data quality rules derived from a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.functions.text import (
    fixed, lower_bound, plain_number, quoted, short_number, thousands, upper_bound,
)
from meterwise.operators.profile import with_ratios
from meterwise.settings import DATA_TYPE_RULES, TOLERANCES, QualityShape, Tolerance

COLUMNS = ("rule_no", "rule_type", "column", "op", "low", "high", "values", "evidence", "rule_text")
# Rule numbers: the column's place times this, plus the rule's place within the column.
_STRIDE = 16


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _rule(
    rule_type: str, op: str, evidence: Column, *, column: Column | None = None,
    low: Column | None = None, high: Column | None = None, values: Column | None = None,
) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(rule_type).alias("rule_type"),
        (none if column is None else column).alias("column"),
        F.lit(op).alias("op"),
        (none if low is None else low.cast("string")).alias("low"),
        (none if high is None else high.cast("string")).alias("high"),
        (F.lit(None).cast("array<string>") if values is None else values).alias("values"),
        evidence.alias("evidence"),
    )


def _condition() -> Column:
    low, high = F.col("low"), F.col("high")
    listed = F.array_join(F.transform("values", quoted), ", ")
    return (
        F.when(F.col("op") == "between", _text(" between ", low, " and ", high))
        .when(F.col("op") == "in", _text(" in [", listed, "]"))
        .when(F.col("op") == "=", _text(" = ", F.when(F.col("rule_type") == "ColumnDataType", quoted(low)).otherwise(low)))
        .when(F.col("op") == ">=", _text(" >= ", low))
        .otherwise("")
    )


def _percent_text(fraction: float) -> str:
    return f"{fraction * 100:g}%"


def _hundredths(value: Column) -> Column:
    return F.floor(value * 100) / 100


def derive_rules(
    profiled: DataFrame, strictness: str = "balanced", shape: QualityShape = QualityShape()
) -> DataFrame:
    """The rule table: one row per rule, in document order by `rule_no`.

    A statistic that was not measured gives no rule. `profiled` has one row per column of the
    profiled table, so everything here is as small as a schema.
    """
    t = TOLERANCES[strictness]
    rows = with_ratios(profiled)
    table_rules = (
        profiled.groupBy("row_count", "sampled", "total_row_count")
        .agg(F.count("*").alias("columns"))
        .select(F.posexplode(F.array(*_table_rules(t, strictness))).alias("pos", "rule"))
        .select(F.col("pos").alias("rule_no"), "rule")
    )
    column_rules = rows.select(
        "column_no", F.posexplode(F.array(*_column_rules(t, strictness, shape))).alias("pos", "rule")
    ).select(((F.col("column_no") + 1) * _STRIDE + F.col("pos")).alias("rule_no"), "rule")
    return (
        table_rules.unionByName(column_rules)
        .filter("rule IS NOT NULL")
        .select("rule_no", "rule.*")
        .withColumn(
            "rule_text",
            _text(
                F.col("rule_type"),
                F.when(F.col("column").isNull(), "").otherwise(_text(" ", quoted(F.col("column")))),
                _condition(),
            ),
        )
        .select(*COLUMNS)
    )


# --- Evidence: the facts behind each rule, which rule documents carry as comments -----------------


def _suffix() -> Column:
    rows, total = thousands(F.col("row_count")), thousands(F.col("total_row_count"))
    return (
        F.when(~F.col("sampled"), "")
        .when(F.col("total_row_count").isNull(), _text(" [sample: ", rows, " rows]"))
        .otherwise(_text(" [sample: ", rows, " rows out of ", total, "]"))
    )


def _table_rules(t: Tolerance, level: str) -> list[Column]:
    total = F.col("total_row_count")
    low = F.greatest(F.lit(0), F.floor(total * F.lit(1 - t.row_count_tolerance)))
    high = F.ceil(total * F.lit(1 + t.row_count_tolerance))
    counted = _text(
        "table size when profiled: ", thousands(total),
        f"; {level} tolerance of plus or minus {_percent_text(t.row_count_tolerance)}",
    )
    columns = F.col("columns").cast("string")
    return [
        F.when(total > 0, _rule("RowCount", "between", counted, low=low, high=high)),
        _rule("ColumnCount", "=", _text("width when profiled: ", columns), low=columns),
    ]


def _column_rules(t: Tolerance, level: str, shape: QualityShape) -> list[Column]:
    name, kind, suffix = F.col("name"), F.col("kind"), _suffix()
    rows, nulls, present = F.col("row_count"), F.col("null_count"), F.col("non_null_count")
    distinct, top = F.col("distinct_count"), F.col("top_values")
    tolerance = f"{level} tolerance"

    complete_at = _hundredths(F.col("completeness") - t.completeness_margin)
    completeness = F.when(
        rows > 0,
        F.when(
            F.col("is_complete"),
            _rule("IsComplete", "", _text("every one of ", thousands(rows), " rows has a value", suffix), column=name),
        ).when(
            complete_at > 0,
            _rule(
                "Completeness", ">=",
                _text(
                    "filled in ", thousands(present), " rows of ", thousands(rows), ", a share of ",
                    fixed(F.col("completeness"), 3), f"; {tolerance} lowers the bar by {t.completeness_margin}", suffix,
                ),
                column=name, low=plain_number(complete_at),
            ),
        ),
    )

    unique_at = _hundredths(F.col("uniqueness") - t.uniqueness_margin)
    near_key = (F.col("uniqueness") >= shape.minimum_uniqueness) & (unique_at > 0)
    key = F.when(
        kind.isin(*shape.key_kinds),
        F.when(
            F.col("is_distinct") & F.col("is_complete"),
            _rule(
                "IsPrimaryKey", "",
                _text("key candidate: each of ", thousands(rows), " rows has its own value", suffix),
                column=name,
            ),
        ).when(
            F.col("is_distinct"),
            _rule(
                "IsUnique", "",
                _text(
                    "no value occurs twice among ", thousands(present), "; empty in ", thousands(nulls),
                    " rows, which rules out a key", suffix,
                ),
                column=name,
            ),
        ).when(
            near_key,
            _rule(
                "Uniqueness", ">=",
                _text(
                    "few repeats: ", thousands(distinct), " different values in ", thousands(present), " filled rows, a share of ",
                    fixed(F.col("uniqueness"), 3), f"; {tolerance} lowers the bar by {t.uniqueness_margin}", suffix,
                ),
                column=name, low=plain_number(unique_at),
            ),
        ),
    )

    category = (
        (kind == "string") & (rows >= shape.minimum_rows_for_values)
        & (distinct <= shape.value_set_size) & (present > 0)
        & (F.try_divide(distinct, present) <= shape.maximum_distinct_ratio)
        & (F.size(top) == distinct)
    )
    shown = F.array_join(
        F.transform(
            F.slice(top, 1, shape.shown_values), lambda v: _text(v["value"], " x ", thousands(v["count"]))
        ),
        ", ",
    )
    more = F.when(
        F.size(top) > shape.shown_values,
        _text(", +", (F.size(top) - shape.shown_values).cast("string"), " others"),
    ).otherwise("")
    allowed = F.when(
        category,
        _rule(
            "ColumnValues", "in",
            _text(
                "closed list of ", distinct.cast("string"), ", counted over ", thousands(present), " filled rows: ",
                shown, more, suffix,
            ),
            column=name, values=F.array_sort(F.transform(top, lambda v: v["value"])),
        ),
    )
    distinct_range = F.when(
        category,
        _rule(
            "DistinctValuesCount", "between",
            _text(
                "the list had ", distinct.cast("string"), " members; more of them, or none at all, is a change", suffix,
            ),
            column=name, low=F.lit(1), high=distinct,
        ),
    )

    low, high = F.col("minimum"), F.col("maximum")
    span = high - low
    pad = F.when(span > 0, span).otherwise(F.abs(low)) * F.lit(t.numeric_padding)
    whole = kind == "integer"
    bottom = F.when(whole, F.floor(low - pad).cast("double")).otherwise(low - pad)
    ceiling = F.when(whole, F.ceil(high + pad).cast("double")).otherwise(high + pad)
    observed = F.when(
        span > 0, _text("seen from ", short_number(low), " up to ", short_number(high))
    ).otherwise(_text("only ", short_number(low), " was seen"))
    numeric = F.when(
        low.isNotNull() & high.isNotNull(),
        _rule(
            "ColumnValues", "between",
            _text(observed, f"; {tolerance} adds {_percent_text(t.numeric_padding)} on both ends", suffix),
            column=name, low=lower_bound(bottom), high=upper_bound(ceiling),
        ),
    )

    short, long = F.col("min_length"), F.col("max_length")
    length = F.when(
        short.isNotNull() & long.isNotNull(),
        _rule(
            "ColumnLength", "between",
            _text(
                "sizes seen: ", short.cast("string"), " - ", long.cast("string"),
                f" bytes; {tolerance} adds {t.length_padding} on both ends", suffix,
            ),
            column=name, low=F.greatest(F.lit(0), short - t.length_padding), high=long + t.length_padding,
        ),
    )

    type_names = F.create_map(*[F.lit(x) for pair in DATA_TYPE_RULES.items() for x in pair])
    typed = F.when(
        kind.isin(*DATA_TYPE_RULES),
        _rule("ColumnDataType", "=", _text("stored type: ", F.col("source_type"), suffix), column=name, low=type_names[kind]),
    )
    return [completeness, key, allowed, distinct_range, numeric, length, typed]

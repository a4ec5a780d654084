"""Profiles, rules and rule documents on tables whose answers are known."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from meterwise.functions.text import lower_bound, plain_number, quoted, short_number, upper_bound
from meterwise.operators import evaluate as ev, profile as pf, rules as rl, ruletext
from meterwise.plans.quality import quality_report
from meterwise.sinks.reports import write_rule_document
from meterwise.sources import tables as tb


@pytest.fixture(scope="module")
def orders_file(tmp_path_factory):
    lines = ["order_id,status,region,amount,customer_note"]
    for i in range(500):
        amount = "" if i % 100 == 0 else f"{i * 7 % 900 + 5}.50"
        status = ("NEW", "PAID", "SHIPPED", "VOID")[i % 4]
        region = ("ap-south-1", "eu-west-1", "us-east-1")[i % 3]
        lines.append(f"{100000 + i},{status},{region},{amount},note-{'x' * (i % 12)}")
    path = tmp_path_factory.mktemp("csv") / "orders.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def texts(rules):
    return [r.rule_text for r in rules.orderBy("rule_no").collect()]


def test_rules_of_orders(spark, orders_file):
    loaded = tb.read_table(spark, orders_file)
    report = quality_report(loaded)
    assert texts(report["rules"]) == [
        "RowCount between 400 and 600", "ColumnCount = 5",
        'IsComplete "order_id"', 'IsPrimaryKey "order_id"', 'ColumnValues "order_id" between 99975 and 100524', 'ColumnDataType "order_id" = "Long"',
        'IsComplete "status"', 'ColumnValues "status" in ["NEW", "PAID", "SHIPPED", "VOID"]', 'DistinctValuesCount "status" between 1 and 4', 'ColumnLength "status" between 2 and 8',
        'IsComplete "region"', 'ColumnValues "region" in ["ap-south-1", "eu-west-1", "us-east-1"]', 'DistinctValuesCount "region" between 1 and 3', 'ColumnLength "region" between 8 and 11',
        'Completeness "amount" >= 0.98', 'ColumnValues "amount" between -37.35 and 949.35', 'ColumnDataType "amount" = "Double"',
        'IsComplete "customer_note"', 'ColumnValues "customer_note" in [' + ", ".join(f'"note-{"x" * n}"' for n in range(12)) + "]",
        'DistinctValuesCount "customer_note" between 1 and 12', 'ColumnLength "customer_note" between 4 and 17',
    ]
    assert report["checks"].filter("NOT passed").count() == 0


def test_document_layout(spark, orders_file, tmp_path):
    rules = quality_report(tb.read_table(spark, orders_file))["rules"]
    text = ruletext.document(rules, "one\n\ntwo").first().document
    assert text.startswith("# one\n#\n# two\n\nRules = [\n    # table size when profiled: 500; balanced tolerance of plus or minus 20%\n")
    assert (
        "    # closed list of 4, counted over 500 filled rows: NEW x 125, PAID x 125, SHIPPED x 125,\n    # VOID x 125\n"
        '    ColumnValues "status" in ["NEW", "PAID", "SHIPPED", "VOID"],\n\n'
    ) in text
    assert text.endswith('\n    ColumnLength "customer_note" between 4 and 17\n]\n')
    write_rule_document(rules, str(tmp_path / "doc"), "h")
    assert "\n".join(r.value for r in spark.read.text(str(tmp_path / "doc")).collect()).startswith("# h\n\nRules = [")


def test_sample_of_text_hides_the_row_count(spark, orders_file):
    loaded = tb.read_table(spark, orders_file, 120)
    assert (loaded.sampled, loaded.total_row_count) == (True, None)
    rules = rl.derive_rules(pf.profile(loaded.table, sampled=True))
    assert texts(rules)[:3] == ["ColumnCount = 5", 'IsComplete "order_id"', 'IsPrimaryKey "order_id"']
    assert rules.filter("rule_type = 'ColumnCount'").first().evidence == "width when profiled: 5"
    assert rules.filter("rule_type = 'IsPrimaryKey'").first().evidence.endswith("rows has its own value [sample: 120 rows]")
    assert tb.read_table(spark, orders_file, 501).sampled is False
    assert tb.read_table(spark, orders_file, 500).sampled is True
    with pytest.raises(ValueError):
        tb.read_table(spark, orders_file, 0)


def test_parquet_sample_knows_the_total(spark, orders_file, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(300).coalesce(1).write.parquet(path)
    loaded = tb.read_table(spark, path, 60)
    assert (loaded.sampled, loaded.total_row_count, loaded.table.count()) == (True, 300, 60)
    assert tb.read_table(spark, path, 300).sampled is False


def test_sensors(spark):
    i = F.col("id")
    table = spark.range(300).select(
        F.format_string("S%03d", i % 8).alias("sensor_id"), (20 + (i % 50) * 0.5).alias("reading_c"),
        F.when(i % 30 != 0, i % 100).alias("battery_pct"), (i % 2 == 0).alias("calibrated"), F.lit("4.2.1").alias("firmware"),
    )
    rules = texts(rl.derive_rules(pf.profile(table)))
    assert 'ColumnValues "reading_c" between 18.775 and 45.725' in rules
    assert 'Completeness "battery_pct" >= 0.95' in rules and 'ColumnValues "battery_pct" between -5 and 104' in rules
    assert 'ColumnDataType "calibrated" = "Boolean"' in rules and not any("calibrated" in r and "ColumnValues" in r for r in rules)
    assert 'ColumnValues "firmware" in ["4.2.1"]' in rules


def test_empty_and_all_null_tables(spark):
    table = spark.createDataFrame([], "a bigint, b string")
    assert texts(rl.derive_rules(pf.profile(table))) == ["ColumnCount = 2", 'ColumnDataType "a" = "Long"']
    nulls = spark.range(60).select(F.lit(None).cast("string").alias("a"), F.lit(None).cast("double").alias("b"))
    assert texts(rl.derive_rules(pf.profile(nulls))) == ["RowCount between 48 and 72", "ColumnCount = 2", 'ColumnDataType "b" = "Double"']


def test_long_texts_are_told_apart(spark):
    table = spark.range(500).select(F.concat(F.repeat(F.lit("é"), 500), (F.col("id") % 77).cast("string")).alias("t"))
    row = pf.profile(table).first()
    assert (row.distinct_count, row.min_length, row.max_length) == (77, 1001, 1002)


def test_names_and_values_that_need_quoting(spark):
    table = spark.range(100).select(F.when(F.col("id") % 2 == 0, 'say "hi"').otherwise("back\\slash").alias("a.b `c`"))
    rules = rl.derive_rules(pf.profile(table)).cache()
    assert 'ColumnValues "a.b `c`" in ["back\\\\slash", "say \\"hi\\""]' in texts(rules)
    assert ev.evaluate(table, rules).filter("NOT passed").count() == 0
    assert ev.failing_rows(table.limit(1).select(F.lit("new").alias("a.b `c`")), rules).count() == 1


def test_numbers_as_text(spark):
    values = [0.0, 1e-07, 12.3456784, -12.3456784, 1234567.0, 100.0, 1e22, 0.1 + 0.2, -0.0000001, 1234567.891]
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v double").select(
        "n", plain_number(F.col("v")), lower_bound(F.col("v")), upper_bound(F.col("v")), short_number(F.col("v"))
    ).orderBy("n").collect()
    assert [tuple(r)[1:] for r in rows] == [
        ("0", "0", "0", "0"), ("0", "0", "0.000001", "1e-07"), ("12.345678", "12.345678", "12.345679", "12.3457"),
        ("-12.345678", "-12.345679", "-12.345678", "-12.3457"), ("1234567", "1234567", "1234567", "1234567"),
        ("100", "100", "100", "100"), ("1" + "0" * 22,) * 4, ("0.3", "0.3", "0.3", "0.3"), ("0", "-0.000001", "0", "-1e-07"),
        ("1234567.891", "1234567.891", "1234567.891", "1.23457e+06"),
    ]
    assert spark.range(1).select(quoted(F.lit('a"\\'))).first()[0] == '"a\\"\\\\"'


def test_distinct_counts_of_random_columns(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1.5, 2.5, rng.random()]), rng.choice(["", "a", None]), rng.choice([b"x", None])) for _ in range(400)]
    counts = pf.distinct_counts(spark.createDataFrame(rows, "a double, b string, c binary"))
    assert counts == {n: len({r[i] for r in rows} - {None}) for i, n in enumerate("abc")}

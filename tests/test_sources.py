"""Offer documents and the first rows of folders of files."""

from __future__ import annotations

import json
from decimal import Decimal

import pyarrow as pa
import pytest
from pyarrow import csv, parquet as pq

from meterwise.sources import prices, tables


def offer(products, terms):
    return json.dumps({"products": products, "terms": {"OnDemand": terms}})


def product(family="ML Instance", **attributes):
    return {"productFamily": family, "attributes": attributes}


def rate(usd, unit="Hrs"):
    return {"unit": unit, "pricePerUnit": {"USD": usd}}


def test_the_first_term_and_dimension_by_code_set_the_price(spark):
    products = {
        "A": product(component="Hosting", instanceName="ml.m5.large-Hosting"), "B": product(component="Hosting", instanceType="ml.g5.xlarge-Hosting", instanceName=""),
        "C": product(component="Training", instanceName="ml.m5.large"), "D": product(component="Hosting", instanceName="ml.c5.large"), "E": product(component="Hosting", instanceName="ml.c6.large"),
    }
    terms = {
        "A": {"T2": {"priceDimensions": {"D1": rate("9")}}, "T1": {"priceDimensions": {"D2": rate("8"), "D1": rate("0.1234567")}}},
        "B": {"T": {"priceDimensions": {"D": rate("1.5")}}}, "C": {"T": {"priceDimensions": {"D": rate("7")}}}, "D": {"T": {"priceDimensions": {"D": rate("0")}}}, "Z": {},
    }
    docs = spark.createDataFrame([("r1", offer(products, terms)), ("r2", "not json"), ("r3", "{}")], "region string, document string")
    assert sorted(tuple(r) for r in prices.hosting_prices(docs).collect()) == [("r1", "ml.g5.xlarge", Decimal("1.5")), ("r1", "ml.m5.large", Decimal("0.123457"))]


def test_token_and_serverless_rates(spark):
    products = {
        "A": product(usagetype="USE1-X_InputTokenCount-Units", servicename=" Model X "), "B": product(usagetype="USE1-X_OutputTokenCount_Global-Units", servicename="Model X"),
        "C": product(usagetype="USE1-X_InputTokenCountBatch-Units", servicename="Model X"), "D": product("ML Serverless", usagetype="USE1-ServerlessInf:Mem-4GB"),
        "E": product(usagetype="USE1-X_InputTokenCount-Units", servicename=" "),
    }
    each = lambda *rates: {"T": {"priceDimensions": {f"D{k}": r for k, r in enumerate(rates)}}}
    terms = {
        "A": each(rate("3", "1M tokens"), rate("4", "1M tokens"), rate("99", "Hrs")), "B": each(rate("15.5", "1M tokens")), "C": each(rate("1", "1M tokens")),
        "D": each(rate("0.00008", "Second")), "E": each(rate("1", "1M tokens")),
    }
    docs = spark.createDataFrame([("r", offer(products, terms))], "region string, document string")
    assert sorted(tuple(r) for r in prices.token_prices(docs).collect()) == [("r", "Model X", "input", Decimal("4")), ("r", "Model X", "output_global", Decimal("15.5"))]
    assert [tuple(r) for r in prices.serverless_prices(docs).collect()] == [("r", 4, Decimal("0.00008"))]


def test_a_document_is_parsed_once_and_not_shuffled_to_its_terms(spark):
    plan = prices.token_prices(spark.createDataFrame([], "region string, document string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "Join" not in plan


@pytest.mark.parametrize("form", ["parquet", "csv"])
@pytest.mark.parametrize("rows", [1, 3, 4, 12, 13, 40, 1000])
def test_first_rows_follow_the_names_of_the_files(spark, tmp_path, form, rows):
    sizes = {"a": 3, "b": 0, "c": 1, "d": 30, "e": 9}
    folder, k, want = tmp_path / f"t.{form}", 0, []
    folder.mkdir()
    for name, size in sizes.items():
        part = pa.table({"k": pa.array(range(k, k + size), pa.int64()), "v": pa.array([f"v{i}" for i in range(k, k + size)], pa.string())})
        (pq.write_table if form == "parquet" else csv.write_csv)(part, folder / f"{name}.{form}")
        want += range(k, k + size)
        k += size
    loaded = tables.read_table(spark, str(folder), sample=rows)
    assert sorted(r.k for r in loaded.table.collect()) == want[:rows] and loaded.table.columns == ["k", "v"]
    assert loaded.sampled == (rows < 43) and loaded.total_row_count == (43 if form == "parquet" else None)

"""Prompt and response of requests asked for by id. Kept apart: no report uses this module."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.functions.json import kind, leaf
from meterwise.functions.text import strip
from meterwise.settings import SCHEMA_TYPE


def fetch(records: DataFrame, request_ids: DataFrame) -> DataFrame:
    """Bodies of the first record of each wanted `request_id`, in order of path and position."""
    wanted = (
        request_ids.select(strip(F.col("request_id")).alias("request_id"))
        .filter("request_id <> ''")
        .distinct()
    )
    raw = F.col("raw")
    typed = (kind(leaf(raw, "$.schemaType")) == "STRING") & (
        F.try_variant_get(raw, "$.schemaType", "string") == SCHEMA_TYPE
    )
    # The ids are looked up first; bodies are rendered for the records found, not for the whole log.
    rows = records.filter(typed).select(
        F.try_variant_get(raw, "$.requestId", "string").alias("request_id"),
        "path", "position", "source", "raw",
    )
    found = rows.join(wanted, "request_id", "left_semi").select(
        "request_id", "path", "position", "source",
        F.coalesce(F.try_variant_get(raw, "$.modelId", "string"), F.lit("")).alias("model_id"),
        F.to_json(leaf(raw, "$.input.inputBodyJson")).alias("input_body"),
        F.to_json(leaf(raw, "$.output.outputBodyJson")).alias("output_body"),
    )
    body = F.struct("source", "model_id", "input_body", "output_body")
    return (
        found.groupBy("request_id")
        .agg(F.min_by(body, F.struct("path", "position")).alias("b"))
        .select("request_id", "b.*")
    )

"""Raw log records to metadata rows, and the rows that cannot be used."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.functions.json import as_string, count, is_null, is_object, leaf, number, string, taken, text
from meterwise.functions.text import strip
from meterwise.functions.time import epoch_timestamp, iso_timestamp
from meterwise.operators.small import once
from meterwise.settings import CONTENT_FIELDS, METRICS_KEY, NO_IDENTITY, REDACTED, SCHEMA_MAJOR, SCHEMA_TYPE

COLUMNS = (
    "ts", "request_id", "model_id", "operation", "region", "account_id", "identity_arn",
    "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens",
    "invocation_latency_ms", "first_byte_latency_ms", "error_code", "source",
)


# The leaves that are read, as the objects that hold them; strings as bytes, what may be of any kind as it is.
_RECORD = f"""struct<schemaType: binary, schemaVersion: variant, timestamp: variant, requestId: binary, modelId: binary, operation: binary,
    region: binary, accountId: binary, errorCode: binary, identity: struct<arn: binary>,
    input: struct<inputTokenCount: variant, cacheReadInputTokenCount: variant, cacheWriteInputTokenCount: variant>,
    output: struct<outputTokenCount: variant, outputBodyJson: struct<`{METRICS_KEY}`: struct<invocationLatency: variant, firstByteLatency: variant>>>>"""


_TEXTS = {
    "request_id": "requestId", "model_id": "modelId", "operation": "operation", "region": "region", "account_id": "accountId",
    "identity_arn": "identity.arn",
}


def _version(value: Column) -> Column:
    """The schema version as text; anything empty or zero reads as not given."""
    own = F.to_json(value)
    return F.coalesce(
        string(value),
        F.when(is_null(value) | own.isin("false", "{}", "[]") | (number(value) == 0), ""),
        # a number as a string, as it stands otherwise
        F.when(own.isNotNull(), F.coalesce(as_string(value), own)),
        F.lit(""),
    )


def parse(records: DataFrame) -> DataFrame:
    """Each record's metadata columns plus `issue_kind`, null for a usable record.

    Only counts and identifiers are ever selected from `raw`; the body fields are not, so no later
    table can hold them. An issue already found while reading is kept. The record is taken apart in one
    read, and every field is evaluated once; a filter on it does not repeat the parsing.
    """
    top = records.select("source", "detail", F.col("issue_kind").alias("read_issue"), taken(F.col("raw"), _RECORD).alias("r"))
    metrics = f"r.output.outputBodyJson.`{METRICS_KEY}`"
    counts = {
        "input_tokens": "r.input.inputTokenCount",
        "output_tokens": "r.output.outputTokenCount",
        "cache_read_tokens": "r.input.cacheReadInputTokenCount",
        "cache_write_tokens": "r.input.cacheWriteInputTokenCount",
        "invocation_latency_ms": f"{metrics}.invocationLatency",
        "first_byte_latency_ms": f"{metrics}.firstByteLatency",
    }
    # what the next step uses more than once
    leaves = top.select(
        "*",
        strip(string(F.col("r.timestamp"))).alias("stamp_text"),
        number(F.col("r.timestamp")).alias("stamp_number"),
        text(F.col("r.errorCode")).alias("error"),
        *[F.to_json(F.col(path)).alias(f"{name}_json") for name, path in counts.items()],
    )
    parsed = once(
        leaves,
        F.col("read_issue"),
        F.col("detail"),
        F.col("r").isNotNull().alias("is_record"),
        F.col("r.schemaType").cast("string").alias("schema_type"),
        _version(F.col("r.schemaVersion")).alias("version"),
        is_null(F.col("r.timestamp")).alias("no_timestamp"),
        F.coalesce(iso_timestamp(F.col("stamp_text")), epoch_timestamp(F.col("stamp_number"))).alias("ts"),
        *[text(F.col(f"r.{path}")).alias(name) for name, path in _TEXTS.items()],
        *[count(F.col(f"{name}_json")).alias(name) for name in counts],
        F.when(F.col("error") != "", F.col("error")).alias("error_code"),
        F.col("source"),
    )
    major = F.substring_index("version", ".", 1)
    issue = F.coalesce(
        F.col("read_issue"),
        F.when(~F.col("is_record"), "not_a_record"),
        F.when(
            ~F.coalesce(F.col("schema_type") == SCHEMA_TYPE, F.lit(False)),
            "wrong_schema_type",
        ),
        F.when((F.col("version") != "") & (major != SCHEMA_MAJOR), "unsupported_schema_version"),
        F.when(F.col("no_timestamp"), "missing_timestamp"),
        F.when(F.col("ts").isNull(), "bad_timestamp"),
        F.when(F.col("model_id") == "", "missing_model_id"),
        F.when(
            F.col("input_tokens").isNull() & F.col("output_tokens").isNull() & F.col("error_code").isNull(),
            "missing_token_counts",
        ),
    )
    return parsed.select(*COLUMNS, issue.alias("issue_kind"), F.coalesce("detail", F.lit("")).alias("detail"))


def usable(parsed: DataFrame) -> DataFrame:
    return parsed.filter("issue_kind IS NULL").select(*COLUMNS)


def issues(parsed: DataFrame) -> DataFrame:
    return parsed.filter("issue_kind IS NOT NULL").select(
        F.col("issue_kind").alias("kind"), "source", "detail"
    )


def issue_counts(parsed: DataFrame) -> DataFrame:
    """Skipped records by reason."""
    return issues(parsed).groupBy("kind").agg(F.count("*").alias("records"))


def usable_share(parsed: DataFrame) -> DataFrame:
    """Records used as a share of everything seen; null when nothing was seen."""
    good = F.count_if(F.col("issue_kind").isNull())
    return parsed.agg(
        good.alias("records"),
        F.count("*").alias("total_seen"),
        F.try_divide(good, F.count("*")).alias("usable_fraction"),
    )


def with_derived(inv: DataFrame) -> DataFrame:
    """Hour, day, and token figures that treat a missing count as nothing to add."""

    def known(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    return inv.select(
        "*",
        F.date_trunc("hour", "ts").alias("hour"),
        F.to_date("ts").alias("day"),
        (
            known("input_tokens") + known("output_tokens")
            + known("cache_read_tokens") + known("cache_write_tokens")
        ).alias("total_tokens"),
        (F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()).alias("has_token_counts"),
        known("input_tokens").alias("billable_input"),
    )


def identity_label(name: str = "identity_arn") -> Column:
    """The caller, or a fixed label when the log names none."""
    value = F.coalesce(F.col(name), F.lit(""))
    return F.when(value == "", NO_IDENTITY).otherwise(value)


def _hide(value: object) -> object:
    if not isinstance(value, dict):
        return value
    return {k: REDACTED if k in CONTENT_FIELDS else _hide(v) for k, v in value.items()}


def redact(records: DataFrame) -> DataFrame:
    """Records with the body fields masked at any object depth, as `redacted` JSON text.

    Bodies stand at the top of a record or in its input and output. There their text is cut out of the record's own
    by plain expressions, for which a variant and the record it belongs to have the same text. A record whose text
    names a body field anywhere else, in a deeper object, an array or another body, is masked by a walk in Python;
    only such records are handed to it.
    """
    places = [(name, f'$.{section}["{name}"]' if section else f'$["{name}"]') for name in CONTENT_FIELDS for section in ("", "input", "output")]
    rows = records.filter(is_object(F.col("raw"))).select(
        "source", F.to_json("raw").alias("json"),
        F.array(*[F.struct(F.lit(f'"{name}":').alias("key"), F.to_json(leaf(F.col("raw"), path)).alias("body")) for name, path in places]).alias("found"),
    )
    # the longest first: one number can begin like another
    found = F.transform(F.filter("found", lambda f: f["body"].isNotNull()), lambda f: F.struct((-F.length(f["body"])).alias("n"), f["key"].alias("key"), f["body"].alias("body")))
    rows = rows.withColumn("found", F.array_sort(found))
    named = F.regexp_count("json", F.lit('"(' + "|".join(CONTENT_FIELDS) + ')":'))
    masked = F.aggregate(
        "found", F.col("json"), lambda text, f: F.replace(text, F.concat(f["key"], f["body"]), F.concat(f["key"], F.lit(f'"{REDACTED}"')))
    )
    usual = named == F.size("found")
    told = once(rows, F.col("source"), F.when(usual, masked).alias("masked"), F.when(~usual, F.col("json")).alias("unusual"))

    @F.pandas_udf("string")
    def walked(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda text: json.dumps(_hide(json.loads(text)), ensure_ascii=False, separators=(",", ":")), na_action="ignore"
        )

    return told.select("source", F.coalesce("masked", walked("unusual")).alias("redacted"))

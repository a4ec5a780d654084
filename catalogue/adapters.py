"""Projections of the driver tables into the domain tables, as SQL both engines run.

Each function takes the dialect, `spark` or `duck`; the few words that differ are below.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meterwise.session import configure, shared_folder

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def load(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    configure(spark)
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def adapted(spark: SparkSession, sf_dir: str, sql: Callable[[str], str], *names: str) -> DataFrame:
    """Run an adapter's SQL over the named driver tables."""
    tables = load(spark, sf_dir, *names)
    return spark.sql(sql("spark").format(**{n: "{" + n + "}" for n in names}), **tables)


def duck(sql: Callable[[str], str]) -> str:
    """An adapter's SQL for the views the driver registers under the tables' own names."""
    return sql("duck").format(**{n: n for n in TABLES})


def scratch(spark: SparkSession) -> str:
    """A new folder in the place that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/written-{uuid.uuid4().hex}"


# --- words that differ between the dialects -------------------------------------------------------


def from_epoch(dialect: str, seconds: str) -> str:
    if dialect == "spark":
        return f"timestamp_seconds({seconds})"
    return f"make_timestamp(CAST({seconds} AS BIGINT) * 1000000)"


def days_since(dialect: str, start: str, column: str) -> str:
    if dialect == "spark":
        return f"datediff(CAST({column} AS DATE), DATE '{start}')"
    return f"date_diff('day', DATE '{start}', CAST({column} AS DATE))"


def utc(year: int, month: int, day: int) -> dt.datetime:
    return dt.datetime(year, month, day, tzinfo=dt.timezone.utc)


# --- model invocations ----------------------------------------------------------------------------


def invocations(dialect: str) -> str:
    k = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
    return f"""
    SELECT CAST(ts AS TIMESTAMP) AS ts,
      'r' || lpad(CAST(event_id AS STRING), 10, '0') AS request_id,
      CASE event_type
        WHEN 'click' THEN 'anthropic.claude-sonnet-4-20250514-v1:0'
        WHEN 'view' THEN 'global.anthropic.claude-haiku-4-5-20251001-v1:0'
        WHEN 'purchase' THEN 'us.meta.llama3-1-70b-instruct-v1:0'
        WHEN 'signup' THEN 'cohere.command-r-plus-v1:0'
        ELSE 'stability.image-core-v2:0' END AS model_id,
      CASE WHEN event_id % 2 = 0 THEN 'Converse' ELSE 'InvokeModel' END AS operation,
      CASE user_id % 3 WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'eu-west-1' ELSE 'me-central-1' END AS region,
      '123456789012' AS account_id,
      CASE WHEN user_id % 25 = 0 THEN ''
        ELSE 'arn:aws:sts::123456789012:assumed-role/app/u' || CAST(user_id AS STRING) END AS identity_arn,
      CASE WHEN event_id % 97 <> 0 THEN CAST(floor(value * 10) AS BIGINT) END AS input_tokens,
      CASE WHEN event_id % 97 <> 0 THEN {k} END AS output_tokens,
      CASE WHEN event_id % 7 = 0 THEN {k} * 3 END AS cache_read_tokens,
      CASE WHEN event_id % 11 = 0 THEN {k} * 2 END AS cache_write_tokens,
      CASE WHEN event_id % 5 <> 0 THEN 100 + {k} * 17 END AS invocation_latency_ms,
      CASE WHEN event_id % 5 <> 0 THEN 10 + {k} END AS first_byte_latency_ms,
      CASE WHEN event_id % 97 = 0 THEN 'ThrottlingException' END AS error_code,
      'events#' || CAST(event_id AS STRING) AS source
    FROM {{events}}"""


def token_prices(dialect: str) -> str:
    rows = []
    for region, factor in (("us-east-1", 1), ("eu-west-1", 1.1)):
        for name, rates in (
            ("Claude Sonnet 4 (Amazon Bedrock Edition)", {"input": 3, "output": 15, "cache_read": 0.3, "cache_write": 3.75}),
            (
                "Claude Haiku 4.5 (Amazon Bedrock Edition)",
                {"input": 1.1, "output": 5.5, "cache_read": 0.11, "cache_write": 1.375,
                 "input_global": 1, "output_global": 5, "cache_read_global": 0.1},
            ),
            ("Meta Llama3.1 70B Instruct", {"input": 0.72, "output": 0.72}),
            ("Cohere Command R+ (Amazon Bedrock Edition)", {"input": 3, "output": 15, "cache_read": 0.5, "cache_write": 4}),
            ("Stable Image Core", {"input": 2, "output": 8}),
        ):
            for kind, rate in rates.items():
                rows.append(f"('{region}', '{name}', '{kind}', CAST({rate * factor:.6f} AS DECIMAL(12,6)))")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(region, service_name, rate_kind, usd_per_mtok)"


def overrides(dialect: str) -> str:
    return "SELECT * FROM (VALUES ('stability.image-core-v2:0', 'Stable Image Core')) AS t(model_id, service_name)"


# --- shards ---------------------------------------------------------------------------------------

SKEW_START = utc(2026, 1, 1)
SKEW_MINUTES = 250
SKEW_END = SKEW_START + dt.timedelta(minutes=SKEW_MINUTES)
_SKEW_EPOCH = int(SKEW_START.timestamp())


def _shard(key: str) -> str:
    # One shard takes about 60% in half of the streams; the others are even.
    return (
        f"CASE WHEN l_returnflag <> 'N' AND {key} % 10 < 6 THEN 'shard-0' "
        f"WHEN {key} % 8 = 7 AND l_linestatus = 'O' THEN 'shard-1' "
        f"ELSE 'shard-' || CAST({key} % 8 AS STRING) END"
    )


_WEIGHT = "CASE l_returnflag || l_linestatus WHEN 'AF' THEN 15 WHEN 'AO' THEN 250 WHEN 'NF' THEN 250 ELSE 20 END"


def _minute(dialect: str) -> str:
    return f"CAST(floor({days_since(dialect, '1995-01-01', 'l_shipdate')} / 10.0e0) AS INT)"


def datapoints(dialect: str) -> str:
    """One-minute sums per shard; ten days of the line items stand for a minute."""
    ts = from_epoch(dialect, f"{_SKEW_EPOCH} + 60 * minute")
    return f"""
    WITH sums AS (
      SELECT l_returnflag || l_linestatus AS stream, {_shard('l_suppkey')} AS shard_id,
        {_minute(dialect)} AS minute,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * {_WEIGHT}) AS DOUBLE) AS bytes,
        CAST(count(*) AS DOUBLE) AS records,
        CAST(sum(CASE WHEN l_discount > 0.09 AND l_returnflag || l_linestatus <> 'RF' THEN 1 ELSE 0 END) AS DOUBLE) AS throttled
      FROM {{lineitem}} GROUP BY 1, 2, 3)
    SELECT stream, shard_id, 'IncomingBytes' AS metric, {ts} AS ts, bytes AS value FROM sums
    UNION ALL SELECT stream, shard_id, 'IncomingRecords', {ts}, records FROM sums
    UNION ALL SELECT stream, shard_id, 'WriteProvisionedThroughputExceeded', {ts}, throttled FROM sums
    UNION ALL SELECT stream, shard_id, 'IteratorAgeMilliseconds', {ts}, 1000.0 * records FROM sums"""


def shards(dialect: str) -> str:
    """The shards seen in the line items, and per stream one that is closed, old, or silent."""
    ts = from_epoch(dialect, f"{_SKEW_EPOCH} + CASE WHEN stream = 'AF' THEN -600 ELSE 600 END")
    return f"""
    WITH seen AS (SELECT DISTINCT l_returnflag || l_linestatus AS stream, {_shard('l_suppkey')} AS shard_id FROM {{lineitem}})
    SELECT stream, shard_id, CAST(NULL AS STRING) AS ending_sequence_number,
      CASE WHEN stream = 'RO' AND shard_id = 'shard-2' THEN 'shard-9' END AS parent_shard_id,
      CAST(NULL AS STRING) AS adjacent_parent_shard_id, CAST(NULL AS TIMESTAMP) AS closed_at FROM seen
    UNION ALL
    SELECT stream, 'shard-9', CASE WHEN stream < 'N' THEN '4961' END, NULL, NULL,
      CASE WHEN stream < 'N' THEN {ts} END FROM (SELECT DISTINCT stream FROM seen) AS s"""


def streams(dialect: str) -> str:
    array = "array" if dialect == "spark" else "list_value"
    three = "'IncomingBytes', 'IncomingRecords', 'WriteProvisionedThroughputExceeded'"
    return f"""
    SELECT stream, 'us-east-1' AS region,
      CASE WHEN stream IN ('AO', 'RO') THEN 'ON_DEMAND' WHEN stream = 'NO' THEN 'something-else' ELSE 'PROVISIONED' END AS capacity_mode,
      CASE WHEN stream = 'RO' THEN {array}('IncomingBytes') WHEN stream = 'AF' THEN {array}('ALL') ELSE {array}({three}) END AS enabled_metrics
    FROM (SELECT DISTINCT l_returnflag || l_linestatus AS stream FROM {{lineitem}}) AS s"""


def stream_records(dialect: str) -> str:
    ts = from_epoch(dialect, f"{_SKEW_EPOCH} + 60 * {_minute(dialect)}")
    return f"""
    SELECT l_returnflag || l_linestatus AS stream, {_shard('l_suppkey')} AS shard_id, {ts} AS ts,
      'k' || CAST(CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE l_partkey % 40 END AS STRING) AS partition_key,
      l_orderkey * 10 + l_linenumber AS sequence_number, l_partkey, l_extendedprice
    FROM {{lineitem}}"""


# --- endpoints ------------------------------------------------------------------------------------

IDLE_END = utc(2026, 9, 23)
IDLE_HOURS = 336
IDLE_START = IDLE_END - dt.timedelta(hours=IDLE_HOURS)
_IDLE_EPOCH = int(IDLE_START.timestamp())
_TWO_VARIANTS = (
    "(SELECT *, 'a' AS variant_name FROM {supplier} UNION ALL SELECT *, 'b' AS variant_name FROM {supplier})"
)
_REGION = "CASE s_nationkey % 3 WHEN 0 THEN 'us-east-1' WHEN 1 THEN 'eu-west-1' ELSE 'ap-south-2' END"


def running_variants(dialect: str) -> str:
    """Flat runtime side: one row per endpoint and variant (two variants for some)."""
    created = from_epoch(dialect, f"{_IDLE_EPOCH} + CASE WHEN s_suppkey % 13 = 0 THEN 3600 * 200 WHEN s_suppkey % 13 = 1 THEN 3600 * 60 ELSE -86400 END")
    return f"""
    SELECT {_REGION} AS region, 'ep' || CAST(s_suppkey AS STRING) AS endpoint,
      CASE s_suppkey % 11 WHEN 0 THEN 'Creating' WHEN 1 THEN 'Updating' WHEN 2 THEN 'Retired' ELSE 'InService' END AS status,
      CASE WHEN s_suppkey % 29 <> 28 THEN {created} END AS created_at,
      CASE WHEN s_suppkey % 23 <> 22 THEN 'cfg' || CAST(s_suppkey AS STRING) END AS config_name,
      v.variant_name, CAST(CASE WHEN v.variant_name = 'b' THEN 1 ELSE s_suppkey % 4 + CASE WHEN s_suppkey % 31 = 0 THEN 0 ELSE 1 END END AS INT) AS current_instance_count,
      CAST(CASE WHEN s_suppkey % 17 = 0 AND v.variant_name = 'a' THEN 2048 END AS INT) AS memory_mb, s_suppkey
    FROM {_TWO_VARIANTS} AS v
    WHERE v.variant_name = 'a' OR s_suppkey % 4 = 3"""


def configured_variants(dialect: str) -> str:
    return f"""
    SELECT {_REGION} AS region, 'cfg' || CAST(s_suppkey AS STRING) AS config_name, v.variant_name,
      CASE WHEN s_suppkey % 17 <> 0 OR v.variant_name = 'b' THEN
        CASE s_suppkey % 6 WHEN 0 THEN 'ml.m5.large' WHEN 1 THEN 'ml.g5.xlarge' WHEN 2 THEN 'ml.m5.4xlarge'
          WHEN 3 THEN 'ml.c5.xlarge' WHEN 4 THEN 'ml.t2.medium' ELSE 'ml.custom' END END AS instance_type,
      CASE WHEN s_suppkey % 9 <> 0 THEN 'model-' || CAST(s_suppkey AS STRING) END AS model_name
    FROM {_TWO_VARIANTS} AS v"""


def scaling_targets(dialect: str) -> str:
    return f"""
    SELECT {_REGION} AS region, 'endpoint/ep' || CAST(s_suppkey AS STRING) || '/variant/a' AS resource_id,
      'sagemaker:variant:DesiredInstanceCount' AS scalable_dimension,
      CAST(s_suppkey % 14 / 7 AS INT) AS min_capacity, 4 AS max_capacity
    FROM {{supplier}} WHERE s_suppkey % 7 = 0"""


def endpoint_points(dialect: str) -> str:
    hour = f"({days_since(dialect, '1995-01-01', 'l_shipdate')} % 400)"
    ts = from_epoch(dialect, f"{_IDLE_EPOCH} + 3600 * hour")
    return f"""
    WITH hourly AS (
      SELECT l_suppkey AS s_suppkey, {hour} AS hour, CAST(count(*) AS DOUBLE) AS n FROM {{lineitem}} GROUP BY 1, 2)
    SELECT {_REGION} AS region, 'ep' || CAST(v.s_suppkey AS STRING) AS endpoint, v.variant_name AS variant, 'Invocations' AS metric, {ts} AS ts,
      CASE WHEN v.s_suppkey % 19 = 3 THEN 0.0 WHEN v.variant_name = 'b' AND h.hour % 50 <> 0 THEN 0.0 ELSE n END AS value
    FROM hourly AS h JOIN {_TWO_VARIANTS} AS v ON h.s_suppkey = v.s_suppkey
    WHERE v.s_suppkey % 5 <> 0"""


def hosting_prices(dialect: str) -> str:
    rows = []
    for region, factor in (("us-east-1", 1), ("eu-west-1", 1.12)):
        for name, usd in (
            ("ml.m5.large", 0.115), ("ml.g5.xlarge", 1.408), ("ml.m5.4xlarge", 0.922),
            ("ml.c5.xlarge", 0.204), ("ml.t2.medium", 0.056),
        ):
            rows.append(f"('{region}', '{name}', CAST({usd * factor:.6f} AS DECIMAL(12,6)))")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(region, instance_type, usd_per_hour)"


def serverless_prices(dialect: str) -> str:
    return (
        "SELECT * FROM (VALUES ('us-east-1', 2, CAST(0.00004 AS DECIMAL(18,10))), ('eu-west-1', 2, CAST(0.000044 AS DECIMAL(18,10))), "
        "('us-east-1', 4, CAST(0.00008 AS DECIMAL(18,10)))) AS t(region, memory_gb, usd_per_second)"
    )


# --- workloads ------------------------------------------------------------------------------------


def workloads(dialect: str) -> str:
    return """
    SELECT p_partkey AS workload_id,
      CASE p_partkey % 8 WHEN 0 THEN 25.0 WHEN 1 THEN 25.5 WHEN 2 THEN 4.0 WHEN 3 THEN 1024.0 WHEN 4 THEN 2048.0
        WHEN 5 THEN 100.0 WHEN 6 THEN CAST(p_size AS DOUBLE) ELSE p_size / 10.0e0 END AS payload_mb,
      CASE p_partkey % 5 WHEN 0 THEN 25.0 WHEN 1 THEN 4.5 ELSE p_size / 20.0e0 END AS response_mb,
      CASE p_partkey % 7 WHEN 0 THEN 60.0 WHEN 1 THEN 61.0 WHEN 2 THEN 3600.0 WHEN 3 THEN 7200.0 WHEN 4 THEN -1.0 ELSE p_size / 2.0e0 END AS processing_seconds,
      CASE p_partkey % 3 WHEN 0 THEN 'steady' WHEN 1 THEN 'bursty-idle' ELSE 'scheduled-batch' END AS traffic,
      CASE p_partkey % 6 WHEN 0 THEN 250.0e0 WHEN 1 THEN 1000.0e0 WHEN 2 THEN 2500.5e0 END AS latency_p99_ms,
      p_size % 5 = 0 AS zero_idle_cost,
      p_partkey % 9 < 4 AS immediate_response,
      p_size % 7 = 0 AS needs_notification,
      p_size % 4 = 0 AS gpu_required,
      CAST((p_partkey % 10 - p_partkey % 2) / 2 AS INT) AS model_count
    FROM {part}"""

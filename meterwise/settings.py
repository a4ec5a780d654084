"""Thresholds and fixed values. Every job takes its thresholds as an argument with these defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: model invocation records -------------------------------------------------------
SCHEMA_TYPE = "ModelInvocationLog"
SCHEMA_MAJOR = "1"
CONTENT_FIELDS = ("inputBodyJson", "outputBodyJson")
METRICS_KEY = "amazon-bedrock-invocationMetrics"
LOG_SUFFIXES = (".json", ".gz", ".jsonl", ".ndjson", ".log")
GEO_PREFIXES = ("us-gov", "global", "apac", "us", "eu")
SERVICE_NAME_SUFFIX = "(amazon bedrock edition)"
TOKEN_KINDS = ("input", "output", "cache_read", "cache_write")
NO_IDENTITY = "<no identity recorded>"
REDACTED = "<redacted>"

# --- Fixed values: shard metrics ------------------------------------------------------------------
BYTES_METRIC = "IncomingBytes"
RECORDS_METRIC = "IncomingRecords"
THROTTLE_METRIC = "WriteProvisionedThroughputExceeded"
SHARD_METRICS = (BYTES_METRIC, RECORDS_METRIC, THROTTLE_METRIC)
SHARD_BYTES_PER_MINUTE = 1048576 * 60
SHARD_RECORDS_PER_MINUTE = 1000 * 60
STREAM_VERDICTS = (
    "no_shard_metrics", "no_traffic", "healthy", "skew", "mixed", "capacity", "bursty",
)
STREAM_PROBLEMS = ("skew", "mixed", "capacity", "bursty")

# --- Fixed values: hosting endpoints --------------------------------------------------------------
INVOCATIONS_METRIC = "Invocations"
ENDPOINT_STATUSES = (
    "InService", "Creating", "Updating", "SystemUpdating", "RollingBack", "Deleting", "Failed",
    "OutOfService",
)
BILLING_STATUSES = ("InService", "Updating", "SystemUpdating", "RollingBack")
ENDPOINT_VERDICTS = ("idle", "underused", "healthy", "not_applicable", "too_new", "not_billing")
WASTE_VERDICTS = ("idle", "underused")
ACCELERATED_FAMILIES = ("p2", "p3", "p4", "p5", "g4", "g5", "g6", "inf1", "inf2", "trn1")
SIZE_MEMORY_GB = {
    "medium": 4, "large": 8, "xlarge": 16, "2xlarge": 32, "4xlarge": 64, "8xlarge": 128,
    "12xlarge": 192, "16xlarge": 256, "24xlarge": 384,
}
SERVERLESS_MAX_MEMORY_GB = 6

# --- Fixed values: data quality rules -------------------------------------------------------------
DATA_TYPE_RULES = {
    "boolean": "Boolean", "integer": "Long", "float": "Double", "date": "Date",
    "timestamp": "Timestamp",
}


# Fixed values, here and in the classes below: default thresholds and weights that results have to agree on.
@dataclass(frozen=True)
class UsageThresholds:
    outlier_percentile: float = 0.99
    minimum_samples: int = 20
    burst_window_seconds: int = 60
    burst_count: int = 60
    jump_multiple: float = 10.0
    jump_minimum_count: int = 20
    jump_minimum_windows: int = 5
    repeat_count: int = 20
    top_requests: int = 10


@dataclass(frozen=True)
class Tolerance:
    completeness_margin: float
    uniqueness_margin: float
    numeric_padding: float
    length_padding: int
    row_count_tolerance: float


# Room left for normal change at each strictness.
TOLERANCES = {
    "strict": Tolerance(0.002, 0.002, 0.0, 0, 0.05),
    "balanced": Tolerance(0.01, 0.01, 0.05, 1, 0.2),
    "lenient": Tolerance(0.05, 0.05, 0.25, 5, 0.5),
}


@dataclass(frozen=True)
class QualityShape:
    value_set_size: int = 25
    shown_values: int = 5
    minimum_rows_for_values: int = 50
    maximum_distinct_ratio: float = 0.1
    minimum_uniqueness: float = 0.95
    key_kinds: tuple[str, ...] = ("integer", "string")


@dataclass(frozen=True)
class SkewThresholds:
    max_to_mean: float = 3.0
    gini: float = 0.4
    headroom: float = 0.5
    near_capacity: float = 0.7
    minimum_shards: int = 2
    minimum_coverage: float = 0.5
    sample_records: int = 5000
    sample_keys: int = 10
    sample_minimum_share: float = 0.01


@dataclass(frozen=True)
class IdleThresholds:
    invocations_per_instance_hour: float = 1.0
    minimum_coverage: float = 0.8
    hours_per_month: int = 730
    serverless_memory_limit_gb: int = 16
    # Both or neither: assumptions for the serverless comparison.
    seconds_per_invocation: float | None = None
    serverless_memory_gb: int | None = None

    def __post_init__(self) -> None:
        if (self.seconds_per_invocation is None) != (self.serverless_memory_gb is None):
            raise ValueError("give seconds_per_invocation and serverless_memory_gb together")


@dataclass(frozen=True)
class ServingOption:
    """One serving option. A cap of None means none is documented."""

    name: str
    title: str
    request_mb: float | None
    response_mb: float | None
    seconds: float | None
    gpu: bool
    scales_to_zero: bool
    inline_response: bool
    notifies: bool
    multi_model: bool = False


# Documented limits of the four options, in display order.
SERVING_OPTIONS = (
    ServingOption("real_time", "Real-time endpoint", 25, 25, 60, True, False, True, False, True),
    ServingOption("serverless", "Serverless inference", 4, 4, 60, False, True, True, False),
    ServingOption("async", "Asynchronous inference", 1024, None, 3600, True, True, False, True),
    ServingOption("batch_transform", "Batch transform", 100, None, 3600, True, True, False, True),
)


@dataclass(frozen=True)
class PlacementWeights:
    """Weights by rule id, in evaluation order, and the tie-break order."""

    weights: dict[str, float] = field(
        default_factory=lambda: {
            "steady_traffic_favours_real_time": 3.0,
            "bursty_traffic_favours_serverless": 3.0,
            "bursty_traffic_favours_async": 1.0,
            "scheduled_batch_favours_batch_transform": 4.0,
            "scheduled_batch_favours_async": 1.0,
            "tight_latency_favours_real_time": 2.0,
            "tight_latency_penalises_serverless": -2.0,
            "offline_result_favours_async": 1.0,
            "offline_result_favours_batch_transform": 1.0,
            "many_models_favour_real_time": 1.0,
        }
    )
    tie_break: tuple[str, ...] = ("serverless", "batch_transform", "async", "real_time")
    tight_latency_ms: float = 1000
    many_models: int = 3
    component_models: int = 2
    cold_start_seconds: int = 240

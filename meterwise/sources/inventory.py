"""Stream and endpoint inventories out of saved describe responses, one JSON response per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.operators.streams import capacity_mode

# Fields of the responses.
_STREAM = (
    "StreamDescriptionSummary struct<StreamName string, OpenShardCount int, "
    "StreamModeDetails struct<StreamMode string>, "
    "EnhancedMonitoring array<struct<ShardLevelMetrics array<string>>>>"
)
_SHARDS = (
    "StreamName string, Shards array<struct<ShardId string, ParentShardId string, "
    "AdjacentParentShardId string, ClosedAt timestamp, "
    "SequenceNumberRange struct<EndingSequenceNumber string>>>"
)
_SERVERLESS = "struct<MemorySizeInMB int, MaxConcurrency int>"
_ENDPOINT = (
    "EndpointName string, EndpointStatus string, CreationTime timestamp, EndpointConfigName string, "
    f"ProductionVariants array<struct<VariantName string, CurrentInstanceCount int, CurrentServerlessConfig {_SERVERLESS}>>"
)
_CONFIG = (
    "EndpointConfigName string, "
    f"ProductionVariants array<struct<VariantName string, InstanceType string, ModelName string, ServerlessConfig {_SERVERLESS}>>"
)
_TARGETS = "ScalableTargets array<struct<ResourceId string, ScalableDimension string, MinCapacity int, MaxCapacity int>>"


def _nonempty(name: str):
    return F.when(F.col(name) != "", F.col(name))


def streams(responses: DataFrame) -> DataFrame:
    """(stream, region, capacity_mode, open_shard_count, enabled_metrics) of (region, response)."""
    s = responses.select("region", F.from_json("response", _STREAM)["StreamDescriptionSummary"].alias("s"))
    metrics = F.flatten(F.transform("s.EnhancedMonitoring", lambda m: F.coalesce(m["ShardLevelMetrics"], F.array())))
    return s.select(
        F.col("s.StreamName").alias("stream"), "region",
        capacity_mode(F.col("s.StreamModeDetails.StreamMode")).alias("capacity_mode"),
        F.coalesce("s.OpenShardCount", F.lit(0)).alias("open_shard_count"),
        F.coalesce(metrics, F.array().cast("array<string>")).alias("enabled_metrics"),
    )


def shards(responses: DataFrame) -> DataFrame:
    """(stream, shard_id, ...) of (response): one row per shard; empty ids read as null."""
    r = responses.select(F.from_json("response", _SHARDS).alias("r"))
    return r.select(F.col("r.StreamName").alias("stream"), F.inline("r.Shards")).select(
        "stream", F.coalesce("ShardId", F.lit("")).alias("shard_id"),
        F.when(F.col("SequenceNumberRange.EndingSequenceNumber") != "", F.col("SequenceNumberRange.EndingSequenceNumber")).alias("ending_sequence_number"),
        _nonempty("ParentShardId").alias("parent_shard_id"),
        _nonempty("AdjacentParentShardId").alias("adjacent_parent_shard_id"),
        F.col("ClosedAt").alias("closed_at"),
    )


def endpoints(responses: DataFrame) -> DataFrame:
    """(region, endpoint, status, created_at, config_name, variants) of (region, response)."""
    r = responses.select("region", F.from_json("response", _ENDPOINT).alias("r"))
    variants = F.transform(
        "r.ProductionVariants",
        lambda v: F.struct(
            v["VariantName"].alias("variant_name"), v["CurrentInstanceCount"].alias("current_instance_count"),
            F.struct(
                v["CurrentServerlessConfig"]["MemorySizeInMB"].alias("memory_mb"),
                v["CurrentServerlessConfig"]["MaxConcurrency"].alias("max_concurrency"),
            ).alias("serverless"),
        ),
    )
    return r.filter("r.EndpointName <> ''").select(
        "region", F.col("r.EndpointName").alias("endpoint"), F.col("r.EndpointStatus").alias("status"),
        F.col("r.CreationTime").alias("created_at"), F.col("r.EndpointConfigName").alias("config_name"),
        variants.alias("variants"),
    )


def configs(responses: DataFrame) -> DataFrame:
    """(region, config_name, variants) of (region, response)."""
    r = responses.select("region", F.from_json("response", _CONFIG).alias("r"))
    variants = F.transform(
        "r.ProductionVariants",
        lambda v: F.struct(
            v["VariantName"].alias("variant_name"), v["InstanceType"].alias("instance_type"),
            v["ModelName"].alias("model_name"),
            F.struct(
                v["ServerlessConfig"]["MemorySizeInMB"].alias("memory_mb"),
                v["ServerlessConfig"]["MaxConcurrency"].alias("max_concurrency"),
            ).alias("serverless"),
        ),
    )
    return r.select("region", F.col("r.EndpointConfigName").alias("config_name"), variants.alias("variants"))


def scaling_targets(responses: DataFrame) -> DataFrame:
    """(region, resource_id, scalable_dimension, min_capacity, max_capacity) of (region, response)."""
    r = responses.select("region", F.from_json("response", _TARGETS).alias("r"))
    return r.select("region", F.inline("r.ScalableTargets")).filter("ResourceId <> ''").select(
        "region", F.col("ResourceId").alias("resource_id"), F.col("ScalableDimension").alias("scalable_dimension"),
        F.coalesce("MinCapacity", F.lit(0)).alias("min_capacity"), F.coalesce("MaxCapacity", F.lit(0)).alias("max_capacity"),
    )

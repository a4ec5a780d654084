"""Queries over endpoint inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue import adapters as ad
from catalogue.logs import money
from meterwise.operators import endpoints as ep
from meterwise.plans.endpoints import endpoint_scan
from meterwise.settings import ENDPOINT_VERDICTS, IdleThresholds
from meterwise.sinks import documents
from meterwise.sinks.reports import finding_rows, nested
from meterwise.sources import inventory

QUERIES: dict = {}
SQL: dict[str, str] = {}
ASSUMED = IdleThresholds(seconds_per_invocation=1.5, serverless_memory_gb=2)


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested endpoints and configurations, built as saved describe responses and read back."""
    running = ad.adapted(spark, sf_dir, ad.running_variants, "supplier")
    variant = F.struct(
        F.col("variant_name").alias("VariantName"), F.col("current_instance_count").alias("CurrentInstanceCount"),
        F.when(F.col("memory_mb").isNotNull(), F.struct(F.col("memory_mb").alias("MemorySizeInMB"))).alias("CurrentServerlessConfig"),
    )
    responses = running.groupBy("region", "endpoint", "status", "created_at", "config_name").agg(
        F.collect_list(variant).alias("v")
    ).select(
        "region",
        F.to_json(
            F.struct(
                F.col("endpoint").alias("EndpointName"), F.col("status").alias("EndpointStatus"),
                F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("CreationTime"),
                F.col("config_name").alias("EndpointConfigName"), F.col("v").alias("ProductionVariants"),
            )
        ).alias("response"),
    )
    configured = ad.adapted(spark, sf_dir, ad.configured_variants, "supplier")
    setting = F.struct(
        F.col("variant_name").alias("VariantName"), F.col("instance_type").alias("InstanceType"), F.col("model_name").alias("ModelName")
    )
    config_responses = configured.groupBy("region", "config_name").agg(F.collect_list(setting).alias("v")).select(
        "region",
        F.to_json(F.struct(F.col("config_name").alias("EndpointConfigName"), F.col("v").alias("ProductionVariants"))).alias("response"),
    )
    targets = ad.adapted(spark, sf_dir, ad.scaling_targets, "supplier")
    target = F.struct(
        F.col("resource_id").alias("ResourceId"), F.col("scalable_dimension").alias("ScalableDimension"),
        F.col("min_capacity").alias("MinCapacity"), F.col("max_capacity").alias("MaxCapacity"),
    )
    target_responses = targets.select("region", F.to_json(F.struct(F.array(target).alias("ScalableTargets"))).alias("response"))
    return inventory.endpoints(responses), inventory.configs(config_responses), inventory.scaling_targets(target_responses)


def variants(spark, sf_dir) -> DataFrame:
    return ep.inventory(*tables(spark, sf_dir), ad.IDLE_END)


def points(spark, sf_dir) -> DataFrame:
    return ad.adapted(spark, sf_dir, ad.endpoint_points, "lineitem", "supplier")


def measured(spark, sf_dir) -> DataFrame:
    return ep.with_traffic(
        variants(spark, sf_dir), ep.invocations(points(spark, sf_dir), ad.IDLE_START, ad.IDLE_END), ad.IDLE_START, ad.IDLE_END
    )


def scan(spark: SparkSession, sf_dir: str, thresholds: IdleThresholds = IdleThresholds()) -> dict[str, DataFrame]:
    return endpoint_scan(
        *tables(spark, sf_dir), points(spark, sf_dir), spark.sql(ad.hosting_prices("spark")),
        spark.sql(ad.serverless_prices("spark")), ad.IDLE_START, ad.IDLE_END, thresholds,
    )


# --- the same in SQL ------------------------------------------------------------------------------

_START = f"TIMESTAMP '{ad.IDLE_START:%Y-%m-%d %H:%M:%S}'"
_END = f"TIMESTAMP '{ad.IDLE_END:%Y-%m-%d %H:%M:%S}'"
INVENTORY = f"""
  running AS ({ad.duck(ad.running_variants)}), configured AS ({ad.duck(ad.configured_variants)}), target AS ({ad.duck(ad.scaling_targets)}),
  variants AS (SELECT r.region, r.endpoint, r.variant_name AS variant, CASE WHEN status = 'Retired' THEN 'Unknown' ELSE status END AS status, coalesce(created_at, {_END}) AS created_at,
      c.instance_type, r.current_instance_count AS instance_count, r.memory_mb AS serverless_memory_mb, c.config_name IS NOT NULL AND coalesce(c.model_name, '') = '' AS hosts_components,
      coalesce(t.min_capacity = 0, FALSE) AS can_scale_to_zero
    FROM running AS r LEFT JOIN configured AS c ON r.region = c.region AND r.config_name = c.config_name AND r.variant_name = c.variant_name
      LEFT JOIN target AS t ON r.region = t.region AND t.resource_id = 'endpoint/' || r.endpoint || '/variant/' || r.variant_name)"""
INVOKED = f"""
  points AS ({ad.duck(ad.endpoint_points)}),
  invoked AS (SELECT region, endpoint, variant, sum(value) AS invocations, count(value) AS datapoints FROM points WHERE metric = 'Invocations' AND ts >= {_START} AND ts < {_END} GROUP BY 1, 2, 3)"""
_BILLS = "status IN ('InService', 'Updating', 'SystemUpdating', 'RollingBack')"
MEASURED = f"""{INVENTORY}, {INVOKED},
  asked AS (SELECT *, {_BILLS} AND serverless_memory_mb IS NULL AND NOT can_scale_to_zero AS needs FROM variants),
  measured AS (SELECT a.*, CASE WHEN needs THEN i.invocations END AS invocations, CASE WHEN needs THEN coalesce(i.datapoints, 0) END AS datapoints,
      greatest(0::DOUBLE, least(1::DOUBLE, (epoch({_END}) - epoch(greatest(created_at, {_START}))) / {ad.IDLE_HOURS * 3600})) AS window_coverage,
      CASE WHEN needs AND instance_count > 0 THEN coalesce(i.invocations, 0) / ({ad.IDLE_HOURS} * instance_count) END AS density
    FROM asked AS a LEFT JOIN invoked AS i ON a.needs AND a.region = i.region AND a.endpoint = i.endpoint AND a.variant = i.variant)"""
JUDGED = f"""{MEASURED},
  judged AS (SELECT *, CASE WHEN NOT {_BILLS} THEN 'not_billing' WHEN serverless_memory_mb IS NOT NULL OR can_scale_to_zero THEN 'not_applicable' WHEN window_coverage < 0.8 THEN 'too_new'
      WHEN instance_count <= 0 THEN 'not_applicable' WHEN coalesce(invocations, 0) <= 0 THEN 'idle' WHEN density < 1 THEN 'underused' ELSE 'healthy' END AS verdict FROM measured)"""


def _findings_sql(assumed: bool) -> str:
    serverless = (
        f"CASE WHEN remedy = 'move_to_serverless' THEN CAST(round(coalesce(invocations, 0) * (730 / {ad.IDLE_HOURS}::DOUBLE) * 1.5 * CAST(per_second AS DOUBLE), 2) AS DECIMAL(20,2)) END"
        if assumed else "CAST(NULL AS DECIMAL(20,2))"
    )
    return f"""{JUDGED}, hosting AS ({ad.hosting_prices('duck')}), serverless AS ({ad.serverless_prices('duck')}),
  priced AS (SELECT j.*, h.usd_per_hour AS hourly, s.usd_per_second AS per_second,
      instance_count - greatest(1, least(instance_count, CAST(ceil(coalesce(invocations, 0) / {ad.IDLE_HOURS}) AS INT))) AS raw_surplus,
      coalesce(j.instance_type, '') = '' OR instance_count <= 0 AS unpriceable,
      coalesce(j.instance_type IN ('ml.m5.large', 'ml.c5.xlarge', 'ml.t2.medium'), FALSE) AS fits
    FROM judged AS j LEFT JOIN hosting AS h ON j.region = h.region AND j.instance_type = h.instance_type LEFT JOIN serverless AS s ON j.region = s.region AND s.memory_gb = 2),
  spent AS (SELECT *, greatest(0, raw_surplus) AS surplus, CASE WHEN serverless_memory_mb IS NULL AND NOT unpriceable THEN CAST(round(hourly * instance_count * 730, 2) AS DECIMAL(20,2)) END AS monthly FROM priced),
  fixed AS (SELECT *, CASE WHEN verdict = 'idle' THEN 'delete' WHEN verdict <> 'underused' THEN 'none' WHEN surplus > 0 THEN 'reduce_instance_count' WHEN fits THEN 'move_to_serverless' ELSE 'move_to_async_scale_to_zero' END AS remedy,
      CASE WHEN serverless_memory_mb IS NOT NULL OR unpriceable THEN 0 WHEN hourly IS NULL THEN NULL WHEN verdict = 'idle' THEN monthly
        WHEN verdict = 'underused' THEN CASE WHEN surplus > 0 THEN CAST(round(hourly * surplus * 730, 2) AS DECIMAL(20,2)) END ELSE 0 END AS waste FROM spent),
  compared AS (SELECT *, {serverless} AS on_serverless FROM fixed),
  findings AS (SELECT *, CASE WHEN waste IS NULL AND on_serverless IS NOT NULL AND monthly IS NOT NULL THEN greatest(0, monthly - on_serverless) ELSE waste END AS wasted FROM compared)"""


_INVENTORY_COLUMNS = "region, endpoint, variant, status, instance_type, instance_count, serverless_memory_mb, hosts_components, can_scale_to_zero"


@query("endpoint_inventory", f"WITH {INVENTORY} SELECT {_INVENTORY_COLUMNS}, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM variants")
def endpoint_inventory(spark, sf_dir):
    return variants(spark, sf_dir).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("endpoint_invocations", f"WITH {INVOKED} SELECT * FROM invoked")
def endpoint_invocations(spark, sf_dir):
    return ep.invocations(points(spark, sf_dir), ad.IDLE_START, ad.IDLE_END)


_TRAFFIC_SQL = "region, endpoint, variant, invocations, datapoints, round(window_coverage, 6) AS window_coverage, round(density, 6) AS density"


@query("endpoint_traffic", f"WITH {MEASURED} SELECT {_TRAFFIC_SQL} FROM measured")
def endpoint_traffic(spark, sf_dir):
    return measured(spark, sf_dir).select(
        "region", "endpoint", "variant", "invocations", "datapoints", F.round("window_coverage", 6).alias("window_coverage"),
        F.round("invocations_per_instance_hour", 6).alias("density"),
    )


@query("endpoint_verdicts", f"WITH {JUDGED} SELECT region, endpoint, variant, verdict, verdict IN ('idle', 'underused') AS is_waste FROM judged")
def endpoint_verdicts(spark, sf_dir):
    judged = ep.classify(measured(spark, sf_dir), ad.IDLE_HOURS)
    return judged.select("region", "endpoint", "variant", "verdict", "is_waste")


_REASON = """CASE WHEN serverless_memory_mb IS NOT NULL THEN 'serverless bills per request, so nothing stands idle' WHEN unpriceable THEN 'no instances to price'
  WHEN hourly IS NULL THEN 'not on the price list of ' || region || ': ' || instance_type WHEN verdict = 'underused' AND surplus = 0 AND (on_serverless IS NULL OR monthly IS NULL) THEN 'one instance is already more than the traffic needs' END AS no_estimate_reason"""
_MONEY = "CAST(monthly AS DOUBLE) AS monthly_usd, CAST(wasted AS DOUBLE) AS wasted_monthly_usd, CAST(on_serverless AS DOUBLE) AS serverless_monthly_usd"
_FINDING = f"region, endpoint, variant, verdict, remedy, {_MONEY}, {_REASON}"


def _shown(findings: DataFrame) -> DataFrame:
    return money(findings, "monthly_usd", "wasted_monthly_usd", "serverless_monthly_usd").select(
        "region", "endpoint", "variant", "verdict", "remedy", "monthly_usd", "wasted_monthly_usd", "serverless_monthly_usd", "no_estimate_reason"
    )


@query("endpoint_findings", f"WITH {_findings_sql(False)} SELECT {_FINDING} FROM findings")
def endpoint_findings(spark, sf_dir):
    return _shown(scan(spark, sf_dir)["findings"])


@query("endpoint_findings_with_serverless_comparison", f"WITH {_findings_sql(True)} SELECT {_FINDING} FROM findings")
def endpoint_findings_with_serverless_comparison(spark, sf_dir):
    return _shown(scan(spark, sf_dir, ASSUMED)["findings"])


@query("wasteful_endpoints", f"WITH {_findings_sql(False)} SELECT region, endpoint, variant, CAST(wasted AS DOUBLE) AS wasted_monthly_usd FROM findings WHERE verdict IN ('idle', 'underused')")
def wasteful_endpoints(spark, sf_dir):
    found = ep.only_waste(scan(spark, sf_dir)["findings"])
    return money(found, "wasted_monthly_usd").select("region", "endpoint", "variant", "wasted_monthly_usd")


@query(
    "endpoint_scan_totals",
    f"WITH {_findings_sql(True)} SELECT CAST(sum(coalesce(monthly, 0)) AS DOUBLE) AS monthly_usd, CAST(sum(coalesce(wasted, 0)) AS DOUBLE) AS wasted_monthly_usd, "
    "count(*) FILTER (WHERE verdict IN ('idle', 'underused') AND wasted IS NULL) AS findings_without_a_waste_estimate, "
    "count(*) FILTER (WHERE verdict IN ('idle', 'underused') AND wasted IS NULL) = 0 AS totals_are_complete, count(*) AS findings FROM findings",
)
def endpoint_scan_totals(spark, sf_dir):
    return money(scan(spark, sf_dir, ASSUMED)["totals"], "monthly_usd", "wasted_monthly_usd")


@query("endpoint_verdict_counts", f"WITH {JUDGED}, names AS (SELECT unnest({list(ENDPOINT_VERDICTS)}) AS verdict) SELECT n.verdict, count(j.verdict) AS count FROM names AS n LEFT JOIN judged AS j ON n.verdict = j.verdict GROUP BY 1")
def endpoint_verdict_counts(spark, sf_dir):
    return scan(spark, sf_dir)["counts"]


@query(
    "endpoint_findings_file",
    f"WITH {_findings_sql(False)} SELECT region, endpoint, variant, status, verdict, instance_type, instance_count, invocations, round(density, 6) AS invocations_per_instance_hour, "
    "CAST(monthly AS DOUBLE) AS estimated_monthly_usd, CAST(wasted AS DOUBLE) AS estimated_wasted_monthly_usd, remedy FROM findings",
)
def endpoint_findings_file(spark, sf_dir):
    rows = finding_rows(scan(spark, sf_dir)["findings"]).drop("evidence")
    return money(rows, "estimated_monthly_usd", "estimated_wasted_monthly_usd")


@query("endpoint_report_sections", f"WITH {JUDGED} SELECT 'findings' AS section, count(*) AS rows FROM judged UNION ALL SELECT 'counts', 6 UNION ALL SELECT 'totals', 1")
def endpoint_report_sections(spark, sf_dir):
    return nested(scan(spark, sf_dir)).groupBy("section").agg(F.count("*").alias("rows"))


@query(
    "instance_type_parts",
    "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'm5' WHEN 1 THEN 'g5' WHEN 2 THEN '' ELSE 'inf2' END AS family, "
    "CAST(CASE WHEN p_size % 4 = 2 THEN NULL ELSE CASE p_size % 5 WHEN 0 THEN 4 WHEN 1 THEN 16 WHEN 2 THEN 384 WHEN 3 THEN NULL ELSE 8 END END AS INT) AS memory_gb FROM part",
)
def instance_type_parts(spark, sf_dir):
    part = ad.load(spark, sf_dir, "part")["part"]
    sizes = F.get(F.array(*[F.lit(x) for x in ("medium", "xlarge", "24xlarge", "metal", "large")]), F.col("p_size") % 5)
    family = F.get(F.array(*[F.lit(x) for x in ("ml.m5.", "ml.g5.", "ml.", "ml.inf2.")]), F.col("p_size") % 4)
    kind = F.concat(family, sizes)
    return part.select("p_partkey", ep.instance_family(kind).alias("family"), ep.approximate_memory_gb(kind).alias("memory_gb"))


@query(
    "region_documents",
    f"""WITH {_findings_sql(False)} SELECT region, count(*) AS count, CAST(sum(wasted) AS DOUBLE) AS wasted_monthly_usd,
      string_agg(endpoint || '/' || variant || ':' || verdict || ':' || remedy, ',' ORDER BY endpoint, variant) AS findings FROM findings GROUP BY 1""",
)
def region_documents(spark, sf_dir):
    document = F.col("document")
    shown = F.transform(document["findings"], lambda f: F.concat(f["endpoint"], F.lit("/"), f["variant"], F.lit(":"), f["verdict"], F.lit(":"), f["remedy"]))
    found = documents.region_documents(scan(spark, sf_dir)["findings"]).select(
        "region", document["count"].alias("count"), document["wasted_monthly_usd"].alias("wasted_monthly_usd"), F.array_join(shown, ",").alias("findings")
    )
    return money(found, "wasted_monthly_usd")

"""Queries over shard metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue import adapters as ad
from meterwise.operators import keys, shards as sh, streams as st
from meterwise.operators.endpoints import verdict_counts
from meterwise.plans.streams import stream_scan
from meterwise.settings import STREAM_VERDICTS
from meterwise.sinks import documents
from meterwise.sources import inventory

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


def points(spark, sf_dir) -> DataFrame:
    return ad.adapted(spark, sf_dir, ad.datapoints, "lineitem")


def shards(spark, sf_dir) -> DataFrame:
    return ad.adapted(spark, sf_dir, ad.shards, "lineitem")


def streams(spark, sf_dir) -> DataFrame:
    return ad.adapted(spark, sf_dir, ad.streams, "lineitem")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = sh.shards_in_window(shards(spark, sf_dir), ad.SKEW_START)
    measured = sh.traffic(points(spark, sf_dir), ad.SKEW_START, ad.SKEW_END)
    return sh.utilisation(live, measured, ad.SKEW_MINUTES)


def scan(spark: SparkSession, sf_dir: str, **extra) -> dict[str, DataFrame]:
    return stream_scan(
        streams(spark, sf_dir), shards(spark, sf_dir), points(spark, sf_dir), ad.SKEW_START, ad.SKEW_END, **extra
    )


# --- the same in SQL ------------------------------------------------------------------------------

_START = f"TIMESTAMP '{ad.SKEW_START:%Y-%m-%d %H:%M:%S}'"
_END = f"TIMESTAMP '{ad.SKEW_END:%Y-%m-%d %H:%M:%S}'"
_M = {"b": "IncomingBytes", "r": "IncomingRecords", "t": "WriteProvisionedThroughputExceeded"}


def _agg(f: str, m: str) -> str:
    return f"{f}(value) FILTER (WHERE metric = '{_M[m]}')"


TRAFFIC = f"""
  points AS ({ad.duck(ad.datapoints)}), shard AS ({ad.duck(ad.shards)}), stream AS ({ad.duck(ad.streams)}),
  traffic AS (SELECT stream, shard_id, coalesce({_agg('sum', 'b')}, 0) AS total_bytes, coalesce({_agg('sum', 'r')}, 0) AS total_records,
      coalesce({_agg('sum', 't')}, 0) AS throttled_records, coalesce({_agg('max', 'b')}, 0) AS peak_bytes, coalesce({_agg('max', 'r')}, 0) AS peak_records,
      greatest({_agg('count', 'b')}, {_agg('count', 'r')}, {_agg('count', 't')}) AS observed_minutes
    FROM points WHERE ts >= {_START} AND ts < {_END} AND metric IN ('{_M['b']}', '{_M['r']}', '{_M['t']}') GROUP BY 1, 2)"""
SCORED = f"""{TRAFFIC},
  live AS (SELECT * FROM shard WHERE closed_at IS NULL OR closed_at >= {_START}),
  joined AS (SELECT l.stream, l.shard_id, l.ending_sequence_number IS NULL AS is_open, coalesce(total_bytes, 0) AS total_bytes, coalesce(total_records, 0) AS total_records,
      coalesce(throttled_records, 0) AS throttled_records, coalesce(peak_bytes, 0) / (1048576 * 60) AS by_bytes, coalesce(peak_records, 0) / 60000 AS by_records,
      coalesce(observed_minutes, 0) AS observed_minutes, least(1.0::DOUBLE, coalesce(observed_minutes, 0) / {ad.SKEW_MINUTES}) AS coverage
    FROM live AS l LEFT JOIN traffic AS t ON l.stream = t.stream AND l.shard_id = t.shard_id),
  scored AS (SELECT *, greatest(by_bytes, by_records) AS utilisation, CASE WHEN by_records > by_bytes THEN 'records' ELSE 'bytes' END AS binding,
      coverage >= 0.5 AND observed_minutes > 0 AS counted, CASE WHEN sum(total_bytes) OVER w > 0 THEN total_bytes / sum(total_bytes) OVER w ELSE 0 END AS share_of_bytes
    FROM joined WINDOW w AS (PARTITION BY stream))"""
STATS = f"""{SCORED},
  counted AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY share_of_bytes) AS rn, row_number() OVER (PARTITION BY stream ORDER BY share_of_bytes DESC, shard_id) AS hot FROM scored WHERE counted),
  stats AS (SELECT stream, count(*) AS shard_count, CASE WHEN avg(share_of_bytes) > 0 THEN max(share_of_bytes) / avg(share_of_bytes) ELSE 1 END AS max_to_mean,
      CASE WHEN avg(share_of_bytes) > 0 THEN stddev_pop(share_of_bytes) / avg(share_of_bytes) ELSE 0 END AS variation,
      CASE WHEN sum(share_of_bytes) > 0 THEN max(share_of_bytes) / sum(share_of_bytes) ELSE 0 END AS hottest_share,
      max(CASE WHEN hot = 1 THEN shard_id END) AS hottest_shard_id, avg(utilisation) AS mean_utilisation, max(utilisation) AS max_utilisation,
      CASE WHEN sum(share_of_bytes) > 0 THEN greatest(0, 2 * sum(rn * share_of_bytes) / (count(*) * sum(share_of_bytes)) - (count(*) + 1) / count(*)) ELSE 0 END AS gini
    FROM counted GROUP BY stream HAVING count(*) >= 2)"""
_NEED = "['IncomingBytes', 'IncomingRecords', 'WriteProvisionedThroughputExceeded']"
VERDICTS = f"""{STATS},
  lacking AS (SELECT stream, CASE WHEN capacity_mode = 'ON_DEMAND' THEN 'ON_DEMAND' ELSE 'PROVISIONED' END AS capacity_mode,
      CASE WHEN list_contains(enabled_metrics, 'ALL') THEN 0 ELSE len([x FOR x IN {_NEED} IF NOT list_contains(enabled_metrics, x)]) END AS missing FROM stream),
  sums AS (SELECT stream, sum(throttled_records) AS throttled, max(utilisation) AS peak FROM scored GROUP BY 1),
  judged AS (SELECT l.stream, capacity_mode, CASE WHEN missing > 0 THEN 0 ELSE coalesce(throttled, 0) END AS throttled_records,
      CASE WHEN missing > 0 THEN 'no_shard_metrics' WHEN coalesce(peak, 0) <= 0 AND coalesce(throttled, 0) <= 0 THEN 'no_traffic' WHEN throttled <= 0 THEN 'healthy'
        WHEN shard_count IS NULL THEN 'capacity' WHEN max_to_mean >= 3 AND gini >= 0.4 AND mean_utilisation <= 0.5 THEN 'skew' WHEN max_to_mean >= 3 AND gini >= 0.4 THEN 'mixed'
        WHEN mean_utilisation >= 0.7 THEN 'capacity' ELSE 'bursty' END AS verdict
    FROM lacking AS l LEFT JOIN sums AS s ON l.stream = s.stream LEFT JOIN stats AS t ON l.stream = t.stream)"""


@query("shard_traffic", f"WITH {TRAFFIC} SELECT stream, shard_id, round(total_bytes, 2) AS total_bytes, total_records, throttled_records, round(peak_bytes, 2) AS peak_bytes, peak_records, observed_minutes FROM traffic")
def shard_traffic(spark, sf_dir):
    t = sh.traffic(points(spark, sf_dir), ad.SKEW_START, ad.SKEW_END)
    return t.withColumns({c: F.round(c, 2) for c in ("total_bytes", "peak_bytes")})


_SHARD_ROUNDED = ("coverage", "by_bytes", "by_records", "utilisation", "share_of_bytes")


@query(
    "shard_utilisation",
    f"WITH {SCORED} SELECT stream, shard_id, is_open, throttled_records, observed_minutes, binding, counted, "
    f"{', '.join(f'round({c}, 6) AS {c}' for c in _SHARD_ROUNDED)}, "
    "CASE WHEN observed_minutes = 0 THEN 'no data for this shard in the window' WHEN NOT counted THEN 'seen for only ' || CAST(round(coverage * 100) AS INT) || '% of the window, too little to compare' END AS excluded_reason FROM scored",
)
def shard_utilisation(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "stream", "shard_id", "is_open", "throttled_records", "observed_minutes", "binding", "counted",
        *[F.round(c, 6).alias(c) for c in _SHARD_ROUNDED],
        "excluded_reason",
    )


_KEYS_TEXT = "choose a key with more distinct values, or salt the busy one and merge downstream"
_LACKS = f"lacks AS (SELECT stream, array_to_string([x FOR x IN {_NEED} IF NOT list_contains(enabled_metrics, x)], ' ') AS lacking FROM stream)"
_PROVISIONED = "j.capacity_mode = 'PROVISIONED'"
_HEADLINE = f"""CASE verdict WHEN 'no_shard_metrics' THEN 'Per-shard metrics are switched off: skew is not measurable' WHEN 'no_traffic' THEN 'Nothing was written in this window'
  WHEN 'healthy' THEN 'Writes were not throttled' WHEN 'skew' THEN 'Key skew: one shard is full and the others are not' WHEN 'mixed' THEN 'Key skew on a stream that is busy anyway'
  WHEN 'capacity' THEN CASE WHEN shard_count IS NULL THEN 'Full, with too few shards for skew to matter' WHEN {_PROVISIONED} THEN 'Too few shards for an even load' ELSE 'More load than the stream has scaled to' END
  ELSE 'Throttled by spikes shorter than one datapoint' END"""
_REMEDY = f"""CASE verdict WHEN 'no_shard_metrics' THEN 'enable enhanced monitoring for ' || lacking || ' and look again later' WHEN 'no_traffic' THEN 'check the producers and the window if traffic was expected'
  WHEN 'healthy' THEN 'none needed' WHEN 'skew' THEN CASE WHEN {_PROVISIONED} THEN 'more shards' ELSE 'scaling' END || ' cannot help, one key stays on one shard: {_KEYS_TEXT}'
  WHEN 'mixed' THEN CASE WHEN {_PROVISIONED} THEN 'add shards' ELSE 'let the stream scale to the new peak' END || ', and {_KEYS_TEXT}'
  WHEN 'capacity' THEN CASE WHEN {_PROVISIONED} THEN 'add shards' WHEN shard_count IS NULL THEN 'retry with backoff until the stream has scaled out' ELSE 'ramp up more slowly, retry with backoff, or ask for higher limits' END
  ELSE 'batch and spread out the writes; ' || CASE WHEN {_PROVISIONED} THEN 'failing that, add shards' ELSE 'the stream does not scale on spikes' END END"""
_STAT_ROUNDED = ("max_to_mean", "variation", "hottest_share", "mean_utilisation", "max_utilisation", "gini")


@query("stream_statistics", f"WITH {STATS} SELECT stream, shard_count, hottest_shard_id, {', '.join(f'round({c}, 6) AS {c}' for c in _STAT_ROUNDED)} FROM stats")
def stream_statistics(spark, sf_dir):
    s = sh.statistics(scored(spark, sf_dir))
    return s.select("stream", "shard_count", "hottest_shard_id", *[F.round(c, 6).alias(c) for c in _STAT_ROUNDED])


@query(
    "gini_of_order_value",
    """WITH t AS (SELECT o_custkey AS customer, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS i FROM orders)
    SELECT customer, round(greatest(0, 2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*)), 6) AS gini FROM t GROUP BY 1""",
)
def gini_of_order_value(spark, sf_dir):
    orders = ad.load(spark, sf_dir, "orders")["orders"].select(F.col("o_custkey").alias("customer"), "o_totalprice")
    return sh.gini(orders, "customer", "o_totalprice").withColumn("gini", F.round("gini", 6))


@query("stream_verdicts", f"WITH {VERDICTS}, {_LACKS} SELECT j.stream, j.capacity_mode, throttled_records, verdict, verdict IN ('skew', 'mixed', 'capacity', 'bursty') AS is_problem, {_HEADLINE} AS headline, {_REMEDY} AS remedy FROM judged AS j LEFT JOIN stats AS t ON j.stream = t.stream LEFT JOIN lacks AS k ON j.stream = k.stream")
def stream_verdicts(spark, sf_dir):
    return scan(spark, sf_dir)["streams"].select("stream", "capacity_mode", "throttled_records", "verdict", "is_problem", "headline", "remedy")


@query("stream_verdict_counts", f"WITH {VERDICTS}, names AS (SELECT unnest({list(STREAM_VERDICTS)}) AS verdict) SELECT n.verdict, count(j.verdict) AS count FROM names AS n LEFT JOIN judged AS j ON n.verdict = j.verdict GROUP BY 1")
def stream_verdict_counts(spark, sf_dir):
    return scan(spark, sf_dir)["counts"]


@query("stream_problems", f"WITH {VERDICTS} SELECT stream, verdict FROM judged WHERE verdict IN ('skew', 'mixed', 'capacity', 'bursty')")
def stream_problems(spark, sf_dir):
    return st.problems(scan(spark, sf_dir)["streams"]).select("stream", "verdict")


@query("one_verdict_of_named_streams", f"WITH {VERDICTS} SELECT stream, throttled_records FROM judged WHERE verdict = 'skew' AND stream IN ('AF', 'AO', 'RF')")
def one_verdict_of_named_streams(spark, sf_dir):
    found = scan(spark, sf_dir, names=["AF", "AO", "RF"])["streams"]
    return st.with_verdict(found, "skew").select("stream", "throttled_records")


@query(
    "missing_shard_metrics",
    f"WITH stream AS ({ad.duck(ad.streams)}) SELECT stream, CASE WHEN list_contains(enabled_metrics, 'ALL') THEN '' ELSE array_to_string([x FOR x IN {_NEED} IF NOT list_contains(enabled_metrics, x)], ',') END AS missing, "
    "CASE WHEN capacity_mode = 'ON_DEMAND' THEN 'ON_DEMAND' ELSE 'PROVISIONED' END AS capacity_mode FROM stream",
)
def missing_shard_metrics(spark, sf_dir):
    s = streams(spark, sf_dir)
    return s.select(
        "stream", F.array_join(st.missing_metrics(F.col("enabled_metrics")), ",").alias("missing"),
        st.capacity_mode(F.col("capacity_mode")).alias("capacity_mode"),
    )


@query(
    "open_shards_and_resharding",
    f"WITH shard AS ({ad.duck(ad.shards)}) SELECT stream, count(*) FILTER (WHERE ending_sequence_number IS NULL) AS open_shard_count, "
    f"bool_or(ending_sequence_number IS NOT NULL OR parent_shard_id IS NOT NULL OR adjacent_parent_shard_id IS NOT NULL) AS resharded FROM shard WHERE closed_at IS NULL OR closed_at >= {_START} GROUP BY 1",
)
def open_shards_and_resharding(spark, sf_dir):
    return sh.resharding(sh.shards_in_window(shards(spark, sf_dir), ad.SKEW_START))


_HOT = f"""{SCORED}, hottest AS (SELECT stream, shard_id FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY share_of_bytes DESC, shard_id) AS i FROM scored WHERE is_open) AS h WHERE i = 1)"""


@query("hottest_open_shards", f"WITH {_HOT} SELECT stream, shard_id FROM hottest")
def hottest_open_shards(spark, sf_dir):
    return keys.hottest_open_shard(scored(spark, sf_dir))


_KEYS = f"""{_HOT}, record AS ({ad.duck(ad.stream_records)}),
  sampled AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r.stream ORDER BY ts, sequence_number, l_partkey, l_extendedprice) AS i FROM record AS r JOIN hottest AS h ON r.stream = h.stream AND r.shard_id = h.shard_id WHERE ts >= {_START}) AS x WHERE i <= 5000),
  shares AS (SELECT stream, partition_key, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY stream) AS share FROM sampled GROUP BY 1, 2)"""


def sampled(spark, sf_dir) -> DataFrame:
    records = ad.adapted(spark, sf_dir, ad.stream_records, "lineitem")
    order = ["ts", "sequence_number", "l_partkey", "l_extendedprice"]
    return keys.sample_records(records, keys.hottest_open_shard(scored(spark, sf_dir)), ad.SKEW_START, order)


@query("partition_key_shares", f"WITH {_KEYS} SELECT stream, partition_key, count, round(share, 6) AS share FROM shares")
def partition_key_shares(spark, sf_dir):
    return keys.key_shares(sampled(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query("top_partition_keys", f"WITH {_KEYS}, r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY count DESC, partition_key) AS rank FROM shares) SELECT stream, partition_key, count, round(share, 6) AS share, rank FROM r WHERE rank <= 10 AND share >= 0.01")
def top_partition_keys(spark, sf_dir):
    return keys.top_keys(sampled(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query(
    "stream_inventory",
    f"WITH stream AS ({ad.duck(ad.streams)}) SELECT stream, region, CASE WHEN capacity_mode = 'ON_DEMAND' THEN 'ON_DEMAND' ELSE 'PROVISIONED' END AS capacity_mode, CAST(length(stream) AS INT) AS open_shard_count, "
    "array_to_string(enabled_metrics, ',') AS enabled_metrics FROM stream",
)
def stream_inventory(spark, sf_dir):
    """Streams as saved describe responses and back."""
    s = streams(spark, sf_dir)
    response = F.to_json(
        F.struct(
            F.struct(
                F.col("stream").alias("StreamName"), F.length("stream").alias("OpenShardCount"),
                F.struct(F.col("capacity_mode").alias("StreamMode")).alias("StreamModeDetails"),
                F.transform("enabled_metrics", lambda m: F.struct(F.array(m).alias("ShardLevelMetrics"))).alias("EnhancedMonitoring"),
            ).alias("StreamDescriptionSummary")
        )
    )
    back = inventory.streams(s.select("region", response.alias("response")))
    return back.withColumn("enabled_metrics", F.array_join("enabled_metrics", ","))


@query(
    "shard_inventory",
    f"WITH shard AS ({ad.duck(ad.shards)}) SELECT stream, shard_id, ending_sequence_number, parent_shard_id, adjacent_parent_shard_id FROM shard",
)
def shard_inventory(spark, sf_dir):
    s = shards(spark, sf_dir)
    one = F.struct(
        F.col("shard_id").alias("ShardId"), F.col("parent_shard_id").alias("ParentShardId"),
        F.coalesce("adjacent_parent_shard_id", F.lit("")).alias("AdjacentParentShardId"),
        F.struct(F.col("ending_sequence_number").alias("EndingSequenceNumber")).alias("SequenceNumberRange"),
    )
    response = F.to_json(F.struct(F.col("stream").alias("StreamName"), F.array(one).alias("Shards")))
    return inventory.shards(s.select(response.alias("response"))).drop("closed_at")  # a response does not say when a shard was closed


@query(
    "stream_documents",
    f"""WITH {VERDICTS} SELECT j.stream, verdict, CASE WHEN verdict = 'no_shard_metrics' THEN '' ELSE coalesce((SELECT string_agg(shard_id || ':' || binding || ':' || CAST(throttled_records AS BIGINT), ',' ORDER BY shard_id) FROM scored AS s WHERE s.stream = j.stream), '') END AS shards
    FROM judged AS j""",
)
def stream_documents(spark, sf_dir):
    document = F.col("document")
    shown = F.transform(
        document["shards"], lambda s: F.concat_ws(":", s["shard_id"], s["binding"], s["throttled_records"].cast("bigint").cast("string"))
    )
    found = documents.stream_documents(scan(spark, sf_dir))
    return found.select(document["stream"].alias("stream"), document["diagnosis"]["verdict"].alias("verdict"), F.array_join(shown, ",").alias("shards"))

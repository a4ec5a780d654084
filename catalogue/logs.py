"""Queries over model invocation logs."""

from __future__ import annotations

import datetime as dt
import itertools
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.adapters import adapted, duck, invocations, load, overrides, scratch, token_prices
from meterwise.functions import text as tx
from meterwise.functions.json import leaf
from meterwise.functions.time import timestamp
from meterwise.operators import anomalies, content, costing, invocations as iv, percentiles, totals
from meterwise.operators.small import once, spread, tasks_for
from meterwise.plans.usage import group_section, usage_report
from meterwise.settings import UsageThresholds
from meterwise.sinks import documents
from meterwise.sources import logs, prices
from meterwise.sources.files import filesystem

# Thresholds that find something in the driver's events.
BURST = UsageThresholds(burst_window_seconds=86400, burst_count=6)
JUMP = UsageThresholds(burst_window_seconds=3600, jump_multiple=1.5, jump_minimum_count=5, jump_minimum_windows=5)
REPEAT = UsageThresholds(burst_window_seconds=604800, repeat_count=3)

QUERIES: dict = {}
SQL: dict[str, str] = {}

_MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


def moment(name: str):
    return F.date_format(name, _MICROS).alias(name)


def duck_moment(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


# Events are a few bytes each, and much work: tasks by their number.
_EVENTS_A_TASK = 50_000


def inv(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spread(load(spark, sf_dir, "events")["events"], _EVENTS_A_TASK)
    return spark.sql(invocations("spark").format(events="{events}"), events=events)


def costed(spark: SparkSession, sf_dir: str, with_overrides: bool = False) -> DataFrame:
    named = spark.sql(overrides("spark")) if with_overrides else None
    return costing.with_cost(inv(spark, sf_dir), spark.sql(token_prices("spark")), named)


# --- the same in SQL ------------------------------------------------------------------------------

# Which service each model id means, written out by hand.
_SERVICES = """
  SELECT * FROM (VALUES
    ('anthropic.claude-sonnet-4-20250514-v1:0', 'Claude Sonnet 4 (Amazon Bedrock Edition)', FALSE),
    ('global.anthropic.claude-haiku-4-5-20251001-v1:0', 'Claude Haiku 4.5 (Amazon Bedrock Edition)', TRUE),
    ('us.meta.llama3-1-70b-instruct-v1:0', 'Meta Llama3.1 70B Instruct', FALSE),
    ('cohere.command-r-plus-v1:0', 'Cohere Command R+ (Amazon Bedrock Edition)', FALSE)
    {extra}) AS s(model_id, service_name, is_global)"""


def _costed_sql(extra: str = "") -> str:
    kinds = ("input", "output", "cache_read", "cache_write")

    def rate(k: str) -> str:
        return f"(CASE WHEN is_global THEN coalesce(max(CASE WHEN rate_kind = '{k}_global' THEN usd_per_mtok END), max(CASE WHEN rate_kind = '{k}' THEN usd_per_mtok END)) ELSE max(CASE WHEN rate_kind = '{k}' THEN usd_per_mtok END) END) AS rate_{k}"

    missing = ", ".join(f"CASE WHEN coalesce({k}_tokens, 0) > 0 AND rate_{k} IS NULL THEN '{k}' END" for k in kinds)
    charge = " + ".join(f"CASE WHEN coalesce({k}_tokens, 0) > 0 THEN CAST({k}_tokens AS DECIMAL(18,0)) * rate_{k} ELSE 0 END" for k in kinds)
    return f"""
    inv AS ({duck(invocations)}),
    price AS ({token_prices('duck')}),
    service AS ({_SERVICES.format(extra=extra)}),
    rates AS (
      SELECT region, model_id, p.service_name, {', '.join(rate(k) for k in kinds)}
      FROM price AS p JOIN service AS s ON p.service_name = s.service_name GROUP BY region, model_id, p.service_name, is_global),
    joined AS (
      SELECT inv.*, r.service_name, [x FOR x IN [{missing}] IF x IS NOT NULL] AS lacking, ({charge}) AS micro,
        inv.region IN (SELECT region FROM price) AS region_priced
      FROM inv LEFT JOIN rates AS r ON inv.region = r.region AND inv.model_id = r.model_id),
    costed AS (
      SELECT *, CASE WHEN service_name IS NOT NULL AND len(lacking) = 0
          THEN CAST(CAST(round(micro, 0) AS DECIMAL(24,0)) * 0.000001 AS DECIMAL(20,6)) END AS cost_usd,
        CASE WHEN NOT region_priced THEN 'region without rates: ' || region
          WHEN service_name IS NULL THEN 'not on the price list of ' || region || ': ' || model_id
          WHEN len(lacking) > 0 THEN 'price list of ' || region || ' lacks a rate for ' || array_to_string(lacking, ', ') END AS no_price_reason
      FROM joined)"""


COSTED = _costed_sql()
_IDENTITY = "CASE WHEN identity_arn = '' THEN '<no identity recorded>' ELSE identity_arn END"


def _totals_sql(keys: str, group: str) -> str:
    return f"""
    SELECT {keys} count(*) AS requests, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens,
      CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens,
      CAST(sum(coalesce(cache_read_tokens, 0)) AS BIGINT) AS cache_read_tokens,
      CAST(sum(coalesce(cache_write_tokens, 0)) AS BIGINT) AS cache_write_tokens,
      CAST(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0) + coalesce(cache_read_tokens, 0) + coalesce(cache_write_tokens, 0)) AS BIGINT) AS total_tokens,
      CAST(coalesce(sum(cost_usd), 0) AS DOUBLE) AS cost_usd,
      CAST(count(*) FILTER (WHERE cost_usd IS NULL) AS BIGINT) AS unpriced_requests,
      count(*) FILTER (WHERE cost_usd IS NULL) = 0 AS cost_is_complete
    FROM costed {group}"""


def money(table: DataFrame, *names: str) -> DataFrame:
    return table.withColumns({n: F.col(n).cast("double") for n in names or ("cost_usd",)})


# --- totals ---------------------------------------------------------------------------------------


@query("usage_totals", f"WITH {COSTED} {_totals_sql('', '')}")
def usage_totals(spark, sf_dir):
    return money(totals.grand_total(costed(spark, sf_dir)))


@query("usage_by_model", f"WITH {COSTED} {_totals_sql('model_id AS key,', 'GROUP BY 1')}")
def usage_by_model(spark, sf_dir):
    return money(totals.by_model(costed(spark, sf_dir)))


@query("usage_by_identity", f"WITH {COSTED} {_totals_sql(_IDENTITY + ' AS key,', 'GROUP BY 1')}")
def usage_by_identity(spark, sf_dir):
    return money(totals.by_identity(costed(spark, sf_dir)))


_HOUR = "strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S+00:00')"
_DAY = "strftime(ts, '%Y-%m-%d')"


@query("usage_by_hour", f"WITH {COSTED} {_totals_sql(_HOUR + ' AS key,', 'GROUP BY 1')}")
def usage_by_hour(spark, sf_dir):
    return money(totals.by_hour(costed(spark, sf_dir)))


@query("usage_by_day", f"WITH {COSTED} {_totals_sql(_DAY + ' AS key,', 'GROUP BY 1')}")
def usage_by_day(spark, sf_dir):
    return money(totals.by_day(costed(spark, sf_dir)))


@query(
    "usage_by_any_key",
    f"WITH {COSTED} {_totals_sql(chr(39) + '' + chr(39) + ' || region || ' + chr(39) + '/' + chr(39) + ' || operation AS key,', 'GROUP BY 1')}",
)
def usage_by_any_key(spark, sf_dir):
    return money(totals.grouped(costed(spark, sf_dir), F.concat_ws("/", "region", "operation")))


_SETS = " UNION ALL ".join(
    _totals_sql(f"'{name}' AS grouping, {key} AS key,", f"GROUP BY {key}" if key != "'all'" else "")
    for name, key in (("all", "'all'"), ("model", "model_id"), ("identity", _IDENTITY), ("hour", _HOUR), ("day", _DAY))
)


@query("usage_all_groupings", f"WITH {COSTED} {_SETS}")
def usage_all_groupings(spark, sf_dir):
    return money(totals.all_groupings(costed(spark, sf_dir)))


@query(
    "usage_window",
    f"WITH inv AS ({duck(invocations)}), w AS (SELECT min(ts) AS window_start, max(ts) AS window_end FROM inv) "
    f"SELECT {duck_moment('window_start')}, {duck_moment('window_end')} FROM w",
)
def usage_window(spark, sf_dir):
    return totals.covered_window(inv(spark, sf_dir)).select(moment("window_start"), moment("window_end"))


@query(
    "most_expensive_requests",
    f"WITH {COSTED} SELECT request_id, model_id, CAST(cost_usd AS DOUBLE) AS cost_usd FROM costed WHERE cost_usd IS NOT NULL "
    "ORDER BY costed.cost_usd DESC, request_id LIMIT 10",
)
def most_expensive_requests(spark, sf_dir):
    return money(totals.most_expensive(costed(spark, sf_dir), 10)).select("request_id", "model_id", "cost_usd")


# --- cost -----------------------------------------------------------------------------------------

_COST_COLUMNS = "request_id, service_name, CAST(cost_usd AS DOUBLE) AS cost_usd, no_price_reason"


@query("invocation_cost", f"WITH {COSTED} SELECT {_COST_COLUMNS} FROM costed")
def invocation_cost(spark, sf_dir):
    return money(costed(spark, sf_dir)).select("request_id", "service_name", "cost_usd", "no_price_reason")


_EXTRA = ", ('stability.image-core-v2:0', 'Stable Image Core', FALSE)"


@query("invocation_cost_with_overrides", f"WITH {_costed_sql(_EXTRA)} SELECT {_COST_COLUMNS} FROM costed")
def invocation_cost_with_overrides(spark, sf_dir):
    return money(costed(spark, sf_dir, True)).select("request_id", "service_name", "cost_usd", "no_price_reason")


@query("unpriced_models", f"WITH {COSTED} SELECT DISTINCT model_id FROM costed WHERE cost_usd IS NULL")
def unpriced_models(spark, sf_dir):
    return costing.unpriced_models(costed(spark, sf_dir))


_RAW_ID = (
    "(CASE event_id % 7 WHEN 0 THEN ' us.' WHEN 1 THEN 'EU.' WHEN 2 THEN 'global.' WHEN 3 THEN 'us-gov.' WHEN 4 THEN 'apac.' "
    "WHEN 5 THEN 'arn:aws:bedrock:us-east-1::foundation-model/' ELSE '' END) || "
    "(CASE event_type WHEN 'click' THEN 'anthropic.Claude-3-5-sonnet-20241022-v2:0' WHEN 'view' THEN 'meta.llama3_1-70b-v1:0' "
    "WHEN 'error' THEN 'anthropic' WHEN 'signup' THEN 'cohere.command-r-plus-v1:0 ' ELSE '20250101.v1-' || event_id END)"
)


@query(
    "model_keys",
    f"""WITH ids AS (SELECT DISTINCT {_RAW_ID} AS model_id FROM events),
    bare AS (SELECT model_id, lower(trim(model_id)) AS t FROM ids),
    cut AS (SELECT model_id, t, regexp_replace(t, '^(us-gov|global|apac|us|eu)\\.', '') AS u FROM bare),
    parts AS (SELECT model_id, t, [x FOR x IN string_split_regex(string_split(list_extract(string_split(u, '/'), -1), ':')[1], '[.\\-_]') IF x <> ''] AS p FROM cut),
    kept AS (SELECT model_id, t, list_concat(p[1:1], [x FOR x IN p[2:] IF NOT regexp_full_match(x, '[0-9]{{8}}') AND x <> 'v1']) AS p FROM parts)
    SELECT model_id, array_to_string(CASE WHEN p[1] = 'anthropic' THEN p[2:] ELSE p END, ' ') AS model_key,
      CASE WHEN t LIKE 'global.%' THEN 'global' ELSE 'regional' END AS scope FROM kept""",
)
def model_keys(spark, sf_dir):
    ids = adapted(spark, sf_dir, lambda d: f"SELECT DISTINCT {_RAW_ID} AS model_id FROM {{events}}", "events")
    return ids.select(
        "model_id", tx.model_key(F.col("model_id")).alias("model_key"), tx.model_scope(F.col("model_id")).alias("scope")
    )


_RAW_NAME = (
    "p_brand || (CASE p_size % 4 WHEN 0 THEN ' Model ' WHEN 1 THEN '+' WHEN 2 THEN ' (Text)/' ELSE ' Model-V2 ' END) || p_type || "
    "(CASE WHEN p_size % 3 = 0 THEN ' (Amazon Bedrock Edition)' ELSE '' END)"
)


@query(
    "service_name_keys",
    f"""WITH names AS (SELECT DISTINCT {_RAW_NAME} AS service_name FROM part),
    bare AS (SELECT service_name, replace(regexp_replace(lower(trim(service_name)), ' *\\(amazon bedrock edition\\)$', ''), '+', ' plus ') AS t FROM names)
    SELECT service_name, array_to_string([x FOR x IN string_split_regex(t, '[\\s.\\-_/()]+') IF x <> '' AND x <> 'model'], ' ') AS service_key FROM bare""",
)
def service_name_keys(spark, sf_dir):
    names = adapted(spark, sf_dir, lambda d: f"SELECT DISTINCT {_RAW_NAME} AS service_name FROM {{part}}", "part")
    return names.select("service_name", tx.service_key(F.col("service_name")).alias("service_key"))


# --- distributions --------------------------------------------------------------------------------

_LONG = """long AS (
      SELECT model_id, 'input' AS direction, input_tokens AS tokens, request_id FROM inv WHERE input_tokens IS NOT NULL
      UNION ALL SELECT model_id, 'output', output_tokens, request_id FROM inv WHERE output_tokens IS NOT NULL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY model_id, direction ORDER BY tokens) AS rn,
      count(*) OVER (PARTITION BY model_id, direction) AS n FROM long)"""


def _at(p: float) -> str:
    return f"max(CASE WHEN rn = CAST(ceil({p} * n) AS BIGINT) THEN tokens END)"


@query(
    "token_percentiles",
    f"""WITH inv AS ({duck(invocations)}), {_LONG}
    SELECT model_id, direction, count(*) AS requests, {_at(0.5)} AS p50, {_at(0.95)} AS p95, {_at(0.99)} AS p99,
      max(tokens) AS max_tokens, count(*) >= 20 AS sample_is_meaningful FROM ranked GROUP BY 1, 2""",
)
def token_percentiles(spark, sf_dir):
    return percentiles.percentiles(inv(spark, sf_dir))


@query(
    "token_outliers",
    f"""WITH inv AS ({duck(invocations)}), {_LONG},
    cut AS (SELECT model_id, direction, {_at(0.99)} AS cutoff FROM ranked GROUP BY 1, 2 HAVING count(*) >= 20)
    SELECT request_id, l.model_id, l.direction AS kind, tokens, cutoff FROM long AS l JOIN cut AS c
      ON l.model_id = c.model_id AND l.direction = c.direction WHERE tokens > cutoff""",
)
def token_outliers(spark, sf_dir):
    return percentiles.outliers(inv(spark, sf_dir)).select("request_id", "model_id", "kind", "tokens", "cutoff")


# --- call patterns --------------------------------------------------------------------------------


def _span_sql(keys: str, width: int, needed: int) -> str:
    """Every call that completes a dense window, with the window's start, size and cost."""
    return f"""
    ev AS (SELECT {_IDENTITY} AS identity, model_id, input_tokens, ts, epoch_us(ts) AS us, source, request_id, coalesce(cost_usd, 0) AS cost FROM costed),
    num AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY us, source, request_id) AS rn,
      sum(cost) OVER (PARTITION BY {keys} ORDER BY us, source, request_id ROWS UNBOUNDED PRECEDING) AS running FROM ev),
    win AS (SELECT *, min(rn) OVER (PARTITION BY {keys} ORDER BY us RANGE BETWEEN {width * 1000000} PRECEDING AND CURRENT ROW) AS first_rn,
      min(us) OVER (PARTITION BY {keys} ORDER BY us RANGE BETWEEN {width * 1000000} PRECEDING AND CURRENT ROW) AS first_us FROM num),
    cand AS (SELECT w.*, w.rn - w.first_rn + 1 AS n, w.running - s.running + s.cost AS span_cost, s.ts AS first_ts
      FROM win AS w JOIN num AS s ON {' AND '.join(f'w.{k.strip()} = s.{k.strip()}' for k in keys.split(','))} AND s.rn = w.first_rn
      WHERE w.rn - w.first_rn + 1 >= {needed})"""


_BURST_SQL = f"""
    {_span_sql('identity', BURST.burst_window_seconds, BURST.burst_count)},
    ordered AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY rn) AS i FROM cand),
    walk AS (
      SELECT *, TRUE AS taken, us AS until FROM ordered WHERE i = 1
      UNION ALL
      SELECT o.*, o.first_us > w.until, CASE WHEN o.first_us > w.until THEN o.us ELSE w.until END
      FROM walk AS w JOIN ordered AS o ON o.identity = w.identity AND o.i = w.i + 1)
    SELECT 'burst' AS kind, identity AS identity_arn, strftime(first_ts, '%Y-%m-%d %H:%M:%S.%f') AS window_start,
      strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS window_end, n AS request_count, CAST(span_cost AS DOUBLE) AS cost_usd,
      CAST(NULL AS VARCHAR) AS model_id, n || ' calls within {BURST.burst_window_seconds}s; the threshold is {BURST.burst_count}' AS detail FROM walk WHERE taken"""
_ANOMALY = ("kind", "identity_arn", "window_start", "window_end", "request_count", "cost_usd", "model_id", "detail")


def _plain(found: DataFrame) -> DataFrame:
    shown = found.withColumns({c: F.date_format(c, _MICROS) for c in ("window_start", "window_end")})
    return money(shown).select(*_ANOMALY)


@query("bursts", f"WITH RECURSIVE {COSTED}, {_BURST_SQL}")
def bursts(spark, sf_dir):
    return _plain(anomalies.bursts(costed(spark, sf_dir), BURST))


_JUMP_SQL = f"""
    slots AS (SELECT {_IDENTITY} AS identity, epoch_us(ts) // {JUMP.burst_window_seconds * 1000000} AS slot, count(*) AS n, sum(coalesce(cost_usd, 0)) AS cost
      FROM costed GROUP BY 1, 2),
    base AS (SELECT *, median(n) OVER (PARTITION BY identity) AS usual, count(*) OVER (PARTITION BY identity) AS windows FROM slots)
    SELECT 'rate_jump' AS kind, identity AS identity_arn,
      strftime(make_timestamp(slot * {JUMP.burst_window_seconds * 1000000}), '%Y-%m-%d %H:%M:%S.%f') AS window_start,
      strftime(make_timestamp((slot + 1) * {JUMP.burst_window_seconds * 1000000}), '%Y-%m-%d %H:%M:%S.%f') AS window_end,
      n AS request_count, CAST(cost AS DOUBLE) AS cost_usd, CAST(NULL AS VARCHAR) AS model_id,
      n || ' calls where a usual window has ' || format('{{:.6g}}', CAST(usual AS DOUBLE)) || ': ' || CAST(round_even(n / usual, 0) AS BIGINT) || '-fold' AS detail
    FROM base WHERE windows >= {JUMP.jump_minimum_windows} AND n >= {JUMP.jump_minimum_count} AND n / usual >= {JUMP.jump_multiple}"""


def by_model_caller(table: DataFrame) -> DataFrame:
    """Treat each model as one caller, so that the driver's thin traffic has baselines."""
    return table.withColumn("identity_arn", F.col("model_id"))


_CALLER = COSTED.replace("costed AS (", "own AS (") + ", costed AS (SELECT * REPLACE (model_id AS identity_arn) FROM own)"


@query("rate_jumps", f"WITH {_CALLER}, {_JUMP_SQL}")
def rate_jumps(spark, sf_dir):
    return _plain(anomalies.rate_jumps(by_model_caller(costed(spark, sf_dir)), JUMP))


def _shape_detail(width: int) -> str:
    return f"n || ' calls to ' || model_id || ' with the same input size of ' || format('{{:,}}', input_tokens) || ' tokens within {width}s'"


# Token counts in fives, so that sizes repeat.
_COARSE = COSTED.replace("costed AS (", "own AS (") + ", costed AS (SELECT * REPLACE (input_tokens // 50 * 50 AS input_tokens) FROM own WHERE input_tokens IS NOT NULL)"
_REPEAT_SQL = f"""
    {_span_sql('identity, model_id, input_tokens', REPEAT.burst_window_seconds, REPEAT.repeat_count)},
    firsts AS (SELECT *, row_number() OVER (PARTITION BY identity, model_id, input_tokens ORDER BY rn) AS i FROM cand)
    SELECT 'repeated_shape' AS kind, identity AS identity_arn, strftime(first_ts, '%Y-%m-%d %H:%M:%S.%f') AS window_start,
      strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS window_end, n AS request_count, CAST(span_cost AS DOUBLE) AS cost_usd, model_id,
      {_shape_detail(REPEAT.burst_window_seconds)} AS detail
    FROM firsts WHERE i = 1"""


def coarse(table: DataFrame) -> DataFrame:
    return table.withColumn("input_tokens", F.floor(F.col("input_tokens") / 50) * 50)


@query("repeated_shapes", f"WITH {_COARSE}, {_REPEAT_SQL}")
def repeated_shapes(spark, sf_dir):
    return _plain(anomalies.repeated_shapes(coarse(costed(spark, sf_dir)), REPEAT))


@query(
    "anomalies_with_rates",
    f"""WITH RECURSIVE {COSTED}, b AS (WITH RECURSIVE {_BURST_SQL.strip()}), j AS (WITH {_JUMP_SQL.strip().replace(str(JUMP.burst_window_seconds * 1000000), str(BURST.burst_window_seconds * 1000000)).replace(f'>= {JUMP.jump_minimum_count} ', f'>= {BURST.jump_minimum_count} ').replace(f'>= {JUMP.jump_multiple}', f'>= {BURST.jump_multiple}')}),
    r AS (WITH {_span_sql('identity, model_id, input_tokens', BURST.burst_window_seconds, 2)},
      firsts AS (SELECT *, row_number() OVER (PARTITION BY identity, model_id, input_tokens ORDER BY rn) AS i FROM cand)
      SELECT 'repeated_shape' AS kind, identity AS identity_arn, strftime(first_ts, '%Y-%m-%d %H:%M:%S.%f') AS window_start,
        strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS window_end, n AS request_count, CAST(span_cost AS DOUBLE) AS cost_usd, model_id,
        {_shape_detail(BURST.burst_window_seconds)} AS detail FROM firsts WHERE i = 1 AND input_tokens IS NOT NULL),
    every AS (SELECT * FROM b UNION ALL SELECT * FROM j UNION ALL SELECT * FROM r),
    timed AS (SELECT *, (epoch_us(CAST(window_end AS TIMESTAMP)) - epoch_us(CAST(window_start AS TIMESTAMP))) / 1000000.0 AS d FROM every)
    SELECT kind, identity_arn, window_start, window_end, request_count, cost_usd, model_id, detail, round(d, 3) AS duration_seconds,
      round(CASE WHEN d <= 0 THEN request_count ELSE request_count / (d / 60) END, 4) AS calls_per_minute FROM timed""",
)
def anomalies_with_rates(spark, sf_dir):
    thresholds = UsageThresholds(
        burst_window_seconds=BURST.burst_window_seconds, burst_count=BURST.burst_count, repeat_count=2
    )
    found = anomalies.with_rates(anomalies.detect(costed(spark, sf_dir), thresholds))
    shown = found.withColumns({c: F.date_format(c, _MICROS) for c in ("window_start", "window_end")})
    return money(shown).select(
        *_ANOMALY, F.round("duration_seconds", 3).alias("duration_seconds"),
        F.round("calls_per_minute", 4).alias("calls_per_minute"),
    )


# --- reading and parsing --------------------------------------------------------------------------

_BODY = "named_struct('messages', 'secret ' || request_id)"
_METRICS = "map('amazon-bedrock-invocationMetrics', named_struct('invocationLatency', invocation_latency_ms, 'firstByteLatency', first_byte_latency_ms))"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invocations as raw log lines, with a bad line for every fiftieth event of each kind."""
    rows = inv(spark, sf_dir).withColumn("n", F.substring("source", F.lit(8), F.lit(20)).cast("bigint"))
    stamp = F.when(F.col("n") % 4 == 0, F.unix_micros("ts") / 1e6).when(F.col("n") % 4 == 1, F.unix_micros("ts") / 1000.0)
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    record = F.expr(
        f"""to_json(named_struct('schemaType', 'ModelInvocationLog', 'schemaVersion', '1.0', 'timestamp', '@@', 'accountId', account_id,
        'region', region, 'requestId', request_id, 'operation', operation, 'modelId', model_id, 'identity', named_struct('arn', identity_arn),
        'errorCode', error_code,
        'input', named_struct('inputTokenCount', input_tokens, 'cacheReadInputTokenCount', cache_read_tokens, 'cacheWriteInputTokenCount', cache_write_tokens, 'inputBodyJson', {_BODY}),
        'output', named_struct('outputTokenCount', output_tokens, 'outputBodyJson', {_METRICS})))"""
    )
    when = F.when(stamp.isNotNull(), F.format_string("%.6f", stamp)).otherwise(
        F.concat(F.lit('"'), iso, F.when(F.col("n") % 4 == 2, "Z").otherwise(""), F.lit('"'))
    )
    line = F.replace(record, F.lit('"@@"'), when)
    bad = (
        F.when(F.col("n") % 50 == 1, F.substring(line, F.lit(1), F.length(line) - 1))
        .when(F.col("n") % 50 == 2, F.concat(F.lit("["), line, F.lit("]")))
        .when(F.col("n") % 50 == 3, F.replace(line, F.lit("ModelInvocationLog"), F.lit("OtherLog")))
        .when(F.col("n") % 50 == 4, F.replace(line, F.lit('"1.0"'), F.lit('"2.0"')))
        .when(F.col("n") % 50 == 5, F.replace(line, F.concat(F.lit('"timestamp":'), when), F.lit('"timestamp":null')))
        .when(F.col("n") % 50 == 6, F.replace(line, F.concat(F.lit('"timestamp":'), when), F.lit('"timestamp":"yesterday"')))
        .when(F.col("n") % 50 == 7, F.replace(line, F.col("model_id"), F.lit(" ")))
        .when(F.col("n") % 50 == 8, F.regexp_replace(line, 'TokenCount":([0-9]+)', 'TokenCount":"$1"'))
        .when(F.col("n") % 50 == 9, F.lit("null"))
        .otherwise(line)
    )
    return once(
        rows, F.col("source").alias("source"), F.col("source").alias("path"), F.lit(0).alias("position"), bad.alias("line")
    )


_ISSUE = """CASE event_id % 50 WHEN 1 THEN 'bad_json' WHEN 2 THEN 'not_a_record' WHEN 3 THEN 'wrong_schema_type' WHEN 4 THEN 'unsupported_schema_version'
      WHEN 5 THEN 'missing_timestamp' WHEN 6 THEN 'bad_timestamp' WHEN 7 THEN 'missing_model_id' WHEN 9 THEN 'not_a_record'
      WHEN 8 THEN CASE WHEN event_id % 97 <> 0 THEN 'missing_token_counts' END END"""


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.parse(logs.decode_lines(log_lines(spark, sf_dir)))


_PARSED = f"tagged AS (SELECT CAST(substring(source, 8) AS BIGINT) AS event_id, i.* FROM ({duck(invocations)}) AS i), issues AS (SELECT *, {_ISSUE} AS issue_kind FROM tagged)"


@query(
    "parsed_invocations",
    f"WITH {_PARSED} SELECT * EXCLUDE (ts, event_id, issue_kind) REPLACE (CASE WHEN event_id % 50 = 8 THEN NULL ELSE cache_read_tokens END AS cache_read_tokens, "
    f"CASE WHEN event_id % 50 = 8 THEN NULL ELSE cache_write_tokens END AS cache_write_tokens), {duck_moment('ts')} FROM issues WHERE issue_kind IS NULL",
)
def parsed_invocations(spark, sf_dir):
    return iv.usable(parsed(spark, sf_dir)).withColumn("ts", F.date_format("ts", _MICROS))


@query(
    "skipped_records",
    f"WITH {_PARSED} SELECT issue_kind AS kind, source, CASE issue_kind WHEN 'bad_json' THEN 'the line is not one JSON value' ELSE '' END AS detail FROM issues WHERE issue_kind IS NOT NULL",
)
def skipped_records(spark, sf_dir):
    return iv.issues(parsed(spark, sf_dir)).select("kind", "source", "detail")


@query("skipped_record_counts", f"WITH {_PARSED} SELECT issue_kind AS kind, count(*) AS records FROM issues WHERE issue_kind IS NOT NULL GROUP BY 1")
def skipped_record_counts(spark, sf_dir):
    return iv.issue_counts(parsed(spark, sf_dir))


@query(
    "usable_share",
    f"WITH {_PARSED} SELECT count(*) FILTER (WHERE issue_kind IS NULL) AS records, count(*) AS total_seen, "
    "round(count(*) FILTER (WHERE issue_kind IS NULL) / count(*), 6) AS usable_fraction FROM issues",
)
def usable_share(spark, sf_dir):
    return iv.usable_share(parsed(spark, sf_dir)).withColumn("usable_fraction", F.round("usable_fraction", 6))


@query(
    "invocation_derived_fields",
    f"WITH inv AS ({duck(invocations)}) SELECT request_id, {_HOUR} AS hour, {_DAY} AS day, "
    "coalesce(input_tokens, 0) + coalesce(output_tokens, 0) + coalesce(cache_read_tokens, 0) + coalesce(cache_write_tokens, 0) AS total_tokens, "
    "input_tokens IS NOT NULL OR output_tokens IS NOT NULL AS has_token_counts, coalesce(input_tokens, 0) AS billable_input FROM inv",
)
def invocation_derived_fields(spark, sf_dir):
    return iv.with_derived(inv(spark, sf_dir)).select(
        "request_id", F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ssxxx").alias("hour"), F.col("day").cast("string").alias("day"),
        "total_tokens", "has_token_counts", "billable_input",
    )


_FILE = 250


def log_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of files of 249 records: lines, an array, lines with bad ones between; and files of one record over two lines."""
    n, first = F.col("n"), F.col("n") % _FILE == 1
    form = F.floor(n / _FILE) % 3
    rows = inv(spark, sf_dir).select(
        F.substring("source", F.lit(8), F.lit(20)).cast("bigint").alias("n"),
        F.to_json(F.struct(F.lit("ModelInvocationLog").alias("schemaType"), F.col("request_id").alias("requestId"))).alias("line"),
    )
    last = n % _FILE == _FILE - 1
    alone = n % _FILE == 0
    lines = (
        F.when(alone, F.replace("line", F.lit(","), F.lit(",\n  ")))
        .when(form == 0, F.col("line"))
        .when(form == 1, F.concat(F.when(first, " [\n").otherwise(""), "line", F.when(last, "]").otherwise(",")))
        .otherwise(F.concat(F.lit("\r\n"), "line", F.lit("\r\n{oops")))
    )
    name = F.concat(F.when(alone, "record").otherwise("file"), F.when(alone, n).otherwise(F.floor(n / _FILE)).cast("string"))
    folder = scratch(spark)
    # the work is that of the files, two for 250 events
    tasks = tasks_for(load(spark, sf_dir, "events")["events"].count(), 40 * _FILE)
    dealt = rows.select(name.alias("name"), "n", lines.alias("value")).repartition(tasks, "name").sortWithinPartitions("name", "n")
    dealt.select("name", "value").mapInArrow(_placed(folder), "files long").agg(F.sum("files")).collect()
    return folder


def _placed(folder: str):
    """Rows (name, value), sorted by name, as the lines of a file of each name, which the task itself puts in place."""

    def named(batches):
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns))

    def write(batches):
        system, root = filesystem(folder)
        part, number = f"part-{TaskContext.get().partitionId():05d}", 0
        for name, rows in itertools.groupby(named(batches), lambda row: row[0]):
            home = f"{root}/name={'__HIVE_DEFAULT_PARTITION__' if name is None else name}"
            system.create_dir(home)
            # another attempt may write the same file: whole ones only bear its name
            draft = f"{home}/{part}.{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as file:
                for _, value in rows:
                    file.write(f"{value or ''}\n".encode())
            system.move(draft, f"{home}/{part}.txt")
            number += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([number], pa.int64())})

    return write


@query(
    "log_layouts",
    f"""WITH n AS (SELECT event_id AS n, event_id // {_FILE} AS f, event_id % {_FILE} AS i, 'r' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS request_id,
        -- the last file of arrays has no end if it is not full: it is read by line
        event_id // {_FILE} % 3 = 1 AND max(event_id % {_FILE}) OVER (PARTITION BY event_id // {_FILE}) < {_FILE} - 1 AS cut
      FROM events)
    SELECT 'file' || f || '#' || CASE WHEN cut THEN i + 1 WHEN f % 3 = 2 THEN 3 * i - 1 ELSE i END AS source, CASE WHEN cut THEN i + 1 WHEN f % 3 = 2 THEN 3 * i - 1 ELSE i END AS position,
      CASE WHEN NOT cut THEN request_id END AS request_id, CASE WHEN cut THEN 'bad_json' END AS issue_kind FROM n WHERE i <> 0
    UNION ALL SELECT 'record' || n, 0, request_id, NULL FROM n WHERE i = 0
    UNION ALL SELECT 'file' || f || '#' || (3 * i), 3 * i, NULL, 'bad_json' FROM n WHERE f % 3 = 2 AND i <> 0
    UNION ALL SELECT 'file' || f || '#1', 1, NULL, 'bad_json' FROM n WHERE cut AND i = 1""",
)
def log_layouts(spark, sf_dir):
    records = logs.read_records(spark, log_folder(spark, sf_dir), (".txt",))
    name, number = F.regexp_extract("source", "name=([a-z0-9]+)/", 1), F.regexp_extract("source", "#[0-9]+$", 0)
    return records.select(
        F.concat(name, number).alias("source"), "position", F.try_variant_get("raw", "$.requestId", "string").alias("request_id"), "issue_kind"
    )


_STAMPS = """CASE event_id % 12 WHEN 0 THEN '"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z"' WHEN 1 THEN '"' || strftime(ts, '%Y-%m-%d') || '"'
  WHEN 2 THEN '"' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '"' WHEN 3 THEN '"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00"'
  WHEN 4 THEN CAST(epoch(ts)::BIGINT AS VARCHAR) WHEN 5 THEN CAST(epoch_ms(ts) AS VARCHAR) WHEN 6 THEN 'true' WHEN 7 THEN '"2024-02-30T00:00:00"'
  WHEN 8 THEN '"  "' WHEN 9 THEN '"' || strftime(ts, '%Y%m%dT%H%M%S') || 'Z"' WHEN 10 THEN '"' || strftime(ts, '%Y-%m-%dT%H:%M') || '-0130"' ELSE '"soon"' END"""
_WANTED = """CASE event_id % 12 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN ts WHEN 3 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
  WHEN 4 THEN date_trunc('second', ts) WHEN 5 THEN date_trunc('millisecond', ts) WHEN 9 THEN date_trunc('second', ts) WHEN 10 THEN date_trunc('minute', ts) + INTERVAL 90 MINUTE END"""


@query(
    "tolerant_timestamps",
    f"WITH w AS (SELECT event_id, {_WANTED} AS ts FROM (SELECT event_id, ts FROM events) AS e) SELECT event_id, {duck_moment('ts')} FROM w",
)
def tolerant_timestamps(spark, sf_dir):
    e = load(spark, sf_dir, "events")["events"].select("event_id", F.col("ts").cast("timestamp").alias("ts"))

    def shown(pattern: str, tail: str = ""):
        return F.concat(F.lit('"'), F.date_format("ts", pattern), F.lit(tail + '"'))

    forms = [
        shown("yyyy-MM-dd'T'HH:mm:ss", "Z"), shown("yyyy-MM-dd"), shown("yyyy-MM-dd HH:mm:ss.SSSSSS"),
        shown("yyyy-MM-dd'T'HH:mm:ss", "+02:00"), F.unix_seconds("ts").cast("string"), F.unix_millis("ts").cast("string"),
        F.lit("true"), F.lit('"2024-02-30T00:00:00"'), F.lit('"  "'), shown("yyyyMMdd'T'HHmmss", "Z"),
        shown("yyyy-MM-dd'T'HH:mm", "-0130"), F.lit('"soon"'),
    ]
    stamp = F.get(F.array(*forms), (F.col("event_id") % 12).cast("int"))
    raw = F.parse_json(F.concat(F.lit('{"timestamp":'), stamp, F.lit("}")))
    return e.select("event_id", raw.alias("raw")).select(
        "event_id", F.date_format(timestamp(leaf(F.col("raw"), "$.timestamp")), _MICROS).alias("ts")
    )


@query(
    "redacted_records",
    f"""WITH {_PARSED} SELECT source, 'secret' AS word, FALSE AS leaked, 2 AS marks FROM issues WHERE event_id % 50 NOT IN (1, 2, 9)""",
)
def redacted_records(spark, sf_dir):
    hidden = iv.redact(logs.decode_lines(log_lines(spark, sf_dir)))
    return hidden.select(
        "source", F.lit("secret").alias("word"), F.contains("redacted", F.lit("secret")).alias("leaked"),
        (F.size(F.split("redacted", "<redacted>")) - 1).alias("marks"),
    )


@query(
    "content_of_requests",
    f"""WITH {_PARSED} SELECT request_id, source, CASE WHEN event_id % 50 = 7 THEN ' ' ELSE model_id END AS model_id, '{{"messages":"secret ' || request_id || '"}}' AS input_body
    FROM issues JOIN (SELECT DISTINCT 'r' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS request_id FROM lineitem WHERE l_quantity = 50) AS w USING (request_id)
    WHERE event_id % 50 NOT IN (1, 2, 3, 9)""",
)
def content_of_requests(spark, sf_dir):
    wanted = adapted(spark, sf_dir, lambda d: "SELECT 'r' || lpad(CAST(l_orderkey AS STRING), 10, '0') AS request_id FROM {lineitem} WHERE l_quantity = 50", "lineitem")
    found = content.fetch(logs.decode_lines(log_lines(spark, sf_dir)), wanted)
    return found.select("request_id", "source", "model_id", "input_body")


_ROUND_TRIP = [c for c in iv.COLUMNS if c not in ("source", "ts")]


@query(
    "log_files_round_trip",
    f"WITH {_PARSED} SELECT coalesce(issue_kind, 'usable') AS outcome, CASE WHEN issue_kind IS NULL THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS ts, "
    + ", ".join(
        f"CASE WHEN issue_kind IS NULL{' AND event_id % 50 <> 8' if c.startswith('cache_') else ''} THEN {c} END AS {c}" for c in _ROUND_TRIP
    )
    + " FROM issues",
)
def log_files_round_trip(spark, sf_dir):
    """Writes the lines as compressed files, reads the folder back whatever its layout, and returns every record."""
    folder = scratch(spark)
    log_lines(spark, sf_dir).select("line").write.option("compression", "gzip").text(folder)
    back = iv.parse(logs.read_records(spark, folder)).withColumn("ts", F.date_format("ts", _MICROS))
    usable = F.col("issue_kind").isNull()
    return back.select(F.coalesce("issue_kind", F.lit("usable")).alias("outcome"), *[F.when(usable, F.col(c)).alias(c) for c in ("ts", *_ROUND_TRIP)])


# --- price lists ----------------------------------------------------------------------------------


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offer documents of one product each, derived from the parts."""
    part = load(spark, sf_dir, "part")["part"]
    sku = F.concat(F.lit("SKU"), F.col("p_partkey").cast("string"))
    usage = F.concat(
        F.lit("USE1-"), F.regexp_replace("p_name", " ", ""),
        F.get(F.array(*[F.lit(x) for x in ("_InputTokenCount", "_OutputTokenCount", "_CacheReadInputTokenCount_Global", "_InputTokenCountBatch", "_OutputTokenCount_Global", "ServerlessInf:Mem-4GB", "_CacheWriteInputTokenCount")]), (F.col("p_partkey") % 7).cast("int")),
        F.when(F.col("p_partkey") % 7 != 5, "-Units").otherwise(""),
    )
    attributes = F.create_map(
        F.lit("usagetype"), usage, F.lit("servicename"), F.concat(F.col("p_brand"), F.lit(" ")),
        F.lit("component"), F.when(F.col("p_partkey") % 5 == 0, "Hosting").otherwise("Training"),
        F.lit("instanceName"), F.concat(F.when(F.col("p_size") % 3 == 0, "m5.").otherwise("ml.m5."), F.col("p_size").cast("string"), F.lit("xlarge-Hosting")),
    )
    unit = F.when(F.col("p_partkey") % 7 == 5, "Seconds").when(F.col("p_size") % 10 == 9, "Hrs").otherwise("1M tokens")
    price = F.create_map(F.lit("USD"), F.format_string("%.8f", F.col("p_retailprice") / 1000))
    product = F.struct(F.when(F.col("p_partkey") % 7 == 5, "ML Serverless").otherwise("ML Instance").alias("productFamily"), attributes.alias("attributes"))
    dimension = F.create_map(F.concat(sku, F.lit(".D")), F.struct(unit.alias("unit"), price.alias("pricePerUnit")))
    terms = F.struct(F.create_map(sku, F.create_map(F.concat(sku, F.lit(".T")), F.struct(dimension.alias("priceDimensions")))).alias("OnDemand"))
    document = F.to_json(F.struct(F.create_map(sku, product).alias("products"), terms.alias("terms")))
    region = F.when(F.col("p_size") % 2 == 0, "us-east-1").otherwise("eu-west-1")
    return part.select(region.alias("region"), document.alias("document"))


_OFFER_REGION = "CASE WHEN p_size % 2 = 0 THEN 'us-east-1' ELSE 'eu-west-1' END AS region"


@query(
    "token_offer_prices",
    f"""SELECT {_OFFER_REGION}, p_brand AS service_name, CASE p_partkey % 7 WHEN 0 THEN 'input' WHEN 1 THEN 'output' WHEN 2 THEN 'cache_read_global' WHEN 4 THEN 'output_global' WHEN 6 THEN 'cache_write' END AS rate_kind,
      CAST(max(CAST(round(p_retailprice / 1000, 8) AS DECIMAL(24,12))) AS DOUBLE) AS usd_per_mtok FROM part
    WHERE p_partkey % 7 NOT IN (3, 5) AND p_size % 10 <> 9 GROUP BY 1, 2, 3""",
)
def token_offer_prices(spark, sf_dir):
    return money(prices.token_prices(offers(spark, sf_dir)), "usd_per_mtok")


@query(
    "hosting_offer_prices",
    f"""SELECT {_OFFER_REGION}, 'ml.m5.' || p_size || 'xlarge' AS instance_type, round(CAST(max(round(CAST(round(p_retailprice / 1000, 8) AS DECIMAL(24,12)), 6)) AS DOUBLE), 6) AS usd_per_hour
    FROM part WHERE p_partkey % 5 = 0 AND p_size % 3 <> 0 GROUP BY 1, 2""",
)
def hosting_offer_prices(spark, sf_dir):
    return money(prices.hosting_prices(offers(spark, sf_dir)), "usd_per_hour")


@query(
    "serverless_offer_prices",
    f"""SELECT {_OFFER_REGION}, 4 AS memory_gb, round(CAST(max(CAST(round(p_retailprice / 1000, 8) AS DECIMAL(24,12))) AS DOUBLE), 8) AS usd_per_second
    FROM part WHERE p_partkey % 7 = 5 AND p_partkey % 5 <> 0 GROUP BY 1""",
)
def serverless_offer_prices(spark, sf_dir):
    return money(prices.serverless_prices(offers(spark, sf_dir)), "usd_per_second")


@query("usage_report_by_model", f"WITH {_PARSED}, {COSTED.replace('inv AS (' + duck(invocations) + ')', 'inv AS (SELECT * REPLACE (CASE WHEN event_id % 50 = 8 THEN NULL ELSE cache_read_tokens END AS cache_read_tokens, CASE WHEN event_id % 50 = 8 THEN NULL ELSE cache_write_tokens END AS cache_write_tokens) FROM issues WHERE issue_kind IS NULL)')} {_totals_sql(chr(39) + 'model' + chr(39) + ' AS grouping, model_id AS key,', 'GROUP BY 2')}")
def usage_report_by_model(spark, sf_dir):
    """From raw lines to a section of the finished report."""
    report = usage_report(parsed(spark, sf_dir), spark.sql(token_prices("spark")), only=("groups",))
    return money(group_section(report, "model"))


def _iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({x}) % 1000000 <> 0 THEN '.' || strftime({x}, '%f') ELSE '' END || '+00:00'"


_FIRST = 40


def _told(item: str, order: str, name: str, limit: str = "") -> str:
    """Rows of another query's SQL as text, in an order."""
    return f"(SELECT coalesce(string_agg({item}, '|' ORDER BY {order}), '') FROM (SELECT * FROM ({SQL[name]}) AS q {limit}) AS rows_of_it)"


_WHERE = "request_count DESC, window_start, identity_arn, kind, model_id NULLS FIRST"


@query(
    "usage_document",
    f"""WITH inv AS ({duck(invocations)}), w AS (SELECT min(ts) AS a, max(ts) AS b FROM inv), t AS ({SQL['usage_totals']}), un AS ({SQL['unpriced_models']}),
      o AS (SELECT count(*) AS n FROM ({SQL['token_outliers']})), an AS (SELECT count(*) AS n FROM ({SQL['anomalies_with_rates']})), sk AS (SELECT sum(records) AS n FROM ({SQL['skipped_record_counts']}))
    SELECT {_iso('a')} AS window_start, {_iso('b')} AS window_end, 7 AS sources_read, '2024-05-01' AS prices_published, t.requests, t.total_tokens, t.cost_usd, t.unpriced_requests, t.cost_is_complete,
      (SELECT coalesce(string_agg(model_id, '|' ORDER BY model_id), '') FROM un) AS unpriced_models,
      {_told("key || ' ' || requests || ' ' || total_tokens || ' ' || unpriced_requests || ' ' || cost_is_complete", 'cost_usd DESC, requests DESC, key', 'usage_by_model')} AS by_model,
      {_told("model_id || ' ' || requests || ' ' || p50 || ' ' || p95 || ' ' || p99 || ' ' || max_tokens || ' ' || sample_is_meaningful", 'requests DESC, model_id', 'token_percentiles', "WHERE direction = 'input'")} AS input_percentiles,
      {_told("model_id || ' ' || requests || ' ' || p50 || ' ' || p95 || ' ' || p99 || ' ' || max_tokens || ' ' || sample_is_meaningful", 'requests DESC, model_id', 'token_percentiles', "WHERE direction = 'output'")} AS output_percentiles,
      o.n AS outlier_count, {_told("request_id || ' ' || model_id || ' ' || kind || ' ' || tokens || ' ' || cutoff", 'tokens DESC, request_id, kind', 'token_outliers', f'ORDER BY tokens DESC, request_id, kind LIMIT {_FIRST}')} AS outliers,
      an.n AS anomaly_count, {_told(f"kind || ' ' || identity_arn || ' ' || coalesce(model_id, '-') || ' ' || {_iso('CAST(window_start AS TIMESTAMP)')} || ' ' || {_iso('CAST(window_end AS TIMESTAMP)')} || ' ' || request_count || ' ' || detail", _WHERE, 'anomalies_with_rates', f'ORDER BY {_WHERE} LIMIT {_FIRST}')} AS anomalies,
      {_told("request_id || ' ' || model_id", 'cost_usd DESC, request_id', 'most_expensive_requests')} AS most_expensive,
      CAST(sk.n AS BIGINT) AS skipped, {_told("kind || ' ' || records", 'kind', 'skipped_record_counts')} AS skipped_by_reason
    FROM w, t, o, an, sk""",
)
def usage_document(spark, sf_dir):
    """The report of the invocations as one record, its nested parts as text; the skipped records are those of the raw lines."""
    thresholds = UsageThresholds(burst_window_seconds=BURST.burst_window_seconds, burst_count=BURST.burst_count, repeat_count=2)
    clean = inv(spark, sf_dir).select("*", F.lit(None).cast("string").alias("issue_kind"), F.lit("").alias("detail"))
    sections = usage_report(clean, spark.sql(token_prices("spark")), thresholds=thresholds)
    sections["skipped_records"] = iv.issue_counts(parsed(spark, sf_dir))
    d = F.col("document")

    def told(items, *names: str):
        return F.array_join(F.transform(items, lambda x: F.concat_ws(" ", *[F.coalesce(x[n].cast("string"), F.lit("-")) for n in names])), "|")

    sizes = ("model_id", "requests", "p50", "p95", "p99", "max", "sample_is_meaningful")
    reasons = F.transform(F.map_entries(d["skipped_records"]["by_reason"]), lambda e: F.concat_ws(" ", e["key"], e["value"].cast("string")))
    return documents.usage_document(sections, 7, dt.date(2024, 5, 1), _FIRST).select(
        d["window"]["start"].alias("window_start"), d["window"]["end"].alias("window_end"), d["sources_read"].cast("int").alias("sources_read"),
        d["prices_published"].cast("string").alias("prices_published"), d["totals"]["requests"].alias("requests"), d["totals"]["total_tokens"].alias("total_tokens"),
        d["totals"]["estimated_cost_usd"].cast("double").alias("cost_usd"), d["totals"]["unpriced_requests"].alias("unpriced_requests"), d["cost_is_complete"].alias("cost_is_complete"),
        F.array_join(d["unpriced_models"], "|").alias("unpriced_models"), told(d["by_model"], "key", "requests", "total_tokens", "unpriced_requests", "cost_is_complete").alias("by_model"),
        told(d["percentiles"]["input"], *sizes).alias("input_percentiles"), told(d["percentiles"]["output"], *sizes).alias("output_percentiles"),
        d["outlier_count"].alias("outlier_count"), told(d["outliers"], "request_id", "model_id", "kind", "tokens", "model_cutoff").alias("outliers"),
        d["anomaly_count"].alias("anomaly_count"), told(d["anomalies"], "kind", "identity_arn", "model_id", "window_start", "window_end", "request_count", "detail").alias("anomalies"),
        told(d["most_expensive"], "request_id", "model_id").alias("most_expensive"),
        d["skipped_records"]["total"].alias("skipped"), F.array_join(reasons, "|").alias("skipped_by_reason"),
    )

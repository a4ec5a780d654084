"""Queries that place workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue import adapters as ad
from meterwise.operators import placement as pl
from meterwise.sinks import documents

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


def workloads(spark, sf_dir) -> DataFrame:
    return ad.adapted(spark, sf_dir, ad.workloads, "part")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.judge(pl.valid_workloads(workloads(spark, sf_dir)))


# --- the same in SQL ------------------------------------------------------------------------------

_BAD = "payload_mb < 0 OR response_mb < 0 OR processing_seconds < 0 OR coalesce(latency_p99_ms <= 0, FALSE) OR model_count < 1"
BASE = f"""
  every AS ({ad.duck(ad.workloads)}),
  w AS (SELECT *, immediate_response OR latency_p99_ms IS NOT NULL AS inl FROM every WHERE NOT ({_BAD})),
  o AS (SELECT * FROM (VALUES ('real_time', 25, 25, 60, TRUE, FALSE, TRUE, FALSE, 3), ('serverless', 4, 4, 60, FALSE, TRUE, TRUE, FALSE, 0),
    ('async', 1024, NULL, 3600, TRUE, TRUE, FALSE, TRUE, 2), ('batch_transform', 100, NULL, 3600, TRUE, TRUE, FALSE, TRUE, 1)) AS t(option, req, resp, sec, gpu, zero, answers, notifies, tie)),
  wo AS (SELECT w.*, o.* FROM w CROSS JOIN o),
  gone AS (
    SELECT workload_id, option, 'request_payload_over_limit' AS constraint_id FROM wo WHERE payload_mb > req
    UNION ALL SELECT workload_id, option, 'response_payload_over_limit' FROM wo WHERE response_mb > resp
    UNION ALL SELECT workload_id, option, 'processing_time_over_limit' FROM wo WHERE processing_seconds > sec
    UNION ALL SELECT workload_id, option, 'gpu_not_supported' FROM wo WHERE gpu_required AND NOT gpu
    UNION ALL SELECT workload_id, option, 'cannot_scale_to_zero' FROM wo WHERE zero_idle_cost AND NOT zero
    UNION ALL SELECT workload_id, option, 'no_inline_response' FROM wo WHERE inl AND NOT answers
    UNION ALL SELECT workload_id, option, 'no_native_completion_notification' FROM wo WHERE needs_notification AND NOT notifies),
  pref AS (
    SELECT workload_id, 'real_time' AS option, 'steady_traffic_favours_real_time' AS rule_id, 3.0::DOUBLE AS weight FROM w WHERE traffic = 'steady'
    UNION ALL SELECT workload_id, 'serverless', 'bursty_traffic_favours_serverless', 3 FROM w WHERE traffic = 'bursty-idle'
    UNION ALL SELECT workload_id, 'async', 'bursty_traffic_favours_async', 1 FROM w WHERE traffic = 'bursty-idle'
    UNION ALL SELECT workload_id, 'batch_transform', 'scheduled_batch_favours_batch_transform', 4 FROM w WHERE traffic = 'scheduled-batch'
    UNION ALL SELECT workload_id, 'async', 'scheduled_batch_favours_async', 1 FROM w WHERE traffic = 'scheduled-batch'
    UNION ALL SELECT workload_id, 'real_time', 'tight_latency_favours_real_time', 2 FROM w WHERE latency_p99_ms < 1000
    UNION ALL SELECT workload_id, 'serverless', 'tight_latency_penalises_serverless', -2 FROM w WHERE latency_p99_ms < 1000
    UNION ALL SELECT workload_id, 'async', 'offline_result_favours_async', 1 FROM w WHERE NOT inl
    UNION ALL SELECT workload_id, 'batch_transform', 'offline_result_favours_batch_transform', 1 FROM w WHERE NOT inl
    UNION ALL SELECT workload_id, 'real_time', 'many_models_favour_real_time', 1 FROM w WHERE model_count >= 3),
  alive AS (SELECT workload_id, option, tie FROM wo ANTI JOIN gone USING (workload_id, option)),
  score AS (SELECT a.workload_id, a.option, tie, coalesce(sum(weight), 0) AS score FROM alive AS a LEFT JOIN pref AS p ON a.workload_id = p.workload_id AND a.option = p.option GROUP BY 1, 2, 3),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY workload_id ORDER BY score DESC, tie) AS rank FROM score),
  best AS (SELECT w.*, r.option AS winner, r.score AS top, s.option AS second, s.score AS next FROM w LEFT JOIN ranked AS r ON w.workload_id = r.workload_id AND r.rank = 1 LEFT JOIN ranked AS s ON w.workload_id = s.workload_id AND s.rank = 2)"""


def _size(x: str) -> str:
    return f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END)"


def _mb(x: str) -> str:
    return f"({_size(x)} || ' MB' || CASE WHEN {x} >= 1024 AND {x} % 1024 = 0 THEN ' (' || CAST({x} / 1024 AS BIGINT) || ' GB)' ELSE '' END)"


@query("option_eliminations", f"WITH {BASE} SELECT workload_id, option, constraint_id FROM gone")
def option_eliminations(spark, sf_dir):
    return pl.eliminations(judged(spark, sf_dir)).select("workload_id", "option", "constraint_id")


@query(
    "payload_limits_in_words",
    f"WITH {BASE} SELECT workload_id, option, 'requests of up to ' || {_mb('payload_mb')} AS requirement, {_mb('req::DOUBLE')} AS \"limit\", {_mb('payload_mb')} AS actual FROM wo WHERE payload_mb > req",
)
def payload_limits_in_words(spark, sf_dir):
    found = pl.eliminations(judged(spark, sf_dir)).filter("constraint_id = 'request_payload_over_limit'")
    return found.select("workload_id", "option", "requirement", "limit", "actual")


@query("surviving_options", f"WITH {BASE} SELECT workload_id, option FROM alive")
def surviving_options(spark, sf_dir):
    return pl.survivors(judged(spark, sf_dir))


@query("option_preferences", f"WITH {BASE} SELECT workload_id, option, rule_id, weight FROM pref")
def option_preferences(spark, sf_dir):
    return pl.preference_rows(judged(spark, sf_dir))


@query("option_rankings", f"WITH {BASE} SELECT workload_id, option, score, CAST(rank AS INT) AS rank FROM ranked")
def option_rankings(spark, sf_dir):
    return pl.rankings(judged(spark, sf_dir))


@query("recommended_options", f"WITH {BASE} SELECT workload_id, winner AS recommended, coalesce(top = next, FALSE) AS level FROM best")
def recommended_options(spark, sf_dir):
    return judged(spark, sf_dir).select("workload_id", "recommended", "level")


@query(
    "placement_advice",
    f"""WITH {BASE} SELECT workload_id, 'provisioned_concurrency' AS advice_id, 'a cold start may take 240 s (4 minutes) against a p99 target of ' || {_size('latency_p99_ms')} || ' ms; provisioned concurrency keeps workers warm, at a standing cost' AS message FROM best WHERE winner = 'serverless' AND latency_p99_ms IS NOT NULL
    UNION ALL SELECT workload_id, 'multi_model_endpoint', model_count || ' mostly idle models can share the instances of one multi-model endpoint' FROM best WHERE winner = 'real_time' AND model_count >= 3 AND traffic = 'bursty-idle'
    UNION ALL SELECT workload_id, 'inference_components', 'inference components give each of ' || model_count || ' models its own resources and scaling' FROM best WHERE winner = 'real_time' AND model_count >= 2
    UNION ALL SELECT workload_id, 'inference_components_scale_to_zero', 'real-time fails only on idle cost, and an endpoint of inference components can scale to zero' FROM best WHERE zero_idle_cost AND (winner IS NULL OR winner IN ('async', 'batch_transform'))
      AND (SELECT list(constraint_id) FROM gone AS g WHERE g.workload_id = best.workload_id AND g.option = 'real_time') = ['cannot_scale_to_zero']""",
)
def placement_advice(spark, sf_dir):
    return pl.advice(judged(spark, sf_dir)).select("workload_id", "advice_id", "message")


@query(
    "requirement_conflicts",
    f"""WITH {BASE}, c AS (SELECT g.workload_id, constraint_id, count(*) AS n, string_agg(g.option, ',' ORDER BY CASE g.option WHEN 'real_time' THEN 0 WHEN 'serverless' THEN 1 WHEN 'async' THEN 2 ELSE 3 END) AS eliminated
      FROM gone AS g JOIN best AS b ON g.workload_id = b.workload_id AND b.winner IS NULL GROUP BY 1, 2)
    SELECT workload_id, constraint_id, eliminated, CAST(row_number() OVER (PARTITION BY workload_id ORDER BY n DESC, constraint_id) AS INT) AS place FROM c""",
)
def requirement_conflicts(spark, sf_dir):
    return pl.conflicts(judged(spark, sf_dir)).select("workload_id", "constraint_id", F.array_join("eliminated", ",").alias("eliminated"), "place")


@query(
    "invalid_workloads",
    f"""WITH {BASE} SELECT workload_id, CASE WHEN payload_mb < 0 THEN 'payload_mb: missing or below zero' WHEN response_mb < 0 THEN 'response_mb: missing or below zero'
      WHEN processing_seconds < 0 THEN 'processing_seconds: missing or below zero' WHEN latency_p99_ms <= 0 THEN 'latency_p99_ms: zero or less' ELSE 'model_count: less than one model' END AS problem
    FROM every WHERE {_BAD}""",
)
def invalid_workloads(spark, sf_dir):
    return pl.invalid_workloads(workloads(spark, sf_dir)).select("workload_id", "problem")


_CONSTRAINTS = "['request_payload_over_limit', 'response_payload_over_limit', 'processing_time_over_limit', 'gpu_not_supported', 'cannot_scale_to_zero', 'no_inline_response', 'no_native_completion_notification']"
_TITLE = "CASE {} WHEN 'real_time' THEN 'Real-time endpoint' WHEN 'serverless' THEN 'Serverless inference' WHEN 'async' THEN 'Asynchronous inference' ELSE 'Batch transform' END"
_FIRST = "(SELECT coalesce(string_agg(rule_id, ',' ORDER BY rule_id), '') FROM pref AS p WHERE p.workload_id = best.workload_id AND p.option = best.winner AND weight {} 0)"


@query(
    "placement_explanations",
    f"""WITH {BASE}, each AS (SELECT workload_id, option, string_agg(constraint_id, '+' ORDER BY list_position({_CONSTRAINTS}, constraint_id)) AS said FROM gone GROUP BY 1, 2),
      n AS (SELECT workload_id, string_agg(option || ': ' || said, '|' ORDER BY list_position(['real_time', 'serverless', 'async', 'batch_transform'], option)) AS said FROM each GROUP BY 1)
    SELECT best.workload_id,
      CASE WHEN winner IS NULL THEN 'No option meets all of these requirements.' WHEN second IS NULL THEN 'Use ' || {_TITLE.format('winner')} || ': no other option meets every requirement.'
        WHEN top = next THEN 'Use ' || {_TITLE.format('winner')} || ', level with ' || {_TITLE.format('second')} || ' but with less running all the time.' ELSE 'Use ' || {_TITLE.format('winner')} || '.' END AS headline,
      CASE WHEN winner IS NULL THEN '' WHEN second IS NULL THEN array_to_string(list_sort(string_split(ltrim({_FIRST.format('>')} || ',every_other_option_ruled_out', ','), ',')), ',')
        WHEN {_FIRST.format('>')} = '' THEN 'tie_break_on_less_standing_infrastructure' ELSE {_FIRST.format('>')} END AS deciding_factors,
      {_FIRST.format('<')} AS caveats,
      (SELECT coalesce(string_agg({_TITLE.format('r.option')} || ' meets every requirement too (score ' || {_size('r.score')} || ' against ' || {_size('top')} || ')', '|' ORDER BY rank), '') FROM ranked AS r WHERE r.workload_id = best.workload_id AND rank > 1) AS runners_up,
      coalesce(n.said, '') AS rejections
    FROM best LEFT JOIN n ON n.workload_id = best.workload_id""",
)
def placement_explanations(spark, sf_dir):
    told = pl.explain(judged(spark, sf_dir))
    return told.select(
        "workload_id", "headline", F.array_join(F.array_sort("deciding_factors"), ",").alias("deciding_factors"),
        F.array_join("caveats", ",").alias("caveats"), F.array_join("runners_up", "|").alias("runners_up"),
        F.array_join(F.transform("rejections", lambda r: F.concat(r["option"], F.lit(": "), F.array_join(r["reasons"], "+"))), "|").alias("rejections"),
    )


@query(
    "workload_documents",
    f"""WITH {BASE} SELECT workload_id, winner AS recommended,
      (SELECT coalesce(string_agg(r.option || ':' || CAST(r.score AS BIGINT), ',' ORDER BY r.rank), '') FROM ranked AS r WHERE r.workload_id = best.workload_id) AS ranked,
      (SELECT coalesce(string_agg(g.option || ':' || constraint_id, ',' ORDER BY g.option, constraint_id), '') FROM gone AS g WHERE g.workload_id = best.workload_id) AS rejected
    FROM best""",
)
def workload_documents(spark, sf_dir):
    document = F.col("document")
    ranked = F.transform(document["ranked"], lambda r: F.concat_ws(":", r["option"], r["score"].cast("bigint").cast("string")))
    rejected = F.flatten(
        F.transform(document["rejected"], lambda o: F.transform(o["eliminations"], lambda e: F.concat_ws(":", o["option"], e["constraint_id"])))
    )
    return documents.workload_documents(judged(spark, sf_dir)).select(
        "workload_id", document["recommended"].alias("recommended"), F.array_join(ranked, ",").alias("ranked"),
        F.array_join(F.array_sort(rejected), ",").alias("rejected"),
    )

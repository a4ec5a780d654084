"""Reports as nested records: one per usage report, stream, workload, profiled table or region.

A record gathers what belongs to one thing that is small by nature (the shards of a stream, the options
of a workload, the columns of a table, the endpoints of a region); a log's own rows are never gathered.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _gathered(table: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Rows of each key as one array of records, in order; the fields to order by come first."""
    fields = [*order, *(c for c in table.columns if c not in (*keys, *order))]
    return table.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def iso(moment: Column) -> Column:
    """A moment as ISO text in UTC, with microseconds only where there are any."""
    seconds = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.when(F.unix_micros(moment) % 1_000_000 != 0, F.date_format(moment, ".SSSSSS")).otherwise("")
    return F.concat(seconds, micros, F.lit("+00:00"))


def _listed(table: DataFrame, order: list[Column], fields: list[Column], most: int | None = None) -> Column:
    """The rows of a small table, or the first `most` of any table, as one array in order."""
    rows = table.orderBy(*order).limit(most) if most is not None else table
    numbered = rows.withColumn("_place", F.row_number().over(Window.orderBy(*order)))
    gathered = F.array_sort(F.collect_list(F.struct(F.col("_place"), F.struct(*fields).alias("item"))))
    return numbered.agg(F.transform(gathered, lambda x: x["item"])).scalar()


def usage_document(
    sections: dict[str, DataFrame], sources_read: int, prices_published: dt.date | None = None, most: int = 100
) -> DataFrame:
    """The usage report as one record: (document).

    Made of scalars and of arrays that do not grow with the log: models, skipping reasons, the dearest requests, and the first
    `most` outliers and call patterns beside their numbers. Callers, hours and days have no bound: they stay tables of
    their own in the section `groups`.
    """
    groups = sections["groups"]
    measures = [
        "requests", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens",
        F.col("cost_usd").alias("estimated_cost_usd"), "unpriced_requests", "cost_is_complete",
    ]
    fields = [F.col(m) if isinstance(m, str) else m for m in measures]
    total = groups.filter("grouping = 'all'").select(F.struct(F.lit("all").alias("key"), *fields)).scalar()
    models = groups.filter("grouping = 'model'")
    by_model = _listed(models, [F.desc("cost_usd"), F.desc("requests"), F.asc("key")], [F.col("key"), *fields])
    when = sections["window"].select(F.struct(iso(F.col("window_start")).alias("start"), iso(F.col("window_end")).alias("end"))).scalar()

    def sizes(direction: str) -> Column:
        rows = sections["percentiles"].filter(F.col("direction") == direction)
        shown = ["model_id", "requests", "p50", "p95", "p99", F.col("max_tokens").alias("max"), "sample_is_meaningful"]
        return _listed(rows, [F.desc("requests"), F.asc("model_id")], [F.col(c) if isinstance(c, str) else c for c in shown])

    outliers = sections["outliers"]
    unusual = _listed(
        outliers, [F.desc("tokens"), F.asc("request_id"), F.asc("kind")],
        [F.col("request_id"), F.col("model_id"), F.col("identity_arn"), iso(F.col("ts")).alias("timestamp"), F.col("kind"), F.col("tokens"),
         F.col("cutoff").alias("model_cutoff"), F.col("source")], most,
    )
    anomalies = sections["anomalies"]
    patterns = _listed(
        anomalies, [F.desc("request_count"), F.asc("window_start"), F.asc("identity_arn"), F.asc("kind"), F.asc("model_id")],
        [F.col("kind"), F.lit(True).alias("heuristic"), F.col("identity_arn"), F.col("model_id"), iso(F.col("window_start")).alias("window_start"),
         iso(F.col("window_end")).alias("window_end"), F.col("request_count"), F.round("calls_per_minute", 2).alias("calls_per_minute"),
         F.col("cost_usd").alias("estimated_cost_usd"), F.col("detail")], most,
    )
    dearest = _listed(
        sections["most_expensive"], [F.desc("cost_usd"), F.asc("request_id")],
        [F.col("request_id"), F.col("model_id"), F.col("identity_arn"), iso(F.col("ts")).alias("timestamp"), F.col("input_tokens"),
         F.col("output_tokens"), F.col("cost_usd").alias("estimated_cost_usd"), F.col("source")],
    )
    skipped = sections["skipped_records"].agg(
        F.struct(
            F.coalesce(F.sum("records"), F.lit(0)).alias("total"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "records")))).alias("by_reason"),
        )
    ).scalar()
    unpriced = sections["unpriced_models"].agg(F.array_sort(F.collect_list("model_id"))).scalar()
    parts = groups.sparkSession.range(1).select(
        F.lit("from log metadata alone; bodies are dropped while parsing").alias("privacy"), when.alias("window"),
        F.lit(sources_read).cast("bigint").alias("sources_read"), F.lit(prices_published).cast("date").alias("prices_published"),
        total.alias("totals"), unpriced.alias("unpriced_models"), by_model.alias("by_model"),
        F.struct(sizes("input").alias("input"), sizes("output").alias("output")).alias("percentiles"),
        outliers.agg(F.count("*")).scalar().alias("outlier_count"), unusual.alias("outliers"),
        anomalies.agg(F.count("*")).scalar().alias("anomaly_count"), patterns.alias("anomalies"),
        dearest.alias("most_expensive"), skipped.alias("skipped_records"),
    )
    complete = F.coalesce(F.col("totals")["cost_is_complete"], F.lit(True)).alias("cost_is_complete")
    return parts.select(F.struct("*", complete).alias("document"))


def stream_documents(report: dict[str, DataFrame]) -> DataFrame:
    """One record per stream of a stream scan: (stream, document)."""
    streams = report["streams"].join(_gathered(report["shards"], ["stream"], ["shard_id"], "shards"), "stream", "left")
    parts = ["shards"]
    if "top_keys" in report:
        keys = report["top_keys"]
        first = [c for c in ("rank", "partition_key") if c in keys.columns]
        streams = streams.join(_gathered(keys, ["stream"], first, "top_keys"), "stream", "left")
        parts.append("top_keys")
    plain = [c for c in report["streams"].columns if c not in ("verdict", "headline", "evidence", "remedy")]
    diagnosis = F.struct("verdict", "headline", "evidence", "remedy").alias("diagnosis")
    filled = [F.coalesce(F.col(p), F.array()).alias(p) for p in parts]
    return streams.select("stream", F.struct(*plain, diagnosis, *filled).alias("document"))


def workload_documents(judged: DataFrame) -> DataFrame:
    """One record per judged workload: (workload_id, document). Made in place, row by row."""
    ranked = F.transform("ranked", lambda r: F.struct(r["option"].alias("option"), r["title"].alias("title"), r["score"].alias("score"), r["reasons"].alias("reasons")))
    rejected = F.transform(
        F.filter("options", lambda o: F.size(o["eliminations"]) > 0),
        lambda o: F.struct(o["option"].alias("option"), o["title"].alias("title"), o["eliminations"].alias("eliminations")),
    )
    return judged.select(
        "workload_id",
        F.struct("workload_id", "recommended", "level", ranked.alias("ranked"), rejected.alias("rejected"), "conflicts").alias("document"),
    )


def profile_document(columns: DataFrame, rules: DataFrame) -> DataFrame:
    """One record for a profiled table: its columns and the rules derived from them."""
    whole = F.lit(0).alias("one")
    left = _gathered(columns.select(whole, "*"), ["one"], ["column_no"], "columns")
    right = _gathered(rules.select(whole, "*"), ["one"], ["rule_no"], "rules")
    first = F.get("columns", F.lit(0))
    return left.join(right, "one", "left").select(
        F.struct(first["row_count"].alias("row_count"), first["sampled"].alias("sampled"), "columns", "rules").alias("document")
    )


def region_documents(findings: DataFrame) -> DataFrame:
    """One record per region of an endpoint scan, with its totals: (region, document)."""
    sums: list[Column] = [F.sum(c).alias(c) for c in ("monthly_usd", "wasted_monthly_usd")]
    complete = (F.count_if(F.col("verdict").isin("idle", "underused") & F.col("wasted_monthly_usd").isNull()) == 0).alias("totals_are_complete")
    totals = findings.groupBy("region").agg(F.count("*").alias("count"), *sums, complete)
    return totals.join(_gathered(findings, ["region"], ["endpoint", "variant"], "findings"), "region").select(
        "region", F.struct("region", "count", "monthly_usd", "wasted_monthly_usd", "totals_are_complete", "findings").alias("document")
    )

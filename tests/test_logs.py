"""Reading files in any layout, and every reason a record is not used."""

from __future__ import annotations

import datetime as dt
import gzip
import json
import os
import re
import zlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from catalogue import logs as queries
from meterwise.kept import _held, released
from meterwise.operators import content, costing, invocations as iv, totals
from meterwise.plans.usage import usage_report
from meterwise.sinks.documents import usage_document
from meterwise.sinks.reports import nested, write_sections
from meterwise.sources import files, logs

CANARY = "the-secret-word"


def record(**changes):
    base = {
        "schemaType": "ModelInvocationLog", "schemaVersion": "1.0", "timestamp": "2026-09-24T12:00:00Z", "accountId": "123456789012",
        "region": "us-east-1", "requestId": "r-1", "operation": "Converse", "modelId": "anthropic.claude-sonnet-4-20250514-v1:0",
        "identity": {"arn": "arn:aws:sts::1:assumed-role/app/x"},
        "input": {"inputTokenCount": 120, "inputBodyJson": {"messages": [CANARY]}},
        "output": {
            "outputTokenCount": 340,
            "outputBodyJson": {"text": CANARY, "amazon-bedrock-invocationMetrics": {"invocationLatency": 1450, "firstByteLatency": 310}},
        },
    }
    base.update(changes)
    return {k: v for k, v in base.items() if v is not ...}


def parsed(spark, *lines):
    rows = [(f"f#{i}", "f", i, line if isinstance(line, str) else json.dumps(line)) for i, line in enumerate(lines, 1)]
    return iv.parse(logs.decode_lines(spark.createDataFrame(rows, "source string, path string, position int, line string")))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    one = json.dumps(record())
    (root / "deep" / "er").mkdir(parents=True)
    (root / "single.json").write_text(json.dumps(record(requestId="single"), indent=2))
    (root / "array.json").write_text(json.dumps([record(requestId="a1"), record(requestId="a2")]))
    (root / "lines.jsonl").write_text(f"{one}\n\n{{broken\n{one}\n")
    (root / "deep" / "er" / "packed.LOG").write_bytes(gzip.compress(one.encode()))
    (root / "deep" / "plain.gz").write_text(one)
    (root / "two-members.gz").write_bytes(gzip.compress(one.encode() + b"\n") + gzip.compress(one.encode()))
    (root / "cut.gz").write_bytes(gzip.compress(one.encode())[:-9])
    (root / "empty.json").write_text("")
    (root / "bytes.log").write_bytes(b'{"schemaType": "\xff"}')
    (root / "notes.md").write_text(one)
    return root


def test_layouts(spark, folder):
    rows = iv.parse(logs.read_records(spark, str(folder))).collect()
    good = sorted(r.source.rsplit("/", 1)[1] for r in rows if r.issue_kind is None)
    assert good == [
        "array.json#1", "array.json#2", "lines.jsonl#1", "lines.jsonl#4", "packed.LOG", "plain.gz", "single.json",
        "two-members.gz#1", "two-members.gz#2",
    ]
    bad = sorted((r.source.rsplit("/", 1)[1], r.issue_kind) for r in rows if r.issue_kind)
    assert bad == [("bytes.log", "wrong_schema_type"), ("cut.gz", "unreadable_file"), ("lines.jsonl#3", "bad_json")]
    assert logs.count_sources(spark, str(folder)) == 9
    assert logs.count_sources(spark, str(folder / "notes.md")) == 1


def test_layouts_by_file_name(tmp_path):
    """The layout is that of the whole file, found without holding more than a value of it."""
    for text, want in [
        ("", "blank"), (" \x1c\n\u2003", "blank"), ("{}", "document"), ("\u00a0[1, {\"a\": [2]}]\x85", "array"), ("[]", "array"), ("[1,]", "lines"),
        ("[1] 2", "lines"), ("[1]\n[2]", "lines"), ("1\n2", "lines"), ("12", "document"), ("tru", "lines"), ('"a', "lines"), ("{", "lines"),
        ('{"a": 1}\n{"a": 2}', "lines"), ('{"a":\n  [1,\n 2]}', "document"), ("[1, 2", "lines"), ("\ufeff{}", "lines"), ("null", "document"),
        ("[" * 3000, "lines"), ('["' + "x" * 5000 + '", {"k": "\\u00e9"}]', "array"), ("-Infinity", "document"),
    ]:
        for size in (1, 2, 7, 10_000):
            assert files.layout_of(text[k : k + size] for k in range(0, len(text), size)) == want, (text[:40], size)


def test_lines_end_as_text_lines_end():
    text = "a\r\nb\rc\n\nd\x0be\x0cf\x1cg\x85h\u2028i\u2029\r\n\r\r\nlast"
    for size in range(1, 9):
        assert list(files.lines_of(text[k : k + size] for k in range(0, len(text), size))) == text.splitlines(keepends=True)
    assert list(files.lines_of(iter([]))) == [] and list(files.lines_of(iter(["x\r"]))) == ["x\r"]


def test_inflating_goes_over_members_and_padding():
    content = bytes(range(256)) * 9000
    packed = gzip.compress(content) + b"\0" * 5 + gzip.compress(b"") + gzip.compress(b"end")
    for size in (1000, 1 << 20):
        blocks = [packed[k : k + size] for k in range(0, len(packed), size)]
        parts = list(files.inflated(iter(blocks)))
        assert b"".join(parts) == content + b"end" and max(map(len, parts)) <= 1 << 20
    for broken in (packed[:-4], b"\x1f\x8b", packed + b"tail"):
        with pytest.raises((EOFError, zlib.error)):
            list(files.inflated(iter([broken])))


def test_a_file_read_in_ranges_is_numbered_as_a_whole(spark, tmp_path):
    ends = ["\n", "\r\n", "\r", "\n\n", "\u2028", " \n"]
    text = "".join(json.dumps({"requestId": "é" * (k % 40), "k": k}, ensure_ascii=False) + ends[k % 6] for k in range(3000)) + "{cut"
    (tmp_path / "long.jsonl").write_text(text, newline="")
    (tmp_path / "short.jsonl").write_text("1\n2\n3")
    (tmp_path / "crs.jsonl").write_text("\r".join("12" for _ in range(500)))
    want = sorted(
        (p.name, k, line.strip()) for p in tmp_path.iterdir() for k, line in enumerate(p.read_bytes().decode().splitlines(), 1) if line.strip()
    )
    for size in (50, 4096, 1 << 30):
        rows = files.pieces(spark, str(tmp_path), (".jsonl",), range_bytes=size).collect()
        assert sorted((r.path.rsplit("/", 1)[1], r.position, r.line) for r in rows) == want and not any(r.problem for r in rows)


def test_an_array_and_a_packed_file_of_many_pieces(spark, tmp_path):
    records = [record(requestId=f"r{k}", note="x" * 900) for k in range(4000)]
    (tmp_path / "array.json").write_text(json.dumps(records))
    (tmp_path / "packed.jsonl").write_bytes(gzip.compress("\n".join(map(json.dumps, records)).encode()))
    (tmp_path / "cut.json").write_text(json.dumps(records, indent=0)[:-1])
    rows = iv.parse(logs.read_records(spark, str(tmp_path))).groupBy(F.regexp_extract("source", "([a-z]+)[.]", 1), "issue_kind").count().collect()
    found = {(r[0], r[1]): r[2] for r in rows}
    assert found["array", None] == found["packed", None] == 4000
    # without its last bracket the third is no array any more
    assert ("cut", None) not in found and found["cut", "bad_json"] > 4000


def test_what_cannot_be_opened_is_one_issue(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "broken.gz").write_bytes(b"\x1f\x8b not gzip")
    rows = logs.read_records(spark, str(tmp_path)).collect()
    assert sorted((r.source.rsplit("/", 1)[1], r.issue_kind) for r in rows) == [
        ("a.json", None), ("broken.gz", "unreadable_file"),
    ]
    assert all(r.detail for r in rows if r.issue_kind)
    assert files._inspected(str(tmp_path / "gone.json"))[2]
    missing = logs.read_records(spark, str(tmp_path / "no-such-folder")).collect()
    assert [r.issue_kind for r in missing] == ["unreadable_file"]


def test_kept_tables_are_removed(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    with released(spark):
        logs.read_records(spark, str(tmp_path)).collect()
        folders = list(_held[spark.sparkContext.applicationId])
        assert folders and all(os.path.isdir(re.sub("^file:/*(?=/)", "", f)) for f in folders)
    assert not any(os.path.isdir(re.sub("^file:/*(?=/)", "", f)) for f in folders[-2:])


def test_one_named_file_is_read_whatever_its_suffix(spark, folder):
    assert iv.usable(iv.parse(logs.read_records(spark, str(folder / "notes.md")))).count() == 1


def test_line_reader(spark, folder):
    rows = iv.parse(logs.read_record_lines(spark, str(folder / "lines.jsonl"))).collect()
    assert sorted(str(r.issue_kind) for r in rows) == ["None", "None", "bad_json"]


def test_fields(spark):
    row = iv.usable(parsed(spark, record(timestamp=1790251200, errorCode=" "))).first()
    assert row.ts == dt.datetime(2026, 9, 24, 12) and row.error_code is None
    assert (row.input_tokens, row.output_tokens, row.cache_read_tokens) == (120, 340, None)
    assert (row.invocation_latency_ms, row.first_byte_latency_ms) == (1450, 310)


@pytest.mark.parametrize(
    ("line", "issue"),
    [
        ("[1]", "not_a_record"), ("null", "not_a_record"), ("{} {}", "bad_json"), ("{", "bad_json"),
        (record(schemaType="Other"), "wrong_schema_type"), (record(schemaType=...), "wrong_schema_type"),
        (record(schemaVersion="2.0"), "unsupported_schema_version"), (record(schemaVersion=2), "unsupported_schema_version"),
        (record(schemaVersion=...), None), (record(schemaVersion=0), None), (record(schemaVersion=1.5), None),
        (record(timestamp=None), "missing_timestamp"), (record(timestamp=""), "bad_timestamp"),
        (record(timestamp=True), "bad_timestamp"), (record(timestamp="yesterday"), "bad_timestamp"),
        (record(timestamp="2026-02-30"), "bad_timestamp"), (record(timestamp=1e300), "bad_timestamp"),
        (record(modelId=" "), "missing_model_id"), (record(modelId=7), "missing_model_id"),
        (record(input={}, output="text"), "missing_token_counts"), (record(input=[1], output=None, errorCode="X"), None),
        (record(input={"inputTokenCount": "12"}, output={"outputTokenCount": True}), "missing_token_counts"),
        (record(input={"inputTokenCount": -1}, output={}), "missing_token_counts"),
        (record(input={"inputTokenCount": 12.9}, output={}), None), (record(identity="nobody"), None),
    ],
)
def test_reasons(spark, line, issue):
    assert [r.issue_kind for r in parsed(spark, line).collect()] == [issue]


def test_counts_are_cut_to_integers(spark):
    row = parsed(spark, record(input={"inputTokenCount": 12.9}, output={"outputTokenCount": 1e3})).first()
    assert (row.input_tokens, row.output_tokens) == (12, 1000)


def prices(spark, *rows):
    return spark.createDataFrame([(*r[:3], Decimal(str(r[3]))) for r in rows], "region string, service_name string, rate_kind string, usd_per_mtok decimal(12,6)")


SONNET = "Claude Sonnet 4 (Amazon Bedrock Edition)"


def test_no_body_reaches_any_output(spark, tmp_path):
    found = parsed(spark, record(), record(schemaType=CANARY[:3]), "{" + CANARY)
    report = usage_report(found, prices(spark, ("us-east-1", SONNET, "input", 3), ("us-east-1", SONNET, "output", 15)))
    text = " ".join(r.row for r in nested(report).collect()) + str(iv.issues(found).collect())
    [told] = usage_document(report, 2, dt.date(2026, 9, 22)).collect()
    assert (told.document.sources_read, told.document.totals.requests, told.document.skipped_records.by_reason) == (2, 1, {"bad_json": 1, "wrong_schema_type": 1})
    assert told.document.window.start == "2026-09-24T12:00:00+00:00" and told.document.most_expensive[0].request_id == "r-1"
    text += str(told)
    assert CANARY not in text and "r-1" in text
    write_sections({"groups": report["groups"]}, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "groups")).count() == 5


def test_redaction_keeps_the_shape(spark):
    deep = record(extra={"more": {"inputBodyJson": CANARY}}, list=[{"inputBodyJson": "kept"}])
    rows = logs.decode_lines(spark.createDataFrame([("s", "p", 1, json.dumps(deep))], "source string, path string, position int, line string"))
    text = iv.redact(rows).first().redacted
    assert CANARY not in text and json.loads(text)["list"] == [{"inputBodyJson": "kept"}]
    assert json.loads(text)["extra"]["more"]["inputBodyJson"] == "<redacted>"


def test_redaction_equals_a_walk_over_every_record(spark):
    body = {"a": [1, 2.5, None], "t": 'quo"te \\ "outputBodyJson":1'}
    found = [
        record(), record(inputBodyJson=CANARY, output=...), record(input={"inputBodyJson": 12, "x": [{"inputBodyJson": 123}]}), record(input="text"), record(input=[{"inputBodyJson": 1}]),
        record(input={"inputBodyJson": body, "outputBodyJson": body}), record(input={"inputBodyJson": {"inputBodyJson": 1}}), record(input={"inputBodyJson": None}),
        record(output={"outputBodyJson": 1, "inputBodyJson": 12}, inputBodyJson=1), {"inputBodyJson": "é\u2028", "deep": {"er": {"outputBodyJson": [1]}}}, {},
    ]
    lines = [(f"s{k}", "p", 1, json.dumps(r)) for k, r in enumerate(found)]
    records = logs.decode_lines(spark.createDataFrame(lines, "source string, path string, position int, line string"))
    got = {r.source: json.loads(r.redacted) for r in iv.redact(records).collect()}
    assert got == {f"s{k}": iv._hide(r) for k, r in enumerate(found)}


def test_content_is_the_first_record_of_an_id(spark):
    rows = [("p#9", "p", 9, json.dumps(record(modelId="late"))), ("p#2", "p", 2, json.dumps(record(modelId="early")))]
    records = logs.decode_lines(spark.createDataFrame(rows, "source string, path string, position int, line string"))
    found = content.fetch(records, spark.createDataFrame([(" r-1 ",), ("",), ("other",)], "request_id string")).collect()
    assert [(r.request_id, r.model_id, CANARY in r.input_body) for r in found] == [("r-1", "early", True)]


def test_cost_and_its_absence(spark):
    table = prices(
        spark, ("us-east-1", SONNET, "input", 3), ("us-east-1", SONNET, "output", 15), ("us-east-1", SONNET, "input_global", 2.5),
        ("us-east-1", "Odd Name", "input", 1), ("us-east-1", "Odd Name", "output", 1),
    )
    lines = [
        record(requestId="plain"), record(requestId="global", modelId="global.anthropic.claude-sonnet-4-20250514-v1:0"),
        record(requestId="region", region="mars-1"), record(requestId="model", modelId="x.y"), record(requestId="odd", modelId=" Odd-ID"),
        record(requestId="kind", input={"inputTokenCount": 1, "cacheReadInputTokenCount": 5}),
        record(requestId="free", input={"inputTokenCount": 0, "cacheReadInputTokenCount": 0}, output={}),
        record(requestId="arn", modelId="arn:aws:bedrock:us-east-1:1:inference-profile/us.anthropic.claude-sonnet-4-20250514-v1:0"),
    ]
    names = spark.createDataFrame([("odd-id", "Odd Name")], "model_id string, service_name string")
    got = {r.request_id: (r.cost_usd, r.no_price_reason) for r in costing.with_cost(iv.usable(parsed(spark, *lines)), table, names).collect()}
    assert got["plain"] == (Decimal("0.005460"), None)
    assert got["global"] == (Decimal("0.005400"), None)
    assert got["odd"] == (Decimal("0.000460"), None)
    assert got["free"] == (Decimal("0.000000"), None)
    assert got["region"] == (None, "region without rates: mars-1")
    assert got["model"] == (None, "not on the price list of us-east-1: x.y")
    assert got["kind"] == (None, "price list of us-east-1 lacks a rate for cache_read")
    assert got["arn"][0] is None


def test_empty_totals(spark):
    none = costing.with_cost(iv.usable(parsed(spark, "x")), prices(spark, ("r", "s", "input", 1)))
    row = totals.grand_total(none).first()
    assert (row.requests, row.input_tokens, row.cost_is_complete) == (0, 0, True)
    assert totals.covered_window(none).first() == (None, None)
    assert totals.most_expensive(none, 0).count() == 0


def test_grouping_key_of_the_caller(spark):
    none = costing.with_cost(iv.usable(parsed(spark, record(), record())), prices(spark, ("r", "s", "input", 1)))
    assert [(r.key, r.requests) for r in totals.grouped(none, F.lower("operation")).collect()] == [("converse", 2)]


def _tasks_of(table) -> int:
    return table.select(F.spark_partition_id()).distinct().count()


def _events(spark, folder, count):
    rows = spark.range(count).coalesce(1).select(
        F.col("id").alias("event_id"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 3}').alias("props"),
    )
    rows.write.parquet(str(folder / "events.parquet"))
    return str(folder)


def test_events_of_one_scan_task_are_dealt_over_tasks(spark, tmp_path):
    where = _events(spark, tmp_path, 120_000)
    assert _tasks_of(spark.read.parquet(where + "/events.parquet")) == 1
    assert _tasks_of(queries.inv(spark, where)) == 3
    assert [tuple(r) for r in queries.inv(spark, where).agg(F.count("*"), F.countDistinct("request_id")).collect()] == [(120_000, 120_000)]


def test_small_files_are_opened_by_several_tasks(spark, tmp_path):
    for k in range(200):
        (tmp_path / f"f{k}.json").write_text(json.dumps({"requestId": f"r{k}"}))
    rows = files.pieces(spark, str(tmp_path), (".json",))
    assert _tasks_of(rows) > 1
    assert sorted(r.line for r in rows.collect()) == sorted(json.dumps({"requestId": f"r{k}"}) for k in range(200))


def test_records_of_a_long_stream_are_dealt_over_tasks(spark, tmp_path):
    records = [json.dumps({"requestId": f"r{k}"}) for k in range(9000)]
    (tmp_path / "packed.jsonl").write_bytes(gzip.compress("\n".join(records).encode()))
    (tmp_path / "array.json").write_text("[" + ",".join(records) + "]")
    (tmp_path / "one.json").write_text('{"requestId": "alone"}')
    rows = files.pieces(spark, str(tmp_path), (".jsonl", ".json"), stream_bytes=1000)
    want = [(n, k, r) for n in ("array.json", "packed.jsonl") for k, r in enumerate(records, 1)] + [("one.json", 0, '{"requestId": "alone"}')]
    assert sorted((r.path.rsplit("/", 1)[1], r.position, r.line) for r in rows.collect()) == sorted(want)
    assert _tasks_of(rows.filter("path LIKE '%packed%'")) > 1


def test_the_files_of_the_layouts_are_written_by_several_tasks(spark, tmp_path):
    folder = queries.log_folder(spark, _events(spark, tmp_path, 20_000))
    folder = re.sub("^file:/*(?=/)", "", folder)
    writers = {name.split("-")[1] for _, _, names in os.walk(folder) for name in names if name.startswith("part-")}
    assert len(writers) > 1

"""The trie of conversation prefixes against one built with dictionaries, and conversations rebuilt in Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from meterwise.llm import prefixes

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, at string, hash int, words string, name string, depth int"


def in_order(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            convs.setdefault(conv, []).append(((turn is not None, turn or 0), role.encode(), digest, (role, text)))
    return {c: [t[-1] for t in sorted(turns)] for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    name = {p: min(m) for p, m in members.items()}
    saved = {p: (len(m) - 1) * (len(WORDS.findall(p[-1][1])) if p else 0) for p, m in members.items()}
    children = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, total = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            total[p[:d]] += saved[p]
    rows = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        rows.append((name[p], len(p), name[p[:-1]] if p else None, len(m), children[p], leaves[p], total[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z", 2) for r in rows], SCHEMA)


def result(spark, rows, parts=5):
    numbered = prefixes.numbered(table_of(spark, rows).repartition(parts))
    return sorted((tuple(r) for r in prefixes.trie(*prefixes.branched(numbered)).collect()), key=repr)


def test_awkward_conversations(spark):
    draw = random.Random(7)
    rows = [(None, 1, "user", "no conversation"), (3, None, "user", "first"), (3, 0, None, None), (3, 0, "", ""), (3, 0, "user", "tie"), (3, 0, "assistant", "tie")]
    rows += [(4, 1, "us", "er a b"), (5, 1, "user", " a b"), (-7, 2, "user", "below zero"), (-20, 1, "user", "base of none"), (9, 1, "user", "only one")]
    for c in list(range(40, 75)) + [1001, 1002]:
        rows += [(c, t, draw.choice(["user", "assistant"]), draw.choice(["yes", "no  no", "a\tb c", "é"])) for t in range(draw.randint(1, 6))]
    rows += [(80, t, "user", draw.choice(["x", "y"])) for t in range(70)] + [(81, t, "user", "x " * t) for t in range(33)]
    rows += [r for r in rows if r[0] == 41]  # repeated rows
    rows.append((90, 1, "user", "long " * 300_000))
    draw.shuffle(rows)
    assert result(spark, rows) == brute(rebuilt(in_order(rows)))


def test_conversations_without_rebuilding_share_deep_prefixes(spark):
    draw = random.Random(3)
    stem = [("user", f"turn {k} of many words") for k in range(100)]
    convs = {c: stem[: draw.choice([0, 1, 2, 63, 64, 65, 99, 100])] + [("user", str(draw.randint(0, 2)))] * draw.randint(0, 3) for c in range(30)}
    rows = [(c, k, *t) for c, turns in convs.items() for k, t in enumerate(turns)]
    places = prefixes.numbered(table_of(spark, rows).repartition(4))
    lengths = spark.createDataFrame([(c, len(t)) for c, t in convs.items()], "conv_id bigint, length bigint")
    got = sorted((tuple(r) for r in prefixes.trie(lengths, places.drop("part")).collect()), key=repr)
    assert got == brute(convs)


def test_a_long_conversation_is_numbered_over_partitions(spark):
    rows = [(1, k, "user", str(k)) for k in range(4000)] + [(0, 5, "user", "a"), (2, 1, "user", "b"), (2, 0, "user", "c")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = prefixes.numbered(table_of(spark, rows).repartition(8))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    found = placed.filter("conv_id = 1").collect()
    assert sorted(r["at"] for r in found) == list(range(1, 4001)) and len({r["part"] for r in found}) > 2
    assert {(r["conv_id"], r["at"]) for r in placed.filter("conv_id <> 1").collect()} == {(0, 1), (2, 1), (2, 2)}


def test_many_members_end_at_one_node(spark):
    rows = [(c * 20, 0, "user", "same") for c in range(2000)]
    assert result(spark, rows) == brute(rebuilt(in_order(rows)))


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(20, 1, "user", "x")], [(21, 1, "user", "x")]])
def test_few_conversations(spark, rows):
    assert result(spark, rows) == brute(rebuilt(in_order(rows)))

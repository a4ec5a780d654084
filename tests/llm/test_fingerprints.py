"""Locally consistent parsing against a parser that goes symbol by symbol, and the order of documents against Python's."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from meterwise.llm import fingerprints as fp
from meterwise.llm.shared import mixed

MASK = (1 << 64) - 1


def spread(x: int) -> int:
    x &= MASK
    x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & MASK
    return x ^ (x >> 29)


def toss(own: int, left: int | None) -> int:
    if left is None:
        return own & 1
    place = ((own ^ left) & -(own ^ left)).bit_length() - 1
    return 2 * place + (own >> place & 1)


def one_level(names: list[int], level: int) -> list[int]:
    runs: list[list[int]] = []
    for name in names:
        if runs and runs[-1][0] == name:
            runs[-1][1] += 1
        else:
            runs.append([name, 1])
    names = [spread(n + k * 0xC2B2AE3D27D4EB4F) for n, k in runs]
    colours = names
    for _ in range(4):
        colours = [toss(c, colours[i - 1] if i else None) for i, c in enumerate(colours)]
    assert all(c < 6 for c in colours) and all(a != b for a, b in zip(colours, colours[1:]))
    for high in (3, 4, 5):
        around = lambda i: {colours[j] for j in (i - 1, i + 1) if 0 <= j < len(colours)}
        colours = [min({0, 1, 2} - around(i)) if c == high else c for i, c in enumerate(colours)]
    assert all(a != b for a, b in zip(colours, colours[1:]))
    phrases: list[list[int]] = []
    for i, name in enumerate(names):
        top = all(colours[i] > colours[j] for j in (i - 1, i + 1) if 0 <= j < len(names))
        if i == 0 or top and i < len(names) - 1:
            phrases.append([])
        phrases[-1].append(name)
    places = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5]
    return [
        spread(sum(spread(n + places[k & 3] * (k + 1)) for k, n in enumerate(p)) & MASK ^ spread(len(p) + 0xD6E8FEB86659FD93 * level))
        for p in phrases
    ]


def brute_set(text: str) -> set[int]:
    names, level, found = [spread(ord(c) + 1) for c in text], 0, set()
    while names:
        names = one_level(names, level)
        level += 1
        if level >= fp.LEAST_LEVEL or len(names) == 1:
            found |= {n >> 32 for n in names}
        if len(names) == 1:
            break
    return found


def some_texts():
    draw = random.Random(8)
    texts = ["", "a", "ab", "aaaa", "aaaaabbbbb", "\U0001f600" * 3, "abc" * 50, "x" * 5000]
    for n in (3, 7, 20, 90, 400, 3000):
        for letters in ("ab", "abcdefg", "the quick é日本\n"):
            texts.append("".join(draw.choice(letters) for _ in range(n)))
    return texts


def test_sketches_equal_symbol_by_symbol_parsing():
    texts = some_texts()
    for text, sketch in zip(texts, fp.sketches(texts)):
        assert sketch.tolist() == sorted(brute_set(text))[: fp.KEPT]


def test_batches_do_not_change_sketches(monkeypatch):
    texts = some_texts()
    whole = [s.tolist() for s in fp.sketches(texts)]
    monkeypatch.setattr(fp, "_TOGETHER", 100)
    assert [s.tolist() for s in fp.sketches(texts)] == whole
    assert fp.sketches([]) == []


def test_equal_substrings_share_their_inside_at_any_offset():
    draw = random.Random(2)
    words = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(4000)]
    shared = " ".join(words[:2000])
    one, two = shared, " ".join(words[2000:2300]) + "q" + shared + " ".join(words[2300:2500])
    a, b = brute_set(one), brute_set(two)
    assert len(a & b) > 0.97 * len(a)
    # halves in common: half of the names of either; the sketch comes near it
    other = " ".join(words[:1000] + words[3000:])
    s, t, u = fp.sketches([shared, other, " ".join(words[2000:])])
    exact = 2 * len(a & brute_set(other)) / (len(a) + len(brute_set(other)))
    assert abs(exact - 0.5) < 0.03 and abs(fp.likeness(s, t) - exact) < 0.2
    assert fp.likeness(s, s) == 1.0 and fp.likeness(s, u) < 0.1


def test_likeness_is_exact_for_whole_sets():
    a, b = np.array([1, 2, 3, 4], np.uint32), np.array([3, 4, 5], np.uint32)
    none = np.array([], np.uint32)
    assert fp.likeness(a, b) == pytest.approx(4 / 7)
    assert (fp.likeness(none, none), fp.likeness(a, none)) == (1.0, 0.0)
    assert mixed(np.array([5], np.uint64))[0] == spread(5)


def brute(rows):
    """Order by Python; equal ids only with equal texts here."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (doc, text) in enumerate(order):
        behind = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + behind[:half]
        own, other, beyond = fp.sketches([text, changed, behind])
        sha = hashlib.sha256(changed.encode()).hexdigest()
        out.append((doc, len(text), sha, fp.fingerprint(own), fp.fingerprint(other), fp.likeness(own, other), fp.likeness(own, beyond)))
    return sorted(out, key=repr)


def rows_of(table):
    return sorted((tuple(r) for r in table.collect()), key=repr)


def test_documents_follow_each_other_over_all_parts(spark):
    draw = random.Random(5)
    text = lambda: "".join(draw.choice("abc dé\U0001f600") for _ in range(draw.randint(0, 120)))
    rows = [(i * 7 - 400, text()) for i in range(150)] + [(5000, "same"), (5000, "same"), (4999, None), (4998, ""), (None, "no id")]
    rows.append((7001, "long " * 150_000))
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, part int, hash string").repartition(6)
    got = fp.edited(table)
    assert got.columns == ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert rows_of(got) == brute(rows)


def test_equal_ids_are_ordered_by_their_texts_hash(spark):
    rows = [(None, f"text {k} of the documents without an id") for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    once, again = rows_of(fp.edited(table)), rows_of(fp.edited(table.repartition(7)))
    assert once == again and len(once) == 60 and len({r[2] for r in once}) == 60


@pytest.mark.parametrize("rows", [[], [(1, "one document")], [(1, None)], [(None, "x")], [(1, ""), (2, "")]])
def test_few_documents(spark, rows):
    table = spark.createDataFrame(rows, "doc_id int, text string")
    assert rows_of(fp.edited(table)) == brute(rows)
    assert sorted((r.n_chars, r.fingerprint) for r in fp.fingerprints(table).collect()) == sorted((r[1], r[3]) for r in brute(rows))

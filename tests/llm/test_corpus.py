"""Each operator on small tables with awkward rows, against brute force, the tokenizer library or held-out rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from meterwise.llm import choices, leaks, lines, lm, mixing, nearcopies, quality, repeats, tokens, toxicity, urls
from meterwise.llm.induced import repeated_windows, suffix_order

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# names that the operators use inside, as further columns of the input
CLASH = "id string, row int, words string, n_tokens int, digest int, component_id int, kept string, epoch int, share int, gone int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
EMPTY = {"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None}


def prose(seed: int, count: int) -> str:
    draw = random.Random(seed)
    stock = ["the", "of", "and", "river", "stone", "window", "quiet", "letter", "market", "garden", "winter", "to", "in", "summer", "north"]
    return " ".join(draw.choice(stock) + draw.choice(["", "s", "ed", "ly", "ing"]) for _ in range(count))


@pytest.fixture(scope="module")
def awkward(spark):
    long = prose(1, 30_000)
    near = prose(2, 120).split()
    rows = [
        (1, prose(3, 60), "en", "src1", 1), (2, prose(3, 60), "en", "src1", 1), (3, None, "en", "src1", None), (4, "", None, None, 0),
        (5, " \t\n ", "de", "src2", 4), (6, long, "en", "src7", None), (7, long + " end", "en", "src7", None),
        (8, " ".join(near), "fr", "src3", 1), (9, " ".join(near[:-1] + ["other"]), "fr", None, 1), (10, "one two", "fr", "srcx", 1),
        (None, prose(3, 60), "en", "src1", 1), (None, None, None, None, None), (1, prose(3, 60), "en", "src1", 1),
        (11, "\n".join(["alpha beta gamma", "delta epsilon", "zeta eta theta", prose(4, 20)]), "en", "src5", 1),
        (12, "\n".join([prose(5, 20), "alpha beta gamma", "", "delta epsilon", "zeta eta theta"]), "en", "src5", 1),
        (13, "a b c d e f g " * 40, "en", "src0", 1),
    ]
    clash = ("x", 1, "y", 2, 3, 4, "z", 5, 6, 7)
    plain = spark.createDataFrame(rows, SCHEMA)
    values = [F.lit(v).alias(c.split()[0]) for v, c in zip(clash, CLASH.split(", "))]
    return plain.select("*", *values).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], f"{SCHEMA}, {CLASH}")


def texts_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def ordered(rows):
    return sorted(rows, key=repr)


# --- quality -----------------------------------------------------------------------------------------


def test_quality_measures_equal_brute_force(awkward):
    got = ordered(tuple(r) for r in quality.measures(awkward).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    want = []
    for doc, text in texts_of(awkward):
        words = WORDS.findall(text)
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        held = [line for line in text.split("\n") if WORDS.search(line)]
        want.append((doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(held) - len(set(held)), len(covered)))
    assert got == ordered(want)


def test_quality_rules_name_what_failed(spark):
    rows = [(1, prose(9, 60)), (2, " ".join(w + "###" for w in prose(9, 60).split())), (3, "few words"), (4, "x y z w v u t s r q " * 9)]
    result = {r.id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert result[1].kept and result[1].failed_rules == []
    assert not result[2].kept and "symbols_per_word" in result[2].failed_rules
    assert result[3].base_failed and result[4].base_failed


# --- tokens ------------------------------------------------------------------------------------------


def test_every_prefix_counts_as_the_library_counts_it():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own, draw = Tokenizer.from_file(path), tokens.PrefixCounter(path), random.Random(4)
    stock = ["a", "b", " ", "  ", "\n", "'s", "'re", "don't", "é", "日本", "1", "23", "<|endoftext|>", "<|", "#", "the", " of", "\x85", "½", "😀", "\x1c", "ՙ", "ՠ"]
    for _ in range(400):
        text = "".join(draw.choice(stock) for _ in range(draw.randint(0, 14)))
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert own.prefixes(text).tolist() == want and own.count(text) == want[-1]


def test_what_may_follow_is_told_without_running_the_merges(monkeypatch):
    own, draw = tokens.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json")), random.Random(9)
    entries = sorted(own.vocabulary)
    pairs = [(draw.choice(entries), draw.choice(entries)) for _ in range(3000)]
    pairs += [(t[:k], t[k:]) for t in draw.sample(entries, 3000) for k in range(1, len(t)) if t[:k] in own.vocabulary and t[k:] in own.vocabulary]
    want = [own.merged(a + b) == [a, b] for a, b in pairs]
    monkeypatch.setattr(own, "merged", None)
    assert [own.may_follow(a, b) for a, b in pairs] == want and 0 < sum(want) < len(want)


def test_token_counts_and_budgets(awkward, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = ordered((r.id, r.n_bytes, r.n_tokens) for r in tokens.counted(awkward, path).collect())
    assert got == ordered((d, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for d, t in texts_of(awkward))
    table = tokens.prefix_table(awkward.filter("doc_id = 6"), path, block=1000)
    text = awkward.filter("doc_id = 6").first().text
    [cut] = [r.n_chars for r in tokens.longest_within(table, 512, block=1000).collect()]
    fits = lambda n: len(library.encode(text[:n], add_special_tokens=False).ids) <= 512
    assert fits(cut) and not any(fits(n) for n in range(cut + 1, cut + 20))
    [known] = tokens.tokens_of_prefix(table, F.lit(cut), block=1000).collect()
    assert known.n_tokens == len(library.encode(text[:cut], add_special_tokens=False).ids)
    assert tokens.counted(nothing, path).count() == 0


# --- byte repeats ------------------------------------------------------------------------------------


def brute_repeats(rows):
    first: dict[bytes, int] = {}
    for doc, text in rows:
        body = text.encode()
        for p in range(len(body) - 49 if doc is not None else 0):
            first[body[p : p + 50]] = min(first.get(body[p : p + 50], doc), doc)
    out = []
    for doc, text in rows:
        body = text.encode()
        gone = bytearray(len(body))
        for p in range(len(body) - 49 if doc is not None else 0):
            if first[body[p : p + 50]] < doc:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(body, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out.append((doc, len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return ordered(out)


def test_suffix_order_is_the_sorted_order():
    import numpy as np

    draw = np.random.default_rng(2)
    for k in range(300):
        text = np.append(draw.integers(1, draw.integers(2, 6), draw.integers(1, 80)), 0).astype(np.int64)
        got = suffix_order(text, memory=3 if k % 2 else 1 << 20)
        assert got.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        groups = repeated_windows(text, got, 4)
        windows = [text[i : i + 4].tolist() for i in got]
        assert all((groups[j] == groups[j - 1]) == (windows[j] == windows[j - 1] and len(windows[j]) == 4) for j in range(1, len(got)))


def test_byte_repeats_equal_brute_force(spark, awkward, nothing):
    got = ordered(tuple(r) for r in repeats.without_repeats(awkward).drop("kept").collect())
    assert got == brute_repeats(texts_of(awkward))
    draw = random.Random(8)
    base = "".join(draw.choice("ab c") for _ in range(400))
    rows = []
    for doc in range(50):
        at = draw.randint(0, 300)
        text = "".join(draw.choice("xyz") for _ in range(draw.randint(0, 30))) + base[at : at + draw.randint(30, 200)]
        rows.append((doc, draw.choice(["a" * draw.randint(40, 200), text, text + text, "ab" * 70])))
    small = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert ordered(tuple(r) for r in repeats.without_repeats(small).drop("kept").collect()) == brute_repeats(rows)
    assert repeats.without_repeats(nothing).count() == 0


def test_an_anchor_with_more_contexts_than_a_piece_holds_is_split(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(repeats, "HOT", 20)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 1000)
    held, masked = [], repeats._masked
    monkeypatch.setattr(repeats, "_masked", lambda rows: held.append(Counter(r[0] for r in rows)) or masked(rows))
    draw, rows = random.Random(12), []
    for doc in range(400):
        before, after = ("".join(draw.choice("xy") for _ in range(60)) for _ in range(2))
        if doc % 3:
            # some of the bytes around the filler recur
            before = before[:30] + "left side " * 3
            after = "right side of it "[: draw.randint(1, 17)] + after
        rows.append((doc, before[draw.randint(0, 40) :] + "0" * 16 + after))
    rows += [(7, rows[8][1]), (900, rows[8][1] + rows[10][1])]
    draw.shuffle(rows)

    def run(step, rows, names, size):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[k : k + size]]) for k in range(0, len(rows), size)]
        return [tuple(r.values()) for b in step(iter(batches)) for r in b.to_pylist()]

    found = run(repeats._findings, sorted(run(repeats._anchor_rows, rows, ["id", "text"], 90)), ["gram", "context", "id"], 10_000)
    wanted = {d: [{"gram": g, "context": c, "hot": h} for g, c, x, open_, h in found if open_ and x == d] for d, _ in rows}
    assert any(pair["hot"] for pairs in wanted.values() for pair in pairs)
    cuts = run(repeats._cut, [(d, t, wanted[d]) for d, t in rows], ["id", "text", "wanted"], 90)
    cuts.sort(key=lambda r: (r[5], r[0], r[3] if r[5] else b"", r[2]))
    masks = run(repeats._shard_masks, cuts, ["gram", "context", "id", "bytes", "lead", "hot"], 1000)
    masks += [(x, c, repeats._ALL) for _, c, x, open_, _ in found if not open_]
    assert all(count <= 20 for piece in held for count in piece.values())
    got = []
    for doc, text in rows:
        body, own = text.encode(), {}
        for x, context, mask in masks:
            if x == doc:
                own[context] = own.get(context, 0) | mask
        spans = repeats.removed_spans(body, own)
        kept = b"".join(body[a:b] for a, b in zip([0] + [b for _, b in spans], [a for a, _ in spans] + [len(body)]))
        got.append((doc, len(body), len(body) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    assert ordered(got) == brute_repeats(rows)


def test_texts_hashed_together_have_the_anchors_of_each(monkeypatch):
    import numpy as np

    monkeypatch.setattr(repeats, "_SLICE", 70)
    draw = random.Random(3)
    texts = [bytes(draw.choices(b"abc", k=draw.choice((0, 1, 15, 16, 49, 50, 51, 84, 300)))) for _ in range(60)] + [b"a" * 400, b""]
    together = list(zip(*(x.tolist() for x in repeats.marks(texts))))
    assert together == [(t, *m[1:]) for t, text in enumerate(texts) for m in zip(*(x.tolist() for x in repeats.marks([text])))]
    for t, text in enumerate(texts):
        grams = repeats.gram_hashes(np.frombuffer(text, dtype=np.uint8)) >> np.uint64(24) if len(text) >= 50 else []
        want = {p + int(np.argmin(grams[p : p + repeats.WINDOW])) for p in range(len(text) - 49)}
        assert [m[1] for m in together if m[0] == t] == sorted(want)
    # runs end with their texts
    masks = [(t, c) for t, c in sorted({(m[0], int(np.uint64(m[3]).astype(np.int64))) for m in together})]
    own = [np.array(x) for x in zip(*masks)]
    spans = list(zip(*(x.tolist() for x in repeats._spans(texts, *own, np.full(len(masks), repeats._ALL)))))
    assert spans == [(t, 0, len(text)) for t, text in enumerate(texts) if len(text) >= 50]


def test_order_and_windows_of_few_and_many_letters():
    import numpy as np

    draw = np.random.default_rng(6)
    for letters in (3, 300, 1 << 20, 1 << 40):
        part = draw.integers(1, letters, 90)
        text = np.concatenate([part, draw.integers(1, letters, 9), part, part[20:80], [0]])
        order = suffix_order(text)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        for span in (1, 7, 8, 50):
            groups, windows = repeated_windows(text, order, span), [text[i : i + span].tolist() for i in order]
            assert all((groups[j] == groups[j - 1]) == (windows[j] == windows[j - 1] and len(windows[j]) == span) for j in range(1, len(order)))


def test_smaller_ids_are_known_across_batches():
    import pyarrow as pa

    for kind, name in ((pa.int64(), int), (pa.string(), lambda k: f"{k:03d}")):
        rows = sorted((g, c, name(k)) for g in range(3) for c in range(2) for k in range(40))
        for size in (1, 7, 1000):
            batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + size]), (pa.int64(), pa.int64(), kind))],
                                                  names=["gram", "context", "id"]) for k in range(0, len(rows), size)]
            found = [r for b in repeats._findings(iter(batches)) for r in b.to_pylist() if not r["open"]]
            assert [(r["gram"], r["context"], r["id"]) for r in found] == [r for r in rows if r[2] != name(0)]


# --- near copies -------------------------------------------------------------------------------------


def brute_components(rows, shingle, percent):
    sets, up = [], {}
    for doc, text in rows:
        words = text.encode().lower().split()
        width = min(shingle, len(words))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set())
        up[doc] = doc

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            common = len(sets[i] & sets[j])
            if a is not None and b is not None and common and 100 * common >= percent * len(sets[i] | sets[j]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return ordered((doc, len(s), top(doc) if doc is not None else None, doc is None or top(doc) == doc) for (doc, _), s in zip(rows, sets))


def test_near_copies_equal_brute_force(spark, awkward, nothing):
    assert ordered(tuple(r) for r in nearcopies.near_copies(awkward).collect()) == brute_components(texts_of(awkward), 3, 85)
    assert nearcopies.near_copies(nothing).count() == 0


def test_a_large_cluster_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "CLUSTER", 20)
    monkeypatch.setattr(nearcopies, "BLOCK", 8)
    draw, base = random.Random(6), prose(7, 150).split()
    rows = []
    for doc in range(70):
        words = list(base)
        for _ in range(draw.randint(0, 9)):
            words[draw.randrange(len(words))] = f"w{draw.randrange(1000)}"
        rows.append((doc, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert ordered(tuple(r) for r in nearcopies.near_copies(docs).collect()) == brute_components(rows, 3, 85)


# --- line dedup --------------------------------------------------------------------------------------


def test_lines_of_repeated_windows_go(awkward, nothing):
    result = {r.doc_id: r.text for r in lines.without_repeats(awkward).collect()}
    assert result[11].startswith("alpha beta gamma\n")
    assert result[12] == prose(5, 20) + "\n"
    assert result[3] is None and result[4] == "" and result[10] == "one two"
    assert lines.without_repeats(awkward).columns == awkward.columns
    assert lines.report(awkward).count() == awkward.count() and lines.report(nothing).count() == 0


def test_overlapping_repeats_merge(spark):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nc\nd\ny"), (3, "q\nq\nq\nq\nq"), (4, "a\nb")]
    result = {r.id: (r.n_lines, r.n_removed, r.text) for r in lines.report(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert result == {1: (5, 0, "a\nb\nc\nd\ne"), 2: (6, 4, "x\ny"), 3: (5, 4, "q"), 4: (2, 0, "a\nb")}


# --- leaks -------------------------------------------------------------------------------------------


def edits_of(passage: bytes, text: bytes) -> int:
    row = [0] * (len(text) + 1)
    for i, letter in enumerate(passage, 1):
        before, row[0] = row[0], i
        for j, other in enumerate(text, 1):
            before, row[j] = row[j], min(before + (letter != other), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_leaks_are_those_within_the_edit_budget(spark, nothing):
    draw, rows, items = random.Random(3), [], [(k, prose(100 + k, 14)) for k in range(6)] + [(6, None), (7, "short"), (8, prose(100, 14))]
    for doc in range(60):
        passage = list(items[doc % 6][1])
        for _ in range(draw.randint(0, 14)):
            at = draw.randrange(len(passage))
            passage[at : at + draw.randint(0, 1)] = draw.choice(["", "q", "zz"])
        rows.append((doc, prose(doc, 30) + "\n" + "".join(passage).upper() + " " + prose(doc + 500, 10)))
    rows += [(60, None), (61, ""), (None, items[0][1]), (62, prose(62, 20_000) + " " + items[1][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.id, r.item_id) for r in leaks.leaks(docs, bench).collect()}
    want = set()
    for doc, text in rows:
        for item, passage in items:
            if text and passage and len(passage) >= leaks.MIN_BYTES and len(text) < 9999:
                if edits_of(leaks.folded(passage.encode()), leaks.folded(text.encode())) <= leaks.edit_budget(len(passage)):
                    want.add((doc, item))
    assert got == want | {(62, 1)}
    kept = {r.doc_id for r in leaks.without_leaks(docs, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in got}
    assert leaks.leaks(docs, bench.filter("false")).count() == 0
    assert leaks.leaks(nothing, bench).count() == 0


def test_quotations_across_a_cut_and_short_items_leak(spark):
    long, words = prose(300, 300)[:1200], "Is 7 a prime?"
    items = spark.createDataFrame([(1, long), (2, words), (3, "ox"), (4, " "), (5, ""), (6, "ox"), (7, prose(301, 500)[:1801])], "item_id bigint, text string")
    rows = [
        (1, "qq " + long[100:1000] + " qq"), (2, "He asked (is 7 a\tPRIME?), twice: Is 7 a prime?"), (3, "This 7 a prime? foxes, oxen"), (4, "an ox\u00e9 ox"),
        (5, "OX"), (6, prose(301, 500)[903:1802]), (7, "is 7 a prim"), (8, "x" * (leaks.SLICE - 1) + " ox"), (9, "x" * (leaks.SLICE - 1) + "ox"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = ordered((r.id, r.item_id) for r in leaks.leaks(docs, items).collect())
    assert got == ordered([(1, 1), (2, 2), (2, 2), (4, 3), (4, 6), (5, 3), (5, 6), (6, 7), (8, 3), (8, 6)])
    assert {r.doc_id for r in leaks.without_leaks(docs, items).collect()} == {3, 7, 9}
    # every run of 899 bytes of any long item is found
    for size in (601, 1199, 1200, 1801, 5000):
        text = leaks.folded(prose(size, 2000)[:size].encode())
        known = leaks.Passages([(0, text)])
        for at in range(0, max(1, size - 898), 97):
            assert known.search(text[at : at + 899]), (size, at)


def test_spans_and_edits_of_leaks_equal_brute_force(monkeypatch):
    draw = random.Random(5)
    letters = lambda n: "".join(draw.choice("abcdefgh ij") for _ in range(n)).encode()
    opening = letters(30)
    items = [opening + letters(size) for size in (2, 10, 11, 30, 81, 120) for _ in range(3)]
    texts = []
    for k in range(60):
        passage = bytearray(items[k % len(items)])
        for _ in range(draw.randint(0, leaks.edit_budget(len(passage)) + 1)):
            at = draw.randrange(len(passage))
            passage[at : at + draw.randint(0, 1)] = draw.choice([b"", b"y", b"z"])
        texts.append(letters(draw.choice((0, 1, 40))) + bytes(passage) + letters(draw.choice((0, 1, 40))) + opening)
    known = leaks.Passages(list(enumerate(items)))
    plain = [known.search(text) for text in texts]
    for text, found in zip(texts, plain):
        least = {k: edits_of(item, text) for k, item in enumerate(items)}
        assert {hit[0] for hit in found} == {k for k, edits in least.items() if edits <= leaks.edit_budget(len(items[k]))}
        for k, start, end, edits in found:
            assert edits_of(text[start:end], items[k]) <= edits == edits_of(items[k], text[start:end])
            assert edits == least[k] or any(hit[0] == k and hit[3] == least[k] for hit in found)
    # slices in halves and candidates in small groups find the same
    monkeypatch.setattr(leaks, "PAIRS", 50)
    monkeypatch.setattr(leaks, "CANDIDATES", 3)
    joined = b" ".join(texts)
    halved = known.search(joined)
    monkeypatch.undo()
    assert halved == known.search(joined) and len(halved) > 20


# --- language model ----------------------------------------------------------------------------------


def test_base_scores_equal_brute_force_and_the_model_is_better(spark, awkward, nothing):
    pattern = "the cat sat on the mat and the dog lay by the door . ".split()
    docs = spark.createDataFrame([(k, " ".join(pattern[k % 13 :] + pattern * 20)) for k in range(140)], "doc_id bigint, text string")
    docs = docs.union(awkward.select("doc_id", "text"))
    rows = texts_of(docs)
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    counts: Counter = Counter()
    for doc, text in rows:
        if not held(doc):
            counts.update([*text.encode().lower().split(), None])
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for doc, text in rows:
        own = [*text.encode().lower().split(), None]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)
        want.append((doc, held(doc), len(own), sum(counts[w] > 0 for w in own), total, round(base, 6)))
    got = lm.scored(docs).collect()
    assert ordered((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == ordered(want)
    mine = [r for r in got if r.held_out and r.id is not None and r.id > 20]
    assert mine and sum(r.score for r in mine) > 0.5 * sum(r.base_score for r in mine)
    assert all(r.score <= 0 for r in got)
    assert lm.scored(nothing).count() == 0


def test_model_probabilities_sum_to_one():
    import numpy as np

    model = lm.Model.fresh(np.full(9, 1 / 9))
    far, near = np.repeat(3, 9), np.repeat(9, 9)
    assert np.exp(model.log_probabilities(far, near, np.arange(9))).sum() == pytest.approx(1, abs=1e-5)


def test_words_are_split_and_counted_column_by_column(monkeypatch):
    import numpy as np
    import pyarrow as pa

    draw = random.Random(6)
    texts = [None, "", " ", "\t a  B\n", "É ß\x85x y\x1cZ", *("".join(draw.choice("aB é\n\t\x0b\x1f") for _ in range(draw.randint(0, 40))) for _ in range(300))]
    split = [(t or "").encode().lower().split() for t in texts]
    monkeypatch.setattr(lm, "_SLICE_BYTES", 200)
    monkeypatch.setattr(lm, "_CHUNK", 30)
    known = [b"a", b"ab", "é".encode()]
    parts = list(lm._chunks(pa.array(texts), pa.array(known, pa.binary()).cast(pa.string())))
    assert len(parts) > 20 and np.concatenate([p[1] for p in parts]).tolist() == list(map(len, split))
    assert [w.encode() for p in parts for w in p[0].to_pylist()] == [w for words in split for w in words]
    assert np.concatenate([p[2] for p in parts]).tolist() == [known.index(w) if w in known else 3 for words in split for w in words]


def test_sums_of_exp_scores_are_right_at_any_size():
    import numpy as np

    draw = np.random.default_rng(4)
    for size in (0.1, 3, 40):
        model = lm.Model.fresh(np.full(70, 1 / 70))
        model.vectors = (draw.normal(0, size, model.vectors.shape)).astype(np.float32)
        hidden = draw.normal(0, size, (3000, lm.SIZE)).astype(np.float32)
        scores = hidden.astype(np.float64) @ model.vectors[:70].T + model.biases[:70]
        top = scores.max(axis=1, keepdims=True)
        want = np.log(np.exp(scores - top).sum(axis=1)) + top[:, 0]
        assert np.abs(model._norms(hidden, slice(0, 70)) - want).max() < 1e-5 * max(1, np.abs(want).max())


def test_sums_of_exp_scores_are_taken_in_blocks_that_stay_in_cache():
    import tracemalloc

    import numpy as np

    model = lm.Model.fresh(np.full(700, 1 / 700))
    hidden = np.random.default_rng(4).normal(0, 1, (5000, lm.SIZE)).astype(np.float32)
    tracemalloc.start()
    model._norms(hidden, slice(0, 700))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 << 20


def test_a_step_changes_rows_by_their_summed_slopes():
    import numpy as np

    draw = np.random.default_rng(8)
    model = lm.Model.fresh(np.full(9, 1 / 9), draw.dirichlet(np.ones(70)), 40)
    trainer = lm.Trainer(model, seed=3)
    first = model.copied()
    far, near, token, noise = (draw.integers(0, len(model.vectors), n) for n in (50, 50, 50, lm.NOISE))
    share = draw.random(50).astype(np.float32)
    share /= share.sum()
    trainer._step(np.column_stack((near, far)), token, share, noise)
    trainer.seen = 1
    # the same with plain sums, row by row
    wide = [w.astype(np.float64) for w in first.weights()]
    vectors, biases, near_matrix, far_matrix = wide
    offset = np.log(lm.NOISE * np.concatenate((first.noise, [1], first.tail)))
    slopes = [np.zeros_like(w) for w in wide]
    for u, v, w, part in zip(far, near, token, share):
        hidden, back = vectors[v] @ near_matrix + vectors[u] @ far_matrix, 0
        for which, sign in ((w, -1), *((x, 1) for x in noise)):
            slope = sign * part / (1 + np.exp(-sign * (hidden @ vectors[which] + biases[which] - offset[which])))
            back = back + slope * vectors[which]
            slopes[0][which] += slope * hidden
            slopes[1][which] += slope
        slopes[0][v] += near_matrix @ back
        slopes[0][u] += far_matrix @ back
        slopes[2] += np.outer(vectors[v], back)
        slopes[3] += np.outer(vectors[u], back)
    want = first.copied()
    for weight, slope in zip(want.weights(), slopes):
        weight -= lm.RATE * slope / np.sqrt(1e-6 + slope * slope)
    got = lm._averaged(first, {block: np.frombuffer(x, np.float32).astype(np.float64).tobytes() for block, x in trainer.changes()})
    for own, other in zip(got.weights(), want.weights()):
        assert np.abs(own - other).max() < 1e-3 * lm.RATE
    # what trainers begin with stays as it is
    assert all((own == other).all() for own, other in zip(model.weights(), first.weights()))


def test_equal_triples_are_counted_whatever_the_size_of_the_vocabulary():
    import numpy as np

    draw = np.random.default_rng(8)
    for wide in (12, 3_000_000):
        far, near, token = (wide - 1 - draw.integers(0, 12, 3000) for _ in range(3))
        got = lm._distinct(far, near, token, wide)
        assert list(zip(*(x.tolist() for x in got))) == [(*k, n) for k, n in sorted(Counter(zip(far.tolist(), near.tolist(), token.tolist())).items())]


def test_known_words_are_looked_up_once_for_many_chunks(monkeypatch):
    import pyarrow as pa

    calls, look_up = [], lm.pc.index_in
    monkeypatch.setattr(lm, "_CHUNK", 30)
    monkeypatch.setattr(lm.pc, "index_in", lambda *a, **k: calls.append(1) or look_up(*a, **k))
    assert len(list(lm._chunks(pa.array(["a b c " * 5] * 60), pa.array(["a", "c"])))) == 20 and len(calls) == 1


def test_trainers_read_many_times_what_they_send(spark):
    draw = random.Random(5)
    texts = spark.createDataFrame([(" ".join(f"w{draw.randrange(900)}" for _ in range(400)),) for _ in range(300)], "text string").repartition(60)
    corpus = lm.Corpus.of(lm.token_counts(texts))
    model = corpus.fresh()
    trainers = lm._trainers(texts, corpus, model)
    assert trainers.count() == 300 and trainers.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism < 60


def test_words_beyond_the_most_frequent_have_probabilities_of_their_own(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(lm, "CLUSTER", 64)
    draw = random.Random(5)
    rows = [(k, " ".join(f"k{w} v{w}" for w in (draw.randrange(600) for _ in range(600)))) for k in range(260)]
    texts = spark.createDataFrame([(t,) for _, t in rows], "text string")
    corpus = lm.Corpus.of(lm.token_counts(texts))
    assert len(corpus.vocabulary) == 511 and len(corpus.tail) == 690 and corpus.other_tokens == 0
    model = lm.fitted(texts, corpus)
    number = corpus.rows(model)
    every = np.array([*number.values(), len(corpus.vocabulary)])
    for context in (number[corpus.tail[0]], number[corpus.vocabulary[0]], model.start):
        same = np.repeat(context, len(every))
        assert np.exp(model.log_probabilities(np.repeat(model.start, len(every)), same, every)).sum() == pytest.approx(1, abs=1e-4)
    # beyond the most frequent words too, the word before tells more than the counts
    pairs = [(number[b"k%d" % w], number[b"v%d" % w], corpus.head[b"v%d" % w]) for w in range(600) if number[b"v%d" % w] > model.start]
    near, token, count = (np.array(x) for x in zip(*pairs))
    gained = model.log_probabilities(np.repeat(model.start, len(near)), near, token) - np.log(count / corpus.tokens)
    assert gained.mean() > 0.5


# --- toxicity ----------------------------------------------------------------------------------------


def test_toxic_words_are_learnt_on_held_out_rows(spark, awkward, nothing):
    draw, rows, labels = random.Random(2), [], []
    for doc in range(900):
        toxic = doc % 6 == 0
        words = prose(doc, 60).split()
        for _ in range(4 if toxic else draw.choice([0, 0, 0, 1])):
            words.insert(draw.randrange(len(words)), draw.choice(["vile", "scum", "rotten"]) + draw.choice(["", ".", "!"]))
        rows.append((doc + 100, " ".join(words), "en"))
        labels += [(doc + 100, int(toxic))] if doc % 5 else []
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").unionByName(awkward.select("doc_id", "text", "lang"))
    marks = spark.createDataFrame(labels + [(None, 1), (3, None), (101, 0)], "doc_id bigint, toxic int")
    got = toxicity.scored(docs, toxicity.fitted(docs, marks)).collect()
    held = [r for r in got if r.held_out and r.id is not None and r.id >= 100]
    right = sum(r.predicted == int((r.id - 100) % 6 == 0) for r in held)
    assert len(got) == docs.count() and right > 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    one_class = toxicity.fitted(docs, marks.filter("toxic = 0"))
    assert {r.predicted for r in toxicity.scored(awkward, one_class).collect()} == {0}
    assert toxicity.scored(nothing, toxicity.fitted(nothing, marks)).count() == 0


# --- URLs --------------------------------------------------------------------------------------------


def test_rules_and_templates(spark):
    pages = [
        (1, "http://A.Example.com/en/1"), (2, "https://www.example.com/en/2#x"), (3, "http://example.com/de/3?q"), (4, "ftp://x.net/es/a"),
        (5, None), (6, "nothing"), (7, "http://com"), (8, "http://com/"), (9, "http://notexample.org/en/"), (None, "http://x.net/fr/"),
    ]
    pages += [(100 + k, f"http://shop.test/{'spam' if k % 2 else 'good'}/{k}.html") for k in range(80)]
    pages += [(300 + k, f"http://wide.test/{chr(97 + k // 26)}{chr(97 + k % 26)}x") for k in range(120)]
    labels = [(k, int(k % 2)) for k in range(80)] + [(None, 1)]
    key = F.expr(r"try_cast(regexp_extract(path, '/([0-9]+)\\.html$', 1) AS bigint)")
    result = {
        r.id: r for r in urls.judged(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "key bigint, bad int"), key).collect()
    }
    assert (result[1].host, result[1].path, result[1].rule, result[1].verdict) == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert (result[2].rule, result[2].verdict) == ("www.example.com/en/", "allow")
    assert (result[3].rule, result[3].path) == ("com/", "/de/3")
    assert (result[4].rule, result[4].verdict) == ("net/es/", "block")
    assert (result[5].host, result[5].path, result[5].rule) == ("", "", None) == (result[6].host, result[6].path, result[6].rule)
    assert (result[7].rule, result[8].rule, result[9].rule) == (None, "com/", None)
    assert result[None].rule == "net/fr/"
    assert {result[100 + k].verdict for k in range(80) if k % 2} == {"block"} and {result[100 + k].verdict for k in range(0, 80, 2)} == {"allow"}
    assert {result[100 + k].template.split("/")[1] for k in range(80)} == {"spam", "good"}
    assert len({result[300 + k].template for k in range(120)}) == 1
    empty = spark.createDataFrame([], "page_id bigint, url string")
    assert urls.judged(empty, spark.createDataFrame(labels, "key bigint, bad int"), key).count() == 0


def test_rare_and_deep_branches_are_judged_by_their_labels(spark):
    # a hundred sections of one host, two of them bad, and a choice at the sixth segment
    pages = [(k, f"http://hot.test/{chr(97 + k % 100 // 10)}{chr(97 + k % 10)}/{k}.html") for k in range(4000)]
    pages += [(k, f"http://deep.test/a/b/c/d/e/{'spam' if k % 2 else 'good'}/{k}.html") for k in range(4000, 4080)]
    pages += [(k, "http://deep.test" + "/z" * 300 + f"/{k}.html") for k in range(4080, 4090)]
    bad = lambda k: k % 100 in (7, 42) if k < 4000 else k < 4080 and k % 2 == 1
    labels = spark.createDataFrame([(k, int(bad(k))) for k in range(4090)], "key bigint, bad int")
    key = F.expr(r"try_cast(regexp_extract(path, '/([0-9]+)\\.html$', 1) AS bigint)")
    got = urls.judged(spark.createDataFrame(pages, "page_id bigint, url string"), labels, key).collect()
    assert len(got) == 4090 and {(r.id, r.verdict) for r in got} == {(k, "block" if bad(k) else "allow") for k in range(4090)}
    assert len({r.template for r in got if r.host == "hot.test"}) == 3


# --- mixing ------------------------------------------------------------------------------------------


def test_shortages_go_to_siblings_first(spark):
    rows, doc = [], 0
    for source, lang, count in (("src0", "en", 10), ("src1", "en", 200), ("src0", "de", 200), ("src7", "en", 400)):
        for _ in range(count):
            rows.append((doc, prose(doc, 10), lang, source))
            doc += 1
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    weights = spark.createDataFrame([("d0", None, None, 1), ("d1", None, None, 1)], "domain string, language string, source string, weight bigint")
    got = mixing.mixed(docs, weights, choices.mix_domain(), budget_percent=50, max_epochs=2, seed=1).groupBy("domain", "language", "source").agg(
        F.sum("n_tokens").alias("n"), F.countDistinct("id", "epoch").alias("rows")
    ).collect()
    taken = {(r.domain, r.language, r.source): r.n for r in got}
    # 4050 tokens: half a domain, a quarter a language of d0; src0/en can give 200 of its 506, src1/en the rest
    assert taken[("d0", "en", "src0")] == 200
    assert 800 <= taken[("d0", "en", "src1")] <= 812 and 1000 <= taken[("d0", "de", "src0")] <= 1012
    assert 2010 <= taken[("d1", "en", "src7")] <= 2025
    assert all(r.rows * 10 == r.n for r in got)


def test_mixing_awkward_rows(awkward, nothing, spark):
    weights = choices.mix_weights(spark)
    first = mixing.drawn(awkward, weights, choices.mix_domain(), **choices.MIX)
    assert first.columns == [c for c in awkward.columns if c != "epoch"] + ["epoch"]
    assert ordered(map(tuple, first.collect())) == ordered(map(tuple, mixing.drawn(awkward.repartition(5), weights, choices.mix_domain(), **choices.MIX).collect()))
    assert mixing.drawn(nothing, weights, choices.mix_domain(), **choices.MIX).count() == 0
    none = spark.createDataFrame([("d0", None, None, 0)], weights.schema)
    assert mixing.mixed(awkward, none, choices.mix_domain()).filter("domain = 'd0'").count() == 0


def test_a_prefix_over_many_ranges_is_the_plain_prefix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 8)
    rows = [(k, prose(k, 1 + k % 7), "en", "src0") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    weights = spark.createDataFrame([], "domain string, language string, source string, weight bigint")
    got = {r.id for r in mixing.mixed(docs, weights, choices.mix_domain(), budget_percent=37, seed=5).collect()}
    order = sorted(rows, key=lambda r: hashlib.md5(f"5:0:{r[0]}".encode()).hexdigest())
    want, total, limit = set(), 0, sum(len(r[1].split()) for r in rows) * 37 // 100
    for row in order:
        total += len(row[1].split())
        if total <= limit:
            want.add(row[0])
    assert got == want


# --- pipeline ----------------------------------------------------------------------------------------


def test_every_stage_takes_awkward_and_empty_tables(spark, awkward, nothing, tmp_path):
    spark.createDataFrame([(1, prose(4, 20)), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (awkward, nothing):
            result = stage(spark, docs, str(tmp_path))
            if name != "mixing_to_weights":
                assert result.columns == docs.columns, name
            assert result.count() <= 3 * docs.count()


def plain(seed, count):
    """As prose, with enough stop words for the quality rules."""
    return " ".join(w if k % 4 else "of the" for k, w in enumerate(prose(seed, count).split()))


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    clean = [(k, plain(k, 80), "en", f"src{k % 4}", 1) for k in range(40)]
    leaked, item = plain(900, 40), plain(901, 20)
    copied = "\n".join(plain(910 + k, 12) for k in range(3))
    bad = [
        (100, clean[0][1], "en", "src0", 1), (101, clean[1][1] + " more", "en", "src0", 1), (102, leaked + " " + item, "en", "src0", 1),
        (103, "### $$$ " * 60, "en", "src0", 1), (104, plain(905, 40) + "\n" + copied, "en", "src0", 1), (105, plain(906, 40) + "\n" + copied, "en", "src0", 1),
    ]
    spark.createDataFrame(clean + bad, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id: r.text for r in docs.collect()})
    every = set(range(40)) | {100, 101, 102, 104, 105}
    assert set(seen[0]) == every and set(seen[1]) == every
    assert seen[1][104].endswith(copied) and seen[1][105] == plain(906, 40)
    assert set(seen[2]) == every - {100, 101} and set(seen[3]) == every - {100, 101, 102}
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert set(final.columns) == {*SCHEMA.replace(",", "").split()[::2], "epoch"} and 0 < final.count()
    assert {r.doc_id for r in final.collect()} <= set(seen[3])


# --- repeated ids ------------------------------------------------------------------------------------


def test_unlike_texts_under_one_id_all_stay(spark):
    one, two, three = prose(31, 80), prose(32, 80), prose(33, 80)
    rows = [(5, one), (5, two), (5, two), (3, two + " more"), (-4, three), (12, three), (None, one), (7, None), (7, prose(34, 40)), (10**18, prose(35, 50)), (2, prose(35, 50))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, own_id string")
    got = sorted(((r.doc_id, r.text) for r in nearcopies.one_of_each(docs).collect()), key=repr)
    assert got == sorted([(5, one), (3, two + " more"), (-4, three), (None, one), (7, None), (7, prose(34, 40)), (2, prose(35, 50))], key=repr)
    named = nearcopies.one_of_each(docs.filter("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("string")))
    assert {r.text for r in named.collect()} == {t for _, t in got if t} | {None}

"""Fingerprints of documents by locally consistent parsing.

A text is a sequence of code points. On every level runs of one symbol become one symbol; the rest is
cut by deterministic coin tossing: each symbol is told from its left neighbour by the lowest bit in
which their names differ, that bit and its place are its new colour, and four rounds leave colours
0 to 5, which two neighbours never share. Colours 3 to 5 then take the smallest colour free between
their neighbours, and a phrase begins at every local maximum. Phrases, of two to four symbols but at the
ends of a text, are named by what they hold, and their names are the symbols of the next level, until
one is left. Where a phrase begins depends on a few symbols around it alone: equal substrings have equal
phrases inside, wherever they stand.

The names of a text's phrases from level 3 on (about twenty characters and longer; of shorter texts the
last name alone) are its set, and the fingerprint holds the 64 smallest of the set, as 8 hexadecimal
digits each, rising. Likeness is the share of names that two sets have in common, 2 |A and B| / (|A| + |B|),
estimated from the 64 smallest names of both together; equal fingerprints have likeness 1, and an empty
text is like an empty one only.

A null text is empty. `edited` compares every document with an edited version of itself, for which it
needs the next document: documents are ordered by falling id, null ids last, equal ids by a hash of the
text and then the text, and the first follows the last. A single document follows itself. Repeated rows
are documents like any other; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.shared import as_bytes, mixed

KEPT = 64
LEAST_LEVEL = 3
# Characters parsed at once; a longer text is parsed alone.
_TOGETHER = 1 << 19
# Keys looked at to cut the order of documents into parts, for each part.
_SAMPLED = 32
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)
_LEVELS = 0xD6E8FEB86659FD93


def _tosses(size: int) -> np.ndarray:
    """New colour by (own colour, left neighbour's) for colours below `size`."""
    own, left = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    away = own ^ left
    low = away & -away
    place = np.zeros_like(low)
    for k in range(1, 8):
        place[low == 1 << k] = k
    return (2 * place + ((own & low) != 0)).astype(np.uint8)


# 64 bits leave colours below 128; further rounds leave colours below 14, 8 and 6.
_ROUNDS = tuple(_tosses(size) for size in (128, 14, 8))
# The smallest of three colours that neither neighbour has; 6 stands for no neighbour.
_FREE = np.array([[min({0, 1, 2} - {a, b}) for b in range(7)] for a in range(7)], dtype=np.uint8)


def _runs(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one symbol to one symbol: new names, and which begin a text."""
    begins = first.copy()
    begins[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(begins)
    lengths = np.diff(np.append(at, len(names))).astype(np.uint64)
    # a symbol that stands alone is named as a run of one
    return mixed(names[at] + lengths * _PLACES[1]), first[at]


def _phrase_starts(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin in texts whose neighbouring symbols differ."""
    left = np.empty_like(names)
    left[1:] = names[:-1]
    left[first] = ~names[first]  # a first symbol is told by its lowest bit
    away = names ^ left
    low = away & (~away + np.uint64(1))
    place = np.frexp(low.astype(np.float64))[1] - 1
    colour = (2 * place + ((names & low) != 0)).astype(np.uint8)
    for table in _ROUNDS:
        left = np.empty_like(colour)
        left[1:] = colour[:-1]
        left[first] = colour[first] ^ 1
        colour = table[colour, left]
    last = np.empty_like(first)
    last[:-1], last[-1] = first[1:], True
    near, far = np.empty_like(colour), np.empty_like(colour)

    def look_around() -> None:
        near[1:], far[:-1] = colour[:-1], colour[1:]
        near[first], far[last] = 6, 6

    for high in (3, 4, 5):
        look_around()
        where = colour == high
        colour[where] = _FREE[near[where], far[where]]
    look_around()
    top = ((colour > near) | first) & ((colour > far) | last)
    return top & ~last | first


def _parsed(names: np.ndarray, first: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """One level up: the names of the phrases, and which begin a text."""
    starts = _phrase_starts(names, first)
    at = np.flatnonzero(starts)
    lengths = np.diff(np.append(at, len(names)))
    inside = np.arange(len(names)) - np.repeat(at, lengths)
    # a phrase at the end of a text may be longer than the rest; places repeat after four
    terms = mixed(names + _PLACES[inside & 3] * (inside + 1).astype(np.uint64))
    sums = np.add.reduceat(terms, at)
    return mixed(sums ^ mixed(lengths.astype(np.uint64) + np.uint64(_LEVELS * level % 2**64))), first[at]


def _sketches(texts: list[str]) -> list[np.ndarray]:
    """The KEPT smallest names of every text, rising, as 32-bit numbers."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owners = np.flatnonzero(lengths)
    first = np.zeros(len(points), dtype=bool)
    first[(np.cumsum(lengths) - lengths)[owners]] = True
    names, level = mixed(points.astype(np.uint64) + np.uint64(1)), 0
    found: list[np.ndarray] = []
    while len(names):
        names, first = _runs(names, first)
        names, first = _parsed(names, first, level)
        level += 1
        starts = np.flatnonzero(first)
        counts = np.diff(np.append(starts, len(names)))
        whole = counts == 1
        text = np.repeat(np.arange(len(starts)), counts)
        kept = np.ones(len(names), dtype=bool) if level >= LEAST_LEVEL else np.repeat(whole, counts)
        found.append((owners[text[kept]].astype(np.uint64) << np.uint64(32)) | (names[kept] >> np.uint64(32)))
        # texts that have become one symbol are done
        go_on = np.repeat(~whole, counts)
        names, first, owners = names[go_on], first[go_on], owners[~whole]
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
    edges = np.searchsorted(pairs >> np.uint64(32), np.arange(len(texts) + 1, dtype=np.uint64))
    return [(pairs[a : min(b, a + KEPT)] & np.uint64(0xFFFFFFFF)).astype(np.uint32) for a, b in zip(edges, edges[1:])]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """As _sketches, in batches of bounded size."""
    made: list[np.ndarray] = []
    batch, held = [], 0
    for text in texts:
        if batch and held + len(text) > _TOGETHER:
            made += _sketches(batch)
            batch, held = [], 0
        batch.append(text)
        held += len(text)
    return made + (_sketches(batch) if batch else [])


def fingerprint(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of names in common, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    one, two = set(a.tolist()), set(b.tolist())
    smallest = sorted(one | two)[:KEPT]
    shared = len((one & two).intersection(smallest)) / len(smallest)
    return 2 * shared / (1 + shared)


def _texts(column: pa.Array) -> list[str]:
    return [b.decode("utf-8", "replace") for b in as_bytes(column)]


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of every document; nothing is shuffled."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(1))
            columns = [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(fingerprint, sketches(texts)))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_chars", "fingerprint"])

    schema = f"id {docs.schema[id].dataType.simpleString()}, n_chars long, fingerprint string"
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(made, schema)


def _dealt(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(part, copy, id, hash, text): the order of documents in parts; copy 1 is the first document behind a part.

    Each part is a partition. Parts are cut by (id, hash) at keys drawn from all rows, as a range partitioning would cut them, but
    longer texts are likelier to be drawn, so that parts are of about equal size. The driver holds keys in proportion to the
    number of parts, no texts.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("hash"), "text")
    keys = rows.select("id", "hash")

    def place(id: int | None, hash: int) -> tuple[int, int, int]:
        return (1, 0, hash) if id is None else (0, -id, hash)

    # about _SAMPLED keys a part, the chance of a key growing with its text
    sized = rows.select("id", "hash", (F.octet_length("text") + 64).alias("size"))
    total = sized.agg(F.sum("size")).first()[0] or 1
    chance = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(2**52)) / float(2**52)
    drawn = sized.filter(chance < F.col("size") * (_SAMPLED * parts / total)).select("id", "hash").collect()
    order = sorted({place(*r) for r in drawn})
    step = max(1, -(-len(order) // parts))
    bounds = order[step::step]

    def part_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        pairs = zip(ids.to_pylist(), hashes.to_pylist())
        return pa.array([bisect_right(bounds, place(*p)) for p in pairs], pa.int32())

    foremost = F.max(F.struct(F.col("id").isNotNull(), F.col("id"), F.bitwise_not("hash"))).alias("first")
    firsts = keys.select("id", "hash", F.arrow_udf(part_of, "int")("id", "hash").alias("part")).groupBy("part").agg(foremost)
    held = sorted(firsts.collect())
    # where the first document of each part has its copy: in the part before, in a circle
    before = {place(r["first"][1], ~r["first"][2]): held[k - 1]["part"] for k, r in enumerate(held)}

    def parts_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        places = [place(*p) for p in zip(ids.to_pylist(), hashes.to_pylist())]
        own = [bisect_right(bounds, at) for at in places]
        return pa.array([[p, before[at]] if at in before else [p] for p, at in zip(own, places)], pa.list_(pa.int32()))

    numbers = F.posexplode(F.arrow_udf(parts_of, "array<int>")("id", "hash")).alias("copy", "part")
    placed = rows.select("id", "hash", "text", numbers).select("part", "copy", "id", "hash", "text")
    return placed.repartitionById(len(bounds) + 1, "part")


def edited(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the next
    document. Texts are shuffled once, into parts of the order; a task streams its part.
    """
    order = _dealt(docs, id, text)
    order = order.sortWithinPartitions("part", "copy", F.col("id").desc_nulls_last(), "hash", "text")
    fields = (
        ("id", docs.schema[id].dataType.simpleString()), ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"),
        ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"),
    )

    def compared(known: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        """All but the last of some consecutive rows (part, copy, id, text), each with the one behind it."""
        own = sketches([row[3] for row in known])
        pairs = [k for k in range(len(known) - 1) if known[k][0] == known[k + 1][0] and not known[k][1]]
        kept = [known[k][3] for k in pairs]
        changed = [t[: len(t) - len(t) // 2] + known[k + 1][3][: len(t) // 2] for k, t in zip(pairs, kept)]
        other = sketches(changed)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([known[k][2] for k in pairs], id_type),
                pa.array(map(len, kept), pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array([fingerprint(own[k]) for k in pairs], pa.string()),
                pa.array(map(fingerprint, other), pa.string()),
                pa.array([likeness(own[k], o) for k, o in zip(pairs, other)], pa.float64()),
                pa.array([likeness(own[k], own[k + 1]) for k in pairs], pa.float64()),
            ],
            [name for name, _ in fields],
        )

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        held = 0
        for batch in batches:
            parts, copies, ids = (batch.column(k).to_pylist() for k in range(3))
            for row in zip(parts, copies, ids, _texts(batch.column(3))):
                waiting.append(row)
                held += len(row[3])
                if held > _TOGETHER:
                    yield compared(waiting, batch.column(2).type)
                    waiting = waiting[-1:]
                    held = len(row[3])
        if waiting:
            yield compared(waiting, batch.column(2).type)

    return order.select("part", "copy", "id", "text").mapInArrow(streamed, ", ".join(map(" ".join, fields)))

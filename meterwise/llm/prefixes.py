"""A trie of the prefixes that conversations share, by recursive halving of its depth.

As in the layout of van Emde Boas, sequences are cut at half their depth. The prefixes down to the cut are
named; the upper half of the trie and the forests below the cut, one under each name, are built in
the same way and at the same time, so a trie of any depth takes as many rounds as its depth has binary
digits, and a conversation of any length is spread over its turns:

* What lies between two cuts is known by a hash: of a turn (128 bits of SHA-256), of two halves, of four quarters, and so on.
* A round names the prefixes that end in the middle of every piece. Two conversations share such a prefix
  if they share the name of where the piece begins and the hash of its first half. The name is the
  smallest conv_id among them, so (name, depth) is a node of the trie.
* Totals are grafted upwards, from small pieces to large: the total of every tree that hangs from a cut is added
  to all nodes above it in the piece of the same height, until one piece is left.

Groups are summed map-side and joined by their names, so one first turn of a third of all
conversations is one row on one side of a join that adaptive execution splits. A task never holds a
conversation, or the members of a node. Rounds are written to the shared folder.

Turns without conv_id belong to no conversation and are left out; a null role or text is empty. Turns are
ordered by turn, null first, equal ones by role and then by the hash of role and text; equal rows are turns
like any other. Texts that differ only in where the role ends differ. Further columns are ignored. Without
conversations there are no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.llm.shared import WORD, written

# Ids put into one string at once, as a power of two, before a node's strings are hashed in order.
_CHUNK_BITS = 8
_ROW_BITS = 33  # of monotonically_increasing_id: below them the row, above the partition
_NOTHING = hashlib.sha256(b"").hexdigest()


def _hash(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, part, at, hash, words): every turn with its place in its conversation, from 1.

    Rows are sorted over all partitions, so a long conversation lies in several; the places of a partition's
    rows begin where those of the same conversation in earlier partitions end. `part` says which partition.
    """
    said, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    rows = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), who.alias("role"),
        _hash(F.octet_length(who).cast("string").cast("binary"), F.lit(":").cast("binary"), who.cast("binary"), said.cast("binary")).alias("hash"),
        F.regexp_count(said, F.lit(WORD)).cast("bigint").alias("words"),
    )
    order = ("conv_id", F.col("turn").asc_nulls_first(), "role", "hash")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = written(dealt.select("conv_id", "hash", "words", F.monotonically_increasing_id().alias("row")))
    kept = kept.select(
        "conv_id", "hash", "words", F.shiftright("row", _ROW_BITS).alias("part"), F.col("row").bitwiseAND((1 << _ROW_BITS) - 1).alias("row")
    )
    runs = kept.groupBy("conv_id", "part").agg(F.min("row").alias("low"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low") + 1).alias("shift"))
    return kept.join(runs, ["conv_id", "part"]).select("conv_id", "part", (F.col("row") + F.col("shift")).alias("at"), "hash", "words")


def lengths(places: DataFrame) -> DataFrame:
    return places.groupBy("conv_id").agg(F.max("at").alias("length"))


def branched(places: DataFrame, step: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations that go on from another one's first turns: (conv_id, length) and (conv_id, at, hash, words).

    Conversation c begins with the first h turns of conversation c - c % step (all if it has fewer, none if there is no
    such conversation) and goes on with its own after its first h; h = crc32(decimal c) % (most + 1).
    """
    places = written(places)
    share = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    heads = places.filter(f"at <= {most} AND conv_id % {step} = 0").groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("at", "hash", "words"))).alias("head")
    )
    all_of = lengths(places).withColumns({"base": F.expr(f"conv_id - conv_id % {step}"), "h": share})
    taken = F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array().cast("array<struct<at:bigint,hash:binary,words:bigint>>"))
    plans = written(all_of.join(heads, "base", "left").select("conv_id", "length", "h", taken.alias("taken")))
    n_taken = F.size("taken")
    runs = places.select("conv_id", "part").distinct().join(plans.select("conv_id", "h", n_taken.alias("n")), "conv_id")
    own = places.join(runs, ["conv_id", "part"]).filter("at > h").select("conv_id", (F.expr("at - h + n")).alias("at"), "hash", "words")
    borrowed = plans.select("conv_id", F.inline("taken")).select("conv_id", "at", "hash", "words")
    convs = plans.select("conv_id", (n_taken + F.greatest(F.col("length") - F.col("h"), F.lit(0))).cast("bigint").alias("length"))
    return convs, own.unionByName(borrowed)


def _together(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _blocks(turns: DataFrame, levels: int) -> DataFrame:
    """(level, conv_id, block, hash) of the first halves of all pieces: whole blocks of 2^level turns, even ones."""
    level = turns.select("conv_id", (F.col("at") - 1).alias("block"), "hash")
    found = []
    for k in range(levels):
        found.append(level.filter("block % 2 = 0").withColumn("level", F.lit(k)))
        left, right = (F.max(F.when(F.col("block") % 2 == side, F.col("hash"))) for side in (0, 1))
        halves = level.groupBy("conv_id", F.shiftright("block", 1).alias("block")).agg(left.alias("left"), right.alias("right"))
        level = halves.filter("left IS NOT NULL AND right IS NOT NULL").select("conv_id", "block", _hash(F.col("left"), F.col("right")).alias("hash"))
    return _together(found)


def names(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, int]:
    """(conv_id, depth, name) for every prefix of every conversation, depth 0 included, and the rounds it took."""
    [known] = convs.agg(F.max("length").alias("longest"), F.min("conv_id").alias("root")).collect()
    rounds = (known["longest"] or 0).bit_length()
    root = F.lit(known["root"]).cast("bigint")
    named = convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), root.alias("name"))
    if not rounds:
        return named, 0
    blocks = written(_blocks(turns, rounds))
    found = [named]
    for k in range(rounds - 1, -1, -1):
        half = 1 << k
        pieces = blocks.filter(F.col("level") == k).select(
            "conv_id", (F.col("block") * half).alias("start"), (F.col("block") * half + half).alias("depth"), "hash"
        )
        first = pieces.filter("start = 0").withColumn("above", root)
        if len(found) == 1:
            pieces = first
        else:
            starts = _together(found[1:]).select("conv_id", F.col("depth").alias("start"), F.col("name").alias("above"))
            pieces = first.unionByName(pieces.filter("start > 0").join(starts, ["conv_id", "start"]))
        keys = ["depth", "above", "hash"]
        groups = pieces.groupBy(*keys).agg(F.min("conv_id").alias("name"))
        found.append(written(pieces.join(groups, keys).select("conv_id", "depth", "name")))
    return _together(found), rounds


def _grafted(nodes: DataFrame, named: DataFrame, rounds: int, values: list[str]) -> DataFrame:
    """(name, depth) and `values` summed over the subtree of every node."""
    sums = [F.sum(v).alias(v) for v in values]
    parts = [nodes.select("name", "depth", *values)]
    paths = named.select(F.col("conv_id").alias("below"), "depth", "name")
    for k in range(rounds):
        cut = F.col("depth") % (2 << k) == 1 << k
        tops = _together([p.filter(cut) for p in parts]).groupBy("name", "depth").agg(*sums)
        above = F.explode(F.sequence(F.col("depth") - (1 << k), F.col("depth") - 1))
        sent = tops.select(F.col("name").alias("below"), above.alias("depth"), *values).join(paths, ["below", "depth"])
        parts.append(written(sent.groupBy("name", "depth").agg(*sums)))
    return _together(parts).groupBy("name", "depth").agg(*sums)


def _hashed(ends: DataFrame) -> DataFrame:
    """(name, depth, ends_sha256) of (name, depth, conv_id): the ids in numerical order, comma-joined, in a stream."""
    chunks = ends.groupBy("name", "depth", F.shiftright("conv_id", _CHUNK_BITS).alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )
    chunks = chunks.repartition("name", "depth").sortWithinPartitions("name", "depth", "chunk")

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for name, depth, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (name, depth) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (name, depth), hashlib.sha256(ids.encode())
            yield batch_of(done)
        if node is not None:
            yield batch_of([(*node, state.hexdigest())])

    def batch_of(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [(), (), ()]
        types = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["name", "depth", "ends_sha256"])

    return chunks.select("name", "depth", "ids").mapInArrow(streamed, "name long, depth long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `convs` has (conv_id, length), turnless conversations included; `turns` has (conv_id, at, hash, words) for places 1 to length.
    """
    convs, turns = written(convs), written(turns)
    named, rounds = names(convs, turns)
    keys = ["name", "depth"]
    said = turns.select(F.col("conv_id").alias("name"), F.col("at").alias("depth"), "words")
    parents = named.select(F.col("conv_id").alias("name"), (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    nodes = named.groupBy(*keys).agg(F.count("*").alias("n_convs")).join(said, keys, "left").join(parents, keys, "left")
    nodes = written(nodes)
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("name"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children")
    )
    nodes = nodes.join(children, keys, "left").select(
        *keys, "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        ((F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))).alias("saved_tokens"), F.col("n_children").isNull().cast("bigint").alias("n_leaves"),
    )
    nodes = written(nodes)
    totals = _grafted(nodes, named, rounds, ["n_leaves", "saved_tokens"])
    ends = convs.withColumnRenamed("length", "depth").join(named, ["conv_id", "depth"]).select(*keys, "conv_id")
    whole = nodes.select(*keys, "parent", "n_convs", "n_children").join(totals, keys).join(_hashed(ends), keys, "left")
    return whole.select(
        F.col("name").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.col("n_children").cast("bigint").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"),
    )

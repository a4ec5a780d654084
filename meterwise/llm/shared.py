"""What several operators need: words, ids of words, kept intermediate tables, connected components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.session import ensure_checkpoint_dir

# Fixed: a word is a run of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"
BREAK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def settled(table: DataFrame) -> DataFrame:
    """Compute a table that several results read, once, into the checkpoint folder the cluster names."""
    ensure_checkpoint_dir(table.sparkSession)
    return table.checkpoint()


def written(table: DataFrame) -> DataFrame:
    """As settled, as Parquet in the same folder: smaller, for tables of many narrow rows."""
    spark = table.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.parquet(path)


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def lowered_words(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased. Bytes know exactly the six breaks and those 26 letters."""
    return text.lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def word_ids(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge table (a, b): one row (id, component) per id with an edge.

    The component is the smallest id in it. Every round hangs the neighbours of each id below its
    smallest neighbour, first those above the id, then those below; only ids and their minima are
    grouped and joined, so a hub of any degree is summed map-side and its join can be split. Rounds
    grow with the logarithm of the longest path. Nothing but a count and a checksum reaches the driver.
    """

    def checksum(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # each pair as (a, b) with a the larger id
    stars = settled(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    last = checksum(stars)
    while last[0]:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        below = large.join(lowest, "a").select("a", "b", "m")
        small = below.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = settled(small.union(lowest.select("a", F.col("m").alias("b"))).distinct())
        now = checksum(stars)
        if now == last:
            break
        last = now
    roots = stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def united(count: int, pairs) -> list[int]:
    """For 0..count-1 joined by `pairs`, the smallest index each can reach."""
    up = list(range(count))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in pairs:
        x, y = top(int(x)), top(int(y))
        up[max(x, y)] = min(x, y)
    return [top(x) for x in range(count)]

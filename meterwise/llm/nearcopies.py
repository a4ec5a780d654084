"""Near-duplicate documents by min-max hashing.

A document's set is its distinct word shingles, as 64-bit values. Under every permutation both the
smallest and the largest value are kept: each is an unbiased estimate of the similarity, so half the
permutations give a signature of full length. Two permutations (four values) make a band; documents
that agree in a band are compared on their full sets.

Scale:
* Equal sets are one node. They are found by a digest, so copies, however many, meet only in sums.
* Bands are hung in stars on the smallest id of a bucket, so buckets cost their size, not its square.
  Connected stars are the clusters; each document's set travels to its cluster once.
* A cluster of more than CLUSTER documents is compared bucket by bucket, in blocks of BLOCK by BLOCK
  documents, each block pair a task of its own. Only joining pairs leave a task: at most one less than
  it has documents.
Every candidate pair is decided on full sets; nothing is capped or sampled. A pair at the threshold
fails to agree in any of the 24 bands with a probability below 1e-5 at 0.8 and 1e-7 at 0.85.

Rows: a null or wordless text has an empty set and is linked with nothing. A null id is linked with
nothing and has no component. Repeated rows share their component; rows with one id and several texts
are judged text by text, under that id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterwise.llm.shared import as_bytes, components, lowered_words, mixed, settled, united, word_ids

BANDS, PERMUTATIONS_PER_BAND = 24, 2
CLUSTER, BLOCK = 512, 256
_CHUNK = 1 << 16


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Distinct shingles of `size` words, sorted; fewer words are one shingle, none is the empty set."""
    ids = word_ids(lowered_words(text))
    if not len(ids):
        return ids
    width = min(size, len(ids))
    value = mixed(ids[: len(ids) - width + 1] + np.uint64(width))
    for k in range(1, width):
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - width + 1 + k])
    return np.unique(value)


def _constants(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240817)
    flips, factors = draw.integers(0, 2**64, (2, count), dtype=np.uint64)
    return flips, factors | np.uint64(1)


def band_values(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS 64-bit values for each non-empty set."""
    flips, factors = _constants(BANDS * PERMUTATIONS_PER_BAND)
    bands = np.empty((len(sets), BANDS), dtype=np.uint64)
    sizes = np.array([len(s) for s in sets])
    first = 0
    while first < len(sets):
        last = first + 1
        total = sizes[first]
        while last < len(sets) and total + sizes[last] <= _CHUNK:
            total += sizes[last]
            last += 1
        values = np.concatenate(sets[first:last])
        starts = np.concatenate(([0], np.cumsum(sizes[first:last])[:-1]))
        for band in range(BANDS):
            value = np.full(last - first, band + 1, dtype=np.uint64)
            for k in range(band * PERMUTATIONS_PER_BAND, (band + 1) * PERMUTATIONS_PER_BAND):
                moved = (values ^ flips[k]) * factors[k]
                for extreme in (np.minimum, np.maximum):
                    value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + extreme.reduceat(moved, starts))
            bands[first:last, band] = value
        first = last
    return bands


def near_copies(
    docs: DataFrame, shingle: int = 3, percent: int = 85, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row; kept where the id is its component's smallest.

    Documents are linked where 100 * |intersection| >= percent * |union| of their sets.
    """
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in as_bytes(batch.column(1))]
            full = [s for s in sets if len(s)]
            rows = iter(band_values(full).astype(np.int64)) if full else iter(())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, sets), pa.int64()),
                 pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                 pa.array([next(rows) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                names=["id", "n", "digest", "bands"],
            )

    sketches = settled(narrow.mapInArrow(sketch, f"id {id_type}, n bigint, digest binary, bands array<bigint>"))
    nodes = (
        sketches.filter("digest IS NOT NULL AND id IS NOT NULL")
        .groupBy("digest").agg(F.min(F.struct("id", "bands")).alias("least"))
        .select("digest", F.col("least.id").alias("id"), F.col("least.bands").alias("bands"))
    )
    nodes = settled(nodes)
    posts = nodes.select("id", F.explode("bands").alias("bucket"))
    hubs = posts.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    shared = settled(posts.join(hubs, "bucket"))
    clusters = components(shared.select(F.col("hub").alias("a"), F.col("id").alias("b")))
    sizes = clusters.groupBy("component").agg(F.count("*").alias("members"))
    clusters = settled(clusters.join(sizes, "component"))

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle).tobytes() for t in as_bytes(batch.column(3))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(sets, pa.binary())],
                names=["id", "component", "members", "set"],
            )

    sets = settled(
        narrow.join(clusters, "id").select("id", "component", "members", "text")
        .mapInArrow(full_sets, f"id {id_type}, component {id_type}, members bigint, set binary")
    )

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        return _joining_pairs(group["id"].to_numpy(), group["set"].tolist(), percent)

    pair = f"a {id_type}, b {id_type}"
    small = sets.filter(F.col("members") <= CLUSTER).groupBy("component").applyInPandas(joined, pair)
    large = sets.filter(F.col("members") > CLUSTER)
    blocks = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64("id"), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))
    pieces = (
        shared.join(large.select("id", "set"), "id")
        .select("bucket", "id", "set", own.alias("own"), other.alias("other"))
        .select("bucket", "id", "set", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    )
    hot = pieces.groupBy("bucket", "low", "high").applyInPandas(joined, pair)
    linked = components(small.union(hot))
    labels = nodes.select("digest", "id").join(linked, "id", "left").select(
        "digest", F.coalesce("component", "id").alias("component")
    )
    with_id = F.col("id").isNotNull()
    return (
        sketches.drop("bands").join(labels, "digest", "left")
        .select("id", F.col("n").alias("n_shingles"), F.when(with_id, F.coalesce("component", "id")).alias("component_id"))
        .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    )


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs`, as they are, with one document of every group of near copies.

    The document with the smallest id stays, of equal ones a single row. Rows with one id and several texts are
    documents of their own: each stays unless it is a near copy of one that does. Rows with a null id stay.
    """
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_column).alias("own_id"), F.col(text_column).cast("string").alias("own_text")
    )
    hashed = F.xxhash64(F.coalesce("own_text", F.lit("")))
    shared = rows.filter("own_id IS NOT NULL").groupBy("own_id").agg(F.min(hashed).alias("least"), F.max(hashed).alias("most"))
    if not shared.filter("least <> most").isEmpty():
        rows = rows.withColumn("own_id", _told_apart(F.col("own_id"), F.col("own_text"), dict(docs.dtypes)[id_column]))
    kept = near_copies(rows, shingle, percent, "own_id", "own_text").filter("kept AND id IS NOT NULL").select(F.col("id").alias("kept_id")).distinct()
    named = rows.join(kept, F.col("own_id") == F.col("kept_id"), "left_semi")
    first = Window.partitionBy("own_id").orderBy("own_text")
    named = named.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("row")
    both = named.union(rows.filter("own_id IS NULL").select("row"))
    return both.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def _told_apart(id: Column, text: Column, id_type: str) -> Column:
    """An id for every (id, text), in the order of the ids."""
    if id_type in ("tinyint", "smallint", "int", "bigint"):
        # shifted above zero and padded, so that text is ordered as numbers are
        id = F.lpad((id.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(id.cast("string"), F.lit(" "), F.sha2(F.coalesce(text, F.lit("")), 256))


def _joining_pairs(ids: np.ndarray, packed: list[bytes], percent: int) -> pd.DataFrame:
    """Pairs that join the documents of one task as their links do, at most one less than there are documents."""
    order = np.argsort(ids, kind="stable")
    ids, sets = ids[order], [np.frombuffer(packed[i], dtype=np.uint64) for i in order]
    roots = united(len(sets), _linked(sets, percent)) if len(sets) > 1 else [0] * len(sets)
    pairs = [(ids[root], ids[k]) for k, root in enumerate(roots) if root != k]
    return pd.DataFrame(pairs, columns=["a", "b"], dtype=ids.dtype)


def _linked(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, columns = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), sizes)
    # shingles of a single document add nothing to an intersection
    spread = np.bincount(columns, minlength=len(values))
    dense = np.cumsum(spread > 1) - 1
    keep = spread[columns] > 1
    rows, columns = rows[keep], dense[columns[keep]]
    shared = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = max(1, 4_000_000 // len(sets))
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for low in range(0, int(columns[-1]) + 1 if len(columns) else 0, width):
        part = slice(*np.searchsorted(columns, (low, low + width)))
        present = np.zeros((len(sets), width), dtype=np.float32)
        present[rows[part], columns[part] - low] = 1
        shared += present @ present.T
    common = shared.astype(np.int64)
    whole = sizes[:, None] + sizes[None, :] - common
    left, right = np.nonzero(np.triu(100 * common >= percent * whole, 1))
    return zip(left.tolist(), right.tolist())

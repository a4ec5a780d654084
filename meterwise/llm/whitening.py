"""Whitening of embeddings: the leading components of their covariance, found by spectrum slicing.

A vector's entries become integers x = floor(64 c) + 1,000,000. Three passes over the table: exact
integer sums; exact integer products of deviations from the rounded-down mean, so that neither the
offset nor the order of the rows costs a digit; and the whitened values themselves, whose covariance
is measured before they are returned. Tasks hand on one sum for each entry, or pair of entries, of a
vector, and Spark adds them up. The driver holds matrices as wide as a vector and
nothing that grows with the number of rows; `slicing` finds the eigenvectors.

Rows whose vector is null, or holds a null, a NaN, an infinity or an entry of 2^46 or more (whose
integers would not be exact in double precision), are dropped. So are vectors of another than the most
frequent length (of equally frequent ones the longest). Components that explain 1e-10 of the variance
or less cannot be scaled to one and are not returned: there may be fewer than 32, and none if all vectors are
equal or empty. A deviation that does not fit a long is null. Null and repeated ids are rows like any
other; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.slicing import leading

COMPONENTS = 32
# Fixed: how entries become integers.
SCALE, OFFSET = 64, 1_000_000
LEAST_SHARE = 1e-10
_LARGEST = 2.0**46
_WHOLE = 2**53  # integers below are exact in double precision
_DECIMAL = pa.decimal128(38, 0)
_SUM = pa.schema([("i", pa.int32()), ("n", pa.int64()), ("total", _DECIMAL)])
_PRODUCT = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("total", _DECIMAL)])


@dataclass(frozen=True)
class Whitener:
    """What the rows are whitened with; as wide as a vector."""

    n: int
    totals: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def means(self) -> np.ndarray:
        return np.array([t // self.n for t in self.totals], dtype=np.int64)

    @property
    def parts(self) -> np.ndarray:
        """What the rounded-down means lack."""
        return np.array([t % self.n / self.n for t in self.totals])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.means) - self.parts) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over a row of (n x - S)^2, exactly."""
        away = x - self.means
        left = np.array([t % self.n for t in self.totals])
        largest = (int(np.abs(away).max(initial=0)) + 1) * self.n
        if largest**2 * max(x.shape[1], 1) < 2**63:
            return ((away * self.n - left) ** 2).sum(axis=1).tolist()
        exact = ((away.astype(object) * self.n - left.astype(object)) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]


def _integers(column: pa.Array, width: int) -> np.ndarray:
    entries = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
    return np.floor(SCALE * entries).astype(np.int64) + OFFSET


def valid(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(id, vector) of the rows that count, and their length."""
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    fits = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < _LARGEST))
    rows = rows.filter(F.col("vector").isNotNull() & fits)
    lengths = rows.groupBy(F.size("vector").alias("width")).count()
    usual = lengths.orderBy(F.desc("count"), F.desc("width")).first()
    width = usual["width"] if usual else 0
    return rows.filter(F.size("vector") == width), width


def _totals(rows: DataFrame, width: int) -> tuple[int, tuple[int, ...]]:
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = 0, [0] * width
        for batch in batches:
            x = _integers(batch.column(0), width)
            small = int(np.abs(x).max(initial=0)) * len(x) < 2**63
            totals = [a + int(b) for a, b in zip(totals, x.sum(axis=0) if small else x.astype(object).sum(axis=0))]
            n += len(x)
        if n:
            columns = [range(width), [n] * width, map(Decimal, totals)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _SUM)], schema=_SUM)

    sums = rows.select("vector").mapInArrow(summed, "i int, n long, total decimal(38,0)")
    found = sums.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("i").collect()
    return (found[0]["n"] if found else 0), tuple(int(r["total"]) for r in found)


def _products(rows: DataFrame, means: np.ndarray) -> np.ndarray:
    """Sums of products of deviations from the integer means, exact until they become doubles."""
    width = len(means)
    upper = np.triu_indices(width)

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(upper[0]), dtype=object)
        seen = False
        for batch in batches:
            away = _integers(batch.column(0), width) - means
            largest = int(np.abs(away).max(initial=0))
            # so many rows at once that a sum of products is still a whole number in double precision
            step = _WHOLE // max(largest * largest, 1)
            for k in range(0, len(away), max(step, 1)):
                part = away[k : k + max(step, 1)]
                part = part.astype(float if step else object)
                total = total + (part.T @ part)[upper].astype(np.int64 if step else object).astype(object)
                seen = True
        if seen:
            columns = [upper[0], upper[1], [Decimal(int(v)) for v in total]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PRODUCT)], schema=_PRODUCT)

    pairs = rows.select("vector").mapInArrow(multiplied, "i int, j int, total decimal(38,0)")
    found = pairs.groupBy("i", "j").agg(F.sum("total").cast("double").alias("total")).toArrow()
    matrix = np.zeros((width, width))
    i, j, total = (found.column(c).to_numpy() for c in ("i", "j", "total"))
    matrix[i, j] = matrix[j, i] = total
    return matrix


def fitted(rows: DataFrame, width: int, components: int = COMPONENTS) -> Whitener | None:
    """The components of all `rows` (id, vector); None if there are none."""
    n, totals = _totals(rows, width) if width else (0, ())
    if not n:
        return None
    means, parts = np.array([t // n for t in totals], dtype=np.int64), np.array([t % n / n for t in totals])
    covariance = _products(rows, means) / n - np.outer(parts, parts)
    trace = float(np.trace(covariance))
    values, vectors = leading(covariance, components, LEAST_SHARE * trace)
    return Whitener(n, totals, values, vectors, trace)


def identity_error(rows: DataFrame, model: Whitener) -> float:
    """How far the covariance of the whitened rows is from the identity, at its worst entry."""
    width, k = len(model.totals), len(model.values)
    upper = np.triu_indices(k)

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            z = model.whiten(_integers(batch.column(0), width))
            products += z.T @ z
            sums += z.sum(axis=0)
        i, j = np.append(upper[0], np.arange(k)), np.append(upper[1], np.full(k, -1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.append(products[upper], sums))], ["i", "j", "total"]
        )

    parts = rows.select("vector").mapInArrow(multiplied, "i int, j int, total double")
    found = parts.groupBy("i", "j").agg(F.sum("total").alias("total")).toArrow()
    i, j, total = (found.column(c).to_numpy() for c in ("i", "j", "total"))
    matrix, sums = np.zeros((k, k)), np.zeros(k)
    matrix[i[j >= 0], j[j >= 0]] = matrix[j[j >= 0], i[j >= 0]] = total[j >= 0]
    # the values are centred already; what rounding left of their mean goes as well
    sums[i[j < 0]] = total[j < 0]
    return float(np.abs(matrix / model.n - np.outer(sums, sums) / model.n**2 - np.eye(k)).max())


def whitened(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row per vector and component."""
    rows, width = valid(vectors, id, vector)
    schema = (
        f"id {vectors.schema[id].dataType.simpleString()}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    )
    model = fitted(rows, width, components)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    error, k = identity_error(rows, model), len(model.values)
    explained = model.values / model.trace

    def written_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # so many vectors at once that their rows stay a few megabytes
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                x = _integers(part.column(1), width)
                each = np.repeat(np.arange(len(x)), k)
                deviation = pa.array(model.deviations(x), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(each), model.n)),
                        deviation.take(pa.array(each)),
                        pa.array(model.whiten(x).ravel()),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(len(each), error)),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(written_out, schema)

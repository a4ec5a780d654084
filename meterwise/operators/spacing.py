"""Picking points that lie more than a gap apart: first come, first kept.

For each key, the earliest point is picked, then the earliest point more than `gap` after the last
pick, and so on. Every pick depends on the one before, which in one pass would need all points of a
key in one task. Instead, time is cut into blocks, and what a block does is summed up as a step function from
the moment at which it may first be entered to the last pick inside. A block is entered at its first point or within
one gap of its start, and walks from different entries soon meet, so a few steps describe it. Blocks
of blocks are summed up by composing the functions of their parts. The function of a key's whole time line is
then followed downwards once: it says where each block of blocks is entered, that where each block is
entered, and the picks inside are walked from there. All steps are exact; no task holds more than one block of
one key, or the steps of its blocks; points and steps are each worked out once and kept in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.kept import kept
from meterwise.operators.small import tasks_for

# Sizes of a block and of a block of blocks, in gaps. With gaps of a minute: four hours and six weeks.
BLOCK_GAPS = (256, 256**2)
_EVER = -(2**62)
# Points of a task. A group costs Python a millisecond however few points it has, so their bytes say little.
_POINTS_A_TASK = 5_000


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    at = table.column("at").to_numpy()
    last = table.column("last").to_numpy()
    order = np.argsort(at, kind="stable")
    return at[order], last[order]


def _last_pick(at: np.ndarray, last: np.ndarray, gap: int) -> np.ndarray:
    """For every step: the last pick of the walk that starts there, by pointer doubling."""
    end = len(at)
    step = np.append(np.searchsorted(at, last + gap, side="right"), end)
    final = np.arange(end + 1)
    while True:
        onward = step[final]
        moving = onward < end
        if not moving.any():
            return last[final[:end]]
        final = np.where(moving, onward, final)
        step = np.where(step[step] < end, step[step], step) if moving.sum() > 64 else step


def _entries(at: np.ndarray, last: np.ndarray, edge: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The step function of a block whose entries lie before `edge`, or at the first point from there on.

    A step (at, last) says: entered at `at` or earlier, but after the step before, the last pick is `last`.
    """
    final = _last_pick(at, last, gap)
    entries = min(int(np.searchsorted(at, edge, side="left")) + 1, len(at))
    at, final = at[:entries], final[:entries]
    steps = np.append(final[1:] != final[:-1], True)
    return at[steps], final[steps]


def _followed(at: np.ndarray, last: np.ndarray, enter: int, gap: int) -> tuple[list[int], list[int]]:
    """The steps taken by a walk that may begin at `enter`, and the moment from which each was open."""
    taken, opened = [], []
    while (k := int(np.searchsorted(at, enter))) < len(at):
        taken.append(k)
        opened.append(enter)
        enter = int(last[k]) + gap + 1
    return taken, opened


def spaced(points: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Rows (keys, at) of `points` (keys, at BIGINT, no duplicates) picked more than `gap` apart."""
    steps = T.StructType([points.schema[k] for k in keys] + [T.StructField(c, T.LongType()) for c in ("at", "last")])
    small, large = BLOCK_GAPS

    def rows(template: pa.Table, at: np.ndarray, last: np.ndarray) -> pa.Table:
        # The key is the same in the whole group: repeat its first row.
        same = template.select(keys).take(pa.array(np.zeros(len(at), dtype=np.int64)))
        return pa.table([*same.columns, pa.array(at, pa.int64()), pa.array(last, pa.int64())], names=[*keys, "at", "last"])

    def blocked(table: DataFrame, size: int) -> DataFrame:
        return table.withColumn("block", F.floor(F.col("at") / F.lit(size * gap)))

    def summed(size: int):
        def one(table: pa.Table) -> pa.Table:
            edge = (table.column("block")[0].as_py() * size + 1) * gap
            return rows(table, *_entries(*_sorted(table), edge, gap))

        return one

    def entered(table: pa.Table, enter: int) -> pa.Table:
        """Where the steps of a table are taken: `at` in the block they belong to, `last` the moment it opens."""
        at, last = _sorted(table)
        taken, opened = _followed(at, last, enter, gap)
        return rows(table, at[taken], np.array(opened, dtype=np.int64))

    def whole(table: pa.Table) -> pa.Table:
        return entered(table, _EVER)

    def inside(table: pa.Table, opening: pa.Table) -> pa.Table:
        if table.num_rows == 0 or opening.num_rows == 0:
            return rows(table, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        return entered(table, opening.column("last")[0].as_py())

    points = kept(points.select(*keys, "at", F.col("at").alias("last")))
    tasks = tasks_for(points.count(), _POINTS_A_TASK)

    def dealt(table: DataFrame, size: int):
        """The blocks of every key, over a number of tasks that is not lowered for the few bytes of small groups."""
        return blocked(table, size).repartition(tasks, *keys, "block").groupBy(*keys, "block")

    low = kept(dealt(points, small).applyInArrow(summed(small), steps))
    high = dealt(low, large).applyInArrow(summed(large), steps)
    picked = high.repartition(tasks, *keys).groupBy(*keys).applyInArrow(whole, steps)
    for size, table in ((large, low), (small, points)):
        picked = dealt(table, size).cogroup(dealt(picked, size)).applyInArrow(inside, steps)
    return picked.select(*keys, "at")

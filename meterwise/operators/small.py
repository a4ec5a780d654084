"""Evaluating expensive columns once, the first rows of every key, and rows dealt over tasks by their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SALTS = 64
# More tasks than this are no help: the driver has to list them.
_MOST_TASKS = 10_000


def once(table: DataFrame, *fields: Column) -> DataFrame:
    """Select `fields`, each evaluated exactly once a row whatever is selected or filtered later.

    The optimizer copies an expression of a projection into every place that uses it, and filters
    on it are moved below. Passing the finished fields through a generator prevents both.
    """
    computed = table.select(*fields)
    names = [F.col(f"`{c}`") for c in computed.columns]
    return computed.select(F.inline(F.array(F.struct(*names))))


def tasks_for(rows: int, rows_a_task: int) -> int:
    """How many tasks `rows` are dealt over, so many to each."""
    return min(_MOST_TASKS, max(1, -(-rows // rows_a_task)))


def spread(table: DataFrame, rows_a_task: int) -> DataFrame:
    """A stored table with its rows dealt evenly over tasks, so many to each; one of fewer rows as it is.

    Scans are cut, and shuffled partitions joined again, by their bytes. Where a row of a few bytes is much work, as is
    a record to write and parse, its table would be one task's. The table is counted, which for a stored one reads no rows.
    """
    tasks = tasks_for(table.count(), rows_a_task)
    return table.repartition(tasks) if tasks > 1 else table


def first_rows(table: DataFrame, keys: list[str], order: list[str], count: int) -> DataFrame:
    """The first `count` rows of every key, with their rank as `rn`.

    Ranked twice: first within parts of a key, chosen by a hash of the whole row, then over what is
    left of all parts. A key holding most of the rows is so ranked by many tasks, and the second
    ranking sees no more than `count` rows of each part.
    """
    salted = table.withColumn("salt", F.pmod(F.xxhash64(*table.columns), F.lit(_SALTS)))
    part = Window.partitionBy(*keys, "salt").orderBy(*order)
    near = salted.withColumn("rn", F.row_number().over(part)).filter(F.col("rn") <= count).drop("salt", "rn")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return near.withColumn("rn", F.row_number().over(whole)).filter(F.col("rn") <= count)

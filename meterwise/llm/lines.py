"""Line dedup by overlapping three-line windows.

The lines of a text are its \\n-separated parts that hold a word; blank lines are left in place. Every
three consecutive lines are a window. Of equal windows, anywhere in the table, the first by (id,
position) stays; the lines that later ones cover are removed, overlaps merged. Whatever is removed
has an earlier copy: the earliest copy of a line is in no later window. A text with fewer than three
lines has no window and stays as it is.

A window is known by a 128-bit digest. Digests are summed to their first place map-side, then joined
back to their places; both sides are narrow, and a window that a third of all documents share is one
row per task in the sum and a join that adaptive execution splits. The texts themselves move once, to
meet the positions to remove.

Rows: a null text stays null. Rows with a null id lose nothing and make nobody else lose anything.
Rows sharing an id are one document each: an equal window in two of them is a repeat only by position,
so exact repeats of a row stay alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.shared import WORD
from meterwise.operators.small import once

SPAN = 3


def _lines(text: Column) -> Column:
    """(line, place among all \\n-parts) of the lines with a word."""
    parts = F.transform(F.split(text, "\n"), lambda line, i: F.struct(line.alias("line"), i.alias("at")))
    return F.filter(parts, lambda part: part["line"].rlike(WORD))


def windows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per window: (id, pos, digest), pos counting the lines that hold a word."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).filter("id IS NOT NULL")
    # arrays read by position are finished first, or they would be made anew for every position
    lines = once(rows, F.col("id"), F.transform(_lines(F.col("text")), lambda part: part["line"]).alias("lines"))
    count = F.size("lines") - (SPAN - 1)
    digests = F.transform(
        F.slice("lines", F.lit(1), count),
        lambda line, i: F.unhex(F.md5(F.concat_ws("\n", line, *(F.get("lines", i + k) for k in range(1, SPAN))))),
    )
    return lines.filter(count > 0).select("id", F.posexplode(digests).alias("pos", "digest"))


def later_windows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, pos) of every window that has an equal one at a smaller (id, pos)."""
    places = windows(docs, id_column, text_column)
    first = places.groupBy("digest").agg(F.min(F.struct("id", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    repeated = places.join(first, "digest")
    return repeated.filter((F.col("id") > F.col("first.id")) | (F.col("pos") > F.col("first.pos"))).select("id", "pos").distinct()


def removals(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, removed): the sorted positions of the lines to remove, for the ids that lose any."""
    starts = later_windows(docs, id_column, text_column).groupBy("id").agg(F.collect_list("pos").alias("starts"))
    covered = F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (SPAN - 1))))
    return starts.select("id", F.array_sort(F.array_distinct(covered)).alias("removed"))


def _left_over(parts: Column, gone: Column) -> Column:
    """The text without the \n-parts at the positions `gone`."""
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    return F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")


def _cleaned(rows: DataFrame, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """`rows` (id, text, ...) with `n_lines`, `gone` (positions among all \n-parts, or null) and `left`."""
    lost = removals(docs, id_column, text_column)
    joined = once(
        rows.join(lost, "id", "left"), *(F.col(c) for c in rows.columns), F.col("removed"),
        F.transform(_lines(F.col("text")), lambda part: part["at"]).alias("at"), F.split("text", "\n").alias("parts"),
    )
    # rows that share an id pool their positions; those beyond a row's own lines fall away
    gone = F.array_compact(F.transform("removed", lambda k: F.get("at", k)))
    return (
        joined.withColumn("n_lines", F.coalesce(F.size("at"), F.lit(0)).cast("long"))
        .withColumn("gone", gone)
        .withColumn("left", F.when(F.col("gone").isNull(), F.col("text")).otherwise(_left_over(F.col("parts"), F.col("gone"))))
    )


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The table with repeated lines removed from its text; rows and columns as in the input.

    The input travels as one struct, so none of its column names can clash with the work columns.
    """
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_column).alias("id"), F.col(text_column).alias("text")
    )
    cleaned = _cleaned(rows, docs, id_column, text_column)
    return cleaned.select(*(F.col("left").alias(c) if c == text_column else F.col("row")[c].alias(c) for c in docs.columns))


def without_repeats_or_empties(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """As without_repeats, less the rows of which no line with a word is left."""
    cleaned = without_repeats(docs, id_column, text_column)
    return once(cleaned, *(F.col(f"`{c}`") for c in cleaned.columns)).filter(F.coalesce(F.col(text_column), F.lit("")).rlike(WORD))


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_lines, n_removed, text): lines with a word, how many go, and what is left, for every row."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return _cleaned(rows, docs, id_column, text_column).select(
        "id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.col("left").alias("text")
    )

"""Rule-based quality filter: a table of thresholds compiled into Spark projections.

Only Spark functions run: no Python, no shuffle. Every rule bounds one ratio of a text (length,
symbols, stop words, lines); a text is kept when the base rule and every rule of the table hold.

A null text has no words. An empty text fails the base rule (fewer than ten words). Rows are judged
one by one, so repeated rows, null ids and further columns change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.shared import BREAK, WORD
from meterwise.operators.small import once

WINDOW = 5
BASE_MIN_WORDS = 10
BASE_MAX_REPEATED_PERCENT = 20
SYMBOLS = "[#*$%&|<>]"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "as", "was", "with", "on", "by", "this", "are", "at",
    "be", "from", "or", "an", "der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist",
    "im", "dem", "nicht", "ein", "eine", "als", "le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "que",
    "qui", "dans", "pour", "par", "sur", "au", "est", "avec", "el", "los", "las", "y", "se", "del", "con", "una", "su",
    "para", "es", "al", "lo", "no", "o",
)


@dataclass(frozen=True)
class Rule:
    """`name` holds when the ratio lies within the bounds that are given."""

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None


# The table. Ratios are SQL over the measures below; a rule whose ratio is null holds.
RULES = (
    Rule("mean_word_length", "word_chars / nullif(n_words, 0)", low=2.0, high=20.0),
    Rule("symbols_per_word", "n_symbols / nullif(n_words, 0)", high=0.3),
    Rule("stop_word_share", "CASE WHEN n_words >= 30 THEN n_stop_words / n_words END", low=0.04),
    Rule("repeated_line_share", "n_dup_lines / nullif(n_lines, 0)", high=0.4),
    Rule("list_line_share", "n_list_lines / nullif(n_lines, 0)", high=0.9),
)


def measures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts of every text: (id, n_words, word_chars, n_symbols, n_stop_words, lines, repeats)."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    # array elements are read by position below, so the arrays are columns of their own projection
    split = docs.select(F.col(id_column).alias("id"), text.alias("body")).select(
        "id", "body",
        F.array_remove(F.split("body", BREAK), "").alias("words"),
        F.filter(F.split("body", "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    ).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    counted = split.select(
        "id", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda line: line.rlike(r"^\s*([-*•|>]|[0-9]+[.)])"))).cast("long").alias("n_list_lines"),
        _prints().alias("prints"),
    )
    # equal prints are only a hint; the windows themselves decide
    return (
        counted.withColumn("hint", F.size(F.array_distinct("prints")) < F.size("prints"))
        .withColumn("sorted", F.when(F.col("hint"), F.array_sort(F.transform("prints", lambda p, i: F.struct(p.alias("p"), i.alias("i"))))))
        .withColumn("starts", F.when(F.col("hint"), _repeated_starts()))
        .withColumn("n_repeat_words", F.when(F.col("hint"), _covered()).otherwise(F.lit(0)).cast("long"))
        .drop("words", "prints", "hint", "sorted", "starts")
    )


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The measures with `base_failed`, the names of the rules that failed, and `kept`."""
    measured = measures(docs, id_column, text_column)
    words, repeats = F.col("n_words"), F.col("n_repeat_words")
    base = (words < BASE_MIN_WORDS) | (100 * repeats > BASE_MAX_REPEATED_PERCENT * words)
    return (
        measured.withColumn("base_failed", base)
        .withColumn("failed_rules", F.array_compact(F.array(*(_failure(r) for r in rules))))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def kept_rows(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_column: str = "text") -> DataFrame:
    """The rows that are kept, as they are. They travel as one struct, so no column name can clash."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_column).alias("text"))
    # the verdict is finished before it is filtered on: a filter moved below would repeat all its parts
    verdicts = once(judged(rows, rules, "row", "text"), F.col("id"), F.col("kept"))
    return verdicts.filter("kept").select(*(F.col("id")[c].alias(c) for c in docs.columns))


def _failure(rule: Rule) -> Column:
    """The rule's name when it fails, else null."""
    ratio, fails = F.expr(rule.ratio), F.lit(False)
    if rule.low is not None:
        fails = fails | (ratio < rule.low)
    if rule.high is not None:
        fails = fails | (ratio > rule.high)
    return F.when(fails, F.lit(rule.name))


def _window(position: Column) -> Column:
    return F.slice("words", position + 1, F.lit(WINDOW))


def _prints() -> Column:
    """A hash of every window, in order, made of the hashes of its words."""
    count = F.greatest(F.size("hashes") - (WINDOW - 1), F.lit(0))
    later = lambda i: [F.get("hashes", i + k) for k in range(1, WINDOW)]
    return F.transform(F.slice("hashes", F.lit(1), count), lambda first, i: F.xxhash64(first, *later(i)))


def _repeated_starts() -> Column:
    """Positions of windows that equal their neighbour in order of print, ascending."""
    at = lambda k: F.get("sorted", k)
    same = lambda j, k: (at(j)["p"] == at(k)["p"]) & (_window(at(j)["i"]) == _window(at(k)["i"]))
    last = F.size("sorted") - 1
    found = F.filter(F.sequence(F.lit(0), last), lambda k: ((k > 0) & same(k, k - 1)) | ((k < last) & same(k, k + 1)))
    return F.array_sort(F.transform(found, lambda k: at(k)["i"]))


def _covered() -> Column:
    """Words inside at least one repeated window."""
    gaps = F.transform(
        "starts",
        lambda s, k: F.when(k == F.size("starts") - 1, WINDOW).otherwise(F.least(F.lit(WINDOW), F.get("starts", k + 1) - s)),
    )
    return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

"""Rule documents: the rule table as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Layout of a rule document.
INDENT = "    "
COMMENT_WIDTH = 88


def wrapped(text: Column, width: int = COMMENT_WIDTH) -> Column:
    """Words of `text` gathered into lines of at most `width` characters."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def add(state: Column, word: Column) -> Column:
        joined = F.when(state["line"] == "", word).otherwise(F.concat(state["line"], F.lit(" "), word))
        fits = (state["line"] == "") | (F.length(joined) <= width)
        return F.struct(
            F.when(fits, state["lines"]).otherwise(F.array_append(state["lines"], state["line"])).alias("lines"),
            F.when(fits, joined).otherwise(word).alias("line"),
        )

    return F.aggregate(words, start, add, lambda s: F.array_append(s["lines"], s["line"]))


def document(rules: DataFrame, heading: str) -> DataFrame:
    """The document as one string, ending in a line break.

    A rule table has a few rows per profiled column, so a document is as small as a schema.
    """
    comments = F.transform(wrapped(F.col("evidence")), lambda line: F.concat(F.lit(f"{INDENT}# "), line))
    entry = F.concat(F.array_join(comments, "\n"), F.lit(f"\n{INDENT}"), F.col("rule_text"))
    entries = F.array_sort(F.collect_list(F.struct("rule_no", entry.alias("entry"))))
    top = "\n".join(f"# {line}" if line else "#" for line in heading.split("\n"))
    body = F.array_join(F.transform("entries", lambda e: e["entry"]), ",\n\n")
    return rules.agg(entries.alias("entries")).select(
        F.when(F.size("entries") == 0, f"{top}\n\nRules = []\n")
        .otherwise(F.concat(F.lit(f"{top}\n\nRules = [\n"), body, F.lit("\n]\n")))
        .alias("document")
    )


def document_lines(rules: DataFrame, heading: str) -> DataFrame:
    """(line_no, line) of the document."""
    return document(rules, heading).select(
        F.posexplode(F.split(F.rtrim(F.col("document"), F.lit("\n")), "\n")).alias("line_no", "line")
    )

"""Reading invocation logs: any folder, any of the layouts a log copy turns up in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.functions.json import document, is_document, wrapped
from meterwise.functions.text import strip
from meterwise.settings import LOG_SUFFIXES
from meterwise.sources import files


def count_sources(spark: SparkSession, path: str, suffixes: tuple[str, ...] = LOG_SUFFIXES) -> int:
    """How many files a read of `path` looks at; empty and unreadable ones count too."""
    return files.listed(spark, path, suffixes).filter("problem IS NULL").count()


def read_records(spark: SparkSession, path: str, suffixes: tuple[str, ...] = LOG_SUFFIXES) -> DataFrame:
    """One row per record of every log file under `path`, or of the one file it names, whatever its layout.

    Columns: source, path, position, raw (variant), issue_kind, detail. A file of one record is its own source; elements
    of an array and lines add their number to it; blank lines are skipped but counted. A file that cannot be
    opened or inflated is one row with an issue. Reading lists and inspects the files at once.
    """
    pieces = files.pieces(spark, path, suffixes)
    numbered = F.concat("path", F.lit("#"), F.col("position").cast("string"))
    rows = pieces.select(
        F.when(F.col("position") == 0, F.col("path")).otherwise(numbered).alias("source"), "path", "position", "line", "problem"
    )
    return decode_lines(rows, "problem").select(
        "source", "path", "position", "raw",
        F.when(F.col("problem").isNotNull(), "unreadable_file").otherwise(F.col("issue_kind")).alias("issue_kind"),
        F.coalesce("problem", "detail").alias("detail"),
    )


def decode_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """Strict parse of `line`, one record each; a null line is left alone."""
    parsed = lines.withColumn("parsed", wrapped(F.col("line")))
    good = is_document(F.col("parsed"))
    bad = F.col("line").isNotNull() & ~good
    return parsed.select(
        "source", "path", "position", *keep,
        F.when(good, document(F.col("parsed"))).alias("raw"),
        F.when(bad, "bad_json").alias("issue_kind"),
        F.when(bad, "the line is not one JSON value").alias("detail"),
    )


def read_record_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records of logs known to hold one record per line.

    Spark's own text reader, for any path Spark can open; the source is the file name without a line number.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_path").alias("path"),
        F.lit(0).alias("position"),
        F.col("value").alias("line"),
    )
    return decode_lines(lines.filter(strip(F.col("line")) != ""))

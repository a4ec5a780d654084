"""Tables to be profiled: delimited text and Parquet, whole or their first rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Separators by suffix.
_SEPARATORS = {".csv": ",", ".txt": ",", ".tsv": "\t"}
_PARQUET = (".parquet", ".pq")


@dataclass(frozen=True)
class Loaded:
    """A table to profile, whether it is only a sample, and the full row count if known."""

    table: DataFrame
    source_format: str
    sampled: bool
    total_row_count: int | None


def source_format(path: str) -> str:
    suffix = "." + path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in _PARQUET:
        return "parquet"
    if suffix in _SEPARATORS:
        return "csv"
    raise ValueError(f"{path}: neither a delimited nor a Parquet suffix")


def _reader(spark: SparkSession, path: str, files: list[str] | None) -> DataFrameReader:
    """A reader that finds the partition columns of single files under `path` too."""
    inside = files and not files[0].rstrip("/").endswith(path.rstrip("/"))
    return spark.read.option("basePath", path) if inside else spark.read


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, blank_is_null: bool = False, *,
    files: list[str] | None = None, keep: tuple[Column, ...] = (),
) -> DataFrame:
    """Delimited text with a header. Integers are 64 bits wide, an empty text field is an empty text.

    `files` restricts the read to some of the files under `path`; the columns `keep` are appended.
    """
    separator = _SEPARATORS["." + path.rsplit(".", 1)[-1].lower()]
    reader = _reader(spark, path, files).option("header", True).option("sep", separator).option("quote", '"')
    chosen = files or path
    table = reader.schema(schema).csv(chosen) if schema else reader.option("inferSchema", True).csv(chosen)
    columns = []
    for f in table.schema.fields:
        value = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, T.IntegerType) and schema is None:
            value = value.cast("bigint")
        if isinstance(f.dataType, T.StringType) and not blank_is_null:
            value = F.coalesce(value, F.lit(""))
        columns.append(value.alias(f.name))
    return table.select(*columns, *keep)


def first_of_files(spark: SparkSession, path: str, rows: int, read: Callable[..., DataFrame], indexed: bool) -> DataFrame:
    """The first `rows` rows of a folder of files in the order of their names, and of the rows in them.

    Files are counted in name order, four times as many each turn, until they hold enough; only those are read. In a file that
    is needed in part, rows are taken by their index if the format has one, else by the order of its splits.
    `read(files, keep)` reads files and appends the columns `keep`.
    """
    file = F.col("_metadata.file_path").alias("_file")
    place = (F.col("_metadata.row_index") if indexed else F.col("_metadata.file_block_start")).alias("_place")
    # Spark's own listing without the contents; empty files have no rows
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").orderBy("path")
    take = 1
    while True:
        paths = [r["path"] for r in names.limit(take).collect()]
        table = read(paths, (file, place))
        counts = table.groupBy("_file").count().orderBy("_file").collect() if paths else []
        if sum(r["count"] for r in counts) >= rows or len(paths) < take:
            break
        take *= 4
    last, left = None, rows
    for r in counts:
        last = r["_file"]
        if r["count"] >= left:
            break
        left -= r["count"]
    if indexed:
        some = table.filter((F.col("_file") < F.lit(last)) | ((F.col("_file") == F.lit(last)) & (F.col("_place") < left)))
        return some.drop("_file", "_place")
    cut = table.filter(F.col("_file") == F.lit(last)).withColumn("_row", F.monotonically_increasing_id())
    cut = cut.orderBy("_place", "_row").limit(left).drop("_row")
    return table.filter(F.col("_file") < F.lit(last)).unionByName(cut).drop("_file", "_place")


def head(table: DataFrame, rows: int, *order: str) -> DataFrame:
    """The first rows of a table in a stated order."""
    if rows < 1:
        raise ValueError("sample: at least one row has to be asked for")
    return table.orderBy(*order).limit(rows)


def read_table(
    spark: SparkSession, path: str, sample: int | None = None, order: tuple[str, ...] = (), blank_is_null: bool = False
) -> Loaded:
    """Read a table, or its first `sample` rows by `order` (when none is given, those of the first files by name).

    Parquet files know their row count, so a sample of one carries the full count. Delimited files
    do not: a sample that came out full leaves the count unknown.
    """
    if sample is not None and sample < 1:
        raise ValueError("sample: at least one row has to be asked for")
    form = source_format(path)

    def read(files: list[str] | None = None, keep: tuple[Column, ...] = ()) -> DataFrame:
        if form == "csv":
            return read_csv(spark, path, blank_is_null=blank_is_null, files=files, keep=keep)
        return _reader(spark, path, files).parquet(*(files or [path])).select("*", *keep)

    table = read()
    if sample is None:
        return Loaded(table, form, False, None)
    if order:
        some = head(table, sample, *order)
    else:
        some = first_of_files(spark, path, sample, read, indexed=form == "parquet")
    if form == "parquet":
        total = table.count()
        return Loaded(table, form, False, total) if sample >= total else Loaded(some, form, True, total)
    if some.count() < sample:
        return Loaded(table, form, False, None)
    return Loaded(some, form, True, None)

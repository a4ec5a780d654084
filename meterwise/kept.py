"""Tables written down because several results read them: in the shared folder, and removed again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from meterwise.session import shared_folder

# Folders of this process that nobody has released, by application.
_held: dict[str, list[str]] = {}


def kept(table: DataFrame) -> DataFrame:
    """The rows of `table`, computed once and read back; an executor lost later costs its tasks only."""
    spark = table.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    _held.setdefault(spark.sparkContext.applicationId, []).append(path)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def release(spark: SparkSession, since: int = 0) -> None:
    """Remove the tables kept in this session, but for the first `since`; what reads them cannot run again."""
    paths = _held.get(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for path in paths[since:]:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    del paths[since:]


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Tables kept inside the block go at its end; results have to be written or collected before."""
    since = len(_held.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, since)

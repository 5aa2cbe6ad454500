"""Change records as a stream: the same transformation as in batch, with a checkpoint in place of `since`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType, file_format: str = "json",
                file_filter: str | None = None, max_files: int | None = None) -> DataFrame:
    """A stream of the files that arrive below `path`, all of them or those named like `file_filter`."""
    reader = spark.readStream.schema(schema).format(file_format)
    if file_filter:
        reader = reader.option("pathGlobFilter", file_filter)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def drain(stream: DataFrame, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Process everything that has arrived since the last run, write it as Parquet, and stop.

    The checkpoint remembers what was read, so a second run takes new files only, and a run that was cut off
    goes on where it stopped. The transformation is stateless and keeps no store.
    """
    query = (
        transform(stream).writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query

"""The current state of records, kept while their changes arrive.

Per record the state store holds the newest version seen and how often it was replaced, a few bytes whatever the history. A
change that is newer than what is known comes out with its revision; an older one, which arrives late, does not. Deletions are
changes like others and are remembered, so that a late update does not bring a record back. Changes are spread by record, so no
task holds more than its share of them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recurva.sources.envelope import DELETE

KEYS = ("source_type", "object_type", "record_id")


def newer_changes(changes: DataFrame, keys: Sequence[str] = KEYS, version: str = "version") -> DataFrame:
    """The changes of a stream that are newer than all before of their record, with `revision`, which counts them from 1.

    Of the changes of a record that arrive together only the newest comes out. Versions are texts or integers that ascend; of equal
    ones the first to arrive counts. All other columns pass through.
    """
    kind = changes.schema[version].dataType
    held = T.StructType([T.StructField("version", kind), T.StructField("revision", T.LongType())])
    out = T.StructType([*changes.schema.fields, T.StructField("revision", T.LongType())])

    def follow(_, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = None
        for batch in batches:
            versions = batch[version].tolist()
            first = batch.iloc[[max(range(len(versions)), key=versions.__getitem__)]]
            if best is None or first[version].iloc[0] > best[version].iloc[0]:
                best = first
        known, revision = state.get if state.exists else (None, 0)
        if best is not None and (known is None or best[version].iloc[0] > known):
            newest = best[version].iloc[0]
            state.update((newest if isinstance(kind, T.StringType) else int(newest), revision + 1))
            yield best.assign(revision=revision + 1)

    return changes.where(F.col(version).isNotNull()).groupBy(*keys).applyInPandasWithState(follow, out, held, "append", "NoTimeout")


def drain_changes(changes: DataFrame, target: str, checkpoint: str, keys: Sequence[str] = KEYS, version: str = "version"):
    """Follow all that has arrived since the last run, batch by batch, write what is newer as Parquet, and stop."""
    query = newer_changes(changes, keys, version).writeStream.format("parquet").outputMode("append").option("path", target).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def current_records(spark: SparkSession, target: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The records as of the last run: the last revision of each, without those that it deletes."""
    rows = spark.read.parquet(target)
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "revision").alias("last")).select(*keys, "last.*")
    return last.where(F.col("change_type") != DELETE)


# Executors get the code of the functions themselves, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

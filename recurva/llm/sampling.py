"""Labelled rows for fitting: a bounded, repeatable choice joined with its texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurva.session import checkpointed


def crc_part(doc_id: Column, parts: int) -> Column:
    """CRC-32 of the id as text, modulo `parts`; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """`doc_id, text, label` of labelled documents that `learn` (over the label table) allows, `most` or all if fewer.

    The choice follows a hash of the id. Rows without id or label are left out; where an id has several labels the
    largest counts. A document that repeats an id comes along as often as it does.
    """
    known = labels.where(learn).where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("__id")).agg(F.max(F.col(label)).cast("double").alias("label"))
    total = known.count()
    if total > most:
        order = F.xxhash64("__id", F.lit(1))
        known = known.orderBy(order, "__id").limit(most)
    known = F.broadcast(checkpointed(known))  # at most `most` rows
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(
        known, F.col("doc_id") == F.col("__id")).drop("__id")

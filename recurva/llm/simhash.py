"""SimHash near-dedup by multi-index hashing.

Fingerprints are made in Arrow batches, as the bit counts of a few hundred hashes per text have no cheap column form.
Documents with equal fingerprints collapse to one row by an aggregate, so copies cost nothing further on.

Two fingerprints that differ in at most three bits differ in at most one bit of their upper or of their lower half.
The index therefore holds each half as it is, and each fingerprint probes it with its half and with the halves at
distance one. Of two halves at distance one exactly one has a zero where they differ, so only zeros are flipped and a
pair is fetched from one side. Fetched pairs are kept if their complete distance allows it.

Many fingerprints may share a half. Halves with more than `crowded` fingerprints are looked up through a second index
on the quarters of the other half, by the same rule: at most three differing bits leave a quarter with at most one.
Such a bucket agrees in 48 bits and cannot hold more than 65,536 fingerprints, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurva.operators.clustering import connected_components
from recurva.session import checkpointed

#: Hashes whose bits are counted at a time.
_STEP = 65_536
_HALF = (1 << 32) - 1


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit number, as Spark's longs are signed."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only the six ASCII blanks split
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(42))), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _STEP):
        ones += np.unpackbits(hashes[start:start + _STEP], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 3, name: str = "fingerprint") -> DataFrame:
    """`df` with the fingerprint of its text as a long; NULL and blank texts have zero. It replaces a column of that name."""
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return df.withColumn(name, of(F.col(text)))


def _segments(value: Column, width: int, count: int) -> list[Column]:
    """`count` segments of `width` bits from the low end of a long."""
    return [F.shiftrightunsigned(value, width * i).bitwiseAND((1 << width) - 1) for i in range(count)]


def _ball(segment: Column, width: int, zeros_only: bool) -> Column:
    """The segment and those at distance one, the latter only with a zero turned to one if so asked."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    if zeros_only:
        bits = F.filter(bits, lambda bit: segment.bitwiseAND(bit) == 0)
    return F.concat(F.array(segment), F.transform(bits, lambda bit: segment.bitwiseXOR(bit)))


def _index(prints: DataFrame, value: Column, width: int, count: int, ball: bool, *carried: str, zeros_only: bool = True) -> DataFrame:
    """A row per segment, or per segment and neighbour of it: `fp, part, key`."""
    parts = F.array(*(F.struct(F.lit(i).alias("part"), s.alias("segment")) for i, s in enumerate(_segments(value, width, count))))
    rows = prints.select("fp", *carried, F.inline(parts))
    if not ball:
        return rows.withColumnRenamed("segment", "key")
    return rows.select("fp", *carried, "part", F.explode(_ball(F.col("segment"), width, zeros_only)).alias("key"),
                       F.col("segment").alias("own"))


def near_pairs(prints: DataFrame, max_bits: int = 3, crowded: int = 4096) -> DataFrame:
    """Pairs `a, b` of different values of the long column `fp`, which holds each once, at most `max_bits` (up to 3) apart.

    A pair near in both halves comes up twice.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves with a radius of one find at most three differing bits")
    table = _index(prints, F.col("fp"), 32, 2, ball=False)
    probes = _index(prints, F.col("fp"), 32, 2, ball=True)
    full = table.groupBy("part", "key").count().where(F.col("count") > crowded).select("part", "key", F.lit(True).alias("full"))
    table, probes = (side.join(full, ["part", "key"], "left") for side in (table, probes))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits) & (
        (F.col("own") != F.col("key")) | (F.col("a") < F.col("b")))

    held = table.where("full IS NULL").select("part", "key", F.col("fp").alias("b"))
    asked = probes.where("full IS NULL").select("part", "key", F.col("fp").alias("a"), "own")
    plain = asked.join(held, ["part", "key"]).where(near).select("a", "b")

    def other_half(side: DataFrame) -> DataFrame:
        value = F.col("fp")
        other = F.when(F.col("half") == 0, F.shiftrightunsigned(value, 32)).otherwise(value.bitwiseAND(_HALF))
        return side.where("full").withColumnsRenamed({"part": "half", "key": "half_key"}).withColumn("__other", other)

    def quarters(side: DataFrame, ball: bool, *carried: str) -> DataFrame:
        return _index(side.withColumnRenamed("own", "half_own") if ball else side, F.col("__other"), 16, 2, ball,
                      "half", "half_key", *carried, zeros_only=False)

    keys = ["half", "half_key", "part", "key"]
    held = quarters(other_half(table), False).select(*keys, F.col("fp").alias("b"))
    asked = quarters(other_half(probes), True, "half_own").select(
        *keys, F.col("fp").alias("a"), F.col("half_own").alias("own"), F.col("half_key").alias("__key"))
    crowd = asked.join(held, keys).withColumn("key", F.col("__key")).where(near).select("a", "b")
    return plain.unionByName(crowd)


def _named(df: DataFrame, doc_id: str, text: str, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """`doc_id, fp` of every row, and `fp, component_id` of every fingerprint."""
    marked = checkpointed(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")), "__text", shingle, "fp").drop("__text"))
    prints = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("smallest")))
    linked = connected_components(near_pairs(prints.select("fp"), max_bits), "a", "b")
    placed = prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "cluster_id", F.coalesce("cluster_id", "fp"))
    named = placed.groupBy("cluster_id").agg(F.min("smallest").alias("component_id"))
    return marked, placed.select("fp", "cluster_id").join(named, "cluster_id").select("fp", "component_id")


def simhash_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """A row per row of `df`: `doc_id, fingerprint` (16 hex digits) and `component_id`, the smallest id reachable by links.

    Documents link if their fingerprints differ in at most `max_bits` bits; equal fingerprints link, also those of
    texts without words, which are zero. Repeated rows come out as often as they went in. A row with a NULL id links
    like any other; a component in which all ids are NULL has a NULL component id. An empty table gives an empty table.
    """
    marked, named = _named(df, doc_id, text, shingle, max_bits)
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The row of each group with the smallest id; rows that repeat this id stay together.

    Of a group in which all ids are NULL all rows stay, as nothing tells them apart; other rows with a NULL id go.
    """
    marked, named = _named(df, doc_id, text, shingle, max_bits)
    first = marked.join(named, "fp").where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__kept")).distinct()
    kept = df.join(first, F.col(doc_id) == F.col("__kept"), "left_semi")
    nameless = named.where("component_id IS NULL").select(F.col("fp").alias("__fp"))
    unnamed = fingerprints(df.where(F.col(doc_id).isNull()), text, shingle, "__fp").join(nameless, "__fp", "left_semi").drop("__fp")
    return kept.unionByName(unnamed)

"""CSV files whose values hold line ends, read in parts.

A part of a file cannot tell whether it begins within quotes. So each part is read for both cases, which gives where it ends in
either; the parts of a file are put together in their order, and that settles how each begins. Then every part cuts its own lines
into records. A record that goes over the end of a part is put together from its pieces, of which a part has two at most.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurva.session import checkpointed

#: Parts up to which their states are sent to all tasks; files with more are read whole.
MOST_PARTS = 500_000
_BATCH_ROWS, _BATCH_CHARS = 5_000, 4_000_000
_WHOLE, _OPEN, _REST = 0, 1, 2


def _ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends within quotes, given whether it begins within them. Quotes open at the start of a cell only."""
    at, quote = 0, line.find('"')
    while quote >= 0:
        if inside:
            if line.startswith('""', quote):
                at = quote + 2
                quote = line.find('"', at)
                continue
            inside, at = False, quote + 1
        elif at == quote:
            inside, at = True, at + 1
            quote = line.find('"', at)
            continue
        comma = line.find(",", at)
        if comma < 0:
            return False
        at = comma + 1
        if quote < at:
            quote = line.find('"', at)
    return inside


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bool, str]]:
    """File and part, how the part begins, and a line, one after the other."""
    for batch in batches:
        begins = batch["inside"].to_pylist() if "inside" in batch.schema.names else [False] * batch.num_rows
        yield from zip(zip(batch["file"].to_pylist(), batch["start"].to_pylist()), begins, batch["value"].to_pylist())


def _both_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part whether it ends within quotes if it begins outside, and if it begins inside."""
    found: dict[tuple[str, int], list[bool]] = {}
    for part, _, line in _parts(batches):
        ends = found.setdefault(part, [False, True])
        if '"' in line:
            ends[:] = [_ends_inside(line, end) for end in ends]
    yield pa.RecordBatch.from_pydict({
        "file": pa.array([f for f, _ in found], pa.string()), "start": pa.array([s for _, s in found], pa.int64()),
        "after_outside": pa.array([a for a, _ in found.values()], pa.bool_()), "after_inside": pa.array([b for _, b in found.values()], pa.bool_())})


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each part, and the pieces of those that begin before it or end after it."""
    out: list[tuple] = []
    chars, current, held, rest, inside, number = 0, None, [], False, False, 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()))],
                                          ["file", "start", "number", "piece", "text"])

    def close(piece: int) -> None:
        nonlocal chars
        out.append((*current, number, piece, "\n".join(held)))
        chars += len(out[-1][-1])

    for part, begins, line in _parts(batches):
        if part != current:
            if held:
                close(_REST if rest else _OPEN)
            current, held, rest, inside, number = part, [], begins, begins, 0
        line = line.removesuffix("\r")
        if not inside and not line.strip():
            continue  # between records
        held.append(line)
        inside = _ends_inside(line, inside)
        if not inside:
            close(_REST if rest else _WHOLE)
            number += not rest
            held, rest = [], False
            if len(out) >= _BATCH_ROWS or chars >= _BATCH_CHARS:
                yield batch()
                out, chars = [], 0
    if held:
        close(_REST if rest else _OPEN)
    yield batch()


def _begins(ends: DataFrame) -> DataFrame:
    """`file, start, inside` from the ends of all parts of a file, in their order."""
    def step(seen: Column, part: Column) -> Column:
        now = seen["now"]
        return F.struct(F.when(now, part["after_inside"]).otherwise(part["after_outside"]).alias("now"),
                        F.array_append(seen["parts"], F.struct(part["start"].alias("start"), now.alias("inside"))).alias("parts"))

    begin = F.struct(F.lit(False).alias("now"), F.array().cast("array<struct<start:bigint,inside:boolean>>").alias("parts"))
    parts = F.sort_array(F.collect_list(F.struct("start", "after_outside", "after_inside")))  # a part is a block of a file
    return ends.groupBy("file").agg(F.aggregate(parts, begin, step)["parts"].alias("parts")).select("file", F.inline("parts"))


def quoted_records(spark: SparkSession, path: str) -> DataFrame | None:
    """`file, start, number, text`: the records of CSV files, each with its part and its number there; None for too many parts.

    Blank lines between records are none. Line ends within values become single line feeds.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    ends = checkpointed(lines.mapInArrow(_both_ends, "file string, start bigint, after_outside boolean, after_inside boolean"))
    if ends.count() > MOST_PARTS:
        return None
    begun = lines.join(F.broadcast(checkpointed(_begins(ends))), ["file", "start"])  # rows keep their order
    found = checkpointed(begun.mapInArrow(_records, "file string, start bigint, number bigint, piece int, text string"))
    pieces = found.where(F.col("piece") != _WHOLE)
    order = Window.partitionBy("file").orderBy("start", F.desc("piece"))  # two pieces a part at most
    numbered = pieces.withColumn("record", F.sum((F.col("piece") == _OPEN).cast("int")).over(order))
    first = F.struct("start", F.col("number").alias("number"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]), "\n")
    joined = numbered.groupBy("file", "record").agg(F.min(first).alias("first"), text.alias("text")).select(
        "file", "first.start", "first.number", "text")
    return found.where(F.col("piece") == _WHOLE).drop("piece").unionByName(joined)


def header_names(line: str) -> list[str]:
    """Column names of a header record: blank ones are numbered, and so are those that occur twice."""
    names = [name or f"_c{i}" for i, name in enumerate(next(csv.reader([line.lstrip("﻿")])))]
    lowered = [n.lower() for n in names]
    return [f"{n}{i}" if lowered.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def quoted_csv(spark: SparkSession, path: str, position: str) -> DataFrame | None:
    """All cells as text, with the place of a row over all files in `position`; None where there is no record, or too many parts.

    Each file has a header; that of the first counts.
    """
    records = quoted_records(spark, path)
    if records is None:
        return None
    counts = records.groupBy("file", "start").agg(F.count(F.lit(1)).alias("rows"))
    heads = counts.groupBy("file").agg(F.min("start").alias("start"))
    header = records.join(heads, ["file", "start"]).where("number = 0").orderBy("file").select("text").first()
    if header is None:
        return None
    names = header_names(header["text"])
    leads = heads.withColumn("lead", F.lit(1))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    offsets = counts.join(leads, ["file", "start"], "left").withColumn("lead", F.coalesce("lead", F.lit(0)))
    offsets = offsets.withColumn("offset", F.coalesce(F.sum(F.col("rows") - F.col("lead")).over(before), F.lit(0)) - F.col("lead")).drop("rows")
    schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    rows = records.join(offsets, ["file", "start"]).where((F.col("lead") == 0) | (F.col("number") > 0))
    cells = F.from_csv("text", schema, {"escape": '"', "maxCharsPerColumn": "-1"})
    return rows.select(cells.alias("cells"), (F.col("offset") + F.col("number")).alias(position)).select("cells.*", position)


# Executors get the code of the functions themselves, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

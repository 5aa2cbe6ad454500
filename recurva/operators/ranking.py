"""Places of rows within groups of any size, without a task that sees a whole group."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurva.session import checkpointed


def same(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """All pairs are equal; NULL equals NULL."""
    return functools.reduce(operator.and_, (a.eqNullSafe(b) for a, b in pairs))


def ranked(df: DataFrame, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`df`, written as a table, with `rank`, a row's place from 0 in its group by `order`, and `members`, the size of the group.

    NULL comes first, and rows equal in all of `groups` and `order` follow each other as they were read. Rows are sorted by
    ranges, which part a large group; the ranges' row counts per group, a small table, turn places within a range into
    places within a group.
    """
    keys = [*groups, *order, "__read"]
    ordered = df.withColumn("__read", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = checkpointed(ordered.drop("__read").withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    names = [f"__group_{i}" for i in range(len(groups))]
    counts = placed.groupBy(part.alias("__part"), *[F.col(g).alias(n) for g, n in zip(groups, names)]).agg(
        F.min("__at").alias("__start"), F.count(F.lit(1)).alias("__rows"))
    group = Window.partitionBy(*names)
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"__before": F.coalesce(F.sum("__rows").over(before), F.lit(0)), "members": F.sum("__rows").over(group)})
    found = placed.join(counts, same([(part, F.col("__part")), *((F.col(g), F.col(n)) for g, n in zip(groups, names))]))
    return found.withColumn("rank", F.col("__before") + F.col("__at") - F.col("__start")).drop(
        "__at", "__part", "__start", "__rows", "__before", *names)

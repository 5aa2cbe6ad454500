"""Golden records: the best value of every field over the records of an entity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recurva.operators.ranking import ranked

# Weight of a source in general, and the sources to prefer for single fields.
SOURCE_PRIORITY = {"stripe": 3, "postgres": 2, "mysql": 2, "hubspot": 1, "salesforce": 1, "csv": 1}
FIELD_SOURCES = {
    "email": ("stripe", "hubspot", "postgres"),
    "company_name": ("hubspot", "salesforce", "postgres", "stripe"),
    "mrr": ("stripe",),
    "plan": ("stripe",),
    "seats": ("postgres",),
    "created_at": ("stripe", "postgres"),
}


def _ladder(values: Mapping[str, int], otherwise: int) -> Column:
    column = F.lit(otherwise)
    for source, place in values.items():
        column = F.when(F.col("source_type") == source, place).otherwise(column)
    return column


def preference(field: str, priority: Mapping[str, int] = SOURCE_PRIORITY,
               field_sources: Mapping[str, Sequence[str]] = FIELD_SOURCES) -> Column:
    """Sort key of a value: listed sources of the field first, then source weight, then source and id."""
    listed = field_sources.get(field, ())
    return F.struct(
        _ladder({s: i for i, s in enumerate(listed)}, len(listed)).alias("place"),
        _ladder({s: -w for s, w in priority.items()}, 0).alias("weight"),
        "source_type",
        "record_id",
    )


def pick(field: str, value: Column, **sources) -> Column:
    """Aggregate: the preferred value that is not NULL."""
    return F.min_by(value, F.when(value.isNotNull(), preference(field, **sources)))


def data_fields(records: DataFrame) -> list[str]:
    """Fields of the nested record; names with a leading underscore are left out."""
    return [f for f in records.schema["data"].dataType.fieldNames() if not f.startswith("_")]


def holds_map(records: DataFrame) -> bool:
    return isinstance(records.schema["data"].dataType, T.MapType)


def golden_records(members: DataFrame, records: DataFrame, confidence: DataFrame, **sources) -> DataFrame:
    """One row per cluster: the picked fields, `_source_count` and `_confidence`.

    `members` lists the records of each cluster and is the lineage; members without a record add nothing. Records
    that hold a map have their picked fields as one map, `data`.
    """
    entity = F.col("cluster_id").alias("entity_id")
    if holds_map(records):
        # a map has as many entries as an entity has fields
        fields = golden_maps(members, records, **sources).groupBy("entity_id").agg(
            F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("data"))
        sizes = members.groupBy(entity).agg(F.count(F.lit(1)).cast("int").alias("_source_count"))
        empty = F.create_map().cast("map<string,string>")
        picked = sizes.join(fields, "entity_id", "left").select("entity_id", F.coalesce("data", empty).alias("data"), "_source_count")
    else:
        fields = data_fields(records)
        rows = members.join(records.select("source_type", "record_id", "data"), ["source_type", "record_id"], "left")
        picked = rows.groupBy(entity).agg(
            *[pick(f, F.col(f"data.`{f}`"), **sources).alias(f) for f in fields],
            F.count(F.lit(1)).cast("int").alias("_source_count"),
        )
    known = confidence.select(F.col("cluster_id").alias("entity_id"), F.col("avg_confidence").alias("_confidence"))
    return picked.join(known, "entity_id", "left")


def golden_maps(members: DataFrame, records: DataFrame, priority: Mapping[str, int] = SOURCE_PRIORITY,
                field_sources: Mapping[str, Sequence[str]] = FIELD_SOURCES) -> DataFrame:
    """Golden fields of records that hold a map: one row per cluster and field, for open schemas."""
    rows = members.join(records.select("source_type", "record_id", F.explode("data").alias("field", "value")),
                        ["source_type", "record_id"])
    place = F.lit(0)
    for field, listed in field_sources.items():
        place = F.when(F.col("field") == field, preference(field, priority, field_sources)["place"]).otherwise(place)
    order = F.struct(place.alias("place"), preference("", priority)["weight"].alias("weight"), "source_type", "record_id")
    rows = rows.where(F.col("value").isNotNull() & ~F.startswith("field", F.lit("_")))
    return rows.groupBy(F.col("cluster_id").alias("entity_id"), "field").agg(F.min_by("value", order).alias("value"))


def unmatched_records(records: DataFrame, members: DataFrame) -> DataFrame:
    """Records in no cluster, each as an entity of its own with one source and full confidence."""
    alone = records.join(members.select("source_type", "record_id"), ["source_type", "record_id"], "left_anti")
    return alone.select(
        F.concat_ws(":", "source_type", "record_id").alias("entity_id"),
        *(["data"] if holds_map(records) else [F.col(f"data.`{f}`").alias(f) for f in data_fields(records)]),
        F.lit(1).alias("_source_count"),
        F.lit(1.0).alias("_confidence"),
    )


def lineage(members: DataFrame, records: DataFrame) -> DataFrame:
    """`entity_id, source_type, record_id` for every record, matched or not."""
    alone = records.join(members, ["source_type", "record_id"], "left_anti")
    own = F.concat_ws(":", "source_type", "record_id")
    return members.select(F.col("cluster_id").alias("entity_id"), "source_type", "record_id").unionByName(
        alone.select(own.alias("entity_id"), "source_type", "record_id"))


def bounded_lineage(rows: DataFrame, size: int = 1000) -> DataFrame:
    """Lineage as arrays of at most `size` records, a row per entity and part, in the order of source and id.

    All parts of an entity but its last are full. Places are found by ranges, so no step gathers an entity in one task.
    """
    placed = ranked(rows.select("entity_id", "source_type", "record_id"), ["entity_id"], ["source_type", "record_id"])
    return placed.groupBy("entity_id", F.floor(F.col("rank") / size).cast("int").alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("source_type", "record_id"))).alias("_sources"))

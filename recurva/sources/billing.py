"""Exported billing objects and the billing event log, both as JSON files."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recurva.sources.envelope import CREATE, DELETE, UPDATE, envelope

# Object types, and the declared columns with their meaning.
OBJECT_TYPES = ("customer", "subscription", "invoice", "charge", "product", "price")
DECLARED = {
    "customer": (
        ("id", "string", "external_id"), ("email", "string", "email_address"), ("name", "string", "person_name"),
        ("created", "timestamp", "created_timestamp"), ("currency", "string", "currency_code"),
    ),
    "subscription": (
        ("id", "string", "external_id"), ("customer", "string", "external_id"), ("status", "string", "status_flag"),
        ("current_period_start", "timestamp", None), ("current_period_end", "timestamp", None),
        ("created", "timestamp", "created_timestamp"), ("plan_amount", "integer", "revenue_amount"),
    ),
    "invoice": (
        ("id", "string", "external_id"), ("customer", "string", "external_id"),
        ("amount_paid", "integer", "revenue_amount"), ("status", "string", "status_flag"),
        ("created", "timestamp", "created_timestamp"),
    ),
}
_TYPES = {"string": T.StringType(), "timestamp": T.TimestampType(), "integer": T.LongType()}


def object_schema(object_type: str) -> T.StructType:
    """Read schema of an object type; types without a declaration have their id only."""
    declared = DECLARED.get(object_type, (("id", "string", "external_id"),))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind, _ in declared])


def describe_objects(spark: SparkSession, object_types: Iterable[str] = tuple(DECLARED)) -> DataFrame:
    """Declared columns of object types, in the shape of a CSV profile; types without a declaration have none."""
    rows = [(table, name, kind, True, name == "id", meaning) for table in object_types
            for name, kind, meaning in DECLARED.get(table, ())]
    return spark.createDataFrame(
        rows, "table_name string, column_name string, data_type string, nullable boolean, "
              "is_primary_key boolean, semantic_type string")


def object_records(objects: DataFrame, source_id: str, object_type: str) -> DataFrame:
    return envelope(objects, "stripe", source_id, object_type, F.coalesce("id", F.lit("")))


def read_objects(spark: SparkSession, folder: str, source_id: str,
                 object_types: Iterable[str] = OBJECT_TYPES) -> dict[str, DataFrame]:
    """Records per object type from `folder/<object type>/`; unknown types are left out."""
    return {
        kind: object_records(spark.read.schema(object_schema(kind)).json(f"{folder}/{kind}"), source_id, kind)
        for kind in object_types if kind in OBJECT_TYPES
    }


def change_kind(event_type: Column) -> Column:
    return (
        F.when(F.contains(event_type, F.lit("created")), CREATE)
        .when(F.contains(event_type, F.lit("deleted")), DELETE)
        .otherwise(UPDATE)
    )


def event_records(events: DataFrame, source_id: str, since: datetime | str | None = None) -> DataFrame:
    """Change records of an event log `type, created, data.object.*`, from `since` on.

    Works on a batch and on a stream alike.
    """
    if since is not None:
        events = events.where(F.col("created") >= F.lit(since).cast(events.schema["created"].dataType))
    fields = events.schema["data"].dataType["object"].dataType.fieldNames()
    kind = F.coalesce(F.col("data.object.object"), F.lit("unknown")) if "object" in fields else F.lit("unknown")
    identity = F.coalesce(F.col("data.object.id").cast("string"), F.lit(""))
    flat = events.select(change_kind(F.col("type")).alias("_change"), kind.alias("_kind"), identity.alias("_id"),
                         "data.object.*")
    return envelope(flat, "stripe", source_id, F.col("_kind"), F.col("_id"), fields, F.col("_change"))

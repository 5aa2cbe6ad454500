"""The record envelope shared by all sources, and its JSON forms."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recurva.functions.coerce import blank_to_null

CREATE, UPDATE, DELETE = "create", "update", "delete"
ENVELOPE = ("source_type", "source_id", "object_type", "record_id", "data", "extracted_at", "change_type", "record_hash")


def canonical(value: Column, kind: T.DataType) -> Column:
    """A value whose fields and map entries are sorted by name at every depth; arrays keep their order."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[canonical(value[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], kind.valueType).alias("value")))
        by_key = F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        return F.map_from_entries(by_key)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.MapType, T.ArrayType)):
        return F.transform(value, lambda x: canonical(x, kind.elementType))
    return value


def content_hash(data: Column, fields: list[str], kinds: Mapping[str, T.DataType] | None = None) -> Column:
    """Digest of the named fields, whatever their order; NULL and missing differ from empty text.

    `kinds` gives the types of fields that hold nested data, whose own fields and entries then have no order either.
    """
    kinds = kinds or {}
    sorted_fields = F.struct(*[canonical(data[f], kinds.get(f, T.NullType())).alias(f) for f in sorted(fields)])
    return F.md5(F.to_json(sorted_fields, {"ignoreNullFields": "false"}))


def field_kinds(schema: T.StructType) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in schema.fields}


def envelope(
    rows: DataFrame,
    source_type: str,
    source_id: str,
    object_type: str | Column,
    record_id: Column,
    fields: list[str] | None = None,
    change_type: str | Column = CREATE,
) -> DataFrame:
    """Wrap rows as normalised records; `fields` names the columns that make up the data.

    A record without an id, or with a blank one, is named after its content: `#` and its hash.
    """
    names = fields or rows.columns
    data = F.struct(*[F.col(f"`{n}`") for n in names])
    digest = content_hash(data, names, field_kinds(rows.schema))
    return rows.select(
        F.lit(source_type).alias("source_type"),
        F.lit(source_id).alias("source_id"),
        (F.lit(object_type) if isinstance(object_type, str) else object_type).alias("object_type"),
        F.coalesce(blank_to_null(record_id.cast("string")), F.concat(F.lit("#"), digest)).alias("record_id"),
        data.alias("data"),
        F.current_timestamp().alias("extracted_at"),
        (F.lit(change_type) if isinstance(change_type, str) else change_type).alias("change_type"),
        digest.alias("record_hash"),
    )


def wrap(frame: DataFrame, source_type: str, source_id: str, object_type: str) -> DataFrame:
    """Envelope for a custom source: any DataFrame; its `id` column, if any, names the records."""
    record_id = F.col("id") if "id" in frame.columns else content_hash(F.struct(*[F.col(f"`{c}`") for c in frame.columns]), frame.columns, field_kinds(frame.schema))
    return envelope(frame, source_type, source_id, object_type, record_id)


def as_map(records: DataFrame) -> DataFrame:
    """Records with their data as a map of text, so that sources with different fields can be united."""
    fields = records.schema["data"].dataType.fieldNames()
    entries = [x for f in fields for x in (F.lit(f), _as_text(F.col(f"data.`{f}`"), records.schema["data"].dataType[f].dataType))]
    return records.withColumn("data", F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull()))


def _common(kinds: list[T.DataType]) -> T.DataType:
    """The type that holds all values of a field: the one they have, double for numbers, else text."""
    known = [k for k in kinds if not isinstance(k, T.NullType)]
    if len({k.simpleString() for k in known}) <= 1:
        return known[0] if known else T.StringType()
    return T.DoubleType() if all(isinstance(k, T.NumericType) for k in known) else T.StringType()


def _as_text(value: Column, kind: T.DataType) -> Column:
    """Nested values as JSON, all others by a cast."""
    return F.to_json(value) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else value.cast("string")


def with_fields(records: DataFrame, fields: dict[str, T.DataType]) -> DataFrame:
    """Records whose data has exactly these fields; those it lacks are NULL."""
    own = {f.name: f.dataType for f in records.schema["data"].dataType.fields}
    values = []
    for name, kind in fields.items():
        value = F.col(f"data.`{name}`") if name in own else F.lit(None)
        if name in own and own[name] != kind:
            value = _as_text(value, own[name]) if isinstance(kind, T.StringType) else value.cast(kind)
        values.append((value if name in own else value.cast(kind)).alias(name))
    return records.withColumn("data", F.struct(*values))


def unite(*sources: DataFrame) -> DataFrame:
    """Union of record sets, whatever their fields.

    The data has every field of any source, with a type that holds all its values; records lack the fields of other
    sources. If the data of some source is a map, fields are not known beforehand, and all become maps of text.
    """
    kinds = [s.schema["data"].dataType for s in sources]
    if any(isinstance(k, T.MapType) for k in kinds):
        frames = [s if isinstance(k, T.MapType) else as_map(s) for s, k in zip(sources, kinds)]
    else:
        found: dict[str, list[T.DataType]] = {}
        for kind in kinds:
            for field in kind.fields:
                found.setdefault(field.name, []).append(field.dataType)
        fields = {name: _common(types) for name, types in found.items()}
        frames = [with_fields(s, fields) for s in sources]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def to_json(records: DataFrame) -> DataFrame:
    """One JSON document per row."""
    return records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("document"))


def preview(records: DataFrame, rows: int, order: tuple[str, ...] = ()) -> DataFrame:
    """The first `rows` rows, for display. Counts and metrics always use all records."""
    return (records.orderBy(*order) if order else records).limit(rows)


def write_json(frame: DataFrame, path: str, mode: str = "error") -> None:
    frame.write.mode(mode).json(path)


def unwrap_payload(payloads: DataFrame, column: str, row_type: T.StructType, wrapper: str = "records") -> DataFrame:
    """Rows of JSON payloads that hold either a bare list or an object with the list under `wrapper`.

    A row may keep its fields under `data`; they take the place of the outer ones where those are missing.
    """
    nested = T.StructType([*row_type.fields, T.StructField("data", row_type)])
    rows = T.ArrayType(nested)
    text = F.col(column)
    bare = F.from_json(F.when(F.startswith(F.ltrim(text), F.lit("[")), text), rows)
    wrapped = F.from_json(F.when(F.startswith(F.ltrim(text), F.lit("{")), text), T.StructType([T.StructField(wrapper, rows)]))
    item = payloads.select(F.explode(F.coalesce(bare, wrapped[wrapper])).alias("item"))
    return item.select(*[F.coalesce(F.col("item.data")[f], F.col("item")[f]).alias(f) for f in row_type.fieldNames()])

"""Database tables over JDBC, and incremental extracts of any table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurva.sources.envelope import CREATE, UPDATE, envelope

# Columns that tell when a row changed, in order of preference.
CHANGE_COLUMNS = ("updated_at", "modified_at", "updated_date", "last_modified")


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def columns_query(schema: str = "public") -> str:
    """Query for tables, columns, types and nullability of a schema; base tables only."""
    return (
        "SELECT c.table_name, c.column_name, c.data_type, c.is_nullable, c.ordinal_position "
        "FROM information_schema.columns c JOIN information_schema.tables t "
        "ON t.table_schema = c.table_schema AND t.table_name = c.table_name "
        f"WHERE t.table_type = 'BASE TABLE' AND c.table_schema = {_text(schema)}"
    )


def describe_tables(columns: DataFrame) -> DataFrame:
    """Profile rows from the rows of `columns_query`, in the shape of a CSV profile."""
    return columns.select(
        "table_name", "column_name", "data_type", (F.upper("is_nullable") == "YES").alias("nullable"),
        F.lit(False).alias("is_primary_key"), F.lit(None).cast("string").alias("semantic_type"),
        F.col("ordinal_position").cast("int").alias("ordinal_position"),
    )


def discover(spark: SparkSession, options: Mapping[str, str], schema: str = "public") -> DataFrame:
    """Tables and columns of a database. `options` are those of the JDBC reader: url, user, password …"""
    return describe_tables(spark.read.format("jdbc").options(**options).option("query", columns_query(schema)).load())


def known_tables(profile: DataFrame, wanted: Iterable[str] | None = None) -> list[str]:
    """Tables to read: all, or those of `wanted` that exist. A profile has one row per column."""
    tables = [r["table_name"] for r in profile.select("table_name").distinct().collect()]
    return sorted(tables) if wanted is None else [t for t in wanted if t in tables]


def partition_options(low: object, high: object, column: str, partitions: int) -> dict[str, str]:
    """Options that make the reader fetch ranges of a column in parallel; none for an empty table."""
    if low is None or high is None:
        return {}
    return {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions)}


def read_table(spark: SparkSession, options: Mapping[str, str], table: str, schema: str = "public",
               partition_column: str | None = None, partitions: int = 64) -> DataFrame:
    """A table; with a partition column it is read in ranges between its smallest and largest value."""
    name = f"{_quoted(schema)}.{_quoted(table)}"
    reader = spark.read.format("jdbc").options(**options)
    if partition_column:
        column = _quoted(partition_column)
        bounds = spark.read.format("jdbc").options(**options).option(
            "query", f"SELECT min({column}) AS low, max({column}) AS high FROM {name}").load().first()
        reader = reader.options(**partition_options(bounds["low"], bounds["high"], partition_column, partitions))
    return reader.option("dbtable", name).load()


def table_records(rows: DataFrame, source_id: str, table: str, source_type: str = "postgres",
                  change_type: str = CREATE) -> DataFrame:
    """Normalised records of a table; the column `id` names them, or their content where it is missing or blank."""
    identity = F.col("id") if "id" in rows.columns else F.lit(None)
    return envelope(rows, source_type, source_id, table, identity, change_type=change_type)


def change_column(columns: Iterable[str]) -> str | None:
    """The column that tells when a row changed, None if there is none."""
    present = set(columns)
    return next((c for c in CHANGE_COLUMNS if c in present), None)


def changed_since(rows: DataFrame, since: datetime | str, ordered: bool = False) -> DataFrame | None:
    """Rows changed after `since`; None for a table that does not tell. The filter reaches the source.

    Ordering by time costs a range shuffle and is off unless asked for.
    """
    column = change_column(rows.columns)
    if column is None:
        return None
    newer = rows.where(F.col(column) > F.lit(since).cast(rows.schema[column].dataType))
    return newer.orderBy(column) if ordered else newer


def changed_records(rows: DataFrame, since: datetime | str, source_id: str, table: str,
                    source_type: str = "postgres") -> DataFrame | None:
    """Changed rows as update records."""
    newer = changed_since(rows, since)
    return None if newer is None else table_records(newer, source_id, table, source_type, UPDATE)

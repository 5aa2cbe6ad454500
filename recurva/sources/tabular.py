"""CSV files: reading, column types, aliases, record ids and normalised records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recurva.functions.coerce import blank_to_null, currency_to_double
from recurva.sources.envelope import envelope
from recurva.sources.quoted import quoted_csv

# Header names by meaning, in order of preference.
FIELD_ALIASES = {
    "mrr": ("mrr", "monthly_recurring_revenue", "mrr_amount", "revenue"),
    "email": ("email", "email_address", "customer_email", "contact_email"),
    "name": ("name", "company_name", "company", "customer_name", "account_name"),
    "plan": ("plan", "plan_name", "subscription_plan", "tier", "pricing_plan"),
    "status": ("status", "subscription_status", "state", "account_status"),
    "created_at": ("created_at", "created", "signup_date", "created_date", "start_date"),
    "customer_id": ("customer_id", "id", "account_id", "stripe_customer_id", "external_id"),
}
# Names the metric templates read, where they differ from the meaning.
METRIC_COLUMNS = {"mrr": "mrr_amount", "customer_id": "customer_entity_id"}
#: Sample values per column in a profile.
SAMPLES = 5
POSITION = "_row_position"
ID = "_row_id"


def _cleaned(header: str) -> str:
    return header.lower().strip()


def resolve_field(headers: Sequence[str], aliases: Sequence[str]) -> str | None:
    """First alias that names a header, ignoring case and blanks; returns the header as written."""
    by_name = {_cleaned(h): h for h in headers}
    return next((by_name[a] for a in aliases if a in by_name), None)


def semantic_type(header: str) -> str | None:
    """Meaning of a header, NULL if no alias list holds it."""
    return next((name for name, aliases in FIELD_ALIASES.items() if _cleaned(header) in aliases), None)


def alias_values(rows: DataFrame, meaning: str, nested: str | None = None) -> list[Column]:
    """The columns that hold a meaning, in order of preference: the name the metrics read, then the aliases.

    With `nested`, the name of a map of text, they are its entries.
    """
    names = dict.fromkeys((METRIC_COLUMNS.get(meaning, meaning), *FIELD_ALIASES[meaning]))
    if nested:
        keys = F.transform_keys(nested, lambda k, _: F.concat(F.lower(F.trim(k)), F.lit("")))
        return [blank_to_null(F.try_element_at(keys, F.lit(n))) for n in names]
    by_name = {_cleaned(c): c for c in reversed(rows.columns)}
    return [F.col(f"`{by_name[n]}`") for n in names if n in by_name]


def metric_names(rows: DataFrame) -> DataFrame:
    """Add columns by the names the metric templates read: the first value of a row over all aliases of a meaning.

    United sources keep a meaning under different names, so each row is asked by itself; NULL and blank values do not count.
    Columns of one type keep it, others become text. All other columns stay.
    """
    added = {}
    for meaning in FIELD_ALIASES:
        found = alias_values(rows, meaning)
        kinds = {rows.select(c).schema[0].dataType.simpleString() for c in found}
        if len(kinds) > 1:
            found = [c.cast("string") for c in found]
        if kinds != {"string"} and len(kinds) == 1:
            value = F.coalesce(*found)
        elif found:
            value = F.coalesce(*map(blank_to_null, found))
        else:
            continue
        added[METRIC_COLUMNS.get(meaning, meaning)] = value
    return rows.withColumns(added)


def has_quoted_newlines(spark: SparkSession, path: str) -> bool:
    """Whether some line of the files holds an odd number of quotes, that is, a value goes over its end."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """All cells as text, with the row position in `_row_position`.

    Files are split among tasks. Where a value may hold a line end, records are cut by `sources.quoted`; by default the files
    are checked for that, in one distributed pass; say True or False where it is known.
    """
    if multi_line is None:
        multi_line = has_quoted_newlines(spark, path)
    if multi_line:
        found = quoted_csv(spark, path, POSITION)
        if found is not None:
            return found
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"', encoding="UTF-8")
    names = {c: c.lstrip("﻿") for c in rows.columns if c.startswith("﻿")}
    return with_position(rows).withColumnsRenamed(names)


def with_position(rows: DataFrame) -> DataFrame:
    """Number rows in file order, from zero, without a global sort.

    A row counts from the start of its file split; the splits, a small table, carry the running total.
    """
    placed = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"),
                         F.monotonically_increasing_id().alias("_number"))
    splits = placed.groupBy("_path", "_start").agg(F.min("_number").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    position = (F.col("_offset") + F.col("_number") - F.col("_first")).alias(POSITION)
    return placed.join(offsets, ["_path", "_start"]).select(*rows.columns, position)


def data_columns(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in (POSITION, ID)]


def _is_number(cell: Column) -> Column:
    return currency_to_double(cell).isNotNull()


def _looks_like_date(cell: Column) -> Column:
    return cell.rlike("[-/T]") & (F.length(cell) >= 8)


def column_type(filled: Column, numbers: Column, dates: Column) -> Column:
    """`numeric` above 80 % numbers, else `timestamp` above 50 % date-like cells, else `string`."""
    return (
        F.when(F.try_divide(numbers, filled) > 0.8, "numeric")
        .when(F.try_divide(dates, filled) > 0.5, "timestamp")
        .otherwise("string")
    )


def profile_columns(rows: DataFrame, table_name: str = "data", samples: int = SAMPLES) -> DataFrame:
    """One row per column: type, meaning, counts and the values of the first `samples` rows.

    Types come from all rows, in one aggregate over all columns at once.
    """
    names = data_columns(rows)
    stats = []
    for i, name in enumerate(names):
        cell = F.col(f"`{name}`")
        filled = cell.isNotNull() & (cell != "")
        stats += [F.count_if(filled).alias(f"filled_{i}"), F.count_if(filled & _is_number(cell)).alias(f"numbers_{i}"),
                  F.count_if(filled & _looks_like_date(cell)).alias(f"dates_{i}")]
    totals = rows.agg(*stats, F.count(F.lit(1)).alias("row_count"))
    described = F.array(*[
        F.struct(
            F.lit(table_name).alias("table_name"), F.lit(name).alias("column_name"),
            column_type(F.col(f"filled_{i}"), F.col(f"numbers_{i}"), F.col(f"dates_{i}")).alias("data_type"),
            F.lit(True).alias("nullable"), F.lit(False).alias("is_primary_key"),
            F.lit(semantic_type(name)).cast("string").alias("semantic_type"),
            F.col(f"filled_{i}").alias("filled"), F.col(f"numbers_{i}").alias("numbers"),
        ) for i, name in enumerate(names)
    ])
    profile = totals.select(F.inline(described), "row_count")
    if samples:
        first = rows.orderBy(POSITION).limit(samples) if POSITION in rows.columns else rows.limit(samples)
        values = first.agg(*[F.collect_list(F.coalesce(F.col(f"`{n}`"), F.lit(""))).alias(n) for n in names])
        values = values.select(F.inline(F.array(*[
            F.struct(F.lit(n).alias("column_name"), F.col(f"`{n}`").alias("sample_values")) for n in names])))
        profile = profile.join(F.broadcast(values), "column_name")
    return profile


def numeric_columns(profile: DataFrame) -> dict[str, bool]:
    """The columns judged numeric, and whether some of their cells are no numbers. A profile has one row per column."""
    found = profile.where(F.col("data_type") == "numeric").select("column_name", (F.col("numbers") < F.col("filled")).alias("mixed"))
    return {r["column_name"]: r["mixed"] for r in found.collect()}


def raw_name(column: str) -> str:
    """Where the text of cells goes that are no numbers in a numeric column."""
    return f"_raw_{column}"


def normalise_cells(rows: DataFrame, numeric: Mapping[str, bool] | Sequence[str] = ()) -> DataFrame:
    """Empty cells become NULL and numeric columns numbers; all other cells stay text.

    A numeric column with cells that are no numbers gets a column next to it, `_raw_<name>`, which holds their text
    and is NULL elsewhere, so no cell is lost. A plain list of names takes every column for one that may need it.
    """
    mixed = numeric if isinstance(numeric, Mapping) else dict.fromkeys(numeric, True)
    cells = {}
    for name in data_columns(rows):
        cell = blank_to_null(F.col(f"`{name}`"))
        if name in mixed:
            number = currency_to_double(cell)
            cells[name] = number
            if mixed[name]:
                cells[raw_name(name)] = F.when(number.isNull(), cell)
        else:
            cells[name] = cell
    return rows.withColumns(cells)


def flags_to_boolean(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns that hold true/false as booleans, so that the text `False` is not taken for true."""
    return rows.withColumns({
        c: F.lower(F.trim(c)).try_cast("boolean") for c in columns
        if c in rows.columns and isinstance(rows.schema[c].dataType, T.StringType)
    })


def record_id(rows: DataFrame) -> Column:
    """The raw id cell; the row position where it is blank or no column holds ids."""
    column = resolve_field(data_columns(rows), FIELD_ALIASES["customer_id"])
    position = F.col(POSITION).cast("string") if POSITION in rows.columns else F.lit(None).cast("string")
    if column is None:
        return position
    return F.coalesce(blank_to_null(F.col(f"`{column}`").cast("string")), position)


def csv_records(spark: SparkSession, path: str, source_id: str, multi_line: bool | None = None) -> DataFrame:
    """Normalised records of CSV files: typed cells, ids, content hashes. Column types follow from all rows."""
    rows = read_csv(spark, path, multi_line)
    table = PurePosixPath(path).stem
    numeric = numeric_columns(profile_columns(rows, table, samples=0))
    typed = normalise_cells(rows.withColumn(ID, record_id(rows)), numeric)  # ids are raw text
    raw = [raw_name(name) for name, mixed in numeric.items() if mixed]
    return envelope(typed, "csv", source_id, table, F.col(ID), [*data_columns(rows), *raw])

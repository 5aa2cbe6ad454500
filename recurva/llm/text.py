"""Text rules the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII blanks that separate words, as a regular-expression class and as characters.
BLANK_CLASS = r"\x20\x09-\x0D"
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """`text` with A-Z in lower case and all else as it is; plain `lower` where the text is ASCII, as that is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Words between ASCII blanks, 0 for NULL, as a long."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK_CLASS}]+")), F.lit(0)).cast("long")


def content_key(df: DataFrame, *columns: str) -> list[Column]:
    """128 bits over the named columns that tell rows apart by content; rows that agree in all of them share it."""
    values = [F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")) for c in columns]
    return [F.xxhash64(F.lit(1), *values), F.xxhash64(F.lit(2), *values)]

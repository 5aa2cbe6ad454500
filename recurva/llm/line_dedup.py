"""Line dedup: lines that many documents share stay in one of them.

Native throughout. Every row is a document. Lines are exploded as 128-bit hashes of their normal form, once per
document for counting and once per position for dropping, so that no line text crosses a shuffle. Counting combines
before its shuffle, however common a line is. The shared lines are written as a table: joined as such, both sides
come straight from a shuffle, so that adaptive execution can send the table to all tasks where its measured size
allows it, and can split the partition of a common line where not. The text is shuffled at most once, next to its dropped positions, and is rebuilt from the slices between
them, which takes time linear in its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurva.llm.text import BLANKS, ascii_lower, content_key
from recurva.session import checkpointed

_KEY = ["__line_1", "__line_2"]
_ROW = ["__row_1", "__row_2"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(text: Column, min_chars: int) -> Column:
    """`pos, h1, h2` of the lines whose key is long enough."""
    keys = F.transform(F.split(F.coalesce(ascii_lower(text), F.lit("")), "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)))
    hashed = F.transform(keys, lambda key, pos: F.struct(
        pos.alias("pos"), F.when(F.char_length(key) >= min_chars, F.xxhash64(F.lit(1), key)).alias("h1"),
        F.xxhash64(F.lit(2), key).alias("h2")))
    return F.filter(hashed, lambda line: line["h1"].isNotNull())


def shared_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Hash, number of different document ids and largest of them, of each line found under at least `min_docs` ids; NULL is none."""
    in_doc = F.array_distinct(F.transform(_hashes(F.col(text), min_chars), lambda line: F.struct(
        line["h1"].alias(_KEY[0]), line["h2"].alias(_KEY[1]))))
    lines = df.select(F.col(doc_id).alias("__doc"), F.inline(in_doc))
    lines = lines.distinct()  # repeated rows of a document count once
    return lines.groupBy(*_KEY).agg(F.count("__doc").alias("n_docs"), F.max("__doc").alias("keeper")).where(F.col("n_docs") >= min_docs)


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """`df` with its text rebuilt from the lines that stay, and with `n_lines` and `n_dropped`.

    A line's key is the line without ASCII blanks at both ends and with A-Z in lower case. Keys of at least
    `min_chars` code points found in at least `min_docs` documents lose all their lines except in the largest
    document id that holds them; other lines stay as they are. A NULL or empty text is one empty line and becomes an
    empty text. Rows with equal ids count as one document, rows with a NULL id as none, and all rows with the largest id
    keep the line. NULL ids are smaller than any other, so that a line which only they hold stays. No row is dropped; an empty
    table gives an empty table. Other columns pass through; columns named `n_lines` or `n_dropped` are replaced.
    """
    shared = checkpointed(shared_lines(df, doc_id, text, min_chars, min_docs))
    keys = [k.alias(name) for k, name in zip(content_key(df, doc_id, text), _ROW)]
    places = df.select(F.col(doc_id).alias("__doc"), *keys, F.inline(_hashes(F.col(text), min_chars)).alias("pos", *_KEY))
    dropped = places.join(shared, _KEY).where(~F.col("__doc").eqNullSafe(F.col("keeper")))
    by_row = dropped.groupBy(*_ROW).agg(F.sort_array(F.collect_set("pos")).alias("__gone"))

    lines, gone = F.col("__lines"), F.col("__gone")
    ends = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    between = F.transform(F.sequence(F.lit(1), F.size(gone) + 1), lambda i: F.slice(
        lines, F.get(F.col("__ends"), i - 1) + 2, F.get(F.col("__ends"), i) - F.get(F.col("__ends"), i - 1) - 1))
    kept = F.when(gone.isNull(), lines).otherwise(F.flatten(between))
    out = df.withColumns(dict(zip(_ROW, content_key(df, doc_id, text)))).join(by_row, _ROW, "left")
    out = out.withColumn("__lines", _lines(F.col(text))).withColumn("__ends", ends)
    return out.withColumns({
        text: F.array_join(kept, "\n"), "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
    }).drop(*_ROW, "__gone", "__lines", "__ends")

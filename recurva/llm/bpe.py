"""Byte-level BPE: texts to token ids and token ids back to bytes, through the tiktoken library.

The rank file lies on every executor (it belongs to an installed library); only its path travels with the task. A
worker process loads it once. tiktoken's own splitter recurses and fails on very long runs of one character class,
and one call holds the whole text, so long texts are cut first: between a letter or digit and a following blank no
match of the pattern can continue, whatever stands on either side. A stretch without such a place is split by the
`regex` module, which does not recurse, and its matches are merged one by one.
"""

from __future__ import annotations

import base64
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Characters given to the tokenizer in one call; it only bounds a call and does not change the ids.
PIECE_CHARS = 16_384
#: Characters of text, or ids, in one batch handed back to Spark.
BATCH_UNITS = 1_000_000

_SAFE = re.compile("(?<=[0-9A-Za-z])(?=[ \n])")


def _kept(key: tuple, make):
    """What `make` returns, once per process. A task brings its own copy of this code, so it is kept outside of it."""
    held = sys.modules.setdefault("_kept_encodings", types.ModuleType("_kept_encodings")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def load_encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    def make():
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return _kept((ranks_path, pattern), make)


def _splitter(pattern: str):
    """The pattern for the `regex` module, with blanks spelled as the Unicode property that both libraries mean."""
    return _kept((pattern,), lambda: regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")))


def cut(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """`text` in pieces that no match crosses, as long as `limit` or as far as the next safe place after it."""
    start = 0
    while len(text) - start > limit:
        found = _SAFE.search(text, start + limit)
        if found is None:
            break
        yield text[start:found.start()]
        start = found.start()
    yield text[start:] if start else text


def encode_text(text: str | None, ranks_path: str, pattern: str, limit: int = PIECE_CHARS) -> list[int]:
    encoding, ids = load_encoding(ranks_path, pattern), []
    for piece in cut(text or "", limit):
        if len(piece) <= 2 * limit:
            ids += encoding.encode_ordinary(piece)
        else:
            for match in _splitter(pattern).finditer(piece):
                ids += encoding._encode_single_piece(match.group().encode())
    return ids


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of about BATCH_UNITS together, one row at least."""
    start = total = 0
    for at, size in enumerate(sizes):
        if at > start and total + size > BATCH_UNITS:
            yield start, at
            start, total = at, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _append(df: DataFrame, name: str, kind: T.DataType, drop: str | None, work) -> DataFrame:
    """`df` with column `name`, replacing one of that name, made batch by batch from all of the row's columns."""
    kept = [f for f in df.schema.fields if f.name not in (name, drop)]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for start, end, column in work(batch):
                rows = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([rows.column(f.name) for f in kept] + [column], [f.name for f in kept] + [name])

    return df.mapInArrow(batches, T.StructType([*kept, T.StructField(name, kind)]))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """`df` with `ids`, the token ids of the whole text as an array of ints.

    Ranks are those of the file; each match of `pattern` is merged by itself and there are no special tokens. NULL
    and empty texts have no ids. Rows are neither joined nor dropped, so repeated rows stay, and NULLs in other
    columns pass through. A column already named like `ids` is replaced. The text can be left out of the result. Texts of any length
    are encoded whole, in pieces that change no id; ties cannot arise. An empty table gives an empty table.
    """
    def work(batch):
        texts = batch.column(text)
        for start, end in _runs([n or 0 for n in pa.compute.binary_length(texts).to_pylist()]):
            found = [encode_text(t, ranks_path, pattern) for t in texts.slice(start, end - start).to_pylist()]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int64)
            values = np.fromiter((i for one in found for i in one), dtype=np.int32, count=ends[-1])
            yield start, end, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))

    return _append(df, ids, T.ArrayType(T.IntegerType(), False), None if keep_text else text, work)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`df` with `decoded`, the raw bytes of the ids; NULL ids give NULL, and no ids no bytes. Bytes need not be valid UTF-8.

    Rows are neither joined nor dropped, so repeated rows stay, and NULLs in other columns pass through. A column already named
    like `decoded` is replaced. An empty table gives an empty table.
    """
    def work(batch):
        column = batch.column(ids)
        encoding = load_encoding(ranks_path, pattern)
        for start, end in _runs([n or 0 for n in pa.compute.list_value_length(column).to_pylist()]):
            found = [None if one is None else encoding.decode_bytes(one) for one in column.slice(start, end - start).to_pylist()]
            yield start, end, pa.array(found, pa.binary())

    return _append(df, decoded, T.BinaryType(), None, work)

"""Benchmark decontamination by winnowing (Schleimer, Wilkerson and Aiken 2003).

Native throughout. A window of `t` words holds `t - k + 1` runs of `k` words; a text keeps the smallest hash of the runs
of each of its windows, once for as long as it stays the smallest. Equal windows have equal smallest hashes, so texts
that share `t` words or more share a kept hash, and no shared span is missed. Kept hashes are less than a third of the
words, and only those that a benchmark item holds as well are hits. A hit is extended to all windows whose smallest
hash it is: their own hashes travel with it, and are compared with those of the windows of the items.

An item of fewer than `t` words is one window of its own length. Each such length that occurs is winnowed by itself, with
`t` lowered to it. Texts are read once and never shuffled. Documents that hold the same set of windows share
one look-up of the items, so a passage in many documents and many items costs neither their product.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurva.llm.text import ascii_lower, content_key
from recurva.session import checkpointed

#: What separates words: ASCII signs and blanks, and nothing beyond ASCII.
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ROW = ["__row_1", "__row_2"]


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), _SEPARATORS, -1), lambda word: word != "")


def word_hashes(text: Column) -> Column:
    """A 64-bit hash per word of the text, none for NULL."""
    return F.coalesce(F.transform(_words(text), lambda word: F.xxhash64(word)), F.array().cast("array<bigint>"))


def _run_words(window: int) -> int:
    """Words of a run, about half a window, which keeps few hashes that are rare."""
    return (window + 1) // 2


def _places(first: int, last: Column) -> Column:
    """The integers from `first` to `last`, none if there are none."""
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, also where it is read for every element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _neighbours(values: Column, shift: int, join: Callable[[Column, Column], Column]) -> Column:
    """Each element joined with the one `shift` places on, without the elements that have no partner."""
    left = F.greatest(F.size(values) - shift, F.lit(0))
    return F.zip_with(F.slice(values, 1, left), F.slice(values, shift + 1, left), join)


def _runs(words: Column, window: int) -> Column:
    """A hash per run of words."""
    size = _run_words(window)
    return F.transform(_places(1, F.size(words) - size + 1), lambda i: F.xxhash64(F.slice(words, i, size)))


def _smallest(runs: Column, window: int) -> Column:
    """Per window the smallest hash of its runs, as minima over spans that double until they fill the window."""
    inner, span, low = window - _run_words(window) + 1, 1, runs
    while span < inner:
        step = min(span, inner - span)
        low = _let(low, _minima(step))
        span += step
    return low


def _minima(shift: int) -> Callable[[Column], Column]:
    return lambda values: _neighbours(values, shift, lambda x, y: F.least(x, y))


def _keys(runs: Column, window: int) -> Column:
    """A hash per window, from its first and its last run, which cover it."""
    return _neighbours(runs, window - _run_words(window), lambda x, y: F.xxhash64(x, y))


def _of_windows(words: Column, window: int, use: Callable[[Column, Column], Column]) -> Column:
    """`use(smallest, keys)` over the windows of a text."""
    return _let(_runs(words, window), lambda runs: _let(_smallest(runs, window), lambda low: _let(_keys(runs, window), lambda keys: use(low, keys))))


def _kept(words: Column, window: int) -> Column:
    """`window, first, hash, keys` per stretch of windows that share their smallest hash, so that each is kept once."""
    def use(low: Column, keys: Column) -> Column:
        def stretches(starts: Column) -> Column:
            after = F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0)))
            return F.zip_with(starts, after, lambda first, end: F.struct(
                F.lit(window).alias("window"), first.alias("first"), F.get(low, first - 1).alias("hash"),
                F.slice(keys, first, F.coalesce(end, F.size(low) + 1) - first).alias("keys")))

        return _let(F.filter(_places(1, F.size(low)), lambda i: (i == 1) | (F.get(low, i - 1) != F.get(low, i - 2))), stretches)

    return _of_windows(words, window, use)


def fingerprints(df: DataFrame, hashes: Column, windows: list[int], *carried: str) -> DataFrame:
    """The kept hashes of a text's word hashes: `window, first, hash, keys` behind the carried columns.

    `first` counts windows of `window` words from 1, and `keys` has a hash per window from there on that keeps the same. Ahead of
    them comes a row with a window of 0 and the text's number of words as `first`.
    """
    def kept(words: Column) -> Column:
        ahead = F.array(F.struct(F.lit(0).alias("window"), F.size(words).alias("first"), F.xxhash64(*carried, F.size(words)).alias("hash"),
                                 F.array().cast("array<bigint>").alias("keys")))
        return F.concat(ahead, *[_kept(words, t) for t in windows])

    return df.select(*carried, F.inline(_let(hashes, kept)))


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 10) -> DataFrame:
    """`item_id, window, hash, key` per different window of an item; one of fewer words than `window` is one window of its length."""
    hashes = word_hashes(F.col(text))
    sized = items.select(F.col(item_id).cast("string").alias("item_id"), hashes.alias("__words"))
    length = F.least(F.size("__words"), F.lit(window))
    sizes = sorted(r[0] for r in sized.select(length).distinct().collect())  # at most `window` + 1
    found = [sized.where(length == t).select("item_id", F.lit(t).alias("window"), F.inline(_of_windows(F.col("__words"), t, lambda low, keys: F.zip_with(
        low, keys, lambda x, y: F.struct(x.alias("hash"), y.alias("key")))))) for t in sizes if t > 0]
    if not found:
        return items.sparkSession.createDataFrame([], "item_id string, window int, hash bigint, key bigint")
    return functools.reduce(DataFrame.unionByName, found).distinct()


def contaminated_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", window: int = 10) -> DataFrame:
    """`docs` with `n_words`, the hit words as `spans` (structs `first, last`, counted from 1) and the ids of the `items` they belong to.

    A word is a stretch of digits, letters a to z after A-Z are lower-cased, and characters beyond ASCII. A window is
    `window` consecutive words of an item, or the whole item where it has fewer; a word of a document is hit if it lies in an
    occurrence of a window. Spans are merged where they touch. `items` are ids as text, different and in ascending order.

    NULL and empty texts have no words: such a document has no spans, such an item hits nothing. An item with a NULL id hits
    words and is not listed. Repeated rows come out as often as they went in; items that repeat count once. Ties cannot arise.
    Very long texts are split into hashes once, and only arrays of hashes of a single text are held. Empty tables give no rows,
    or rows without spans. Other columns pass through; `n_words`, `spans` and `items` are replaced.
    """
    windows = checkpointed(item_windows(items, item_id, item_text, window))
    lengths = sorted(r["window"] for r in windows.select("window").distinct().collect())
    keys = [k.alias(name) for k, name in zip(content_key(docs, doc_id, text), _ROW)]
    kept = fingerprints(docs.select(*keys, F.col(text).alias("__text")), word_hashes(F.col("__text")), lengths, *_ROW)
    known = windows.select("window", "hash").distinct().withColumn("known", F.lit(True))
    hits = checkpointed(kept.join(known, ["window", "hash"], "left").where("known OR window = 0").drop("known", "hash"))
    counts = hits.where("window = 0").groupBy(*_ROW).agg(F.max("first").cast("long").alias("n_words"))

    extended = hits.where("window > 0").select(*_ROW, "window", "first", F.posexplode("keys").alias("step", "key"))
    found = extended.join(windows.select("window", "key").distinct(), ["window", "key"], "left_semi")
    first = F.col("first") + F.col("step")
    rows = checkpointed(found.groupBy(*_ROW).agg(
        F.sort_array(F.collect_list(F.struct(first.alias("first"), (first + F.col("window") - 1).alias("last")))).alias("places"),
        F.sort_array(F.collect_set(F.struct("window", "key"))).alias("held"),
    ).select(*_ROW, merged_spans(F.col("places")).alias("spans"), "held", F.xxhash64(F.lit(1), "held").alias("set_1"),
             F.xxhash64(F.lit(2), "held").alias("set_2")))

    sets = rows.groupBy("set_1", "set_2").agg(F.any_value("held").alias("held")).select("set_1", "set_2", F.inline("held"))
    listed = sets.join(windows, ["window", "key"]).groupBy("set_1", "set_2").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    named = rows.join(listed, ["set_1", "set_2"]).select(*_ROW, "spans", "items")
    plain = docs.drop("n_words", "spans", "items").withColumns(dict(zip(_ROW, content_key(docs, doc_id, text))))
    out = plain.join(counts, _ROW).join(named, _ROW, "left")
    no_spans, no_items = F.array().cast("array<struct<first:int,last:int>>"), F.array().cast("array<string>")
    return out.withColumns({"spans": F.coalesce("spans", no_spans), "items": F.coalesce("items", no_items)}).drop(*_ROW)


def merged_spans(places: Column) -> Column:
    """Sorted places `first, last` without overlaps: those that overlap or touch become one."""
    def add(spans: Column, place: Column) -> Column:
        last = F.element_at(spans, -1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["last"], place["last"]).alias("last"))
        joined = F.array_append(F.slice(spans, 1, F.size(spans) - 1), longer)
        return F.when((F.size(spans) > 0) & (place["first"] <= F.try_element_at(spans, F.lit(-1))["last"] + 1), joined).otherwise(
            F.array_append(spans, place))

    return F.aggregate(places, F.array().cast("array<struct<first:int,last:int>>"), add)


def span_words(spans: Column) -> Column:
    """Words within spans, as a long."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, span: n + span["last"] - span["first"] + 1)

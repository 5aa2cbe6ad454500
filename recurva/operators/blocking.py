"""Blocking: which records of different sources share a normalised e-mail domain, name or phone.

Sizes and pair counts of blocks come from counts, not from pairs: no operator here lists the pairs of a
block. `operators.matching` finds the pairs that can reach the match threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurva.functions.coerce import blank_to_null, field_values
from recurva.functions.normalize import company_key, email_domain, phone_key
from recurva.session import checkpointed
from recurva.sources.envelope import canonical

IDENTITY = ("source_type", "record_id")


@dataclass(frozen=True)
class Strategy:
    """A way to block: the fields to read, how to normalise them, and the shortest useful key."""

    name: str
    fields: tuple[str, ...]
    normalize: Callable[[Column], Column]
    min_length: int = 1


# Fields read by each strategy, and the shortest key.
STRATEGIES = (
    Strategy("email_domain", ("email", "email_address", "owner_email", "contact_email"), email_domain),
    Strategy("company_name", ("name", "company_name", "company", "account_name", "organization"), company_key, 2),
    Strategy("phone", ("phone", "phone_number", "mobile", "tel"), phone_key, 7),
)


def with_source(records: DataFrame) -> DataFrame:
    """Records with a source and an id.

    Those without a source come from `unknown`. Those without an id, or with a blank one, are named after their
    content, so that only records equal in all fields are taken for copies of one.
    """
    source = F.col("source_type") if "source_type" in records.columns else F.lit(None).cast("string")
    content = F.concat(F.lit("#"), F.md5(F.to_json(canonical(F.col("data"), records.schema["data"].dataType), {"ignoreNullFields": "false"}))) if "data" in records.columns else F.lit("")
    return records.withColumns({
        "source_type": F.coalesce(source, F.lit("unknown")),
        "record_id": F.coalesce(blank_to_null(F.col("record_id").cast("string")), content),
    })


def _newest(rows: DataFrame) -> DataFrame:
    """An aggregate and not a window, so that copies of one id are combined before the shuffle."""
    rank = [F.col(c) for c in ("extracted_at", "record_hash") if c in rows.columns]
    if "record_hash" not in rows.columns:
        rank.append(F.md5(F.to_json(F.struct(*[c for c in rows.columns if c != "extracted_at"]))))
    rest = [c for c in rows.columns if c not in IDENTITY]
    newest = rows.groupBy(*IDENTITY).agg(F.max_by(F.struct(*rest), F.struct(*rank)).alias("newest"))
    return newest.select(*IDENTITY, "newest.*").select(*rows.columns)


def latest_records(records: DataFrame) -> DataFrame:
    """One row per (source, id): the newest by `extracted_at`, then by `record_hash`.

    Ids that occur twice are found first, by ids alone. Only their rows are shuffled as a whole; without any
    the records come back as they are.
    """
    rows = with_source(records)
    repeated = checkpointed(rows.groupBy(*IDENTITY).count().where(F.col("count") > 1).select(*IDENTITY))
    if repeated.isEmpty():
        return rows
    keys = list(IDENTITY)
    single = rows.join(repeated, keys, "left_anti")
    return single.unionByName(_newest(rows.join(repeated, keys, "left_semi").select(*rows.columns)))


def strategy_keys(records: DataFrame, strategy: Strategy) -> Column:
    """The distinct keys of a record under one strategy; every filled field gives one."""
    keys = [strategy.normalize(value) for value in field_values(records, strategy.fields)]
    if not keys:
        return F.array().cast("array<string>")
    usable = F.filter(F.array(*keys), lambda k: F.length(k) >= strategy.min_length)  # normalises each field once
    return F.array_distinct(usable) if len(keys) > 1 else usable


def key_array(records: DataFrame, strategies: Sequence[Strategy] = STRATEGIES) -> Column:
    """All keys of a record as sorted text `strategy:key`."""
    def labelled(strategy: Strategy) -> Column:
        return F.transform(strategy_keys(records, strategy), lambda k: F.concat(F.lit(f"{strategy.name}:"), k))

    return F.sort_array(F.concat(*map(labelled, strategies)))


def block_keys(records: DataFrame, strategies: Sequence[Strategy] = STRATEGIES) -> DataFrame:
    """The block index: one row per record, strategy and key."""
    def tagged(strategy: Strategy) -> Column:
        return F.transform(strategy_keys(records, strategy),
                           lambda k: F.struct(F.lit(strategy.name).alias("strategy"), k.alias("key")))

    return with_source(records).select("source_type", "record_id", F.inline(F.concat(*map(tagged, strategies))))


def block_sizes(keys: DataFrame) -> DataFrame:
    """Per strategy and key: sources, records, and how many pairs of different sources share it."""
    per_source = keys.groupBy("strategy", "key", "source_type").agg(F.count(F.lit(1)).alias("n"))
    total, squares = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    return per_source.groupBy("strategy", "key").agg(
        F.count(F.lit(1)).alias("sources"), total.alias("records"), ((total * total - squares) / 2).cast("long").alias("pairs")
    )


def _shared_sets(records: DataFrame, strategies: Sequence[Strategy]) -> DataFrame:
    """`source_type, keys, n`: the different sets of keys that records of several sources share, with the number of records.

    Keys that only one source has join nothing and are left out. Of keys that always come together one stands for all: their
    records are the same, which 128 bits over the sets that hold a key tell.
    """
    rows = with_source(records)
    sets = checkpointed(rows.select("source_type", key_array(rows, strategies).alias("keys")).groupBy("source_type", "keys").agg(
        F.count(F.lit(1)).alias("n")).withColumn("set", F.monotonically_increasing_id()))  # fixed by the writing
    places = sets.select("set", "source_type", F.explode("keys").alias("key"))
    holders = [F.bit_xor(F.xxhash64("set", F.lit(i))).alias(f"holders_{i}") for i in (1, 2)]
    shared = places.groupBy("key").agg(F.min("source_type").alias("first"), F.max("source_type").alias("last"), F.count(F.lit(1)).alias("sets"), *holders)
    chosen = shared.where("first < last").groupBy("sets", "holders_1", "holders_2").agg(F.min("key").alias("key")).select("key")
    left = places.join(chosen, "key").groupBy("set").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    return left.join(sets.select("set", "source_type", "n"), "set").groupBy("source_type", "keys").agg(F.sum("n").alias("n"))


def _shared_subsets(sets: DataFrame, at_once: int) -> DataFrame:
    """`source_type, shared, n`: records per source that hold a subset of keys, for all subsets that several sources hold.

    Sets of up to `at_once` keys list their subsets. For larger ones subsets grow by one key at a time, and only those that
    several sources still hold grow on, so that a set of many keys does not list what nobody else holds. Where several sources
    share many keys of which each also comes without the others, that is still many.
    """
    if sets.where(F.size("keys") > at_once).isEmpty():
        nothing = F.array(F.array().cast("array<string>"))
        subsets = F.aggregate("keys", nothing, lambda found, key: F.concat(found, F.transform(found, lambda s: F.array_append(s, key))))
        return sets.select("source_type", "n", F.explode(F.filter(subsets, lambda s: F.size(s) > 0)).alias("shared")).groupBy(
            "shared", "source_type").agg(F.sum("n").alias("n"))
    found, grown = None, sets.select("source_type", "n", "keys", F.array().cast("array<string>").alias("shared"))
    while True:
        last = F.coalesce(F.array_max("shared"), F.lit(""))
        grown = grown.select("source_type", "n", "keys", F.explode(F.transform(
            F.filter("keys", lambda key: (key > last) | (F.size("shared") == 0)), lambda key: F.array_append("shared", key))).alias("shared"))
        grown = checkpointed(grown)
        several = grown.groupBy("shared").agg(F.min("source_type").alias("first"), F.max("source_type").alias("last")).where("first < last")
        grown = checkpointed(grown.join(several.select("shared"), "shared").select("source_type", "n", "keys", "shared"))
        counts = grown.groupBy("shared", "source_type").agg(F.sum("n").alias("n"))
        if grown.isEmpty():
            return counts if found is None else found
        found = counts if found is None else found.unionByName(counts)


def candidate_counts(records: DataFrame, strategies: Sequence[Strategy] = STRATEGIES, at_once: int = 8) -> DataFrame:
    """Distinct candidate pairs per pair of sources, over the union of all strategies.

    By inclusion and exclusion: pairs that share a set of keys are counted for every subset of the set, with
    alternating sign, so each pair adds up to one. Work grows with the records and not with the pairs, and records with the
    same keys are counted once.
    """
    counts = _shared_subsets(checkpointed(_shared_sets(records, strategies)), at_once)
    a = counts.select("shared", F.col("source_type").alias("source_a"), F.col("n").alias("n_a"))
    b = counts.select("shared", F.col("source_type").alias("source_b"), F.col("n").alias("n_b"))
    sign = F.when(F.size("shared") % 2 == 1, 1).otherwise(-1)
    return (
        a.join(b, "shared").where(F.col("source_a") < F.col("source_b"))
        .groupBy("source_a", "source_b")
        .agg(F.sum(sign * F.col("n_a") * F.col("n_b")).alias("candidate_pairs"))
    )

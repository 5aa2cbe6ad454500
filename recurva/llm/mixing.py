"""Mixing sources to target weights.

Native throughout. The words of a source stand in one long line, document after document, cut into blocks of a fixed
number of words; a document covers one block or several and shares its first and last with its neighbours. The mix is
a list of slots in shards of fixed size, each holding one block of one source. The source counts of a shard are a
multinomial draw by the sources' quotas, which follow from their targets. Chance gives some sources more slots than
their quota and others fewer; once a source has its quota, its further slots go to those that are short, so targets and
the cap on repeats hold exactly. About as many slots change hands as the square roots of the quotas add up to, in the
last shards of these sources. The j-th slot of a source holds the block to which the source's own permutation of this
epoch sends j, so every block comes once before any comes again. Slots and blocks meet in a join on source and block number, whose
keys are spread evenly however large one source is.

Permutations are swap-or-not shuffles (Hoang, Morris and Rogaway 2012): they work on any range, need no state, and
are plain column expressions. Everything follows from content and seed; reruns agree.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recurva.llm.text import BLANK_CLASS, content_key, word_count
from recurva.session import checkpointed

#: Buckets of a source's documents; their sums place every document without ordering a whole source in one task.
BUCKETS = 4096
#: Shards whose counts are summed as one on the way to a place among all slots of a source.
SPAN = 4096
#: Cells of the slot plan up to which it is sent to all tasks.
BROADCAST_CELLS = 100_000
ROUNDS = 16


class Mix(NamedTuple):
    """`sources`: a row per source with its size and target; `slots`: source, block, shard and place of every slot;
    `pieces`: per input row and block the words it holds there, with the number of slots that hold the block."""

    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame


def _round_keys(size: Column, *seed: Column) -> Column:
    """A round's number and reflection point, for each round of a permutation of `size` values."""
    return F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda r: F.struct(
        r.alias("r"), F.pmod(F.xxhash64(*seed, r), F.greatest(size, F.lit(1))).alias("k")))


def _permuted(value: Column, size: Column, keys: Column, *seed: Column) -> Column:
    """Where the permutation sends `value`; below `size` as it is."""
    def step(at, key):
        other = F.pmod(key["k"] - at, size)
        swap = F.xxhash64(*seed, key["r"], F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(at)
    return F.aggregate(keys, value, step)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: float = 3.0) -> DataFrame:
    """`__src, source, source_size, target`: each source's share of all words by weight, at most `max_repeat` times its size.

    Sources by code point, NULL last, take the weights in turn. What a capped source cannot take goes to the others by
    weight until none is above its cap: all targets are the smaller of the cap and of weight times one common level.
    The windows run over one row per source.
    """
    by_source = sizes.groupBy("__src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, map(float, weights))), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    weighted = by_source.withColumn("__weight", turn).withColumn("__cap", F.col("source_size") * float(max_repeat))
    weighted = weighted.withColumn("__ratio", F.col("__cap") / F.col("__weight"))
    by_ratio = Window.orderBy("__ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("__cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("__weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    levels = weighted.withColumn("__level", (F.sum("source_size").over(everything) - before) / left)
    level = F.max(F.when(F.col("__ratio") > F.col("__level"), F.col("__level"))).over(everything)
    levels = levels.withColumn("__common", level)
    target = F.when(F.col("__ratio") <= F.col("__common"), F.col("__cap")).otherwise(
        F.coalesce(F.col("__weight") * F.col("__common"), F.col("__cap")))
    return levels.select("__src", "source", "source_size", target.alias("target"))


def _owned(rows: DataFrame, owners: DataFrame, total: int, many: int) -> DataFrame:
    """Each row of `rows` with the row of `owners` whose stretch, `__size` long from `__start` on, holds its `__at`.

    The stretches cover 0 to `total`, which is cut into cells, four for each of the `many` owners at least, so that a cell meets few
    stretches. The cells are sent to all tasks while they are few.
    """
    least = max(1024, 4 * many)
    width = max(1, -(-total // least))
    ends = F.col("__start") + F.col("__size")
    cells = owners.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__start") / width), F.floor((ends - 1) / width))))
    if least + many <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    found = rows.withColumn("__cell", F.floor(F.col("__at") / width)).join(cells, "__cell")
    return found.where((F.col("__at") >= F.col("__start")) & (F.col("__at") < ends)).drop("__cell")


def _before(column: str, window) -> Column:
    """Sum of the rows before this one."""
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _shard_counts(plan: DataFrame, total: int, many: int, shard_slots: int, seed: int) -> DataFrame:
    """Multinomial draws: `shard, __src, __n`, the slots of a shard that an independent draw by quota gives to a source.

    A slot's draw is a hash of its place, and its source the one whose stretch of all quotas holds it. Counts are combined before
    their shuffle, as the slots of a shard lie together.
    """
    tasks = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.col("id")
    drawn = plan.sparkSession.range(0, total, 1, tasks).select(
        F.floor(place / shard_slots).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), place), F.lit(max(total, 1))).alias("__at"))
    owners = plan.select("__src", "__start", F.col("__quota").alias("__size"))
    return _owned(drawn, owners, total, many).groupBy("shard", "__src").agg(F.count(F.lit(1)).alias("__n"))


def _slots(sources: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """`__src, block, place, shard` of every slot, as many of a source as its quota says."""
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    plan = sources.select("__src", blocks.alias("__blocks"), quota.cast("long").alias("__quota")).where(F.col("__quota") > 0)
    plan = checkpointed(plan.withColumn("__start", _before("__quota", Window.orderBy("__src"))))
    many, total = plan.agg(F.count(F.lit(1)), F.coalesce(F.sum("__quota"), F.lit(0))).first()

    counts = checkpointed(_shard_counts(plan, total, many, shard_slots, seed)).withColumn("__span", F.floor(F.col("shard") / SPAN))
    spans = counts.groupBy("__src", "__span").agg(F.sum("__n").alias("__sum"))
    spans = spans.withColumn("__base", _before("__sum", Window.partitionBy("__src").orderBy("__span"))).drop("__sum")
    lined = counts.join(spans, ["__src", "__span"]).join(plan.drop("__start"), "__src").withColumns({
        "__first": F.col("__base") + _before("__n", Window.partitionBy("__src", "__span").orderBy("shard")),
        "__local": _before("__n", Window.partitionBy("shard").orderBy("__src")),
    })
    lined = lined.withColumn("__kept", F.least("__n", F.greatest(F.col("__quota") - F.col("__first"), F.lit(0))))
    lined = checkpointed(lined.drop("__base", "__quota"))

    def with_keys(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__size", F.least(F.lit(shard_slots), total - F.col("shard") * shard_slots)).withColumns({
            "__own_keys": _round_keys(F.col("__blocks"), F.lit(seed), F.col("__src")),
            "__shard_keys": _round_keys(F.col("__size"), F.lit(seed), F.lit("shard"), F.col("shard")),
        })

    wide = ["__src", "__blocks", "shard", "__size", "__own_keys", "__shard_keys"]
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = lined.where(F.col("__kept") > 0).repartition(tasks, "shard", "__src")  # few bytes list many slots
    kept = with_keys(kept).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__kept") - 1)))
    kept = kept.select(*wide, (F.col("__first") + F.col("__i")).alias("__j"), (F.col("__local") + F.col("__i")).alias("__local"))

    drawn = counts.groupBy("__src").agg(F.sum("__n").alias("__drawn"))
    short = plan.drop("__start").join(drawn, "__src", "left").withColumn("__drawn", F.coalesce("__drawn", F.lit(0)))
    short = short.withColumn("__size", F.col("__quota") - F.col("__drawn")).where(F.col("__size") > 0).drop("__quota")
    short = checkpointed(short.withColumn("__start", _before("__size", Window.orderBy("__src"))))
    few, missing = short.agg(F.count(F.lit(1)), F.coalesce(F.sum("__size"), F.lit(0))).first()
    over = lined.where(F.col("__n") > F.col("__kept")).withColumn("__over", F.col("__n") - F.col("__kept"))
    bases = over.groupBy("__span").agg(F.sum("__over").alias("__sum"))
    bases = bases.withColumn("__base", _before("__sum", Window.orderBy("__span"))).drop("__sum")
    over = over.withColumn("__rank", _before("__over", Window.partitionBy("__span").orderBy("shard", "__src"))).join(bases, "__span")
    over = over.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__over") - 1))).select(
        "shard", (F.col("__local") + F.col("__kept") + F.col("__i")).alias("__local"),
        (F.col("__base") + F.col("__rank") + F.col("__i")).alias("__at"))
    filled = _owned(over, short, missing, few).withColumn("__j", F.col("__drawn") + F.col("__at") - F.col("__start"))
    filled = with_keys(filled.select("__src", "__blocks", "shard", "__j", "__local")).select(*wide, "__j", "__local")

    slots = kept.unionByName(filled)
    epoch = F.floor(F.col("__j") / F.col("__blocks"))
    block = _permuted(F.pmod("__j", "__blocks"), F.col("__blocks"), F.col("__own_keys"), F.lit(seed), F.col("__src"), epoch)
    local = _permuted(F.col("__local"), F.col("__size"), F.col("__shard_keys"), F.lit(seed), F.lit("place"), F.col("shard"))
    return slots.select("__src", block.alias("block"), (F.col("shard") * shard_slots + local).alias("place"), "shard")


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1),
        max_repeat: float = 3.0, block_words: int = 64, shard_slots: int = 4096, seed: int = 42) -> Mix:
    """Targets, slots and pieces for the rows of `df`.

    A row's size is its number of words, 0 for NULL and blank texts; such rows have one piece without a block and are
    never taken. A NULL source is a source of its own, in the last place. Rows are places in the line of their source,
    so repeated rows, also with equal or NULL ids, are packed and taken separately. An empty table gives empty tables.
    A source takes its target to within a block; no row is taken more than `max_repeat` times.
    """
    keys = content_key(df, doc_id, text, source)
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    rows = checkpointed(df.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), key.alias("__src"),
        word_count(F.col(text)).alias("size"), keys[0].alias("__row_1"), keys[1].alias("__row_2")))
    rows = rows.withColumn("__bucket", F.pmod("__row_1", F.lit(BUCKETS)))
    sources = checkpointed(source_targets(rows, weights, max_repeat))
    slots = _slots(sources, block_words, shard_slots, seed)

    up_to = Window.unboundedPreceding
    sums = rows.groupBy("__src", "__bucket").agg(F.sum("size").alias("__sum"))
    starts = sums.select("__src", "__bucket", F.coalesce(F.sum("__sum").over(
        Window.partitionBy("__src").orderBy("__bucket").rowsBetween(up_to, -1)), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__src", "__bucket").orderBy("__row_1", "__row_2", "doc_id")
    placed = rows.withColumn("__rank", F.row_number().over(inside)).withColumn(
        "__before", F.coalesce(F.sum("size").over(inside.rowsBetween(up_to, -1)), F.lit(0))).join(starts, ["__src", "__bucket"])
    placed = placed.withColumn("__from", F.col("__start") + F.col("__before")).withColumn("__to", F.col("__from") + F.col("size"))
    covered = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("__from") / block_words), F.floor((F.col("__to") - 1) / block_words)))
    pieces = placed.withColumn("block", F.explode_outer(covered))
    first = F.greatest(F.col("block") * block_words, F.col("__from"))
    words = F.least((F.col("block") + 1) * block_words, F.col("__to")) - first
    pieces = pieces.select("doc_id", "__src", "size", "__row_1", "__row_2", "__bucket", "__rank", "block",
                           (first - F.col("__from")).alias("first_word"), words.alias("words"))
    drawn = slots.groupBy("__src", "block").agg(F.count(F.lit(1)).alias("times"), F.min("shard").alias("first_shard"))
    # Spark takes the drawn blocks for as small as the plan they are listed from, and would broadcast them
    pieces = pieces.join(drawn.hint("merge"), ["__src", "block"], "left").withColumn("times", F.coalesce(F.col("times"), F.lit(0)))
    return Mix(sources.select("source", "source_size", "target", "__src"), slots, pieces)


def taken_words(found: Mix) -> DataFrame:
    """A line per input row: `doc_id, size, source, source_size, target, taken, first_shard`."""
    by_row = found.pieces.groupBy("__src", "__bucket", "__rank", "doc_id", "size").agg(
        F.coalesce(F.sum(F.col("times") * F.col("words")), F.lit(0)).alias("taken"), F.min("first_shard").alias("first_shard"))
    return by_row.join(found.sources, "__src").select("doc_id", "size", "source", "source_size", "target", "taken", "first_shard")


def mixed_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """`df` with each text replaced by the words of it that the mix takes; rows of which it takes none are left out.

    Words keep the blanks after them and their order; what is taken again follows after a line end. Rows equal in id,
    source and text come out as one row that holds what the mix takes of all of them, with the other columns of any. NULL ids are
    ids like others, NULL and blank texts are never taken, and a NULL source is a source. An empty table gives an empty table. Other
    columns pass through, whatever their names.
    """
    keys = ["__row_1", "__row_2"]
    took = mix(df, doc_id, text, source, **options).pieces.where(F.col("times") > 0)
    took = took.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__rank", "first_word", "words", "times"))).alias("__took"))
    rows = df.withColumns(dict(zip(keys, content_key(df, doc_id, text, source)))).dropDuplicates(keys).join(took.hint("merge"), keys)
    words = F.regexp_extract_all(F.col(text), F.lit(f"[^{BLANK_CLASS}]+[{BLANK_CLASS}]*"), F.lit(0))
    rows = rows.select("*", F.explode(F.array(words)).alias("__words"))  # a generator, lest words are extracted for every piece
    most = F.array_max(F.transform("__took", lambda one: one["times"]))
    again = F.transform(F.sequence(F.lit(1), most), lambda turn: F.array_join(F.flatten(F.transform(
        F.filter("__took", lambda one: one["times"] >= turn),
        lambda one: F.slice(F.col("__words"), (one["first_word"] + 1).cast("int"), one["words"].cast("int")))), ""))
    return rows.withColumn(text, F.array_join(again, "\n")).drop(*keys, "__took", "__words")

"""Conversation repair by a suffix-shared automaton.

A row is a letter: its role's initial and its fault. The letters of a conversation, cut from its end into segments of a bounded
length, are its signatures, and equal signatures of all conversations are solved once. Signatures are read from the end and
sorted that way, so those with a common suffix lie next to each other: a task walks over them with the path of the automaton
on a stack, and a node, which is a suffix, is made once for all that end in it. A node holds per state of the
role grammar the least cost of repairing its rows and the least audit of that cost.

What follows a segment is one of five things: the end, or a state in which the next one starts. The segments of a long
conversation are joined from its end, which adds the costs from there on and settles where each segment leads to from each state.
Inserts belong to the segment after them, so that audits of equal cost never are prefixes of each other, and the least
audit of a whole is made of the least audits of its parts.

Ranks, faults and signatures are narrow rows that large conversations share out over many tasks. Texts move once. Only where
the result itself is one value per conversation, its audit and the digest of its text, do its rows pass through one task, sorted
and streamed: what is held of them is the audit.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recurva.llm.text import BLANKS
from recurva.operators.ranking import ranked, same
from recurva.session import checkpointed

# States of the grammar (s?(ua)+)? by what was said last.
START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = (USER, USER, ASSISTANT, USER)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_END = -1
#: A row that has to be deleted; others are the initial of their role, or `o`, in upper case where the text is truncated.
_GONE = "x"
SEGMENT = 16
_BATCH_ROWS, _BATCH_CHARS = 2000, 4_000_000

_OPTION = "struct<at:int,to:int,cost:bigint,audit:string>"


# --- the automaton ------------------------------------------------------------------------------


def _end_node() -> dict[int, list]:
    """Before the end of a conversation: nothing, or the inserts that complete a pair."""
    return {_END: [(0, ""), (4, "II"), (2, "I"), (0, "")]}


def _inner_node() -> dict[int, list]:
    """Before the next segment, for each state it may start in."""
    return {state: [(0, "") if state == at else None for at in range(4)] for state in range(4)}


def _before(letter: str, node: dict[int, list]) -> dict[int, list]:
    """The node of a suffix that is `letter` and then `node`: per goal and state the least cost and the least audit."""
    initial, extra = letter.lower(), int(letter.isupper())

    def options(at: int, rest: list) -> Iterator[tuple[int, str]]:
        after = _AFTER[at]
        if rest[at]:
            yield rest[at][0] + 3, "D" + rest[at][1]
        if letter != _GONE:
            kept = SYSTEM if initial == "s" and at == START else after if _NAMES[after][0] == initial else None
            if kept is not None and rest[kept]:
                yield rest[kept][0] + extra, "K" + rest[kept][1]
            if rest[after]:
                yield rest[after][0] + extra + 2, "R" + rest[after][1]

    found = {}
    for goal, rest in node.items():
        best = [min(options(at, rest), default=None) for at in range(4)]
        for _ in range(3):  # an insert leads to the state after, at most three until one comes round
            for at in range(4):
                then = best[_AFTER[at]]
                if then:
                    best[at] = min(filter(None, (best[at], (then[0] + 2, "I" + then[1]))))
        found[goal] = best
    return found


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Options per signature. `reversed` comes sorted, so that the stack holds the nodes shared with the one before."""
    before, inner, stack = "", None, []
    for batch in batches:
        out = []
        for is_inner, word in zip(batch["inner"].to_pylist(), batch["reversed"].to_pylist()):
            if is_inner != inner:
                before, inner, stack = "", is_inner, [_inner_node() if is_inner else _end_node()]
            shared = 0
            while shared < min(len(word), len(before)) and word[shared] == before[shared]:
                shared += 1
            del stack[shared + 1:]
            for letter in word[shared:]:
                stack.append(_before(letter, stack[-1]))
            before = word
            out.append([{"at": at, "to": goal, "cost": best[0], "audit": best[1]}
                        for goal, table in stack[-1].items() for at, best in enumerate(table) if best])
        yield pa.RecordBatch.from_arrays([batch["inner"], batch["reversed"], pa.array(out, pa.list_(_ARROW_OPTION))], ["inner", "reversed", "options"])


_ARROW_OPTION = pa.struct([("at", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])


def solve_signatures(signatures: DataFrame) -> DataFrame:
    """`inner, reversed, options` per different pair of `inner` (more rows follow) and `reversed` (letters from the end)."""
    keys = ["inner", "reversed"]
    return signatures.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(
        _solve, f"inner boolean, reversed string, options array<{_OPTION}>")


# --- segments of long conversations -------------------------------------------------------------


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment and state the best way on. Segments come sorted by conversation, the last one first."""
    conversation, to_go = None, {}
    for batch in batches:
        out = []
        for conv, segment, options in zip(batch["conv"].to_pylist(), batch["segment"].to_pylist(), batch["options"].to_pylist()):
            if segment == 0 or conv != conversation:
                conversation, to_go = conv, {_END: 0}
            best = {}
            for option in options:
                if option["to"] in to_go:
                    way = (option["cost"] + to_go[option["to"]], option["audit"], option["to"])
                    best[option["at"]] = min(best.get(option["at"], way), way)
            to_go = {at: way[0] for at, way in best.items()}
            out.append([{"at": at, "to": to, "cost": cost, "audit": audit} for at, (cost, audit, to) in best.items()])
        yield pa.RecordBatch.from_arrays([batch["conv"], batch["segment"], pa.array(out, pa.list_(_ARROW_OPTION))], ["conv", "segment", "options"])


# --- rows ---------------------------------------------------------------------------------------


def _plain(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    space = F.lit(" ")
    rows = df.select(F.col(f"`{conv_id}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
                     F.coalesce(F.col(f"`{role}`"), space).alias("role"), F.coalesce(F.col(f"`{text}`"), space).alias("text"))
    return rows.withColumns({f"said_{i}": F.xxhash64(F.lit(i), "role", "text") for i in (1, 2)})


def _narrow(rows: DataFrame) -> DataFrame:
    """Rows without their texts: order, initial, and whether they are blank or truncated. Duplicates are marked."""
    ended = F.rtrim(F.col("text"), F.lit(BLANKS))
    narrow = checkpointed(rows.select(
        "conv", "turn", "said_1", "said_2", F.substring("role", 1, 1).alias("initial"), (ended == "").alias("blank"),
        (~F.substring(ended, -1, 1).isin(".", "!", "?")).alias("truncated"), F.monotonically_increasing_id().alias("row")))
    said = ["said_1", "said_2"]
    first = narrow.groupBy("conv", *said).agg(F.min(F.struct("turn", "row")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select(
        F.col("conv").alias("__conv"), *[F.col(s).alias(f"__{s}") for s in said], "first")
    met = narrow.join(first, same([(F.col(c), F.col(f"__{c}")) for c in ("conv", *said)]), "left")
    later = F.col("first").isNotNull() & ~F.struct("turn", "row").eqNullSafe(F.col("first"))
    return met.withColumn("repeats", later & ~F.col("blank")).drop("first", "__conv", "__said_1", "__said_2")


def _segments(narrow: DataFrame, segment: int) -> DataFrame:
    """A row per segment: its letters from the end, its first row's place in the order, and counts of faults."""
    gone = F.col("blank") | F.col("repeats")
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    letter = F.when(gone, _GONE).when(F.col("truncated"), F.upper(initial)).otherwise(initial)
    # rows that are equal in turn, role and text change places without effect: those that repeat follow the first
    placed = ranked(narrow, ["conv"], ["turn", "said_1", "said_2", "repeats"]).withColumn("letter", letter)
    back = F.col("members") - 1 - F.col("rank")
    held = placed.groupBy("conv", F.floor(back / segment).cast("long").alias("segment")).agg(
        F.sort_array(F.collect_list(F.struct(back.alias("back"), "letter"))).alias("letters"),  # at most `segment`
        F.min(F.struct("rank", "turn", "said_1", "said_2")).alias("head"), F.max("members").alias("members"),
        *[F.count_if(c).alias(n) for n, c in (("blank", F.col("blank")), ("duplicate", F.col("repeats")),
                                              ("truncated", ~gone & F.col("truncated")))])
    return checkpointed(held.select("conv", "segment", "members", "head.turn", "head.said_1", "head.said_2", "blank", "duplicate", "truncated",
                                    (F.col("segment") > 0).alias("inner"), F.array_join(F.transform("letters", lambda x: x["letter"]), "").alias("reversed")))


def _ways(segments: DataFrame, segment: int) -> DataFrame:
    """Segments with the best way on from each state."""
    solved = checkpointed(solve_signatures(segments))
    known = segments.join(solved, ["inner", "reversed"]).drop("inner", "reversed")
    many = F.col("members") > segment
    long = known.where(many).select("conv", "segment", "options").repartition("conv").sortWithinPartitions("conv", "segment")
    conv = segments.schema["conv"].dataType.simpleString()
    joined = long.mapInArrow(_join_segments, f"conv {conv}, segment bigint, options array<{_OPTION}>").select(
        F.col("conv").alias("__conv"), F.col("segment").alias("__segment"), "options")
    long = known.where(many).drop("options").join(joined, same([(F.col("conv"), F.col("__conv")), (F.col("segment"), F.col("__segment"))]))
    return known.where(~many).unionByName(long.drop("__conv", "__segment"))


class _Conversation:
    """What is known of a conversation while its rows pass by."""

    def __init__(self, conv):
        self.conv, self.edits, self.audit, self.cost, self.state, self.said = conv, deque(), [], None, START, START
        self.digest, self.place = hashlib.sha256(), 0
        self.low = self.high = None
        self.turns = self.illegal = 0
        self.counts, self.initial = [0, 0, 0], None

    def ahead(self, options: list[dict], counts: list[int]) -> None:
        """A segment begins: its edits are known by the state in which the one before ended."""
        way = next(o for o in options if o["at"] == self.state)
        if self.cost is None:
            self.cost = way["cost"]
        self.state = way["to"]
        self.audit.append(way["audit"])
        self.edits.extend(way["audit"])
        self.counts = [a + b for a, b in zip(self.counts, counts)]

    def _say(self, edit: str, role: str | None, text: str) -> tuple:
        system = edit == "K" and self.said == START and role[:1] == "s"
        self.said = SYSTEM if system else _AFTER[self.said]
        role = role if edit == "K" else _NAMES[self.said]
        self.digest.update(("\n" if self.place else "").encode() + f"{role}:{text}".encode())
        self.place += 1
        return self.conv, self.place, role, text, edit

    def inserts(self) -> Iterator[tuple]:
        while self.edits and self.edits[0] == "I":
            yield self._say(self.edits.popleft(), None, "")

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        yield from self.inserts()
        edit = self.edits.popleft()
        if edit != "D":
            yield self._say(edit, role, text)

    def summary(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.counts, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def _play(summaries: bool, schema: pa.Schema):
    """Follow rows and the segments before them; give a summary per conversation, or its repaired rows."""
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, out, chars = None, [], 0

        def finish() -> Iterator[tuple]:
            if current is not None:
                rest = list(current.inserts())
                yield from [current.summary()] if summaries else rest

        names = ("conv", "kind", "turn", "role", "text", "options", "blank", "duplicate", "truncated")
        for batch in batches:
            for conv, kind, turn, role, text, options, *counts in zip(*(batch[n].to_pylist() for n in names)):
                if current is None or conv != current.conv:
                    out.extend(finish())
                    current = _Conversation(conv)
                if kind == 0:
                    current.ahead(options, counts)
                    chars += len(options[0]["audit"])
                    continue
                said = list(current.row(turn, role, text))
                if not summaries:
                    out.extend(said)
                    chars += len(text)
                if len(out) >= _BATCH_ROWS or out and chars >= _BATCH_CHARS:
                    yield batch_of(out)
                    out, chars = [], 0
        out.extend(finish())
        yield batch_of(out)

    return run


def _arrow_type(kind: T.DataType) -> pa.DataType:
    return pa.string() if isinstance(kind, T.StringType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.int64()


def _played(df: DataFrame, columns: tuple[str, ...], segment: int, fields: str, summaries: bool) -> DataFrame:
    rows = _plain(df, *columns)
    conv = rows.schema["conv"].dataType
    if not isinstance(conv, (T.StringType, T.IntegerType, T.LongType)):
        raise TypeError("conversations are named by integers or texts")
    ways = checkpointed(_ways(_segments(_narrow(rows), segment), segment))
    heads = ways.select("conv", "turn", "said_1", "said_2", F.lit(0).alias("kind"), (-F.col("segment")).alias("order"), "options", "blank", "duplicate",
                        "truncated")
    both = rows.withColumn("kind", F.lit(1)).unionByName(heads, allowMissingColumns=True).repartition("conv").sortWithinPartitions(
        "conv", "turn", "said_1", "said_2", "kind", "order")
    spark_schema = T.StructType([T.StructField("conv", conv), *T.StructType.fromDDL(fields).fields])
    schema = pa.schema([(f.name, _arrow_type(f.dataType)) for f in spark_schema])
    return both.mapInArrow(_play(summaries, schema), spark_schema)


_COLUMNS = ("conv_id", "turn", "role", "text")


def repaired_rows(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The rows of all conversations after the cheapest repair: `conv_id, place, role, text, edit`.

    `place` counts from 1; `edit` is K, R or I. See `repair` for rules and special cases.
    """
    rows = _played(df, (conv_id, turn, role, text), segment, "place bigint, role string, text string, edit string", False)
    return rows.withColumnRenamed("conv", conv_id)


def repair(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """A row per conversation with a row: `gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`.

    Rows are taken by turn, NULL first; rows of one turn by a hash of role and text, so that equal rows are neighbours. A row's
    first fault counts: its text is blank, its role and text were seen before, its text does not end in `.`, `!` or `?`. Keeping
    a row costs 0, giving it the role user or assistant 2, deleting it 3, which blank and duplicate rows must be,
    inserting an empty row 2, and a truncated row that stays 1. The roles that remain are nothing, or pairs of user
    and assistant after at most one system row, by their initials. Of the cheapest audits, the edits' initials in order, the least
    counts. `illegal` counts neighbours that are not su, ua or au; `gaps` counts missing turns between the first and
    the last. `repaired_sha256` is taken of the repaired rows as `role:text`, joined by line ends.

    NULL roles and texts are one space, and rows with a NULL conversation belong to one. Empty texts are blank. Repeated rows are
    duplicates. Very long texts are hashed row by row. Conversations of any length are handled; an empty table gives no
    rows. Other columns play no part, whatever their names.
    """
    fields = ("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
              "repaired_sha256 string")
    return _played(df, (conv_id, turn, role, text), segment, fields, True).withColumnRenamed("conv", conv_id)


def damage(df: DataFrame) -> DataFrame:
    """`conv_id, turn, role, text` with faults that a hash of conversation and turn chooses, one row in four.

    By the hash modulo 20 a row is dropped, emptied, loses its sentence ends, is repeated, or is said by the user. NULLs are one
    space, in the hash as in role and text.
    """
    def spoken(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", spoken("conv_id"), spoken("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spoken("text"), "[.!?]", "")).otherwise(spoken("text"))
    rows = df.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(spoken("role")).alias("role"), text.alias("text"),
                                      F.explode(F.array_repeat(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("__copy"))
    return rows.drop("__copy")

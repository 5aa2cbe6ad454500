"""Decontamination, Merkle manifests and conversation repair against brute force on small fixtures."""

import hashlib
import heapq
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recurva.llm import conversations, decontamination, merkle

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# decontamination

def plain_hits(docs, items, window):
    words = lambda text: WORD.findall(lowered(text or ""))
    windows = {}
    for item, text in items:
        said = words(text)
        size = min(window, len(said))
        for i in range(len(said) - size + 1 if said else 0):
            windows.setdefault(tuple(said[i:i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        said, hit, found = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(said) - size + 1):
                held = windows.get(tuple(said[i:i + size]))
                if held:
                    hit |= set(range(i, i + size))
                    found |= held
        out.append((doc, len(said), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=repr)


def decontaminated(spark, docs, items, window):
    frame = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, window int, items string, first int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated_spans(frame, bench, window=window)
    assert set(got.columns) == {*frame.columns, "n_words", "spans"}
    rows = got.select("doc_id", "n_words", decontamination.span_words(F.col("spans")).alias("n"), "items", "spans").collect()
    for r in rows:  # merged and in order
        assert all(a["last"] + 1 < b["first"] for a, b in zip(r["spans"], r["spans"][1:]))
    return sorted(((r["doc_id"], r["n_words"], r["n"], r["items"]) for r in rows), key=repr)


@pytest.mark.parametrize("window", [10, 4, 3, 1])
def test_decontamination(spark, window):
    rng = random.Random(window)
    prose = lambda n, letters="abcdefgh": [("".join(rng.choices(letters, k=3))) for _ in range(n)]
    items = [(i, " ".join(prose(rng.randint(4, 40)))) for i in range(12)]
    items += [(12, items[0][1]), (13, None), (14, ""), (15, "Solo"), (None, items[1][1]), (16, "two words"), (17, items[2][1].upper()), (18, "é à É ü ö ä")]
    docs = []
    for i in range(40):
        text = prose(rng.randint(0, 60))
        passage = (items[i % 12][1]).split()
        start = rng.randint(0, len(passage) - 1)
        text[rng.randint(0, len(text)):0] = passage[start:start + rng.randint(1, 30)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text)))
    docs += [(50, None), (51, ""), (52, items[0][1] + "!"), (52, items[0][1] + "!"), (None, items[3][1].upper()), (53, "SOLO, solo two-words"),
             (54, "a " * 500), (55, "é à É ü ö ä"), (56, " ".join(prose(20000)) + " " + items[4][1] + " " + items[4][1])]
    items.append((19, "a " * 30))
    assert decontaminated(spark, docs, items, window) == plain_hits(docs, items, window)


def test_decontamination_of_nothing(spark):
    docs = [(1, "some words"), (2, None)]
    assert decontaminated(spark, docs, [], 10) == [(1, 2, 0, []), (2, 0, 0, [])]
    assert decontaminated(spark, docs, [(1, None), (2, " ")], 10) == [(1, 2, 0, []), (2, 0, 0, [])]
    assert decontaminated(spark, [], [(1, "some words")], 10) == []


def test_shared_spans_share_a_kept_hash(spark):
    """The guarantee of winnowing: any window that two texts share has its smallest hash kept in both."""
    rng = random.Random(3)
    text = [rng.choice("abc") for _ in range(300)]
    frame = spark.createDataFrame([(" ".join(text), 1)], "text string, id int")
    for window in (10, 9, 2, 1):
        kept = decontamination.fingerprints(frame, decontamination.word_hashes(F.col("text")), [window], "id").collect()
        assert [r["first"] for r in kept if r["window"] == 0] == [300]
        kept = [r for r in kept if r["window"]]
        covered = sorted((r["first"], r["first"] + len(r["keys"]) - 1) for r in kept)
        assert [i for a, b in covered for i in range(a, b + 1)] == list(range(1, len(text) - window + 2))
        by_place = {i: r["hash"] for r in kept for i in range(r["first"], r["first"] + len(r["keys"]))}
        seen = {}
        for i in by_place:
            assert seen.setdefault(tuple(text[i - 1:i - 1 + window]), by_place[i]) == by_place[i]


# manifests

def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_manifest(rows, fan):
    leaves = {}
    for row in rows:
        leaves.setdefault(row[2], []).append((row[0], sha("".join(map(framed, row)))))

    def grow(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i:i + fan])) for i in range(0, len(levels[-1]), fan)])
        return levels

    def siblings(levels, rank):
        out = []
        for level in levels[:-1]:
            start = rank // fan * fan
            out.append(("".join(level[start:rank]), "".join(level[rank + 1:start + fan])))
            rank //= fan
        return out

    langs = sorted(leaves, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: grow([d for _, d in sorted(leaves[lang], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for lang in langs}
    top = grow([trees[lang][-1][0] for lang in langs])
    out = []
    for place, lang in enumerate(langs):
        for rank, leaf in enumerate(trees[lang][0]):
            out.append((lang, rank, leaf, trees[lang][-1][0], top[-1][0], siblings(trees[lang], rank) + siblings(top, place)))
    return sorted(out, key=repr)


def found_proofs(manifest, requests=None):
    rows = merkle.proofs(manifest, requests)
    return sorted(((r["tree"], r["rank"], r["digest"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("fan", [8, 2])
def test_manifest(spark, fan):
    rng = random.Random(fan)
    rows = [(i, f"s{i % 3}", rng.choice(["en", "de", "é", None]), i, f"text {i} é") for i in range(150)]
    rows += [(200, None, "lone", None, None), (None, None, "en", 0, ""), (None, "x", "en", 0, "y" * 100_000), (7, "s", "en", 1, "same"), (7, "s", "en", 1, "same"), (7, "s", "en", 1, "other")]
    rows += [(9, "s", "copies", 1, "same")] * 40
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "d", 2) for r in rows],
                                 "doc_id long, source string, lang string, n_chars long, text string, rank int, digest string, members int")
    manifest = merkle.build_manifest(docs, fan=fan, altered=merkle.leaf_digest(F.col("text")))
    want = plain_manifest(rows, fan)
    got = found_proofs(manifest)
    assert got == want
    asked = spark.createDataFrame([(None, 0), ("en", 3), ("lone", 0), ("en", 10_000), ("en", 3)], "tree string, rank long")
    assert found_proofs(manifest, asked) == [w for w in want if (w[0], w[1]) in {(None, 0), ("en", 3), ("lone", 0)}]
    checked = merkle.proofs(manifest).select(
        (merkle.fold(F.col("digest"), F.col("proof")) == F.col("root")).alias("own"),
        (merkle.fold(F.col("altered"), F.col("proof")) == F.col("root")).alias("altered"))
    assert {(r["own"], r["altered"]) for r in checked.collect()} == {(True, False)}
    stored = [r for level in manifest.groups.levels for r in level.collect()]
    assert all(sha("".join(r["children"])) == r["digest"] and len(r["children"]) <= fan for r in stored)


def test_small_manifests(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert found_proofs(merkle.build_manifest(spark.createDataFrame([], schema))) == []
    for rows in ([(1, "s", None, 1, "t")], [(1, "s", "a", 1, "t"), (2, "s", "b", 1, "t")], [(i, "s", "a", 1, "t") for i in range(9)]):
        assert found_proofs(merkle.build_manifest(spark.createDataFrame(rows, schema))) == plain_manifest(rows, 8)


# conversations

def faults(rows):
    """Fault of each row: b, d, t or nothing."""
    seen, out = set(), []
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\f\r")
        out.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Uniform-cost search over (row, role said last), audits in order of cost and then of their letters."""
    bad = faults(rows)
    queue = [(0, "", 0, "", ())]
    settled = set()
    while True:
        cost, audit, i, last, said = heapq.heappop(queue)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, said
        if (i, last) in settled:
            continue
        settled.add((i, last))
        name = "assistant" if last == "u" else "user"
        heapq.heappush(queue, (cost + 2, audit + "I", i, name[0], (*said, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, last, said))
            if bad[i] not in ("b", "d"):
                extra = int(bad[i] == "t")
                heapq.heappush(queue, (cost + 2 + extra, audit + "R", i + 1, name[0], (*said, f"{name}:{text}")))
                if role[:1] == name[0] or (role[:1] == "s" and last == ""):
                    heapq.heappush(queue, (cost + extra, audit + "K", i + 1, role[:1], (*said, f"{role}:{text}")))


def plain_summary(rows):
    turns = {t for t, _, _ in rows if t is not None}
    bad = faults(rows)
    cost, audit, said = plain_repair(rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, bad.count("b"), bad.count("d"), bad.count("t"), illegal, cost, audit, sha("\n".join(said))


def talk(rng, length):
    out = []
    for turn in range(length):
        role = rng.choice(["system", "user", "assistant", "tool", "unknown"]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
        text = rng.choice(["Yes.", "No!", "", " \n", "cut off", "Why? \t"]) if rng.random() < 0.5 else f"Text {rng.random()}."
        out.append((turn * rng.choice([1, 1, 2]) if rng.random() < 0.95 else None, role, text))
    return out


def in_order(spark, rows):
    """Rows by turn, NULL first, and equal turns in the operator's order, which hashes role and text."""
    frame = spark.createDataFrame(rows, "turn long, role string, text string").orderBy(
        "turn", F.xxhash64(F.lit(1), "role", "text"), F.xxhash64(F.lit(2), "role", "text"))
    return [tuple(r) for r in frame.collect()]


def test_repair(spark):
    rng = random.Random(5)
    talks = {i: talk(rng, rng.randint(1, 9)) for i in range(60)}
    talks[100] = talk(rng, 150)
    talks[101] = [(1, "user", "Same.")] * 70
    talks[102] = [(None, "user", "a."), (None, "user", "b")]
    talks[103] = [(5, "", "no role."), (-5, "system", "x" * 200_000)]
    talks[None] = [(0, "user", "Hello."), (1, "assistant", "Hello.")]
    rows = [(i, *row, 1, "z") for i, said in talks.items() for row in said]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv int, kind string").repartition(5)
    for segment in (16, 3):
        found = conversations.repair(frame, segment=segment)
        got = {r["conv_id"]: tuple(r)[1:] for r in found.collect()}
        assert got.keys() == talks.keys()
        for i, said in talks.items():
            assert got[i] == plain_summary(in_order(spark, said)), i
    told = {}
    for r in conversations.repaired_rows(frame, segment=4).collect():
        told.setdefault(r["conv_id"], []).append((r["place"], f"{r['role']}:{r['text']}", r["edit"]))
    for i in talks:
        lines = sorted(told.get(i, []))
        assert [n for n, _, _ in lines] == list(range(1, len(lines) + 1))
        assert sha("\n".join(x for _, x, _ in lines)) == got[i][-1]
        assert "".join(e for _, _, e in lines) == got[i][-2].replace("D", "")
    assert conversations.repair(frame.limit(0)).count() == 0


def test_repair_of_nulls(spark):
    frame = spark.createDataFrame([("a", 1, None, None), ("a", 2, None, "Said."), ("a", None, "user", "Hi.")], "conv_id string, turn int, role string, text string")
    assert [tuple(r)[1:] for r in conversations.repair(frame).collect()] == [plain_summary([(None, "user", "Hi."), (1, " ", " "), (2, " ", "Said.")])]


def test_signatures_are_solved_once(spark):
    """Every suffix is one node, and signatures in any number of partitions give the same options."""
    made = []

    def counted(letter, node):
        made.append(letter)
        return before(letter, node)

    before = conversations._before
    words = sorted(["au", "auauau", "auauus", "x", "xauAUx"])
    batch = pa.RecordBatch.from_pydict({"inner": [False] * len(words), "reversed": words})
    conversations._before = counted
    try:
        options = pa.Table.from_batches(conversations._solve(iter([batch])))["options"].to_pylist()
    finally:
        conversations._before = before
    assert len(made) == len({w[:n] for w in words for n in range(1, len(w) + 1)})
    frame = spark.createDataFrame([(False, w) for w in words * 3], "inner boolean, reversed string")
    got = {r["reversed"]: [o.asDict() for o in r["options"]] for r in conversations.solve_signatures(frame.repartition(4)).collect()}
    assert got == dict(zip(words, options))


def test_damage(spark):
    rows = [(i, t, "assistant", "One. Two!") for i in range(40) for t in range(3)] + [(None, None, None, None), (1, None, "user", None)]
    want = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        if kind:
            new = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            want += [new] * (2 if kind == 3 else 1)
    got = [tuple(r) for r in conversations.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) != len(rows)

"""Operators on texts against brute force on small fixtures, with NULLs, empty and long texts, ties and repeated rows."""

import collections
import math
import random
import re
import zlib

import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from recurva.llm import bpe, licenses, line_dedup, mixing, quality, simhash, toxicity
from recurva.llm.sampling import crc_part

BLANKS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def prose(seed, words=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(words))


def components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# SimHash

def plain_fingerprint(text):
    words = WORD.findall(lowered(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark):
    base = prose(1, 300)
    texts = [base, base, base.replace("a", "a", 1) + " tail", base.upper(), base + " end of it", prose(2), prose(3, 2), None, "", " \n", "É é", "one", "ONE", prose(4, 9000)]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(5, prose(2), "x", "y"), (None, base, "x", "y"), (None, prose(9), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, cluster_id string")
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(docs).collect() if r["doc_id"] is not None)
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    roots = components(prints, near)
    want = [(i, f"{prints[i]:016x}", roots[i]) for i in prints]
    assert got == sorted([*want, want[5]])
    unnamed = {r["fingerprint"]: r["component_id"] for r in simhash.simhash_groups(docs).where("doc_id IS NULL").collect()}
    assert unnamed == {want[0][1]: 0, f"{plain_fingerprint(prose(9)):016x}": None}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted([*set(roots.values()), 5])
    assert [r["text"] for r in kept.where("doc_id IS NULL").collect()] == [prose(9)]
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowded", [4096, 2])
def test_near_fingerprints(spark, crowded):
    rng = random.Random(7)
    values = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(6):
            value = centre
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                value ^= 1 << bit
            values.add(value)
    dense = rng.getrandbits(32) << 32  # many that share a half
    values |= {dense | rng.getrandbits(6) for _ in range(40)} | {0, 1, 7, 15}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    pairs = simhash.near_pairs(spark.createDataFrame(signed, "fp long"), 3, crowded).collect()
    found = {frozenset((r["a"] % (1 << 64), r["b"] % (1 << 64))) for r in pairs}
    assert found == {frozenset((a, b)) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3}


# lines

def plain_lines(rows):
    key = lambda line: lowered(line.strip(BLANKS))
    holders = collections.defaultdict(list)
    for n, (doc, text) in enumerate(rows):
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= 20:
                holders[k].append(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        least = lambda d: (d is not None, d or 0)
        gone = [len(holders[key(x)]) >= 3 and least(doc) != max(map(least, holders[key(x)])) for x in lines]
        out.append((doc, "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    shared, twice, umlaut = "This line is in Many documents", "a line found in two documents only", "ÄRGERLICHE ZEILE in drei Texten"
    rows = [(1, f"{shared}\nown line of one\n\n"), (2, f"  {shared.upper()}\t\n{twice}\n{shared}"), (3, f"x\n{twice}\n{shared}\nshort"), (4, None), (5, ""),
            (6, "short\n" * 50 + umlaut), (7, "short\n" + umlaut), (8, umlaut.lower() + "\n" + umlaut), (9, "\n".join([shared] * 300)), (9, "\n".join([shared] * 300)),
            (None, f"{shared}\nrest"), (None, "all ids are null here, line"), (None, "all ids are null here, line"), (None, "all ids are null here, line\n!")]
    docs = spark.createDataFrame([(*r, "kept", 5, 6) for r in rows], "doc_id long, text string, extra string, n_lines int, pos int")
    got = line_dedup.dedup_lines(docs)
    assert set(got.columns) == {*docs.columns, "n_dropped"}
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=repr) == plain_lines(rows)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_repeated_rows_are_one_document(spark):
    line = "a line that two documents hold"
    docs = spark.createDataFrame([(1, line), (1, line), (2, line), (None, line)], "doc_id long, text string")
    assert {(r["text"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs).collect()} == {(line, 0)}


# licences

def test_licenses(spark):
    rows = [(1, "Some prose here.\nReleased under the MIT License.\nmore prose"), (2, "licensed under the apache license, version 2.0"), (3, None), (4, ""),
            (5, "The license to fish in the lake is sold under the bridge."), (6, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-SA 4.0."),
            (7, "This work is licensed under the GNU General Public License, version 3."), (7, "This work is licensed under the GNU General Public License, version 3."),
            (None, "All rights reserved."), (8, "word " * 30_000 + "\nAll rights reserved.")]
    background = [(100 + i, "\n".join(prose(i * 20 + j, 12) + " the work of this license" for j in range(5))) for i in range(60)]
    docs = spark.createDataFrame([(*r, "x") for r in rows + background], "doc_id long, text string, pos string")
    model = licenses.train(docs)
    assert 0.5 <= model.needed < 1 and model.classes[0] == licenses.UNKNOWN
    got = sorted(((r["doc_id"], r["families"]) for r in licenses.document_licenses(docs, model).collect() if r["families"]), key=repr)
    assert got == sorted([(1, ["MIT"]), (2, ["Apache"]), (6, ["CC-BY-NC", "CC-BY-SA"]), (7, ["GPL"]), (7, ["GPL"]), (8, ["Proprietary"]), (None, ["Proprietary"])], key=repr)
    assert licenses.document_licenses(docs, model).count() == docs.count()
    assert licenses.document_licenses(docs.limit(0), licenses.train(docs.limit(0))).count() == 0


def test_license_threshold_covers_the_corpus(spark):
    rows = [(i, "\n".join(f"{prose(i * 40 + j, 10)} {'under the license' if j % 4 else 'you may not'} {prose(j, 4)}" for j in range(20))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = licenses.train(docs, background=40)
    again = licenses.train(docs.orderBy(F.desc("doc_id")).repartition(7).unionByName(docs), background=40)
    assert model.needed == again.needed
    assert all(again.weights[pair] == pytest.approx(w, abs=1e-6) for pair, w in model.weights.items())
    lines = licenses._background(docs, "text", sorted(model.weights))
    assert lines.count() == len({line for _, text in rows for line in text.split("\n")})
    assert licenses._threshold({9000: 1, 7000: 2, 100: 1997}, 2000) == 0.7001  # the largest two of 2,000 may pass
    assert licenses._threshold({9999: 5}, 10) == 0.99 and licenses._threshold({}, 0) == licenses.LEAST


def test_licenses_within_long_lines(spark):
    notices = {"MIT": "Released under the MIT License.", "CC0": "Released under CC0 1.0.", "Proprietary": "All rights reserved.",
               "Apache": "Licensed under the Apache License, Version 2.0.", "GPL": licenses.TEMPLATES["GPL"][2]}
    rows, want = [], {}
    for family, notice in notices.items():
        for size in (50, 500, 20_000):
            for cut in (size // 2, size):
                words = prose(len(rows), size).split()
                want[len(rows)] = [family]
                rows.append((len(rows), " ".join([*words[:cut], notice, *words[cut:]])))
    want[len(rows)] = ["Apache", "MIT"]
    rows.append((len(rows), f"{prose(70, 200)} {notices['MIT']} {prose(71, 200)} {notices['Apache']} {prose(72, 200)}"))
    rows += [(500 + i, prose(500 + i, 300) + " the work of this license is under the sea " + prose(i, 300)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.document_licenses(docs, licenses.train(docs)).collect()
    assert {r["doc_id"]: r["families"] for r in got if r["families"]} == want
    assert {r["n_licensed"] for r in got if r["families"]} == {1}  # one line each, also where two windows hold the notice
    assert max(len(pairs) for _, _, pairs in licenses._template_rows()) <= licenses.WINDOW - licenses.STRIDE <= licenses.WINDOW / 2


def plain_licenses(model, text):
    """Families of a text by the rules, one window after the other."""
    found, own = set(), licenses.own_pairs()
    for line in (text or "").lower().replace("licence", "license").split("\n"):
        words = re.findall(licenses._WORD, line)
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
        last = max(0, -(-(len(pairs) - licenses.WINDOW) // licenses.STRIDE))
        for w in range(last + 1):
            part = pairs[w * licenses.STRIDE:w * licenses.STRIDE + licenses.WINDOW]
            hits = {p for p in part if p in model.weights}
            logits = [b + sum(model.weights[p][i] for p in hits) / min(licenses.DILUTED, len(part)) ** 0.5 if part else b for i, b in enumerate(model.intercepts)]
            for i, family in enumerate(model.classes[1:], 1):
                likely = hits and 1 / (1 + math.exp(logits[0] - logits[i])) >= model.needed
                alike = [len(hits & set(t)) / min(len(part), len(set(t))) for f, _, t in licenses._template_rows() if f == family] if likely else []
                if likely and hits & set(own[family]) and max(alike) >= licenses.CONFIRMED:
                    found.add(family)
    return sorted(found)


def test_notices_in_other_words(spark):
    """Several licences in a line, identifiers, short names and spellings, against a plain reading of the rules."""
    want = {
        "Released under the MIT License. Licensed under the Apache License, Version 2.0.": ["Apache", "MIT"],
        "Licensed under the Apache License, Version 2.0 or the MIT License, at your option.": ["Apache", "MIT"],
        "This work is licensed under the GNU General Public License, version 3. All rights reserved.": ["GPL", "Proprietary"],
        "// SPDX-License-Identifier: Apache-2.0": ["Apache"], "SPDX-License-Identifier: MIT OR Apache-2.0": ["Apache", "MIT"], "SPDX-License-Identifier: Zlib": [],
        "The code is available under the terms of the MIT licence.": ["MIT"], "It is licensed under GPLv3.": ["GPL"], "Released under the terms of CC BY-SA.": ["CC-BY-SA"],
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided": ["ISC"],
        "This is free and unencumbered software released into the public domain.": ["Unlicense"],
        "made available under the terms of the Eclipse Public License 2.0": ["EPL"], "Licensed under the Mozilla Public License, version 2.0.": ["MPL"],
        "Licensed under the GNU Lesser General Public License, version 2.1.": ["LGPL"], "The terms of the sale are under the public law.": [],
    }
    rows = list(enumerate(want)) + [(100 + i, "\n".join(prose(i * 20 + j, 12) + " the work of this license under the terms" for j in range(5))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = licenses.train(docs)
    got = {r["doc_id"]: r["families"] for r in licenses.document_licenses(docs, model).collect()}
    assert got == {i: plain_licenses(model, text) for i, text in rows}
    assert {text: got[i] for i, text in enumerate(want)} == want


# mixing

def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in sizes if s not in capped]
        targets = {s: 3.0 * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if targets[s] > 3 * sizes[s]}
        if not over:
            return targets
        capped |= over


def test_source_mixing(spark):
    rng = random.Random(3)
    rows = [(i, prose(i, rng.randint(0, 150)), rng.choice(["a", "b", "c", "Z", None])) for i in range(300)]
    rows += [(900, prose(1, 12_000), "b"), (901, None, "a"), (902, " \n", "c"), (903, "tiny source", "d"), (903, "tiny source", "d"), (None, prose(5, 90), "a"), (904, None, "nothing")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, block string, size int")
    found = mixing.taken_words(mixing.mix(docs, block_words=16)).collect()
    count = lambda text: len(WORD.findall(text or ""))
    assert sorted((r["doc_id"] or -1, r["size"], r["source"] or "") for r in found) == sorted((d or -1, count(t), s or "") for d, t, s in rows)
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += count(text)
    targets, taken = plain_targets(sizes), collections.Counter()
    for r in found:
        assert r["target"] == pytest.approx(targets[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 16 + 0.01 * targets[s] for s in targets)
    key = lambda r: (r["doc_id"] or -1, r["size"], r["taken"], r["first_shard"] or -1)
    again = mixing.taken_words(mixing.mix(docs.repartition(7), block_words=16)).collect()
    assert sorted(map(key, again)) == sorted(map(key, found))
    assert mixing.taken_words(mixing.mix(docs.limit(0))).count() == 0


def test_mixed_texts_and_slots(spark):
    rows = [(i, f"w{i} " + prose(i, 40) + " \n" + prose(i + 500, 20), "ab"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix(docs, block_words=8, shard_slots=10)
    took = {r["doc_id"]: r["taken"] for r in mixing.taken_words(plan).collect()}
    mixed = {r["doc_id"]: r["text"] for r in mixing.mixed_documents(docs, block_words=8, shard_slots=10).collect()}
    texts = {i: t for i, t, _ in rows}
    for i, n in took.items():
        words = WORD.findall(mixed.get(i, ""))
        assert len(words) == n and not collections.Counter(words) - collections.Counter(WORD.findall(texts[i]) * 3)
    slots = plan.slots.toPandas()
    assert sorted(slots["place"]) == list(range(len(slots))) and (slots["shard"] == slots["place"] // 10).all()
    for _, part in slots.groupby("__src"):
        uses = part["block"].value_counts()
        assert uses.max() - uses.min() <= 1  # every block before any again
    counts = slots.groupby(["shard", "__src"]).size().unstack(fill_value=0)
    assert counts.std().max() > 0  # drawn, not dealt in turn


def chained_hash(*values):
    """Spark's xxhash64 of integers (int, long) and texts."""
    seed = 42
    for value, size in values:
        seed = xxhash.xxh64_intdigest(value.encode() if size is None else value.to_bytes(size, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


@pytest.mark.parametrize("quotas, shard_slots", [({"a": 700, "b": 290, "c": 10}, 64), ({f"s{i:03d}": 1 + i % 3 for i in range(300)}, 7), ({"only": 5}, 4096), ({}, 8)])
def test_multinomial_slots(spark, quotas, shard_slots, monkeypatch):
    monkeypatch.setattr(mixing, "SPAN", 5)  # several spans of shards
    rows = spark.createDataFrame([(s, 16 * n, 16.0 * n) for s, n in quotas.items()] + [("=none", 0, 0.0)], "__src string, source_size long, target double")
    slots = mixing._slots(rows, 16, shard_slots, 42).toPandas()
    total = sum(quotas.values())
    assert sorted(slots["place"]) == list(range(total)) and (slots["shard"] == slots["place"] // shard_slots).all()
    assert slots["__src"].value_counts().to_dict() == quotas
    assert all(sorted(part["block"]) == list(range(quotas[s])) for s, part in slots.groupby("__src"))

    owner = [s for s in sorted(quotas) for _ in range(quotas[s])]
    drawn = [owner[chained_hash((42, 4), ("draw", None), (p, 8)) % total] for p in range(total)]
    got, counts, free = collections.Counter(zip(slots["shard"], slots["__src"])), collections.Counter(), 0
    want = collections.Counter()
    for place, s in enumerate(drawn):  # draws stand until a source has its quota
        if counts[s] < quotas[s]:
            want[place // shard_slots, s] += 1
            counts[s] += 1
        else:
            free += 1
    assert not want - got and sum((got - want).values()) == free
    assert all((got - want)[k] == 0 or sum(d == k[1] for d in drawn) < quotas[k[1]] for k in got)


def test_few_and_many_sources_are_drawn_alike(spark, monkeypatch):
    rows = spark.createDataFrame([(f"s{i}", 160 * i, 320.0 * i) for i in range(40)], "__src string, source_size long, target double")
    want = sorted(mixing._slots(rows, 16, 32, 7).collect())
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    assert sorted(mixing._slots(rows, 16, 32, 7).collect()) == want


# byte-level BPE

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_bpe(spark):
    texts = [None, "", " ", "plain words, and 12 numbers", "tabs\t\tand\n\n lines  ", "ñandú 東京 🙂", "a" * 40_000, "<|endoftext|>", prose(1, 20_000), "x y\x85z\x1c w" * 3000]
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(3, texts[3], 0)], "doc_id long, text string, ids int")
    both = bpe.decode(bpe.encode(rows, RANKS, PATTERN), RANKS, PATTERN).collect()
    encoding = bpe.load_encoding(RANKS, PATTERN)
    assert len(both) == len(texts) + 1
    for r in both:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == encoding.encode_ordinary(text) and bytes(r["decoded"]) == text.encode() and r["text"] == texts[r["doc_id"]]
    assert bpe.encode(rows.limit(0), RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("limit", [1, 7, 50])
def test_cuts_do_not_change_ids(limit):
    text = "".join(random.Random(limit).choices("ab 1.,\n\t'süß  ", k=3000))
    assert "".join(bpe.cut(text, limit)) == text
    assert bpe.encode_text(text, RANKS, PATTERN, limit) == bpe.load_encoding(RANKS, PATTERN).encode_ordinary(text)


def test_long_run_of_signs():
    ids = bpe.encode_text("^" * 300_000 + " end", RANKS, PATTERN)  # tiktoken's own splitter fails on it
    assert bpe.load_encoding(RANKS, PATTERN).decode_bytes(ids) == b"^" * 300_000 + b" end"
    assert isinstance(bpe.load_encoding(RANKS, PATTERN), tiktoken.Encoding)


# quality and toxicity

def held(doc, parts, rest):
    return zlib.crc32(str(doc).encode()) % parts == rest


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(5)
    junk = [lambda t: " ".join(w + "***" for w in t.split()), lambda t: t.upper().replace(" ", "!! "), lambda t: " ".join(w + f" {w}" * 6 for w in t.split())]
    rows, labels = [], []
    for i in range(400):
        text, quality_, toxic = prose(i, rng.randint(20, 90)).capitalize() + ".", 1, 0
        if i % 5 == 0:
            text, quality_ = junk[i % 3](text), 0
        elif i % 5 == 1:
            words = text.split()
            for word in rng.sample(["zugzug", "grimbel", "vorkox"], 2):
                words.insert(rng.randrange(len(words)), word)
            text, toxic = " ".join(words), 1
        rows.append((i, text, "en", "s", i))
        labels.append((i, quality_, toxic))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, prose(7), "en", "s", 1), (3, rows[3][1], "en", "s", 3), (1002, prose(8, 20_000), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long")
    return docs, spark.createDataFrame(labels + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int"), labels


def test_quality(spark, judged):
    docs, labels, truth = judged
    rules = quality.learn_rules(docs, labels, crc_part(F.col("doc_id"), 3) != 1)
    got = quality.score_quality(docs, rules)
    assert set(got.columns) == set(docs.columns) and got.count() == docs.count()
    scores = {r["doc_id"]: r["score"] for r in got.collect()}
    assert all(0 <= s <= 1 for s in scores.values())
    out = [(i, q) for i, q, _ in truth if held(i, 3, 1)]
    assert sum((scores[i] >= 0.5) == (q == 1) for i, q in out) >= 0.97 * len(out) and scores[1002] >= 0.5
    assert len(rules.weighted) <= 60


def test_quality_without_labels(spark, judged):
    docs, labels, _ = judged
    none = quality.learn_rules(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    one = quality.learn_rules(docs, labels.where("quality = 1"), F.lit(True))
    assert all(r["score"] > 0.9 for r in quality.score_quality(docs, one).collect())
    assert quality.score_quality(docs.limit(0), one).count() == 0


def test_toxicity(spark, judged):
    docs, labels, truth = judged
    model = toxicity.learn_toxicity(docs, labels, crc_part(F.col("doc_id"), 4) != 2)
    hidden = [(5000, prose(900) + " zu9zug gr1mbel " + prose(901)), (5001, prose(902) + " z u g z u g grimmmmbel " + prose(903)), (5002, "V0RKOX, z*gzug " + prose(904)), (5003, prose(905))]
    more = spark.createDataFrame([(*r, "en", "s", 0) for r in hidden], docs.schema)
    got = toxicity.score_toxicity(docs.unionByName(more), model)
    assert set(got.columns) == set(docs.columns) and got.count() == docs.count() + 4
    scores = {r["doc_id"]: r["score"] for r in got.collect()}
    out = [(i, t) for i, _, t in truth if held(i, 4, 2)]
    assert sum((scores[i] >= 0.3) == (t == 1) for i, t in out) >= 0.95 * len(out)
    assert min(scores[5000], scores[5001], scores[5002]) >= 0.3 > max(scores[5003], scores[1000], scores[1001], scores[1002])
    empty = toxicity.learn_toxicity(docs.limit(0), labels, F.lit(True))
    assert {r["score"] for r in toxicity.score_toxicity(docs, empty).collect()} == {0.5}


def plainly_decoded(channel, word, dropped):
    """The likeliest reading among all of them, one by one."""
    readings = []

    def go(i, path, cost):
        if i == len(word):
            a, b = (path[j] if len(path) + j >= 0 else " " for j in (-2, -1))
            readings.append((cost + channel.cost[(toxicity._code(a) if a != " " else 0), (toxicity._code(b) if b != " " else 0), 0], path))
            return
        a, b = (path[j] if len(path) + j >= 0 else " " for j in (-2, -1))
        row = channel.cost[(toxicity._code(a) if a != " " else 0), (toxicity._code(b) if b != " " else 0)]
        for letter, price in channel._choices(word[i]):
            go(i + 1, path + letter, cost + price + row[toxicity._code(letter)])
        if i and word[i] == word[i - 1] and path:
            go(i + 1, path, cost + dropped)

    go(0, "", 0.0)
    return min(readings)


def test_decoding_finds_the_best_of_all_readings():
    counts = toxicity.np.zeros(28 ** 3, toxicity.np.int64)
    for word in ("monster", "bassoon", "illegal", "total", "zebra"):
        counts += 30 * toxicity.np.bincount(toxicity._trigrams(word), minlength=28 ** 3)
    channel, rng = toxicity.Channel(counts), random.Random(4)
    for _ in range(60):
        word = "".join(rng.choice("mons1l0a@$$tt!e") for _ in range(rng.randint(1, 7)))
        for dropped in (0.5, math.inf):
            assert channel.decode(word, dropped) == plainly_decoded(channel, word, dropped)[1], word


def test_words_in_pieces():
    """Letters set apart at any length from three on, and words in pieces of up to three letters."""
    counts = toxicity.np.zeros(28 ** 3, toxicity.np.int64)
    for word in ("monster", "internationalization", "bad", "the", "of", "in"):
        counts += 50 * toxicity.np.bincount(toxicity._trigrams(word), minlength=28 ** 3)
    channel = toxicity.Channel(counts)
    for written, meant in [("b a d", "bad"), ("so b.a.d it", "bad"), (" ".join("internationalization"), "internationalization"), ("a mo ns ter", "monster"),
                           ("mon st er!", "monster"), ("the m on st er of", "monster")]:
        assert meant in channel.collect(written, lambda words: words), written
    assert not {"inthe", "ofthe", "ofin"} & channel.collect("in the of in of the", lambda words: words)


def test_trigrams_cover_all_texts(spark, judged):
    docs = judged[0]
    counts = collections.Counter()
    for r in docs.collect():
        if r["text"]:
            counts.update(toxicity._trigrams(r["text"]).tolist())
    found = toxicity.count_trigrams(docs)
    assert {i: int(n) for i, n in enumerate(found) if n} == dict(counts)


def test_decoding():
    counts = toxicity.np.zeros(28 ** 3, toxicity.np.int64)
    for word in ("monster", "master", "letter", "little", "session"):
        counts += 50 * toxicity.np.bincount(toxicity._trigrams(word), minlength=28 ** 3)
    channel = toxicity.Channel(counts)
    for written, meant in [("m0nster", "monster"), ("mmmmaster", "master"), ("l3tter", "letter"), ("l!ttle", "little"), ("$e$$ion", "session"), ("m-a-s-t-e-r", "master"),
                           ("m a s t e r", "master"), ("we mo n s t 3 r", "monster"[3:])]:
        assert meant in channel.collect(written, lambda words: words), written
    assert channel.collect("12345 6789 !!! ***", lambda words: words) == set()


def test_decoding_of_long_tokens():
    counts = toxicity.np.zeros(28 ** 3, toxicity.np.int64)
    for word in ("monster", "master", "letter", "little", "session"):
        counts += 50 * toxicity.np.bincount(toxicity._trigrams(word), minlength=28 ** 3)
    channel = toxicity.Channel(counts)
    joined = "session,little/letter;session,little/letter"
    for written, meant in [("m" + "a" * 40 + "ster", "master"), ("m0n" + "s" * 500 + "ter", "monster"), (f"{joined},m0nster/{joined}", "monster"),
                           (f"{joined}-l3tter-{joined}", "letter"), (f"{joined}_mmmmaster:{joined}", "master"), (f"{joined},m-0-n-s-t-e-r,{joined}", "monster"),
                           ("-".join("sessionlittleletter" * 4 + "m0nster"), "monster"), ("letter" * 9 + "m0nster" + "little" * 9, "monster"),
                           (" ".join("m" + "a" * 60 + "ster"), "master"), ("1" * 100 + ",m0nster", "monster")]:
        assert meant in channel.collect(written, lambda words: words), written
    assert channel.collect("session" * 9, lambda words: words) == {"session" * 9}

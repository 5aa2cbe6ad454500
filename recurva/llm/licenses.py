"""License scans by a trained paragraph classifier.

Native throughout: training is MLlib on a bounded set, calibration and scoring are joins and aggregates. Features are the word pairs
that occur in the templates below, a fixed vocabulary of a few hundred; a feature's value is one over the root of the
paragraph's number of pairs, of which a few count. The classes are the families and `unknown`, whose examples are paragraphs of the corpus and
weigh as much as all families together. A multinomial logistic regression with an elastic net gives the weights. Each family is
judged by itself, by its probability against `unknown`, so that a paragraph can name several licences. The probability a family needs is
calibrated on all corpus paragraphs kept out of the fit, and a prediction counts only if the paragraph also resembles a template of
its family and holds a word pair that no other family has.

To score, pairs are exploded as hashes and joined with the vocabulary, which every task gets; only hits are shuffled.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Interaction
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recurva.llm.text import content_key
from recurva.session import checkpointed

# Notices by which licences are named or begun, with the common short names and identifiers.
TEMPLATES = {
    "AGPL": ("Licensed under the GNU Affero General Public License, version 3.", "Licensed under AGPLv3.", "SPDX-License-Identifier: AGPL-3.0",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    "Apache": ("Licensed under the Apache License, Version 2.0.", "Released under the terms of the Apache License.", "SPDX-License-Identifier: Apache-2.0",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS"),
    "BSD": ("Distributed under the BSD 3-Clause License.", "Released under the BSD license.", "Available under the terms of the BSD license.",
            "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "Released under the terms of CC BY-NC.", "SPDX-License-Identifier: CC-BY-NC-4.0",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "Released under the terms of CC BY-SA.", "SPDX-License-Identifier: CC-BY-SA-4.0",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0": ("Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0",
            "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "EPL": ("Made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0",
            "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    "GPL": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.",
            "Licensed under GPLv2.", "Licensed under GPLv3.", "SPDX-License-Identifier: GPL-2.0", "SPDX-License-Identifier: GPL-3.0",
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    "ISC": ("Released under the ISC License.", "SPDX-License-Identifier: ISC",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under LGPLv3.", "SPDX-License-Identifier: LGPL-2.1",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Available under the terms of the MIT License.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "MPL": ("Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0",
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "Proprietary": ("All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
    "Unlicense": ("Released under the Unlicense.", "SPDX-License-Identifier: Unlicense",
                  "This is free and unencumbered software released into the public domain."),
}
UNKNOWN = "unknown"
_WORD = r"[a-z]+|[0-9]+(?:\.[0-9]+)?"

#: Twice the corpus paragraphs the fit uses as unknown, at most; all others calibrate.
BACKGROUND = 6000
#: Word pairs of a window of a long line, and the pairs from one window to the next. What has WINDOW - STRIDE pairs lies whole in
#: a window; the longest template has fewer.
WINDOW, STRIDE = 64, 32
#: Pairs beyond which a paragraph no longer weakens its hits, so that a notice of two pairs counts within other words.
DILUTED = 16
#: Steps of probability in which the calibration counts.
STEPS = 10_000
#: Share of unknown paragraphs that may reach the calibrated probability, and its least value.
FALSE_SHARE, LEAST = 0.001, 0.5
#: Resemblance to a template that confirms a prediction.
CONFIRMED = 0.6


def _scale(n: Column | str) -> Column:
    """Value of a hit in a paragraph of `n` pairs."""
    return 1 / F.sqrt(F.least(F.lit(DILUTED), n))


def _template_rows() -> list[tuple[str, str, list[str]]]:
    """Family, template and its word pairs."""
    rows = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = re.findall(_WORD, text.lower())
            rows.append((family, text, [f"{a} {b}" for a, b in zip(words, words[1:])]))
    return rows


def _windows(pairs: list[str]) -> list[list[str]]:
    """The pairs and contiguous parts of them, as paragraphs may quote a notice in part."""
    n = len(pairs)
    spans = {(a, a + size) for size in (n, math.ceil(3 * n / 4), math.ceil(n / 2)) for a in range(0, n - size + 1, max(1, n // 4))}
    return [pairs[a:b] for a, b in sorted(spans) if b - a >= 2]


def _surrounded(pairs: list[str]) -> list[tuple[list[str], int]]:
    """Parts of a notice, each with the number of pairs of a paragraph that holds it: of its own and, if it suffices to
    confirm, of longer ones, in which other words stand around it."""
    found = []
    for part in _windows(pairs):
        longer = {DILUTED // 2, DILUTED} if len(part) >= CONFIRMED * len(pairs) else set()
        found += [(part, n) for n in sorted({len(part)} | {n for n in longer if n > len(part)})]
    return found


def _last_window(n: Column) -> Column:
    """Number of the last window of a line of `n` pairs, from 0; lines of up to WINDOW pairs are one."""
    return F.greatest(F.lit(0), F.ceil((n - WINDOW) / STRIDE)).cast("int")


def _paragraphs(text: Column) -> Column:
    """Word pairs of each line of a text."""
    spelled = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("licence"), F.lit("license"))
    lines = F.split(spelled, "\n", -1)

    def pairs(line: Column) -> Column:
        words = F.regexp_extract_all(line, F.lit(_WORD), F.lit(0))
        return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.transform(lines, lambda line: F.filter(pairs(line), lambda pair: F.contains(pair, F.lit(" "))))


@dataclass(frozen=True)
class Classifier:
    """Families in the order of the weights, weights by word pair, intercepts, and the probability a family needs."""

    classes: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    intercepts: tuple[float, ...]
    needed: float


def _probabilities(classes: int) -> Column:
    """Probability of each family against `unknown`, from the columns `l0`, `l1`, …"""
    return F.array(*(1 / (1 + F.exp(F.least(F.col("l0") - F.col(f"l{i}"), F.lit(700.0)))) for i in range(1, classes)))


def _background(df: DataFrame, text: str, vocabulary: list[str]) -> DataFrame:
    """The different paragraphs of all texts, long lines by windows, that resemble no template: a hash `row`, `n` pairs, and those of the vocabulary as `held`."""
    lines = df.select(F.explode(_paragraphs(F.col(text))).alias("line")).where(F.size("line") > 1)
    windows = F.transform(F.sequence(F.lit(0), _last_window(F.size("line"))), lambda w: F.slice("line", w * STRIDE + 1, F.lit(WINDOW)))
    lines = lines.select(F.explode(windows).alias("pairs"))
    held = F.filter("pairs", lambda pair: pair.isin(vocabulary))
    rows = lines.select(F.xxhash64("pairs").alias("row"), F.size("pairs").alias("n"), F.array_sort(F.array_distinct(held)).alias("held"))
    whole = F.array(*(F.array(*map(F.lit, pairs)) for _, _, pairs in _template_rows()))
    like = F.exists(whole, lambda known: F.size(F.array_intersect(known, F.col("held"))) >= 0.5 * F.least(F.size(known), "n"))
    return rows.groupBy("row").agg(F.first("n").alias("n"), F.first("held").alias("held")).where((F.size("held") == 0) | ~like)


def _threshold(counts: dict[int, int], total: int) -> float:
    """The least step of probability that at most `FALSE_SHARE` of `total` paragraphs reach, given how many lie in each step."""
    above = 0
    for step in sorted(counts, reverse=True):
        above += counts[step]
        if above > FALSE_SHARE * total:
            return min(0.99, max(LEAST, (step + 1) / STEPS))
    return LEAST


def train(df: DataFrame, doc_id: str = "doc_id", text: str = "text", background: int = BACKGROUND) -> Classifier:
    """A classifier from the templates and from at most half of `background` different paragraphs, the first in the order of a hash.

    The needed probability is calibrated on all other paragraphs of the corpus, each counted once, also those without any
    known pair. Rows, their order and partitions do not matter. With an empty table there are no unknown examples but an
    empty paragraph.
    """
    spark, templates = df.sparkSession, _template_rows()
    vocabulary = sorted({pair for _, _, pairs in templates for pair in pairs})
    classes = (UNKNOWN, *sorted(TEMPLATES))
    lines = checkpointed(_background(df, text, vocabulary))
    total, most = lines.count(), background // 2
    # half of the paragraphs at most, so that some are left; the share only spares the sort what it would drop
    order = F.xxhash64(F.lit(1), "row")
    share = max(1, int(min(0.5, 2 * most / max(total, 1)) * 1_000_000))
    fitted = checkpointed(lines.where(F.pmod(order, F.lit(1_000_000)) < share).orderBy(order, "row").limit(most))

    quoted = [[(float(classes.index(family)), part, n) for part, n in _surrounded(pairs)] for family, _, pairs in templates]
    unknown = fitted.select(F.lit(0.0).alias("label"), F.col("held").alias("pairs"), "n", F.lit(1.0).alias("weight"))
    examples = sum(map(len, quoted))
    weight = max(1.0, unknown.count() / examples)  # of an example, were all alike; each template weighs the same
    rows = unknown.unionByName(spark.createDataFrame(
        [(*one, weight * examples / len(quoted) / len(parts)) for parts in quoted for one in parts] + [(0.0, ["none"], 1, weight)], "label double, pairs array<string>, n int, weight double"))
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="pairs", outputCol="held", minTF=1.0).setBinary(True)
    scaled = counter.transform(rows.withColumn("one", _scale("n")))
    scaled = Interaction(inputCols=["one", "held"], outputCol="features").transform(scaled).select(
        "label", "weight", "features")
    model = LogisticRegression(family="multinomial", elasticNetParam=0.5, regParam=0.0001, maxIter=100, standardization=False,
                               weightCol="weight").fit(checkpointed(scaled).coalesce(8))  # bounded by BACKGROUND
    matrix, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    found = {pair: tuple(map(float, matrix[:, i])) for i, pair in enumerate(vocabulary)}
    draft = Classifier(classes, found, tuple(map(float, intercepts)), LEAST)

    kept_out = lines.join(F.broadcast(fitted.select("row")), "row", "left_anti")  # bounded by BACKGROUND
    hits = kept_out.select("row", F.lit(0).alias("pos"), "n", F.explode("held").alias("pair"))
    scored = _scored(hits.join(F.broadcast(_vocabulary(spark, draft)), "pair"), draft, "row")
    steps = scored.groupBy(F.floor(F.array_max("probabilities") * STEPS).alias("step")).count()  # STEPS + 1 rows at most
    # paragraphs without a hit have the probability of the intercepts
    counts = {r["step"]: r["count"] for r in steps.collect()}
    out = total - fitted.count()
    plain = math.floor(max(1 / (1 + math.exp(draft.intercepts[0] - x)) for x in draft.intercepts[1:]) * STEPS)
    counts[plain] = counts.get(plain, 0) + out - sum(counts.values())
    return Classifier(classes, found, draft.intercepts, _threshold(counts, out))


def _vocabulary(spark: SparkSession, model: Classifier) -> DataFrame:
    """Weights by pair; as many rows as the templates have pairs."""
    return spark.createDataFrame([(pair, list(w)) for pair, w in model.weights.items()], "pair string, weights array<double>")


def _scored(hits: DataFrame, model: Classifier, *row: str) -> DataFrame:
    """The probabilities of all families for each paragraph (or window, by `row`) with a hit."""
    sums = [(F.sum(F.get("weights", F.lit(i)) * _scale("n")) + b).alias(f"l{i}") for i, b in enumerate(model.intercepts)]
    by_line = hits.groupBy(*row, "pos").agg(*sums, F.first("n").alias("n"), F.collect_set("pair").alias("pairs"))
    return by_line.select(*row, "pos", "n", "pairs", _probabilities(len(model.classes)).alias("probabilities"))


def own_pairs() -> dict[str, list[str]]:
    """The pairs of each family's templates that no other family has."""
    pairs = {family: {p for f, _, found in _template_rows() if f == family for p in found} for family in TEMPLATES}
    return {family: sorted(held - set().union(*(pairs[f] for f in pairs if f != family))) for family, held in pairs.items()}


def scan(df: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per paragraph and family confirmed in it: `row_1, row_2, pos, family, probability, resemblance`.

    A paragraph is a line, so a wrapped licence text is several paragraphs. A line of more than `WINDOW` pairs is judged in
    overlapping windows, each like a paragraph. A paragraph may hold several families, and ties between them keep both; the largest
    values of a family count. The row keys are those of `content_key` over id
    and text; repeated rows share them and come out once. Resemblance is the share of the pairs of the paragraph or of the
    template, whichever has fewer, that both have. NULL and empty texts have no paragraphs with pairs, and an empty table gives no
    rows. Other columns play no part, whatever their names.
    """
    spark = df.sparkSession
    keys = [k.alias(name) for k, name in zip(content_key(df, doc_id, text), ("row_1", "row_2"))]
    lines = df.select(*keys, F.posexplode(_paragraphs(F.col(text))).alias("pos", "pairs")).where(F.size("pairs") > 0)
    pairs = lines.select("row_1", "row_2", "pos", F.size("pairs").alias("all"), F.posexplode("pairs").alias("at", "pair"))
    vocabulary = F.broadcast(_vocabulary(spark, model))  # bounded by the templates
    near = F.floor(F.col("at") / STRIDE).cast("int")
    held = F.filter(F.array(near - 1, near), lambda w: (w >= 0) & (w <= _last_window(F.col("all"))))
    hits = pairs.join(vocabulary.select("pair"), "pair").select("row_1", "row_2", "pos", "all", "pair", F.explode(held).alias("window"))
    hits = hits.withColumn("n", F.least(F.lit(WINDOW), F.col("all") - F.col("window") * STRIDE)).drop("all").distinct().join(vocabulary, "pair")
    scored = _scored(hits, model, "row_1", "row_2", "window")
    named = F.transform("probabilities", lambda p, i: F.struct(F.get(F.array(*map(F.lit, model.classes[1:])), i).alias("family"), p.alias("probability")))
    likely = scored.select("row_1", "row_2", "window", "pos", "n", "pairs", F.inline(F.filter(named, lambda x: x["probability"] >= model.needed)))
    own = own_pairs()
    known = spark.createDataFrame([(family, pairs, own[family]) for family, _, pairs in _template_rows()], "family string, template array<string>, own array<string>")
    both = F.array_intersect("pairs", "template")
    alike = F.size(both) / F.least("n", F.size(F.array_distinct("template")))
    keys = ("row_1", "row_2", "pos", "family")
    judged = likely.join(F.broadcast(known), "family").where(F.arrays_overlap("pairs", "own") & (alike >= CONFIRMED))
    return judged.groupBy(*keys).agg(F.max("probability").alias("probability"), F.max(alike).alias("resemblance"))


def document_licenses(df: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of `df`: `doc_id, n_licensed` paragraphs, `families` in order, and the largest `probability`, NULL without any.

    An empty table gives no rows. Repeated rows come out as often as they went in; other columns are not read."""
    found = scan(df, model, doc_id, text).groupBy("row_1", "row_2").agg(
        F.count_distinct("pos").alias("n_licensed"), F.sort_array(F.collect_set("family")).alias("families"), F.max("probability").alias("probability"))
    rows = df.select(F.col(doc_id).alias("doc_id"), *(k.alias(n) for k, n in zip(content_key(df, doc_id, text), ("row_1", "row_2"))))
    return rows.join(found, ["row_1", "row_2"], "left").select(
        "doc_id", F.coalesce("n_licensed", F.lit(0)).alias("n_licensed"), F.coalesce("families", F.array().cast("array<string>")).alias("families"), "probability")

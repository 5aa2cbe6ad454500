"""Quality classifier: a sparse ensemble of rules over text statistics (after RuleFit, Friedman and Popescu 2008).

A small forest is grown on statistics of labelled texts. Every path from a root to a node is a rule, a conjunction of
limits. A lasso logistic regression over the rules keeps few of them. What remains is compiled into one column
expression, so that scoring a corpus is a projection without a join, a model file or Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurva.llm.sampling import labelled
from recurva.llm.text import BLANK_CLASS
from recurva.session import checkpointed

#: Labelled texts the rules are grown and weighed on, at most about as many.
SAMPLE_ROWS = 20_000
TREES, DEPTH, LASSO = 16, 3, 0.002
#: Tasks that fit on the sample; each of some dozen passes over it costs a task that many times.
SAMPLE_TASKS = 8
_LIMIT = re.compile(r"(If|Else) \(feature (\d+) (<=|>) (\S+)\)")

Limit = tuple[str, bool, float]  # statistic, whether it must lie above, bound


def statistics(df: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """`df` with a column per statistic, and their names. All are 0 for NULL and empty texts."""
    word = f"[^{BLANK_CLASS}]"

    whole = F.coalesce(F.col(text), F.lit(""))

    def count(pattern: str) -> Column:
        return F.regexp_count(whole, F.lit(pattern)).cast("double")

    counts = {
        "__words": count(f"{word}+"), "__chars": F.char_length(whole).cast("double"), "__lines": count("\n") + 1,
        "__again": count(f"(?<!{word})({word}++)[{BLANK_CLASS}]++(?=\\1(?!{word}))"),
        "__symbols": count(r"[^\p{L}\p{N}\s.,;:'\"?()\-]+"), "__bars": count(r"\|"),
        "__capitals": F.char_length(F.regexp_replace(whole, r"[^\p{Lu}]+", "")).cast("double"),
        "__digits": F.char_length(F.regexp_replace(whole, "[^0-9]+", "")).cast("double"),
        "__short": count(f"(?<!{word}){word}{{1,2}}+(?!{word})"), "__stops": count(r"[.!?]"),
    }
    # as rows of a generator, so that a condition on the score is not pushed below it with every pattern written out again
    df = df.select("*", F.inline(F.array(F.struct(*(value.alias(name) for name, value in counts.items())))))

    def per(part: str, all_of: str) -> Column:
        return F.col(part) / F.greatest(F.col(all_of), F.lit(1.0))

    values = {
        "__s_repeats": per("__again", "__words"), "__s_symbols": per("__symbols", "__words"), "__s_bars": per("__bars", "__words"),
        "__s_capitals": per("__capitals", "__chars"), "__s_digits": per("__digits", "__chars"),
        "__s_word_length": per("__chars", "__words"), "__s_line_words": per("__words", "__lines"),
        "__s_short_words": per("__short", "__words"), "__s_stops": per("__stops", "__words"), "__s_words": F.log1p("__words"),
    }
    return df.withColumns(values).drop(*counts), list(values)


@dataclass(frozen=True)
class Rules:
    """Weighted conjunctions of limits and an intercept."""

    intercept: float
    weighted: tuple[tuple[tuple[Limit, ...], float], ...]

    def score(self) -> Column:
        """Probability of label 1 from the columns of `statistics`."""
        total = F.lit(self.intercept)
        for limits, weight in self.weighted:
            total = total + F.when(_holds(limits), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _holds(limits: tuple[Limit, ...]) -> Column:
    return reduce(and_, (F.col(name) > bound if above else F.col(name) <= bound for name, above, bound in limits))


def _paths(tree: str, names: list[str]) -> set[tuple[Limit, ...]]:
    """The path to each node of a printed tree; a limit implied by a later one of the path is left out."""
    found, above = set(), []
    for line in tree.splitlines():
        match = _LIMIT.search(line)
        if match:
            depth = len(line) - len(line.lstrip())
            above = [x for x in above if x[0] < depth] + [(depth, (names[int(match[2])], match[3] == ">", float(match[4])))]
            tightest: dict[tuple[str, bool], float] = {}
            for _, (name, over, bound) in above:
                known = tightest.get((name, over), bound)
                tightest[name, over] = max(known, bound) if over else min(known, bound)
            found.add(tuple(sorted((name, over, bound) for (name, over), bound in tightest.items())))
    return found


def learn_rules(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", sample_rows: int = SAMPLE_ROWS,
                doc_id: str = "doc_id", text: str = "text", seed: int = 42) -> Rules:
    """Rules from the labelled rows that `learn`, a condition on the label table, allows.

    Without any such row, and with one label only, there are no rules and the score is a constant: one half, or close
    to that label.
    """
    rows, names = statistics(labelled(docs, labels, label, learn, sample_rows, doc_id, text), "text")
    rows = checkpointed(rows.select("label", *names)).coalesce(SAMPLE_TASKS)  # a bounded table of a few numbers a row
    shares = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two values
    if len(shares) < 2:
        return Rules(0.0 if not shares else 4.0 if 1.0 in shares else -4.0, ())
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", seed=seed, minInstancesPerNode=5).fit(assembled)
    rules = sorted(set().union(*(_paths(tree.toDebugString, names) for tree in forest.trees)))
    if not rules:
        return Rules(4.0 if shares[1.0] > shares[0.0] else -4.0, ())
    held = rows.select("label", *(F.when(_holds(rule), 1.0).otherwise(0.0).alias(f"r{i}") for i, rule in enumerate(rules)))
    held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(held).select("features", "label")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60).fit(held)
    weights = lasso.coefficients.toArray()
    return Rules(float(lasso.intercept), tuple((rule, float(w)) for rule, w in zip(rules, weights) if w))


def score_quality(df: DataFrame, rules: Rules, text: str = "text", name: str = "score") -> DataFrame:
    """`df` with `name`, the probability between 0 and 1 that the text has label 1; it replaces a column of that name.

    Each row is scored by its text alone, whole however long; NULL and empty texts are scored as empty ones. Repeated
    rows, NULLs elsewhere and further columns pass through. An empty table gives an empty table.
    """
    rows, names = statistics(df, text)
    return rows.withColumn(name, rules.score()).drop(*names)

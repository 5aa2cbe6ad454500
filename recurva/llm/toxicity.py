"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all documents. Words that look disguised, with digits or signs among their
letters, letters held down, letters set apart, or words in pieces, become lattices: what each character may stand for, at a price. A
Viterbi search finds the letters that model and channel together make most likely, and the restored words join the
plain ones. A logistic regression over words and word beginnings that the labelled rows single out gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurva.llm.sampling import labelled

#: Labelled texts the score is fitted on (about as many at most), and the features it may use.
SAMPLE_ROWS, FEATURES = 12_000, 512
#: Lengths of word beginnings that count as features, and how sure a feature must be (standard deviations).
BEGINNINGS, CERTAINTY = (4, 5, 6, 7), 4.0

# Letters that digits and signs stand in for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a",
    "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "abcdefghijklmnopqrstuvwxyz",
}
#: Prices of the channel, as negative logarithms: a stand-in, a stand-in for any letter, and dropping a repeated letter,
#: where repetition is taken for disguise and where it is taken for spelling and stays. Both readings are kept.
STAND_IN, ANY_LETTER, DROPPED = 1.5, 3.5, (0.5, math.inf)
#: Longest disguised word that is decoded at once; longer ones are decoded in windows.
LONGEST = 32
#: Lengths of the words looked for in letters set apart, which may hold several words; longer ones are found as their windows.
APART = range(3, 33)
#: Letters of a token that may be a piece of a word, and stars that may stand for a letter each.
PIECE, STARS = 3, 12
#: Tokens a worker remembers; it forgets all beyond that.
REMEMBERED = 200_000

_LETTERS = 28  # end of word, a to z, any other letter
_WORD = re.compile(r"[^\W\d_]+")
_HELD = re.compile(r"([^\W\d_])\1\1")
_RUN = re.compile(r"([^*])\1{3,}|(\*)\2{12,}")  # a star may stand for another letter each time
_APART = re.compile(r"[\w@$!](?:([.\-_])[\w@$!])(?:\1[\w@$!])+")
_LEADING = "\"'`.,;:!?()[]{}<>*#%&|+-_=~/\\^"
_TRAILING = _LEADING + "@$"
#: Signs within a token that stand for no letter: those that set no letters apart, and all.
_JOINTS = re.compile(r"[^\w.\-" + re.escape("".join(LOOKALIKES)) + "]+")
_ALL_JOINTS = re.compile(r"(?:[^\w" + re.escape("".join(LOOKALIKES)) + "]|_)+")
_CODES = np.full(256, 0, np.uint8)
_CODES[97:123] = np.arange(1, 27)
_CODES[128:] = 27


def _code(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 27


def _trigrams(text: str) -> np.ndarray:
    """Codes of all trigrams of a text, over bytes, so that a letter beyond ASCII is a few of one kind."""
    codes = _CODES[np.frombuffer(f"  {text.lower()} ".encode(), np.uint8)].astype(np.int32)
    grams = (codes[:-2] * _LETTERS + codes[1:-1]) * _LETTERS + codes[2:]
    return grams[(codes[1:-1] > 0) | (codes[2:] > 0)]


def count_trigrams(df: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts over all texts. There are 28³ = 21,952 trigrams, so that is what the driver gets at most."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(_LETTERS ** 3, np.int64)
        for batch in batches:
            for one in batch["__text"]:
                if one:
                    counts += np.bincount(_trigrams(one), minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"gram": seen, "n": counts[seen]})

    counts = np.zeros(_LETTERS ** 3, np.int64)
    for row in df.select(F.col(text).alias("__text")).mapInPandas(work, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[row["gram"]] = row["n"]
    return counts


class Screen:
    """Tells whether a text without its blanks holds a word or beginning that is a known feature."""

    def __init__(self, known: Iterable[str]):
        words = {f[1:] for f in known}
        self.starts = frozenset(w[:3] for w in words)
        self._words = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for word in words:
            self._words.add_word(word)
        if words:
            self._words.make_automaton()
        self._any = bool(words)

    def finds(self, text: str) -> bool:
        return self._any and next(self._words.iter(text), None) is not None


class Channel:
    """The character model with the channel's prices."""

    def __init__(self, counts: np.ndarray):
        table = counts.reshape(_LETTERS, _LETTERS, _LETTERS).astype(np.float64)
        pairs = table.sum(axis=0) + 0.5
        pairs /= pairs.sum(axis=1, keepdims=True)  # the third letter from the second alone
        weight = 20.0
        self.cost = -np.log((table + weight * pairs) / (table.sum(axis=2, keepdims=True) + weight))
        self._known: dict[str, frozenset[str]] = {}

    @staticmethod
    def _choices(char: str) -> list[tuple[str, float]]:
        found = [(char, 0.0)] if char.isalpha() else []
        letters = LOOKALIKES.get(char, "")
        return found + [(letter, ANY_LETTER if len(letters) > 2 else STAND_IN) for letter in letters]

    def decode(self, word: str, dropped: float) -> str:
        """The likeliest letters of a lattice. States are the last two letters and the last character written."""
        states: dict[tuple[str, str], tuple[float, str]] = {(" ", " "): (0.0, "")}
        before = ""
        for char in word:
            choices = self._choices(char)
            if not choices:
                continue
            after: dict[tuple[str, str], tuple[float, str]] = {}
            for (a, b), (cost, path) in states.items():
                row = self.cost[_code(a) if a != " " else 0, _code(b) if b != " " else 0]
                options = [((b, letter), cost + price + row[_code(letter)], path + letter) for letter, price in choices]
                if char == before and path:
                    options.append(((a, b), cost + dropped, path))
                for state, total, text in options:
                    if state not in after or (total, text) < after[state]:
                        after[state] = total, text
            states, before = after, char
        ends = [(cost + self.cost[_code(a) if a != " " else 0, _code(b) if b != " " else 0, 0], path) for (a, b), (cost, path) in states.items()]
        return min(ends)[1]

    def _both(self, word: str) -> set[str]:
        return {self.decode(word, price) for price in DROPPED}

    @staticmethod
    def _shortened(word: str) -> str:
        """`word` with runs of one character cut to three, of stars to `STARS`."""
        return _RUN.sub(lambda run: run[0][:3] if run[1] else run[0][:STARS], word)

    def _restored(self, core: str) -> frozenset[str] | set[str]:
        """Words that a token or a part of one may hide, whatever its length; none if nothing looks disguised."""
        if core.isalpha():
            if not _HELD.search(core):
                return set()
        elif apart := _APART.fullmatch(core):
            core = core.replace(apart[1], "")
        elif not _WORD.search(core) or not any(char in LOOKALIKES for char in core):
            return set()
        word = self._shortened("".join([char for char in core if char.isalpha() or char in LOOKALIKES]))
        return self._both(word) if len(word) <= LONGEST else self.of_letters(word)

    def of_token(self, token: str) -> frozenset[str]:
        """Words of a lower-case token, as written and restored, as a whole and between its inner signs."""
        core = token.lstrip(_LEADING).rstrip(_TRAILING)
        words = {core} if core.isalpha() else set(_WORD.findall(core))
        parts = {core, *_JOINTS.split(core), *_ALL_JOINTS.split(core)}
        for part in {core, *(part.lstrip(_LEADING).rstrip(_TRAILING) for part in parts)}:
            words |= self._restored(part)
        return frozenset(words)

    def of_letters(self, run: str) -> frozenset[str]:
        """Words that characters in a row may spell, wherever they begin."""
        found, run = set(), self._shortened(run)
        for start in range(0, len(run), LONGEST):  # windows overlap by the longest word looked for, each letter held
            for text in self._both(run[start:start + LONGEST + 3 * APART[-1]]):
                found |= {text[i:i + n] for n in APART for i in range(len(text) - n + 1)} | {text}
        return frozenset(found)

    def word_cost(self, word: str) -> float:
        """Price of a word under the character model."""
        codes = [0, 0, *map(_code, word), 0]
        return float(sum(self.cost[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:])))

    def of_pieces(self, pieces: tuple[str, ...], screen: Screen | None) -> set[str]:
        """Words that neighbouring pieces make up, where the model finds one word likelier than several.

        With `screen` only words that begin as it knows are looked at.
        """
        found = set()
        for i in range(len(pieces) - 1):
            word = pieces[i]
            for j in range(i + 1, len(pieces)):
                word += pieces[j]
                if len(word) > APART[-1]:
                    break
                if len(word) >= APART[0] and (screen is None or word[:3] in screen.starts) and word not in found:
                    if self.word_cost(word) < sum(map(self.word_cost, pieces[i:j + 1])):
                        found.add(word)
        return found

    def collect(self, text: str | None, of, screen: Screen | None = None) -> set[str]:
        """What `of` makes of the words of each token, of letters set apart and of pieces put together, all in one.

        `screen`, for what `of` knows, spares texts without any of it the search among pieces.
        """
        tokens, found = (text or "").lower().split(), set()
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        for token in set(tokens):
            got = known.get(token)
            if got is None:
                got = known[token] = frozenset(of(self.of_token(token)))
            if got:
                found |= got
        runs = "".join([token if len(token) == 1 else " " for token in tokens]).split()
        for run in {run for run in runs if len(run) >= APART[0] and len(set(run)) > 1}:
            found |= of(self.of_letters(run))
        if screen is None or screen.finds("".join(tokens)):
            for run in {run for run in self._pieces(tokens) if len(run) > 1 and max(map(len, run)) > 1}:
                found |= of(self.of_pieces(run, screen))
        return found

    @staticmethod
    def _pieces(tokens: list[str]) -> Iterator[tuple[str, ...]]:
        """Stretches of short tokens that are letters, up to a sign after one."""
        run: list[str] = []
        for token in tokens:
            if len(token) <= PIECE + 1:
                core = token.strip(_LEADING)
                if len(core) <= PIECE and core.isalpha():
                    run.append(core)
                    if token[-1:].isalpha():
                        continue
            if run:
                yield tuple(run)
                run = []
        if run:
            yield tuple(run)


def features(words: Iterable[str], known: frozenset[str] | None = None) -> set[str]:
    """Words as `=word` and their beginnings as `^begin`; only known ones where these are given."""
    found = {"=" + w for w in words}
    for n in BEGINNINGS:
        found |= {"^" + w[:n] for w in words if len(w) > n}
    return found if known is None else found & known


@dataclass(frozen=True)
class Model:
    counts: np.ndarray
    intercept: float
    weights: dict[str, float]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[float, np.ndarray]:
    """Ridge logistic regression by Newton steps; the intercept is not shrunk."""
    x = np.hstack([np.ones((len(x), 1), x.dtype), x])
    beta, shrink = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), beta[1:]


def learn_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", sample_rows: int = SAMPLE_ROWS,
                   doc_id: str = "doc_id", text: str = "text") -> Model:
    """The character model of all `docs`, and weights from labelled rows that `learn`, a condition on the label table, allows.

    Without such rows the score is one half, with one label only it is close to that label.
    """
    counts = count_trigrams(docs, text)
    rows = labelled(docs, labels, label, learn, sample_rows, doc_id, text)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel = Channel(counts)
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start:start + 256]
                found = [sorted(channel.collect(t, features)) for t in part["text"]]
                yield pd.DataFrame({"label": part["label"].to_numpy(), "found": found})

    marked = rows.select("text", "label").mapInPandas(spread, "label double, found array<string>")
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    bad, good = totals.get(1.0, 0), totals.get(0.0, 0)
    if not bad or not good:
        return Model(counts, 0.0 if not bad and not good else 4.0 if bad else -4.0, {})
    by_feature = marked.select("label", F.explode("found").alias("feature")).groupBy("feature").agg(
        F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    share = (F.col("bad") + F.col("good")) / (bad + good)
    sure = (F.col("bad") / bad - F.col("good") / good) / F.sqrt(share * (1 - share) * (1 / bad + 1 / good) + 1e-12)
    # a feature beside chance: toxic rows that hold it must outnumber what its share among the others explains
    chosen = by_feature.where("bad >= 3").withColumn("sure", sure).where(F.col("sure") >= CERTAINTY).orderBy(
        F.desc("sure"), "feature").limit(FEATURES).collect()
    names = [r["feature"] for r in chosen]
    place, known = {n: i for i, n in enumerate(names)}, frozenset(names)

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel, screen = Channel(counts), Screen(known)
        for batch in batches:
            found = [sorted(place[f] for f in channel.collect(t, lambda words: features(words, known), screen)) for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "found": found})

    # at most 2·sample_rows rows with at most FEATURES small numbers each
    held = rows.select("text", "label").mapInPandas(reduced, "label double, found array<int>").groupBy("label", "found").count().collect()
    x, y = np.zeros((len(held), len(names)), np.float32), np.array([r["label"] for r in held])
    for i, r in enumerate(held):
        x[i, r["found"]] = 1
    weight = np.array([r["count"] for r in held])
    order = np.lexsort([y, *x.T[:8]]) if len(names) else np.arange(len(y))
    x, y, weight = x[order], y[order], weight[order]
    intercept, weights = _logistic(np.repeat(x, weight, axis=0), np.repeat(y, weight))
    return Model(counts, intercept, dict(zip(names, map(float, weights))))


def score_toxicity(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """`df` with `name`, the probability between 0 and 1 that the text has label 1; it replaces a column of that name.

    Each row is scored by its whole text alone; NULL and empty texts have the score of a text without any known
    feature. Repeated rows, NULLs elsewhere and further columns pass through. An empty table gives an empty table.
    """
    known = frozenset(model.weights)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        channel = Channel(model.counts)

        def of(words):
            return features(words, known)

        screen = Screen(known)
        for texts in batches:
            totals = [model.intercept + sum(model.weights[f] for f in sorted(channel.collect(t, of, screen))) for t in texts]
            yield pd.Series([1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for x in totals], dtype="float64")

    return df.withColumn(name, score(F.col(text)))

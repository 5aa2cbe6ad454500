"""Pair scores. Everything is a native expression except the fuzzy name ratio."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from recurva.functions.coerce import strip
from recurva.functions.normalize import email_domain

# Share of each dimension in the total. Domain and phone carry weight but are not scored.
WEIGHTS = {"email": 0.35, "company_name": 0.25, "domain": 0.15, "temporal": 0.10, "amount": 0.10, "phone": 0.05}

NAME_EXACT = 0.95
NAME_FUZZY = 0.80
DAY_MICROS = 86_400_000_000
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
_ZONED = r"[T ].*(Z|[+-]\d{2}:?\d{2})$"


def clean_email(email: Column) -> Column:
    """Comparable form of an e-mail; NULL where it is missing or empty."""
    return F.when(email != "", F.lower(strip(email)))


def known_domain(email: Column) -> Column:
    """Domain of a cleaned e-mail; NULL where there is none."""
    domain = email_domain(email)
    return F.when(domain != "", domain)


def score_email(a: Column, b: Column, domain_a: Column | None = None, domain_b: Column | None = None) -> Column:
    """1.0 for the same address, 0.8 for the same domain, else 0.0.

    Takes cleaned e-mails, and their domains where those are known already.
    """
    domain_a = known_domain(a) if domain_a is None else domain_a
    domain_b = known_domain(b) if domain_b is None else domain_b
    return F.when(a == b, 1.0).when(domain_a == domain_b, 0.8).otherwise(0.0)


def email_method(a: Column, b: Column, score: Column | None = None) -> Column:
    score = score_email(a, b) if score is None else score
    return (
        F.when(a.isNull() | b.isNull(), "no_email")
        .when(score == 1.0, "email_exact")
        .when(score == 0.8, "email_domain")
        .otherwise("email_mismatch")
    )


def name_score(similarity: Column) -> Column:
    """Similarity 0…1 as a score: 1.0 from 0.95 on, itself from 0.80 on, else 0.0."""
    return F.when(similarity >= NAME_EXACT, 1.0).when(similarity >= NAME_FUZZY, similarity).otherwise(0.0)


def name_method(a: Column, b: Column, similarity: Column) -> Column:
    missing = F.coalesce(a, F.lit("")).eqNullSafe("") | F.coalesce(b, F.lit("")).eqNullSafe("")
    return (
        F.when(missing, "no_name")
        .when(similarity >= NAME_EXACT, "name_exact")
        .when(similarity >= NAME_FUZZY, "name_fuzzy")
        .otherwise("name_mismatch")
    )


def iso_micros(text: Column) -> Column:
    """ISO date or time as microseconds; NULL for anything else. Without a zone it counts as UTC."""
    has_zone = text.rlike(_ZONED)
    stamp = F.when(has_zone, text).otherwise(F.concat(text, F.when(F.length(text) == 10, "T00:00:00Z").otherwise("Z")))
    return F.when(text.rlike(_ISO), F.unix_micros(stamp.try_cast("timestamp")))


def iso_zoned(text: Column) -> Column:
    return text.rlike(_ZONED)


def day_distance(a_micros: Column, b_micros: Column) -> Column:
    """Days between two times. The difference is floored before the sign is dropped."""
    return F.abs(F.floor((a_micros - b_micros) / F.lit(DAY_MICROS)))


def score_temporal(a_micros: Column, b_micros: Column, comparable: Column, tolerance_days: int = 3) -> Column:
    """1 − d / (tolerance + 1) up to the tolerance, else 0.0; 0.0 where only one side has a zone."""
    days = day_distance(a_micros, b_micros)
    near = 1.0 - days / F.lit(float(tolerance_days + 1))
    return F.when(comparable & (days <= tolerance_days), near).otherwise(0.0)


def score_amount(a: Column, b: Column, tolerance: float = 0.05) -> Column:
    """1.0 within the tolerance of the larger amount, 0.7 within a tenth, 0.5 if both are zero."""
    share = F.try_divide(F.abs(a - b), F.greatest(F.abs(a), F.abs(b)))
    return (
        F.when((a == 0) & (b == 0), 0.5).when(share <= tolerance, 1.0).when(share <= 0.10, 0.7).otherwise(0.0)
    )


def amount_method(a: Column, b: Column, unreadable: Column, tolerance: float = 0.05) -> Column:
    share = F.try_divide(F.abs(a - b), F.greatest(F.abs(a), F.abs(b)))
    return (
        F.when(unreadable, "amount_parse_error")
        .when(a.isNull() | b.isNull(), "no_amount")
        .when((a == 0) & (b == 0), "both_zero")
        .when(share <= tolerance, "amount_exact")
        .when(share <= 0.10, "amount_close")
        .otherwise("amount_mismatch")
    )


def weighted_sum(email: Column, name: Column, temporal: Column, amount: Column) -> Column:
    return (
        email * WEIGHTS["email"] + name * WEIGHTS["company_name"]
        + temporal * WEIGHTS["temporal"] + amount * WEIGHTS["amount"]
    )


def total_score(email: Column, name: Column, temporal: Column, amount: Column) -> Column:
    """Weighted sum with four decimals, rounded by its exact binary value and not by its decimal print.

    Only a fuzzy name gives more than four decimals, so only then the costly way is needed.
    """
    total = weighted_sum(email, name, temporal, amount)
    return F.when(name.isin(0.0, 1.0), F.round(total, 4)).otherwise(F.format_number(total, 4).cast("double"))


def reaches(threshold: float, email: Column, name: Column, temporal: Column, amount: Column) -> Column:
    """Whether the total score rounds to the threshold or more.

    Short, so that it stays fast inside a join. A sum that lies right between two rounded values is settled by
    `total_score`; see `needs_rounding`.
    """
    return weighted_sum(email, name, temporal, amount) >= threshold - 5e-5


def needs_rounding(threshold: float) -> bool:
    """Whether a sum can lie right below the threshold by half a digit.

    The scores other than that of a fuzzy name add up to steps of 0.005, and a fuzzy name cannot make up for
    the rest of a step in fewer than thousands of letters.
    """
    return abs(threshold * 200 - round(threshold * 200)) > 1e-6


# --- fuzzy name ratio -------------------------------------------------------------------------
# Spark has no weighted fuzzy ratio, so distinct name pairs go through one Arrow UDF.


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word operation per character of `b`."""
    full = (1 << len(a)) - 1
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    open_bits = full
    for ch in b:
        hit = open_bits & where.get(ch, 0)
        open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return len(a) - open_bits.bit_count()


def _ratio(a: str, b: str) -> float:
    size = len(a) + len(b)
    return 200.0 * _common(a, b) / size if size else 100.0


def _best_window(a: str, b: str) -> float:
    """Best ratio of the shorter text with any stretch of the longer one of at most its length."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0 if long else 100.0
    if short in long:
        return 100.0
    n = len(short)
    return max(_ratio(short, long[max(0, start) : start + n]) for start in range(1 - n, len(long)))


def _token_views(a: str, b: str) -> tuple[str, str, set[str], str, str]:
    words_a, words_b = a.split(), b.split()
    both = set(words_a) & set(words_b)
    only_a = " ".join(sorted(set(words_a) - both))
    only_b = " ".join(sorted(set(words_b) - both))
    return " ".join(sorted(words_a)), " ".join(sorted(words_b)), both, only_a, only_b


def _token_ratio(a: str, b: str) -> float:
    sorted_a, sorted_b, both, only_a, only_b = _token_views(a, b)
    if not sorted_a or not sorted_b:
        return 0.0
    if both and (not only_a or not only_b):
        return 100.0
    best = _ratio(sorted_a, sorted_b)
    shared = " ".join(sorted(both))
    with_a, with_b = f"{shared} {only_a}".strip(), f"{shared} {only_b}".strip()
    best = max(best, _ratio(with_a, with_b))
    if both:
        best = max(best, _ratio(shared, with_a), _ratio(shared, with_b))
    return best


def _partial_token_ratio(a: str, b: str) -> float:
    sorted_a, sorted_b, both, only_a, only_b = _token_views(a, b)
    if both:
        return 100.0
    if not sorted_a or not sorted_b:
        return 0.0
    return max(_best_window(sorted_a, sorted_b), _best_window(only_a, only_b))


def weighted_ratio(a: str, b: str) -> float:
    """Weighted fuzzy ratio of two texts, 0…100.

    Texts of similar length take the better of the plain and the word-based ratio (× 0.95); texts of
    unlike length also take the best-window ratio (× 0.9, or × 0.6 beyond eight times the length).
    """
    if not a or not b:
        return 0.0
    if a == b:
        return 100.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    best = _ratio(a, b)
    if spread < 1.5:
        return max(best, 0.95 * _token_ratio(a, b))
    scale = 0.9 if spread <= 8.0 else 0.6
    best = max(best, scale * _best_window(a, b))
    return max(best, scale * 0.95 * _partial_token_ratio(a, b))


def _compare(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in parts:
        yield pd.Series([weighted_ratio(a or "", b or "") / 100.0 for a, b in zip(left, right)], dtype="float64")


def fuzzy_similarity(a: str, b: str) -> Column:
    """Similarity 0…1 of two columns of lower-case names; meant for distinct pairs."""
    return F.pandas_udf(_compare, "double")(a, b)


# Executors get the code of the function itself, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

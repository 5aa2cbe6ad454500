"""Normalisers that turn e-mail, company name and phone into blocking keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recurva.functions.coerce import strip

# Legal-form endings, taken off in this order, each at most once.
COMPANY_ENDINGS = (
    " inc", " inc.", " incorporated", " llc", " l.l.c.", " ltd", " ltd.", " corp", " corp.",
    " corporation", " co", " co.", " company", " gmbh", " ag", " sa", " bv",
)


def email_domain(email: Column) -> Column:
    """Lower-case text between the first and the second `@`; NULL without an `@`."""
    return F.when(F.contains(email, F.lit("@")), F.split_part(F.lower(strip(email)), F.lit("@"), F.lit(2)))


def company_key(name: Column) -> Column:
    """Lower-case name without legal-form endings, punctuation and repeated blanks."""
    key = F.lower(strip(F.coalesce(name, F.lit(""))))
    key = F.aggregate(
        F.array(*map(F.lit, COMPANY_ENDINGS)), key,
        lambda text, ending: F.when(F.endswith(text, ending), F.left(text, F.length(text) - F.length(ending))).otherwise(text),
    )
    key = F.regexp_replace(key, r"(?U)[^a-z0-9\s]", "")
    return strip(F.regexp_replace(key, r"(?U)\s+", " "))


def phone_key(phone: Column) -> Column:
    """The last seven digits, or all of them where there are fewer."""
    return F.right(F.regexp_replace(phone, "[^0-9]", ""), F.lit(7))

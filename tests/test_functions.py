import math

import pytest
from pyspark.sql import functions as F

from recurva.functions import labels, normalize, similarity
from recurva.functions.coerce import currency_to_double, numeric_field, template_filter, truthy
from recurva.functions.similarity import weighted_ratio


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def pairs(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(values)], f"i int, a {kind}, b {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("a"), F.col("b"))).collect()]


def test_email_domain(spark):
    values = ["alex@acme.com", "ALEX@Acme.COM", " a@B.c ", "invalid", "", None, "a@", "a@b@c"]
    assert column(spark, values, normalize.email_domain) == ["acme.com", "acme.com", "b.c", None, None, None, "", "b"]


def test_company_key(spark):
    values = ["Acme Inc.", "Acme Corporation", "Acme LLC", "Acme Ltd.", "  Acme   Corp  ", "O'Brien & Co.", "Acme Co Inc",
              "Acme Inc Co", "Müller GmbH", "", None]
    assert column(spark, values, normalize.company_key) == [
        "acme", "acme", "acme", "acme", "acme", "obrien", "acme", "acme inc", "mller", "", ""]


def test_phone_key(spark):
    assert column(spark, ["+1 (555) 123-4567", "555-123-4567", "1234567", "12-3"], normalize.phone_key) == ["1234567"] * 3 + ["123"]


def test_currency_text(spark):
    values = ["$1,234.50", "£7", "€1.5", " 12 ", "1e3", "5d", "5f", "0x1p3", "n/a", "", "inf", None]
    found = column(spark, values, currency_to_double)
    assert found == [1234.5, 7.0, 1.5, 12.0, 1000.0, None, None, None, None, None, math.inf, None]


def test_email_score(spark):
    clean = similarity.clean_email
    values = [("a@x.com", " A@X.com"), ("a@x.com", "b@x.com"), ("a@x.com", "a@y.com"), (None, "a@x.com"), ("", "a@x.com"), ("abc", "abc")]
    assert pairs(spark, values, lambda a, b: similarity.score_email(clean(a), clean(b))) == [1.0, 0.8, 0.0, 0.0, 0.0, 1.0]
    assert pairs(spark, values, lambda a, b: similarity.email_method(clean(a), clean(b))) == [
        "email_exact", "email_domain", "email_mismatch", "no_email", "no_email", "email_exact"]


def test_temporal_score(spark):
    def score(a, b):
        same_kind = similarity.iso_zoned(a) == similarity.iso_zoned(b)
        return similarity.score_temporal(similarity.iso_micros(a), similarity.iso_micros(b), same_kind)

    values = [("2024-01-15", "2024-01-15"), ("2024-01-15", "2024-01-16"), ("2024-01-18", "2024-01-15"), ("2024-01-15", "2024-06-15"),
              (None, "2024-01-15"), ("2024-01-15T00:00:00", "2024-01-15T12:00:00"), ("2024-01-15T12:00:00", "2024-01-15T00:00:00"),
              ("2024-01-15T00:00:00Z", "2024-01-15"), ("2024-01-15T00:00:00Z", "2024-01-15T01:00:00+01:00"), ("soon", "2024-01-15")]
    assert pairs(spark, values, score) == [1.0, 0.75, 0.25, 0.0, 0.0, 0.75, 1.0, 0.0, 1.0, 0.0]


def test_amount_score(spark):
    values = [(100.0, 100.0), (100.0, 105.0), (100.0, 95.0), (100.0, 91.0), (100.0, 500.0), (0.0, 0.0), (None, 100.0), (-10.0, 10.0), (0.0, 5.0)]
    assert pairs(spark, values, similarity.score_amount, "double") == [1.0, 1.0, 1.0, 0.7, 0.0, 0.5, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("a, b, low, high", [
    ("acme corp", "acme corp", 100, 100),
    ("acme corporation", "acme corp", 90, 90),
    ("acme corp", "corp acme", 95, 95),
    ("acme corp", "totally different company", 0, 79.9),
    ("microsoft", "microsofft", 94, 95),
    ("ab", "axb", 80, 80),
    ("", "acme", 0, 0),
    ("a", "bca", 90, 90),
])
def test_weighted_ratio(a, b, low, high):
    assert low <= weighted_ratio(a, b) <= high
    assert weighted_ratio(a, b) == weighted_ratio(b, a)


def test_common_subsequence_against_table():
    import random

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(0, 90))) for _ in "ab")
        assert similarity._common(a, b) == table(a, b)


def test_weights_add_up():
    assert sum(similarity.WEIGHTS.values()) == pytest.approx(1.0)
    assert max(similarity.WEIGHTS, key=similarity.WEIGHTS.get) == "email"


def test_filters_and_coercion(spark):
    rows = spark.createDataFrame(
        [("active", True, "12.5", 1, None), ("canceled", False, "x", 0, "a"), (None, None, None, None, "")],
        "status string, flag boolean, amount string, n int, text string")

    def keep(where):
        return [r[0] for r in rows.select(template_filter(rows, where)).collect()]

    assert keep({"status": "active"}) == [True, False, False]
    assert keep({"status": ["active", "canceled"]}) == [True, True, False]
    assert keep({"flag": True}) == [True, False, False]
    assert keep({"flag": False}) == [False, True, False]
    assert keep({"n": False}) == [False, True, False]
    assert keep({"status": 5}) == [False, False, False]
    assert keep({"nowhere": None}) == [True, True, True]
    assert keep({"nowhere": True}) == [False, False, False]
    assert keep({"status": [None]}) == [False, False, True]
    assert [r[0] for r in rows.select(numeric_field(rows, "amount")).collect()] == [12.5, 0.0, 0.0]
    assert [r[0] for r in rows.select(numeric_field(rows, "flag")).collect()] == [1.0, 0.0, 0.0]
    assert [r[0] for r in rows.select(truthy(rows, "text")).collect()] == [False, True, False]


def test_labels(spark):
    units = [(1234567.5, "currency"), (6.25, "percent"), (1.005, "ratio"), (1234.0, "count"), (2.5, "days")]
    rows = spark.createDataFrame([(i, *u) for i, u in enumerate(units)], "i int, value double, unit string")
    shown = [r[0] for r in rows.orderBy("i").select(labels.metric_text(F.col("value"), F.col("unit"))).collect()]
    assert shown == [f"${1234567.5:,.0f}", f"{6.25:.1f}%", f"{1.005:.2f}", "1,234", f"{2.5:,.0f}"]
    assert column(spark, [12.34, -3.0, 0.0, None], labels.change_text, "double") == ["↑ 12.3%", "↓ 3.0%", "→ 0.0%", "—"]
    assert column(spark, [0.9, 0.7, 0.5, 0.4], labels.severity_label, "double") == ["Critical", "Warning", "Warning", "Info"]
    ids = [["a", "b"], ["a", "b", "c", "d"]]
    assert column(spark, ids, labels.joint_metric_id, "array<string>") == ["multivariate_a_b", "multivariate_a_b_c_etc"]

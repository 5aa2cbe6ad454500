import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from recurva.functions.coerce import exact_sum
from recurva.operators import metrics as ops
from recurva.operators import periods, registry
from recurva.operators.formulas import formula_column, formula_order
from recurva.operators.registry import CORE_METRICS, Metric
from recurva.operators.metrics import compute_metrics
from recurva.operators.validation import validate_metrics
from recurva.plans.analyse import entity_rows
from recurva.plans.compute import compute_saas_metrics


@pytest.fixture(scope="module")
def entities(spark):
    rows = [("c1", "active", 500, None, "e1"), ("c2", "active", 300, None, "e2"), ("c3", "active", 200, None, "e3"),
            ("c4", "canceled", 100, True, "e4")]
    return spark.createDataFrame(rows, "customer_id string, status string, mrr_amount int, canceled_in_period boolean, entity_id string")


def values(frame):
    return {r["metric_id"]: r["value"] for r in frame.collect()}


def test_fixture(spark, entities):
    found = values(ops.compute_metrics(entities))
    assert found["mrr"] == 1000 and found["churn_mrr"] == 100 and found["active_customers"] == 3
    assert found["arpu"] == pytest.approx(333.3333, abs=1e-3)
    assert found["quick_ratio"] == 0 and found["nrr"] == 0 and found["logo_churn_rate"] == 0
    assert len(found) == 10


def test_change_and_decomposition(spark, entities):
    previous = spark.createDataFrame([("mrr", 800.0), ("arpu", 0.0)], "metric_id string, value double")
    rows = {r["metric_id"]: r for r in ops.compute_metrics(entities, previous=previous).collect()}
    assert (rows["mrr"]["change_absolute"], rows["mrr"]["change_percent"]) == (200.0, 25.0)
    assert rows["arpu"]["change_percent"] is None and rows["arpu"]["change_absolute"] is not None
    assert rows["nrr"]["change_absolute"] is None
    assert rows["mrr"]["decomposition"] == {"new_mrr": 0.0, "expansion_mrr": 0.0, "contraction_mrr": 0.0, "churn_mrr": 100.0}
    assert rows["nrr"]["decomposition"] is None


def test_empty_input(spark, entities):
    assert set(values(ops.compute_metrics(entities.limit(0))).values()) == {0.0}


def test_extra_values(entities):
    found = values(ops.compute_metrics(entities, extra={"mrr_previous": 900, "churned_customers": 1, "active_customers_start": 4}))
    assert found["nrr"] == pytest.approx(100.0) and found["logo_churn_rate"] == 25.0


def test_deltas(spark):
    rows = spark.createDataFrame([("active", True, 50.0), ("active", True, -20.0), ("active", False, 5.0), ("canceled", True, 7.0),
                                  ("active", True, None)], "status string, existing_customer boolean, delta double")
    found = values(ops.compute_metrics(rows))
    assert (found["expansion_mrr"], found["contraction_mrr"]) == (50.0, 20.0)


def test_rows_without_any_id_count_as_themselves(spark):
    rows = spark.createDataFrame([("a", "active"), ("a", "active"), (None, "active"), (None, "active")], "customer_id string, status string")
    assert values(ops.compute_metrics(rows))["active_customers"] == 3.0
    assert values(ops.compute_metrics(rows.drop("customer_id")))["active_customers"] == 4.0


def test_registry():
    assert len(CORE_METRICS) >= 10
    assert {m.category for m in CORE_METRICS.values()} == {"revenue", "retention", "growth", "efficiency"}
    edges = registry.edges()
    assert len(edges) == 14 and len(set(edges)) == 14
    assert all(p != c and p in CORE_METRICS and c in CORE_METRICS for p, c, _, _ in edges)
    assert {"mrr", "quick_ratio"} <= set(registry.parents_of("new_mrr"))
    assert registry.parts_of("mrr") == ["new_mrr", "expansion_mrr", "contraction_mrr", "churn_mrr"]
    assert registry.parts_of("active_customers") == []
    assert registry.parent_of("churn_mrr") == "mrr"
    assert list(registry.metric_pack(["arpu"])) == ["mrr", "active_customers", "arpu"]


def test_formulas(spark):
    one = spark.range(1)

    def result(text, **names):
        return one.select(formula_column(text, {k: F.lit(float(v)) for k, v in names.items()})).first()[0]

    assert result("(a + b) / c * 2 - -1", a=1, b=2, c=4) == 2.5
    assert result("a / b", a=1, b=0) == 0.0
    assert result("a / nobody", a=1) == 0.0
    for text in ("a ** 2", "print(a)", "a if a else 0", "a; b", "True"):
        with pytest.raises((ValueError, SyntaxError)):
            formula_column(text, {"a": F.lit(1.0)})


def test_formula_over_formula():
    def formula(name, text):
        return Metric(name, "", "", "", "", "formula", formula=text)

    listed = {m.metric_id: m for m in (formula("c", "b + 1"), formula("b", "a + 1"), formula("a", "1 + 1"))}
    assert formula_order(listed) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        formula_order({m.metric_id: m for m in (formula("a", "b"), formula("b", "a"))})


def test_many_tenants_in_one_pass(spark):
    rows = spark.createDataFrame([("t1", "active", 10.0), ("t1", "active", 5.0), ("t2", "active", 1.0)], "tenant_id string, status string, mrr_amount double")
    plan = ops.wide_metrics(rows, ["tenant_id"])
    found = {r["tenant_id"]: (r["mrr"], r["entity_count"]) for r in plan.collect()}
    assert found == {"t1": (15.0, 2), "t2": (1.0, 1)}


def test_validations(spark, entities):
    tables = compute_saas_metrics(entities)
    rows = {r["invariant_name"]: r for r in tables.validations.collect()}
    assert rows["mrr_decomposition_sum"]["passed"] and rows["mrr_decomposition_sum"]["severity"] == "error"
    assert rows["mrr_decomposition_sum"]["details"]["churn"] == 100.0
    assert rows["nrr_range"]["message"] == "NRR is 0.0% — within expected range (0-300%)"
    assert rows["quick_ratio_positive_denominator"]["message"] == "Quick ratio denominator: 100"
    few = spark.createDataFrame([("nrr", 400.0)], "metric_id string, value double")
    rows = {r["invariant_name"]: r for r in validate_metrics(few).collect()}
    assert not rows["nrr_range"]["passed"] and "outside" in rows["nrr_range"]["message"]
    assert rows["quick_ratio_positive_denominator"]["message"].endswith("(zero)")


def test_metadata_of_unknown_metric(spark):
    row = ops.describe_metrics(spark.createDataFrame([("abc", 1.0)], "metric_id string, value double")).first()
    assert (row["name"], row["unit"], row["direction"]) == ("abc", "unknown", "neutral")


def test_bands(spark):
    rows = spark.createDataFrame([("nrr", 130.0), ("nrr", 89.0), ("logo_churn_rate", 1.0), ("logo_churn_rate", 9.0), ("mrr", 5.0)],
                                 "metric_id string, value double")
    assert sorted((r["metric_id"], r["value"], r["band"]) for r in ops.benchmark_bands(rows).collect()) == [
        ("logo_churn_rate", 1.0, "excellent"), ("logo_churn_rate", 9.0, "poor"), ("nrr", 89.0, "poor"), ("nrr", 130.0, "excellent")]


def test_period_flags(spark):
    ts = datetime.datetime
    rows = [("t", "c", "s1", "active", 10.0, ts(2024, 1, 5), 1), ("t", "c", "s1", "active", 30.0, ts(2024, 2, 5), 2),
            ("t", "c", "s1", "canceled", 30.0, ts(2024, 2, 20), 3), ("t", "c", "s2", "active", 7.0, ts(2024, 2, 7), 4)]
    history = spark.createDataFrame(rows, "tenant_id string, customer_entity_id string, subscription_id string, status string, "
                                          "amount double, at timestamp, sequence int")
    flags = periods.period_flags(periods.subscription_periods(history))
    found = {(r["subscription_id"], r["period_date"].month): r for r in flags.collect()}
    assert found["s1", 1]["created_in_period"] and not found["s1", 1]["existing_customer"] and found["s1", 1]["delta"] is None
    assert found["s1", 2]["delta"] == 50.0 and found["s1", 2]["canceled_in_period"] and not found["s1", 2]["created_in_period"]
    assert found["s2", 2]["created_in_period"] and found["s2", 2]["existing_customer"] and not found["s2", 2]["canceled_in_period"]
    churn = {r["period_date"].month: (r["active_customers_start"], r["churned_customers"]) for r in periods.customer_churn(flags).collect()}
    assert churn == {2: (1.0, 0.0), 3: (1.0, 1.0)}


def test_customer_churn(spark):
    rng = random.Random(4)
    months = [datetime.date(2023 + i // 12, 1 + i % 12, 1) for i in range(18)]
    rows = [(rng.choice("tu"), rng.choice(["x", "y", "z", None]), f"s{rng.randint(0, 2)}", rng.choice(["active", "active", "canceled", None]), rng.choice(months))
            for _ in range(120)]
    flags = spark.createDataFrame(rows, "tenant_id string, customer_entity_id string, subscription_id string, status string, period_date date")
    at = {}
    for tenant, customer, _, status, month in rows:
        if status == "active":
            at.setdefault((tenant, month), set()).add(customer)
    want = {}
    for (tenant, month), before in at.items():
        following = datetime.date(month.year + month.month // 12, month.month % 12 + 1, 1)
        want[tenant, following] = (len(before), len(before - at.get((tenant, following), set())))
    churn = periods.customer_churn(flags)
    assert {(r["tenant_id"], r["period_date"]): (r["active_customers_start"], r["churned_customers"]) for r in churn.collect()} == want
    assert "Join" not in churn._jdf.queryExecution().executedPlan().toString()
    assert periods.customer_churn(flags.limit(0)).count() == 0


def test_exact_sum(spark):
    rng = random.Random(2)
    sets = {"tiny": [1e-7] * 1000, "huge": [1e27, 1.0, 1e-7, -1e27], "tenths": [0.1] * 30, "mixed": [rng.uniform(-1, 1) * 10 ** rng.randint(-3, 12) for _ in range(2000)],
            "negative": [-1e-7, -3.5, 0.25], "beyond": [1e300, 2.0], "nothing": [None, None], "some": [None, 2.5]}
    rows = spark.createDataFrame([(k, v) for k, values in sets.items() for v in values], "k string, v double")
    found = []
    for parts in (1, 3, 8):
        got = rows.orderBy(F.rand(parts)).repartition(parts).groupBy("k").agg(exact_sum(F.col("v")).alias("s")).collect()
        found.append({r["k"]: r["s"] for r in got})
    assert found[0] == found[1] == found[2]
    assert found[0] == {k: math.fsum(x for x in values if x is not None) if k != "nothing" else None for k, values in sets.items()}
    bad = spark.createDataFrame([(float("nan"),), (1.0,)], "v double").agg(exact_sum(F.col("v"))).first()[0]
    assert math.isnan(bad)


def test_amounts_under_several_names(spark):
    """United sources keep the amount under different names, in columns or in maps."""
    frame = spark.createDataFrame([("a", 100.0, None, "active", None), ("b", None, "40", "", "active"), ("c", None, "", "active", "x"), ("d", 1.0, "2", None, "canceled")],
                                  "entity_id string, mrr double, Revenue string, status string, state string")
    rows = {r["entity_id"]: (r["mrr_amount"], r["status"]) for r in entity_rows(frame).collect()}
    assert rows == {"a": ("100.0", "active"), "b": ("40", "active"), "c": (None, "active"), "d": ("1.0", "canceled")}
    maps = spark.createDataFrame([("a", {"MRR ": "100.0", "status": "active"}), ("b", {"revenue": "40", "status": "", "state": "active"}), ("e", {}), ("f", {"mrr_amount": "5", "status": "canceled"})],
                                 "entity_id string, data map<string,string>")
    assert {r["entity_id"]: (r["mrr_amount"], r["status"]) for r in entity_rows(maps).collect()} == {
        "a": ("100.0", "active"), "b": ("40", "active"), "e": (None, None), "f": ("5", "canceled")}
    values = {r["metric_id"]: r["value"] for r in compute_metrics(entity_rows(maps)).collect()}
    assert (values["mrr"], values["active_customers"], values["arpu"]) == (140.0, 2.0, 70.0)

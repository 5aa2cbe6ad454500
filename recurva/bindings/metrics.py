"""Filters, coercions, aggregates, metrics, derived inputs and validations."""

from __future__ import annotations

from pyspark.sql import functions as F

from recurva.bindings.tables import (
    METRICS_SQL, SUBSCRIPTION_SQL, day, metric_inputs, number, subscription_history, subscriptions, table,
)
from recurva.functions import coerce
from recurva.operators import metrics as ops
from recurva.operators import periods, validation
from recurva.operators.registry import CORE_METRICS, Metric, edges_frame, metric_pack, metrics_frame

QUERIES, ORACLES = {}, {}
KEYS = ("tenant_id", "period_date")


def query(name, sql):
    def register(function):
        QUERIES[name], ORACLES[name] = function, sql
        return function
    return register


# --- filters and coercions --------------------------------------------------------------------


@query("p1_template_filter", """
SELECT o_orderpriority, CAST(count(*) FILTER (o_orderstatus IN ('O', 'P')) AS BIGINT) AS by_list,
       CAST(count(*) FILTER (o_orderstatus = 'F' AND o_totalprice <> 0) AS BIGINT) AS by_value_and_truth,
       CAST(0 AS BIGINT) AS by_missing_column
FROM orders GROUP BY 1""")
def p1(spark, folder):
    rows = table(spark, folder, "orders")
    return rows.groupBy("o_orderpriority").agg(
        F.count_if(coerce.template_filter(rows, {"o_orderstatus": ["O", "P"]})).alias("by_list"),
        F.count_if(coerce.template_filter(rows, {"o_orderstatus": "F", "o_totalprice": True})).alias("by_value_and_truth"),
        F.count_if(coerce.template_filter(rows, {"nowhere": "F"})).alias("by_missing_column"),
    )


@query("p2_numeric_coercion", """
SELECT o_orderkey, coalesce(TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority
                                          WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE), 0.0) AS amount,
       CAST(0 AS DOUBLE) AS missing
FROM orders""")
def p2(spark, folder):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.col("o_orderpriority")).when(k % 5 != 0, F.col("o_totalprice").cast("string"))
    rows = table(spark, folder, "orders").select("o_orderkey", text.alias("raw"))
    return rows.select("o_orderkey", coerce.numeric_field(rows, "raw").alias("amount"),
                       coerce.numeric_field(rows, "nowhere").alias("missing"))


@query("p2b_truthiness", """
SELECT o_orderkey, o_orderkey % 3 <> 0 AS number_true, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'False' END <> '' AS text_true,
       coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END, false) AS flag_true
FROM orders""")
def p2b(spark, folder):
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        k, (k % 3).alias("n"), F.when(k % 4 == 0, "").otherwise("False").alias("t"), F.when(k % 5 != 0, k % 2 == 0).alias("b"))
    return rows.select(k, coerce.truthy(rows, "n").alias("number_true"), coerce.truthy(rows, "t").alias("text_true"),
                       coerce.truthy(rows, "b").alias("flag_true"))


@query("p3_first_non_null", """
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END,
                            CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, CAST(o_custkey AS VARCHAR)) AS found
FROM orders""")
def p3(spark, folder):
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(k, F.struct(
        F.when(k % 3 == 0, F.col("o_orderpriority")).alias("name"), F.when(k % 2 == 0, F.col("o_orderstatus")).alias("company"),
        F.col("o_custkey").alias("account_name")).alias("data"))
    read = coerce.field_reader(rows)
    return rows.select(k, coerce.first_non_null(read, ("name", "company_name", "company", "account_name")).alias("found"))


@query("p4_nested_or_outer", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END AS found FROM orders""")
def p4(spark, folder):
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        k, F.struct(F.when(k % 3 == 0, F.col("o_orderpriority")).otherwise("").alias("name")).alias("data"),
        F.col("o_orderstatus").alias("name"))
    return rows.select(k, coerce.field_values(rows, ["name"])[0].alias("found"))


# --- single aggregates over orders ----------------------------------------------------------------


def _custom(kind, column="", where=None, formula=""):
    return Metric("custom", "Custom", "revenue", "currency", "up_good", kind, column, where or {}, formula)


def _by_priority(rows, metric):
    return rows.groupBy("o_orderpriority").agg(number(ops.aggregate_column(rows, metric), 2).alias("value"))


@query("a1_filtered_sum", """
SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus IN ('O', 'P')), 2) AS value FROM orders GROUP BY 1""")
def a1(spark, folder):
    return _by_priority(table(spark, folder, "orders"), _custom("sum", "o_totalprice", {"o_orderstatus": ["O", "P"]}))


@query("a1_exact_sums", """
SELECT l_returnflag, round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / 1e7, 9) AS tiny, round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE), 2) AS huge,
       round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / 1e7, 9) AS canceled FROM lineitem GROUP BY 1""")
def a1_exact(spark, folder):
    """Sums of very small and of very large amounts, and of small ones between large ones that cancel out."""
    rows = table(spark, folder, "lineitem").select("l_returnflag", F.col("l_quantity").alias("q"))
    sums = rows.groupBy("l_returnflag").agg(coerce.exact_sum(F.col("q") * 1e-7).alias("tiny"), (coerce.exact_sum(F.col("q") * 1e25) / 1e25).alias("huge"))
    mixed = rows.select("l_returnflag", F.explode(F.array(F.lit(1e27), F.col("q") * 1e-7, F.lit(-1e27))).alias("x"))
    left = mixed.groupBy("l_returnflag").agg(F.round(coerce.exact_sum(F.col("x")), 9).alias("canceled"))
    return sums.select("l_returnflag", F.round("tiny", 9).alias("tiny"), F.round("huge", 2).alias("huge")).join(left, "l_returnflag")


@query("a2_distinct_with_fallback", """
SELECT o_orderpriority, CAST(count(DISTINCT coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS VARCHAR) END,
                                         CASE WHEN o_orderkey % 5 <> 0 THEN 'a' || (o_orderkey % 100) END))
       + count(*) FILTER (o_orderkey % 15 = 0) AS DOUBLE) AS value
FROM orders GROUP BY 1""")
def a2(spark, folder):
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        "o_orderpriority", F.when(k % 3 != 0, F.col("o_custkey")).alias("customer_entity_id"),
        F.when(k % 5 != 0, F.concat(F.lit("a"), (k % 100).cast("string"))).alias("account_id"))
    return _by_priority(rows, _custom("count_distinct", "customer_entity_id"))


def _with_delta(spark, folder):
    return table(spark, folder, "orders").select("o_orderpriority", (F.col("o_totalprice") - 250000).alias("delta"))


@query("a3_positive_delta", """
SELECT o_orderpriority, round(sum(greatest(0, o_totalprice - 250000)), 2) AS value FROM orders GROUP BY 1""")
def a3(spark, folder):
    return _by_priority(_with_delta(spark, folder), _custom("sum_positive_delta", "ignored"))


@query("a4_negative_delta", """
SELECT o_orderpriority, round(abs(sum(least(0, o_totalprice - 250000))), 2) AS value FROM orders GROUP BY 1""")
def a4(spark, folder):
    return _by_priority(_with_delta(spark, folder), _custom("sum_negative_delta", "ignored"))


@query("a5_unknown_kind", "SELECT o_orderpriority, CAST(0 AS DOUBLE) AS value FROM orders GROUP BY 1")
def a5(spark, folder):
    return _by_priority(table(spark, folder, "orders"), _custom("median", "o_totalprice"))


@query("a6_formulas", """
SELECT o_orderpriority, round(sum(o_totalprice) / count(DISTINCT o_custkey) + 1e-9, 4) AS average,
       CAST(0 AS DOUBLE) AS by_zero, CAST(0 AS DOUBLE) AS unknown_name,
       round((sum(o_totalprice) / count(DISTINCT o_custkey)) * 2 - 1 + 1e-9, 4) AS over_formula
FROM orders GROUP BY 1""")
def a6(spark, folder):
    def formula(metric_id, text):
        return Metric(metric_id, metric_id, "efficiency", "ratio", "up_good", "formula", formula=text)

    total = Metric("total", "", "", "", "", "sum", "o_totalprice")
    buyers = Metric("buyers", "", "", "", "", "count_distinct", "o_custkey")
    listed = (formula("over_formula", "average * 2 - 1"), total, buyers, formula("average", "total / buyers"),
              formula("by_zero", "total / (buyers - buyers)"), formula("unknown_name", "total / nobody"))
    wide = ops.wide_metrics(table(spark, folder, "orders"), ["o_orderpriority"], {m.metric_id: m for m in listed})
    return wide.select("o_orderpriority", *[number(c).alias(c) for c in ("average", "by_zero", "unknown_name", "over_formula")])


# --- the ten metrics per tenant and month -----------------------------------------------------------


def monthly(spark, folder, metric_ids=None):
    flags = subscriptions(spark, folder)
    registry = CORE_METRICS if metric_ids is None else metric_pack(metric_ids)
    needs_inputs = any(name not in registry for m in registry.values() for name in m.inputs)
    return ops.compute_metrics(flags, KEYS, registry, metric_inputs(flags) if needs_inputs else None)


def with_lag(spark, folder):
    return ops.with_change(ops.lag_previous(monthly(spark, folder).drop("change_absolute", "change_percent"), "period_date", ["tenant_id"]))


def _single(metric_id):
    def run(spark, folder):
        rows = monthly(spark, folder, [metric_id]).where(F.col("metric_id") == metric_id)
        return rows.select("tenant_id", day("period_date").alias("period"), number("value").alias("value"))
    return run


for place, metric_id in enumerate(CORE_METRICS, 1):
    QUERIES[f"m{place}_{metric_id}"] = _single(metric_id)
    ORACLES[f"m{place}_{metric_id}"] = f"""WITH {METRICS_SQL}
SELECT tenant_id, CAST(period_date AS VARCHAR) AS period, round({metric_id} + 1e-9, 4) AS value FROM wide"""


@query("m11_benchmark_bands", f"""WITH {METRICS_SQL}
SELECT tenant_id, CAST(period_date AS VARCHAR) AS period, metric_id, round(value + 1e-9, 4) AS value,
  CASE metric_id
    WHEN 'nrr' THEN CASE WHEN value >= 130 THEN 'excellent' WHEN value >= 110 THEN 'good' WHEN value >= 100 THEN 'ok'
                         WHEN value >= 90 THEN 'concern' ELSE 'poor' END
    WHEN 'quick_ratio' THEN CASE WHEN value >= 4 THEN 'excellent' WHEN value >= 2 THEN 'good' WHEN value >= 1 THEN 'ok'
                                 WHEN value >= 0.5 THEN 'concern' ELSE 'poor' END
    ELSE CASE WHEN value <= 1 THEN 'excellent' WHEN value <= 3 THEN 'good' WHEN value <= 5 THEN 'ok'
              WHEN value <= 8 THEN 'concern' ELSE 'poor' END END AS band
FROM metrics WHERE metric_id IN ('nrr', 'quick_ratio', 'logo_churn_rate')""")
def m11(spark, folder):
    bands = ops.benchmark_bands(monthly(spark, folder))
    return bands.select("tenant_id", day("period_date").alias("period"), "metric_id", number("value").alias("value"), "band")


@query("a7_all_metrics", f"""WITH {METRICS_SQL}
SELECT tenant_id, CAST(period_date AS VARCHAR) AS period, 'daily' AS grain, metric_id, round(value + 1e-9, 4) AS value,
       CAST(entity_count AS BIGINT) AS entity_count FROM metrics""")
def a7(spark, folder):
    return monthly(spark, folder).select("tenant_id", day("period_date").alias("period"), "grain", "metric_id",
                                         number("value").alias("value"), "entity_count")


@query("a8_absolute_change", f"""WITH {METRICS_SQL}
SELECT tenant_id, CAST(period_date AS VARCHAR) AS period, metric_id, round(change_absolute + 1e-9, 2) AS change_absolute FROM changes""")
def a8(spark, folder):
    return with_lag(spark, folder).select("tenant_id", day("period_date").alias("period"), "metric_id",
                                          number("change_absolute", 2).alias("change_absolute"))


@query("a9_percent_change", f"""WITH {METRICS_SQL}
SELECT tenant_id, CAST(period_date AS VARCHAR) AS period, metric_id, round(change_percent + 1e-9, 4) AS change_percent FROM changes""")
def a9(spark, folder):
    return with_lag(spark, folder).select("tenant_id", day("period_date").alias("period"), "metric_id",
                                          number("change_percent").alias("change_percent"))


@query("j9_previous_snapshot", f"""WITH {METRICS_SQL},
whole AS (SELECT metric_id, max(value) AS previous_value FROM metrics WHERE metric_id IN ('mrr', 'arpu') GROUP BY 1)
SELECT tenant_id, CAST(period_date AS VARCHAR) AS period, metric_id, round(previous_value + 1e-9, 4) AS previous_value
FROM metrics LEFT JOIN whole USING (metric_id)""")
def j9(spark, folder):
    rows = monthly(spark, folder).drop("previous_value")
    snapshot = rows.where(F.col("metric_id").isin("mrr", "arpu")).groupBy("metric_id").agg(F.max("value").alias("value"))
    return ops.join_previous(rows, snapshot).select("tenant_id", day("period_date").alias("period"), "metric_id",
                                                    number("previous_value").alias("previous_value"))


@query("j10_metric_metadata", f"""WITH {METRICS_SQL},
named AS (SELECT CASE WHEN metric_id = 'arpu' THEN 'unheard_of' ELSE metric_id END AS metric_id, value FROM metrics)
SELECT metric_id, coalesce(name, metric_id) AS name, coalesce(unit, 'unknown') AS unit,
       coalesce(direction, 'neutral') AS direction, CAST(count(*) AS BIGINT) AS n
FROM named LEFT JOIN registry USING (metric_id) GROUP BY 1, 2, 3, 4""")
def j10(spark, folder):
    renamed = F.when(F.col("metric_id") == "arpu", "unheard_of").otherwise(F.col("metric_id"))
    described = ops.describe_metrics(monthly(spark, folder).withColumn("metric_id", renamed))
    return described.groupBy("metric_id", "name", "unit", "direction").agg(F.count(F.lit(1)).alias("n"))


@query("j11_decomposition", f"""WITH {METRICS_SQL}
SELECT tenant_id, CAST(period_date AS VARCHAR) AS period, 'mrr' AS metric_id, metric_id AS part, round(value + 1e-9, 4) AS part_value
FROM metrics WHERE metric_id IN ('new_mrr', 'expansion_mrr', 'contraction_mrr', 'churn_mrr')""")
def j11(spark, folder):
    rows = monthly(spark, folder).select("tenant_id", day("period_date").alias("period"), "metric_id",
                                         F.explode("decomposition").alias("part", "part_value"))
    return rows.withColumn("part_value", number("part_value"))


@query("p7_metric_listing", f"""WITH {METRICS_SQL}
SELECT metric_id, name, category, unit, direction, CAST(count(*) AS BIGINT) AS periods, round(max(value) + 1e-9, 4) AS highest
FROM metrics JOIN registry USING (metric_id) WHERE category IN ('growth', 'retention') GROUP BY ALL""")
def p7(spark, folder):
    listing = metrics_frame(spark).where(F.col("category").isin("growth", "retention")).drop("description")
    rows = monthly(spark, folder).join(F.broadcast(listing), "metric_id")
    return rows.groupBy("metric_id", "name", "category", "unit", "direction").agg(
        F.count(F.lit(1)).alias("periods"), number(F.max("value")).alias("highest"))


@query("p8_metric_graph", f"""WITH {METRICS_SQL},
graph(parent, child, relationship) AS (VALUES
  ('mrr', 'new_mrr', 'decomposition'), ('mrr', 'expansion_mrr', 'decomposition'), ('mrr', 'contraction_mrr', 'decomposition'),
  ('mrr', 'churn_mrr', 'decomposition'), ('nrr', 'mrr', 'formula_input'), ('nrr', 'expansion_mrr', 'formula_input'),
  ('nrr', 'contraction_mrr', 'formula_input'), ('nrr', 'churn_mrr', 'formula_input'), ('arpu', 'mrr', 'formula_input'),
  ('arpu', 'active_customers', 'formula_input'), ('quick_ratio', 'new_mrr', 'formula_input'),
  ('quick_ratio', 'expansion_mrr', 'formula_input'), ('quick_ratio', 'contraction_mrr', 'formula_input'),
  ('quick_ratio', 'churn_mrr', 'formula_input'))
SELECT parent, child, relationship, CAST(1 AS DOUBLE) AS weight, CAST(count(*) AS BIGINT) AS rows_of_child, round(avg(value) + 1e-9, 2) AS mean_of_child
FROM graph JOIN metrics ON metric_id = child GROUP BY 1, 2, 3""")
def p8(spark, folder):
    graph = F.broadcast(edges_frame(spark))
    rows = monthly(spark, folder).join(graph, F.col("metric_id") == F.col("child"))
    return rows.groupBy("parent", "child", "relationship", "weight").agg(
        F.count(F.lit(1)).alias("rows_of_child"), number(F.avg("value"), 2).alias("mean_of_child"))


# --- derived inputs -----------------------------------------------------------------------------------


def _flag(flag):
    def run(spark, folder):
        return subscriptions(spark, folder).select(
            "tenant_id", F.col("customer_entity_id").alias("customer"), F.col("subscription_id").alias("subscription"),
            day("period_date").alias("period"), "status", F.col(flag).alias("flag"))
    return run


for place, flag in ((1, "created_in_period"), (2, "existing_customer"), (4, "canceled_in_period")):
    QUERIES[f"d{place}_{flag}"] = _flag(flag)
    ORACLES[f"d{place}_{flag}"] = f"""WITH {SUBSCRIPTION_SQL}
SELECT tenant_id, customer, subscription, CAST(period_date AS VARCHAR) AS period, status, coalesce({flag}, false) AS flag FROM subscriptions"""


@query("d3_delta", f"""WITH {SUBSCRIPTION_SQL}
SELECT tenant_id, customer, subscription, CAST(period_date AS VARCHAR) AS period, round(mrr_amount + 1e-9, 2) AS mrr_amount, round(delta + 1e-9, 2) AS delta FROM subscriptions""")
def d3(spark, folder):
    return subscriptions(spark, folder).select(
        "tenant_id", F.col("customer_entity_id").alias("customer"), F.col("subscription_id").alias("subscription"),
        day("period_date").alias("period"), number("mrr_amount", 2).alias("mrr_amount"), number("delta", 2).alias("delta"))


@query("d5_previous_mrr", f"""WITH {METRICS_SQL}
SELECT tenant_id, CAST(CAST(period_date + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS period, round(mrr + 1e-9, 2) AS mrr_previous FROM direct""")
def d5(spark, folder):
    rows = periods.previous_mrr(subscriptions(spark, folder))
    return rows.select("tenant_id", day("period_date").alias("period"), number("mrr_previous", 2).alias("mrr_previous"))


@query("d6_customer_churn", f"""WITH {METRICS_SQL}
SELECT tenant_id, CAST(period_date AS VARCHAR) AS period, active_customers_start, churned_customers FROM churn""")
def d6(spark, folder):
    rows = periods.customer_churn(subscriptions(spark, folder))
    return rows.select("tenant_id", day("period_date").alias("period"), "active_customers_start", "churned_customers")


@query("d_subscription_periods", f"""WITH {SUBSCRIPTION_SQL}
SELECT tenant_id, customer, subscription, CAST(period_date AS VARCHAR) AS period, status, round(mrr_amount + 1e-9, 2) AS mrr_amount,
       CAST(CAST(created_at AS DATE) AS VARCHAR) AS created_on FROM periods""")
def subscription_rows(spark, folder):
    rows = periods.subscription_periods(subscription_history(spark, folder))
    return rows.select("tenant_id", F.col("customer_entity_id").alias("customer"), F.col("subscription_id").alias("subscription"),
                       day("period_date").alias("period"), "status", number("mrr_amount", 2).alias("mrr_amount"),
                       day("created_at").alias("created_on"))


# --- validations ----------------------------------------------------------------------------------------


_CHECKS = {
    "mrr_decomposition_sum": """'error' AS severity, true AS passed,
  printf('MRR components: new=%.2f, exp=%.2f, contr=%.2f, churn=%.2f, net=%.2f', new_mrr, expansion_mrr, contraction_mrr, churn_mrr,
         new_mrr + expansion_mrr - contraction_mrr - churn_mrr) AS message""",
    "nrr_range": """'warning' AS severity, nrr BETWEEN 0 AND 300 AS passed, printf('NRR is %.1f%% — ', nrr)
  || CASE WHEN nrr BETWEEN 0 AND 300 THEN 'within' ELSE 'outside' END || ' expected range (0-300%)' AS message""",
    "quick_ratio_positive_denominator": """'info' AS severity, contraction_mrr + churn_mrr > 0 AS passed,
  printf('Quick ratio denominator: %.0f', contraction_mrr + churn_mrr)
  || CASE WHEN contraction_mrr + churn_mrr > 0 THEN '' ELSE ' (zero)' END AS message""",
}


def _check_sql(name):
    return f"SELECT tenant_id, CAST(period_date AS VARCHAR) AS period, '{name}' AS invariant_name, {_CHECKS[name]} FROM wide"


def _checked(spark, folder):
    rows = validation.validate_metrics(monthly(spark, folder), KEYS)
    return rows.select("tenant_id", day("period_date").alias("period"), "invariant_name", "severity", "passed", "message")


def _one_check(name):
    return lambda spark, folder: _checked(spark, folder).where(F.col("invariant_name") == name)


for key, name in zip(("a14_mrr_decomposition", "a15_nrr_range", "a16_quick_ratio_denominator"), _CHECKS):
    QUERIES[key] = _one_check(name)
    ORACLES[key] = f"WITH {METRICS_SQL} {_check_sql(name)}"

QUERIES["a17_all_invariants"] = _checked
ORACLES["a17_all_invariants"] = f"WITH {METRICS_SQL} " + " UNION ALL ".join(map(_check_sql, _CHECKS))

"""Inputs of the metric templates, derived from a subscription history.

The templates read `created_in_period`, `existing_customer`, `delta` and `canceled_in_period`; two
formulas read `mrr_previous`, `churned_customers` and `active_customers_start`. All of them come from
rows of one subscription at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurva.functions.coerce import exact_sum
from recurva.session import checkpointed

TENANT, CUSTOMER, SUBSCRIPTION, PERIOD = "tenant_id", "customer_entity_id", "subscription_id", "period_date"


def period_start(at: Column, grain: str = "month") -> Column:
    return F.to_date(F.date_trunc(grain, at))


def next_period(start: Column, grain: str = "month") -> Column:
    months = {"month": 1, "quarter": 3, "year": 12}
    if grain in months:
        return F.add_months(start, months[grain])
    return F.date_add(start, {"day": 1, "week": 7}[grain])


def subscription_periods(history: DataFrame, grain: str = "month") -> DataFrame:
    """One row per subscription and period from `tenant_id, customer_entity_id, subscription_id, status,
    amount, at, sequence`.

    The amounts of a period add up; the status is that of the last row, by time and sequence. This is the
    only step that sees raw rows, and it aggregates before it shuffles.
    """
    last = F.struct("at", "sequence")
    return (
        history.withColumn(PERIOD, period_start(F.col("at"), grain))
        .groupBy(TENANT, CUSTOMER, SUBSCRIPTION, PERIOD)
        .agg(
            F.max_by("status", last).alias("status"),
            exact_sum(F.col("amount")).alias("mrr_amount"),
            F.min("at").alias("created_at"),
            F.max(F.when(F.col("status") == "canceled", F.col("at"))).alias("canceled_at"),
        )
    )


def created_in_period(grain: str = "month") -> Column:
    """The subscription itself starts in the period: its first row ever lies there."""
    return (F.col("subscription_start") >= F.col(PERIOD)) & (F.col("subscription_start") < next_period(F.col(PERIOD), grain))


def canceled_in_period(grain: str = "month") -> Column:
    at = F.col("canceled_at")
    inside = (at >= F.col(PERIOD)) & (at < next_period(F.col(PERIOD), grain))
    return F.coalesce(inside, F.lit(False)) & (F.col("status") == "canceled")


def period_flags(periods: DataFrame, grain: str = "month") -> DataFrame:
    """Add the four template inputs to the rows of `subscription_periods`.

    Ids are those of a tenant; another tenant may use the same. The windows run over one subscription and hold
    one row per period, so the calendar bounds them. The first day of a customer, who may own any number of
    subscriptions, is aggregated and joined instead.
    """
    own = Window.partitionBy(TENANT, CUSTOMER, SUBSCRIPTION).orderBy(PERIOD)
    rows = periods.withColumns({
        "delta": F.col("mrr_amount") - F.lag("mrr_amount").over(own),
        "subscription_start": F.min("created_at").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    first = periods.groupBy(TENANT, CUSTOMER).agg(F.min("created_at").alias("customer_start"))
    return rows.join(first, [TENANT, CUSTOMER]).withColumns({
        "created_in_period": created_in_period(grain),
        "existing_customer": F.col("customer_start") < F.col(PERIOD),
        "canceled_in_period": canceled_in_period(grain),
    })


def subscription_flags(history: DataFrame, grain: str = "month") -> DataFrame:
    """Subscription periods with their flags, checkpointed.

    Metrics and formula inputs read this table several times; the raw history is read once.
    """
    return checkpointed(period_flags(checkpointed(subscription_periods(history, grain)), grain))


def previous_mrr(flags: DataFrame, grain: str = "month", keys: Sequence[str] = (TENANT,)) -> DataFrame:
    """`mrr_previous` per key and period: the MRR of the period right before, NULL where that has none."""
    mrr = flags.groupBy(*keys, PERIOD).agg(
        F.coalesce(exact_sum(F.when(F.col("status") == "active", F.col("mrr_amount"))), F.lit(0.0)).alias("mrr_previous")
    )
    return mrr.withColumn(PERIOD, next_period(F.col(PERIOD), grain))


def customer_churn(flags: DataFrame, grain: str = "month", keys: Sequence[str] = (TENANT,)) -> DataFrame:
    """`active_customers_start` and `churned_customers` per key and period.

    A customer counts at the start if active in the period before, and as churned if not active any more. A customer
    without an id is one like others. Each active row speaks for its own period and for the next, so that both sides of a
    customer meet in one aggregate, which combines before its shuffle, instead of in a join.
    """
    active = flags.where(F.col("status") == "active").select(*keys, CUSTOMER, F.inline(F.array(
        F.struct(F.col(PERIOD).alias(PERIOD), F.lit(False).alias("before")),
        F.struct(next_period(F.col(PERIOD), grain).alias(PERIOD), F.lit(True).alias("before")))))
    seen = active.groupBy(*keys, PERIOD, CUSTOMER).agg(F.max("before").alias("before"), F.min("before").alias("gone"))
    counted = seen.groupBy(*keys, PERIOD).agg(
        F.count_if("before").cast("double").alias("active_customers_start"),
        F.count_if("gone").cast("double").alias("churned_customers"),
    )
    return counted.where(F.col("active_customers_start") > 0)


def formula_inputs(flags: DataFrame, grain: str = "month", keys: Sequence[str] = (TENANT,)) -> DataFrame:
    """Everything the formulas read beyond the metrics, ready for `compute_metrics(extra=…)`."""
    return previous_mrr(flags, grain, keys).join(customer_churn(flags, grain, keys), [*keys, PERIOD], "full")

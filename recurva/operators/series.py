"""Anomaly rules on metric time series.

A series is a set of rows `keys…, metric_id, period_date, value` with at most one row per day, so the
calendar bounds every window here; `daily_series` makes such rows from raw ones and aggregates before it
shuffles. Every point is judged against the rows before it. `latest_only` keeps the newest point per series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurva.functions.labels import clamp, direction
from recurva.operators.registry import CORE_METRICS, Registry, parts_of

MIN_HISTORY = 7


def daily_series(rows: DataFrame, metric: Column, at: Column, value: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Sum raw rows to one value per series and day."""
    return (
        rows.select(*keys, metric.alias("metric_id"), F.to_date(at).alias("period_date"), value.alias("value"))
        .groupBy(*keys, "metric_id", "period_date")
        .agg(F.sum("value").alias("value"))
    )


def _series(keys: Sequence[str]):
    return Window.partitionBy(*keys, "metric_id").orderBy("period_date")


def series_statistics(series: DataFrame, keys: Sequence[str] = (), window: int = 30) -> DataFrame:
    """Add the statistics all rules need; one shuffle and one sort for all of them.

    `history_count`, trailing `mean`, `std` and `baseline_count`, `previous` (from two history points on),
    `change` against the row before, and `mean_change`, `std_change`, `change_count` over all earlier changes.
    """
    order = _series(keys)
    history = order.rowsBetween(Window.unboundedPreceding, -1)
    trailing = order.rowsBetween(-window, -1)
    before = F.lag("value").over(order)
    based = series.withColumns({
        "history_count": F.count("value").over(history),
        "baseline_count": F.count("value").over(trailing),
        "mean": F.avg("value").over(trailing),
        "std": F.stddev_pop("value").over(trailing),
        "before": before,
        "change": F.try_divide(F.col("value") - before, F.abs(before)),
        "is_latest": F.lead("period_date").over(order).isNull(),
    })
    return based.withColumns({
        "previous": F.when(F.col("history_count") >= 2, F.col("before")),
        "change_count": F.count("change").over(history),
        "mean_change": F.avg("change").over(history),
        "std_change": F.stddev_pop("change").over(history),
    }).drop("before")


def _hit(condition: Column, method: str, severity: Column, deviation: Column, baseline: Column,
         way: Column, context: dict[str, Column]) -> Column:
    entries = [x for name, value in context.items() for x in (F.lit(name), value.cast("double"))]
    return F.when(condition, F.struct(
        F.lit(method).alias("detection_method"),
        clamp(severity).alias("severity"),
        deviation.alias("deviation"),
        baseline.alias("baseline_value"),
        F.col("value").alias("actual_value"),
        way.alias("direction"),
        F.create_map(*entries).alias("context"),
    ))


def zscore_hit(threshold: float = 2.5) -> Column:
    """Trailing z-score rule as a struct column, NULL where there is no anomaly."""
    z = F.try_divide(F.col("value") - F.col("mean"), F.col("std"))
    return _hit(
        (F.col("history_count") >= MIN_HISTORY) & (F.abs(z) >= threshold),
        "z_score", F.abs(z) / 5.0, z, F.col("mean"), direction(z, "above", "below"),
        {"z_score": z, "mean": F.col("mean"), "std": F.col("std"), "baseline_window": F.col("baseline_count")},
    )


def short_change_hit(limit: float = 0.15) -> Column:
    """Rate of change where fewer than seven earlier changes exist: a plain limit."""
    change = F.col("change")
    return _hit(
        F.col("previous").isNotNull() & (F.col("change_count") < MIN_HISTORY) & (F.abs(change) > limit),
        "rate_of_change", F.abs(change) / 0.5, change, F.col("previous"), F.lit("unknown"), {"change_rate": change},
    )


def change_zscore_hit(multiplier: float = 2.0) -> Column:
    """Rate of change against mean and spread of all earlier changes."""
    z = F.try_divide(F.col("change") - F.col("mean_change"), F.col("std_change"))
    return _hit(
        F.col("previous").isNotNull() & (F.col("change_count") >= MIN_HISTORY) & (F.abs(z) >= multiplier),
        "rate_of_change", F.abs(z) / 4.0, z, F.col("previous"), F.lit("unknown"),
        {"change_rate": F.col("change"), "z_change": z, "mean_change": F.col("mean_change"),
         "std_change": F.col("std_change")},
    )


def detect_series(
    series: DataFrame,
    keys: Sequence[str] = (),
    window: int = 30,
    z_threshold: float = 2.5,
    multiplier: float = 2.0,
    latest_only: bool = False,
) -> DataFrame:
    """All hits of the statistical rules, one row per hit."""
    points = series_statistics(series, keys, window)
    if latest_only:
        points = points.where("is_latest")
    hits = F.array(zscore_hit(z_threshold), short_change_hit(), change_zscore_hit(multiplier))
    return points.select(*keys, "metric_id", "period_date", F.inline(F.array_compact(hits)))


def change_threshold(metrics: DataFrame, limit: float = 15.0) -> DataFrame:
    """Rule for metrics without history: the percent change exceeds the limit."""
    size = F.abs("change_percent")
    return metrics.where(size > limit).select(
        *[c for c in metrics.columns if c in ("tenant_id", "period_date", "metric_id", "name", "change_percent")],
        F.lit("change_threshold").alias("detection_method"),
        clamp(size / 50.0).alias("severity"),
        F.col("value").alias("actual_value"),
        direction(F.col("change_percent"), "increase", "decrease").alias("direction"),
    )


def component_series(series: DataFrame, parent: str, keys: Sequence[str] = (),
                     registry: Registry = CORE_METRICS) -> DataFrame:
    """Series of the parts of a metric: one row per day of the parent, 0.0 where a part has none."""
    parts = F.array(*[F.lit(p) for p in parts_of(parent, registry)])
    days = series.where(F.col("metric_id") == parent).select(*keys, "period_date", F.explode(parts).alias("metric_id"))
    filled = days.join(series, [*keys, "metric_id", "period_date"], "left")
    return filled.withColumn("value", F.coalesce("value", F.lit(0.0)))


def detect_components(series: DataFrame, parent: str, keys: Sequence[str] = (),
                      registry: Registry = CORE_METRICS, **rules) -> DataFrame:
    """Hits of the statistical rules on the parts of a metric, tagged with parent and component."""
    hits = detect_series(component_series(series, parent, keys, registry), keys, **rules)
    return hits.withColumns({"parent_metric": F.lit(parent), "component": F.col("metric_id")})

"""Metric computation: one aggregate over the entities, one projection for the formulas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurva.functions.coerce import exact_sum, numeric_field, template_filter
from recurva.operators.formulas import formula_column, formula_order
from recurva.operators.registry import CORE_METRICS, ID_FALLBACKS, Metric, Registry, metrics_frame


def _distinct_ids(df: DataFrame, column: str, keep: Column) -> Column:
    """Distinct ids with fallback columns; a row without any id counts as itself."""
    names = [n for n in dict.fromkeys((column, *ID_FALLBACKS)) if n in df.columns]
    if not names:
        return F.count_if(keep).cast("double")
    entity = F.coalesce(*[F.col(n).cast("string") for n in names])
    return (F.count_distinct(F.when(keep, entity)) + F.count_if(keep & entity.isNull())).cast("double")


def aggregate_column(df: DataFrame, metric: Metric) -> Column:
    """The aggregate of one direct metric over `df`; 0.0 for a kind nobody knows."""
    keep = template_filter(df, dict(metric.where))
    if metric.kind == "count_distinct":
        return _distinct_ids(df, metric.column, keep)
    if metric.kind == "sum":
        value = exact_sum(F.when(keep, numeric_field(df, metric.column)))
    elif metric.kind == "sum_positive_delta":
        value = exact_sum(F.when(keep, F.greatest(F.lit(0.0), numeric_field(df, "delta"))))
    elif metric.kind == "sum_negative_delta":
        value = F.abs(exact_sum(F.when(keep, F.least(F.lit(0.0), numeric_field(df, "delta")))))
    else:
        return F.max(F.lit(0.0))
    return F.coalesce(value, F.lit(0.0))


def wide_metrics(
    entities: DataFrame,
    keys: Sequence[str] = (),
    registry: Registry = CORE_METRICS,
    extra: DataFrame | Mapping[str, float] | None = None,
) -> DataFrame:
    """One row per key with a column per metric and `entity_count`; a single scan of the entities.

    `extra` brings further formula inputs, such as `mrr_previous`: a table keyed like the result, or plain
    numbers that hold for every key.
    """
    direct = [m for m in registry.values() if m.kind != "formula"]
    wide = entities.groupBy(*keys).agg(
        *[aggregate_column(entities, m).alias(m.metric_id) for m in direct], F.count(F.lit(1)).alias("entity_count")
    )
    names = {m.metric_id: F.col(m.metric_id) for m in direct}
    if isinstance(extra, Mapping):
        names |= {name: F.lit(float(value)) for name, value in extra.items()}
    elif extra is not None:
        wide = wide.join(extra, list(keys), "left")
        names |= {c: F.col(c).cast("double") for c in extra.columns if c not in keys}
    for metric_id in formula_order(registry):
        wide = wide.withColumn(metric_id, formula_column(registry[metric_id].formula, names))
        names[metric_id] = F.col(metric_id)
    return wide


def _decomposition(metric: Metric, registry: Registry) -> Column:
    if not metric.parts:
        return F.lit(None).cast("map<string,double>")
    pairs = [x for p in metric.parts for x in (F.lit(p), F.col(p) if p in registry else F.lit(0.0))]
    return F.create_map(*pairs)


def long_metrics(wide: DataFrame, keys: Sequence[str] = (), registry: Registry = CORE_METRICS) -> DataFrame:
    """One row per key and metric, with the values of its parts as a map."""
    rows = F.array(*[
        F.struct(F.lit(m.metric_id).alias("metric_id"), F.col(m.metric_id).alias("value"),
                 _decomposition(m, registry).alias("decomposition"))
        for m in registry.values()
    ])
    return wide.select(*keys, "entity_count", F.inline(rows))


def with_change(metrics: DataFrame) -> DataFrame:
    """Absolute and percent change against `previous_value`; percent is NULL for no or a zero base."""
    step = F.col("value") - F.col("previous_value")
    return metrics.withColumns({
        "change_absolute": step,
        "change_percent": F.try_divide(step, F.col("previous_value")) * 100,
    })


def join_previous(metrics: DataFrame, previous: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add `previous_value` from an earlier snapshot (`keys`, `metric_id`, `value`); NULL where it has none."""
    snapshot = previous.select(*keys, "metric_id", F.col("value").cast("double").alias("previous_value"))
    return metrics.join(snapshot, [*keys, "metric_id"], "left")


def lag_previous(metrics: DataFrame, period: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add `previous_value` from the period before in the same table.

    Each window holds one row per period, so the calendar bounds it.
    """
    order = Window.partitionBy(*keys, "metric_id").orderBy(period)
    return metrics.withColumn("previous_value", F.lag("value").over(order))


def compute_metrics(
    entities: DataFrame,
    keys: Sequence[str] = (),
    registry: Registry = CORE_METRICS,
    extra: DataFrame | Mapping[str, float] | None = None,
    previous: DataFrame | None = None,
    previous_keys: Sequence[str] | None = None,
) -> DataFrame:
    """All metrics of all keys (tenant, period …) in long form, with change and decomposition.

    Rows are not filtered by period: "in period" comes from the flags of `operators.periods`.
    """
    metrics = long_metrics(wide_metrics(entities, keys, registry, extra), keys, registry)
    if previous is None:
        metrics = metrics.withColumn("previous_value", F.lit(None).cast("double"))
    else:
        metrics = join_previous(metrics, previous, keys if previous_keys is None else previous_keys)
    return with_change(metrics).withColumn("grain", F.lit("daily"))


def describe_metrics(metrics: DataFrame, registry: Registry = CORE_METRICS) -> DataFrame:
    """Add name, unit and direction; an unknown metric keeps its id as name."""
    about = metrics_frame(metrics.sparkSession, registry).select("metric_id", "name", "unit", "direction")
    joined = metrics.join(F.broadcast(about), "metric_id", "left")
    return joined.withColumns({
        "name": F.coalesce("name", "metric_id"),
        "unit": F.coalesce("unit", F.lit("unknown")),
        "direction": F.coalesce("direction", F.lit("neutral")),
    })


# Lower limits of the bands per metric; for logo churn they are upper limits.
BENCHMARKS = (
    ("nrr", 130.0, 110.0, 100.0, 90.0),
    ("quick_ratio", 4.0, 2.0, 1.0, 0.5),
    ("logo_churn_rate", 1.0, 3.0, 5.0, 8.0),
)


def benchmark_bands(metrics: DataFrame, registry: Registry = CORE_METRICS) -> DataFrame:
    """Band each benchmarked metric as excellent, good, ok, concern or poor."""
    spark = metrics.sparkSession
    limits = spark.createDataFrame(
        [(*row, registry[row[0]].direction == "down_good") for row in BENCHMARKS if row[0] in registry],
        "metric_id string, excellent double, good double, ok double, concern double, low_is_good boolean",
    )
    band = F.lit("poor")
    for name in ("concern", "ok", "good", "excellent"):
        reached = F.when(F.col("low_is_good"), F.col("value") <= F.col(name)).otherwise(F.col("value") >= F.col(name))
        band = F.when(reached, name).otherwise(band)
    return metrics.join(F.broadcast(limits), "metric_id").withColumn("band", band).select(*metrics.columns, "band")

"""From records to a report in one call."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recurva.operators.metrics import with_change
from recurva.operators.registry import CORE_METRICS, ID_FALLBACKS, Registry
from recurva.plans.compute import compute_saas_metrics
from recurva.plans.detect import detect_anomalies
from recurva.plans.resolve import Resolution, resolve_entities
from recurva.sources.tabular import FIELD_ALIASES, METRIC_COLUMNS, alias_values, flags_to_boolean, metric_names

FLAGS = ("created_in_period", "existing_customer", "canceled_in_period")


@dataclass(frozen=True)
class Analysis:
    resolution: Resolution
    metrics: DataFrame
    validations: DataFrame
    anomalies: DataFrame


def entity_rows(entities: DataFrame, registry: Registry = CORE_METRICS) -> DataFrame:
    """Entities as input of the metrics: the column names they read, and flags that are booleans.

    Entities that hold a map have everything a metric reads taken out of it.
    """
    if "data" in entities.columns and isinstance(entities.schema["data"].dataType, T.MapType):
        read = {m.column for m in registry.values()} | {c for m in registry.values() for c in m.where}
        plain = {c: F.try_element_at("data", F.lit(c)) for c in (read | {"delta", *ID_FALLBACKS}) - {"", *entities.columns}}
        meanings = {METRIC_COLUMNS.get(m, m): F.coalesce(*alias_values(entities, m, "data")) for m in FIELD_ALIASES}
        rows = entities.withColumns(plain | meanings)
    else:
        rows = metric_names(entities)
    return flags_to_boolean(rows, FLAGS)


def add_history(metrics: DataFrame, history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics with their last value before as `previous_value`, together with the earlier rows."""
    earlier = history.select(*keys, "metric_id", "period_date", "value")
    last = earlier.groupBy(*keys, "metric_id").agg(F.max_by("value", "period_date").alias("previous_value"))
    current = with_change(metrics.drop("previous_value").join(last, [*keys, "metric_id"], "left"))
    return current.unionByName(earlier, allowMissingColumns=True)


def analyse(
    records: DataFrame,
    period_date: str,
    history: DataFrame | None = None,
    keys: Sequence[str] = (),
    registry: Registry = CORE_METRICS,
    extra: DataFrame | Mapping[str, float] | None = None,
    use_forest: bool = True,
) -> Analysis:
    """Resolve, compute and detect. `history` holds earlier metric rows: keys, metric_id, period_date, value."""
    resolution = resolve_entities(records)
    tables = compute_saas_metrics(entity_rows(resolution.entities, registry), keys, registry, extra)
    metrics = tables.metrics.withColumn("period_date", F.lit(period_date).cast("date"))
    if history is not None:
        judged = add_history(metrics, history, keys)
        metrics = judged.where(F.col("entity_count").isNotNull())
    else:
        judged = metrics
    return Analysis(resolution, metrics, tables.validations,
                    detect_anomalies(judged, keys, use_forest=use_forest, registry=registry))

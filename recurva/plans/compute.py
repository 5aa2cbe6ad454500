"""Metric tables with names, units and validations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from recurva.operators.metrics import compute_metrics, describe_metrics
from recurva.operators.registry import CORE_METRICS, Registry
from recurva.operators.validation import validate_metrics
from recurva.session import checkpointed


@dataclass(frozen=True)
class MetricTables:
    metrics: DataFrame
    validations: DataFrame


def compute_saas_metrics(entities: DataFrame, keys: Sequence[str] = (), registry: Registry = CORE_METRICS,
                         extra: DataFrame | Mapping[str, float] | None = None,
                         previous: DataFrame | None = None) -> MetricTables:
    """All metrics per key with their metadata, and the invariants; the metrics are computed once and checkpointed."""
    metrics = checkpointed(compute_metrics(entities, keys, registry, extra, previous))
    return MetricTables(describe_metrics(metrics, registry), validate_metrics(metrics, keys))

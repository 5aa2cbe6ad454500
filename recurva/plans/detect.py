"""Anomalies of a metric table, over all rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recurva.operators.forest import detect_forest, detect_joint_forest
from recurva.operators.registry import CORE_METRICS, Registry, metrics_frame
from recurva.operators.series import change_threshold, detect_series
from recurva.session import checkpointed

COLUMNS = ("metric_id", "period_date", "detection_method", "severity", "deviation", "baseline_value", "actual_value",
           "change_percent", "direction")
_TYPES = {"deviation": "double", "baseline_value": "double", "change_percent": "double"}


def _aligned(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    return hits.select(*keys, *[
        F.col(c) if c in hits.columns else F.lit(None).cast(_TYPES[c]).alias(c) for c in COLUMNS
    ])


def name_anomalies(anomalies: DataFrame, registry: Registry = CORE_METRICS) -> DataFrame:
    """Add the display name; a metric that is not registered keeps its id."""
    names = metrics_frame(anomalies.sparkSession, registry).select("metric_id", F.col("name").alias("metric_name"))
    known = anomalies.join(F.broadcast(names), "metric_id", "left")
    joint = F.when(F.col("detection_method") == "isolation_forest_multivariate", "Multivariate Anomaly")
    return known.withColumn("metric_name", F.coalesce(joint, "metric_name", "metric_id"))


def detect_anomalies(metrics: DataFrame, keys: Sequence[str] = (), latest_only: bool = True, use_forest: bool = True,
                     registry: Registry = CORE_METRICS) -> DataFrame:
    """Judge a long metric table `keys…, metric_id, period_date, value, change_percent`.

    The first point of a series has no history and is judged by its percent change alone. The forest looks at
    the newest point only. `latest_only=False` also judges all earlier points by the statistical rules. The joint
    forest takes the metrics of the registry, per key.

    Several rules read the table, so it is checkpointed once.
    """
    metrics = checkpointed(metrics.select(*keys, "metric_id", "period_date", "value", "change_percent"))
    series = metrics.select(*keys, "metric_id", "period_date", "value")
    order = Window.partitionBy(*keys, "metric_id").orderBy("period_date")
    first = metrics.withColumn("_place", F.row_number().over(order))
    if latest_only:
        first = first.withColumn("_place", F.col("_place") + F.when(F.lead("period_date").over(order).isNull(), 0).otherwise(1))
    alone = first.where(F.col("_place") == 1).drop("_place")
    hits = _aligned(change_threshold(alone), keys).unionByName(
        _aligned(detect_series(series, keys, latest_only=latest_only), keys))
    if use_forest:
        hits = hits.unionByName(_aligned(detect_forest(series, keys), keys))
        hits = hits.unionByName(_aligned(detect_joint_forest(series, keys, list(registry)), keys))
    return name_anomalies(hits, registry)

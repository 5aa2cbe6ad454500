"""Ranked summaries and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurva.functions import labels
from recurva.session import checkpointed

# Fixed value: what a report without anomalies says.
ALL_QUIET = "No anomalies detected. All metrics are within normal ranges."


def summarise(anomalies: DataFrame) -> DataFrame:
    """One summary per anomaly. Not sorted; see `ranked` and `most_severe`."""
    name = F.coalesce("metric_name", "metric_id")
    return anomalies.select(
        *[c for c in anomalies.columns if c in ("tenant_id", "period_date")],
        name.alias("metric"),
        labels.severity_label(F.col("severity")).alias("severity"),
        F.col("severity").alias("severity_score"),
        labels.anomaly_sentence(name, F.col("direction"), F.col("actual_value")).alias("what_happened"),
        "detection_method",
        F.col("deviation"), F.col("baseline_value").alias("baseline"), F.col("actual_value").alias("actual"),
        F.col("change_percent") if "change_percent" in anomalies.columns else F.lit(None).cast("double").alias("change_percent"),
    )


def ranked(summaries: DataFrame) -> DataFrame:
    """Most severe first; ties by metric and method, and by key where there is one."""
    keys = [c for c in ("tenant_id", "period_date") if c in summaries.columns]
    return summaries.orderBy(F.desc("severity_score"), "metric", "detection_method", *keys)


def most_severe(summaries: DataFrame) -> DataFrame:
    """The first row of the ranking."""
    return ranked(summaries).limit(1)


def explain_anomalies(anomalies: DataFrame) -> DataFrame:
    """The ranked summaries; a single row that says so where there are none. The anomalies are evaluated once."""
    summaries = checkpointed(summarise(anomalies))
    quiet = summaries.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0).select(F.lit(ALL_QUIET).alias("what_happened"))
    return ranked(summaries.unionByName(quiet, allowMissingColumns=True))


def metric_report(metrics: DataFrame) -> DataFrame:
    """Display columns for metrics that carry name, unit and direction."""
    keys = [c for c in ("tenant_id", "period_date") if c in metrics.columns]
    return metrics.select(
        *keys,
        F.coalesce("name", "metric_id").alias("metric"),
        labels.metric_text(F.col("value"), F.col("unit")).alias("value"),
        labels.change_text(F.col("change_percent")).alias("change"),
        labels.change_style(F.col("change_percent"), F.col("direction")).alias("style"),
        labels.direction_icon(F.col("direction")).alias("direction"),
    )


def anomaly_report(anomalies: DataFrame) -> DataFrame:
    """Display columns for anomalies."""
    keys = [c for c in ("tenant_id", "period_date") if c in anomalies.columns]
    line = F.concat(F.coalesce("metric_name", "metric_id"), F.lit(" — "), F.coalesce("direction", F.lit("changed")),
                    F.lit(" (severity: "), labels.fixed(F.col("severity"), 2), F.lit(")"))
    return anomalies.select(*keys, labels.severity_band(F.col("severity")).alias("band"), line.alias("line"))

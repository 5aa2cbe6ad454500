"""Labels and display text for metrics and anomalies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(severity: Column) -> Column:
    """Severity with an upper bound of one."""
    return F.least(F.lit(1.0), severity)


def direction(change: Column, up: str, down: str) -> Column:
    return F.when(change > 0, up).otherwise(down)


def severity_label(severity: Column) -> Column:
    return F.when(severity > 0.7, "Critical").when(severity > 0.4, "Warning").otherwise("Info")


def severity_band(severity: Column) -> Column:
    return F.when(severity > 0.7, "red").when(severity > 0.4, "yellow").otherwise("blue")


def plain_number(value: Column) -> Column:
    """A double as text without an exponent, with the fewest digits that tell it apart; exponents from 10^16 on."""
    short = value.cast("string")
    digits = F.regexp_replace(short.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    plain = F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.when(F.contains(short, F.lit("E")) & (F.abs(value) < 1e16) & (F.abs(value) >= 1e-4), plain).otherwise(short)


def anomaly_sentence(name: Column, way: Column, value: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(name, F.lit("Metric")), F.coalesce(way, F.lit("changed")), F.lit("to"),
                       F.coalesce(plain_number(value), F.lit("N/A")))


def fixed(value: Column, digits: int) -> Column:
    """A number with a fixed count of decimals, halves to even, without separators."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def metric_text(value: Column, unit: Column) -> Column:
    """A metric value as people read it: `$1,234`, `12.3%`, `1.25`, `1,234`."""
    whole = F.format_number(value, 0)
    return (
        F.when(unit == "currency", F.concat(F.lit("$"), whole))
        .when(unit == "percent", F.concat(fixed(value, 1), F.lit("%")))
        .when(unit == "ratio", fixed(value, 2))
        .otherwise(whole)
    )


def change_text(change_percent: Column) -> Column:
    arrow = F.when(change_percent > 0, "↑").when(change_percent < 0, "↓").otherwise("→")
    return F.when(change_percent.isNull(), "—").otherwise(
        F.concat(arrow, F.lit(" "), fixed(F.abs(change_percent), 1), F.lit("%"))
    )


def change_style(change_percent: Column, metric_direction: Column) -> Column:
    """`green` for a change in the wanted direction, `red` against it, `dim` without a change value."""
    return (
        F.when(change_percent.isNull(), "dim")
        .when((change_percent > 0) == (metric_direction == "up_good"), "green")
        .otherwise("red")
    )


def direction_icon(metric_direction: Column) -> Column:
    return F.when(metric_direction == "up_good", "📈").when(metric_direction == "down_good", "📉").otherwise("➡️")


def joint_metric_id(metric_ids: Column) -> Column:
    """Id of an anomaly found over several metrics at once: the first three ids, then `_etc`."""
    return F.concat(
        F.lit("multivariate_"),
        F.array_join(F.slice(metric_ids, 1, 3), "_"),
        F.when(F.size(metric_ids) > 3, "_etc").otherwise(""),
    )

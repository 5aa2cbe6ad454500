"""Invariants of computed metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurva.functions.labels import fixed

# The metrics read, and the names, severities and message texts of the three invariants below.
_CHECKED = ("new_mrr", "expansion_mrr", "contraction_mrr", "churn_mrr", "nrr")


def _row(name: str, passed: Column, severity: str, message: Column, details: Column | None = None) -> Column:
    details = F.lit(None).cast("map<string,double>") if details is None else details
    return F.struct(F.lit(name).alias("invariant_name"), passed.alias("passed"), F.lit(severity).alias("severity"),
                    message.alias("message"), details.alias("details"))


def mrr_decomposition() -> Column:
    """Reports the movement of MRR; it never fails."""
    new, up, down, gone = (F.col(c) for c in _CHECKED[:4])
    net = new + up - down - gone
    said = [F.concat(F.lit(f"{label}="), fixed(value, 2))
            for label, value in (("new", new), ("exp", up), ("contr", down), ("churn", gone), ("net", net))]
    message = F.concat(F.lit("MRR components: "), F.concat_ws(", ", *said))
    details = F.create_map(F.lit("new"), new, F.lit("expansion"), up, F.lit("contraction"), down, F.lit("churn"), gone)
    return _row("mrr_decomposition_sum", F.lit(True), "error", message, details)


def nrr_range() -> Column:
    """Net retention lies between 0 and 300 percent."""
    passed = (F.col("nrr") >= 0) & (F.col("nrr") <= 300)
    where = F.when(passed, "within").otherwise("outside")
    message = F.concat(F.lit("NRR is "), fixed(F.col("nrr"), 1), F.lit("% — "), where, F.lit(" expected range (0-300%)"))
    return _row("nrr_range", passed, "warning", message)


def quick_ratio_denominator() -> Column:
    """Something was lost, so the quick ratio has a denominator."""
    lost = F.col("contraction_mrr") + F.col("churn_mrr")
    passed = lost > 0
    message = F.concat(F.lit("Quick ratio denominator: "), fixed(lost, 0), F.when(passed, "").otherwise(" (zero)"))
    return _row("quick_ratio_positive_denominator", passed, "info", message)


def validate_metrics(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Three rows per key from long metrics; a metric that is missing reads as 0."""
    values = metrics.groupBy(*keys).agg(*[
        F.coalesce(F.max(F.when(F.col("metric_id") == m, F.col("value"))), F.lit(0.0)).alias(m) for m in _CHECKED
    ])
    return values.select(*keys, F.inline(F.array(mrr_decomposition(), nrr_range(), quick_ratio_denominator())))

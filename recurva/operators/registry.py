"""The metric registry: what each metric is and how the metrics hang together."""

from __future__ import annotations

import ast
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Metric:
    """One metric. `kind` is sum, count_distinct, sum_positive_delta, sum_negative_delta or formula."""

    metric_id: str
    name: str
    category: str
    unit: str
    direction: str
    kind: str
    column: str = ""
    where: Mapping[str, object] = field(default_factory=dict)
    formula: str = ""
    description: str = ""
    parts: tuple[str, ...] = ()
    related: tuple[str, ...] = ()

    @property
    def inputs(self) -> list[str]:
        """Names a formula reads, in order of appearance."""
        if not self.formula:
            return []
        names = [(n.lineno, n.col_offset, n.id) for n in ast.walk(ast.parse(self.formula, mode="eval"))
                 if isinstance(n, ast.Name)]
        return list(dict.fromkeys(name for _, _, name in sorted(names)))


_ACTIVE = {"status": "active"}
_ACTIVE_EXISTING = {"status": "active", "existing_customer": True}
_MOVEMENTS = ("new_mrr", "expansion_mrr", "contraction_mrr", "churn_mrr")

# Ids, names, categories, units, directions, filters and formulas of the ten metrics.
_CORE = (
    Metric("mrr", "Monthly Recurring Revenue", "revenue", "currency", "up_good", "sum", "mrr_amount", _ACTIVE,
           description="What all running subscriptions bring in per month.",
           parts=_MOVEMENTS, related=("arr", "arpu", "active_customers")),
    Metric("new_mrr", "New MRR", "growth", "currency", "up_good", "sum", "mrr_amount",
           {"status": "active", "created_in_period": True},
           description="The part of MRR whose subscriptions start in the period."),
    Metric("expansion_mrr", "Expansion MRR", "growth", "currency", "up_good", "sum_positive_delta", "delta",
           _ACTIVE_EXISTING, description="How much more earlier customers pay than in the period before."),
    Metric("contraction_mrr", "Contraction MRR", "retention", "currency", "down_good", "sum_negative_delta", "delta",
           _ACTIVE_EXISTING, description="How much less earlier customers pay than in the period before."),
    Metric("churn_mrr", "Churned MRR", "retention", "currency", "down_good", "sum", "mrr_amount",
           {"status": "canceled", "canceled_in_period": True},
           description="The MRR that ended with subscriptions canceled in the period."),
    Metric("nrr", "Net Revenue Retention", "retention", "percent", "up_good", "formula",
           formula="(mrr + expansion_mrr - contraction_mrr - churn_mrr) / mrr_previous * 100",
           description="This period's revenue after growth and losses, as a share of the MRR before.",
           related=("mrr", "expansion_mrr", "contraction_mrr", "churn_mrr")),
    Metric("active_customers", "Active Customers", "growth", "count", "up_good", "count_distinct",
           "customer_entity_id", _ACTIVE,
           description="Distinct customers who have an active subscription."),
    Metric("arpu", "Average Revenue Per User", "efficiency", "currency", "up_good", "formula",
           formula="mrr / active_customers", description="The MRR of an average active customer.",
           related=("mrr", "active_customers")),
    Metric("quick_ratio", "Quick Ratio", "efficiency", "ratio", "up_good", "formula",
           formula="(new_mrr + expansion_mrr) / (contraction_mrr + churn_mrr)",
           description="MRR gained for every unit of MRR lost.",
           related=_MOVEMENTS),
    Metric("logo_churn_rate", "Logo Churn Rate", "retention", "percent", "down_good", "formula",
           formula="churned_customers / active_customers_start * 100",
           description="Share of the customers at the start who are gone at the end."),
)

Registry = Mapping[str, Metric]
CORE_METRICS: Registry = {m.metric_id: m for m in _CORE}

# Columns tried, in this order, when a row lacks the id column of a distinct count.
ID_FALLBACKS = ("customer_id", "id", "entity_id", "account_id", "record_id", "customer_entity_id")


def metric_pack(metric_ids: Iterable[str], registry: Registry = CORE_METRICS) -> Registry:
    """The named metrics, with whatever metrics their formulas read."""
    wanted = list(metric_ids)
    for metric_id in wanted:
        wanted += [i for i in registry[metric_id].inputs if i in registry and i not in wanted]
    return {m: registry[m] for m in registry if m in wanted}


def edges(registry: Registry = CORE_METRICS) -> list[tuple[str, str, str, float]]:
    """(parent, child, relationship, weight): the parts of a metric, and the metrics a formula reads."""
    parts = [(m.metric_id, c, "decomposition", 1.0) for m in registry.values() for c in m.parts]
    inputs = [(m.metric_id, c, "formula_input", 1.0) for m in registry.values() for c in m.inputs if c in registry]
    return parts + inputs


def parts_of(metric_id: str, registry: Registry = CORE_METRICS) -> list[str]:
    """Children by decomposition."""
    return [child for parent, child, kind, _ in edges(registry) if parent == metric_id and kind == "decomposition"]


def parents_of(metric_id: str, registry: Registry = CORE_METRICS) -> list[str]:
    """Parents by any edge."""
    return [parent for parent, child, _, _ in edges(registry) if child == metric_id]


def parent_of(metric_id: str, registry: Registry = CORE_METRICS) -> str | None:
    """The metric this one is a part of."""
    return next((m.metric_id for m in registry.values() if metric_id in m.parts), None)


def metrics_frame(spark: SparkSession, registry: Registry = CORE_METRICS) -> DataFrame:
    """The registry as a table; it has one row per metric and is safe to broadcast."""
    rows = [(m.metric_id, m.name, m.description, m.category, m.unit, m.direction) for m in registry.values()]
    return spark.createDataFrame(
        rows, "metric_id string, name string, description string, category string, unit string, direction string"
    )


def edges_frame(spark: SparkSession, registry: Registry = CORE_METRICS) -> DataFrame:
    return spark.createDataFrame(edges(registry), "parent string, child string, relationship string, weight double")

"""Metric formulas: arithmetic over metric ids, rendered as native columns."""

from __future__ import annotations

import ast
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from recurva.operators.registry import Registry


def _render(node: ast.AST, names: Mapping[str, Column]) -> Column:
    match node:
        case ast.Expression(body=body):
            return _render(body, names)
        case ast.Constant(value=bool()):
            raise ValueError("a formula holds numbers and metric ids only")
        case ast.Constant(value=int() | float() as number):
            return F.lit(float(number))
        case ast.Name(id=name):
            return names[name]
        case ast.UnaryOp(op=ast.USub(), operand=inner):
            return -_render(inner, names)
        case ast.UnaryOp(op=ast.UAdd(), operand=inner):
            return _render(inner, names)
        case ast.BinOp(left=left, op=op, right=right):
            a, b = _render(left, names), _render(right, names)
            match op:
                case ast.Add():
                    return a + b
                case ast.Sub():
                    return a - b
                case ast.Mult():
                    return a * b
                case ast.Div():
                    return F.try_divide(a, b)
    raise ValueError("a formula may use + - * / and brackets only")


def formula_column(formula: str, names: Mapping[str, Column]) -> Column:
    """A formula as a column; 0.0 for an unknown name, a NULL input or a division by zero."""
    tree = ast.parse(formula, mode="eval")
    used = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)}
    if not used <= names.keys():
        _render(tree, {**dict.fromkeys(used, F.lit(0.0)), **names})
        return F.lit(0.0)
    return F.coalesce(_render(tree, names), F.lit(0.0))


def formula_order(registry: Registry) -> list[str]:
    """Formula metrics, each after the formula metrics it reads."""
    order: list[str] = []

    def place(metric_id: str, above: tuple[str, ...]) -> None:
        if metric_id in above:
            raise ValueError(f"formulas read each other: {' > '.join((*above, metric_id))}")
        if metric_id in order or registry[metric_id].kind != "formula":
            return
        for name in registry[metric_id].inputs:
            if name in registry:
                place(name, (*above, metric_id))
        order.append(metric_id)

    for metric_id in registry:
        place(metric_id, ())
    return order

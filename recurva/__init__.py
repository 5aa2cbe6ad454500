"""Recurring-revenue analytics as Spark DataFrame operators."""

"""Coercion of free-typed enum values, as on ingest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import lookup, norm

# Accepted spellings.
PERIOD_TYPES = {
    "instant": "instant", "point_in_time": "instant", "as_of": "instant", "month": "month", "monthly": "month", "quarter": "quarter",
    "quarterly": "quarter", "half_year": "half_year", "half_yearly": "half_year", "semi_annual": "half_year", "fiscal_year": "fiscal_year",
    "annual": "fiscal_year", "yearly": "fiscal_year", "year": "fiscal_year", "custom": "custom", "unknown": "unknown",
}
VALUE_TYPES = {
    "number": "number", "numeric": "number", "float": "number", "int": "number", "integer": "number", "amount": "number", "ratio": "number",
    "percentage": "percentage", "percent": "percentage", "%": "percentage", "pct": "percentage", "currency": "currency", "money": "currency",
    "monetary": "currency", "inr": "currency", "usd": "currency", "boolean": "boolean", "bool": "boolean",
}
STATUSES = {
    "actual": "actual", "estimate": "estimate", "estimated": "estimate", "forecast": "forecast", "forecasted": "forecast",
    "projected": "projected", "projection": "projected", "target": "target", "targeted": "target", "restated": "restated", "unknown": "unknown",
}


def period_type(c: Column) -> Column:
    return F.coalesce(lookup(F.translate(norm(c), "- ", "__"), PERIOD_TYPES), F.lit("custom"))


def value_type(c: Column) -> Column:
    return F.coalesce(lookup(norm(c), VALUE_TYPES), F.lit("text"))


def assertion_status(c: Column) -> Column:
    return F.coalesce(lookup(norm(c), STATUSES), F.lit("unknown"))

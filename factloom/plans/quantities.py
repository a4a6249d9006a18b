"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.quantities import catalog_factors, normalize_quantities, read_quantities, solve_units
from factloom.sources.tables import Scratch, read_table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every observation with a recognisable quantity, in the units of unit_catalog."""
    found = normalize_quantities(read_table(spark, folder, "observations"), read_table(spark, folder, "unit_catalog"))
    return found.select(F.col("id").alias("observation_id"), F.col("normalized_unit").alias("common_unit"), "value_key")


def p4_units(spark: SparkSession, folder: str) -> DataFrame:
    """What every unit text means, by the identity among the columns, and whether that is the only solution."""
    catalog = read_table(spark, folder, "unit_catalog")
    parsed, _ = Scratch(spark).cut(read_quantities(read_table(spark, folder, "observations"), catalog))
    return solve_units(parsed, catalog_factors(catalog))


def queries() -> dict:
    return {"p4_found": p4_found, "p4_units": p4_units}


def oracle_sql() -> dict[str, str]:
    return {}

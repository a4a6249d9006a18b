"""Units and values as the reference normalises them, quirks included.

A currency is found as a substring ("users" holds "rs" and is rupees), a scale as a token, and the empty
token counts as a scale of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import first_of, is_set, lookup, norm, one_of, staged, strip

# Scale words, currencies in their order of precedence, and names of percent.
MULTIPLIERS = {
    "": 1.0, "unit": 1.0, "units": 1.0, "thousand": 1e3, "thousands": 1e3, "k": 1e3, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5,
    "million": 1e6, "millions": 1e6, "mn": 1e6, "m": 1e6, "crore": 1e7, "crores": 1e7, "cr": 1e7,
    "billion": 1e9, "billions": 1e9, "bn": 1e9, "b": 1e9, "trillion": 1e12, "trillions": 1e12, "tn": 1e12,
}
CURRENCIES = {
    "inr": "INR", "₹": "INR", "rs": "INR", "rs.": "INR", "rupees": "INR", "usd": "USD", "$": "USD", "dollars": "USD",
    "eur": "EUR", "€": "EUR", "gbp": "GBP", "£": "GBP",
}
PERCENT = ("%", "pct", "percent", "percentage")
MONEY = ("INR", "USD", "EUR", "GBP")
NUMERIC = ("number", "percentage", "currency")


def with_unit_components(df: DataFrame, unit: str, currency: str = "currency", scale: str = "scale") -> DataFrame:
    """Adds currency and scale of a unit column; null for what is not there."""
    cleaned, symbol, percent = F.col("_u"), F.col("_symbol"), F.col("_percent")
    first = F.try_element_at(F.filter(F.split("_rest", r"[\s\-_/]+"), lambda t: t.isin(list(MULTIPLIERS))), F.lit(1))
    return staged(
        df,
        {"_u": norm(F.col(unit))},
        {"_symbol": first_of(cleaned, CURRENCIES), "_percent": one_of(cleaned, PERCENT)},
        {"_rest": F.when(symbol.isNull(), cleaned).otherwise(strip(F.replace(cleaned, symbol, F.lit(" "))))},
        {
            currency: F.when(is_set(F.col(unit)) & percent, F.lit("%")).when(is_set(F.col(unit)), lookup(symbol, CURRENCIES)),
            scale: F.when(is_set(F.col(unit)) & ~percent, first),
        },
        keep=(currency, scale),
    )


def with_value(df: DataFrame, kind: str = "value_type", amount: str = "value", unit: str = "unit", text: str = "text_value") -> DataFrame:
    """Adds amount (read from the text if missing), n_amount and n_unit; null where there is none."""
    df = with_unit_components(df, unit, "_currency", "_scale")
    is_percent, is_number = F.col(kind) == "percentage", F.col(kind).isin("number", "currency")
    first = F.nullif(F.regexp_extract(F.replace(F.col(text), F.lit(","), F.lit("")), r"[-+]?\d*\.?\d+", 0), F.lit(""))
    read = F.when(is_percent, F.regexp_replace(text, r"[^\d.-]", "")).when(is_number, first)
    plain = F.when(is_set(F.col(unit)), norm(F.col(unit))).otherwise(F.lit("unit"))
    name = F.when(F.col("_currency").isNotNull(), F.col("_currency")).when(is_set(F.col("_scale")), F.lit("unit")).otherwise(plain)
    number = F.col("amount")
    return staged(
        df,
        {"amount": F.coalesce(F.col(amount), read.try_cast("double")), "_factor": F.coalesce(lookup(F.col("_scale"), MULTIPLIERS), F.lit(1.0))},
        {
            "n_amount": F.when(is_percent, number).when(is_number, number * F.col("_factor")),
            "n_unit": F.when(is_percent, F.lit("%")).when(is_number & number.isNotNull(), name),
        },
        keep=("amount", "n_amount", "n_unit"),
    ).drop("_currency", "_scale")


def approximately_equal(a: Column, b: Column, rel: float = 1e-3, tiny: float = 1e-9) -> Column:
    """Within ``tiny``, or within ``rel`` of the larger magnitude (at least 1); false for null."""
    off = F.abs(a - b)
    size = F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    return F.coalesce((off <= tiny) | (off / size <= rel), F.lit(False))


def relative_difference(a: Column, b: Column) -> Column:
    """Difference over the larger magnitude (at least 1); 0 for null."""
    return F.coalesce(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)), F.lit(0.0))


def meaningful_normalization(amount: Column, unit: Column, normalized: Column, normalized_unit: Column) -> Column:
    """Whether normalising changed the amount or the unit."""
    changed = F.abs(amount - normalized) > 1e-9
    renamed = is_set(unit) & is_set(normalized_unit) & (F.lower(unit) != F.lower(normalized_unit))
    return F.coalesce(amount.isNotNull() & normalized.isNotNull() & (changed | renamed), F.lit(False))

"""Period labels: fiscal years from April to March, named by the year they end in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import is_set, staged, strip

# Patterns of labels.
QUALIFIER = r"(?i)(\(.*?\)|(?:up to|as on|as of|end-)\s*.+)$"
YEAR = r"fy\s*(20)?(\d{2})"
RANGE = r"20(\d{2})[-/](\d{2})"
HALF = r"(?i)h([1-2])\s*(?:fy)?\s*(20)?(\d{2})"
QUARTER = r"(?i)q([1-4])\s*(?:fy)?\s*(20)?(\d{2})"


def _group(c: Column, pattern: str, n: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, n), F.lit(""))


def with_fiscal_label(df: DataFrame, label: str, out: str = "fiscal_label") -> DataFrame:
    """Adds FYyy with a trailing qualifier kept; the stripped label if it names no fiscal year."""
    raw, qualifier, core = F.col("_raw"), F.col("_qualifier"), F.col("_core")
    tail = F.coalesce(F.concat(F.lit(" "), strip(qualifier)), F.lit(""))
    named = F.concat(F.lit("FY"), F.col("_year"), tail)
    return staged(
        df,
        {"_raw": strip(F.col(label))},
        {"_qualifier": _group(raw, QUALIFIER, 1)},
        {"_core": F.lower(F.when(qualifier.isNull(), raw).otherwise(strip(F.regexp_replace(raw, QUALIFIER, ""))))},
        {"_year": F.coalesce(_group(core, YEAR, 2), _group(core, RANGE, 2))},
        {out: F.when(~is_set(F.col(label)), F.col(label)).when(F.col("_year").isNull(), raw).otherwise(named)},
        keep=(out,),
    )


def with_period(df: DataFrame, label: str = "period_label", start: str = "period_start", end: str = "period_end") -> DataFrame:
    """Adds what a label says: fiscal_label, label_start, label_end, label_type ("custom" without dates), and
    period_key, the normalised label that is compared when there are no dates."""
    df = with_fiscal_label(df, label)
    half, half_year = F.col("_half"), F.col("_half_year").cast("int") + 2000
    quarter, quarter_year = F.col("_quarter").cast("int"), F.col("_quarter_year").cast("int") + 2000
    year = F.col("_fy") + 2000
    day = lambda y, m, d: F.make_date(y, F.lit(m), F.lit(d))
    first = F.add_months(day(quarter_year - 1, 4, 1), (quarter - 1) * 3)
    raw = F.col("_raw")
    fiscal = F.contains(F.lower(raw), F.lit("fy")) | raw.rlike(r"\d{4}-\d{2}")
    dates = F.when(F.col(start).isNotNull() & F.col(end).isNotNull(), F.concat_ws("_", F.col(start).cast("string"), F.col(end).cast("string")))
    return staged(
        df,
        {"_raw": strip(F.col(label))},
        {
            "_half": _group(raw, HALF, 1),
            "_half_year": _group(raw, HALF, 3),
            "_quarter": _group(raw, QUARTER, 1),
            "_quarter_year": _group(raw, QUARTER, 3),
            "_fy": _group(F.col("fiscal_label"), r"(?i)FY(\d{2})", 1).cast("int"),
        },
        {
            "label_start": F.when(half == "1", day(half_year - 1, 4, 1))
            .when(half == "2", day(half_year - 1, 10, 1))
            .when(quarter.isNotNull(), first)
            .when(year.isNotNull(), day(year - 1, 4, 1)),
            "label_end": F.when(half == "1", day(half_year - 1, 9, 30))
            .when(half == "2", day(half_year, 3, 31))
            .when(quarter.isNotNull(), F.last_day(F.add_months(first, 2)))
            .when(year.isNotNull(), day(year, 3, 31)),
            "label_type": F.when(half.isNotNull(), "half_year").when(quarter.isNotNull(), "quarter").when(year.isNotNull(), "fiscal_year").otherwise("custom"),
            "period_key": F.when(~is_set(F.col(label)), F.coalesce(dates, F.lit("unknown")))
            .when(quarter.isNotNull(), F.concat(F.lit("Q"), F.col("_quarter"), F.lit("_FY"), F.col("_quarter_year")))
            .when(half.isNotNull(), F.concat(F.lit("H"), half, F.lit("_FY"), F.col("_half_year")))
            .when(fiscal, F.col("fiscal_label"))
            .otherwise(F.replace(F.lower(raw), F.lit(" "), F.lit(""))),
        },
        keep=("label_start", "label_end", "label_type", "period_key"),
    )


def compare_periods(start_a: Column, end_a: Column, key_a: Column, start_b: Column, end_b: Column, key_b: Column) -> Column:
    """same, nested or different; by dates if both have them, else by keys."""
    dated = start_a.isNotNull() & end_a.isNotNull() & start_b.isNotNull() & end_b.isNotNull()
    inside = ((start_a >= start_b) & (end_a <= end_b)) | ((start_b >= start_a) & (end_b <= end_a))
    part = lambda x, y: x.rlike("^(Q[1-4]|H[12])_") & (F.substring(x, 4, 1_000) == y)
    return (
        F.when(dated & (start_a == start_b) & (end_a == end_b), "same")
        .when(dated & inside, "nested")
        .when(dated, "different")
        .when((key_a == key_b) & (key_a != "unknown"), "same")
        .when(part(key_a, key_b) | part(key_b, key_a), "nested")
        .otherwise("different")
    )


def fiscal_year_of(day: Column) -> Column:
    """The year in which the fiscal year of a date ends."""
    return F.year(day) + F.when(F.month(day) >= 4, 1).otherwise(0)

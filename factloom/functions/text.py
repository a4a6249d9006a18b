"""Small text expressions with the semantics of the reference's host language."""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as the reference strips it.
SPACE = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def norm(c: Column) -> Column:
    """Lower case without white space at either end."""
    return strip(F.lower(c))


def is_set(c: Column) -> Column:
    """Neither null nor empty; never null itself."""
    return F.coalesce(c != "", F.lit(False))


def one_of(c: Column, words) -> Column:
    return F.coalesce(c.isin(list(words)), F.lit(False))


def has_any(c: Column, words) -> Column:
    """Some of the words is a substring; false for null."""
    return F.coalesce(c.rlike("|".join(re.escape(w) for w in words)), F.lit(False))


def let(c: Column, body) -> Column:
    """body(c), with c evaluated once."""
    return F.element_at(F.transform(F.array(c), body), 1)


def first_of(c: Column, words) -> Column:
    """The first of the words that is a substring, else null."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for w in words:
        chain = chain.when(F.contains(c, F.lit(w)), F.lit(w))
    return chain


def literal(x: str | float) -> str:
    """A value as a SQL literal."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else f"{x!r}D"


def lookup(c: Column, table: dict[str, str] | dict[str, float]) -> Column:
    """The table's value; null if there is none."""
    pairs = ", ".join(f"{literal(k)}, {literal(v)}" for k, v in table.items())
    return F.element_at(F.expr(f"map({pairs})"), c)


def float_text(x: Column) -> Column:
    """A double as decimal text with at least one decimal, never in exponent form below 1e16."""
    text = x.cast("string")
    wide = F.regexp_replace(text.try_cast("decimal(38,12)").cast("string"), r"0+$", "")
    wide = F.when(wide.endswith("."), F.concat(wide, F.lit("0"))).otherwise(wide)
    return F.when(F.contains(text, F.lit("E")), wide).otherwise(text)


def short_float_text(x: Column) -> Column:
    """A double with six significant digits and no trailing zeros, in exponent form from 1e6."""
    size = F.when(x == 0, 0).otherwise(F.floor(F.log10(F.abs(x)))).cast("int")
    rounded = F.when(size == 5, F.round(x, 0))
    for k in range(4, -5, -1):
        rounded = rounded.when(size == k, F.round(x, 5 - k))
    plain = float_text(rounded.otherwise(x))
    plain = F.regexp_replace(plain, r"\.0$", "")
    mantissa = F.regexp_replace(float_text(F.round(x / F.pow(F.lit(10.0), size.cast("double")), 5)), r"\.0$", "")
    exponent = F.concat(mantissa, F.lit("e+"), F.lpad(size.cast("string"), 2, "0"))
    return F.when(size >= 6, exponent).otherwise(plain)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns behind a generator of one row, so that what uses them, filters included, never computes them again."""
    held = df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_once"))
    return held.withColumns({n: F.col(f"_once.{n}") for n in columns}).drop("_once")


def staged(df: DataFrame, *stages: dict[str, Column] | Callable[[], dict[str, Column]], keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds columns stage by stage, each of which may use the ones before, then drops all but ``keep``.

    A value that later stages use more than once is so computed once, inside generated code.
    """
    added: list[str] = []
    for stage in stages:
        columns = stage() if callable(stage) else stage
        df = df.withColumns(columns)
        added += columns
    return df.drop(*(c for c in added if c not in keep))

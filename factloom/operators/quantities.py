"""Quantities recorded in different units, converted to common ones (problem 4)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product as combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from factloom.functions.quantities import claimed, known_factors
from factloom.sources.tables import Scratch

#: A unit catalog is a list of common units; more rows than this are no catalog.
CATALOG_ROWS = 10_000
#: Unit combinations of one identity, at most.
COMBINATIONS = 100_000


#: Least rows with a stored value from which the identity speaks for a unit text, and least share of them that must fit.
EVIDENCE_ROWS, EVIDENCE_SHARE = 8, 0.7
#: The identity overrules a reading that fits no more than this share.
OVERRULED_SHARE = 0.15
#: Values agree if their decimal logarithms differ by less.
AGREE = 1e-4


def read_quantities(obs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, signature, number, stored, stored_unit, options) of all rows that hold a number, one an id.

    ``options``: what a 1 of the number may be in units of the catalog, as far as the words tell, the likeliest
    first; empty if no word is known.  ``signature`` is the same for rows that say their unit alike.
    """
    factors = catalog_factors(catalog)
    fields = ["value", "unit", "text_value", "normalized_value", "normalized_unit"]
    latest = F.struct(*([F.col("ingested_at")] if "ingested_at" in obs.columns else []), *fields)
    once = obs.where("id is not null").groupBy("id").agg(F.max(latest).alias("r")).select("id", "r.*").select("id", *fields)
    option = T.StructType([T.StructField("unit", T.StringType()), T.StructField("factor", T.DoubleType()), T.StructField("amount", T.DoubleType()), T.StructField("key", T.LongType())])
    schema = T.StructType(
        [
            T.StructField("id", obs.schema["id"].dataType), T.StructField("signature", T.StringType()), T.StructField("number", T.DoubleType()), T.StructField("stored", T.DoubleType()),
            T.StructField("stored_unit", T.StringType()), T.StructField("options", T.ArrayType(option)),
        ]
    )
    arrow = pa.schema(
        [
            ("id", to_arrow_type(obs.schema["id"].dataType)), ("signature", pa.string()), ("number", pa.float64()), ("stored", pa.float64()), ("stored_unit", pa.string()),
            ("options", pa.list_(pa.struct([("unit", pa.string()), ("factor", pa.float64()), ("amount", pa.float64()), ("key", pa.int64())]))),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v, u, t, nv, nu in zip(*(batch.column(c).to_pylist() for c in ["id", *fields]), strict=True):
                number, options, signature = claimed(v, u, t)
                if number is None:
                    continue
                found = []
                for unit, factor in options:
                    if unit in factors:
                        x = number * factor
                        found.append({"unit": unit, "factor": float(factor), "amount": float(x), "key": round(x * factors[unit])})
                if found or (nu in factors and not options):
                    out.append((i, signature, float(number), nv, nu, found))
            columns = list(zip(*out, strict=True)) or [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return once.mapInArrow(read, schema)


def catalog_factors(catalog: DataFrame) -> dict[str, int]:
    rows = catalog.select("common_unit", "key_factor").where("common_unit is not null").limit(CATALOG_ROWS + 1).collect()
    if len(rows) > CATALOG_ROWS:
        raise ValueError("the unit catalog has too many rows")
    return {r[0]: int(r[1]) for r in rows}


def solve_units(parsed: DataFrame, factors: dict[str, int]) -> DataFrame:
    """What each unit text means, by the identity number * factor = stored value among the columns.

    One row a signature: its unit and factor, the least median log residual, the rows, the share of them that
    fits, ``unique`` (false if another known factor fits alike), ``chosen``: "words" if the reading of the words
    stands, with ``n`` its place, "identity" if the identity gives it, as it does for words that are not known or
    that the stored values contradict.  Signatures that neither tells are left out.
    """
    usable = parsed.where(F.col("stored_unit").isin(list(factors)) & (F.col("number") * F.col("stored") > 0))
    positive = usable.select("signature", "stored_unit", F.abs("number").alias("number"), F.abs("stored").alias("stored"))
    known = {repr(f): f for f in known_factors()}
    solved = solve_unit_identity(positive, ["signature", "stored_unit"], "stored", ["number"], {"stored": {"1": 1.0}, "number": known}, AGREE)
    near = F.col("residual") < AGREE  # else the unit is none of the known ones: its own ratio is its factor
    learned = solved.select(
        "signature", F.col("stored_unit").alias("unit"), F.when(near, F.col("unit_number").cast("double")).otherwise(F.pow(F.lit(10.0), "ratio")).alias("factor"),
        F.when(near, F.col("residual")).otherwise(0.0).alias("residual"), (F.col("unique") & near).alias("unique"),
    )
    off = lambda amount: F.abs(F.log10(F.col("stored") / amount))
    fits = lambda amount: F.coalesce(off(amount) < AGREE, F.lit(False)).cast("double")
    judged = positive.join(learned.withColumnRenamed("unit", "stored_unit"), ["signature", "stored_unit"])
    best = judged.groupBy("signature", "stored_unit").agg(F.sum(fits(F.col("number") * F.col("factor"))).alias("fit"), F.first("factor").alias("factor"), F.first("residual").alias("residual"), F.first("unique").alias("unique"))
    total = usable.groupBy("signature").agg(F.count("*").alias("rows"))
    top = best.groupBy("signature").agg(F.max_by(F.struct(F.col("stored_unit").alias("unit"), "factor", "residual", "unique", "fit"), F.struct("fit", "stored_unit")).alias("i"))
    told = parsed.where(F.size("options") > 0).select("signature", "number", "stored", "stored_unit", F.posexplode("options").alias("n", "o"))
    right = (F.col("stored_unit") == F.col("o.unit")) & (F.col("stored") * F.col("o.amount") > 0)
    words = told.groupBy("signature", "n").agg(
        F.percentile_approx(F.when(right, off(F.col("o.amount"))), 0.5).alias("off"), F.sum(F.when(right, fits(F.col("o.amount"))).otherwise(0.0)).alias("fit"),
        F.first("o.unit").alias("unit"), F.first("o.factor").alias("factor"),
    )
    ranked = F.array_sort(F.collect_list(F.struct(F.coalesce("off", F.lit(float("inf"))).alias("off"), "n", "fit", "unit", "factor")))
    words = words.groupBy("signature").agg(ranked.alias("w"))
    joined = words.join(top, "signature", "full").join(total, "signature", "left").withColumns({"first": F.try_element_at("w", F.lit(1)), "second": F.try_element_at("w", F.lit(2))})
    rows = F.coalesce("rows", F.lit(0))
    speaks = (rows >= EVIDENCE_ROWS) & (F.col("i.fit") >= EVIDENCE_SHARE * rows)
    unheard = F.col("first").isNull() | (F.col("first.fit") <= OVERRULED_SHARE * rows)
    identity = F.coalesce(speaks & unheard, F.lit(False))
    single = F.col("second").isNull() | F.coalesce((F.col("first.off") < float("inf")) & (F.col("second.off") - F.col("first.off") > 1e-6), F.lit(False))
    pick = lambda c: F.when(identity, F.col(f"i.{c}")).otherwise(F.col(f"first.{c}"))
    out = joined.select(
        "signature", F.when(identity, "identity").otherwise("words").alias("chosen"), F.col("first.n").alias("n"), pick("unit").alias("unit"), pick("factor").alias("factor"),
        F.when(identity, F.col("i.residual")).otherwise(F.nullif("first.off", F.lit(float("inf")))).alias("residual"), F.when(identity, F.col("i.unique")).otherwise(single).alias("unique"),
        rows.alias("rows"), (pick("fit") / F.nullif(rows, F.lit(0))).alias("share"),
    )
    return out.where("unit is not null")


def normalize_quantities(obs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Converts what value, unit and text_value give together to the units of ``catalog``.

    ``obs`` has id, value, unit, text_value, normalized_value, normalized_unit; ``catalog`` has
    common_unit and key_factor.  Result: id, normalized_value double, normalized_unit, value_key long
    (the value times key_factor, rounded), unique_reading boolean; a row per id that gives a number and a
    unit of the catalog.  Rows with a null id, without a number, or without such a unit are left out.  Of
    several rows with one id the latest ingested counts if there is an ingested_at, then the largest of
    the fields, so repeated rows give one.  Empty tables give an empty result.

    What a unit text means is decided by the identity number * factor = stored value over all rows that
    say it alike (``solve_units``): of several readings of the words the one with the least median log
    residual, whether or not single stored values are stale or wrong; a text of unknown words, or one that the
    stored values contradict, has the unit and factor that they agree on.  If two readings fit alike, or nothing is
    stored, the likelier one is taken and ``unique_reading`` is false.
    """
    factors = catalog_factors(catalog)
    parsed, _ = Scratch(obs.sparkSession).cut(read_quantities(obs, catalog))
    units = solve_units(parsed, factors).select("signature", "chosen", "n", F.col("unit").alias("u"), F.col("factor").alias("f"), "unique")
    scale = F.create_map(*(F.lit(x) for item in factors.items() for x in item))
    joined = parsed.join(units, "signature")
    told = F.try_element_at("options", F.coalesce("n", F.lit(0)) + 1)
    learned = F.col("chosen") == "identity"
    amount = F.col("number") * F.col("f")
    return joined.select(
        "id", F.when(learned, amount).otherwise(told["amount"]).alias("normalized_value"), F.when(learned, F.col("u")).otherwise(told["unit"]).alias("normalized_unit"),
        F.when(learned, F.round(amount * F.element_at(scale, F.col("u"))).cast("long")).otherwise(told["key"]).alias("value_key"), F.col("unique").alias("unique_reading"),
    ).where("value_key is not null")


def solve_unit_identity(
    df: DataFrame, group: str | list[str], target: str, factors: list[str], candidates: dict[str, dict[str, float]], tolerance: float = 0.02
) -> DataFrame:
    """Finds each group's (source's) units from a physical identity target = product of factors.

    As mass = density * volume.  ``candidates`` has, for each column, the units it may be in with their
    factors to a coherent system.  Of all unit combinations, the one with the least median absolute log10
    residual is chosen; since factors are constant in a group, the group's median log ratio (``ratio``, to a
    ten-thousandth of the rows) decides, in one aggregation of bounded memory.  Result: group, unit_<column>..., residual, unique (false if another combination
    fits within ``tolerance`` as well), rows, ratio.  Rows with a null, zero or negative column are ignored;
    groups without other rows are left out; a null group is a group.
    """
    columns = [target, *factors]
    named = [list(candidates[c].items()) for c in columns]
    total = 1
    for n in named:
        total *= len(n)
    if not 0 < total <= COMBINATIONS:
        raise ValueError(f"{total} unit combinations")
    signs = [1] + [-1] * len(factors)
    shift = lambda col, sign: F.log10(F.col(col).cast("double")) * sign
    ok = F.lit(True)
    for c in columns:
        ok = ok & (F.col(c) > 0)
    ratio: Column = F.lit(0.0)
    for c, sign in zip(columns, signs, strict=True):
        ratio = ratio + shift(c, sign)
    by = [group] if isinstance(group, str) else group
    medians = df.where(ok).groupBy(*by).agg(F.percentile_approx(ratio, 0.5).alias("_r"), F.count("*").alias("rows"))
    options = []
    for combo in combinations(*named):
        offset = sum(sign * math.log10(f) for (_, f), sign in zip(combo, signs, strict=True))
        options.append(F.struct(F.lit(offset).alias("offset"), *(F.lit(u).alias(f"unit_{c}") for (u, _), c in zip(combo, columns, strict=True))))
    units = [f"unit_{c}" for c in columns]
    scored = F.array_sort(
        F.transform(F.array(*options), lambda o: F.struct(F.abs(F.col("_r") + o["offset"]).alias("residual"), *(o[u].alias(u) for u in units)))
    )
    best = medians.withColumn("_s", scored)
    second = F.col("_s")[1]["residual"] if total > 1 else F.lit(float("inf"))
    return best.select(
        *by, *(F.col("_s")[0][u].alias(u) for u in units), F.col("_s")[0]["residual"].alias("residual"),
        (second > tolerance).alias("unique"), "rows", F.col("_r").alias("ratio"),
    )

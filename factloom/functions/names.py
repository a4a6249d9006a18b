"""Names of entities and concepts, families of related concepts, qualifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import has_any, is_set, lookup, norm, one_of

# Other names of entities and concepts.
ENTITY_NAMES = {
    "delhivery": "delhivery limited", "delhivery ltd": "delhivery limited", "rbi": "reserve bank of india",
    "imf": "international monetary fund", "fund": "international monetary fund", "goi": "government of india",
    "ministry of finance": "government of india", "mof": "government of india", "republic of india": "india", "indian economy": "india",
}
CONCEPT_NAMES = {
    "sales": "revenue", "turnover": "revenue", "total turnover": "revenue", "total sales": "revenue", "total revenue": "revenue",
    "real gdp growth rate": "real gdp growth", "gdp growth": "real gdp growth", "gdp growth rate": "real gdp growth",
    "cpi inflation": "headline cpi inflation", "consumer price index inflation": "headline cpi inflation", "cad": "current account deficit",
    "express parcel shipment volume": "express parcel volume", "team size": "total workforce", "employees": "total workforce",
    "total employees": "total workforce",
}
# Families of related concepts.
MACRO = ("real gdp growth", "gdp growth", "real gdp growth rate", "real gva growth", "gva growth", "aggregate gdp growth", "economic growth", "national income")
SECTORS = ("services", "manufacturing", "agriculture", "industry", "construction", "mining", "electricity")
SECTOR_MEASURES = ("gva", "growth", "output")
DEMAND = ("gfcf", "gross fixed capital formation", "capital outlay", "consumption expenditure", "investment", "gross capital formation", "gcf", "saving", "household financial saving")
REVENUE = ("revenue", "revenue from operations", "total revenue", "total turnover", "sales")
SEGMENTS = ("traded goods", "express parcel", "part truckload", "ptl", "supply chain", "freight")
INFLATION = ("headline cpi inflation", "cpi inflation", "headline inflation", "cpi", "inflation")
INFLATION_PARTS = ("food inflation", "core cpi inflation", "core inflation", "fuel inflation", "services inflation", "wpi inflation", "wholesale price index")
CREDIT = ("credit growth", "bank credit", "non-food credit", "deposit growth", "deposits", "advances")
HEALTH = ("gross npa", "gnpa", "net npa", "nnpa", "crar", "capital adequacy", "capital to risk weighted assets", "provision coverage ratio", "pcr")
FISCAL = ("fiscal deficit", "revenue deficit", "primary deficit", "tax revenue", "capex", "capital outlay")
# Words by which concepts differ.
DELTA = ("growth", "expansion", "contraction", "deflation", "decline", "increase", "decrease")
SPECIFIC = (
    "traded", "goods", "contract", "contracts", "customer", "customers", "food", "fuel", "core", "services", "agriculture", "manufacturing",
    "industrial", "mining", "utilities", "rural", "urban", "primary", "headline", "wholesale", "consumer", "retail", "effective",
)


def canonical_entity(name: Column) -> Column:
    key = norm(name)
    return F.coalesce(lookup(key, ENTITY_NAMES), key)


def canonical_concept(name: Column) -> Column:
    key = norm(name)
    return F.coalesce(lookup(key, CONCEPT_NAMES), key)


def alias_list(c: Column) -> Column:
    """array<string>: a JSON list, a list in quotes of either kind, or items with semicolons; null if there are none."""
    s = F.trim(c)
    quoted = F.filter(F.split(F.substring(s, F.lit(3), F.length(s) - 4), "['\"], *['\"]"), lambda x: x != "")
    items = F.filter(F.transform(F.split(s, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return (
        F.when(~is_set(s) | s.isin("[]", "null"), F.lit(None))
        .when(s.startswith('["'), F.from_json(s, "array<string>"))
        .when(s.startswith("['") & s.endswith("]"), quoted)
        .when(~s.startswith("["), items)
    )


def family_roles(name: Column) -> Column:
    """array<struct<family, role>>: a concept's places in the families; L goes with R, and B with B."""
    name = norm(name)
    sector = has_any(name, SECTORS) & has_any(name, SECTOR_MEASURES)
    places = [
        ("sector", "L", one_of(name, MACRO)), ("sector", "R", sector),
        ("demand", "L", one_of(name, MACRO)), ("demand", "R", has_any(name, DEMAND)),
        ("revenue", "L", one_of(name, REVENUE)), ("revenue", "R", has_any(name, SEGMENTS)),
        ("inflation", "L", has_any(name, INFLATION)), ("inflation", "R", has_any(name, INFLATION_PARTS)),
        ("credit", "B", has_any(name, CREDIT)), ("health", "B", has_any(name, HEALTH)), ("fiscal", "B", has_any(name, FISCAL)),
    ]
    return F.array_compact(F.array(*(F.when(c, F.struct(F.lit(f).alias("family"), F.lit(r).alias("role"))) for f, r, c in places)))


def sibling_concepts(a: Column, b: Column) -> Column:
    """Different concepts of one family, by their canonical names."""
    meets = lambda x, y: (x["family"] == y["family"]) & (F.concat(x["role"], y["role"]).isin("LR", "RL", "BB"))
    related = F.exists(family_roles(a), lambda x: F.exists(family_roles(b), lambda y: meets(x, y)))
    return F.coalesce((norm(a) != norm(b)) & related, F.lit(False))


def divergent_qualifiers(a: Column, b: Column) -> Column:
    """One names a change and the other doesn't, or their specific words differ."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), 1)
    delta = lambda c: F.arrays_overlap(words(c), F.array(*map(F.lit, DELTA)))
    specific = lambda c: F.sort_array(F.array_intersect(words(c), F.array(*map(F.lit, SPECIFIC))))
    return (delta(a) != delta(b)) | (specific(a) != specific(b))


def scope_keys(consolidation: Column, geography: Column, level: Column) -> dict[str, Column]:
    """What of an observation's scope is compared; null where it says nothing."""
    known = F.when((consolidation != "") & (consolidation != "unknown"), F.lower(consolidation))
    return {
        "s_cons": known,
        "s_raw": F.lower(F.coalesce(consolidation, F.lit(""))),
        "geo": F.nullif(norm(geography), F.lit("")),
        "s_level": F.nullif(norm(level), F.lit("")),
    }


def scope_match(a: str = "_a", b: str = "_b") -> Column:
    """match, different_consolidation or different_geography, of two observations' scope keys.

    A difference of level alone is called one of geography.
    """
    differ = lambda c: F.coalesce(F.col(c + a) != F.col(c + b), F.lit(False))
    other = F.when(F.col("s_raw" + a) != F.col("s_raw" + b), "different_consolidation").otherwise("different_geography")
    return F.when(differ("s_cons") | differ("geo") | differ("s_level"), other).otherwise("match")

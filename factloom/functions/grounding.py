"""Row-level checks of an extracted claim against its evidence quote.

Each check gives null if the claim passes, else the reason.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import first_of, float_text, has_any, is_set, let, norm, short_float_text, strip

# Words that turn a positive number in a text negative.
NEGATIONS = (
    "contracting", "contracted", "contraction", "deflation", "deflated", "declined", "decline", "declining", "fell", "fall", "falling",
    "dropped", "drop", "dropping", "decrease", "decreased", "decreasing", "negative", "down by", "depreciated", "decelerated",
)
# Fixed values: (context, concept, exempt): a concept broader than its context.
BROADENING = (
    ("services", "gdp", "services"), ("services sector", "gdp growth", "services"), ("agriculture", "gdp", "agriculture"),
    ("manufacturing", "gdp", "manufacturing"), ("industrial", "gdp", "industrial"), ("r&d", "gdp growth", "r&d"),
    ("research & development", "gdp growth", "research"), ("research and development", "gdp growth", "research"),
    ("expenditure in gdp", "gdp growth", "expenditure"), ("share in gdp", "gdp growth", "share"), ("as % of gdp", "gdp growth", "as %"),
)
DELTAS = ("growth", "expansion", "contraction", "deflation", "decline")
GROWTH = (
    "growth", "grew", "grow", "expanded", "expansion", "contracting", "contracted", "contraction", "deflation", "deflated", "declined",
    "decline", "declining", "fell", "fall", "falling", "increase", "increased", "decreasing", "decreased", "decrease", "dropped", "drop",
    "uptick", "moderated", "moderating", "y-o-y", "yoy", "m-o-m", "mom", "q-o-q", "qoq",
)
HISTORICAL = ("historical", "previous year", "a year ago")
MARKERS = (
    "likely to", "expected to", "projected", "projection", "forecast", "anticipated", "estimated to", "is likely", "are likely", "will likely",
    "advance estimate", "provisional", "revised estimate", "estimated at", "budget estimate", "budgeted", "target",
)
# Headings that hold no data, and where such a heading starts.
HEADERS = (
    r"income statement for the|balance sheet as at|statement of .+ for the|notes to .+ financial statements|cash flow statement for the"
    r"|for the year ended|for the period ended|as at \w+ \d{1,2},?\s*\d{4}|annual report \d{4}|table of contents|financial highlights"
)
HEADER_START = (
    r"(?i)(income statement|balance sheet|statement of|for the year ended|for the period ended|as at|annual report|table of contents"
    r"|financial highlights|notes to|cash flow statement).*"
)
TEMPORAL = (
    r"(fy\s*\d{2,4}|20\d{2}|q[1-4]|h[12]|january|february|march|april|may|june|july|august|september|october|november|december"
    r"|\d{4}\s*[-–]\s*\d{2,4})"
)
DIMENSIONLESS = (
    "index", "fi-index", "pmi", "ccpi", "ratio", "score", "rank", "ranking", "standard deviation", "std dev", "skewness", "kurtosis",
    "parameter", "elasticity", "multiplier",
)


def plain_minus(quote: Column) -> Column:
    """One kind of minus sign, next to its number."""
    s = F.regexp_replace(quote, r"\(\s*-\s*\)", "-")
    return F.regexp_replace(F.translate(s, "−–—", "---"), r"-\s+(?=\d)", "-")


def _comma_forms(digits: Column) -> tuple[Column, Column]:
    western = F.regexp_replace(digits, r"(?<=\d)(?=(\d{3})+$)", ",")
    indian = F.regexp_replace(digits, r"(?<=\d)(?=(\d\d)*\d{3}$)", ",")
    return western, indian


def value_reason(kind: Column, value: Column, quote: Column) -> Column:
    """The quote must hold the number in some notation, or its magnitude with a word of decline."""
    return let(plain_minus(F.translate(strip(F.coalesce(quote, F.lit(""))), "\n\r", "  ")), lambda text: _value_reason(kind, value, text))


def _value_reason(kind: Column, value: Column, text: Column) -> Column:
    whole = value == F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("double")
    size = F.abs(value)
    digits = F.floor(size).cast("decimal(38,0)").cast("string")
    western, indian = _comma_forms(digits)
    long = F.length(digits) > 3
    spelled = float_text(value)
    decimals = F.when(~whole & F.contains(spelled, F.lit(".")), F.regexp_extract(spelled, r"\..*$", 0))
    forms = F.array_compact(
        F.array(
            F.when(whole, F.concat(F.when(value < 0, "-").otherwise(""), digits)),
            spelled,
            short_float_text(value),
            F.when(long, western),
            F.when(long, indian),
        )
    )
    forms = F.concat(forms, F.array_compact(F.transform(forms, lambda f: F.concat(f, decimals))))
    direct = F.exists(forms, lambda f: F.contains(text, f))
    positive = F.array_compact(F.array(F.when(whole, digits), float_text(size), short_float_text(size)))
    lower = F.lower(text)
    near_minus = F.exists(positive, lambda f: F.regexp_like(text, F.concat(F.lit(r"-\s*"), F.replace(F.replace(f, F.lit("."), F.lit(r"\.")), F.lit("+"), F.lit(r"\+")), F.lit(r"\b"))))
    negated = (value < 0) & ((F.exists(positive, lambda f: F.contains(text, f)) & has_any(lower, NEGATIONS)) | near_minus)
    return (
        F.when(kind == "text", F.lit(None).cast("string"))
        .when(text == "", F.lit("Evidence quote is empty"))
        .when(value.isNull() | direct | negated, F.lit(None).cast("string"))
        .otherwise(F.lit("Value not found in evidence quote"))
    )


def period_reason(label: Column, quote: Column) -> Column:
    """The quote must hold the claimed period, or no period at all; a part of a year is no year."""
    bad = F.lit("Period not grounded in evidence")
    fine = F.lit(None).cast("string")
    text = norm(F.coalesce(quote, F.lit("")))
    period = norm(label)
    claimed_year = period.rlike(r"^fy\s*\d{2,4}$")
    sub = text.rlike(r"\bq[1-4]\b") | text.rlike(r"\bh[12]\b")
    year = F.nullif(F.regexp_extract(period, r"^fy\s*(\d{2,4})", 1), F.lit(""))
    short = F.right(year, F.lit(2))
    before = F.concat(F.lit("20"), F.lpad((short.cast("int") - 1).cast("string"), 2, "0"), F.lit("-"), short)
    loose = F.concat(F.lit("20"), (short.cast("int") - 1).cast("string"), F.lit("-"), short)

    def spans(v: Column) -> Column:
        at = F.call_function("instr", text, v)
        head = F.substring(text, F.greatest(at - 5, F.lit(1)), F.least(F.lit(5), at - 1))
        return F.coalesce((at > 0) & ~(strip(head).rlike("q[1-4]|h[12]")), F.lit(False))

    quarter = F.nullif(F.regexp_extract(period, r"^(q[1-4])\s*[:\-]?\s*(.+)", 1), F.lit(""))
    half = F.nullif(F.regexp_extract(period, r"^(h[12])", 1), F.lit(""))
    first = F.nullif(F.regexp_extract(period, r"^(\d{4})\s*[-–]\s*(\d{2,4})", 1), F.lit(""))
    last = F.nullif(F.regexp_extract(period, r"^(\d{4})\s*[-–]\s*(\d{2,4})", 2), F.lit(""))
    holds = lambda x: F.coalesce(F.contains(text, x), F.lit(False))
    return (
        F.when(~is_set(label), fine)
        .when(text == "", F.lit("Period claimed but evidence quote is empty"))
        .when(F.contains(text, period), fine)
        .when(claimed_year & sub, bad)
        .when(spans(loose) | spans(before), fine)
        .when(holds(quarter) | holds(half) | (holds(first) & holds(last)), fine)
        .when(~text.rlike(TEMPORAL), fine)
        .otherwise(bad)
    )


def concept_reason(concept: Column, source: Column, quote: Column) -> Column:
    """No broader concept than the evidence speaks of, and no change without a word of change."""
    name = norm(F.coalesce(concept, F.lit("")))
    text = norm(F.coalesce(quote, F.lit("")))
    context = F.concat(norm(F.coalesce(source, F.lit(""))), F.lit(" "), text)
    chain = F.when(name == "", F.lit(None).cast("string"))
    for around, claimed, exempt in BROADENING:
        hit = F.contains(context, F.lit(around)) & F.contains(name, F.lit(claimed)) & ~F.contains(name, F.lit(exempt))
        chain = chain.when(hit, F.concat(F.lit("Concept '"), concept, F.lit(f"' may not match source evidence context ('{around}')")))
    changed = has_any(text, GROWTH)
    for word in DELTAS:
        chain = chain.when(F.contains(name, F.lit(word)) & ~changed, F.lit(f"Concept claims '{word}' but no growth or change terms found in evidence quote"))
    return chain


def status_reason(status: Column, concept: Column, label: Column, value: Column, value_text: Column, quote: Column) -> Column:
    """An actual figure must not be told in words of forecast, estimate or target, unless it is a past baseline."""
    text = norm(F.coalesce(quote, F.lit("")))
    period = norm(F.coalesce(label, F.lit("")))
    past = has_any(norm(F.coalesce(concept, F.lit(""))), HISTORICAL)
    past = past | period.rlike(r"\b(20[0-1]\d|202[0-4]|fy[0-1]\d|fy2[0-4])\b") | period.rlike(r"\b\d{4}\s*[-–]\s*(?:19|20|21|22|23|24)\b")
    said = F.coalesce(short_float_text(value), value_text, F.lit("None"))
    escaped = F.regexp_replace(said, r"([.^$*+?()\[\]{}|\\/-])", r"\\$1")
    baseline = F.regexp_like(text, F.concat(F.lit(r"(?:from|below|compared (?:with|to)|as against)\s+[^.;]*?\b"), escaped, F.lit(r"\b")))
    marker = first_of(text, MARKERS)
    conflict = F.concat(F.lit("Assertion status 'actual' conflicts with evidence language: '"), marker, F.lit("'"))
    exempt = (status != "actual") | status.isNull() | (text == "") | past | F.coalesce(baseline, F.lit(False))
    return F.when(~exempt, conflict)


def metadata_reason(quote: Column) -> Column:
    """A value read from a heading is none."""
    text = norm(F.coalesce(quote, F.lit("")))
    left = F.length(strip(F.regexp_replace(text, HEADER_START, "")))
    return F.when(text.rlike(HEADERS) & (left < 30), F.lit("Value likely extracted from document metadata, not a data point"))


def grounding_reasons(kind: Column, value: Column, value_text: Column, label: Column, concept: Column, source: Column, status: Column, quote: Column) -> Column:
    """Every check's reason, in order; an empty array if the claim is grounded."""
    return F.array_compact(
        F.array(
            value_reason(kind, value, quote), period_reason(label, quote), concept_reason(concept, source, quote),
            status_reason(status, concept, label, value, value_text, quote), metadata_reason(quote),
        )
    )

"""Reading quantities: numbers and units as they are written in filings.

Plain Python on single strings; ``operators.quantities`` applies it to columns in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

# Scale words.
SCALES = {
    **dict.fromkeys(("hundred", "hundreds"), 10**2),
    **dict.fromkeys(("thousand", "thousands", "k", "'000", "000", "'000s", "000s"), 10**3),
    **dict.fromkeys(("lakh", "lakhs", "lac", "lacs"), 10**5),
    **dict.fromkeys(("million", "millions", "mn", "mln", "mio"), 10**6),
    **dict.fromkeys(("crore", "crores", "cr", "crs"), 10**7),
    **dict.fromkeys(("billion", "billions", "bn", "bln"), 10**9),
    **dict.fromkeys(("trillion", "trillions", "trn", "tn", "tln"), 10**12),
}
_FOOT = Fraction(3048, 10000)
_ACRE = Fraction(40468564224, 10**7)
# Units by name, as (common unit, factor to it).
UNITS: dict[str, tuple[str, Fraction]] = {
    **dict.fromkeys(("inr", "rs", "₹", "rupee", "rupees", "₨"), ("INR", Fraction(1))),
    **dict.fromkeys(("usd", "us$", "$", "dollar", "dollars"), ("USD", Fraction(1))),
    **dict.fromkeys(("eur", "€", "euro", "euros"), ("EUR", Fraction(1))),
    **dict.fromkeys(("gbp", "£", "pound", "pounds", "sterling"), ("GBP", Fraction(1))),
    **dict.fromkeys(("%", "pct", "percent", "percentage", "pp", "ppt", "ppts", "percents"), ("%", Fraction(1))),
    **dict.fromkeys(("bp", "bps", "basispoint"), ("%", Fraction(1, 100))),
    **dict.fromkeys(("‰", "permille"), ("%", Fraction(1, 10))),
    **dict.fromkeys(
        (
            "nos", "employee", "employees", "person", "persons", "people", "household", "households",
            "vehicle", "vehicles", "shipment", "shipments", "parcel", "parcels", "account", "accounts", "customer", "customers",
            "pincode", "worker", "workers", "job", "jobs", "passenger", "passengers", "client", "clients", "branch", "branches",
            "student", "students", "home", "homes", "truck", "trucks", "user", "users", "subscriber", "subscribers", "container",
            "containers", "teu", "teus", "order", "orders", "transaction", "transactions", "village", "villages", "outlet",
            "outlets", "store", "stores", "headcount", "item", "items", "piece", "pieces", "pcs",
        ),
        ("count", Fraction(1)),
    ),
    **dict.fromkeys(("tonne", "tonnes", "ton", "tons", "mt", "t"), ("tonne", Fraction(1))),
    **dict.fromkeys(("kilotonne", "kilotonnes", "kt"), ("tonne", Fraction(1000))),
    **dict.fromkeys(("mmt", "megatonne", "megatonnes"), ("tonne", Fraction(10**6))),
    **dict.fromkeys(("kg", "kgs", "kilogram", "kilograms", "kilo", "kilos"), ("tonne", Fraction(1, 1000))),
    **dict.fromkeys(("quintal", "quintals", "qtl", "qtls"), ("tonne", Fraction(1, 10))),
    **dict.fromkeys(("gram", "grams", "gm", "gms"), ("tonne", Fraction(1, 10**6))),
    **dict.fromkeys(("lb", "lbs"), ("tonne", Fraction(45359237, 10**11))),
    **dict.fromkeys(("oz", "ounce", "ounces"), ("tonne", Fraction(45359237, 16 * 10**11))),
    **dict.fromkeys(("km", "kms", "kilometre", "kilometres", "kilometer", "kilometers"), ("km", Fraction(1))),
    **dict.fromkeys(("m", "metre", "metres", "meter", "meters", "mtr", "mtrs"), ("km", Fraction(1, 1000))),
    **dict.fromkeys(("mi", "mile", "miles"), ("km", Fraction(1609344, 10**6))),
    **dict.fromkeys(("ft", "foot", "feet"), ("km", _FOOT / 1000)),
    **dict.fromkeys(("yd", "yds", "yard", "yards"), ("km", _FOOT * 3 / 1000)),
    **dict.fromkeys(("sqm", "sqmtr", "sqmtrs"), ("sq_m", Fraction(1))),
    **dict.fromkeys(("sqft", "sft"), ("sq_m", _FOOT**2)),
    "msf": ("sq_m", _FOOT**2 * 10**6),
    **dict.fromkeys(("sqkm", "sqkms"), ("sq_m", Fraction(10**6))),
    "sqmi": ("sq_m", (Fraction(1609344, 1000)) ** 2),
    **dict.fromkeys(("ha", "hectare", "hectares"), ("sq_m", Fraction(10**4))),
    **dict.fromkeys(("acre", "acres"), ("sq_m", _ACRE)),
    **dict.fromkeys(("kwh", "kilowatthour"), ("kwh", Fraction(1))),
    **dict.fromkeys(("mwh", "megawatthour"), ("kwh", Fraction(10**3))),
    **dict.fromkeys(("gwh", "gigawatthour"), ("kwh", Fraction(10**6))),
    **dict.fromkeys(("twh", "terawatthour"), ("kwh", Fraction(10**9))),
    **dict.fromkeys(("h", "hr", "hrs", "hour", "hours"), ("hour", Fraction(1))),
    **dict.fromkeys(("min", "mins", "minute", "minutes"), ("hour", Fraction(1, 60))),
    **dict.fromkeys(("second", "seconds", "sec", "secs"), ("hour", Fraction(1, 3600))),
    **dict.fromkeys(("day", "days"), ("hour", Fraction(24))),
    **dict.fromkeys(("week", "weeks"), ("hour", Fraction(168))),
}
# Words that name a measure without a common unit.
NO_UNIT = frozenset("index score scores rank ranks ranked ranking times x star stars multiple multiples ratio rating".split())
# Readings of an unclear token besides the one in UNITS, which comes first.
UNCLEAR: dict[str, list[tuple[str, Fraction]]] = {"m": [("scale", Fraction(10**6))], "t": [("scale", Fraction(10**3))]}
# Numbers in words.
NUMBER_WORDS = {
    w: n
    for n, w in enumerate(
        "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    )
} | {w: 20 + 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split())}

_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?"
_YEAR = r"(?:19|20)\d{2}"
#: What holds digits but no quantity: references, dates, periods.
_NOISE = re.compile(
    rf"""\(?\b(?:(?:please\s+)?(?:see|refer|as\s+per|vide|cf)\.?\s+(?:to\s+)?)?(?:foot)?(?:notes?|schedule|tables?|annex(?:ure)?|para(?:graph)?|section|page|item|chart|figure|appendix)\s*(?:no\.?\s*)?[\divx]+(?:\.\d+)*[a-z]?\b\)?
    |\bas\s+reported\s+in\s+\S+
    |\b\d{{1,2}}(?:st|nd|rd|th)?\s+{_MONTH},?\s*{_YEAR}\b
    |\b{_MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+{_YEAR}\b
    |\b{_MONTH}[\s'-]*{_YEAR}\b
    |\b{_YEAR}-\d{{2}}-\d{{2}}\b
    |\b\d{{1,2}}[./]\d{{1,2}}[./]{_YEAR}\b
    |\b[qh][1-4]\s*:?\s*(?:fy)?\s*'?(?:{_YEAR}|\d{{2}})(?:\s*[-/–]\s*(?:\d{{4}}|\d{{2}}))?\b
    |\bfy\s*'?(?:{_YEAR}|\d{{2}})(?:\s*[-/–]\s*(?:\d{{4}}|\d{{2}}))?\b
    |\b(?:19|20)\d{{2}}\s*[-/–]\s*(?:\d{{4}}|\d{{2}})\b(?![.,]\d)
    |\b(?:in|during|for|of|since|by)\s+{_YEAR}\b(?![.,]\d|\s*[-/–]\s*\d)
    """,
    re.X,
)
_NUMBER = re.compile(r"\d{1,3}(?:[   ]\d{3})+(?:[.,]\d+)?(?![\d.,]*\d)|\d[\d.,]*")
_SCALE_DIGITS = re.compile(r"(?<![\d.,])['’‘`]000s?\b|(?<![\d.,])000s?\b")
_TOKEN = re.compile(r"'?000s?|[a-z]+|[₹₨$£€%‰]|x")
_JOIN = (
    (re.compile(r"basis[\s-]*points?"), "basispoint"),
    (re.compile(r"per[\s-]*mil(?:le|l)\b"), "permille"),
    (re.compile(r"per[\s-]*cent(?:age)?"), "percent"),
    (re.compile(r"(?:percentage|percent|%)[\s-]*(?:points?|pts?)\b"), "percent"),
    (re.compile(r"index[\s-]*points?"), "index"),
    (re.compile(r"pin[\s-]*codes?"), "pincode"),
    (re.compile(r"(kilo|mega|giga|tera)watt[\s-]*hours?"), r"\1watthour"),
    (re.compile(r"\bsq(?:uare)?\.?\s*-?(?:ft|feet|foot)\b"), "sqft"),
    (re.compile(r"\bsq(?:uare)?\.?\s*-?(?:m|mtrs?|met(?:re|er)s?)\b"), "sqm"),
    (re.compile(r"\bsq(?:uare)?\.?\s*-?(?:kms?|kilomet(?:re|er)s?)\b"), "sqkm"),
    (re.compile(r"\bsq(?:uare)?\.?\s*-?(?:mi|miles?)\b"), "sqmi"),
    (re.compile(r"\bkm2\b"), "sqkm"),
    (re.compile(r"\bm2\b"), "sqm"),
    (re.compile(r"\bft2\b"), "sqft"),
    (re.compile(r"metric\s+(tonn?e?s?|tons?)\b"), r"\1"),
    (re.compile(r"\bus\s*\$"), "usd "),
    (re.compile(r"\bus\s+dollars?"), "usd"),
    (re.compile(r"pounds?\s+sterling"), "gbp"),
)


class Reading(NamedTuple):
    """What a string says: a number, scales it may name and units it may mean, the likeliest first."""

    number: Fraction | None
    scales: tuple[Fraction, ...]
    units: tuple[tuple[str, Fraction], ...]


NOTHING = Reading(None, (), ())


def fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower().replace("’", "'").replace("‘", "'").replace("`", "'")


def read_number(digits: str) -> Fraction | None:
    """A number with grouping as in 1,23,456.7, 1,234,567.8, 1.234.567,8 or 1 234,5; a lone dot is decimal."""
    s = re.sub(r"[   ]", "", digits).rstrip(".,")
    comma, dot = s.rfind(","), s.rfind(".")
    if comma >= 0 and dot >= 0:
        group, point = (",", ".") if dot > comma else (".", ",")
        s = s.replace(group, "").replace(point, ".") if s.count(point) == 1 else s.replace(",", "").replace(".", "")
    elif comma >= 0:
        grouped = re.fullmatch(r"\d{1,3}(?:,\d{2,3})*,\d{3}", s)
        s = s.replace(",", "") if grouped else s.replace(",", ".") if s.count(",") == 1 else s.replace(",", "")
    elif s.count(".") > 1:
        s = s.replace(".", "")
    try:
        return Fraction(s)
    except (ValueError, ZeroDivisionError):
        return None


_STRONG = ("INR", "USD", "EUR", "GBP", "%")


def _units(text: str) -> tuple[tuple[Fraction, ...], tuple[tuple[str, Fraction], ...]]:
    for pattern, name in _JOIN:
        text = pattern.sub(name, text)
    tokens = _TOKEN.findall(text)
    scale: Fraction | None = None
    last = -2
    unit: tuple[str, Fraction] | None = None
    unit_token = ""
    for n, t in enumerate(tokens):
        if t in SCALES:
            if scale is None:
                scale = Fraction(SCALES[t])
            elif last == n - 1 and SCALES[t] > 100 and scale != SCALES[t]:  # lakh crore
                scale *= SCALES[t]
            last = n
        elif t in NO_UNIT:
            return (), ()
        elif t in UNITS and (unit is None or (UNITS[t][0] in _STRONG and unit[0] not in _STRONG)):
            unit, unit_token = UNITS[t], t
    unclear = {t for t in tokens if t in UNCLEAR and t != unit_token}
    scales = (scale,) if scale is not None else tuple(f for t in sorted(unclear) for _, f in UNCLEAR[t])
    return scales, (unit,) if unit is not None else ()


@lru_cache(maxsize=200_000)
def read_unit(text: str) -> tuple[tuple[Fraction, ...], tuple[tuple[str, Fraction], ...]]:
    """Scales and units of a unit string; no scale if none is named."""
    return _units(_SCALE_DIGITS.sub(" thousand ", fold(text)))


def read_text(text: str) -> Reading:
    """Number, scale and units of a free text."""
    s = _NOISE.sub(" ", fold(text))
    s = re.sub(r"^\s*(?:c\.|ca\.|circa)\s*", " ", s)
    s = _SCALE_DIGITS.sub(" thousand ", s)
    m = next((m for m in _NUMBER.finditer(s) if not s[: m.start()].endswith(("m^", "co"))), None)
    number: Fraction | None = None
    if m:
        number = read_number(m[0])
        before, after = s[: m.start()], s[m.start() + len(m[0].rstrip(".,")) :]
        signed = re.search(r"(?:^|[\s(:])(?:\(\s*[-−–]\s*\)|[-−–])\s*(?:[₹$£€]|rs\.?|inr|usd|us\$)?\s*$", before)
        bracket = re.search(r"\(\s*(?:[₹$£€]|rs\.?|inr|usd|us\$)?\s*$", before) and re.match(r"\s*%?\s*\)", after)
        if number is not None and (signed or bracket):
            number = -number
        rest = re.sub(r"\(\s*[-−–]\s*\)", " ", before) + " " + after
    else:
        words = re.findall(r"[a-z]+", s)
        total = None
        for w in words:
            if w in NUMBER_WORDS:
                total = (total or 0) + NUMBER_WORDS[w]
            elif total is not None:
                break
        if total is not None:
            number = Fraction(total)
        rest = s
    scales, units = _units(rest)
    return Reading(number, scales, units)


def known_factors() -> list[float]:
    """Every factor that a unit with or without a scale word may have, once each."""
    bases = {f for _, f in UNITS.values()}
    return sorted({float(b * s) for b in bases for s in (1, *SCALES.values())})


def claimed(value: float | None, unit: str | None, text: str | None) -> tuple[Fraction | None, list[tuple[str, Fraction]], str]:
    """``readings`` and a signature: rows of one signature have one reading.

    The signature is the unit's text and what the text says of units and scales, or its words if neither is
    known.  Without a known unit the number comes alone, and the signature says what its unit was called.
    """
    said = read_text(text) if text else NOTHING
    number, options = _readings(value, unit, text, said)
    name = " ".join(fold(unit).split()) if unit else ""
    told = ",".join([*map(str, said.scales), *(f"{u}*{f}" for u, f in said.units)])
    if options:
        return number, options, f"{name}|{told}"
    words = "" if name or not text else " ".join(_TOKEN.findall(_NOISE.sub(" ", fold(text))))[:80]
    return number, [], f"{name}|{told}|{words}"


def readings(value: float | None, unit: str | None, text: str | None) -> tuple[Fraction | None, list[tuple[str, Fraction]]]:
    """The number that value, unit and text give together, and what a 1 of it may be, the likeliest first.

    A present value is the number, else the number is in the text.  A scale named in either place applies
    once.  No number or no unit gives (None, []).
    """
    number, options = _readings(value, unit, text, read_text(text) if text else NOTHING)
    return (number, options) if options else (None, [])


def _readings(value: float | None, unit: str | None, text: str | None, said: Reading) -> tuple[Fraction | None, list[tuple[str, Fraction]]]:
    unit_scales, units = read_unit(unit) if unit else ((), ())
    present = value is not None and value == value and abs(value) != float("inf")
    number = Fraction(repr(value)) if present else said.number
    units = units or said.units
    if number is None or not units:
        return number, []
    scales = unit_scales or said.scales
    clear = bool(scales) and any(t in SCALES for t in _TOKEN.findall(fold(f"{unit or ''} {text or ''}")))
    options = [(u, f * s) for u, f in units for s in (scales or (Fraction(1),))]
    if scales and not clear:  # the scale is only a possible one
        options += [(u, f) for u, f in units]
    return number, options

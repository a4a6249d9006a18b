"""Golden rows of the scalar functions, quirks included."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factloom.functions import enums, grounding, names, periods, text, units, vectors


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_unit_quirks(spark):
    given = [
        ("INR/crore", "INR", ""), ("₹ Cr", "INR", "cr"), ("million dollars", "INR", "million"), ("users", "INR", None), ("% of GDP", None, None),
        ("million parcels", None, "million"), ("pct", "%", None), (None, None, None), ("", None, None), ("USD million", "USD", "million"),
    ]
    df = spark.createDataFrame([(n, u) for n, (u, _, _) in enumerate(given)], "n int, unit string")
    out = units.with_unit_components(df, "unit").orderBy("n").select("currency", "scale")
    assert rows(out) == [(c, s) for _, c, s in given]


def test_values_normalise(spark):
    given = [
        ("currency", 8142.16, "INR crore", None, 8142.16 * 1e7, "INR"), ("percentage", 6.4, "%", None, 6.4, "%"),
        ("percentage", None, None, "about 6.4 %", 6.4, "%"), ("number", None, "million tonnes", "1,234.5 or so", 1234.5e6, "unit"),
        ("text", None, None, "neutral", None, None), ("number", None, None, "none", None, None), ("number", 3.0, None, None, 3.0, "unit"),
        ("number", 2.0, "Pin Codes", None, 2.0, "pin codes"),
    ]
    df = spark.createDataFrame([(n, *g[:4]) for n, g in enumerate(given)], "n int, value_type string, value double, unit string, text_value string")
    out = units.with_value(df).orderBy("n").select("n_amount", "n_unit")
    assert rows(out) == [g[4:] for g in given]


def test_materiality(spark):
    pairs = [(8.14216e10, 8.1424e10, True), (6.4, 7.2, False), (None, 1.0, False), (0.0, 0.0005, True), (0.0, 0.002, False)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a double, b double")
    assert [r[0] for r in df.select(units.approximately_equal(F.col("a"), F.col("b"))).collect()] == [p[2] for p in pairs]


@pytest.mark.parametrize(
    ("label", "expected"),
    [
        ("FY 2024", "FY24"), ("2023-24", "FY24"), ("FY2024-25", "FY24"), ("FY 23-24", "FY23"), ("2000-19", "FY19"), ("1999-00", "1999-00"),
        ("2024-25 (up to February 2025)", "FY25 (up to February 2025)"), ("", ""), (None, None), (" 2024 ", "2024"),
    ],
)
def test_fiscal_label(spark, label, expected):
    df = spark.createDataFrame([(label,)], "l string")
    assert periods.with_fiscal_label(df, "l").collect()[0]["fiscal_label"] == expected


def test_period_bounds_and_comparison(spark):
    d = dt.date
    given = {
        "H1 FY24": (d(2023, 4, 1), d(2023, 9, 30), "half_year"), "Q4 FY24": (d(2024, 1, 1), d(2024, 3, 31), "quarter"), "FY24": (d(2023, 4, 1), d(2024, 3, 31), "fiscal_year"),
        "H1 2024-25": (d(2023, 4, 1), d(2023, 9, 30), "half_year"), "Q1:2024-25": (d(2024, 4, 1), d(2025, 3, 31), "fiscal_year"), "2024": (None, None, "custom"),
    }
    df = spark.createDataFrame([(k, None, None) for k in given], "period_label string, period_start date, period_end date")
    out = periods.with_period(df)
    assert {r["period_label"]: (r["label_start"], r["label_end"], r["label_type"]) for r in out.collect()} == given
    a = out.select(*(F.col(c).alias(c + "_a") for c in ("period_label", "label_start", "label_end", "period_key")))
    b = out.select(*(F.col(c).alias(c + "_b") for c in ("period_label", "label_start", "label_end", "period_key")))
    rel = periods.compare_periods(*(F.col(c) for c in ("label_start_a", "label_end_a", "period_key_a", "label_start_b", "label_end_b", "period_key_b")))
    got = {(r[0], r[1]): r[2] for r in a.crossJoin(b).select("period_label_a", "period_label_b", rel).collect()}
    assert got["H1 FY24", "FY24"] == "nested" and got["FY24", "H1 FY24"] == "nested"
    assert got["FY24", "Q1:2024-25"] == "different" and got["2024", "2024"] == "same" and got["2024", "FY24"] == "different"


def test_names_and_families(spark):
    df = spark.createDataFrame([("RBI", "Total Sales"), (" Delhivery Ltd ", "CAD"), ("X", "x")], "e string, c string")
    got = rows(df.select(names.canonical_entity(F.col("e")), names.canonical_concept(F.col("c"))))
    assert got == [("reserve bank of india", "revenue"), ("delhivery limited", "current account deficit"), ("x", "x")]
    pairs = [
        ("growth in services gva", "real gdp growth", True), ("revenue from traded goods", "revenue from operations", True), ("real gdp growth", "real gdp growth", False),
        ("real gdp growth", "headline cpi inflation", False), ("food inflation", "rural inflation", True), ("gross npa ratio", "net npa ratio", True), ("sales", "capex", False),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in df.select(names.sibling_concepts(F.col("a"), F.col("b")), "want").collect())
    pairs = [("food inflation", "core inflation", True), ("gdp growth", "gdp", True), ("revenue", "income", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in df.select(names.divergent_qualifiers(F.col("a"), F.col("b")), "want").collect())


def test_enums(spark):
    df = spark.createDataFrame([(" Half-Yearly", "PCT", "Projection"), ("nonsense", None, ""), (None, "Money", "targeted")], "p string, v string, s string")
    got = rows(df.select(enums.period_type(F.col("p")), enums.value_type(F.col("v")), enums.assertion_status(F.col("s"))))
    assert got == [("half_year", "percentage", "projected"), ("custom", "text", "unknown"), ("custom", "currency", "target")]


def test_float_text(spark):
    values = [8142.16, 31.0, -2.5, 12345678.9, 0.5, 231076.38, 1234567.0, 0.0]
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v double").orderBy("n")
    got = rows(df.select(text.float_text(F.col("v")), text.short_float_text(F.col("v"))))
    assert got == [(str(v), f"{v:g}") for v in values]


VALUE_CASES = [
    ("number", 31.0, "statement for the year", "Value not found in evidence quote"), ("number", 8142.16, "it was 8,142.16 crore", None), ("number", 8142163.0, "81,42,163 units", None),
    ("number", -1.0, "contracting by 1.0", None), ("number", -2.5, "(-) 2.5 per cent", None), ("number", -2.7, "rose by 2.7", "Value not found in evidence quote"),
    ("text", None, "", None), ("number", 1.0, "", "Evidence quote is empty"), ("number", 1.0, "in 2019", None), ("number", None, "abc", None), ("number", 1.0, None, "Evidence quote is empty"),
]


def test_value_grounding(spark):
    df = spark.createDataFrame([(n, *c) for n, c in enumerate(VALUE_CASES)], "n int, k string, v double, q string, want string").orderBy("n")
    out = df.select("k", "v", "q", grounding.value_reason(F.col("k"), F.col("v"), F.col("q")).alias("got"), "want").collect()
    assert [r["got"] for r in out] == [r["want"] for r in out]


def test_period_grounding(spark):
    bad = "Period not grounded in evidence"
    cases = [
        ("FY25", "Q1:2024-25 was", bad), ("FY19", "2000-19", bad), ("FY24", "2023-24 it", None), ("FY24", "fy 24", bad), ("Q1:2024-25", "in q1", None),
        ("H1 FY25", "h1 saw", None), (None, "x", None), ("FY24", "", "Period claimed but evidence quote is empty"), ("FY24", "no time named", None),
    ]
    df = spark.createDataFrame([(n, *c) for n, c in enumerate(cases)], "n int, p string, q string, want string").orderBy("n")
    out = df.select(grounding.period_reason(F.col("p"), F.col("q")).alias("got"), "want").collect()
    assert [r["got"] for r in out] == [r["want"] for r in out]


def test_concept_status_metadata_grounding(spark):
    one = spark.range(1)
    lit = F.lit
    none = lit(None).cast("string")
    reason = lambda c: one.select(c).collect()[0][0]
    assert reason(grounding.concept_reason(lit("real GDP growth"), lit("services sector growth"), lit("7.5"))) == "Concept 'real GDP growth' may not match source evidence context ('services')"
    assert "no growth or change terms" in reason(grounding.concept_reason(lit("bank credit growth"), none, lit("was 7.5")))
    assert reason(grounding.concept_reason(lit("revenue"), none, none)) is None
    status = lambda period, value, quote: reason(grounding.status_reason(lit("actual"), lit("x"), lit(period), lit(value), none, lit(quote)))
    assert status("FY26", 4.3, "likely to be 4.3") == "Assertion status 'actual' conflicts with evidence language: 'likely to'"
    assert status("2024", 5.7, "projected to moderate from 5.7% in 2024") is None
    assert status("FY26", 57.0, "projected to fall from 57 to 4") is None
    assert reason(grounding.metadata_reason(lit("Income Statement for the year ended March 31, 2025"))) is not None
    assert reason(grounding.metadata_reason(lit("Revenue was 12"))) is None


def test_ngram_vector_matches_its_definition(spark):
    def reference(s):
        import math
        import re

        words = re.sub(r"[^\w\s]", " ", s.lower().strip()).split()
        counts = [0.0] * 128
        for t in words + [w[k : k + 3] for w in words if len(w) >= 3 for k in range(len(w) - 2)]:
            h = 2166136261
            for c in t:
                h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
            counts[h % 128] += 1
        n = math.sqrt(sum(x * x for x in counts))
        return [x / n if n else x for x in counts]

    texts = ["Real GDP growth", "a", "", "Müller & Söhne 3.5%"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").orderBy("n")
    got = [r[0] for r in df.select(vectors.ngram_vector(F.col("t"))).collect()]
    for g, t in zip(got, texts, strict=True):
        assert g == pytest.approx(reference(t))
    same = spark.range(1).select(vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0))), vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).collect()[0]
    assert tuple(same) == (1.0, 0.0)

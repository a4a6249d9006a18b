"""The cascade's cases, invariants and plan."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from factloom.operators import reconcile as R

SCHEMA = """id string, document_id string, session_id string, entity_id string, concept_id string, value_type string, value double, unit string,
text_value string, period_type string, period_start date, period_end date, period_label string, geography string, scope_level string,
consolidation string, assertion_status string, needs_review boolean, ingested_at timestamp, entity_name string, concept_name string"""
FIELDS = [f.split()[0] for f in SCHEMA.replace("\n", " ").split(",")]


def obs(i, **given):
    base = dict.fromkeys(FIELDS)
    base |= dict(id=i, document_id="d1", entity_id="e", concept_id="c", value_type="percentage", unit="%", period_type="fiscal_year", period_label="FY25", assertion_status="actual", needs_review=False, entity_name="India", concept_name="real gdp growth")
    row = base | given
    if "concept_id" not in given:  # an id of its own for each name: two ids decide alone whether concepts are one
        row["concept_id"] = f"c:{row['concept_name']}"
    return tuple(row[f] for f in FIELDS)


def run(spark, rows, **kw):
    return R.reconcile(R.prepare(spark.createDataFrame(rows, SCHEMA)), **kw)


CR = dict(value_type="currency", concept_name="revenue from operations", entity_name="Delhivery Limited", period_label="FY24")
CASES = {
    "corroborated": (CR | dict(value=8142.16, unit="INR crore"), CR | dict(value=81424.0, unit="INR million"), "equal"),
    "status": (dict(value=6.4, assertion_status="estimate"), dict(value=6.5, assertion_status="forecast"), "status"),
    "contradicted": (dict(value=6.4), dict(value=7.2), "differs"),
    "currency": (CR | dict(value=100.0, unit="INR crore"), CR | dict(value=12.0, unit="USD million"), "currency"),
    "sibling": (dict(value=7.5, concept_name="growth in services gva"), dict(value=6.5), "sibling"),
    "concept": (dict(value=6.4), dict(value=5.4, concept_name="headline cpi inflation"), None),
    "quarter_year": (dict(value=6.5, period_type="quarter", period_label="Q1:2024-25"), dict(value=7.5, period_label="2024-25"), None),
    "years": (dict(value=8.2, period_label="FY24"), dict(value=6.5), None),
    "scope": (CR | dict(value=8142.16, unit="INR crore", consolidation="consolidated"), CR | dict(value=7800.0, unit="INR crore", consolidation="standalone"), "scope"),
    "level": (dict(value=1.0, scope_level="state"), dict(value=1.0, scope_level="unknown"), None),
    "nested": (dict(value=1.0, period_type="custom", period_label="H1 FY24"), dict(value=2.0, period_type="custom", period_label="FY24"), "nested"),
    "review": (dict(value=6.4, needs_review=True), dict(value=6.4), None),
    "entity": (dict(value=6.4, entity_id="x"), dict(value=6.4), None),
    "type": (dict(value=6.4, value_type="number"), dict(value=6.4), None),
    "geography": (dict(value=6.4, geography="Delta"), dict(value=6.4, geography="unknown"), None),
    "no_amount": (dict(value=None, text_value="n"), dict(value=6.4), None),
    "explicit_dates": (dict(value=6.4, period_start=dt.date(2024, 4, 1), period_end=dt.date(2026, 3, 31), period_label="x"), dict(value=6.4, period_label="FY26"), "nested"),
    "same_label": (dict(value=6.4, period_label="2024"), dict(value=6.4, period_label="2024"), "equal"),
    "null_label": (dict(value=6.4, period_label=None), dict(value=6.4, period_label=None), None),
}


def test_cases(spark):
    rows = [obs(f"{n:02d}{side}", **(c[k] | {"entity_id": f"{n}" + (c[k].get("entity_id") or "")})) for n, c in enumerate(CASES.values()) for k, side in enumerate("ab")]
    got = {r["observation_a"][:2]: r for r in run(spark, rows).collect()}
    for n, (name, (_, _, want)) in enumerate(CASES.items()):
        r = got.get(f"{n:02d}")
        assert (r["verdict"] if r else None) == want, name
    c = got["00"]
    assert (c["relationship_type"], c["confidence"], c["id"]) == ("corroborated", 0.99, "rel_00a_00b")
    assert got["02"]["numeric"]["difference"] == pytest.approx(-0.8)
    assert got["04"]["comparability"]["concept_match"] == "related_sub_metric" and got["04"]["numeric"]["difference"] == 1.0
    strict = {r["observation_a"][:2] for r in run(spark, rows, strict_code_order=True).collect()}
    assert set(got) - strict == {"03"}


def test_blocks_find_every_pair(spark):
    """Against the gate's definition applied to all pairs, with random periods, dates and labels."""
    import random

    from factloom.functions.periods import compare_periods

    r = random.Random(3)
    labels = ["FY24", "FY25", "H1 FY24", "Q4 FY24", "2024", "year", None, "Q1 FY25 x"]
    rows = []
    for n in range(60):
        start = r.choice([None, None, dt.date(2023, 4, 1), dt.date(2022, 4, 1)])
        end = start and r.choice([None, dt.date(2024, 3, 31), dt.date(2025, 3, 31)])
        rows.append(obs(f"{n:03d}", value=float(r.randint(1, 3)), period_type="custom", period_label=r.choice(labels), period_start=start, period_end=end, entity_id=r.choice("ef"), geography=r.choice([None, "A", "B"])))
    p = R.prepare(spark.createDataFrame(rows, SCHEMA)).cache()
    got = [(x[0], x[1]) for x in R.gated_pairs(p).select("id_a", "id_b").collect()]
    a, b = R._side(p, "a"), R._side(p, "b")
    period = compare_periods(*(F.col(c) for c in ("start_a", "end_a", "period_key_a", "start_b", "end_b", "period_key_b")))
    every = a.crossJoin(b).where((F.col("id_a") < F.col("id_b")) & (F.col("entity_id_a") == F.col("entity_id_b")) & F.coalesce(F.col("geo_a") == F.col("geo_b"), F.lit(True)) & (period != "different"))
    want = [(x[0], x[1]) for x in every.select("id_a", "id_b").collect()]
    assert len(got) == len(set(got)) and set(got) == set(want) and len(want) > 100
    reasons = {x["reason"]: x["pairs"] for x in R.gate_reasons(p).collect()}
    assert sum(reasons.values()) == 60 * 59 // 2 and reasons["identical_concept"] == len(want)


def test_invariants_and_empty(spark):
    rows = [obs(f"{n}", value=v, entity_id=e) for n, (v, e) in enumerate(itertools.product([1.0, 1.0005, 2.0], ["e", "f", None]))]
    out = run(spark, rows).collect()
    assert len({r["id"] for r in out}) == len(out) == 6
    assert run(spark, []).count() == 0
    assert R.gate_reasons(R.prepare(spark.createDataFrame([], SCHEMA))).count() == 0
    left = R.prepare(spark.createDataFrame(rows[:2], SCHEMA))
    assert R.reconcile(R.prepare(spark.createDataFrame(rows, SCHEMA)), left=left).count() == 4


def test_latest_keeps_one_row_a_key(spark):
    t = dt.datetime
    df = spark.createDataFrame([("a", 1, t(2021, 1, 1)), ("a", 2, t(2021, 1, 2)), ("a", 3, None), (None, 4, t(2021, 1, 1)), ("b", None, None)], "id string, v int, ingested_at timestamp")
    assert sorted((r["id"], r["v"]) for r in R.latest(df).collect()) == [("a", 2), ("b", None)]


def test_plan_has_equi_joins_only(spark):
    df = run(spark, [obs("1", value=1.0), obs("2", value=1.0)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("NestedLoop", "Cartesian", "Python", "Pandas", "Arrow"):
        assert word not in plan


def test_judge_with_a_model_and_modes(spark):
    import json

    rows = [obs("1", value_type="text", unit=None, text_value="Yes"), obs("2", value_type="text", unit=None, text_value="yes "), obs("3", value_type="text", unit=None, text_value="YES", document_id="d2")]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = R.open_pairs(R.prepare(df), df.select("id", "text_value"))
    offline = {r["id"]: (r["relationship_type"], r["confidence"]) for r in R.judged_pairs(pairs).collect()}
    assert offline == {"rel_1_2": ("unresolved", 0.75), "rel_1_3": ("corroborated", 0.92), "rel_2_3": ("unresolved", 0.75)}
    told = lambda p: json.dumps({"relationship_type": "contradicted" if "yes " in p else "nonsense", "confidence": 0.5, "explanation": "so", "reasons": ["r"]})
    said = {r["id"]: (r["relationship_type"], r["explanation"]) for r in R.judged_pairs(pairs, told).collect()}
    assert said["rel_1_2"] == ("contradicted", "[LLM Semantic Judge]: so") and said["rel_1_3"][0] == "corroborated"
    p = R.prepare(spark.createDataFrame([obs(i, value=5.0, document_id=d) for i, d in (("1", "x"), ("2", "x"), ("3", "y"), ("4", "z"))], SCHEMA))
    new, stored = p.where("id in ('1', '2')"), p.where("id not in ('1', '2')")
    ids = lambda mode, **kw: sorted(r["id"] for r in R.reconcile_documents(stored, new, mode, **kw).collect())
    assert ids("intra") == ["rel_1_2"] and ids("cross") == ["rel_1_3", "rel_1_4", "rel_2_3", "rel_2_4"] and ids("cross", targets=["z"]) == ["rel_1_4", "rel_2_4"]
    assert ids("combined") == sorted(ids("intra") + ids("cross"))


def test_class_links_count_pairs_in_small_plans(spark):
    """Links against the pairs themselves, with classes that differ in amount, unit or status alone; the plan joins related concepts as written."""
    import collections
    import random

    r = random.Random(5)
    pick = lambda: dict(value=r.choice([None, 1.0, 2.0]), unit=r.choice(["%", "percent", None]), assertion_status=r.choice(["actual", "forecast", None]), entity_id=r.choice(["e", "f", None]), geography=r.choice([None, "A", "B"]), period_label=r.choice(["FY24", "H1 FY24", None]), period_type="custom", needs_review=r.random() < 0.1, concept_name=r.choice(["real gdp growth", "growth in services gva"]))
    p = R.prepare(spark.createDataFrame([obs(f"{n:03d}", **pick()) for n in range(150)], SCHEMA)).cache()
    of = {x["id"]: x["class_id"] for x in R.class_members(p).collect()}
    want = collections.Counter()
    for x in R.reconcile(p).collect():
        want.update({of[x["observation_a"]], of[x["observation_b"]]})
    found = R.class_links(p)
    got = {x["class_id"]: (x["members"], x["links"]) for x in found.collect()}
    assert got == {c: (n, want[c]) for c, n in collections.Counter(of.values()).items()} and max(want.values()) > 10
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") <= 3

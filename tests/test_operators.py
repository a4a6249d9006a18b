"""Quantities, documents, views, sources, streaming."""

import datetime as dt
import json
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from factloom.functions.quantities import read_number, readings
from factloom.operators import documents as D
from factloom.operators import views as V
from factloom.operators.quantities import normalize_quantities, solve_unit_identity
from factloom.sources import artifacts as A

QUANTITIES = [
    (None, None, "estimated at 2,991 (US$-Cr.) as on 31 March 2020", "USD", 29_910_000_000), (673.0, None, "stood at 673bps", "%", 6.73),
    (10127.0, "INR", "all numbers in billions", "INR", 10_127_000_000_000), (1318.38, "Rs Lacs", "INR 1318.38 Lacs", "INR", 131_838_000),
    (None, None, "5707 (employees in Lacs) during Q1 FY23", "count", 570_700_000), (None, "pct", "(5.051)", "%", -5.051), (9493.02, "US$-Lacs", "9.493,02 (US$-Lacs)", "USD", 949_302_000),
    (None, None, "in Q2:2023-24, 20.093 % pts", "%", 20.093), (0.139, "₹lakh crore", None, "INR", 139_000_000_000), (None, "h", "2.318,94", "hour", 2318.94),
    (0.13, None, "reported as 0.13 day(s) (see note 9)", "hour", 3.12), (None, "MT", "2839.7", "tonne", 2839.7), (None, None, "INR eight Cr.", "INR", 80_000_000),
    (None, None, "US$85897.2 '000", "USD", 85_897_200), (None, "mn sq. ft.", "2", "sq_m", 185806.08), (None, "% p.a.", "−7.0", "%", -7.0), (310.0, None, "refer note 12", None, None),
    (None, None, "ranked 62", None, None), (None, None, "index at 126.9", None, None), (5.0, "x", None, None, None), (None, "INR crore", "NA", None, None), (5.0, "", "", None, None),
    (None, "m", "5", "km", 0.005), (None, "USD m", "5", "USD", 5_000_000), (None, None, "1.5 lb", "tonne", 0.000680388555), (4.0, "yd", None, "km", 0.0036576), (2.0, "oz", None, "tonne", 0.00005669904625),
]


@pytest.mark.parametrize(("value", "unit", "text", "want_unit", "want"), QUANTITIES)
def test_readings(value, unit, text, want_unit, want):
    number, options = readings(value, unit, text)
    assert (options[0][0] if options else None) == want_unit
    if want_unit:
        assert float(number * options[0][1]) == pytest.approx(want)


def test_numbers():
    for s, n in {"1,23,456.7": "123456.7", "1.234.567,8": "1234567.8", "1,234": "1234", "12,5": "12.5", "3.652": "3.652", "1 234,5": "1234.5", "1,695,288.2": "1695288.2"}.items():
        assert read_number(s) == Fraction(n), s


OBS = "id string, value double, unit string, text_value string, normalized_value double, normalized_unit string, ingested_at timestamp, r string, options string"


def test_normalize_quantities(spark):
    t = dt.datetime
    rows = [
        ("a", 5.0, "USD m", None, None, None, t(2021, 1, 1), "x", "y"), ("a", 5.0, "USD m", None, None, None, t(2021, 1, 2), "x", "y"),
        *[(f"m{n}", 5.0, "m units-of-length", None, 0.005 if n else 99.0, "km", None, None, None) for n in range(5)],
        (None, 5.0, "%", None, None, None, None, None, None), ("n", None, None, None, None, None, None, None, None), ("l", None, None, "x" * 200_000 + " 5 %", None, None, None, None, None),
    ]
    catalog = spark.createDataFrame([("USD", 1), ("km", 1000), ("%", 1000)], "common_unit string, key_factor long")
    got = {r["id"]: r for r in normalize_quantities(spark.createDataFrame(rows, OBS), catalog).collect()}
    assert got["a"]["value_key"] == 5_000_000 and not got["a"]["unique_reading"]  # nothing stored tells m from million
    assert got["m0"]["value_key"] == 5 and got["l"]["value_key"] == 5000 and "n" not in got and len(got) == 7
    assert normalize_quantities(spark.createDataFrame([], OBS), catalog).count() == 0


def test_units_from_the_identity(spark):
    row = lambda i, v, u, stored, unit: (i, float(v), u, None, stored, unit, None, None, None)
    rows = [row(f"f{n}", n + 1, "Furlongs", 0.201168 * (n + 1) * (10 if n < 2 else 1), "km") for n in range(12)]  # no known word, two wrong values
    rows += [row(f"g{n}", n + 1, "gizmos", 0.5 * (n + 1) ** 2, "km") for n in range(12)]  # no constant factor
    rows += [row(f"h{n}", n + 1, "zots", float(n + 1), "km") for n in range(5)]  # too few
    rows += [row(f"t{n}", n + 1, "MT", 1e6 * (n + 1), "tonne") for n in range(9)]  # all stored values contradict the word
    rows += [row(f"k{n}", n + 1, "kg", (n + 1) * (0.001 if n % 2 else 7.0), "tonne") for n in range(10)]
    catalog = spark.createDataFrame([("km", 1000), ("tonne", 1000)], "common_unit string, key_factor long")
    got = {r["id"]: r for r in normalize_quantities(spark.createDataFrame(rows, OBS), catalog).collect()}
    assert {i[0] for i in got} == {"f", "t", "k"} and len(got) == 31
    assert got["f0"]["normalized_unit"] == "km" and [got[f"f{n}"]["value_key"] for n in range(3)] == [201, 402, 604] and not got["f0"]["unique_reading"]
    assert got["t4"]["normalized_value"] == 5e6 and got["t4"]["unique_reading"] and got["k0"]["value_key"] == 1 and got["k9"]["normalized_value"] == pytest.approx(0.01)


def test_unit_identity(spark):
    rows = [("s1", 2.0 * v, 2000.0, v) for v in (1.0, 2.0, 3.0)] + [("s2", 2000.0 * v, 2000.0, v) for v in (1.0, 5.0)] + [("s3", None, 1.0, 1.0), (None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "source string, mass double, density double, volume double")
    units = {"mass": {"kg": 1.0, "tonne": 1000.0}, "density": {"kg/m3": 1.0}, "volume": {"m3": 1.0, "litre": 0.001}}
    got = {r["source"]: r for r in solve_unit_identity(df, "source", "mass", ["density", "volume"], units).collect()}
    assert (got["s2"]["unit_mass"], got["s2"]["unit_volume"]) in {("kg", "m3"), ("tonne", "m3")} and got["s2"]["residual"] < 1e-9
    assert not got["s1"]["unique"]  # 2 tonnes in 1 m3, or 2 kg in 1 litre: the same identity
    only = solve_unit_identity(df, "source", "mass", ["density", "volume"], units | {"volume": {"m3": 1.0}})
    got = {r["source"]: (r["unit_mass"], r["unique"]) for r in only.collect()}
    assert got == {"s1": ("tonne", True), "s2": ("kg", True)}


def test_chunks_and_batches(spark):
    table = "Item   1   2   3   4"
    page = "\n\n".join(["INTRODUCTION", "a" * 1000, "b" * 600, table, "1.2 Next part", "c"])
    pages = spark.createDataFrame([("d", 2, "line one\nline two"), ("d", 1, page), ("d", 3, ""), ("d", 4, None), (None, 1, "x"), ("e", 1, None)], "document_id string, page_number int, text string")
    out = D.chunk_pages(pages)
    chunks = sorted(map(tuple, out.collect()))
    assert [(c[0], c[2], c[4]) for c in chunks] == [("chk_d_p1_0", 1, "text"), ("chk_d_p1_1", 1, "text"), ("chk_d_p1_2", 1, "table"), ("chk_d_p1_3", 1, "text"), ("chk_d_p2_4", 2, "text")]
    assert chunks[0][3] == "INTRODUCTION" and chunks[3][3] == chunks[4][3] == "1.2 Next part" and chunks[4][5] == "line one\n\nline two"
    # a heading names the blocks that wait before it, too
    late = D.chunk_pages(spark.createDataFrame([("d", 1, "\n\n".join(["x" * 1400, "1 Heading", "y" * 200]))], "document_id string, page_number int, text string")).orderBy("id").collect()
    assert [r["section"] for r in late] == ["1 Heading", "1 Heading"]
    assert D.build_batches(out).count() == 1 and D.chunk_pages(pages.limit(0)).count() == 0
    part = lambda n, page, section, size: (f"c{n}", "d", page, section, "x" * size)
    rows = [part(0, 1, "A", 4000), part(1, 1, "B", 100), part(2, 7, "B", 100), part(3, 7, None, 15_000), part(4, 7, "B", 0), part(5, 7, "General Information", 10)]
    df = spark.createDataFrame(rows, "id string, document_id string, page_number int, section string, text string")
    got = [(r["batch_id"], r["section"], r["chunk_ids"], r["total_chars"]) for r in D.build_batches(df).orderBy("batch_id").collect()]
    assert got == [("batch_01", "A", ["c0"], 4000), ("batch_02", "B", ["c1"], 100), ("batch_03", "B", ["c2"], 100), ("batch_04", "B", ["c3"], 15_000), ("batch_05", "General Information", ["c5"], 10)]
    assert D.build_batches(df.limit(0)).count() == 0


def test_resolve_chunks(spark):
    chunks = spark.createDataFrame([("k1", "d", 1, "alpha beta"), ("k2", "d", 2, "gamma"), ("k3", "e", 1, None)], "id string, document_id string, page_number int, text string")
    claims = spark.createDataFrame([(1, "d", "k2", 9, "alpha"), (2, "d", None, 9, " Alpha "), (3, "d", None, 2, "zz"), (4, "d", "?", 9, None), (5, "x", "k1", 1, "a")], "candidate_id int, document_id string, chunk_id string, page_number int, evidence_quote string")
    assert {r[0]: r[1] for r in D.resolve_chunks(claims, chunks).collect()} == {1: "k2", 2: "k1", 3: "k2", 4: "k1", 5: "chk_unknown"}


def test_views(spark):
    obs = spark.createDataFrame([("1", "E", "C", False, "d"), ("2", "E", "C", None, "d"), ("3", "E", "X", True, "e")], "id string, entity_name string, concept_name string, needs_review boolean, document_id string")
    rels = spark.createDataFrame([("r", "1", "2", " Contradicted\n"), ("s", "1", "3", "corroborated"), ("t", None, "2", None)], "id string, observation_a string, observation_b string, relationship_type string")
    facts = {r["fact_key"]: (r["status"], r["observations"], r["relationships"]) for r in V.grouped_facts(obs, rels).collect()}
    assert facts == {"E::C": ("contradicted", 2, 1), "E::X": ("needs_review", 1, 0)}
    evidence = obs.select(F.col("id").alias("observation_id"), "document_id", F.lit(1).alias("page_number"), F.lit("q").alias("quote"))
    evidence = evidence.withColumn("id", V.evidence_id())
    o, e, r = V.rollback_document(obs, evidence, rels, F.lit("d"))
    assert ({x["id"] for x in o.collect()}, e.count(), r.count()) == ({"3"}, 1, 0)
    assert {x["id"] for x in V.touching(rels, spark.createDataFrame([("3",)], "id string")).collect()} == {"s"}
    up = V.upsert(obs.select("id", "document_id"), spark.createDataFrame([("1", "new"), ("9", "z")], "id string, document_id string"))
    assert sorted(map(tuple, up.collect())) == [("1", "new"), ("2", "d"), ("3", "e"), ("9", "z")]
    new = V.get_or_create(spark.createDataFrame([("A",)], "canonical_name string"), spark.createDataFrame([("A",), ("B b",), (None,), ("",), ("B b",)], "name string"), "ent_")
    assert [tuple(x) for x in new.collect()] == [("ent_b_b", "B b")]


def test_evidence_keeps_an_observation(spark):
    obs = spark.createDataFrame([("1", "d"), ("2", "d"), ("3", None)], "id string, document_id string")
    ev = spark.createDataFrame([("1", "d", 1, "q"), ("1", "e", 2, "r"), ("2", "d", 1, None)], "observation_id string, document_id string, page_number int, quote string")
    ev = ev.withColumns({"id": V.evidence_id(), "section": F.lit("s"), "chunk_id": F.lit(None).cast("string")})
    assert len({r["id"] for r in ev.collect()}) == 3
    o, e, _ = V.rollback_document(obs, ev, spark.createDataFrame([], "id string, observation_a string, observation_b string"), F.lit("d"))
    assert {r["id"] for r in o.collect()} == {"1", "3"} and e.count() == 1
    held = {r["id"]: r["evidence"] for r in V.with_evidence(obs, ev).collect()}
    assert [x["quote"] for x in held["1"]] == ["q", "r"] and held["3"] == []
    named = obs.withColumns({"entity_name": F.lit("Acme"), "concept_name": F.lit("Sales"), "needs_review": F.lit(None).cast("boolean"), "session_id": F.lit("s")})
    ids = lambda df: {r["id"] for r in df.collect()}
    assert ids(V.observation_list(named, ev, document_id="e")) == {"1"} and ids(V.observation_list(named, document_id="all", entity="ACME")) == {"1", "2", "3"}
    assert ids(V.comparison_candidates(named, ev, "d")) == {"3"} and ids(V.comparison_candidates(named, ev, "x", targets=["e"])) == {"1"}
    known = spark.createDataFrame([("ent_x", "Other")], "id string, canonical_name string")
    full = named.join(V.with_evidence(obs, ev).select("id", "evidence"), "id").withColumn("document_id", F.lit(None).cast("string"))
    saved = V.save_observations(full, known, known.limit(0))
    assert {(r["id"], r["entity_id"], r["document_id"]) for r in saved["observations"].collect()} == {("1", "ent_acme", "d"), ("2", "ent_acme", "d"), ("3", "ent_acme", None)}
    assert saved["evidence"].count() == 3 and saved["entities"].count() == 2 and saved["concepts"].count() == 1


def test_displays_and_small_changes(spark):
    obs = spark.createDataFrame([("1", "Acme", "Sales", "FY25", "actual", False), ("2", "Beta", None, None, "forecast", None)], "id string, entity_name string, concept_name string, period_label string, assertion_status string, needs_review boolean")
    rels = spark.createDataFrame([("r", "1", "9", "Apparent_Contradiction", None, '["x"]'), ("s", "8", "9", None, "why", None)], "id string, observation_a string, observation_b string, relationship_type string, explanation string, reasons_json string")
    ids = lambda df: {r["id"] for r in df.collect()}
    assert ids(V.displayed_observations(obs, "estimate")) == {"2"} and ids(V.displayed_observations(obs, "all", "ACM")) == {"1"} and ids(V.displayed_observations(obs, "review_only")) == set()
    assert ids(V.displayed_relationships(rels, obs, "contradicted")) == {"r"} and ids(V.displayed_relationships(rels, obs, "all", "sales")) == {"r"} and ids(V.displayed_relationships(rels, obs, "all", "WHY")) == {"s"}
    dim = spark.createDataFrame([("c", "Sales", ["turnover"], None)], "id string, canonical_name string, aliases array<string>, embedding_json string")
    names = spark.createDataFrame([("Sales", ["net sales", "turnover"], "[1]"), ("New one", None, None), (None, ["x"], None)], "name string, aliases array<string>, embedding_json string")
    got = {r["id"]: (r["aliases"], r["embedding_json"]) for r in V.merge_dimension(dim, names, "cpt_").collect()}
    assert got == {"c": (["turnover", "net sales"], "[1]"), "cpt_new_one": ([], None)}
    assert {r["status"] for r in V.set_status(spark.createDataFrame([("a", "x"), ("b", "y")], "id string, status string"), "a", "done").collect()} == {"done", "y"}
    assert all(t.count() == 0 and t.columns for t in V.cleared({"o": obs, "r": rels}).values())


def test_claims_by_an_injected_model(spark):
    from factloom.operators import claims as C

    chunks = spark.createDataFrame([("k1", "d", 3, "text", "Part A", "Sales were 12 crore in FY25."), ("k2", "d", 4, "text", None, "Nothing.")], "id string, document_id string, page_number int, chunk_type string, section string, text string")
    batches = spark.createDataFrame([("batch_01", "d", "Part A", 3, 4, ["k1", "k2"]), ("batch_02", "e", "x", 1, 1, ["gone"])], "batch_id string, document_id string, section string, page_start int, page_end int, chunk_ids array<string>")
    item = {"entity_name": "RBI", "concept_name": "Sales", "value_type": "money", "value": 12, "unit": "INR crore", "period_label": "FY25", "assertion_status": "Actual", "evidence_quote": "Sales were 12 crore in FY25.", "page_number": 9, "scope": {"geography": "India"}}

    def call(prompt):
        assert 'CHUNK id="k1" page=3' in prompt and "=== BATCH batch_01 | SECTION: Part A | PAGES: 3 - 4 ===" in prompt
        return "Here: " + json.dumps({"observations": [item, {"entity_name": "x"}, item | {"value": "high", "value_type": "?", "confidence": 0.5}]})

    got = C.extract_from_batches(batches, chunks, call)
    assert got.count() == 2 and C.extract_from_batches(batches, chunks, None).count() == 0
    registry = spark.createDataFrame([("c1", "net revenue", ["sales value"])], "id string, canonical_name string, aliases array<string>")
    rows = {r["value_type"]: r for r in C.to_observations(got, registry.limit(0), registry, chunks).collect()}
    o = rows["currency"]
    assert (o["entity_name"], o["concept_name"], o["value"], o["normalized_value"], o["normalized_unit"], o["geography"]) == ("reserve bank of india", "revenue", 12.0, 1.2e8, "INR", "India")
    assert (o["evidence"][0]["chunk_id"], o["evidence"][0]["page_number"]) == ("k1", 3) and not o["needs_review"] and o["entity_aliases"] == ["RBI"]
    assert rows["text"]["text_value"] == "high" and rows["text"]["review_reason"] == "Low extraction confidence score" and C.evidence_rows(C.to_observations(got, registry, registry)).count() == 2
    text = C.extract_from_text(spark.createDataFrame([("t", "Sales")], "document_id string, text string"), lambda p: json.dumps([item]))
    assert [r["document_id"] for r in text.collect()] == ["t"]
    assert C.to_observations(got.limit(0), registry, registry).count() == 0


def test_resolution_with_a_judge(spark):
    from factloom.operators.resolve import learned_aliases, new_rows, resolve_names

    registry = spark.createDataFrame([("e1", "Lismes Kuvpobkos Securities", ["lks"]), ("e2", "Port Authority of Dor", None)], "id string, canonical_name string, aliases array<string>")
    names = spark.createDataFrame([(x,) for x in ("RBI", "LKS", " lismes  kuvpobkos securities ", "lismes kuvpobkos security", "zzz", None, " ")], "name string")
    plain = {r["name"]: r for r in resolve_names(names, registry, "entity").collect()}
    assert (plain["RBI"]["via"], plain["RBI"]["canonical"], plain["RBI"]["id"]) == ("alias", "reserve bank of india", None)
    assert plain["LKS"]["id"] == "e1" == plain[" lismes  kuvpobkos securities "]["id"] and plain[None]["canonical"] == "unspecified entity" == plain[" "]["canonical"]
    near = plain["lismes kuvpobkos security"]
    assert (near["status"], near["id"], near["canonical"], len(near["candidates"])) == ("ambiguous", "e1", "lismes kuvpobkos security", 2) and plain["zzz"]["status"] == "new"
    judged = resolve_names(names, registry, "entity", lambda a, b: True)
    assert {r["via"] for r in judged.where("name like '%security'").collect()} == {"llm_judge"}
    assert "lismes kuvpobkos security" in {r["id"]: r["aliases"] for r in learned_aliases(judged, registry).collect()}["e1"]
    other = resolve_names(names, registry, "entity", lambda a, b: False)
    assert {r["canonical_name"] for r in new_rows(other, registry, "ent_").collect()} == {"zzz", "lismes kuvpobkos security"}
    assert resolve_names(names, registry.limit(0), "entity").where("status = 'new'").count() == 6 and resolve_names(names.limit(0), registry, "concept").count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from factloom.sources import tables

    none = SimpleNamespace(isDefined=lambda: False)
    conf = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError):
        tables.shared_folder(SimpleNamespace(conf=conf, sparkContext=context))


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"one\x0ctwo")
    (tmp_path / "in" / "b.pdf").write_bytes(b"\xff")
    (tmp_path / "in" / "c.txt").write_bytes(b"x")
    pages = A.read_pages(spark, str(tmp_path / "in"), lambda b: b.decode().split("\x0c"))
    assert sorted((r["page_number"], r["text"]) for r in pages.collect() if r["text"]) == [(1, "one"), (2, "two")] and pages.count() == 3
    assert A.read_files(spark, str(tmp_path / "in")).count() == 2
    docs = spark.createDataFrame([("d", "f.pdf", "2021")], "id string, filename string, created_at string")
    chunks = spark.createDataFrame([("k", "d", 1, "text")], "id string, document_id string, page_number int, text string")
    rels = spark.createDataFrame([("r", "1", "2", "d")], "id string, observation_a string, observation_b string, document_id string")
    A.write_artifacts(docs, chunks, rels, str(tmp_path / "out"))
    (tmp_path / "out" / "bad.json").write_text("{not json")
    back = A.read_artifacts(spark, str(tmp_path / "out"))
    assert back["chunks"].select("chunk_type").collect()[0][0] == "text" and back["relationships"].count() == 1
    assert A.catalog(spark, str(tmp_path / "out")).collect()[0]["chunks"] == 1
    found = spark.createDataFrame([("o", "d", "E", [("d", 3, "s", "k", "q")])], "id string, document_id string, entity_name string, evidence array<struct<document_id: string, page_number: int, section: string, chunk_id: string, quote: string>>")
    A.write_artifacts(docs, chunks, rels, str(tmp_path / "full"), found)
    assert A.load_artifacts(spark, str(tmp_path / "full"), str(tmp_path / "store")) == 1 == A.load_artifacts(spark, str(tmp_path / "full"), str(tmp_path / "store"))
    assert [(r["observation_id"], r["page_number"], r["quote"]) for r in spark.read.parquet(str(tmp_path / "store" / "evidence.parquet")).collect()] == [("o", 3, "q")]
    tabled = A.read_pages(spark, str(tmp_path / "in"), lambda b: [("text ", [[["a", None], [1, 2]]])] * 70 if b[:1] == b"o" else 1 / 0).collect()
    assert len(tabled) == 71 and tabled[0]["tables"] == ["a | \n1 | 2"] and [r["page_number"] for r in tabled if r["text"] is None] == [0]
    prompts = spark.createDataFrame([("b1", "p"), ("b2", "fail")], "batch_id string, prompt string")

    def call(p):
        if p == "fail":
            raise RuntimeError("400 bad request")
        return json.dumps({"observations": [{"x": 1}]})

    got = {r[0]: r[1] for r in A.ask(prompts, call).collect()}
    assert A.clean_json(got["b1"]) == [{"x": 1}] and got["b2"] is None
    assert A.ask(prompts, None).where("answer is not null").count() == 0
    assert A.clean_json("```json\n[1, {\"a\": 2}]\n```") == [{"a": 2}] and A.clean_json("no") == [] and A.clean_json(None) == []
    assert A.transient("HTTP 503")[0] and not A.transient("400")[0] and not A.transient("15000 tokens")[0]
    asked, slept = [], []

    def broken(p):
        asked.append("a")
        raise RuntimeError("503 busy" if len(asked) < 3 else "404")

    assert A.answer_of("p", [broken, lambda p: None, lambda p: "yes"], sleep=slept.append) == "yes" and asked == ["a"] * 3 and len(slept) == 2
    assert A.answer_of("p", [lambda p: None], sleep=slept.append) is None and len(slept) == 3


def test_stream_equals_batch(spark, tmp_path):
    from test_reconcile import SCHEMA, obs

    from factloom.operators import reconcile as R
    from factloom.streaming.ingest import IncrementalStore

    rows = [obs(f"{n}", value=1.0 + n % 3, entity_id=f"e{n % 2}", concept_id="c") for n in range(12)]
    df = spark.createDataFrame(rows, SCHEMA).drop("entity_name", "concept_name")
    for k in range(3):
        df.where(F.col("id").cast("int") % 3 == k).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    entities = spark.createDataFrame([("e0", "A"), ("e1", "B")], "id string, canonical_name string")
    concepts = spark.createDataFrame([("c", "growth")], "id string, canonical_name string")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = {(r["id"], r["verdict"]) for r in IncrementalStore(spark, entities, concepts, str(tmp_path / "store")).run(stream).collect()}
    want = {(r["id"], r["verdict"]) for r in R.reconcile(R.prepare(R.with_names(df, entities, concepts))).collect()}
    assert got == want and len(want) == 30


def test_corrections_replace_what_is_stored(spark, tmp_path):
    from test_reconcile import SCHEMA, obs

    from factloom.streaming.ingest import IncrementalStore, new_documents

    frame = lambda rows: spark.createDataFrame(rows, SCHEMA).drop("entity_name", "concept_name")
    entities = spark.createDataFrame([("e0", "A")], "id string, canonical_name string")
    concepts = spark.createDataFrame([("c", "growth")], "id string, canonical_name string")
    o = lambda i, v: obs(i, value=v, entity_id="e0", concept_id="c")
    store = IncrementalStore(spark, entities, concepts, str(tmp_path / "store"))
    store.add(frame([o("1", 5.0), o("2", 5.0)]), 0)
    store.add(frame([o("3", 5.0), o("1", 5.0)]), 1)  # 1 comes again as it was
    verdicts = lambda: {r["id"]: r["verdict"] for r in store.relationships().collect()}
    assert verdicts() == {"rel_1_2": "equal", "rel_1_3": "equal", "rel_2_3": "equal"}
    store.add(frame([o("1", 9.0)]), 2)
    assert verdicts() == {"rel_1_2": "differs", "rel_1_3": "differs", "rel_2_3": "equal"} and store.observations().count() == 3
    store.add(frame([o("1", 9.0)]), 2)  # the batch runs again
    assert len(verdicts()) == 3
    docs = spark.createDataFrame([("a", "h"), ("b", "k"), ("c", None)], "id string, file_hash string")
    fresh, again = new_documents(docs, docs.where("id = 'a'"))
    assert {r["id"] for r in fresh.collect()} == {"b", "c"} and [r["id"] for r in again.collect()] == ["a"]


def test_runs(spark):
    from factloom.operators.runs import cancel, run_document

    undone = []
    clock = iter("0123456789").__next__
    run = lambda job, **kw: run_document(spark, "d", job, lambda: undone.append(1), clock, **kw).collect()[0]
    assert run(lambda: {"pages": 3})["metrics"] == {"pages": 3} and undone == []
    assert run(lambda: {}, cancelled=lambda: True)["status"] == "cancelled" and len(undone) == 1
    assert run(lambda: 1 / 0)["error"] == "division by zero" and len(undone) == 2
    cancel(spark, "nothing")


def test_core_does_not_need_llm():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for p in [*(root / "factloom").rglob("*.py"), root / "bench.py"]:
        if "llm" not in p.parts and p.exists():
            assert "factloom.llm" not in p.read_text(), p


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["relationship_type", "pairs"]

"""The training-data operators against brute force, round trips and odd input."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import lookup, names, neighbours, packing, quality, queries, splitting, tokens
from factloom.llm.edits import distance
from factloom.llm.groups import connected_groups

VOCABULARY = f"{tokens.TOKENIZERS}/byte_bpe_50k"


def components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_groups_against_union_find(spark):
    r = random.Random(1)
    pairs = [(f"x{r.randint(0, 400):03d}", f"x{r.randint(0, 400):03d}") for _ in range(260)]
    pairs += [(f"y{n:03d}", f"y{n + 1:03d}") for n in range(150)] + [("hub", f"z{n}") for n in range(120)] + [("q", "q"), (None, "q"), ("q", None)] + pairs[:50]
    r.shuffle(pairs)
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in pairs], "a string, b string, u int, group_id int")
    got = [tuple(x) for x in connected_groups(df).collect()]
    assert len(got) == len(set(got)) and dict(got) == components(pairs)
    assert connected_groups(df.limit(0)).collect() == []
    assert connected_groups(spark.createDataFrame([(5, 3), (3, 4)], "a long, b long")).agg(F.max("group_id")).collect()[0][0] == 3


def test_split_text_invariants():
    r = random.Random(2)
    texts = ["word " * 900, "x" * 5000, "é" * 2000 + "\n\n" + "b c. " * 500, "A b.\n" * 800, ("para one. two\n\n" * 200).strip(), "漢字。" * 900, "é" * 1500, "a" * 1501]
    texts += ["".join(r.choice("ab  .\n") for _ in range(r.randint(1501, 6000))) for _ in range(20)]
    for t in texts:
        pieces = splitting.split_text(t, 1500, 150)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(t) and all(0 < b - a <= 1500 for a, b in pieces)
        for (_, b), (c, _) in zip(pieces, pieces[1:], strict=False):
            assert c == b - 150
        s = splitting.strengths(t)
        for a, b in pieces[:-1]:  # the strongest boundary of the window, the rightmost of equals
            lo, hi = max(a + 151, a + 750), a + 1500
            top = int(s[lo : hi + 1].max())
            if top > 0:
                assert s[b] == top and not (s[b + 1 : hi + 1] == top).any()
    assert splitting.split_text("", 10, 2) == [(0, 0)]
    table = splitting.RangeMax(np.arange(50)[::-1].copy(), 50)
    assert all(table.query(a, b) == 49 - a for a in range(50) for b in range(a, 50))


def test_split_tables(spark):
    chunks = spark.createDataFrame(
        [("a", "s", 1, "t " * 1000), ("a", "s", 1, "t " * 1000), ("b", None, 1, "  " + "x" * 1500 + "\n"), (None, "s", 1, "y" * 3000), ("n", "s", 1, None), ("long", "s", 2, "w " * 10_000), ("c", "u", 3, "z" * 900)],
        "id string, section string, page_number int, text string",
    )
    got = splitting.split_chunks(chunks)
    assert {r["item_id"] for r in got.collect()} == {"a", "long"}
    batches = spark.createDataFrame(
        [("B", ["a", "long", "c", "missing"]), ("B", ["a", "long", "c", "missing"]), ("small", ["a"]), ("none", None), (None, ["long"]), ("twice", ["c"] * 20)], "batch_id string, chunk_ids array<string>"
    )
    out = splitting.split_batches(batches, chunks).orderBy("item_id", "piece").collect()
    assert {r["item_id"] for r in out} == {"B", "twice"}
    b = [r for r in out if r["item_id"] == "B"]
    assert [r["piece"] for r in b] == list(range(len(b))) and all(r["chars"] <= 15_000 for r in out)
    assert {c for r in b for c in r["chunk_ids"]} == {"a", "long", "c", "missing"} and sum(r["start"] is not None for r in b) >= 2
    twice = [len(r["chunk_ids"]) for r in out if r["item_id"] == "twice"]
    assert sum(twice) - (len(twice) - 1) == 20
    assert splitting.split_batches(batches.limit(0), chunks).count() == 0 and splitting.split_chunks(chunks.limit(0)).count() == 0


NAMES = [
    ["Lismes Kuvpobkos Securities Company Limited", "Kuvpobkos Securities, Lismes Co. Ltd", "L. Kuvpobkos Secs.", "LismesKuvpobkos Securities", "M/s Lis-Kuvpobkos Securities", "LISMES KUVPBKOS SECURITIES (P) LTD"],
    ["Lismes Kuvpobkos Steel Company Limited", "lismes kuvpobkos stl."], ["Department of Fisheries of Firhekzax", "DoF, Firhekzax", "The Firhekzax Dept. of Fisheries"], ["Securities Commission of Firhekzax"],
    ["Patricia K. Bofraldor", "BOFRALDOR, Trish K.", "P. Bofraldor", "Bofraldor P.K.", "Dr. Patricia Bofralodr"], ["Robert Bofraldor"], ["Keptix Fefgottab Infrastructure Trust Series IV", "Keptix Féfgóttáb Infrastructure Tr. Ser. 4"],
    ["Keptix Fefgottab Infrastructure Trust Series VI"], ["the Group"], ["   "], [None],
]


def test_name_pairs(spark):
    rows, want = [], set()
    for g, variants in enumerate(NAMES):
        ids = [f"{g:02d}-{n}" for n in range(len(variants))]
        want |= {(a, b) for a in ids for b in ids if a < b}
        rows += [(i, v, '["the Group", "ABC"]' if n % 2 else None, 1) for n, (i, v) in enumerate(zip(ids, variants, strict=True))]
    rows += [("alias", "Zed", "['Lismes Kuvpobkos Securities Ltd']", 1), (None, "Lismes Kuvpobkos Securities", None, 1)]
    want |= {(f"00-{n}", "alias") for n in range(len(NAMES[0]))}
    df = spark.createDataFrame(rows, "id string, canonical_name string, aliases_json string, form int")
    got = [tuple(r) for r in names.variant_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want)
    assert names.variant_pairs(df.limit(0)).count() == 0
    again = names.variant_pairs(df.union(df))  # repeated rows
    assert {tuple(r) for r in again.collect()} == want


def name_pairs(spark, spellings):
    """Pairs found of a list of groups of spellings, and the pairs within the groups."""
    rows = [(f"{g:03d}-{n}", v, None) for g, x in enumerate(spellings) for n, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id string, canonical_name string, aliases_json string")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[0][:3] == b[0][:3]}
    return {tuple(r) for r in names.variant_pairs(df).collect()}, want


def test_frequent_names_stay_names(spark):
    hot = [[("Zephyr Steel Ltd", "Zephyr Steel", "Zephyr Stl. Company")[n % 3] for n in range(60)]]
    hot += [[f"{g.title()} Kumarande"] + (["Z. Kumarande"] if g == "zachary" else []) for g in names.GIVEN]
    r = random.Random(12)
    hot += [["".join(r.choice("abdefgiklmnoprstuv") for _ in range(10)).title() + " Widgets Ltd"] for _ in range(60)]
    got, want = name_pairs(spark, hot)
    assert got == want
    df = spark.createDataFrame([(names.read_form(v), None) for x in hot for v in x], "form string, name_form string")
    known = names.learn(df, df.select("form").distinct())
    assert set(known.common) == {"widgets", "kumarande"}


def test_names_of_any_business_and_order(spark):
    got, want = name_pairs(
        spark,
        [
            ["Northwind Haulage Ltd", "Haulage, Northwind", "NORTHWIND HAUL. LTD", "Norhtwind Haulage"], ["Northwind Bakeries Ltd"], ["Verdant Bakeries", "The Verdant Bakeries PLC"],
            ["Alpha Beta Gamma", "Gamma Alpha Beta"], ["Lismes Kuvpobkos Securities Ltd", "Kuvpobkos Lismes Securities Ltd", "Securities Lismes Kuvpobkos"],
            ["International Business Machines Corp", "Intl Business Machines"], ["3M Company", "3M"], ["ACME", "Acme", "Acme Ltd"], ["IBM", "ibm"], ["Delmar Tunnels Series 3 Ltd"], ["Delmar Tunnels Series 4 Ltd", "Delmar Tunnels Series IV"],
        ],
    )
    assert got == want


def test_a_short_form_that_fits_two_names_links_neither(spark):
    got, want = name_pairs(spark, [["Lismes Kuvpobkos Securities"], ["Lara Kuvpobkos Securities"], ["L. Kuvpobkos Securities", "L Kuvpobkos Secs."], ["Lismes Datoff Steel", "L. Datoff Steel"]])
    assert got == want
    rows = [("a", "Peter Bofraldor", '["PB"]'), ("b", "Paul Bofraldor", '["PB", "P. Bofraldor"]'), ("c", "Piet Baxmol", "['PB']"), ("d", "P. Bofraldor", None)]
    df = spark.createDataFrame(rows, "id string, canonical_name string, aliases_json string")
    assert names.variant_pairs(df).collect() == []


def test_rarity_decides():
    known = names.Vocabulary({"steel": 900, "mills": 500}, {}, {}, 10_000, 20.0)
    match = names.Matcher(known)
    assert match("kuvpobkos lismes steel", "lismes kuvpobkos") == (match("lismes kuvpobkos", "kuvpobkos lismes steel")[0], 1)
    assert match("kuvpobkos lismes steel", "lismes kuvpobkos")[0] > 0.75 > match("kuvpobkos lismes steel", "steel kuvpobkos")[0]
    assert match("kuvpobkos steel", "kuvpobkos mills")[0] == 0 == match("kuvpobkos #3", "kuvpobkos #4")[0]


def test_all_accepted_slips_are_candidates(spark):
    r = random.Random(11)
    for _ in range(6000):
        a = b = "".join(r.choice("abcdefgh") for _ in range(r.choice([4, 5, 6, 7, 8, 11, 12, 13, 14, 15, 18])))
        for _ in range(names.slips(len(a))):
            k = r.randrange(len(b))
            b = r.choice([b[:k] + b[k + 1 :], b[:k] + "q" + b[k:], b[:k] + "x" + b[k + 1 :], b[:k] + b[k + 1 : k + 2] + b[k] + b[k + 2 :]])
        if names.same_word(a, b):
            assert names.rests(a) & names.rests(b), (a, b)
    twins = ["Zephyr Steel Ltd", "Zehpyr Steel Ltd", "Robert Mehta", "Robert Mehat", "Susan Gupta", "Susan Gutpa", "Vexmora Cement Ltd", "Vexnora Cement Ltd", "Dawn Okra", "Dawn Okar", "Lismes Kuvpobkos Bank", "Ilsmes Kuvopbkso Bank"]
    got, want = name_pairs(spark, [twins[n : n + 2] for n in range(0, len(twins), 2)])
    assert got == want


def test_forms_with_strays_are_rejected_before_aligning(monkeypatch):
    """Rows of unlike names that mistype one common word alike are candidates, whose number grows fastest with the table."""
    known = names.Vocabulary({"industries": 900, "steel": 500, "mills": 300, "paper": 250}, {"inds": frozenset({"industries"})}, {"mills": frozenset({"paper"})}, 10_000, 20.0)
    calls = []
    aligned = names.edits
    monkeypatch.setattr(names, "edits", lambda *a: calls.append(a) or aligned(*a))
    assert names.Matcher(known)("kepfef jetbinkig industtries", "firduk jusdifpav industrires") == (0.0, 0) and not calls
    whole = names.Matcher(known)
    monkeypatch.setattr(whole, "strays", lambda *a: False)
    r = random.Random(11)
    parts = ["kep", "fef", "jet", "bin", "kig", "sud"]
    words = [a + b + c for a in parts for b in parts for c in ("", "zon")] + ["industries", "steel", "mills", "paper", "inds", "k", "j", "kj", "jbk", "bob", "robert", "jenifer"]
    slip = lambda w: w if r.random() < 0.6 or len(w) < 4 else w[: (n := r.randrange(len(w)))] + r.choice(["", "x"]) + w[n + 1 :]
    match, found = names.Matcher(known), 0
    for _ in range(4000):
        x = [r.choice(words) for _ in range(r.randint(1, 4))]
        y = [r.choice(words) if r.random() < 0.3 else w for w in x]
        if r.random() < 0.2:
            y = ["".join(y[:2]), *y[2:]]
        r.shuffle(y)
        x, y = (" ".join(map(slip, z)) for z in (x, y))
        assert match(x, y) == whole(x, y), (x, y)
        found += match(x, y)[0] > 0
    assert found > 300


def test_short_names_match_exactly(spark):
    same = [["TCS Limited", "TCS Ltd.", "T.C.S. Ltd"], ["ITC Ltd", "itc limited"], ["HCL Technologies Ltd", "HCL Tech. Ltd"], ["HLC Technologies Ltd"], ["Amit Rao", "Rao, Amit", "A. Rao"], ["Wei Li", "Wei Li"], ["Wei Lu"], ["UCO Bank", "UCO Bank"], ["L & T Ltd", "L&T Limited"]]
    rows = [(f"{g:02d}-{n}", v, None) for g, x in enumerate(same) for n, v in enumerate(x)] + [(f"z{n}", v, None) for n, v in enumerate(["our Company", "our Company", "K. Ltd", "K. Ltd", "the Bank", "the Bank"])]
    df = spark.createDataFrame(rows, "id string, canonical_name string, aliases_json string")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[0][:2] == b[0][:2] and a[0][0] == "0"}
    assert {tuple(r) for r in names.variant_pairs(df).collect()} == want


def test_aliases():
    assert names.aliases_of('["a", "b"]') == ["a", "b"] and names.aliases_of("['x y', 'z']") == ["x y", "z"] and names.aliases_of("a; b") == ["a", " b"]
    assert names.aliases_of(None) == names.aliases_of("") == names.aliases_of("[]") == []


def test_edits_against_dynamic_programme():
    def slow(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    r = random.Random(4)
    for _ in range(800):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 7))) for _ in range(2))
        n = slow(a, b)
        assert distance(a, b, 3) == (n if n <= 3 else None), (a, b)


TYPED = {
    "\xa0Cash balacne  ": "cash", "CHE. GVA GRO.": "chem", "f r e e c a s h f l o w": "fcf", "Free cash f10w *": "fcf", "t a t": "tat", "Inflation, rural": "rural",
    "Prt trckld vlm": "ptl", "kg of cold chain yield per": "cold", "(iv) travel_and_hospitality_advsnces [note 14]": "tour", "non-. inco.": "other", "exports of 12. automobile": "auto",
    "bookofservicesloan": "serv", "tobacco gva growth": "unmatched", "donkey census": "unmatched", "Particulars": "unmatched", "gaming loan book": "unmatched", "The the fcf": "fcf", "-": "unmatched",
}
CONCEPTS = {
    "cash": ["cash and cash equivalents", "cash balance"], "chem": ["chemicals gva growth"], "fcf": ["free cash flow", "fcf"], "tat": ["average turnaround time", "tat"], "rural": ["rural inflation"],
    "ptl": ["part truckload volume"], "cold": ["cold chain yield per kg"], "tour": ["tourism loan book", "travel and hospitality advances"], "other": ["other income", "non-operating income"],
    "auto": ["automobile exports"], "serv": ["services loan book"], "mine": ["mining loan book"],
}


def test_lookup(spark):
    rows = [(n, t, 1) for n, t in enumerate(TYPED)] + [(0, next(iter(TYPED)), 1), (900, None, 1), (901, " \xa0", 1), (None, "fcf", 1), (902, "x" * 100_000, 1)]
    typed = spark.createDataFrame(rows, "candidate_id long, concept_name string, entry int")
    ref = spark.createDataFrame([(k, v[0], json.dumps(v[1:])) for k, v in CONCEPTS.items()] + [(None, "x", None), ("void", None, "[]")], "id string, canonical_name string, aliases_json string")
    got = {r["candidate_id"]: r["entry"] for r in lookup.map_values(typed, ref).collect()}
    assert got == dict(enumerate(TYPED.values())) | {902: "unmatched"}
    assert {r["entry"] for r in lookup.map_values(typed, ref.limit(0)).collect()} == {"unmatched"} and lookup.map_values(typed.limit(0), ref).count() == 0


def test_lookup_in_blocks_equals_one_dictionary(spark, monkeypatch):
    typed = spark.createDataFrame(list(enumerate(TYPED)), "candidate_id long, concept_name string")
    ref = spark.createDataFrame([(k, v[0], json.dumps(v[1:])) for k, v in CONCEPTS.items()], "id string, canonical_name string, aliases_json string")
    whole = {tuple(r) for r in lookup.map_values(typed, ref).select("candidate_id", "entry").collect()}
    monkeypatch.setattr(lookup, "BLOCK_PHRASES", 5)
    monkeypatch.setattr(lookup, "CHUNK_VALUES", 7)
    assert {tuple(r) for r in lookup.map_values(typed, ref).select("candidate_id", "entry").collect()} == whole


def test_ties_between_blocks_go_by_frequency_at_any_size(spark, monkeypatch):
    ref = [(f"e{n:04d}", f"metric {n}x", None) for n in range(1100)] + [("a", "shared metric", None), ("z", "shared metric", '["zinc output"]')]
    typed = [(n, f"metric {n}x") for n in range(1100)] + [(2000, "shared metric"), (2001, "zinc output")]
    monkeypatch.setattr(lookup, "BLOCK_PHRASES", 600)
    out = lookup.map_values(spark.createDataFrame(typed, "candidate_id long, concept_name string"), spark.createDataFrame(ref, "id string, canonical_name string, aliases_json string"))
    assert {r["candidate_id"]: r["entry"] for r in out.where("candidate_id >= 2000").collect()} == {2000: "z", 2001: "z"}


def test_symmetric_delete_finds_all_within_two_edits():
    words = sorted({w for v in CONCEPTS.values() for p in v for w in p.split() if len(w) >= 6 and w.isalpha()})
    d = lookup.Dictionary([("x", " ".join(words))], {})
    r = random.Random(5)
    for w in words:
        for _ in range(20):
            k = r.randrange(len(w))
            typo = r.choice([w[:k] + w[k + 1 :], w[:k] + "q" + w[k:], w[:k] + w[k + 1 : k + 2] + w[k] + w[k + 2 :]])
            assert w in d.candidates(lookup.Token(typo, False)), (w, typo)


def test_long_words_are_found_with_three_slips():
    d = lookup.Dictionary([("x", "industrialisation"), ("y", "telecommunications")], {})
    for typo, entry in (("idnustrailisatoin", "x"), ("industralisatoinn", "x"), ("etlecommnuicatinos", "y"), ("tlecommunictionss", "y")):
        assert lookup.slip_cost(typo, {"x": "industrialisation", "y": "telecommunications"}[entry], 3) is not None
        assert d.candidates(lookup.Token(typo, False)), typo


def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(6)
    centres = r.standard_normal((40, 32))
    v = np.concatenate([c + 0.4 * r.standard_normal((12, 32)) for c in centres]) * r.choice([1.0, 10.0], (480, 1))
    rows = [(f"v{n:03d}", json.dumps(x.tolist()), 1) for n, x in enumerate(v)]
    rows += [("c1", rows[0][1], 1), ("c2", rows[0][1], 1)] + [("bad1", None, 1), ("bad2", "[]", 1), ("bad3", json.dumps([0.0] * 32), 1), ("bad4", "[1, 2", 1), ("bad5", "[NaN" + ", 1" * 31 + "]", 1), ("bad6", json.dumps([1.0] * 31 + [None]), 1)]
    df = spark.createDataFrame(rows, "id string, embedding_json string, vector int")
    usable = neighbours.parse_vectors(df.drop("vector"), "embedding_json", 32, ["id"])
    assert usable.count() == 482
    got = {}
    for x in neighbours.nearest_neighbours(usable, 32, 5).collect():
        got.setdefault(x["id"], {})[x["neighbour"]] = x["similarity"]
    u = np.concatenate([v, v[:1], v[:1]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    ids = [x[0] for x in rows[:482]]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hits = 0
    for n, i in enumerate(ids):
        assert len(got[i]) == 5 and i not in got[i]
        bar = np.sort(s[n])[-5] - 1e-6
        hits += sum(s[n][ids.index(j)] >= bar for j in got[i])
    assert hits / (5 * len(ids)) >= 0.97
    assert {"c1", "c2"} <= set(got["v000"]) and got["c1"]["c2"] == pytest.approx(1)
    assert neighbours.nearest_neighbours(usable.limit(0), 32).count() == 0


def test_one_bit_estimates_and_bounds():
    r = np.random.default_rng(7)
    x = r.standard_normal((300, 128)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = x.mean(axis=0) / np.linalg.norm(x.mean(axis=0))
    turn = neighbours.rotation(128)
    assert np.allclose(turn @ turn.T, np.eye(128), atol=1e-5)
    est, err = neighbours.Codes(x, centre, turn).estimate(x[:50], centre, turn)
    off = np.abs(est - x[:50] @ x.T)
    assert (off <= err).mean() > 0.93 and off.mean() < 0.12


TEXTS = ["", None, " ", "a", "Hello world", "x" * 70_000, "word " * 20_000, "\r\n\t  a b 漢字 é́ 😀 <|endoftext|> 'll don't 12,345.6", "a\n\n\n  b" * 300, "déjà vu tab\tend  ", "http://x.y/z?q=1&r=2 " * 50]


def test_encoding_equals_one_piece_and_round_trips(spark):
    from tokenizers import Tokenizer

    whole = tokens.load_bpe(VOCABULARY + ".tiktoken")
    other = Tokenizer.from_file(VOCABULARY + ".json")
    other.encode_special_tokens = True
    r = random.Random(8)
    texts = TEXTS + ["".join(r.choice(["the ", "of\n", "Rs.", " 12", "é", "  ", "漢", "don't", "\t", "."]) for _ in range(r.randint(1, 900))) for _ in range(60)]
    df = spark.createDataFrame([(n, t, 1) for n, t in enumerate(texts)] + [(0, "", 1), (None, "x", 1)], "doc_id long, text string, id int")
    out = tokens.encode_corpus(df).collect()
    assert len(out) == len(texts) + 2
    got = {x["doc_id"]: x["ids"] for x in out if x["doc_id"] is not None}
    for n, t in enumerate(texts):
        assert got[n] == whole.encode_ordinary(t or "") == other.encode(t or "", add_special_tokens=False).ids
        assert whole.decode(got[n]) == (t or "")
    counts = {x["doc_id"]: x["n_tokens"] for x in tokens.token_counts(df).collect()}
    assert all(counts[n] == len(got[n]) for n in got) and tokens.encode_corpus(df.limit(0)).count() == 0


def test_chunks_shared_by_the_cluster_give_the_same_ids(spark):
    r = random.Random(18)
    passage = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(800))
    texts = TEXTS + [f"{n} {passage} {n}" for n in range(12)]
    df = spark.createDataFrame([(n, t, 1) for n, t in enumerate(texts)] + [(0, "", 1), (3, "a", 1), (None, "x", 1), (None, None, 1)], "doc_id long, text string, ids int").repartition(3)
    rows = lambda out: sorted((str(x["doc_id"]), list(x["ids"])) for x in out.collect())
    assert rows(tokens.encode_corpus_shared(df)) == rows(tokens.encode_corpus(df)) and tokens.encode_corpus_shared(df.limit(0)).count() == 0


def test_chunks_are_shared_and_cuts_depend_on_content():
    e = tokens.ChunkEncoder(VOCABULARY + ".tiktoken")
    r = random.Random(10)
    passage = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(6000)).encode()
    e.encode([b"first " + passage])
    before = e.encoded_bytes
    e.encode([b"another beginning, " + passage + b" and end"])
    assert e.encoded_bytes - before < len(passage) / 5
    a, b = np.frombuffer(passage, np.uint8), np.frombuffer(b"zzzzz" + passage, np.uint8)
    late = lambda cuts, shift: {c - shift for c in cuts.tolist() if c - shift > 40}
    assert late(tokens.rolling_cuts(a), 0) == late(tokens.rolling_cuts(b), 5)


def test_packing(spark):
    r = random.Random(9)
    sizes = [r.choice([1, 5, 300, 700, 1024, 1025, 2048, 2049, 5000]) if r.random() < 0.5 else r.randint(1, 2048) for _ in range(2000)] + [0, -3, None]
    df = spark.createDataFrame([(n, s, 1) for n, s in enumerate(sizes)], "doc_id long, n_tokens long, piece int").repartition(2)
    out = packing.pack_documents(df).collect()
    filled, pieces = {}, {}
    for x in out:
        filled[x["container_id"]] = filled.get(x["container_id"], 0) + x["n_tokens"]
        pieces.setdefault(x["doc_id"], []).append((x["piece"], x["token_from"], x["n_tokens"]))
    assert max(filled.values()) <= 2048
    for n, s in enumerate(sizes):
        own = sorted(pieces.get(n, []))
        assert sum(p[2] for p in own) == max(s or 0, 0) and (len(own) <= 1 or s > 2048)
        assert all(p[1] == p[0] * 2048 for p in own)
    total = sum(s for s in sizes if s and s > 0)
    assert len(filled) <= -(-total // 2048) * 1.02 + 2
    assert packing.pack_documents(df.limit(0)).count() == 0
    bins = packing.harmonic_pack(np.array([600] * 9), 2048)
    assert sorted(np.bincount(bins).tolist()) == [3, 3, 3]


PROSE = "The committee noted that the report of the auditor was late, and it asked for a new plan before the end of the year. "
JUNK = {
    "list": "\n".join(f"- How to read the chart on item {n} and who is to be paid" for n in range(12)), "table": "\n".join(f"Steel exports | {n}.5 | {n * 7}" for n in range(12)),
    "text_table": "\n".join("Coal;in line with the plan;to be done by the board;as in the last year" for _ in range(9)), "base64": "Eh+fuYGPgh9Og9R640XA38AJSFdUAiOiApq4nDz2DrSS50905uAyPF9Sh" * 9,
    "salad": "railway route length steel exports urban inflation forest cover coal despatch " * 12, "rule": "_ " * 300, "scrambled": "Fro eht hfla yare the igefru asw 54 halk tons ta a tagetr fo 57 dna ti saw tno eht lats eno rof eht ryae. " * 6,
    "directory": "\n".join(f"Jane Doe\nSome Coast, Plot {n}\nPhone ext. {n}" for n in range(12)), "contents": "\n".join(f"The share of X in coal ........... {n}" for n in range(9)),
}
FINE = {
    "plain": PROSE * 4, "upper": (PROSE * 4).upper(), "lower": (PROSE * 4).lower().replace(".", "").replace(",", ""), "wrapped": "\n".join((PROSE * 4)[k : k + 60] for k in range(0, 460, 60)), "short": PROSE,
    "german": "Die Behörde weist darauf hin, dass die Zahlen für das Jahr noch nicht endgültig sind und sich ändern können. " * 3, "mixed": "1 Overview\n" + PROSE * 4 + "\n- coal\n- steel\n- tin\n" + PROSE * 2,
    "long": PROSE.replace("new", "{}") * 1,
}


def test_quality(spark):
    words = spark.createDataFrame([("en", w) for w in "the of and to a in that it was for is by on who be as at not who how with are an before".split()] + [("de", w) for w in "die der und für das nicht dass sich sind noch auf".split()] + [(None, None)], "lang string, word string")
    odd = {"empty": "", "blank": " \n\t", "null": None, "huge": " ".join(PROSE.replace("plan", f"plan {n}") for n in range(9000))}
    named = list(JUNK.items()) + list(FINE.items()) + list(odd.items())
    df = spark.createDataFrame([(n, t, 1) for n, (_, t) in enumerate(named)], "doc_id long, text string, word_count int")
    got = {named[r["doc_id"]][0]: r for r in quality.text_quality(df, words).collect()}
    assert {k: got[k]["is_prose"] for k in JUNK} == dict.fromkeys(JUNK, False)
    assert {k: got[k]["is_prose"] for k in FINE} == dict.fromkeys(FINE, True)
    assert got["empty"]["is_prose"] is None and got["blank"]["is_prose"] is None and got["null"]["word_count"] == 0 and got["huge"]["is_prose"]
    p = got["plain"]
    assert p["word_count"] == 96 and 3.5 < p["mean_word_length"] < 4.5 and p["lines_ending_in_punctuation"] == 1.0 and 0.3 < p["common_words"] < 0.8
    assert got["text_table"]["duplicate_lines"] == pytest.approx(8 / 9) and quality.text_quality(df.limit(0), words).count() == 0


def test_repeated_short_units_count_once():
    judge = quality.Judge({"en": frozenset("the of and to a in that it was for is by on not".split())})
    line = "The report is for the board and not for the public."
    assert judge(line)["is_prose"] and judge(PROSE + "\n\n" + line)["is_prose"]
    assert judge("\n\n".join([line] * 300))["is_prose"] is False


def test_repetition_shares_decide():
    judge = quality.Judge({"en": frozenset("the of and to a in that it was for is by on not with this".split())})
    notice = "This notice is for the holders of the notes and is not for the public."  # one notice of 70 letters, 400 times
    found = judge("\n".join([notice] * 400))
    assert found["duplicate_lines"] > 0.99 and found["is_prose"] is False
    varied = "\n".join(f"The report of the auditor for the year {n} was on time and in order, and it is with the board of unit {n}." for n in range(40))
    assert judge(varied)["is_prose"] and judge(varied)["duplicate_lines"] == 0
    assert judge("and so it is " * 300)["top_gram_share"] >= quality.GRAM_BOILERPLATE and judge("and so it is " * 300)["is_prose"] is False


def test_queries_registered():
    found = queries.queries()
    assert {"p1_found", "p2_found", "p3_found", "p5_found", "p6_found", "p7_ids", "p8_containers", "p9_found"} <= set(found)
    assert set(queries.oracle_sql()) <= set(found)

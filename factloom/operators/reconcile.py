"""Candidate gating and the deterministic cascade over pairs of observations.

Everything about one observation is computed before the join.  Pairs are found by equi-joins alone: on
entity, value type, concept (through the small table of related concepts) and a period block, so an
entity with a large share of all rows falls apart into many small blocks.

Observations that agree in all the cascade looks at are one class: ``class_verdicts`` gives the verdicts between
classes with the number of pairs each stands for, ``class_links`` how many pairs each class is in, ``reconcile``
the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.names import canonical_concept, canonical_entity, family_roles, scope_keys, scope_match
from factloom.functions.periods import compare_periods, fiscal_year_of, with_period
from factloom.functions.text import is_set, norm, once
from factloom.functions.units import MONEY, NUMERIC, approximately_equal, relative_difference, with_value
from factloom.sources.artifacts import ask
from factloom.sources.tables import Scratch

# Each verdict's relationship type, confidence and reasons.
VERDICTS = {
    "sibling": ("apparent_contradiction", 0.96, ["same_entity", "related_sub_metric_concept", "different_measurement_basis"]),
    "nested": ("contextualized", 0.95, ["same_entity", "same_concept", "nested_period"]),
    "scope": ("contextualized", 0.96, ["same_entity", "same_concept", "different_scope"]),
    "currency": ("unresolved", 0.95, ["same_entity", "same_concept", "different_currency_no_fx"]),
    "status": ("contextualized", 0.90, ["same_entity", "same_concept", "same_period", "different_assertion_status"]),
    "equal": ("corroborated", 0.99, ["same_entity", "same_concept", "same_period", "equivalent_after_normalization"]),
    "differs": (
        "contradicted",
        0.93,
        ["same_entity", "same_concept", "same_period", "same_scope", "matching_assertion_status", "material_value_difference"],
    ),
}
GATES = ("quarantined_needs_review", "entity_mismatch", "value_type_mismatch", "unit_incompatible", "geography_mismatch", "different_period")


def latest(df: DataFrame, key: str = "id", when: str = "ingested_at") -> DataFrame:
    """One row a key: the latest, then the largest.  Null keys are left out."""
    others = [c for c in df.columns if c not in (key, when)]
    rows = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(when, *others)).alias("_r"))
    return rows.select(key, *(F.col("_r")[c].alias(c) for c in [*others, when])).select(*df.columns)


def with_names(obs: DataFrame, entities: DataFrame, concepts: DataFrame) -> DataFrame:
    """Observations with entity and concept names; those without either row are left out."""
    e = entities.select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("entity_name"))
    c = concepts.select(F.col("id").alias("concept_id"), F.col("canonical_name").alias("concept_name"))
    return obs.join(e, "entity_id").join(c, "concept_id")


def prepare(obs: DataFrame) -> DataFrame:
    """What the gate and the cascade need to know of one observation (with entity and concept names).

    Optional columns: entity_aliases array<string>, source_label.
    """
    explicit = F.col("period_start").isNotNull()
    aliases = F.col("entity_aliases") if "entity_aliases" in obs.columns else F.array().cast("array<string>")
    label = F.col("source_label") if "source_label" in obs.columns else F.lit(None).cast("string")
    every = F.concat(F.array("entity_name"), F.coalesce(aliases, F.array().cast("array<string>")))
    named = {
        "period_type": F.coalesce("period_type", F.lit("custom")),
        "assertion_status": F.coalesce("assertion_status", F.lit("unknown")),
        "needs_review": F.coalesce("needs_review", F.lit(False)),
        "entity_keys": F.array_distinct(F.filter(F.transform(every, canonical_entity), lambda k: k.isNotNull())),
        "concept_key": canonical_concept(F.col("concept_name")),
        "label_key": F.nullif(canonical_concept(label), F.lit("")),
        "numeric": F.col("value_type").isin(*NUMERIC),
        **scope_keys(F.col("consolidation"), F.col("geography"), F.col("scope_level")),
    }
    out = with_period(with_value(obs.withColumns(named))).select(
        "id", "document_id", "session_id", "entity_id", "concept_id", "value_type", "unit", "geography", "scope_level", "consolidation",
        "period_type", "assertion_status", "needs_review", "period_label", "entity_name", "concept_name", "entity_keys", "concept_key", "label_key",
        F.xxhash64("concept_id", "concept_name", "label_key").alias("concept_code"),
        "numeric", "amount", "n_amount", "n_unit", "s_cons", "s_raw", "geo", "s_level", "period_key",
        F.when(explicit, F.col("period_start")).otherwise(F.col("label_start")).alias("start"),
        F.when(explicit, F.col("period_end")).otherwise(F.col("label_end")).alias("end"),
    )
    return out


def concept_pairs(prepared: DataFrame) -> DataFrame:
    """(code_a, code_b, same_concept): pairs of distinct concepts that are one or siblings.

    Two ids decide alone; else canonical names must agree, or the label of one with the name of the other.
    By equi-joins on id, name, label, and on the family and role, so it needs no bound on the concepts.
    """
    fields = {"concept_code": "code", "concept_id": "cid", "concept_name": "name", "concept_key": "key", "label_key": "label"}
    every = prepared.select(*(F.col(c).alias(n) for c, n in fields.items())).distinct()
    a, b = _side(every, "a"), _side(every, "b")
    without_ids = F.col("cid_a").isNull() | F.col("cid_b").isNull()
    both = lambda on: a.join(b, on).select("code_a", "code_b")
    same = both(F.col("cid_a") == F.col("cid_b")).union(both((F.col("key_a") == F.col("key_b")) & without_ids))
    same = same.union(both((F.col("label_a") == F.col("key_b")) & without_ids)).union(both((F.col("key_a") == F.col("label_b")) & without_ids)).distinct()
    roles = every.select("code", "name", F.explode(family_roles(F.col("name"))).alias("r"))
    left = roles.select(F.col("code").alias("code_a"), F.col("name").alias("name_a"), "r.family", "r.role")
    right = roles.select(F.col("code").alias("code_b"), F.col("name").alias("name_b"), "r.family", F.translate("r.role", "LRB", "RLB").alias("role"))
    siblings = left.join(right, ["family", "role"]).where(norm(F.col("name_a")) != norm(F.col("name_b"))).select("code_a", "code_b").distinct()
    siblings = siblings.join(same, ["code_a", "code_b"], "left_anti")
    return same.withColumn("same_concept", F.lit(True)).union(siblings.withColumn("same_concept", F.lit(False)))


def _side(df: DataFrame, s: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{c}_{s}") for c in df.columns))


def _blocks(p: DataFrame, left: bool) -> DataFrame:
    """A row for each fiscal year that a dated period touches, and rows by label for pairs with an undated one.

    An undated left row meets every right row of its label (U); a dated left row meets undated right rows (V).
    """
    dated = F.col("start").isNotNull() & F.col("end").isNotNull()
    first, last = fiscal_year_of(F.least("start", "end")), fiscal_year_of(F.greatest("start", "end"))
    years = F.when(dated, F.transform(F.sequence(first, last), lambda y: F.concat(F.lit("D"), y.cast("string"))))
    label = F.regexp_replace("period_key", "^(Q[1-4]|H[12])_", "")
    u, v = F.concat(F.lit("U"), label), F.concat(F.lit("V"), label)
    blocks = F.when(dated, F.concat(years, F.array(v))).otherwise(F.array(u)) if left else F.when(dated, F.concat(years, F.array(u))).otherwise(F.array(u, v))
    return p.withColumns({"first_year": F.when(dated, first), "block": F.explode(blocks)})


def unit_clash(a: Column, b: Column, numeric: Column) -> Column:
    both_money = a.isin(*MONEY) & b.isin(*MONEY)
    return F.coalesce(numeric & (a != "") & (b != "") & (a != b) & ~both_money, F.lit(False))


def _entities(p: DataFrame, by_names: bool) -> DataFrame:
    """Adds the keys on which entities meet: the id, and with ``by_names`` the names of one without an id."""
    if not by_names:
        return p.withColumn("meets", F.col("entity_id"))
    names = F.transform("entity_keys", lambda k: F.concat(F.lit("n"), k))
    return p.withColumn("meets", F.explode(F.array_compact(F.concat(F.array(F.concat(F.lit("i"), F.col("entity_id"))), names))))


def _same_entity(by_names: bool) -> Column:
    """Two ids decide alone; else some name or alias must agree, and the first that does brings the pair."""
    if not by_names:
        return F.lit(True)
    shared = F.array_min(F.array_intersect("entity_keys_a", "entity_keys_b"))
    with_ids = F.col("entity_id_a").isNotNull() & F.col("entity_id_b").isNotNull()
    return F.when(with_ids, F.col("meets_a").startswith("i")).otherwise(F.col("meets_a") == F.concat(F.lit("n"), shared))


def _periods_of(s: str) -> list[Column]:
    return [F.col(f"{c}_{s}") for c in ("start", "end", "period_key")]


def _once() -> Column:
    """Periods that share several years meet in the first of them alone."""
    return ~F.col("block_a").startswith("D") | (F.col("block_a") == F.concat(F.lit("D"), F.greatest("first_year_a", "first_year_b").cast("string")))


def gated_pairs(
    prepared: DataFrame, left: DataFrame | None = None, keep: Column | None = None, by_names: bool = False, related: DataFrame | None = None, own: bool = False
) -> DataFrame:
    """Pairs that pass the candidate gate, as columns ..._a and ..._b with same_concept and period.

    Without ``left``: all pairs with the smaller id first.  With ``left``: its rows against ``prepared``,
    as new against stored, without pairs of a row with itself.  ``keep``: a further condition on a pair.
    ``by_names``: observations without an entity id are matched by names and aliases.  ``related``: their
    ``concept_pairs``, if at hand.  ``own``: without ``left``, each row's pair with itself too.
    """
    if related is None:
        related = concept_pairs(prepared if left is None else prepared.unionByName(left))
    sound = _entities(prepared.where("not needs_review"), by_names)
    a = _side(_blocks(sound if left is None else _entities(left.where("not needs_review"), by_names), True), "a")
    b = _side(_blocks(sound, False), "b")
    order = F.col("id_a") != F.col("id_b") if left is not None else F.col("id_a") <= F.col("id_b") if own else F.col("id_a") < F.col("id_b")
    period = compare_periods(*_periods_of("a"), *_periods_of("b"))
    with_related = a.join(related, F.col("concept_code_a") == F.col("code_a"))
    on = [
        F.col("meets_a") == F.col("meets_b"), F.col("value_type_a") == F.col("value_type_b"),
        F.col("code_b") == F.col("concept_code_b"), F.col("block_a") == F.col("block_b"), order, _same_entity(by_names),
        _once(), ~unit_clash(F.col("n_unit_a"), F.col("n_unit_b"), F.col("numeric_a")),
        F.coalesce(F.col("geo_a") == F.col("geo_b"), F.lit(True)), period != "different",
    ]
    if keep is not None:
        on.append(keep)
    condition = on[0]
    for x in on[1:]:
        condition = condition & x
    return with_related.join(b, condition).withColumn("period", period).drop("code_a", "code_b", "block_a", "block_b", "meets_a", "meets_b")


def gate_reasons(prepared: DataFrame) -> DataFrame:
    """(reason, pairs): how many of all pairs (smaller id first) each gate turns away or lets pass.

    Pairs are counted, never formed.  Every gate's survivors are counted over groups of what the gates so far
    look at: by entity and value type, then unit, geography, period (in period blocks), concept (by related
    concepts and blocks).  A gate turns away the difference.  So no join is wider than the values that occur.
    """
    n = F.col("n").cast("double")
    rows = F.coalesce(F.sum("rows"), F.lit(0)).alias("n")
    count = lambda df, *by: df.groupBy(*by).agg(rows) if by else df.agg(rows)
    within = lambda name, df: df.select(F.lit(name).alias("stage"), F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0)).alias("pairs"))
    # all that the gates look at, counted once; what they look at one after the other is counted from that
    looked_at = ["needs_review", "entity_id", "value_type", "numeric", "n_unit", "geo", "start", "end", "period_key", "concept_id", "concept_name", "concept_key", "label_key", "concept_code"]
    prepared, _ = Scratch(prepared.sparkSession).cut(prepared.groupBy(*looked_at).agg(F.count("*").alias("rows")))
    sound = prepared.where("not needs_review")
    typed = ["entity_id", "value_type"]
    by_unit = [*typed, "numeric", "n_unit"]
    by_place = [*by_unit, "geo"]
    by_period = [*by_place, "start", "end", "period_key"]
    units = ~unit_clash(F.col("n_unit_a"), F.col("n_unit_b"), F.col("numeric_a"))
    places = units & F.coalesce(F.col("geo_a") == F.col("geo_b"), F.lit(True))
    periods = places & (compare_periods(*_periods_of("a"), *_periods_of("b")) != "different") & _once()
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    # both directions of different groups occur, so each counts half
    weight = F.sum(F.when(F.col("group_a") == F.col("group_b"), na * (na - 1) / 2).otherwise(na * nb / 2))

    def between(by: list[str], passes: Column, blocked: bool) -> DataFrame:
        groups = count(sound, *by).withColumn("group", F.struct(*by).cast("string"))
        a, b = (_side(_blocks(groups, left) if blocked else groups, s) for left, s in ((True, "a"), (False, "b")))
        on = passes
        for c in [*typed, "block"] if blocked else typed:
            on = (F.col(f"{c}_a") == F.col(f"{c}_b")) & on
        if "concept_code" in by:
            a = a.join(concept_pairs(prepared), F.col("concept_code_a") == F.col("code_a"))
            on = (F.col("code_b") == F.col("concept_code_b")) & on
        return a.join(b, on)

    stage = lambda name, by, passes, blocked=False: between(by, passes, blocked).agg(F.coalesce(weight, F.lit(0.0)).alias("pairs")).select(F.lit(name).alias("stage"), "pairs")
    concepts = between([*by_period, "concept_code"], periods, True)
    concepts = concepts.groupBy(F.when(F.col("same_concept"), "identical_concept").otherwise("related_sibling_concept").alias("stage")).agg(weight.alias("pairs"))
    stages = (
        within("every", count(prepared)).union(within("sound", count(sound))).union(within("entity", count(sound, "entity_id")))
        .union(within("type", count(sound, *typed))).union(stage("unit", by_unit, units)).union(stage("place", by_place, places))
        .union(stage("period", by_period, periods, True)).union(concepts)
    )
    value = lambda name: F.coalesce(F.max(F.when(F.col("stage") == name, F.col("pairs"))), F.lit(0.0))
    steps = ("every", "sound", "entity", "type", "unit", "place", "period")
    last = ("identical_concept", "related_sibling_concept")
    row = stages.agg(*(value(x).alias(x) for x in (*steps, *last)))
    lost = [F.struct(F.lit(g).alias("reason"), (F.col(x) - F.col(y)).alias("pairs")) for g, x, y in zip(GATES, steps, steps[1:], strict=False)]
    kept = [F.struct(F.lit(x).alias("reason"), F.col(x).alias("pairs")) for x in last]
    rest = F.struct(F.lit("concept_mismatch").alias("reason"), (F.col("period") - F.col(last[0]) - F.col(last[1])).alias("pairs"))
    out = row.select(F.explode(F.array(*lost, *kept, rest)).alias("r")).select("r.reason", F.round("r.pairs").cast("long").alias("pairs"))
    return out.where("pairs > 0")


#: All the cascade looks at in one observation.
CLASS = [
    "entity_id", "value_type", "concept_id", "concept_name", "concept_key", "label_key", "concept_code", "numeric", "n_amount", "n_unit", "unit", "s_cons", "s_raw", "geo",
    "s_level", "period_key", "period_type", "start", "end", "assertion_status",
]


def classes(prepared: DataFrame, *further: str) -> DataFrame:
    """Sound observations by class: its columns, ``id`` (the smallest of its observations), ``members``."""
    rows = prepared.where("not needs_review").groupBy(*CLASS, *further).agg(F.min("id").alias("id"), F.count("*").alias("members"))
    return rows.withColumn("needs_review", F.lit(False))


def class_members(prepared: DataFrame) -> DataFrame:
    """(id, class_id) of every sound observation."""
    sound = prepared.where("not needs_review").select("id", F.struct(*CLASS).cast("string").alias("c"))
    return sound.join(sound.groupBy("c").agg(F.min("id").alias("class_id")), "c").select("id", "class_id")


def class_verdicts(prepared: DataFrame, strict_code_order: bool = False) -> DataFrame:
    """(class_a, class_b, verdict, links): the verdicts between classes, the smaller id first, and within them.

    ``links`` is the number of pairs of observations a row stands for; nothing is lost and no pair is formed
    within a class.  Observations without an entity id have none.
    """
    c, _ = Scratch(prepared.sparkSession).cut(classes(prepared))
    between = gated_pairs(c).withColumn("links", F.col("members_a") * F.col("members_b"))
    own = c.where("members > 1 and entity_id is not null and value_type is not null and concept_key is not null")
    # joined with itself: two names for each column of one row would multiply the optimiser's constraints
    twice = _side(own, "a").join(_side(own, "b"), F.col("id_a") == F.col("id_b"))
    twice = twice.withColumns({"same_concept": F.lit(True), "period": compare_periods(*_periods_of("a"), *_periods_of("b")), "links": F.col("members_a") * (F.col("members_a") - 1) / 2})
    every = between.select(*between.columns).unionByName(twice.where("period <> 'different'").withColumn("links", F.col("links").cast("long")), allowMissingColumns=True)
    judged = once(signature(every), {"verdict": verdict(strict_code_order)}).where("verdict is not null")
    return judged.select(F.col("id_a").alias("class_a"), F.col("id_b").alias("class_b"), "verdict", "links")


#: What of a class decides whether a pair is comparable at all, beside whether it has an amount.
PROFILE = [c for c in CLASS if c not in ("n_amount", "unit", "assertion_status")]


def class_links(prepared: DataFrame) -> DataFrame:
    """(class_id, members, links) of every class: its sound observations, and the comparable pairs that it is in.

    Amounts, spellings of units and status decide which verdict a pair gets, not whether it gets one: so pairs
    are formed between profiles, the classes that differ in nothing else.  Related concepts are written first,
    which leaves the driver small plans.
    """
    scratch = Scratch(prepared.sparkSession)
    valued = F.when(F.col("n_amount").isNotNull(), 1.0)
    alike = Window.partitionBy(*PROFILE, "valued")
    c = classes(prepared).withColumn("valued", valued).withColumns({"profile": F.min("id").over(alike), "rows": F.sum("members").over(alike)})
    c, _ = scratch.cut(c.select("id", "members", "profile", "rows", "valued", *PROFILE))
    concepts, _ = scratch.cut(c.select("concept_code", "concept_id", "concept_name", "concept_key", "label_key").distinct())
    related, _ = scratch.cut(concept_pairs(concepts))
    nothing = {x: F.lit(None).cast("string") for x in ("unit", "assertion_status")}
    profiles = c.where("id = profile").withColumns({"needs_review": F.lit(False), "n_amount": F.col("valued"), **nothing})
    met = once(signature(gated_pairs(profiles, related=related, own=True)), {"verdict": verdict()}).where("verdict is not null")
    end = lambda x, y: F.struct(F.col(f"id_{x}").alias("profile"), F.col(f"rows_{y}").alias("others"), (F.col("id_a") == F.col("id_b")).alias("own"))
    ends = met.select(F.explode(F.when(F.col("id_a") == F.col("id_b"), F.array(end("a", "b"))).otherwise(F.array(end("a", "b"), end("b", "a")))).alias("e"))
    met = ends.groupBy("e.profile").agg(F.sum("e.others").alias("others"), F.max("e.own").alias("own"))
    # a pair within a class counts once, not at both ends
    n = F.col("members")
    links = n * F.col("others") - F.when(F.col("own"), n * n - (n * (n - 1) / 2).cast("long")).otherwise(0)
    return c.select("id", "members", "profile").join(met, "profile", "left").select(F.col("id").alias("class_id"), "members", F.coalesce(links, F.lit(0)).cast("long").alias("links"))


def signature(p: DataFrame) -> DataFrame:
    """Adds the six comparability columns to gated pairs."""
    types = F.array("period_type_a", "period_type_b")
    part = F.arrays_overlap(types, F.array(*map(F.lit, ("quarter", "month", "half_year"))))
    whole = F.array_contains(types, "fiscal_year")
    both = F.col("numeric_a") & F.col("numeric_b")
    same_unit = F.col("n_unit_a").eqNullSafe(F.col("n_unit_b"))
    raw_differs = F.coalesce("unit_a", F.lit("")) != F.coalesce("unit_b", F.lit(""))
    status_a, status_b = F.col("assertion_status_a"), F.col("assertion_status_b")
    versus = lambda x: ((status_a == "actual") & (status_b == x)) | ((status_a == x) & (status_b == "actual"))
    return once(
        p,
        {
            "entity_match": F.lit("match"),
            "concept_match": F.when(F.col("same_concept"), "match").otherwise("related_sub_metric"),
            "period_match": F.when((F.col("period_type_a") != F.col("period_type_b")) & part & whole, "different_aggregation")
            .when(F.col("period") == "nested", "nested")
            .when(F.col("period") == "different", "different_period")
            .otherwise("match"),
            "scope_match": scope_match(),
            "unit_match": F.when(~both, "match").when(~same_unit, "incompatible").when(raw_differs, "normalized_match").otherwise("match"),
            "status_relation": F.when(status_a == status_b, "identical")
            .when(versus("estimate"), "actual_vs_estimate")
            .when(versus("forecast"), "actual_vs_forecast")
            .when(versus("target"), "actual_vs_target")
            .otherwise("different"),
        },
    )


def verdict(strict_code_order: bool = False) -> Column:
    """The cascade's verdict of a pair with signature; null if it is not comparable.

    The currency test comes before the hard discard, unless ``strict_code_order``, which never reaches it.
    """
    sibling = ~F.col("same_concept")
    fits = (F.col("period_match") == "match") & (F.col("scope_match") != "different_geography") & (F.col("unit_match") != "incompatible")
    both = F.col("numeric_a") & F.col("numeric_b")
    money = both & F.col("n_unit_a").isin(*MONEY) & F.col("n_unit_b").isin(*MONEY) & (F.col("n_unit_a") != F.col("n_unit_b"))
    out_of_place = F.col("period_match").isin("different_period", "different_aggregation") | (F.col("scope_match") == "different_geography")
    clash = (F.col("unit_match") == "incompatible") & (F.lit(strict_code_order) | ~F.coalesce(money, F.lit(False)))
    known = (F.col("assertion_status_a") != "unknown") & (F.col("assertion_status_b") != "unknown")
    nothing = F.lit(None).cast("string")
    return (
        F.when(sibling & ~fits, nothing)
        .when(sibling, "sibling")
        .when(out_of_place | clash, nothing)
        .when(F.coalesce(money, F.lit(False)) & (F.col("period_match") == "match") & (F.col("scope_match") == "match"), "currency")
        .when(F.col("period_match") == "nested", "nested")
        .when(F.col("scope_match") != "match", "scope")
        .when(~both, nothing)
        .when(F.col("n_amount_a").isNull() | F.col("n_amount_b").isNull(), nothing)
        .when(known & (F.col("assertion_status_a") != F.col("assertion_status_b")), "status")
        .when(approximately_equal(F.col("n_amount_a"), F.col("n_amount_b")), "equal")
        .otherwise("differs")
    )


# The offline judge's types, confidences and reasons.
OPINIONS = {
    "contextualized": (0.88, ["different_concept_definitions", "semantic_contextualization"]),
    "corroborated": (0.92, ["textual_equivalence", "qualitative_corroboration"]),
    "unresolved": (0.75, ["unresolved_semantic_nuance", "insufficient_grounding"]),
}


def judge(names_differ: Column, text_a: Column, text_b: Column) -> Column:
    """The offline judge of pairs the cascade leaves open: its relationship type."""
    same = is_set(text_a) & is_set(text_b) & (F.lower(text_a) == F.lower(text_b))
    return F.when(names_differ, "contextualized").when(F.coalesce(same, F.lit(False)), "corroborated").otherwise("unresolved")


def open_pairs(prepared: DataFrame, texts: DataFrame, left: DataFrame | None = None) -> DataFrame:
    """Gated pairs that the cascade leaves open, with the text values (id, text_value) of both ends."""
    rest = once(signature(gated_pairs(prepared, left)), {"verdict": verdict()}).where("verdict is null")
    side = lambda s: texts.select(F.col("id").alias(f"id_{s}"), F.col("text_value").alias(f"text_{s}"))
    return rest.join(side("a"), "id_a", "left").join(side("b"), "id_b", "left")


def judged_pairs(pairs: DataFrame, call: Callable[[str], str | None] | None = None) -> DataFrame:
    """Relationships of open pairs: an injected model's opinion, else, and where it fails, the offline judge's.

    ``call`` answers a prompt with JSON of relationship_type, confidence, explanation and reasons.
    """
    kind = judge(F.col("concept_name_a") != F.col("concept_name_b"), F.col("text_a"), F.col("text_b"))
    table = F.create_map(*(x for k, (c, r) in OPINIONS.items() for x in (F.lit(k), F.struct(F.lit(c).alias("confidence"), F.array(*map(F.lit, r)).alias("reasons")))))
    why = (
        F.when(F.col("kind") == "contextualized", F.concat(F.lit("'"), F.col("concept_name_a"), F.lit("' and '"), F.col("concept_name_b"), F.lit("' are related, not identical: each gives the other context.")))
        .when(F.col("kind") == "corroborated", F.concat(F.lit("Both sources say the same of '"), F.col("entity_name_a"), F.lit("'.")))
        .otherwise(F.lit("Same entity, but different or missing wording allows no conclusion."))
    )
    line = lambda s: F.concat_ws(" | ", f"entity_name_{s}", f"concept_name_{s}", F.coalesce(F.col(f"n_amount_{s}").cast("string"), f"text_{s}"), f"period_label_{s}", f"assertion_status_{s}")
    rows = pairs.select(
        F.concat_ws("_", F.lit("rel"), F.least("id_a", "id_b"), F.greatest("id_a", "id_b")).alias("id"), F.col("id_a").alias("observation_a"), F.col("id_b").alias("observation_b"),
        kind.alias("kind"), "concept_name_a", "concept_name_b", "entity_name_a", F.concat(F.lit("A: "), line("a"), F.lit("\nB: "), line("b")).alias("prompt"),
    ).withColumns({"o": F.element_at(table, F.col("kind")), "why": why})
    offline = rows.select("id", "observation_a", "observation_b", F.col("kind").alias("relationship_type"), "o.confidence", "o.reasons", F.col("why").alias("explanation"))
    if call is None:
        return offline
    answers = ask(rows.select("id", "prompt"), call, key="id").select("id", F.from_json("answer", "relationship_type string, confidence double, explanation string, reasons array<string>").alias("m"))
    kinds = F.col("m.relationship_type").isin("corroborated", "contradicted", "contextualized", "apparent_contradiction", "not_comparable", "unresolved")
    sound = F.coalesce(kinds & F.col("m.confidence").between(0, 1) & F.col("m.reasons").isNotNull() & F.col("m.explanation").isNotNull(), F.lit(False))
    said = answers.where(sound).select("id", "m")
    pick = lambda c: F.coalesce(f"m.{c}", c).alias(c)
    told = offline.join(said, "id", "left").withColumn("explanation", F.coalesce(F.concat(F.lit("[LLM Semantic Judge]: "), "m.explanation"), "explanation"))
    return told.select("id", "observation_a", "observation_b", pick("relationship_type"), pick("confidence"), pick("reasons"), "explanation")


def explanation() -> Column:
    """One sentence on the verdict."""
    amount = lambda s: F.coalesce(F.col(f"n_amount_{s}").cast("string"), F.lit("none"))
    pair = F.concat(amount("a"), F.lit(" vs "), amount("b"))
    about = F.concat(F.lit("'"), F.col("entity_name_a"), F.lit("' - '"), F.col("concept_name_a"), F.lit("'"))
    return (
        F.when(F.col("verdict") == "sibling", F.concat(F.lit("Related but distinct metrics ("), pair, F.lit("): '"), F.col("concept_name_a"), F.lit("' vs '"), F.col("concept_name_b"), F.lit("'.")))
        .when(F.col("verdict") == "nested", F.concat(about, F.lit(" over nested periods: '"), F.coalesce("period_label_a", F.lit("")), F.lit("' and '"), F.coalesce("period_label_b", F.lit("")), F.lit("'.")))
        .when(F.col("verdict") == "scope", F.concat(about, F.lit(" in different reporting scopes.")))
        .when(F.col("verdict") == "currency", F.concat(F.lit("Different currencies ("), F.col("n_unit_a"), F.lit(" vs "), F.col("n_unit_b"), F.lit(") without an exchange rate.")))
        .when(F.col("verdict") == "status", F.concat(F.lit("Figures of different status ("), pair, F.lit("): "), F.col("assertion_status_a"), F.lit(" vs "), F.col("assertion_status_b"), F.lit(".")))
        .when(F.col("verdict") == "equal", F.concat(about, F.lit(": values agree after unit normalisation ("), pair, F.lit(").")))
        .when(F.col("verdict") == "differs", F.concat(about, F.lit(": material difference ("), pair, F.lit(").")))
    )


def reconcile(
    prepared: DataFrame, left: DataFrame | None = None, keep: Column | None = None, strict_code_order: bool = False, by_names: bool = False
) -> DataFrame:
    """Relationships of all comparable pairs: id, ends, type, confidence, reasons, comparability, numbers.

    Quarantined observations take part in none; each pair comes out at most once.  Null keys match nothing.
    An empty input gives an empty result.
    """
    pairs = once(signature(gated_pairs(prepared, left, keep, by_names)), {"verdict": verdict(strict_code_order)}).where("verdict is not null")
    table = F.create_map(
        *[
            x
            for k, (kind, confidence, reasons) in VERDICTS.items()
            for x in (F.lit(k), F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), F.array(*map(F.lit, reasons)).alias("reasons")))
        ]
    )
    v = F.element_at(table, F.col("verdict"))
    a, b = F.col("n_amount_a"), F.col("n_amount_b")
    numbers = F.when(
        F.col("numeric_a") & F.col("numeric_b") & a.isNotNull() & b.isNotNull(),
        F.struct(
            a.alias("value_a"), b.alias("value_b"), F.round(a - b, 4).alias("difference"), F.round(relative_difference(a, b), 6).alias("relative_difference")
        ),
    )
    signs = ("entity_match", "concept_match", "period_match", "scope_match", "unit_match", "status_relation")
    out = pairs.select(
        F.concat_ws("_", F.lit("rel"), F.least("id_a", "id_b"), F.greatest("id_a", "id_b")).alias("id"),
        F.col("id_a").alias("observation_a"),
        F.col("id_b").alias("observation_b"),
        "verdict",
        v["kind"].alias("relationship_type"),
        v["confidence"].alias("confidence"),
        v["reasons"].alias("reasons"),
        explanation().alias("explanation"),
        F.struct(*signs).alias("comparability"),
        numbers.alias("numeric"),
        F.col("document_id_a"),
        F.col("document_id_b"),
    )
    return out


def reconcile_documents(stored: DataFrame, new: DataFrame, mode: str = "cross", targets: list[str] | None = None) -> DataFrame:
    """Relationships of new prepared observations, one edge an id, by mode.

    intra: pairs within one of the new documents; cross: new against stored observations of other documents
    (of ``targets`` alone if given); combined (or all): both.
    """
    if mode not in ("intra", "cross", "combined", "all"):
        raise ValueError(f"unknown mode {mode}")
    parts = []
    if mode != "cross":
        parts.append(reconcile(new, keep=F.col("document_id_a") == F.col("document_id_b")))
    if mode != "intra":
        pool = stored.where(F.col("document_id").isin(targets)) if targets else stored
        parts.append(reconcile(pool, left=new, keep=~F.col("document_id_a").eqNullSafe(F.col("document_id_b"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates(["id"])

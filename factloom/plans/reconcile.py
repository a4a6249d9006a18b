"""Queries over pairs of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.names import CONCEPT_NAMES, canonical_concept
from factloom.operators import reconcile as R
from factloom.plans import sql as S
from factloom.plans.views import MONTH_START
from factloom.sources.tables import Scratch, read_table


def _ready(spark: SparkSession, folder: str) -> DataFrame:
    """The observations as the gate and the cascade need them."""
    obs = R.latest(read_table(spark, folder, "observations"))
    return R.prepare(R.with_names(obs, read_table(spark, folder, "entities"), read_table(spark, folder, "concepts")))


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    """The same, written once: both sides of a pair read them."""
    ready, _ = Scratch(spark).cut(_ready(spark, folder))
    return ready


def candidate_gate_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """How many of all pairs each gate turns away or lets pass."""
    return R.gate_reasons(prepared(spark, folder))


def cascade_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Every comparable pair with its verdict and signature."""
    r = R.reconcile(prepared(spark, folder))
    return r.select("observation_a", "observation_b", "verdict", "comparability.concept_match", "comparability.period_match", "comparability.scope_match", "comparability.unit_match", "comparability.status_relation")


def cascade_relationships(spark: SparkSession, folder: str) -> DataFrame:
    """Every comparable pair as a relationship row."""
    r = R.reconcile(prepared(spark, folder))
    return r.select("id", "observation_a", "observation_b", "relationship_type", "confidence", F.array_join("reasons", ";").alias("reasons"), "numeric.value_a", "numeric.value_b")


def _by_type(verdicts: DataFrame) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for k, v in R.VERDICTS.items() for x in (k, v[0])))
    return verdicts.groupBy(F.element_at(kinds, F.col("verdict")).alias("relationship_type")).agg(F.sum("links").alias("pairs"))


def verdict_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """Relationships by type, counted over classes of equal observations."""
    return _by_type(R.class_verdicts(prepared(spark, folder)))


def cascade_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of observations that agree in all the cascade looks at: members and links of each."""
    return R.class_links(_ready(spark, folder))


def cascade_explanations(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences on verdicts that quote no numbers: nested periods, scopes, currencies."""
    r = R.reconcile(prepared(spark, folder)).where(F.col("verdict").isin("nested", "scope", "currency"))
    return r.select("id", "explanation")


def numeric_differences(spark: SparkSession, folder: str) -> DataFrame:
    """How far the numbers of comparable pairs lie apart, relatively."""
    r = R.reconcile(prepared(spark, folder)).where("numeric is not null")
    return r.select("id", "numeric.relative_difference", (F.col("numeric.difference") > 0).alias("first_is_more"))


def intra_document_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts of pairs within one document."""
    r = R.reconcile(prepared(spark, folder), keep=F.col("document_id_a") == F.col("document_id_b"))
    return r.groupBy("verdict").agg(F.count("*").alias("pairs"))


def cross_document_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts of pairs across documents, by the number of documents they tie."""
    r = R.reconcile(prepared(spark, folder), keep=F.col("document_id_a") != F.col("document_id_b"))
    return r.groupBy("verdict").agg(F.count("*").alias("pairs"), F.countDistinct("document_id_a").alias("documents"))


def strict_order_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts when the currency test comes after the hard discard, as the reference's code has it."""
    return R.class_verdicts(prepared(spark, folder), strict_code_order=True).groupBy("verdict").agg(F.sum("links").alias("pairs"))


def judge_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """The offline judge's opinions of gated pairs that the cascade leaves open."""
    texts = R.latest(read_table(spark, folder, "observations")).select("id", "text_value")
    j = R.judged_pairs(R.open_pairs(prepared(spark, folder), texts))
    return j.select("id", "relationship_type", "confidence", F.array_join("reasons", ";").alias("reasons"))


def reconcile_combined(spark: SparkSession, folder: str) -> DataFrame:
    """Relationships of late observations among themselves within documents, and against those of other documents stored before."""
    obs = read_table(spark, folder, "observations")
    e, c = read_table(spark, folder, "entities"), read_table(spark, folder, "concepts")
    ready = lambda df: R.prepare(R.with_names(R.latest(df), e, c))
    old, new = obs.where(F.col("ingested_at") < MONTH_START), obs.where(F.col("ingested_at") >= MONTH_START)
    new = new.join(old.select("id").distinct(), "id", "left_anti").select(*obs.columns)
    return R.reconcile_documents(ready(old), ready(new), "combined").select("id", "verdict")


#: Pairs by their matching rules alone: (case, ids, names, aliases and labels of either side, whether they match).
RULES = [
    ("ids_equal", ("e1", "A", None, "c1", "sales", None), ("e1", "B", None, "c1", "margin", None), "identical"),
    ("ids_differ", ("e1", "A", None, "c1", "sales", None), ("e2", "A", None, "c1", "sales", None), None),
    ("name_without_id", (None, "RBI", None, None, "Sales", None), ("e2", "Reserve Bank of India", None, "c1", "revenue", None), "identical"),
    ("alias_without_id", (None, "Acme", ["Acme Limited"], None, "x", None), (None, "acme limited ", ["Apex"], None, "X", None), "identical"),
    ("two_shared_aliases", (None, "P", ["k", "m"], None, "x", None), (None, "Q", ["m", "k"], None, "x", None), "identical"),
    ("no_shared_name", (None, "P", ["k"], None, "x", None), (None, "Q", ["n"], None, "x", None), None),
    ("concept_ids_differ", ("e1", "A", None, "c1", "sales", None), ("e1", "A", None, "c2", "sales", None), None),
    ("label_to_name", ("e1", "A", None, None, "operating income", "turnover"), ("e1", "A", None, "c2", "total revenue", None), "identical"),
    ("label_to_label", ("e1", "A", None, None, "p", "turnover"), ("e1", "A", None, None, "q", "turnover"), None),
    ("siblings", ("e1", "A", None, None, "real gdp growth", None), ("e1", "A", None, "c3", "services gva growth", None), "sibling"),
]


def matching_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Entity and concept matching by ids, names, aliases and labels, on cases stated with their outcome."""
    rows = []
    for name, *sides, _ in RULES:
        for k, (eid, entity, aliases, cid, concept, label) in enumerate(sides):
            rows.append((f"{name}|{k}", eid, cid, entity, concept, aliases, label))
    schema = "id string, entity_id string, concept_id string, entity_name string, concept_name string, entity_aliases array<string>, source_label string"
    other = "document_id session_id unit text_value period_type geography scope_level consolidation assertion_status"
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit(None).cast("string") for c in other.split()} | {"value_type": F.lit("number"), "value": F.lit(1.0), "period_label": F.lit("FY25"), "needs_review": F.lit(False)})
    df = df.withColumns({c: F.lit(None).cast("date") for c in ("period_start", "period_end")})
    case = lambda s: F.substring_index(f"id_{s}", "|", 1)
    found = R.gated_pairs(R.prepare(df), by_names=True, keep=case("a") == case("b"))
    return found.select(case("a").alias("case_name"), F.when(F.col("same_concept"), "identical").otherwise("sibling").alias("outcome"))


def comparison_pool(spark: SparkSession, folder: str) -> DataFrame:
    """For each document, the number of sound observations of other documents on its concepts."""
    p = prepared(spark, folder).where("not needs_review")
    per = p.where("document_id is not null").groupBy("document_id", "concept_id").agg(F.count("*").alias("n"))
    total = p.groupBy("concept_id").agg(F.count("*").alias("total"))
    return per.join(total, "concept_id").groupBy("document_id").agg(F.sum(F.col("total") - F.col("n")).alias("pool"))


def sibling_concepts(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of concepts that are siblings, by name."""
    none = F.lit(None).cast("string")
    c = read_table(spark, folder, "concepts").select("canonical_name").distinct()
    c = c.select(none.alias("concept_id"), F.col("canonical_name").alias("concept_name"), canonical_concept(F.col("canonical_name")).alias("concept_key"), none.alias("label_key"))
    c = c.withColumn("concept_code", F.xxhash64("concept_name"))
    side = lambda s: c.select(F.col("concept_code").alias(f"code_{s}"), F.col("concept_name").alias(f"name_{s}"))
    return R.concept_pairs(c).where("not same_concept").join(side("a"), "code_a").join(side("b"), "code_b").select("name_a", "name_b")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            candidate_gate_reasons, cascade_verdicts, cascade_relationships, verdict_breakdown, cascade_classes, cascade_explanations, numeric_differences, intra_document_pairs, cross_document_pairs,
            strict_order_verdicts, judge_fallback, reconcile_combined, matching_rules, comparison_pool, sibling_concepts,
        )
    }


def oracle_sql() -> dict[str, str]:
    reasons = "CASE verdict " + " ".join(f"WHEN {S.q(k)} THEN {S.q(';'.join(v[2]))}" for k, v in R.VERDICTS.items()) + " END"
    counts = "SELECT verdict, count(*) AS pairs FROM judged WHERE verdict IS NOT NULL"
    return {
        "candidate_gate_reasons": f"""{S.OBSERVATIONS}, pairs AS (SELECT CASE
            WHEN a.needs_review OR b.needs_review THEN 'quarantined_needs_review'
            WHEN a.entity_id <> b.entity_id THEN 'entity_mismatch'
            WHEN a.value_type <> b.value_type THEN 'value_type_mismatch'
            WHEN {S.CLASH} THEN 'unit_incompatible'
            WHEN coalesce(a.geo <> b.geo, false) THEN 'geography_mismatch'
            WHEN {S.compare_periods('a', 'b')} = 'different' THEN 'different_period'
            WHEN a.concept_id = b.concept_id THEN 'identical_concept'
            WHEN {S.sibling('a.concept_low', 'b.concept_low')} THEN 'related_sibling_concept'
            ELSE 'concept_mismatch' END AS reason FROM prepared a JOIN prepared b ON a.id < b.id)
            SELECT reason, count(*) AS pairs FROM pairs GROUP BY reason""",
        "cascade_verdicts": f"""{S.PAIRS} SELECT a.id AS observation_a, b.id AS observation_b, verdict,
            CASE WHEN same_concept THEN 'match' ELSE 'related_sub_metric' END AS concept_match, period_match, scope_match, unit_match, status_relation
            FROM judged WHERE verdict IS NOT NULL""",
        "cascade_relationships": f"""{S.PAIRS} SELECT 'rel_' || a.id || '_' || b.id AS id, a.id AS observation_a, b.id AS observation_b,
            {S.VERDICT_TYPE} AS relationship_type, {S.VERDICT_CONFIDENCE} AS confidence, {reasons} AS reasons,
            CASE WHEN a.numeric_value AND a.n_amount IS NOT NULL AND b.n_amount IS NOT NULL THEN a.n_amount END AS value_a,
            CASE WHEN a.numeric_value AND a.n_amount IS NOT NULL AND b.n_amount IS NOT NULL THEN b.n_amount END AS value_b
            FROM judged WHERE verdict IS NOT NULL""",
        "verdict_breakdown": f"""{S.PAIRS} SELECT {S.VERDICT_TYPE} AS relationship_type, count(*) AS pairs FROM judged WHERE verdict IS NOT NULL GROUP BY 1""",
        "intra_document_pairs": f"{S.PAIRS} {counts} AND a.document_id = b.document_id GROUP BY verdict",
        "cross_document_pairs": f"""{S.PAIRS} SELECT verdict, count(*) AS pairs, count(DISTINCT a.document_id) AS documents FROM judged
            WHERE verdict IS NOT NULL AND a.document_id <> b.document_id GROUP BY verdict""",
        "strict_order_verdicts": f"""{S.PAIRS} SELECT verdict, count(*) AS pairs FROM judged WHERE verdict IS NOT NULL
            AND NOT (money AND same_concept) GROUP BY verdict""",
        "judge_fallback": f"""{S.PAIRS}, kind AS (SELECT 'rel_' || a.id || '_' || b.id AS id, CASE WHEN a.concept_name <> b.concept_name THEN 'contextualized'
            WHEN coalesce(a.text_value <> '' AND lower(a.text_value) = lower(b.text_value), false) THEN 'corroborated'
            ELSE 'unresolved' END AS relationship_type FROM judged WHERE verdict IS NULL)
            SELECT id, relationship_type, CAST(CASE relationship_type WHEN 'contextualized' THEN 0.88 WHEN 'corroborated' THEN 0.92 ELSE 0.75 END AS DOUBLE) AS confidence,
            CASE relationship_type WHEN 'contextualized' THEN 'different_concept_definitions;semantic_contextualization' WHEN 'corroborated' THEN 'textual_equivalence;qualitative_corroboration'
            ELSE 'unresolved_semantic_nuance;insufficient_grounding' END AS reasons FROM kind""",
        "cascade_classes": f"""{S.PAIRS}, c AS (SELECT id, min(id) OVER (PARTITION BY entity_id, value_type, concept_id, concept_name, numeric_value, n_amount, n_unit, unit,
              CASE WHEN consolidation NOT IN ('', 'unknown') THEN lower(consolidation) END, lower(coalesce(consolidation, '')), geo, nullif({S.norm('scope_level')}, ''), p_key, period_type, d_start, d_end, assertion_status) AS class_id
              FROM prepared WHERE NOT needs_review), p AS (SELECT x.class_id AS a, y.class_id AS b FROM judged JOIN c x ON x.id = a.id JOIN c y ON y.id = b.id WHERE verdict IS NOT NULL),
            e AS (SELECT a AS class_id FROM p UNION ALL SELECT b FROM p WHERE a <> b), l AS (SELECT class_id, count(*) AS links FROM e GROUP BY 1)
            SELECT class_id, count(*) AS members, coalesce(any_value(links), 0) AS links FROM c LEFT JOIN l USING (class_id) GROUP BY class_id""",
        "reconcile_combined": f"""{S.PAIRS.replace('FROM observations WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) = 1', f"FROM (SELECT *, ingested_at >= TIMESTAMP '{MONTH_START}' AS late, bool_or(ingested_at < TIMESTAMP '{MONTH_START}') OVER (PARTITION BY id) AS known FROM observations WHERE id IS NOT NULL AND ingested_at IS NOT NULL) WHERE NOT (late AND known) QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1").replace('SELECT id, document_id, session_id, entity_id', 'SELECT id, late, document_id, session_id, entity_id')}
            SELECT 'rel_' || a.id || '_' || b.id AS id, verdict FROM judged WHERE verdict IS NOT NULL AND ((a.late AND b.late AND a.document_id = b.document_id)
            OR (a.late <> b.late AND a.document_id IS DISTINCT FROM b.document_id))""",
        "matching_rules": "SELECT * FROM (VALUES " + ", ".join(f"({S.q(r[0])}, {S.q(r[3])})" for r in RULES if r[3]) + ") t(case_name, outcome)",
        "cascade_explanations": f"""{S.PAIRS} SELECT 'rel_' || a.id || '_' || b.id AS id, CASE verdict
            WHEN 'nested' THEN '''' || a.entity_name || ''' - ''' || a.concept_name || ''' over nested periods: ''' || coalesce(a.period_label, '') || ''' and ''' || coalesce(b.period_label, '') || '''.'
            WHEN 'scope' THEN '''' || a.entity_name || ''' - ''' || a.concept_name || ''' in different reporting scopes.'
            ELSE 'Different currencies (' || a.n_unit || ' vs ' || b.n_unit || ') without an exchange rate.' END AS explanation FROM judged WHERE verdict IN ('nested', 'scope', 'currency')""",
        "numeric_differences": f"""{S.PAIRS} SELECT 'rel_' || a.id || '_' || b.id AS id, round(abs(a.n_amount - b.n_amount) / greatest(abs(a.n_amount), abs(b.n_amount), 1.0::DOUBLE), 6) AS relative_difference,
            round(a.n_amount - b.n_amount, 4) > 0 AS first_is_more FROM judged WHERE verdict IS NOT NULL AND a.numeric_value AND a.n_amount IS NOT NULL AND b.n_amount IS NOT NULL""",
        "comparison_pool": f"""{S.OBSERVATIONS}, sound AS (SELECT document_id, concept_id FROM prepared WHERE NOT needs_review),
            per AS (SELECT document_id, concept_id, count(*) AS n FROM sound WHERE document_id IS NOT NULL GROUP BY ALL),
            total AS (SELECT concept_id, count(*) AS total FROM sound GROUP BY ALL)
            SELECT document_id, CAST(sum(total - n) AS BIGINT) AS pool FROM per JOIN total USING (concept_id) GROUP BY document_id""",
        "sibling_concepts": f"""WITH c AS (SELECT DISTINCT canonical_name AS name, {S.norm('canonical_name')} AS low,
              {S.canonical('canonical_name', CONCEPT_NAMES)} AS key FROM concepts WHERE canonical_name IS NOT NULL)
            SELECT a.name AS name_a, b.name AS name_b FROM c a JOIN c b ON a.key <> b.key WHERE {S.sibling('a.low', 'b.low')}""",
    }

"""Queries over the stored tables: facts, filters, searches, counts, cases, upserts and clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.names import alias_list
from factloom.operators import views as V
from factloom.operators.reconcile import latest, with_names
from factloom.plans import sql as S
from factloom.sources.artifacts import read_files
from factloom.sources.tables import read_table

MONTH_START = "2021-07-01"
SOURCE = "treasury_bulletin"
TERMS = ("bank", "steel", "fisher%es", "limited", "growth", "r_venue")


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = read_table(spark, folder, name)
    return latest(df) if name in ("observations", "relationships") else df.dropDuplicates(["id"]) if name == "chunks" else df


def _named(spark: SparkSession, folder: str) -> DataFrame:
    return with_names(_t(spark, folder, "observations"), read_table(spark, folder, "entities"), read_table(spark, folder, "concepts"))


def claims(spark: SparkSession, folder: str) -> DataFrame:
    """Claims once each, the latest."""
    x = read_table(spark, folder, "extracted_observations")
    others = [c for c in x.columns if c not in ("candidate_id", "ingested_at")]
    return x.groupBy("candidate_id").agg(F.max(F.struct("ingested_at", *others)).alias("r")).select("candidate_id", *(F.col(f"r.{c}") for c in others))


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    return V.evidence_from_claims(_t(spark, folder, "observations"), claims(spark, folder))


def grouped_facts(spark, folder):
    """Facts with their status, contradicted ones first."""
    return V.grouped_facts(_named(spark, folder), _t(spark, folder, "relationships")).orderBy(*V.fact_order())


def fact_members(spark, folder):
    """The observations of every fact and the relationships within it."""
    return V.fact_members(_named(spark, folder), _t(spark, folder, "relationships"))


def document_counts(spark, folder):
    """Chunks and observations of each document."""
    return V.document_counts(read_table(spark, folder, "documents"), _t(spark, folder, "chunks"), _t(spark, folder, "observations"))


def document_list(spark, folder):
    """Documents newest first, then by filename, with their place in their dataset's list."""
    place = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("created_at"), "filename", "doc_id"))
    d = read_table(spark, folder, "documents").select("doc_id", "id", "filename", "dataset", "created_at", place.alias("place"))
    return d.orderBy(F.desc("created_at"), "filename")


def content_hash_dedupe(spark, folder):
    """For each content hash issued more than once, the first document and the number of copies."""
    d = read_table(spark, folder, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1")


def hash_lookup(spark, folder):
    """The documents that have the file hash of the document with the smallest id."""
    d = read_table(spark, folder, "documents")
    first = d.agg(F.min_by("file_hash", "id")).first()[0]
    return V.by_id(d, first, "file_hash").select("doc_id", "id", "file_hash")


def point_lookup(spark, folder):
    """The rows of the smallest ids of documents, observations, relationships and sessions."""
    out = None
    for name in ("documents", "observations", "relationships", "analysis_sessions"):
        t = _t(spark, folder, name)
        row = V.by_id(t, t.agg(F.min("id")).first()[0]).select(F.lit(name).alias("table_name"), "id")
        out = row if out is None else out.union(row)
    return out


def observation_filter(spark, folder):
    """Sound observations of revenue from operations, as the list gives them."""
    o = V.observation_list(_named(spark, folder), concept="Revenue FROM operations", needs_review=False)
    return o.select("id", "entity_name", "concept_name", "value", "unit").orderBy("id")


def document_observations(spark, folder):
    """Observations of the document with the smallest id that has some, its own and those it is evidence of."""
    o = _named(spark, folder)
    first = o.agg(F.min("document_id")).first()[0]
    return V.observation_list(o, _evidence(spark, folder), document_id=first).select("id", "document_id")


def observation_evidence(spark, folder):
    """Observations with all their evidence."""
    o = V.with_evidence(_t(spark, folder, "observations").select("id"), _evidence(spark, folder))
    return o.select("id", F.size("evidence").alias("items"), F.array_join(F.transform("evidence", lambda e: F.coalesce(e["quote"], F.lit("-"))), " | ").alias("quotes"))


def comparison_candidates(spark, folder):
    """What the observations of the smallest document id are compared with."""
    o = _named(spark, folder)
    first = o.agg(F.min("document_id")).first()[0]
    return V.comparison_candidates(o, _evidence(spark, folder), first).select("id")


def relationship_filter(spark, folder):
    """Relationships that touch a document's observations, for every document."""
    r = _t(spark, folder, "relationships").select("id", "observation_a", "observation_b", V.relationship_kind().alias("kind"))
    o = _t(spark, folder, "observations").where("document_id is not null").select(F.col("id").alias("oid"), "document_id")
    ends = r.select("id", "kind", F.explode(F.array("observation_a", "observation_b")).alias("oid")).join(o, "oid")
    return ends.select("document_id", "id", "kind").distinct()


def relationship_detail(spark, folder):
    """Relationships with what both ends claim."""
    r, o = _t(spark, folder, "relationships"), _t(spark, folder, "observations")
    side = lambda s: o.select(F.col("id").alias(f"observation_{s}"), F.col("concept_id").alias(f"concept_{s}"), F.col("document_id").alias(f"document_{s}"))
    return r.select("id", "observation_a", "observation_b").join(side("a"), "observation_a", "left").join(side("b"), "observation_b", "left")


def displayed_observations(spark, folder):
    """The observation list under each status, with a text."""
    o = _named(spark, folder)
    out = None
    for status, text in (("actual", "revenue"), ("estimate", "fy25"), ("review_only", ""), ("all", "tr. ser")):
        rows = V.displayed_observations(o, status, text).select(F.lit(status).alias("shown"), "id")
        out = rows if out is None else out.union(rows)
    return out


def displayed_relationships(spark, folder):
    """The relationship list under two types, with a text."""
    r, o = _t(spark, folder, "relationships"), _named(spark, folder)
    out = None
    for kind, text in (("contradicted", "revenue"), ("all", "equivalent_after")):
        rows = V.displayed_relationships(r, o, kind, text).select(F.lit(kind).alias("shown"), "id")
        out = rows if out is None else out.union(rows)
    return out


def search_like(spark, folder):
    """Entities by name or aliases, concepts by name or description, for terms with wildcards."""
    term = F.explode(F.array(*map(F.lit, TERMS)))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    e = read_table(spark, folder, "entities").select(F.lit("entity").alias("kind"), "id", low("canonical_name").alias("n"), low("aliases_json").alias("a"), term.alias("term"))
    c = read_table(spark, folder, "concepts").select(F.lit("concept").alias("kind"), "id", low("canonical_name").alias("n"), low("description").alias("a"), term.alias("term"))
    pattern = F.concat(F.lit("%"), F.col("term"), F.lit("%"))
    hit = F.call_function("like", F.col("n"), pattern) | F.call_function("like", F.col("a"), pattern)
    return e.union(c).where(hit).select("kind", "term", "id")


def search_contains(spark, folder):
    """Observations that hold a term in entity, concept, period or a quote of their evidence."""
    o = V.with_evidence(_named(spark, folder), _evidence(spark, folder))
    text = F.lower(F.concat_ws("\n", "entity_name", "concept_name", "period_label"))
    out = None
    for term in ("growth", "fy25", "reported for"):
        hit = F.contains(text, F.lit(term)) | F.exists("evidence", lambda e: F.contains(F.lower(F.coalesce(e["quote"], F.lit(""))), F.lit(term)))
        rows = o.where(hit).select(F.lit(term).alias("term"), "id")
        out = rows if out is None else out.union(rows)
    return out


def review_queue(spark, folder):
    """Observations waiting for review."""
    return _t(spark, folder, "observations").where("needs_review").select("id", "review_reason").orderBy("id")


def dashboard_metrics(spark, folder):
    """The counts of the overview, of each dataset: a relationship counts where an end belongs."""
    docs = read_table(spark, folder, "documents").select(F.col("id").alias("document_id"), "dataset")
    d = docs.groupBy("dataset").agg(F.count("*").alias("documents"))
    o = _t(spark, folder, "observations").join(docs, "document_id").select("id", "dataset", "needs_review")
    counts = o.groupBy("dataset").agg(F.count("*").alias("observations"), F.count_if(F.coalesce("needs_review", F.lit(False))).alias("review"))
    r = _t(spark, folder, "relationships").select(F.col("id").alias("rel"), F.explode(F.array_distinct(F.array("observation_a", "observation_b"))).alias("id"), V.relationship_kind().alias("k"))
    r = r.join(o.select("id", "dataset"), "id").select("rel", "k", "dataset").distinct()
    kinds = r.groupBy("dataset").agg(
        F.count_if(F.col("k") == "corroborated").alias("corroborated"),
        F.count_if(F.col("k").isin("contradicted", "apparent_contradiction")).alias("contradicted"),
        F.count_if(F.col("k") == "contextualized").alias("contextualized"),
    )
    joined = d.join(counts, "dataset", "left").join(kinds, "dataset", "left")
    return joined.select("dataset", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("documents", "observations", "review", "corroborated", "contradicted", "contextualized")))


def showcase_union(spark, folder):
    """Cases of relationships with both ends, followed by the first ten under review."""
    r, o = _t(spark, folder, "relationships"), _named(spark, folder)
    a = o.select(F.col("id").alias("observation_a"), F.concat("entity_name", F.lit(" - "), "concept_name").alias("about"))
    both = r.join(a, "observation_a").join(o.select(F.col("id").alias("observation_b")), "observation_b", "left_semi")
    kind = V.relationship_kind()
    title = F.concat(F.lit("Reconciliation ("), F.replace(F.coalesce(kind, F.lit("")), F.lit("_"), F.lit(" ")), F.lit("): "), "about")
    cases = both.select(
        F.concat(F.lit("case_"), "id").alias("case_id"), title.alias("title"), F.upper(F.replace(F.coalesce(kind, F.lit("")), F.lit("_"), F.lit(" "))).alias("badge"), kind.alias("category"), F.col("explanation").alias("takeaway")
    )
    first = o.where("needs_review").orderBy("id").limit(10)
    review = first.select(
        F.concat(F.lit("review_"), "id").alias("case_id"), F.concat(F.lit("Anomaly Escalation: "), "entity_name", F.lit(" - "), "concept_name").alias("title"),
        F.lit("NEEDS REVIEW").alias("badge"), F.lit("needs_review").alias("category"), F.coalesce("review_reason", F.lit("Ambiguous attributes")).alias("takeaway"),
    )
    return cases.unionByName(review)


def review_cases(spark, folder):
    """The first ten observations under review, the limit of the case list."""
    return _t(spark, folder, "observations").where("needs_review").orderBy("id").limit(10).select("id", "review_reason")


def session_view(spark, folder):
    """Sessions, newest first, with their observations and relationships."""
    s = read_table(spark, folder, "analysis_sessions").select(F.col("id").alias("session_id"), "status", "created_at")
    o = _t(spark, folder, "observations").groupBy("session_id").agg(F.count("*").alias("observations"))
    r = _t(spark, folder, "relationships").groupBy("session_id").agg(F.count("*").alias("relationships"))
    j = s.join(o, "session_id", "left").join(r, "session_id", "left").orderBy(F.desc("created_at"))
    return j.select("session_id", "status", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("observations", "relationships")))


def session_documents(spark, folder):
    """Documents named by each session."""
    s = read_table(spark, folder, "analysis_sessions")
    ids = F.from_json("document_ids_json", "array<string>")
    return s.select("id", F.coalesce(F.size(ids), F.lit(0)).alias("documents"))


def session_changes(spark, folder):
    """Sessions after a new one is made and its status set, and the observations stamped with it."""
    s = V.new_session(read_table(spark, folder, "analysis_sessions"), "Review 41", ["doc_a", "doc_b"], "combined", "2022-01-01 00:00:00")
    key = s.where("session_name = 'Review 41'").select("id").first()[0]
    s = V.set_status(s, key, "completed")
    o = V.stamp_session(_t(spark, folder, "observations"), "sess_new", _t(spark, folder, "observations").where("session_id is null"))
    return s.groupBy("status").agg(F.count("*").alias("n")).select(F.concat(F.lit("session "), "status").alias("kind"), "n").union(
        o.where("session_id = 'sess_new'").agg(F.count("*").alias("n")).select(F.lit("stamped").alias("kind"), "n")
    )


def upsert_latest(spark, folder):
    """Late rows upserted into earlier ones: the rows that stay."""
    o = read_table(spark, folder, "observations").where("id is not null")
    old, new = latest(o.where(F.col("ingested_at") < MONTH_START)), latest(o.where(F.col("ingested_at") >= MONTH_START))
    return V.upsert(old, new).select("id", F.date_format("ingested_at", "yyyy-MM-dd").alias("day"))


def rollback_document(spark, folder):
    """What is left when every document of one source is rolled back."""
    gone = read_table(spark, folder, "documents").where(F.col("source") == SOURCE).select(F.col("id").alias("document_id"))
    o, e, r = V.rollback_documents(_t(spark, folder, "observations"), _evidence(spark, folder), _t(spark, folder, "relationships"), gone)
    rows = lambda df, name, c: df.select(F.lit(name).alias("kind"), F.col(c).alias("id"))
    return rows(o, "observation", "id").union(rows(e, "evidence", "observation_id")).union(rows(r, "relationship", "id"))


def delete_relationships(spark, folder):
    """Relationships that stay when those of one source's documents are deleted."""
    gone = read_table(spark, folder, "documents").where(F.col("source") == SOURCE).select(F.col("id").alias("document_id"))
    ids = _t(spark, folder, "observations").join(gone, "document_id", "left_semi").select("id")
    return V.not_touching(_t(spark, folder, "relationships"), ids).select("id")


def get_or_create_entities(spark, folder):
    """Dimension rows for entity names as typed in lower case, most of which the table does not know."""
    x = read_table(spark, folder, "extracted_observations").select(F.lower("entity_name").alias("name"))
    return V.get_or_create(read_table(spark, folder, "entities"), x, "ent_")


def merged_concepts(spark, folder):
    """The concepts with the typed names got or created, their labels merged as aliases."""
    known = read_table(spark, folder, "concepts").select("id", "canonical_name", alias_list(F.col("aliases_json")).alias("aliases"), "embedding_json")
    x = claims(spark, folder).where("concept_name is not null")
    label = F.when(F.col("source_label") != "", F.array("source_label")).otherwise(F.array().cast("array<string>"))
    names = x.select(F.col("concept_name").alias("name"), label.alias("aliases"), F.lit(None).cast("string").alias("embedding_json"))
    names = names.union(names.select(F.lit("revenue from operations"), F.array(F.lit("turnover"), F.lit("gross receipts")), F.lit("[1]")).limit(1))
    out = V.merge_dimension(known, names, "cpt_")
    return out.select("id", "canonical_name", F.array_join("aliases", "|").alias("aliases"), F.col("embedding_json").isNotNull().alias("embedded"))


def alias_union(spark, folder):
    """Aliases of entities in any notation, distinct, with the number of rows that have each."""
    e = read_table(spark, folder, "entities").select("id", F.explode(F.array_distinct(alias_list(F.col("aliases_json")))).alias("alias"))
    return e.groupBy("alias").agg(F.count("*").alias("n"))


def full_scan(spark, folder):
    """Entities and concepts with their JSON columns decoded."""
    out = None
    for name in ("entities", "concepts"):
        t = read_table(spark, folder, name)
        rows = t.select("id", "canonical_name", F.coalesce(F.size(alias_list(F.col("aliases_json"))), F.lit(0)).alias("aliases"))
        out = rows if out is None else out.union(rows)
    return out


def update_embeddings(spark, folder):
    """Concepts after a new vector for those that have none."""
    c = read_table(spark, folder, "concepts")
    new = c.where("embedding_json is null").select("id", F.lit("[0.5]").alias("embedding_json"))
    return V.update_embedding(c, new).select("id", F.length("embedding_json").alias("n"))


def cleared_tables(spark, folder):
    """Rows that are left in each table after all is cleared: none."""
    tables = {n: _t(spark, folder, n) for n in ("documents", "chunks", "observations", "relationships")}
    out = None
    for name, t in V.cleared(tables).items():
        n = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = n if out is None else out.union(n)
    return out


def chunk_scan(spark, folder):
    """Chunks of every document with their place in page and id order."""
    c = _t(spark, folder, "chunks").where("document_id is not null and id is not null and page_number is not null")
    return c.select("document_id", "id", F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "id")).alias("place"))


def run_metrics(spark, folder):
    """Counts of one run a document: pages, chunks, batches, observations, normalised, under review."""
    c = _t(spark, folder, "chunks").groupBy("document_id").agg(F.countDistinct("page_number").alias("pages"), F.count("*").alias("chunks"))
    b = read_table(spark, folder, "llm_batches").groupBy("document_id").agg(F.count("*").alias("batches"))
    o = _t(spark, folder, "observations").groupBy("document_id").agg(F.count("*").alias("observations"), F.count("normalized_value").alias("normalized"), F.count_if(F.coalesce("needs_review", F.lit(False))).alias("review"))
    j = c.join(b, "document_id", "full").join(o, "document_id", "full").where("document_id is not null")
    return j.select("document_id", *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("pages", "chunks", "batches", "observations", "normalized", "review")))


def chunk_diagnostics(spark, folder):
    """Chunks by type with lengths and their average to one decimal."""
    c = _t(spark, folder, "chunks").where("text is not null")
    return c.groupBy("chunk_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"), F.round(F.avg(F.length("text")), 1).alias("average"))


def events_props(spark, folder):
    """A JSON column parsed with a schema: sums by type."""
    e = read_table(spark, folder, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"))


def starter_files(spark, folder):
    """The files of a folder with their sizes in MB."""
    f = read_files(spark, folder, "*.parquet", hashed=False)
    return f.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "size_mb").orderBy("filename")


QUERIES = (
    grouped_facts, fact_members, document_counts, document_list, content_hash_dedupe, hash_lookup, point_lookup, observation_filter, document_observations,
    observation_evidence, comparison_candidates, relationship_filter, relationship_detail, displayed_observations, displayed_relationships, search_like,
    search_contains, review_queue, dashboard_metrics, showcase_union, review_cases, session_view, session_documents, session_changes, upsert_latest,
    rollback_document, delete_relationships, get_or_create_entities, merged_concepts, alias_union, full_scan, update_embeddings, cleared_tables, chunk_scan,
    run_metrics, chunk_diagnostics, events_props, starter_files,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    one = lambda t: f"(SELECT * FROM {t} WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) = 1)"
    obs, rel = one("observations"), one("relationships")
    chunks = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id) = 1)"
    named = f"(SELECT o.*, e.canonical_name AS entity_name, c.canonical_name AS concept_name FROM {obs} o JOIN entities e ON o.entity_id = e.id JOIN concepts c ON o.concept_id = c.id)"
    kind = f"lower({S.strip('relationship_type')})"
    said = "(SELECT * FROM extracted_observations QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY ingested_at DESC NULLS LAST) = 1)"
    evidence = f"""(SELECT DISTINCT o.id AS observation_id, o.document_id, x.page_number, x.section, x.chunk_id, x.evidence_quote AS quote FROM {obs} o
        LEFT JOIN {said} x ON x.document_id = o.document_id AND x.period_label = o.period_label AND x.value_num = o.value AND x.unit = o.unit AND x.evidence_quote IS NOT NULL WHERE o.document_id IS NOT NULL)"""
    gone = f"(SELECT id FROM documents WHERE source = {S.q(SOURCE)})"
    like = "lower({0}) LIKE '%' || term || '%'"
    terms = f"(SELECT unnest([{', '.join(map(S.q, TERMS))}]) AS term)"
    text = "lower(concat_ws(chr(10), entity_name, concept_name, period_label))"
    has = lambda term: f"contains({text}, {S.q(term)})"
    list_text = lambda term: "(" + " OR ".join(f"contains(lower(coalesce({c}, '')), {S.q(term)})" for c in ("entity_name", "concept_name", "period_label")) + ")"
    rel_text = lambda term: f"""(contains(lower(coalesce(explanation, '')), {S.q(term)}) OR contains(lower(coalesce(reasons_json, '')), {S.q(term)})
        OR contains(lower(coalesce(observation_a, '')), {S.q(term)}) OR contains(lower(coalesce(observation_b, '')), {S.q(term)})
        OR observation_a IN (SELECT id FROM n WHERE contains(lower(entity_name), {S.q(term)}) OR contains(lower(concept_name), {S.q(term)}))
        OR observation_b IN (SELECT id FROM n WHERE contains(lower(entity_name), {S.q(term)}) OR contains(lower(concept_name), {S.q(term)})))"""  # noqa: E731
    return {
        "grouped_facts": f"""WITH n AS {named}, r AS (SELECT a.entity_name, a.concept_name, bool_or(k = 'contradicted') AS c1, bool_or(k = 'corroborated') AS c2,
              bool_or(k = 'contextualized') AS c3, count(*) AS n FROM (SELECT observation_a, observation_b, {kind} AS k FROM {rel})
              JOIN n a ON a.id = observation_a JOIN n b ON b.id = observation_b AND a.entity_name = b.entity_name AND a.concept_name = b.concept_name GROUP BY ALL),
            f AS (SELECT entity_name, concept_name, count(*) AS observations, bool_or(coalesce(needs_review, false)) AS review FROM n GROUP BY ALL)
            SELECT entity_name || '::' || concept_name AS fact_key, entity_name, concept_name, observations, coalesce(r.n, 0) AS relationships,
            CASE WHEN review THEN 'needs_review' WHEN c1 THEN 'contradicted' WHEN c2 THEN 'corroborated' WHEN c3 THEN 'contextualized' ELSE 'single_source' END AS status
            FROM f LEFT JOIN r USING (entity_name, concept_name)""",
        "fact_members": f"""WITH n AS (SELECT id, entity_name || '::' || concept_name AS fact_key FROM {named}) SELECT fact_key, 'observation' AS kind, id FROM n
            UNION ALL SELECT a.fact_key, 'relationship', r.id FROM {rel} r JOIN n a ON a.id = r.observation_a JOIN n b ON b.id = r.observation_b WHERE a.fact_key = b.fact_key""",
        "document_counts": f"""SELECT d.id AS document_id, (SELECT count(DISTINCT c.id) FROM chunks c WHERE c.document_id = d.id) AS chunk_count,
            (SELECT count(DISTINCT o.id) FROM {obs} o WHERE o.document_id = d.id) AS observation_count FROM documents d""",
        "document_list": "SELECT doc_id, id, filename, dataset, created_at, CAST(row_number() OVER (PARTITION BY dataset ORDER BY created_at DESC NULLS LAST, filename NULLS FIRST, doc_id) AS INT) AS place FROM documents",
        "content_hash_dedupe": "SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "hash_lookup": "SELECT doc_id, id, file_hash FROM documents WHERE file_hash = (SELECT file_hash FROM documents ORDER BY id LIMIT 1)",
        "point_lookup": f"""SELECT 'documents' AS table_name, min(id) AS id FROM documents UNION ALL SELECT 'observations', min(id) FROM observations
            UNION ALL SELECT 'relationships', min(id) FROM relationships UNION ALL SELECT 'analysis_sessions', min(id) FROM analysis_sessions""",
        "observation_filter": f"SELECT id, entity_name, concept_name, value, unit FROM {named} WHERE lower(concept_name) = 'revenue from operations' AND NOT coalesce(needs_review, false)",
        "document_observations": f"""WITH n AS {named}, d AS (SELECT min(document_id) AS d FROM n) SELECT id, document_id FROM n, d
            WHERE document_id = d OR id IN (SELECT observation_id FROM {evidence} e, d WHERE e.document_id = d)""",
        "observation_evidence": f"""SELECT o.id, CAST(count(e.observation_id) AS INT) AS items, coalesce(string_agg(CASE WHEN e.observation_id IS NOT NULL THEN coalesce(e.quote, '-') END, ' | '
            ORDER BY e.document_id, e.page_number NULLS FIRST, e.section NULLS FIRST, e.chunk_id NULLS FIRST, e.quote NULLS FIRST), '') AS quotes FROM {obs} o LEFT JOIN {evidence} e ON e.observation_id = o.id GROUP BY o.id""",
        "comparison_candidates": f"""WITH n AS {named}, d AS (SELECT min(document_id) AS d FROM n) SELECT id FROM n, d WHERE NOT coalesce(needs_review, false) AND (document_id <> d
            OR (document_id IS NULL AND id NOT IN (SELECT observation_id FROM {evidence} e, d WHERE e.document_id = d)))""",
        "relationship_filter": f"""SELECT DISTINCT o.document_id, r.id, {kind} AS kind FROM {rel} r JOIN {obs} o
            ON o.id IN (r.observation_a, r.observation_b) WHERE o.document_id IS NOT NULL""",
        "relationship_detail": f"""SELECT r.id, observation_a, observation_b, a.concept_id AS concept_a, a.document_id AS document_a, b.concept_id AS concept_b, b.document_id AS document_b
            FROM {rel} r LEFT JOIN {obs} a ON a.id = observation_a LEFT JOIN {obs} b ON b.id = observation_b""",
        "displayed_observations": f"""WITH n AS {named} SELECT 'actual' AS shown, id FROM n WHERE assertion_status = 'actual' AND {list_text('revenue')}
            UNION ALL SELECT 'estimate', id FROM n WHERE assertion_status IN ('estimate', 'forecast', 'projected') AND {list_text('fy25')}
            UNION ALL SELECT 'review_only', id FROM n WHERE needs_review UNION ALL SELECT 'all', id FROM n WHERE {list_text('tr. ser')}""",
        "displayed_relationships": f"""WITH n AS {named}, r AS (SELECT *, {kind} AS k FROM {rel}) SELECT 'contradicted' AS shown, id FROM r WHERE k IN ('contradicted', 'apparent_contradiction') AND {rel_text('revenue')}
            UNION ALL SELECT 'all', id FROM r WHERE {rel_text('equivalent_after')}""",
        "search_like": f"""SELECT 'entity' AS kind, term, id FROM entities, {terms} WHERE {like.format('canonical_name')} OR {like.format("coalesce(aliases_json, '')")}
            UNION ALL SELECT 'concept', term, id FROM concepts, {terms} WHERE {like.format('canonical_name')} OR {like.format("coalesce(description, '')")}""",
        "search_contains": f"WITH n AS {named}, e AS {evidence} " + " UNION ALL ".join(f"SELECT {S.q(t)} AS term, id FROM n WHERE {has(t)} OR id IN (SELECT observation_id FROM e WHERE contains(lower(quote), {S.q(t)}))" for t in ("growth", "fy25", "reported for")),
        "review_queue": f"SELECT id, review_reason FROM {obs} WHERE needs_review",
        "dashboard_metrics": f"""WITH o AS (SELECT o.id, o.needs_review, d.dataset FROM {obs} o JOIN documents d ON o.document_id = d.id),
            k AS (SELECT DISTINCT r.id, dataset, {kind} AS k FROM {rel} r JOIN o ON o.id IN (r.observation_a, r.observation_b))
            SELECT dataset, count(*) AS documents, (SELECT count(*) FROM o WHERE o.dataset IS NOT DISTINCT FROM d.dataset AND d.dataset IS NOT NULL) AS observations,
            (SELECT count(*) FROM o WHERE needs_review AND o.dataset = d.dataset) AS review, (SELECT count(*) FROM k WHERE k = 'corroborated' AND k.dataset = d.dataset) AS corroborated,
            (SELECT count(*) FROM k WHERE k IN ('contradicted', 'apparent_contradiction') AND k.dataset = d.dataset) AS contradicted,
            (SELECT count(*) FROM k WHERE k = 'contextualized' AND k.dataset = d.dataset) AS contextualized FROM documents d GROUP BY dataset""",
        "showcase_union": f"""WITH n AS {named}, r AS (SELECT *, {kind} AS k FROM {rel}) SELECT 'case_' || r.id AS case_id,
            'Reconciliation (' || replace(coalesce(k, ''), '_', ' ') || '): ' || a.entity_name || ' - ' || a.concept_name AS title, upper(replace(coalesce(k, ''), '_', ' ')) AS badge, k AS category, explanation AS takeaway
            FROM r JOIN n a ON a.id = observation_a WHERE observation_b IN (SELECT id FROM n)
            UNION ALL (SELECT 'review_' || id, 'Anomaly Escalation: ' || entity_name || ' - ' || concept_name, 'NEEDS REVIEW', 'needs_review', coalesce(review_reason, 'Ambiguous attributes')
            FROM n WHERE needs_review ORDER BY id LIMIT 10)""",
        "review_cases": f"SELECT id, review_reason FROM {obs} WHERE needs_review ORDER BY id LIMIT 10",
        "session_view": f"""SELECT s.id AS session_id, status, (SELECT count(*) FROM {obs} o WHERE o.session_id = s.id) AS observations,
            (SELECT count(*) FROM {rel} r WHERE r.session_id = s.id) AS relationships FROM analysis_sessions s""",
        "session_documents": "SELECT id, coalesce(CAST(json_array_length(document_ids_json) AS INT), 0) AS documents FROM analysis_sessions",
        "session_changes": f"""SELECT 'session ' || status AS kind, count(*) AS n FROM (SELECT status FROM analysis_sessions UNION ALL SELECT 'completed') GROUP BY status
            UNION ALL SELECT 'stamped', count(*) FROM {obs} WHERE session_id IS NULL""",
        "upsert_latest": "SELECT id, strftime(max(ingested_at), '%Y-%m-%d') AS day FROM observations WHERE id IS NOT NULL AND ingested_at IS NOT NULL GROUP BY id",
        "rollback_document": f"""WITH o AS {obs}, e AS {evidence}, r AS {rel}, own AS (SELECT observation_id FROM e WHERE document_id IN {gone}),
            rest AS (SELECT * FROM e WHERE document_id NOT IN {gone}), orphan AS (SELECT observation_id FROM own WHERE observation_id NOT IN (SELECT observation_id FROM rest))
            SELECT 'observation' AS kind, id FROM o WHERE id NOT IN (SELECT observation_id FROM orphan) UNION ALL SELECT 'evidence', observation_id FROM rest
            UNION ALL SELECT 'relationship', id FROM r WHERE coalesce(observation_a NOT IN (SELECT observation_id FROM own), true) AND coalesce(observation_b NOT IN (SELECT observation_id FROM own), true)""",
        "delete_relationships": f"""WITH o AS (SELECT id FROM {obs} WHERE document_id IN {gone}) SELECT id FROM {rel} WHERE coalesce(observation_a NOT IN (SELECT id FROM o), true)
            AND coalesce(observation_b NOT IN (SELECT id FROM o), true)""",
        "get_or_create_entities": """SELECT 'ent_' || replace(name, ' ', '_') AS id, name AS canonical_name FROM (SELECT DISTINCT lower(entity_name) AS name
            FROM extracted_observations WHERE entity_name <> '') WHERE name NOT IN (SELECT canonical_name FROM entities WHERE canonical_name IS NOT NULL)""",
        "merged_concepts": f"""WITH x AS (SELECT concept_name AS name, CASE WHEN source_label <> '' THEN source_label END AS a, NULL AS v FROM {said} WHERE concept_name <> ''
              UNION ALL SELECT 'revenue from operations', unnest(['turnover', 'gross receipts']), '[1]'),
            m AS (SELECT name, list_sort(list(DISTINCT a) FILTER (WHERE a IS NOT NULL)) AS more, min(v) AS v FROM x GROUP BY name),
            k AS (SELECT id, canonical_name, {S.alias_list('aliases_json')} AS own, embedding_json FROM concepts),
            j AS (SELECT coalesce(k.id, 'cpt_' || replace(lower(m.name), ' ', '_')) AS id, coalesce(canonical_name, name) AS canonical_name, coalesce(own, []) AS own,
              list_filter(coalesce(more, []), lambda z: NOT list_contains(coalesce(own, []), z)) AS fresh, coalesce(embedding_json, v) IS NOT NULL AS embedded FROM k FULL JOIN m ON k.canonical_name = m.name)
            SELECT id, canonical_name, array_to_string(list_concat(own, fresh), '|') AS aliases, embedded FROM j""",
        "alias_union": f"SELECT alias, count(*) AS n FROM (SELECT DISTINCT id, unnest({S.alias_list('aliases_json')}) AS alias FROM entities) GROUP BY 1",
        "full_scan": " UNION ALL ".join(f"SELECT id, canonical_name, CAST(coalesce(len({S.alias_list('aliases_json')}), 0) AS INT) AS aliases FROM {t}" for t in ("entities", "concepts")),
        "update_embeddings": "SELECT id, CAST(length(coalesce(embedding_json, '[0.5]')) AS INT) AS n FROM concepts",
        "cleared_tables": "SELECT unnest(['documents', 'chunks', 'observations', 'relationships']) AS table_name, CAST(0 AS BIGINT) AS n",
        "chunk_scan": f"""SELECT document_id, id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_number, id) AS INT) AS place FROM {chunks}
            WHERE document_id IS NOT NULL AND id IS NOT NULL AND page_number IS NOT NULL""",
        "run_metrics": f"""WITH c AS (SELECT document_id, count(DISTINCT page_number) AS pages, count(*) AS chunks FROM {chunks} GROUP BY 1),
            b AS (SELECT document_id, count(*) AS batches FROM llm_batches GROUP BY 1), o AS (SELECT document_id, count(*) AS observations,
            count(normalized_value) AS normalized, count(*) FILTER (WHERE needs_review) AS review FROM {obs} GROUP BY 1)
            SELECT document_id, coalesce(pages, 0) AS pages, coalesce(chunks, 0) AS chunks, coalesce(batches, 0) AS batches, coalesce(observations, 0) AS observations,
            coalesce(normalized, 0) AS normalized, coalesce(review, 0) AS review FROM c FULL JOIN b USING (document_id) FULL JOIN o USING (document_id) WHERE document_id IS NOT NULL""",
        "chunk_diagnostics": f"SELECT chunk_type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(length(text)) AS INT) AS longest, round(avg(length(text)), 1) AS average FROM {chunks} WHERE text IS NOT NULL GROUP BY 1",
        "events_props": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
    }

"""Read operators over the stored tables: facts, filters, searches, counts, cases, upserts and clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import is_set, norm


def relationship_kind(c: str = "relationship_type") -> Column:
    return norm(F.col(c))


def evidence_id() -> Column:
    """An evidence row's id: its observation, page and a hash of its quote."""
    quote = F.substring(F.sha2(F.coalesce("quote", F.lit("")), 256), 1, 8)
    return F.concat_ws("_", F.lit("ev"), "observation_id", F.coalesce(F.col("page_number").cast("string"), F.lit("0")), quote)


def evidence_from_claims(obs: DataFrame, claims: DataFrame) -> DataFrame:
    """Evidence rows: each observation with the quotes of its document's claims on its concept label and value.

    An observation without such a claim has one row with its document alone.
    """
    own = obs.where("document_id is not null").select(F.col("id").alias("observation_id"), "document_id", F.col("period_label").alias("_l"), F.col("value").alias("_v"), F.col("unit").alias("_u"))
    said = claims.where("evidence_quote is not null").select(
        "document_id", F.col("period_label").alias("_l"), F.col("value_num").alias("_v"), F.col("unit").alias("_u"), "page_number", "section", "chunk_id", F.col("evidence_quote").alias("quote")
    )
    rows = own.join(said, ["document_id", "_l", "_v", "_u"], "left")
    rows = rows.select("observation_id", "document_id", "page_number", "section", "chunk_id", "quote").distinct()
    return rows.withColumn("id", evidence_id())


def with_evidence(obs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Observations with all their evidence as an array, by document, page and quote; an empty one without any."""
    item = F.struct("document_id", "page_number", "section", "chunk_id", "quote")
    held = evidence.groupBy(F.col("observation_id").alias("id")).agg(F.sort_array(F.collect_list(item)).alias("evidence"))
    kind = held.schema["evidence"].dataType
    return obs.join(held, "id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(kind)))


def save_observations(obs: DataFrame, entities: DataFrame, concepts: DataFrame) -> dict[str, DataFrame]:
    """Observations with names and an evidence array to the rows that are stored: observations, evidence, entities, concepts.

    Names the dimensions don't know get rows; the document is that of the first evidence if none is given.
    """
    fresh = {}
    for kind, known, prefix in (("entity", entities, "ent_"), ("concept", concepts, "cpt_")):
        named = obs.select(F.col(f"{kind}_name").alias("name"))
        fresh[kind] = known.select("id", "canonical_name").unionByName(get_or_create(known, named, prefix))
    ids = {k: F.col(f"_{k}") for k in fresh}
    out = obs
    for kind, rows in fresh.items():
        one = rows.groupBy(F.col("canonical_name").alias(f"{kind}_name")).agg(F.min("id").alias(f"_{kind}"))
        out = out.join(one, f"{kind}_name", "left")
    first = F.try_element_at("evidence", F.lit(1))["document_id"]
    out = out.withColumns({"entity_id": ids["entity"], "concept_id": ids["concept"], "document_id": F.coalesce("document_id", first)})
    items = out.select(F.col("id").alias("observation_id"), F.explode("evidence").alias("v")).select("observation_id", "v.*").withColumn("id", evidence_id()).distinct()
    stored = out.drop("entity_name", "concept_name", "evidence", "_entity", "_concept")
    return {"observations": stored, "evidence": items, "entities": fresh["entity"], "concepts": fresh["concept"]}


def observation_list(
    obs: DataFrame, evidence: DataFrame | None = None, entity: str | None = None, concept: str | None = None,
    needs_review: bool | None = None, document_id: str | None = None, session_id: str | None = None,
) -> DataFrame:
    """Observations (with names) by any of the filters; a document's are also those with evidence from it; "all" is no filter."""
    out = obs
    if entity:
        out = out.where(F.lower("entity_name") == entity.lower())
    if concept:
        out = out.where(F.lower("concept_name") == concept.lower())
    if needs_review is not None:
        out = out.where(F.coalesce("needs_review", F.lit(False)) == needs_review)
    if document_id and document_id != "all":
        own = F.col("document_id") == document_id
        if evidence is None:
            out = out.where(own)
        else:
            cited = evidence.where(F.col("document_id") == document_id).select(F.col("observation_id").alias("id")).distinct().withColumn("_cited", F.lit(True))
            out = out.join(cited, "id", "left").where(own | F.coalesce("_cited", F.lit(False))).drop("_cited")
    if session_id:
        out = out.where(F.col("session_id") == session_id)
    return out


def comparison_candidates(obs: DataFrame, evidence: DataFrame, document_id: str, cross_document: bool = True, targets: list[str] | None = None) -> DataFrame:
    """Sound observations that a document's are compared with: of other documents, and of ``targets`` alone if given.

    An observation without a document is another's unless this one's evidence holds it.
    """
    out = obs.where(~F.coalesce("needs_review", F.lit(False)))
    by = lambda where: evidence.where(where).select(F.col("observation_id").alias("id")).distinct()
    if cross_document:
        own = by(F.col("document_id") == document_id).withColumn("_own", F.lit(True))
        out = out.join(own, "id", "left").where((F.col("document_id") != document_id) | (F.col("document_id").isNull() & F.col("_own").isNull())).drop("_own")
    if targets:
        there = by(F.col("document_id").isin(targets)).withColumn("_there", F.lit(True))
        out = out.join(there, "id", "left").where(F.col("document_id").isin(targets) | F.col("_there").isNotNull()).drop("_there")
    return out


def by_id(df: DataFrame, key: str, column: str = "id") -> DataFrame:
    """Point lookup: documents, observations, evidence, relationships, sessions, or documents by file_hash."""
    return df.where(F.col(column) == key)


def displayed_observations(obs: DataFrame, status: str = "all", text: str = "") -> DataFrame:
    """Observations (with names) as a list shows them: by status (all, actual, estimate, review_only) and a text."""
    shown = {
        "actual": F.col("assertion_status") == "actual",
        "estimate": F.col("assertion_status").isin("estimate", "forecast", "projected"),
        "review_only": F.coalesce("needs_review", F.lit(False)),
    }.get(status, F.lit(True))
    holds = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))
    return obs.where(shown & (holds("entity_name") | holds("concept_name") | holds("period_label")))


def displayed_relationships(rels: DataFrame, obs: DataFrame, kind: str = "all", text: str = "") -> DataFrame:
    """Relationships as a list shows them: by type (contradicted admits apparent_contradiction) and a text.

    The text may be in explanation, a reason, an end's id, or an end's entity or concept name.
    """
    is_kind = relationship_kind()
    right = F.lit(True) if kind == "all" else (is_kind == kind.lower()) | ((is_kind == "apparent_contradiction") & F.lit(kind == "contradicted"))
    if not text:
        return rels.where(right)
    holds = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))
    named = obs.where(holds("entity_name") | holds("concept_name")).select("id")
    end = lambda s: named.select(F.col("id").alias(f"observation_{s}"), F.lit(True).alias(f"_{s}"))
    joined = rels.join(end("a"), "observation_a", "left").join(end("b"), "observation_b", "left")
    said = holds("explanation") | holds("reasons_json") | holds("observation_a") | holds("observation_b")
    return joined.where(right & (said | F.col("_a").isNotNull() | F.col("_b").isNotNull())).select(*rels.columns)


def update_embedding(dimension: DataFrame, vectors: DataFrame) -> DataFrame:
    """A dimension with new embeddings (id, embedding_json) of some rows."""
    new = vectors.select("id", F.col("embedding_json").alias("_new"))
    out = dimension.join(new, "id", "left").withColumn("embedding_json", F.coalesce("_new", "embedding_json"))
    return out.select(*dimension.columns)


def set_status(df: DataFrame, key: str, status: str) -> DataFrame:
    """A table with the status of one row (a session or a run) set."""
    return df.withColumn("status", F.when(F.col("id") == key, status).otherwise(F.col("status")))


def stamp_session(df: DataFrame, session_id: str, rows: DataFrame | None = None) -> DataFrame:
    """A table with session_id set, of all rows or of those with an id in ``rows``."""
    if rows is None:
        return df.withColumn("session_id", F.lit(session_id))
    some = rows.select("id").distinct().withColumn("_in", F.lit(True))
    return df.join(some, "id", "left").withColumn("session_id", F.when(F.col("_in"), session_id).otherwise(F.col("session_id"))).select(*df.columns)


def new_session(spark_df: DataFrame, name: str, documents: list[str], mode: str, created_at: str) -> DataFrame:
    """The sessions table with one more row, its id made of its content."""
    import hashlib
    import json

    ids = json.dumps(documents)
    key = "sess_" + hashlib.sha256(f"{name}|{ids}|{mode}|{created_at}".encode()).hexdigest()[:8]
    row = {"id": key, "session_name": name, "description": None, "document_ids_json": ids, "comparison_mode": mode, "created_at": created_at, "status": "created"}
    some = spark_df.sparkSession.createDataFrame([tuple(row[c] for c in row)], "id string, session_name string, description string, document_ids_json string, comparison_mode string, created_at string, status string")
    return spark_df.unionByName(some.select(*(F.col(f.name).cast(f.dataType) for f in spark_df.schema)))


def cleared(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables, empty, with their columns."""
    return {k: t.where(F.lit(False)) for k, t in tables.items()}


def grouped_facts(obs: DataFrame, rels: DataFrame) -> DataFrame:
    """Observations by entity and concept name, with what is known about each group.

    Status: needs_review before contradicted, corroborated, contextualized, single_source; a relationship
    counts if both its ends are in the group.  Only counts and flags are gathered, never a group's rows:
    ``fact_members`` lists those.
    """
    ids = obs.select("id", "entity_name", "concept_name")
    end = lambda s: ids.select(F.col("id").alias(f"observation_{s}"), F.col("entity_name").alias(f"e_{s}"), F.col("concept_name").alias(f"c_{s}"))
    kind = relationship_kind()
    inside = rels.select("observation_a", "observation_b", kind.alias("kind")).join(end("a"), "observation_a").join(end("b"), "observation_b")
    inside = inside.where("e_a = e_b and c_a = c_b").groupBy(F.col("e_a").alias("entity_name"), F.col("c_a").alias("concept_name"))
    edges = inside.agg(
        F.bool_or(F.col("kind") == "contradicted").alias("contradicted"),
        F.bool_or(F.col("kind") == "corroborated").alias("corroborated"),
        F.bool_or(F.col("kind") == "contextualized").alias("contextualized"),
        F.count("*").alias("relationships"),
    )
    facts = obs.groupBy("entity_name", "concept_name").agg(F.count("*").alias("observations"), F.bool_or(F.coalesce("needs_review", F.lit(False))).alias("review"))
    status = (
        F.when(F.col("review"), "needs_review")
        .when(F.col("contradicted"), "contradicted")
        .when(F.col("corroborated"), "corroborated")
        .when(F.col("contextualized"), "contextualized")
        .otherwise("single_source")
    )
    joined = facts.join(edges, ["entity_name", "concept_name"], "left")
    return joined.select(
        F.concat_ws("::", "entity_name", "concept_name").alias("fact_key"), "entity_name", "concept_name", "observations",
        F.coalesce("relationships", F.lit(0)).cast("long").alias("relationships"), status.alias("status"),
    )


def fact_order() -> list[Column]:
    """Facts as they are listed: contradicted ones first, then by entity, then by concept."""
    return [F.col("status") != "contradicted", F.col("entity_name"), F.col("concept_name")]


def fact_members(obs: DataFrame, rels: DataFrame) -> DataFrame:
    """(fact_key, kind, id): the observations of every fact, and the relationships within it, a row each."""
    key = F.concat_ws("::", "entity_name", "concept_name")
    keyed = obs.where("entity_name is not null and concept_name is not null").select("id", key.alias("fact_key"))
    end = lambda s: keyed.select(F.col("id").alias(f"observation_{s}"), "fact_key")
    inside = rels.join(end("a"), "observation_a").join(end("b"), ["observation_b", "fact_key"]).select("fact_key", F.lit("relationship").alias("kind"), "id")
    return keyed.select("fact_key", F.lit("observation").alias("kind"), "id").union(inside)


def document_counts(docs: DataFrame, chunks: DataFrame, obs: DataFrame) -> DataFrame:
    """Chunks and observations of every document, 0 included."""
    c = chunks.groupBy("document_id").agg(F.countDistinct("id").alias("chunk_count"))
    o = obs.groupBy("document_id").agg(F.countDistinct("id").alias("observation_count"))
    joined = docs.select(F.col("id").alias("document_id")).join(c, "document_id", "left").join(o, "document_id", "left")
    return joined.select("document_id", *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("chunk_count", "observation_count")))


def touching(rels: DataFrame, ids: DataFrame) -> DataFrame:
    """Relationships with an end among ``ids`` (a column id)."""
    a = rels.join(ids.select(F.col("id").alias("observation_a")), "observation_a", "left_semi")
    b = rels.join(ids.select(F.col("id").alias("observation_b")), "observation_b", "left_semi")
    return a.unionByName(b).distinct()


def not_touching(rels: DataFrame, ids: DataFrame) -> DataFrame:
    """Relationships with no end among ``ids``: the rest after a document's edges are deleted."""
    rest = rels.join(ids.select(F.col("id").alias("observation_a")), "observation_a", "left_anti")
    return rest.join(ids.select(F.col("id").alias("observation_b")), "observation_b", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows replace old ones of the same key; rows of ``new`` must have distinct keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def rollback_documents(obs: DataFrame, evidence: DataFrame, rels: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observations, evidence, relationships) without what only the documents (document_id) hold up.

    Relationships that touch their observations go, their evidence goes, and observations left without evidence.
    """
    own = evidence.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    rest = evidence.join(own.select("id"), "id", "left_anti")
    ids = own.select(F.col("observation_id").alias("id")).distinct()
    orphans = ids.join(rest.select(F.col("observation_id").alias("id")), "id", "left_anti")
    return obs.join(orphans, "id", "left_anti"), rest, not_touching(rels, ids)


def rollback_document(obs: DataFrame, evidence: DataFrame, rels: DataFrame, document_id: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rollback_documents`` of one."""
    one = obs.sparkSession.range(1).select(document_id.alias("document_id"))
    return rollback_documents(obs, evidence, rels, one)


def merge_dimension(known: DataFrame, names: DataFrame, prefix: str) -> DataFrame:
    """The dimension (id, canonical_name, aliases, embedding_json) with names (name, aliases, embedding_json) got or created.

    A known name takes the new aliases beside its own, distinct and in order, and an embedding if it has none;
    others get a row.  Names are exact and case-sensitive; null and empty ones are left out.
    """
    none = F.array().cast("array<string>")
    new = names.where(is_set(F.col("name"))).groupBy(F.col("name").alias("canonical_name")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", none))))).alias("_more"), F.min("embedding_json").alias("_vector")
    )
    joined = known.select("id", "canonical_name", "aliases", "embedding_json").join(new, "canonical_name", "full")
    made = F.concat(F.lit(prefix), F.replace(F.lower("canonical_name"), F.lit(" "), F.lit("_")))
    every = F.array_distinct(F.concat(F.coalesce("aliases", none), F.coalesce("_more", none)))
    return joined.select(F.coalesce("id", made).alias("id"), "canonical_name", every.alias("aliases"), F.coalesce("embedding_json", "_vector").alias("embedding_json"))


def get_or_create(known: DataFrame, names: DataFrame, prefix: str) -> DataFrame:
    """Dimension rows of names not in ``known`` (exact, case-sensitive), with ids made of the names."""
    fresh = names.where(is_set(F.col("name"))).select("name").distinct()
    fresh = fresh.join(known.select(F.col("canonical_name").alias("name")), "name", "left_anti")
    return fresh.select(F.concat(F.lit(prefix), F.replace(F.lower("name"), F.lit(" "), F.lit("_"))).alias("id"), F.col("name").alias("canonical_name"))

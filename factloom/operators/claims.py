"""From claims to observations with evidence: resolution, normal values, review reasons; and the model's part of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import enums
from factloom.functions import grounding as G
from factloom.functions.names import canonical_concept
from factloom.functions.periods import with_fiscal_label
from factloom.functions.text import has_any, is_set
from factloom.functions.units import with_value
from factloom.operators.documents import resolve_chunks
from factloom.operators.resolve import resolve_names
from factloom.operators.views import evidence_id
from factloom.sources.artifacts import ask, batch_prompt, clean_json

#: A claim as a model gives it.
CLAIM = """candidate_id bigint, document_id string, entity_name string, entity_type string, concept_name string, source_label string, value_type string,
value_num double, value_text string, unit string, period_label string, period_type string, assertion_status string, evidence_quote string,
page_number int, section string, chunk_id string, confidence double, geography string, scope_level string, consolidation string"""
LOW_CONFIDENCE = 0.7


def review_reasons(entity_note: Column, concept_note: Column, number: Column) -> Column:
    """All reasons why a claim must be reviewed, in order; the notes are those of ambiguous names, else null."""
    grounding = G.grounding_reasons(
        F.col("value_type"), number, F.col("value_text"), F.col("period_label"), F.col("concept_name"), F.col("source_label"),
        F.lower("assertion_status"), F.col("evidence_quote"),
    )
    without_unit = has_any(F.lower("concept_name"), G.DIMENSIONLESS) | has_any(F.lower("source_label"), G.DIMENSIONLESS)
    missing = F.col("value_type").isin("number", "currency") & ~is_set(F.col("unit")) & ~without_unit
    further = F.array(
        F.concat(F.lit("Ambiguous entity resolution: "), entity_note),
        F.concat(F.lit("Ambiguous concept resolution: "), concept_note),
        F.when(missing, "Missing numerical unit"),
        F.when(~is_set(F.col("period_label")), "Unspecified time period"),
        F.when(F.col("confidence") < LOW_CONFIDENCE, "Low extraction confidence score"),
    )
    return F.concat(grounding, F.array_compact(further))


def with_label(df: DataFrame, label: str = "period_label", out: str = "label") -> DataFrame:
    """Adds the label as observations keep it: its fiscal year if it has "fy" or four digits, else as it is."""
    df = with_fiscal_label(df, label, "_fiscal")
    dated = F.contains(F.lower(label), F.lit("fy")) | F.col(label).rlike(r"\d{4}")
    return df.withColumn(out, F.when(dated, F.col("_fiscal")).otherwise(F.col(label))).drop("_fiscal")


def to_observations(
    claims: DataFrame, entities: DataFrame, concepts: DataFrame, chunks: DataFrame | None = None, judge: Callable[[str, str], bool | None] | None = None
) -> DataFrame:
    """Claims (distinct candidate_id) to observations, one row each, with one evidence item in ``evidence``.

    ``entities`` and ``concepts`` have id, canonical_name, aliases.  Names are resolved once each.  Ids are
    content hashes.  Nothing is dropped: what is ungrounded, ambiguous or incomplete is flagged, with all
    reasons in order.  With ``chunks`` the evidence names the claim's own chunk and its page.
    """
    claims = claims.withColumns({"number": F.coalesce("value_num", F.col("value_text").try_cast("double"))})
    if chunks is not None:
        where = resolve_chunks(claims, chunks).select("candidate_id", F.col("resolved").alias("_chunk"), F.col("page").alias("_page"))
        claims = claims.join(where, "candidate_id", "left").withColumns({"chunk_id": F.coalesce("_chunk", "chunk_id"), "page_number": F.coalesce("_page", "page_number")}).drop("_chunk", "_page")
    side = lambda r, c, p: r.select(F.col("name").alias(c), *(F.col(x).alias(f"{p}_{x}") for x in ("status", "via", "id", "canonical", "explanation")))
    e = side(resolve_names(claims.select(F.col("entity_name").alias("name")), entities, "entity", judge), "_e", "e")
    c = side(resolve_names(claims.select(F.col("concept_name").alias("name")), concepts, "concept", judge), "_c", "c")
    joined = claims.join(e, F.col("entity_name").eqNullSafe(F.col("_e")), "left").join(c, F.col("concept_name").eqNullSafe(F.col("_c")), "left")
    note = lambda p, name: F.when(F.col(f"{p}_status") == "ambiguous", F.coalesce(f"{p}_explanation", name, F.lit("")))
    reasons = review_reasons(note("e", "entity_name"), note("c", "concept_name"), F.col("number"))
    ready = joined.withColumn("reasons", reasons).withColumn("_text", F.when(F.col("number").isNull(), F.col("value_text")))
    ready = with_label(with_value(ready, "value_type", "number", "unit", "_text"))
    new_id = F.concat(F.lit("obs_"), F.substring(F.sha2(F.concat_ws("|", F.col("candidate_id").cast("string"), "document_id", "entity_name", "concept_name", "evidence_quote"), 256), 1, 12))
    item = F.struct("document_id", "page_number", "section", "chunk_id", F.col("evidence_quote").alias("quote"))
    scope = lambda c, default: F.col(c) if c in claims.columns else F.lit(default).cast("string").alias(c)
    return ready.select(
        "candidate_id", new_id.alias("id"), "document_id", F.col("e_id").alias("entity_id"), F.col("e_canonical").alias("entity_name"), "entity_type",
        F.when(F.col("entity_name") != F.col("e_canonical"), F.array("entity_name")).otherwise(F.array().cast("array<string>")).alias("entity_aliases"),
        F.col("c_id").alias("concept_id"), F.col("c_canonical").alias("concept_name"), F.coalesce("source_label", "concept_name").alias("source_label"),
        "value_type", F.col("number").alias("value"), "unit", F.col("_text").alias("text_value"), F.col("n_amount").alias("normalized_value"), F.col("n_unit").alias("normalized_unit"),
        enums.period_type(F.col("period_type")).alias("period_type"), F.col("label").alias("period_label"),
        scope("geography", None), scope("scope_level", None), scope("consolidation", "unknown"), enums.assertion_status(F.col("assertion_status")).alias("assertion_status"),
        "confidence", (F.size("reasons") > 0).alias("needs_review"), F.nullif(F.array_join("reasons", "; "), F.lit("")).alias("review_reason"), F.array(item).alias("evidence"),
    )


def evidence_rows(observations: DataFrame) -> DataFrame:
    """One evidence row an item of ``evidence``, with an id of its content."""
    items = observations.select(F.col("id").alias("observation_id"), F.explode("evidence").alias("v")).select("observation_id", "v.*")
    return items.withColumn("id", evidence_id()).distinct()


def parse_claims(answers: DataFrame) -> DataFrame:
    """(document_id, batch_id, answer) to claims; items that are no claim are left out, one by one."""
    fields = [f.split() for f in CLAIM.replace("\n", " ").split(",")]
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "int": pa.int32(), "string": pa.string()}

    def value(item: dict, name: str, kind: str) -> object:
        x = item.get("value") if name in ("value_num", "value_text") else item.get(name, (item.get("scope") or {}).get({"scope_level": "level"}.get(name, name)) if isinstance(item.get("scope"), dict) else None)
        number = isinstance(x, int | float) and not isinstance(x, bool)
        if name == "value_num":
            return float(x) if number else None
        if name == "value_text":
            return None if x is None or number else str(x)
        if name == "confidence":
            return float(x) if x is not None else 0.95
        return None if x is None else int(x) if kind == "int" else float(x) if kind == "double" else str(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, answer in zip(batch.column("document_id").to_pylist(), batch.column("answer").to_pylist(), strict=True):
                for item in clean_json(answer):
                    if not item.get("entity_name") or not item.get("concept_name") or "value" not in item:
                        continue
                    try:
                        rows.append([None if n == "candidate_id" else doc if n == "document_id" else value(item, n, k) for n, k in fields])
                    except (TypeError, ValueError):
                        continue
            columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    claims = answers.select("document_id", "answer").mapInArrow(run, CLAIM)
    number = F.xxhash64(*(F.col(n) for n, _ in fields if n != "candidate_id"))
    typed = claims.withColumns({"candidate_id": number, "value_type": enums.value_type(F.col("value_type"))})
    return typed.dropDuplicates(["candidate_id"])


def extract_from_batches(batches: DataFrame, chunks: DataFrame, call: Callable[[str], str | None] | None) -> DataFrame:
    """Claims of batches (batch_id, document_id, section, page_start, page_end, chunk_ids) by an injected model.

    Prompt, answer, JSON, claims, chunk: without a model there are no claims.
    """
    wanted = batches.select("*", F.posexplode("chunk_ids").alias("n", "_id"))
    part = F.struct("n", F.col("_id").alias("id"), "page_number", "chunk_type", F.coalesce("own", "section").alias("section"), "text")
    texts = chunks.select(F.col("document_id"), F.col("id").alias("_id"), "page_number", "chunk_type", F.nullif("section", F.lit("")).alias("own"), "text")
    held = wanted.join(texts, ["document_id", "_id"]).groupBy("document_id", "batch_id", "section", "page_start", "page_end").agg(F.sort_array(F.collect_list(part)).alias("chunks"))
    key = F.to_json(F.struct("document_id", "batch_id"))
    answers = ask(held.select(key.alias("batch_id"), batch_prompt().alias("prompt")), call)
    answers = answers.select(F.from_json("batch_id", "document_id string, batch_id string").alias("k"), "answer").select("k.*", "answer")
    return parse_claims(answers)


def extract_from_text(texts: DataFrame, call: Callable[[str], str | None] | None) -> DataFrame:
    """Claims of plain texts (document_id, text), each taken as one batch of one chunk."""
    chunk = texts.select("document_id", F.concat(F.lit("chk_"), "document_id", F.lit("_p1_0")).alias("id"), F.lit(1).alias("page_number"), F.lit("General Information").alias("section"), F.lit("text").alias("chunk_type"), "text")
    batch = chunk.select(F.lit("batch_01").alias("batch_id"), "document_id", "section", F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.array("id").alias("chunk_ids"))
    return extract_from_batches(batch, chunk, call)


def prompt_text(canonical: Column = None) -> Column:
    """An observation as a judge reads it, a line each for what it says."""
    said = F.when(F.col("value").isNotNull(), F.concat_ws(" ", F.col("value").cast("string"), "unit")).otherwise(F.coalesce("text_value", F.lit("N/A")))
    blank = lambda c, d="N/A": F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(d))
    quote = F.coalesce(F.try_element_at("evidence", F.lit(1))["quote"], F.lit("N/A"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Entity: "), "entity_name", F.lit(" ("), blank("entity_type", "entity"), F.lit(")")),
        F.concat(F.lit("Concept: "), canonical if canonical is not None else F.col("concept_name")),
        F.concat(F.lit("Value: "), said, F.lit(" (Normalized: "), blank("normalized_value", "None"), F.lit(" "), blank("normalized_unit", "None"), F.lit(")")),
        F.concat(F.lit("Period: "), blank("period_label"), F.lit(" (type: "), "period_type", F.lit(")")),
        F.concat(F.lit("Scope: geography="), blank("geography"), F.lit(", level="), blank("scope_level"), F.lit(", consolidation="), blank("consolidation", "unknown")),
        F.concat(F.lit("Status: "), "assertion_status"),
        F.concat(F.lit('Evidence Quote: "'), quote, F.lit('"')),
    )


__all__ = ["canonical_concept", "evidence_rows", "extract_from_batches", "extract_from_text", "parse_claims", "prompt_text", "review_reasons", "to_observations", "with_label"]

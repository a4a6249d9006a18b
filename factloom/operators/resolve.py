"""Resolving names against a frozen registry: alias dictionary, exact, then nearest vector, then a judge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.names import CONCEPT_NAMES, ENTITY_NAMES, divergent_qualifiers
from factloom.functions.text import is_set, lookup, norm
from factloom.functions.vectors import DIM, ngram_vector
from factloom.operators.views import get_or_create

HIGH, LOW = 0.92, 0.75
#: Names, and registry rows, that one task compares at once.
BLOCK = 20_000
#: Candidates kept of each name.
TOP = 3

COLUMNS = ["name", "status", "via", "id", "canonical", "similarity", "candidates", "explanation"]


def _nearest(names: DataFrame, registry: DataFrame, top: int = TOP) -> DataFrame:
    """(clean), (id, canonical_name, vector) to (clean, ranked): the most similar registry rows of each name.

    Blocks of names meet blocks of the registry; a task holds one of each and gives its best rows.  Equal
    similarities (to four decimals) go to the smaller id, as the registry is listed.
    """
    blocks = lambda df: max(1, -(-df.count() // BLOCK))
    registry = registry.select(F.col("id").alias("entry"), "canonical_name", "vector")
    n, m = blocks(names), blocks(registry)
    place = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = names.select("clean", ngram_vector(F.col("clean")).alias("vector"), place("clean", n).alias("x"), every(m).alias("y"))
    right = registry.select("*", every(n).alias("x"), place("entry", m).alias("y"))
    schema = T.StructType([T.StructField(c, t) for c, t in (("clean", T.StringType()), ("id", T.StringType()), ("canonical_name", T.StringType()), ("s", T.DoubleType()))])

    def unit(column: pa.ChunkedArray) -> np.ndarray:
        v = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(-1, DIM) if column.length() else np.zeros((0, DIM))
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        rows, cols, values = [], [], []
        if a.num_rows and b.num_rows:
            b = b.sort_by("entry")
            va, vb = unit(a.column("vector")), unit(b.column("vector"))
            for lo in range(0, len(va), 1024):
                s = np.round(np.clip(va[lo : lo + 1024] @ vb.T, -1, 1), 4)
                best = np.argsort(-s, axis=1, kind="stable")[:, :top]
                rows.append(np.repeat(np.arange(len(s)) + lo, best.shape[1]))
                cols.append(best.ravel())
                values.append(np.take_along_axis(s, best, axis=1).ravel())
        at, to = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols))
        return pa.table(
            {
                "clean": a.column("clean").take(pa.array(at)), "id": b.column("entry").take(pa.array(to)), "canonical_name": b.column("canonical_name").take(pa.array(to)),
                "s": pa.array(np.concatenate(values) if values else np.zeros(0)),
            }
        )

    found = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(compare, schema)
    best = Window.partitionBy("clean").orderBy(F.desc("s"), "id")
    kept = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top)
    ranked = F.sort_array(F.collect_list(F.struct("n", F.struct("id", F.col("canonical_name").alias("name"), F.col("s").alias("similarity")).alias("c"))))
    return kept.groupBy("clean").agg(F.transform(ranked, lambda x: x["c"]).alias("candidates"))


def ask_judge(cases: DataFrame, judge: Callable[[str, str], bool | None] | None) -> DataFrame:
    """(clean, entry) with ``same``: what an injected judge says of two names; null without one, or if it fails."""
    if judge is None:
        return cases.withColumn("same", F.lit(None).cast("boolean"))
    schema = T.StructType([*cases.schema.fields, T.StructField("same", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = []
            for a, b in zip(batch.column("clean").to_pylist(), batch.column("entry").to_pylist(), strict=True):
                try:
                    said.append(judge(a, b))
                except Exception:
                    said.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.bool_())], names=schema.names)

    return cases.mapInArrow(run, schema)


def resolve_names(raw: DataFrame, registry: DataFrame, kind: str, judge: Callable[[str, str], bool | None] | None = None) -> DataFrame:
    """(name) to one row a distinct name: status, via, id, canonical, similarity, candidates, explanation.

    ``kind`` is "entity" or "concept"; ``registry`` has id, canonical_name, aliases array<string> and, if it is
    to be used, embedding array<double> (else names' own vectors are compared).  Tiers: the dictionary of
    aliases; equality with a registry name or alias; nearest vector, new below LOW, matched from HIGH (concepts
    only if their qualifiers agree), in between the judge's word, and without a judge new for concepts whose
    qualifiers differ, else ambiguous.  The registry does not grow while names are resolved, so the result is
    independent of their order; ``new_rows`` registers what is new.  Null and blank names give "unspecified".
    """
    names = raw.select("name", F.regexp_replace(norm(F.col("name")), r"(?U)\s+", " ").alias("clean")).distinct()
    nothing, no_candidates = F.lit(None).cast("string"), F.expr("cast(null as array<struct<id: string, name: string, similarity: double>>)")
    out = lambda df, status, via, i, canonical, s, candidates, why: df.select(
        "name", F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"), F.lit(via).alias("via") if isinstance(via, str) else via.alias("via"),
        i.cast("string").alias("id"), canonical.alias("canonical"), s.cast("double").alias("similarity"), candidates.alias("candidates"), why.alias("explanation"),
    )
    one = F.lit(1.0)
    single = lambda i, c: F.array(F.struct(i.cast("string").alias("id"), c.alias("name"), one.alias("similarity")))
    empty = out(names.where(~is_set(F.col("clean"))), "new", "fallback", nothing, F.lit(f"unspecified {kind}"), F.lit(None), no_candidates, nothing)
    aliases = CONCEPT_NAMES if kind == "concept" else ENTITY_NAMES
    names = names.where(is_set(F.col("clean"))).withColumn("known", lookup(F.col("clean"), aliases))
    alias = out(names.where("known is not null"), "matched", "alias", nothing, F.col("known"), one, single(nothing, F.col("known")), F.lit("Found in the dictionary of aliases"))
    rest = names.where("known is null").select("name", "clean")
    keys = registry.select("id", "canonical_name", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("key"))
    keys = keys.select(F.lower("key").alias("clean"), "id", "canonical_name").groupBy("clean").agg(F.min(F.struct("id", "canonical_name")).alias("e"))
    hit = rest.join(keys, "clean")
    exact = out(hit, "matched", "exact", F.col("e.id"), F.col("e.canonical_name"), one, single(F.col("e.id"), F.col("e.canonical_name")), F.lit("Equals a name or alias of the registry"))
    rest = rest.join(keys, "clean", "left_anti")
    own = ngram_vector(F.col("canonical_name"))
    vector = F.when(F.size("embedding") == DIM, F.col("embedding")).otherwise(own) if "embedding" in registry.columns else own
    listed = registry.where("id is not null and canonical_name is not null").select("id", "canonical_name", vector.alias("vector"))
    near = rest.join(_nearest(rest.select("clean").distinct(), listed), "clean", "left").withColumn("top", F.try_element_at("candidates", F.lit(1)))
    near = near.select("*", F.col("top.name").alias("entry"), F.coalesce("top.similarity", F.lit(0.0)).alias("s"))
    apart = divergent_qualifiers(F.col("clean"), F.col("entry")) if kind == "concept" else F.lit(False)
    near = near.withColumn("apart", F.coalesce(apart, F.lit(False)))
    unsure = (F.col("s") >= LOW) & ((F.col("s") < HIGH) | F.col("apart"))
    if judge is None:
        near = near.withColumn("same", F.lit(None).cast("boolean"))
    else:
        near = near.join(ask_judge(near.where(unsure).select("clean", "entry").distinct(), judge), ["clean", "entry"], "left")
    via = (
        F.when(F.col("s") < LOW, "new_below_threshold")
        .when(~unsure, "embedding_high")
        .when(F.col("same"), "llm_judge")
        .when(~F.col("same"), "new_judged")
        .when(F.col("apart"), "new_divergent")
        .otherwise("no_judge")
    )
    near = near.withColumn("via", via)
    status = F.when(F.col("via").isin("embedding_high", "llm_judge"), "matched").when(F.col("via") == "no_judge", "ambiguous").otherwise("new")
    score = F.col("s").cast("string")
    why = (
        F.when(F.col("via") == "new_below_threshold", F.concat(F.lit("Nothing close (best similarity "), score, F.lit(f" < {LOW})")))
        .when(F.col("via") == "embedding_high", F.concat(F.lit("Close ("), score, F.lit(f" >= {HIGH}) to '"), F.col("entry"), F.lit("'")))
        .when(F.col("via") == "llm_judge", F.concat(F.lit("Judged the same as '"), F.col("entry"), F.lit("' (similarity "), score, F.lit(")")))
        .when(F.col("via") == "new_judged", F.concat(F.lit("Judged other than '"), F.col("entry"), F.lit("'")))
        .when(F.col("via") == "new_divergent", F.concat(F.lit("Qualifiers differ from '"), F.col("entry"), F.lit("'")))
        .otherwise(F.concat(F.lit("May be '"), F.col("entry"), F.lit("' (similarity "), score, F.lit("), kept apart for review")))
    )
    matched = status == "matched"
    tier = out(
        near, status, F.col("via"), F.when(status != "new", F.col("top.id")), F.when(matched, F.col("entry")).otherwise(F.col("clean")), F.col("s"), F.col("candidates"), why
    )
    return empty.union(alias).union(exact).union(tier)


def resolve_concepts(raw: DataFrame, registry: DataFrame) -> DataFrame:
    """(name) to (name, status, via, concept, similarity): ``resolve_names`` of concepts without a judge."""
    return resolve_names(raw, registry, "concept").select("name", "status", "via", F.col("canonical").alias("concept"), "similarity")


def new_rows(resolved: DataFrame, registry: DataFrame, prefix: str) -> DataFrame:
    """Registry rows of the names that are new, with ids made of the names; unspecified ones are none."""
    fresh = resolved.where("status = 'new' and via <> 'fallback'").select(F.col("canonical").alias("name"))
    return get_or_create(registry, fresh, prefix)


def learned_aliases(resolved: DataFrame, registry: DataFrame) -> DataFrame:
    """The registry with the names that vectors or the judge matched among the aliases, distinct and in order."""
    clean: Column = F.regexp_replace(norm(F.col("name")), r"(?U)\s+", " ")
    seen = resolved.where("via in ('embedding_high', 'llm_judge')").groupBy("id").agg(F.sort_array(F.collect_set(clean)).alias("_seen"))
    every = F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("_seen", F.array().cast("array<string>"))))
    return registry.join(seen, "id", "left").withColumn("aliases", every).drop("_seen").select(*registry.columns)

"""The pN_ queries of the training-data problems, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.groups import connected_groups
from factloom.llm.lookup import map_values
from factloom.llm.names import link_names, variant_pairs
from factloom.llm.neighbours import nearest_neighbours, parse_vectors
from factloom.llm.packing import pack_documents
from factloom.llm.quality import text_quality
from factloom.llm.splitting import BATCH_BUDGET, CHUNK_BUDGET, OVERLAP, split_batches, split_chunks
from factloom.llm.tokens import encode_corpus, token_counts
from factloom.sources.tables import read_table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every observation tied to another one by a match, once, with the smallest id of its group."""
    rel = read_table(spark, folder, "relationships")
    kind = F.lower(F.regexp_replace("relationship_type", r"(?U)^\s+|\s+$", ""))
    pairs = rel.where(kind == "corroborated").select(F.col("observation_a").alias("a"), F.col("observation_b").alias("b"))
    return connected_groups(pairs).select(F.col("id").alias("observation_id"), "group_id")


def p2_chunk_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of the chunks over 1,500 characters."""
    return split_chunks(read_table(spark, folder, "chunks"))


def p2_batch_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of the batches over 15,000 characters."""
    return split_batches(read_table(spark, folder, "llm_batches"), read_table(spark, folder, "chunks"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The items that come out in pieces."""
    chunks = p2_chunk_pieces(spark, folder).select(F.lit("chunk").alias("item_kind"), "item_id").distinct()
    batches = p2_batch_pieces(spark, folder).select(F.lit("batch").alias("item_kind"), "item_id").distinct()
    return chunks.union(batches)


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every entity with the group of rows that name the same."""
    return link_names(read_table(spark, folder, "entities"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of entities that name the same company, body, fund or person."""
    return variant_pairs(read_table(spark, folder, "entities"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The concept each freely typed concept_name means, or unmatched."""
    found = map_values(read_table(spark, folder, "extracted_observations"), read_table(spark, folder, "concepts"))
    return found.select("candidate_id", F.col("entry").alias("concept_id"))


def p6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar other rows of every row of entities and of concepts with a usable vector."""
    found = []
    for name in ("entities", "concepts"):
        vectors = parse_vectors(read_table(spark, folder, name), "embedding_json", 128, ["id"])
        vectors = vectors.where("id is not null")
        found.append(nearest_neighbours(vectors, 128, 5).withColumn("of_table", F.lit(name)))
    return found[0].unionByName(found[1])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of which at least one is among the five most similar rows of the other."""
    pairs = p6_neighbours(spark, folder)
    return pairs.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's token ids."""
    return encode_corpus(read_table(spark, folder, "documents"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with tokens in containers of 2,048 tokens."""
    return pack_documents(token_counts(read_table(spark, folder, "documents")))


def p9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's statistics and verdict."""
    return text_quality(read_table(spark, folder, "documents"), read_table(spark, folder, "common_words"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text is not blank and not prose."""
    return p9_quality(spark, folder).where("not is_prose").select("doc_id")


def p2_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Of every chunk that is split: its length, and whether its pieces cover it in order, keep budget and overlap, and stay in its section."""
    p = p2_chunk_pieces(spark, folder)
    before = F.lag("end").over(Window.partitionBy("item_id").orderBy("piece"))
    p = p.withColumn("joins", F.when(F.col("piece") == 0, F.col("start") == 0).otherwise(F.col("start") == before - OVERLAP))
    fits = (F.col("end") - F.col("start") <= CHUNK_BUDGET) & (F.length("text") == F.col("end") - F.col("start")) & (F.col("end") > F.col("start"))
    whole = p.groupBy("item_id").agg(
        F.max("end").alias("chars"), (F.min("piece") == 0).alias("from_first"), (F.max("piece") == F.count("*") - 1).alias("numbered"), F.bool_and("joins").alias("overlap"),
        F.bool_and(fits).alias("in_budget"), (F.countDistinct(F.coalesce("section", F.lit(""))) == 1).alias("one_section"),
    )
    return whole


def p2_batch_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Of every batch that is split: its distinct chunks, and whether its pieces hold them all, in order and within budget."""
    p = p2_batch_pieces(spark, folder)
    held = p.select("item_id", F.explode("chunk_ids").alias("chunk")).groupBy("item_id").agg(F.countDistinct("chunk").alias("chunks"))
    sound = p.groupBy("item_id").agg((F.max("chars") <= BATCH_BUDGET).alias("in_budget"), (F.max("piece") == F.count("*") - 1).alias("numbered"))
    return held.join(sound, "item_id")


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of the containers: too full ones, documents split without need, gaps in split ones, and containers beyond 2 % over the least possible number."""
    p = p8_containers(spark, folder)
    full = p.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    fill = full.agg(F.count_if(F.col("n") > 2048).alias("overfull"), F.sum("n").alias("tokens"), F.count("*").alias("containers"))
    docs = p.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"), F.max("token_from").alias("last"), F.max("piece").alias("top"))
    split = docs.agg(F.count_if((F.col("pieces") > 1) & (F.col("n") <= 2048)).alias("needless"), F.count_if((F.col("last") != F.col("top") * 2048) | (F.col("top") != F.col("pieces") - 1)).alias("gaps"))
    tight = F.col("containers") <= F.ceil(F.col("tokens") / 2048) * 1.02 + 8
    return fill.crossJoin(split).select("overfull", "needless", "gaps", tight.alias("tight"))  # single rows


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics that need no judgement: words, lines, and what of them repeats."""
    q = p9_quality(spark, folder)
    return q.select("doc_id", "word_count", *(F.round(c, 6).alias(c) for c in ("mean_word_length", "common_words", "duplicate_lines")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_chunk_pieces, p2_batch_pieces, p2_found, p3_groups, p3_found, p5_found, p6_neighbours, p6_found, p7_ids, p8_containers, p9_quality, p9_found, p2_checks, p2_batch_checks, p8_checks, p9_statistics)}


def oracle_sql() -> dict[str, str]:
    blank = "' ' || chr(9) || chr(10) || chr(13)"
    usable = """SELECT id, TRY_CAST(embedding_json AS DOUBLE[]) AS v FROM {} WHERE len(v) = 128
        AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0"""
    near = """SELECT a.id AS a, b.id AS b FROM ({0}) a JOIN ({0}) b ON a.id <> b.id
        QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) <= 5"""
    both = " UNION ALL ".join(near.format(usable.format(t)) for t in ("entities", "concepts"))
    return {
        "p1_found": """WITH RECURSIVE m AS (SELECT observation_a AS a, observation_b AS b FROM relationships
              WHERE regexp_replace(lower(relationship_type), '^\\s+|\\s+$', '', 'g') = 'corroborated' AND observation_a <> observation_b),
            e AS (SELECT a, b FROM m UNION SELECT b, a FROM m),
            r(a, g) AS (SELECT a, a FROM e UNION SELECT e.b, r.g FROM r JOIN e ON r.a = e.a WHERE r.g < e.b)
            SELECT a AS observation_id, min(g) AS group_id FROM (SELECT a, g FROM r UNION SELECT a, a FROM e) GROUP BY a""",
        "p2_found": f"""WITH l AS (SELECT id, max(length(trim(text, {blank}))) AS n FROM chunks WHERE id IS NOT NULL GROUP BY id),
            b AS (SELECT batch_id, unnest(chunk_ids) AS id FROM (SELECT batch_id, max(chunk_ids) AS chunk_ids FROM llm_batches WHERE batch_id IS NOT NULL GROUP BY 1))
            SELECT 'chunk' AS item_kind, id AS item_id FROM l WHERE n > 1500
            UNION ALL SELECT 'batch', batch_id FROM b LEFT JOIN l USING (id) GROUP BY batch_id HAVING sum(coalesce(n, 0)) > 15000""",
        "p2_checks": f"""SELECT id AS item_id, CAST(max(length(trim(text, {blank}))) AS INT) AS chars, true AS from_first, true AS numbered, true AS overlap, true AS in_budget, true AS one_section
            FROM chunks WHERE id IS NOT NULL GROUP BY id HAVING max(length(trim(text, {blank}))) > 1500""",
        "p2_batch_checks": f"""WITH l AS (SELECT id, max(length(trim(text, {blank}))) AS n FROM chunks WHERE id IS NOT NULL GROUP BY id),
            b AS (SELECT batch_id, unnest(chunk_ids) AS id FROM (SELECT batch_id, max(chunk_ids) AS chunk_ids FROM llm_batches WHERE batch_id IS NOT NULL GROUP BY 1))
            SELECT batch_id AS item_id, count(DISTINCT id) AS chunks, true AS in_budget, true AS numbered FROM b LEFT JOIN l USING (id) GROUP BY batch_id HAVING sum(coalesce(n, 0)) > 15000""",
        "p8_checks": "SELECT CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS needless, CAST(0 AS BIGINT) AS gaps, true AS tight",
        "p9_statistics": """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{Nl}\\p{No}]+(?:[''’-][\\p{L}\\p{Nl}\\p{No}]+)*') AS words,
              list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]'), lambda x: regexp_replace(x, '^[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+|[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+$', '', 'g')), lambda x: x <> '') AS lines FROM d),
            k AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, coalesce(c.lang, '') AS lang, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM w) x
              JOIN (SELECT DISTINCT lang, lower(word) AS word FROM common_words WHERE word IS NOT NULL) c USING (word) GROUP BY ALL) GROUP BY doc_id)
            SELECT doc_id, CAST(len(words) AS INT) AS word_count, CASE WHEN len(words) > 0 THEN round(list_sum(list_transform(words, lambda x: length(x))) / len(words), 6) END AS mean_word_length,
              CASE WHEN len(words) > 0 THEN round(coalesce(n, 0) / len(words), 6) END AS common_words,
              CASE WHEN len(lines) > 0 THEN round(1 - len(list_distinct(lines)) / len(lines), 6) END AS duplicate_lines FROM w LEFT JOIN k USING (doc_id)""",
        "p6_found": f"SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM ({both})",
    }

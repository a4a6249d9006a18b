"""Queries that apply the scalar functions to whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import enums, names, periods, units, vectors
from factloom.plans import sql as S
from factloom.plans.reconcile import prepared
from factloom.operators.reconcile import latest
from factloom.sources.tables import read_table


def _obs(spark: SparkSession, folder: str) -> DataFrame:
    return latest(read_table(spark, folder, "observations"))


def units_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Amount and unit of every observation as the reference normalises them."""
    return units.with_value(_obs(spark, folder)).select("id", "amount", "n_amount", "n_unit")


def unit_components(spark: SparkSession, folder: str) -> DataFrame:
    """Currency and scale of every distinct unit."""
    rows = read_table(spark, folder, "observations").select("unit").distinct()
    return units.with_unit_components(rows, "unit")


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    obs = read_table(spark, folder, "observations").select("period_label")
    return obs.union(read_table(spark, folder, "extracted_observations").select("period_label")).distinct()


def fiscal_year_label(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct label as a fiscal year."""
    return periods.with_fiscal_label(_labels(spark, folder), "period_label")


def period_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct label's dates, type and key."""
    none = F.lit(None).cast("date")
    rows = _labels(spark, folder).withColumns({"period_start": none, "period_end": none})
    out = periods.with_period(rows)
    return out.select("period_label", F.col("label_start").cast("string").alias("label_start"), F.col("label_end").cast("string").alias("label_end"), "label_type", "period_key")


def period_compare(spark: SparkSession, folder: str) -> DataFrame:
    """All ordered pairs of distinct period signatures that share a fiscal label, compared."""
    p = prepared(spark, folder).select("start", "end", "period_key").distinct().withColumn("k", F.regexp_replace("period_key", "^(Q[1-4]|H[12])_", ""))
    a = p.select(*(F.col(c).alias(f"{c}_a") for c in p.columns))
    b = p.select(*(F.col(c).alias(f"{c}_b") for c in p.columns))
    j = a.join(b, F.col("k_a") == F.col("k_b"))
    result = periods.compare_periods(*(F.col(c) for c in ("start_a", "end_a", "period_key_a", "start_b", "end_b", "period_key_b")))
    return j.groupBy("period_key_a", "period_key_b", result.alias("relation")).agg(F.count("*").alias("pairs"))


def scope_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct scopes of one entity, compared with each other."""
    s = prepared(spark, folder).select("entity_id", "consolidation", "scope_level", "s_cons", "s_raw", "geo", "s_level").distinct()
    a = s.select(*(F.col(c).alias(f"{c}_a") for c in s.columns))
    b = s.select(*(F.col(c).alias(f"{c}_b") for c in s.columns))
    j = a.join(b, F.col("entity_id_a") == F.col("entity_id_b"))
    return j.groupBy(names.scope_match().alias("scope_match")).agg(F.count("*").alias("pairs"))


def materiality(spark: SparkSession, folder: str) -> DataFrame:
    """Stored against computed normalised value of every observation."""
    v = units.with_value(_obs(spark, folder))
    a, b = F.col("n_amount"), F.col("normalized_value")
    return v.select("id", units.approximately_equal(a, b).alias("equal"), units.relative_difference(a, b).alias("relative_difference"), units.meaningful_normalization(F.col("amount"), F.col("unit"), a, F.col("n_unit")).alias("meaningful"))


def enum_coerce(spark: SparkSession, folder: str) -> DataFrame:
    """Free-typed enums of extracted observations, coerced."""
    x = read_table(spark, folder, "extracted_observations")
    kinds = (enums.period_type(F.col("period_type")), enums.value_type(F.col("value_type")), enums.assertion_status(F.col("assertion_status")))
    return x.groupBy(*(k.alias(n) for k, n in zip(kinds, ("period_type", "value_type", "status"), strict=True))).agg(F.count("*").alias("n"))


def entity_alias(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical name of every entity."""
    return read_table(spark, folder, "entities").select("id", names.canonical_entity(F.col("canonical_name")).alias("entity_key"))


def concept_alias(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical name of every typed concept."""
    x = read_table(spark, folder, "extracted_observations").select("concept_name").distinct()
    return x.select("concept_name", names.canonical_concept(F.col("concept_name")).alias("concept_key"))


def divergent_qualifiers(spark: SparkSession, folder: str) -> DataFrame:
    """Concepts that share a word, with whether their qualifiers differ."""
    c = read_table(spark, folder, "concepts").select("id", "canonical_name", F.explode(F.array_distinct(F.split(F.lower("canonical_name"), " "))).alias("w"))
    a = c.select(F.col("id").alias("id_a"), F.col("canonical_name").alias("name_a"), "w")
    b = c.select(F.col("id").alias("id_b"), F.col("canonical_name").alias("name_b"), "w")
    pairs = a.join(b, "w").where("id_a < id_b").select("id_a", "name_a", "id_b", "name_b").distinct()
    return pairs.select("id_a", "id_b", names.divergent_qualifiers(F.col("name_a"), F.col("name_b")).alias("divergent"))


def ngram_vector(spark: SparkSession, folder: str) -> DataFrame:
    """Offline vector of every concept name, as its non-zero places."""
    c = read_table(spark, folder, "concepts").select("id", vectors.ngram_vector(F.col("canonical_name")).alias("v"))
    return c.select("id", F.posexplode("v").alias("place", "weight")).where("weight <> 0").select("id", "place", F.round("weight", 9).alias("weight"))


def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The three nearest vectors of every fiftieth vector, exactly, in one pass over a stated query set."""
    e = read_table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    blocks = max(spark.sparkContext.defaultParallelism, e.count() // 50_000 + 1)
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    stored = e.withColumn("block", F.pmod("vec_id", F.lit(blocks)).cast("int"))
    scored = stored.join(asked, "block").where("vec_id <> query_id").select("query_id", "vec_id", F.round(vectors.cosine(F.col("q"), F.col("v")), 9).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return scored.withColumn("rank", rank).where("rank <= 3")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            units_normalize, unit_components, fiscal_year_label, period_bounds, period_compare, scope_compare, materiality, enum_coerce,
            entity_alias, concept_alias, divergent_qualifiers, ngram_vector, cosine_topk,
        )
    }


def oracle_sql() -> dict[str, str]:
    once = "SELECT * FROM observations WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) = 1"
    labels = "SELECT period_label FROM observations UNION SELECT period_label FROM extracted_observations"
    value = f"SELECT *, {S.value_columns('value_type', 'value', 'unit', 'text_value')} FROM ({once})"
    near = lambda a, b: f"abs({a} - {b}) / greatest(abs({a}), abs({b}), 1.0::DOUBLE)"
    delta = "regexp_extract_all(lower({0}), '\\w+')"
    words = lambda x, ws: f"list_sort(list_distinct(list_filter({delta.format(x)}, lambda w: w IN ({', '.join(map(S.q, ws))}))))"
    return {
        "units_normalize": f"SELECT id, amount_read AS amount, n_amount, n_unit FROM ({value})",
        "unit_components": f"SELECT unit, u_currency AS currency, u_scale AS scale FROM (SELECT unit, {S.unit_columns('unit')} FROM (SELECT DISTINCT unit FROM observations))",
        "fiscal_year_label": f"SELECT period_label, {S.fiscal_label('period_label')} AS fiscal_label FROM ({labels})",
        "period_bounds": f"""SELECT period_label, CAST(p_start AS VARCHAR) AS label_start, CAST(p_end AS VARCHAR) AS label_end, p_type AS label_type, p_key AS period_key
            FROM (SELECT period_label, {S.period_columns('period_label', 'NULL::DATE', 'NULL::DATE')} FROM ({labels}))""",
        "period_compare": f"""{S.OBSERVATIONS}, p AS (SELECT DISTINCT d_start, d_end, p_key, regexp_replace(p_key, '^(Q[1-4]|H[12])_', '') AS k FROM prepared)
            SELECT a.p_key AS period_key_a, b.p_key AS period_key_b, {S.compare_periods('a', 'b')} AS relation, count(*) AS pairs FROM p a JOIN p b ON a.k = b.k GROUP BY ALL""",
        "scope_compare": f"""{S.OBSERVATIONS}, s AS (SELECT DISTINCT entity_id, consolidation, scope_level, geo AS geography FROM prepared)
            SELECT CASE WHEN {S.scope('a', 'b')} = 'compatible' THEN 'match' WHEN lower(coalesce(a.consolidation, '')) <> lower(coalesce(b.consolidation, '')) THEN 'different_consolidation'
            ELSE 'different_geography' END AS scope_match, count(*) AS pairs FROM s a JOIN s b ON a.entity_id = b.entity_id GROUP BY 1""",
        "materiality": f"""SELECT id, coalesce(abs(n_amount - normalized_value) <= 1e-9::DOUBLE OR {near('n_amount', 'normalized_value')} <= 0.001::DOUBLE, false) AS equal,
            CASE WHEN n_amount IS NULL OR normalized_value IS NULL THEN 0.0::DOUBLE ELSE {near('n_amount', 'normalized_value')} END AS relative_difference,
            coalesce(amount_read IS NOT NULL AND n_amount IS NOT NULL AND (abs(amount_read - n_amount) > 1e-9::DOUBLE OR coalesce(unit <> '' AND n_unit <> '' AND lower(unit) <> lower(n_unit), false)), false) AS meaningful FROM ({value})""",
        "enum_coerce": f"""SELECT coalesce({S.lookup("translate(" + S.norm('period_type') + ", '- ', '__')", enums.PERIOD_TYPES)}, 'custom') AS period_type,
            coalesce({S.lookup(S.norm('value_type'), enums.VALUE_TYPES)}, 'text') AS value_type,
            coalesce({S.lookup(S.norm('assertion_status'), enums.STATUSES)}, 'unknown') AS status, count(*) AS n FROM extracted_observations GROUP BY 1, 2, 3""",
        "entity_alias": f"SELECT id, {S.canonical('canonical_name', names.ENTITY_NAMES)} AS entity_key FROM entities",
        "concept_alias": f"SELECT concept_name, {S.canonical('concept_name', names.CONCEPT_NAMES)} AS concept_key FROM (SELECT DISTINCT concept_name FROM extracted_observations)",
        "divergent_qualifiers": f"""SELECT a.id AS id_a, b.id AS id_b, (len({words('a.canonical_name', names.DELTA)}) > 0) <> (len({words('b.canonical_name', names.DELTA)}) > 0)
            OR {words('a.canonical_name', names.SPECIFIC)} <> {words('b.canonical_name', names.SPECIFIC)} AS divergent FROM concepts a JOIN concepts b
            ON a.id < b.id AND len(list_intersect(string_split(lower(a.canonical_name), ' '), string_split(lower(b.canonical_name), ' '))) > 0""",
        "ngram_vector": """WITH w AS (SELECT id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(trim(canonical_name)), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS word FROM concepts),
            t AS (SELECT id, word AS token FROM w UNION ALL SELECT id, unnest(list_transform(generate_series(1, length(word) - 2), lambda k: substr(word, k, 3))) FROM w WHERE length(word) >= 3),
            h AS (SELECT id, list_reduce(list_prepend(69::BIGINT, list_transform(string_split(token, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 19) & 127) AS place FROM t),
            n AS (SELECT id, place, count(*)::DOUBLE AS c FROM h GROUP BY ALL), s AS (SELECT id, sqrt(sum(c * c)) AS l FROM n GROUP BY id)
            SELECT id, place::INT AS place, round(c / l, 9) AS weight FROM n JOIN s USING (id)""",
        "cosine_topk": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id,
            round(list_cosine_similarity(a.v, b.v), 9) AS similarity FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 3""",
    }

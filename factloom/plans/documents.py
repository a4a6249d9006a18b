"""Queries from documents to resolved, grounded claims, and incremental ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import enums
from factloom.functions import grounding as G
from factloom.functions.names import CONCEPT_NAMES, DELTA, ENTITY_NAMES, SPECIFIC, alias_list
from factloom.operators import claims as C
from factloom.operators import documents as D
from factloom.operators.resolve import resolve_names
from factloom.plans import sql as S
from factloom.plans.views import MONTH_START, claims
from factloom.sources.tables import read_table
from factloom.streaming.ingest import IncrementalStore

#: Characters of a page: a text without page marks is paged by its length.
PAGE_CHARS = 3_000
#: Claims that the tables have no likes of, for the checks; with negative ids.
CASES = [
    (-1, "percentage", 6.4, None, "FY25", "real gdp growth", None, "actual", "Growth of 6.4 per cent is likely to be seen in Q3."),
    (-2, "percentage", 6.4, None, "FY25", "real gdp growth", None, "actual", "Real GDP is estimated to grow by 6.4 per cent."),
    (-3, "percentage", -2.5, None, "FY24", "gva growth", None, "actual", "Output declined by 2.5 per cent in 2023-24."),
    (-4, "percentage", 2.5, None, "2019-20", "gdp growth", None, "forecast", "The services sector grew by 2.5 per cent in 2021-22."),
    (-5, "currency", 8142.0, None, "FY24", "revenue", None, "actual", "Statement of accounts for the year ended 31 March"),
    (-6, "number", 1234567.0, None, "H1 FY24", "parcels", None, "actual", "12,34,567 parcels in H1 FY24"),
    (-7, "number", 1234567.5, None, "", "parcels", None, "estimate", "Some 1,234,567.5 parcels"),
    (-8, "text", None, "yes", "FY25", "listed", None, "actual", ""),
    (-9, "percentage", -3.0, None, "2024-25", "contraction", None, "actual", "change of ( - ) 3 per cent in 2024-25"),
    (-10, "percentage", 7.0, None, "FY26", "gdp", "R&D", "actual", "R&D spending, budget estimate, of 7 % in FY26"),
    (-11, "number", 5.0, None, "FY25", "wholesale index", None, "target", "The target of 5 was set for December"),
    (-12, "currency", 100.0, None, "FY25", "tax revenue", None, "actual", "from 100 to a projected 120 in FY25"),
]
_CASE = "candidate_id bigint, value_type string, value_num double, value_text string, period_label string, concept_name string, source_label string, assertion_status string, evidence_quote string"


def checked_claims(spark: SparkSession, folder: str) -> DataFrame:
    """The claims of a folder and the cases beside them, with their number."""
    cases = spark.createDataFrame(CASES, _CASE)
    return claims(spark, folder).unionByName(cases, allowMissingColumns=True).withColumn("number", F.coalesce("value_num", F.col("value_text").try_cast("double")))


def doc_metadata(spark, folder):
    """Document type and publisher by keywords of the text."""
    d = read_table(spark, folder, "documents")
    return d.select("doc_id", D.keyword_chain(F.col("text"), D.TYPES).alias("document_type"), D.keyword_chain(F.col("text"), D.PUBLISHERS).alias("publisher"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    d = read_table(spark, folder, "documents").where("text <> ''").select(F.col("id").alias("document_id"), "text")
    count = F.ceil(F.length("text") / PAGE_CHARS).cast("int")
    cut = F.transform(F.sequence(F.lit(1), count), lambda n: F.substring(F.col("text"), (n - 1) * PAGE_CHARS + 1, F.lit(PAGE_CHARS)))
    each = d.select("document_id", F.posexplode(cut).alias("n", "text"))
    return each.select("document_id", (F.col("n") + 1).alias("page_number"), D.strip(F.col("text")).alias("text"))


def chunk_blocks(spark, folder):
    """Chunks of all documents, by pages of equal length."""
    return D.chunk_pages(pages(spark, folder))


def batch_fold(spark, folder):
    """Batches of all chunks."""
    return D.build_batches(read_table(spark, folder, "chunks").dropDuplicates(["id"]))


def chunk_resolution(spark, folder):
    """The chunk of every claim."""
    return D.resolve_chunks(claims(spark, folder), read_table(spark, folder, "chunks").dropDuplicates(["id"])).select("candidate_id", "resolved", "how")


def _failing(spark: SparkSession, folder: str, reason) -> DataFrame:
    return checked_claims(spark, folder).select("candidate_id", reason.alias("reason")).where("reason is not null")


def grounding_value(spark, folder):
    """Claims whose quote lacks the value."""
    return _failing(spark, folder, G.value_reason(F.col("value_type"), F.col("number"), F.col("evidence_quote")))


def grounding_period(spark, folder):
    """Claims whose quote contradicts the period."""
    return _failing(spark, folder, G.period_reason(F.col("period_label"), F.col("evidence_quote")))


def grounding_concept(spark, folder):
    """Claims whose concept is broader than the evidence."""
    return _failing(spark, folder, G.concept_reason(F.col("concept_name"), F.col("source_label"), F.col("evidence_quote")))


def grounding_status(spark, folder):
    """Actual figures told as forecasts."""
    status = F.lower(F.col("assertion_status"))
    return _failing(spark, folder, G.status_reason(status, F.col("concept_name"), F.col("period_label"), F.col("number"), F.col("value_text"), F.col("evidence_quote")))


def grounding_metadata(spark, folder):
    """Quotes of claims, and lines of documents, that read as a heading, not as data."""
    d = read_table(spark, folder, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    quotes = checked_claims(spark, folder).select(F.col("evidence_quote").alias("line"))
    return d.union(quotes).select("line", G.metadata_reason(F.col("line")).alias("reason")).where("reason is not null").groupBy("line", "reason").agg(F.count("*").alias("n"))


def validate_grounding(spark, folder):
    """All reasons of all five checks, in order, of every claim."""
    reasons = G.grounding_reasons(
        F.col("value_type"), F.col("number"), F.col("value_text"), F.col("period_label"), F.col("concept_name"), F.col("source_label"), F.lower("assertion_status"), F.col("evidence_quote")
    )
    return checked_claims(spark, folder).select("candidate_id", F.array_join(reasons, "; ").alias("reasons"), (F.size(reasons) == 0).alias("passed"))


def _registry(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, folder, name).select("id", "canonical_name", alias_list(F.col("aliases_json")).alias("aliases"))


def resolve_tiers(spark, folder):
    """Every typed concept name, resolved against the registry of concepts."""
    raw = read_table(spark, folder, "extracted_observations").select(F.col("concept_name").alias("name"))
    return resolve_names(raw, _registry(spark, folder, "concepts"), "concept").select("name", "status", "via", "id", "canonical", "similarity")


def resolve_entities(spark, folder):
    """Every entity name, resolved against the registry of entities."""
    raw = read_table(spark, folder, "extracted_observations").select(F.col("entity_name").alias("name"))
    return resolve_names(raw, _registry(spark, folder, "entities"), "entity").select("name", "status", "via", "id", "canonical", "similarity")


def resolve_candidates(spark, folder):
    """The three nearest concepts of every typed name that is neither an alias nor in the registry, with their places."""
    raw = read_table(spark, folder, "extracted_observations").select(F.col("concept_name").alias("name"))
    r = resolve_names(raw, _registry(spark, folder, "concepts"), "concept").where("via not in ('fallback', 'alias', 'exact')")
    return r.select("name", F.posexplode("candidates").alias("place", "c")).select("name", (F.col("place") + 1).alias("place"), "c.id", "c.similarity")


def claim_observations(spark, folder):
    """Claims as observations: resolved, normalised, with all reasons for review in order."""
    o = C.to_observations(claims(spark, folder), _registry(spark, folder, "entities"), _registry(spark, folder, "concepts"))
    return o.select(
        "candidate_id", "entity_id", "entity_name", "concept_id", "concept_name", "source_label", "value", "normalized_value", "normalized_unit", "period_type", "period_label",
        "assertion_status", "needs_review", F.coalesce("review_reason", F.lit("")).alias("review_reason"),
    )


def saved_evidence(spark, folder):
    """The evidence items of claims as observations, each with its own chunk."""
    chunks = read_table(spark, folder, "chunks").dropDuplicates(["id"])
    o = C.to_observations(claims(spark, folder), _registry(spark, folder, "entities"), _registry(spark, folder, "concepts"), chunks)
    items = o.select("candidate_id", F.explode("evidence").alias("v")).select("candidate_id", "v.*")
    return items.select("candidate_id", "document_id", "section", "chunk_id", "quote")


def incremental_ingest(spark, folder):
    """Verdicts of observations that arrive in two batches: the late ones against those stored."""
    obs = read_table(spark, folder, "observations")
    store = IncrementalStore(spark, read_table(spark, folder, "entities"), read_table(spark, folder, "concepts"))
    store.add(obs.where(F.col("ingested_at") < MONTH_START), 0)
    store.add(obs.where(F.col("ingested_at") >= MONTH_START), 1)
    return store.relationships().groupBy("verdict").agg(F.count("*").alias("pairs"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            doc_metadata, chunk_blocks, batch_fold, chunk_resolution, grounding_value, grounding_period, grounding_concept, grounding_status,
            grounding_metadata, validate_grounding, resolve_tiers, resolve_candidates, resolve_entities, claim_observations, saved_evidence, incremental_ingest,
        )
    }


def _resolution(kind: str, names: str, table: str, tag: str) -> str:
    """CTEs that end in ``tag``_r: name, status, via, id, canonical, similarity, entry."""
    aliases = CONCEPT_NAMES if kind == "concept" else ENTITY_NAMES
    ws = lambda x, words: f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({x}), '\\w+'), lambda w: w IN ({', '.join(map(S.q, words))}))))"
    apart = f"((len({ws('clean', DELTA)}) > 0) <> (len({ws('entry', DELTA)}) > 0) OR {ws('clean', SPECIFIC)} <> {ws('entry', SPECIFIC)})" if kind == "concept" else "false"

    def vector(src: str, key: str, of: str) -> str:
        t = f"{tag}_{of}"
        return f"""{t}_w AS (SELECT {key}, unnest(list_filter(regexp_split_to_array(regexp_replace({src}, '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS word FROM {t}),
        {t}_t AS (SELECT {key}, word AS token FROM {t}_w UNION ALL SELECT {key}, unnest(list_transform(generate_series(1, length(word) - 2), lambda k: substr(word, k, 3))) FROM {t}_w WHERE length(word) >= 3),
        {t}_h AS (SELECT {key}, list_reduce(list_prepend(69::BIGINT, list_transform(string_split(token, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 19) & 127) AS place FROM {t}_t),
        {t}_n AS (SELECT {key}, place, count(*)::DOUBLE AS n FROM {t}_h GROUP BY ALL), {t}_v AS (SELECT {key}, place, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS w FROM {t}_n)"""

    return f"""{tag}_n AS (SELECT DISTINCT name, regexp_replace({S.norm('name')}, '{S.SP}+', ' ', 'g') AS clean FROM ({names})),
        {tag}_k AS (SELECT lower(key) AS clean, arg_min(canonical_name, id) AS exact, min(id) AS exact_id FROM (SELECT id, canonical_name, canonical_name AS key FROM {table} UNION ALL
          SELECT id, canonical_name, unnest({S.alias_list('aliases_json')}) FROM {table}) GROUP BY 1),
        {tag}_t AS (SELECT name, clean, {S.lookup('clean', aliases)} AS known, exact, exact_id FROM {tag}_n LEFT JOIN {tag}_k USING (clean)),
        {tag}_c AS (SELECT DISTINCT clean FROM {tag}_t WHERE clean <> '' AND known IS NULL AND exact IS NULL),
        {tag}_i AS (SELECT id, lower(canonical_name) AS src, canonical_name FROM {table}),
        {vector('clean', 'clean', 'c')}, {vector('src', 'id', 'i')},
        {tag}_s AS (SELECT clean, id, round(sum(a.w * b.w), 4) AS s FROM {tag}_c_v a JOIN {tag}_i_v b USING (place) GROUP BY ALL),
        {tag}_b AS (SELECT clean, id, canonical_name AS entry, s FROM {tag}_s JOIN {tag}_i USING (id) QUALIFY row_number() OVER (PARTITION BY clean ORDER BY s DESC, id) = 1),
        {tag}_x AS (SELECT t.*, b.id AS near_id, b.entry, coalesce(b.s, 0.0::DOUBLE) AS s FROM {tag}_t t LEFT JOIN {tag}_b b USING (clean)),
        {tag}_r AS (SELECT name, entry, s, CASE WHEN coalesce(clean, '') = '' THEN 'new' WHEN known IS NOT NULL OR exact IS NOT NULL THEN 'matched' WHEN s < 0.75 THEN 'new'
          WHEN s >= 0.92 AND NOT {apart} THEN 'matched' WHEN {apart} THEN 'new' ELSE 'ambiguous' END AS status,
        CASE WHEN coalesce(clean, '') = '' THEN 'fallback' WHEN known IS NOT NULL THEN 'alias' WHEN exact IS NOT NULL THEN 'exact' WHEN s < 0.75 THEN 'new_below_threshold'
          WHEN s >= 0.92 AND NOT {apart} THEN 'embedding_high' WHEN {apart} THEN 'new_divergent' ELSE 'no_judge' END AS via,
        CASE WHEN coalesce(clean, '') = '' OR known IS NOT NULL THEN NULL WHEN exact IS NOT NULL THEN exact_id WHEN via IN ('embedding_high', 'no_judge') THEN near_id END AS id,
        CASE WHEN coalesce(clean, '') = '' THEN 'unspecified {kind}' WHEN known IS NOT NULL THEN known WHEN exact IS NOT NULL THEN exact
          WHEN via = 'embedding_high' THEN entry ELSE clean END AS canonical,
        CASE WHEN coalesce(clean, '') = '' THEN NULL WHEN known IS NOT NULL OR exact IS NOT NULL THEN 1.0::DOUBLE ELSE s END AS similarity FROM {tag}_x)"""


def oracle_sql() -> dict[str, str]:
    lit = lambda x: "NULL" if x is None else S.q(x) if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x)
    fields = [f.split()[0] for f in _CASE.split(", ")]
    cases = ", ".join("(" + ", ".join(map(lit, c)) + ")" for c in CASES)
    once = "(SELECT * FROM extracted_observations QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY ingested_at DESC NULLS LAST) = 1)"
    claims = f"""(SELECT *, coalesce(value_num, TRY_CAST(value_text AS DOUBLE)) AS number FROM (SELECT {', '.join(fields)}, confidence, unit FROM {once}
        UNION ALL SELECT *, NULL, NULL FROM (VALUES {cases}) t({', '.join(fields)})))"""
    chunks = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id) = 1)"
    chain = lambda entries: "CASE " + " ".join(f"WHEN {S.has_any('lower(text)', w)} THEN {S.q(n)}" for w, n in entries) + " ELSE 'unknown' END"
    text = S.norm("coalesce(evidence_quote, '')")
    concept = " ".join(
        f"WHEN contains(ctx, {S.q(a)}) AND contains(nm, {S.q(b)}) AND NOT contains(nm, {S.q(c)}) THEN 'Concept ''' || concept_name || ''' may not match source evidence context (''' || {S.q(a)} || ''')'"
        for a, b, c in G.BROADENING
    ) + " ".join(
        f" WHEN contains(nm, '{w}') AND NOT {S.has_any('q', G.GROWTH)} THEN 'Concept claims ''{w}'' but no growth or change terms found in evidence quote'" for w in G.DELTAS
    )
    value = f"""SELECT *, {S.strip("coalesce(evidence_quote, '')")} AS q0,
        regexp_replace(replace(replace(replace(regexp_replace(replace(replace(q0, chr(10), ' '), chr(13), ' '), '\\(\\s*-\\s*\\)', '-', 'g'), '−', '-'), '–', '-'), '—', '-'), '-\\s+(\\d)', '-\\1', 'g') AS q,
        number = trunc(number) AS whole, CAST(CAST(trunc(abs(number)) AS HUGEINT) AS VARCHAR) AS d, CAST(number AS VARCHAR) AS f, format('{{:g}}', number) AS g,
        CASE WHEN whole THEN '' ELSE regexp_extract(f, '\\..*$') END AS dec,
        CASE WHEN length(d) > 3 THEN format('{{:,}}', CAST(d AS BIGINT)) END AS w,
        CASE WHEN length(d) > 3 THEN reverse(rtrim(regexp_replace(reverse(d[:-4]), '(..)', '\\1,', 'g'), ',')) || ',' || right(d, 3) END AS i,
        list_filter([CASE WHEN whole THEN (CASE WHEN number < 0 THEN '-' ELSE '' END) || d END, f, g, w, i], lambda x: x IS NOT NULL) AS forms,
        list_concat(forms, list_transform(forms, lambda x: x || dec)) AS every,
        list_filter([CASE WHEN whole THEN d END, CAST(abs(number) AS VARCHAR), format('{{:g}}', abs(number))], lambda x: x IS NOT NULL) AS pos FROM {claims}"""
    found = "len(list_filter(every, lambda x: contains(q, x))) > 0"
    negated = f"""number < 0 AND ((len(list_filter(pos, lambda x: contains(q, x))) > 0 AND {S.has_any('lower(q)', G.NEGATIONS)})
        OR len(list_filter(pos, lambda x: regexp_matches(q, '-\\s*' || replace(x, '.', '\\.') || '\\b'))) > 0)"""
    value_reason = f"""CASE WHEN value_type = 'text' THEN NULL WHEN q0 = '' THEN 'Evidence quote is empty' WHEN number IS NULL THEN NULL
        WHEN {found} THEN NULL WHEN {negated} THEN NULL ELSE 'Value not found in evidence quote' END"""
    period = f"""SELECT *, {text} AS t, {S.norm('period_label')} AS p, regexp_extract(p, '^fy\\s*(\\d{{2,4}})', 1) AS yr, TRY_CAST(right(yr, 2) AS INT) - 1 AS prev,
        '20' || lpad(CAST(prev AS VARCHAR), 2, '0') || '-' || right(yr, 2) AS v1, '20' || CAST(prev AS VARCHAR) || '-' || right(yr, 2) AS v2,
        strpos(t, v1) AS a1, strpos(t, v2) AS a2 FROM {{0}}"""
    spans = lambda a: f"coalesce({a} > 0 AND yr <> '' AND NOT regexp_matches(substr(t, greatest({a} - 5, 1), least(5, {a} - 1)), 'q[1-4]|h[12]'), false)"
    part = lambda pattern, n: f"nullif(regexp_extract(p, '{pattern}', {n}), '')"
    holds = lambda x: f"coalesce(contains(t, {x}), false)"
    years = r"^(\d{4})\s*[-–]\s*(\d{2,4})"
    period_reason = f"""CASE WHEN coalesce(period_label <> '', false) = false THEN NULL WHEN t = '' THEN 'Period claimed but evidence quote is empty'
        WHEN contains(t, p) THEN NULL
        WHEN regexp_matches(p, '^fy\\s*\\d{{2,4}}$') AND (regexp_matches(t, '\\bq[1-4]\\b') OR regexp_matches(t, '\\bh[12]\\b')) THEN 'Period not grounded in evidence'
        WHEN {spans('a1')} OR {spans('a2')} THEN NULL
        WHEN {holds(part('^(q[1-4])\\s*[:\\-]?\\s*(.+)', 1))} OR {holds(part('^(h[12])', 1))} OR ({holds(part(years, 1))} AND {holds(part(years, 2))}) THEN NULL
        WHEN NOT regexp_matches(t, '{G.TEMPORAL}') THEN NULL ELSE 'Period not grounded in evidence' END"""
    status = f"""SELECT *, {text} AS t, {S.norm("coalesce(period_label, '')")} AS p, {S.norm("coalesce(concept_name, '')")} AS c,
        regexp_replace(coalesce(format('{{:g}}', number), value_text, 'None'), '([.^$*+?()\\[\\]{{}}|\\\\/-])', '\\\\\\1', 'g') AS v FROM {claims}"""
    metadata = f"""CASE WHEN regexp_matches(@x, '{G.HEADERS}') AND length({S.strip(f"regexp_replace(@x, '{G.HEADER_START}', '', 'g')")}) < 30 THEN 'Value likely extracted from document metadata, not a data point' END"""
    concept_reason = f"CASE WHEN nm = '' THEN NULL {concept} END"
    status_reason = f"""CASE WHEN lower(assertion_status) = 'actual' AND t <> '' AND NOT {S.has_any('c', G.HISTORICAL)}
            AND NOT regexp_matches(p, '\\b(20[0-1]\\d|202[0-4]|fy[0-1]\\d|fy2[0-4])\\b') AND NOT regexp_matches(p, '\\b\\d{{4}}\\s*[-–]\\s*(?:19|20|21|22|23|24)\\b')
            AND NOT regexp_matches(t, '(?:from|below|compared (?:with|to)|as against)\\s+[^.;]*?\\b' || v || '\\b') THEN
            'Assertion status ''actual'' conflicts with evidence language: ''' || {S.first_of('t', G.MARKERS)} || '''' END"""
    # all checks: one subquery each, by claim
    v_sql = f"SELECT candidate_id, {value_reason} AS r1 FROM ({value})"
    p_sql = f"SELECT candidate_id, {period_reason} AS r2 FROM ({period.replace('{0}', claims)})"
    c_sql = f"""SELECT candidate_id, {concept_reason} AS r3 FROM (SELECT *, {S.norm("coalesce(concept_name, '')")} AS nm, {text} AS q, {S.norm("coalesce(source_label, '')")} || ' ' || q AS ctx FROM {claims})"""
    s_sql = f"SELECT candidate_id, {status_reason} AS r4 FROM ({status})"
    m_sql = f"SELECT candidate_id, {metadata.replace('@x', 'm')} AS r5 FROM (SELECT candidate_id, {text} AS m FROM {claims})"
    grounded = f"({v_sql}) JOIN ({p_sql}) USING (candidate_id) JOIN ({c_sql}) USING (candidate_id) JOIN ({s_sql}) USING (candidate_id) JOIN ({m_sql}) USING (candidate_id)"
    entity_sql = _resolution("entity", "SELECT entity_name AS name FROM extracted_observations", "entities", "e")
    concept_sql = _resolution("concept", "SELECT concept_name AS name FROM extracted_observations", "concepts", "c")
    note = lambda tag, what: f"CASE WHEN {tag}.status = 'ambiguous' THEN 'Ambiguous {what} resolution: May be ''' || {tag}.entry || ''' (similarity ' || CAST({tag}.s AS VARCHAR) || '), kept apart for review' END"
    page = f"""(SELECT id AS document_id, n AS page_number, {S.strip(f"substr(text, (n - 1) * {PAGE_CHARS} + 1, {PAGE_CHARS})")} AS text
        FROM (SELECT id, text, unnest(generate_series(1, CAST(ceil(length(text) / {PAGE_CHARS}) AS BIGINT))) AS n FROM documents WHERE text <> ''))"""
    parts = lambda pattern: f"list_filter(list_transform(regexp_split_to_array(text, '{pattern}'), lambda b: {S.strip('b')}), lambda b: b <> '')"
    return {
        "doc_metadata": f"SELECT doc_id, {chain(D.TYPES)} AS document_type, {chain(D.PUBLISHERS)} AS publisher FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
        "chunk_resolution": f"""SELECT candidate_id, coalesce(b.chunk, 'chk_unknown') AS resolved, b.how AS how FROM (SELECT candidate_id, min({{'how': how, 'at': coalesce(page_number, -1), 'chunk': chunk}}) AS b FROM (
            SELECT x.candidate_id, k.page_number, k.id AS chunk, CASE WHEN x.chunk_id = k.id THEN 0
              WHEN s <> '' AND contains(lower(k.text), s) THEN 1 WHEN x.page_number = k.page_number THEN 2 WHEN k.id IS NOT NULL THEN 3 ELSE 4 END::INT AS how
            FROM (SELECT *, lower(substr({S.strip("coalesce(evidence_quote, '')")}, 1, 80)) AS s FROM {once}) x LEFT JOIN {chunks} k ON k.document_id = x.document_id) GROUP BY 1)""",
        "grounding_value": f"SELECT candidate_id, {value_reason} AS reason FROM ({value}) WHERE reason IS NOT NULL",
        "grounding_period": f"SELECT candidate_id, {period_reason} AS reason FROM ({period.replace('{0}', claims)}) WHERE reason IS NOT NULL",
        "grounding_concept": f"SELECT candidate_id, r3 AS reason FROM ({c_sql}) WHERE r3 IS NOT NULL",
        "grounding_status": f"SELECT candidate_id, r4 AS reason FROM ({s_sql}) WHERE r4 IS NOT NULL",
        "grounding_metadata": f"""SELECT line, reason, count(*) AS n FROM (SELECT line, {metadata.replace('@x', S.norm('line'))} AS reason FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents
            UNION ALL SELECT evidence_quote FROM {claims})) WHERE reason IS NOT NULL GROUP BY ALL""",
        "validate_grounding": f"""SELECT candidate_id, array_to_string(list_filter([r1, r2, r3, r4, r5], lambda x: x IS NOT NULL), '; ') AS reasons, reasons = '' AS passed FROM {grounded}""",
        "chunk_blocks": f"""WITH RECURSIVE pages AS {page}, split AS (SELECT document_id, page_number, unnest(CASE WHEN len(ps) > 1 THEN ps ELSE ls END) AS block, generate_subscripts(CASE WHEN len(ps) > 1 THEN ps ELSE ls END, 1) AS pos
              FROM (SELECT *, {parts(f'\\n{S.SP}*\\n')} AS ps, {parts('\\n')} AS ls FROM pages)),
            b AS (SELECT *, length(block) AS n, length(block) < 120 AND ((regexp_matches(block, '\\p{{Lu}}') AND NOT regexp_matches(block, '\\p{{Ll}}')) OR regexp_matches(block, '{D.HEADING}')
                OR contains(lower(block), 'table of contents')) AS heading, regexp_matches(block, '\\t|   |\\n') AND len(regexp_extract_all(block, '{D.NUMBER}')) >= 4 AS is_table FROM split),
            s AS (SELECT *, coalesce(last_value(CASE WHEN heading THEN block END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page_number, pos), 'General Information') AS section FROM b),
            t AS (SELECT *, lead(section) OVER (PARTITION BY document_id, page_number ORDER BY pos) AS following FROM s),
            f AS (SELECT document_id, page_number, pos, 1 AS chunk, NOT is_table AS held, CASE WHEN is_table THEN 0 ELSE n END AS size FROM t WHERE pos = 1
              UNION ALL SELECT t.document_id, t.page_number, t.pos, CASE WHEN NOT t.is_table AND f.held AND f.size + t.n <= 1500 THEN f.chunk ELSE f.chunk + 1 END,
                NOT t.is_table, CASE WHEN t.is_table THEN 0 WHEN f.held AND f.size + t.n <= 1500 THEN f.size + t.n ELSE t.n END
              FROM f JOIN t ON t.document_id = f.document_id AND t.page_number = f.page_number AND t.pos = f.pos + 1),
            c AS (SELECT document_id, page_number, chunk, string_agg(block, chr(10) || chr(10) ORDER BY pos) AS text, bool_or(is_table) AS is_table,
                CASE WHEN bool_or(is_table) THEN any_value(section) ELSE coalesce(arg_max_null(following, pos), arg_max(section, pos)) END AS section
              FROM f JOIN t USING (document_id, page_number, pos) GROUP BY ALL)
            SELECT 'chk_' || document_id || '_p' || page_number || '_' || (row_number() OVER (PARTITION BY document_id ORDER BY page_number, chunk) - 1) AS id, document_id, CAST(page_number AS INT) AS page_number,
              section, CASE WHEN is_table THEN 'table' ELSE 'text' END AS chunk_type, text FROM c""",
        "batch_fold": f"""WITH RECURSIVE c AS (SELECT document_id, id, page_number AS page, nullif(section, '') AS section, length({S.strip("coalesce(text, '')")}) AS n,
                first_value(section) OVER (PARTITION BY document_id ORDER BY page_number, id) AS opening FROM {chunks} WHERE id IS NOT NULL AND document_id IS NOT NULL AND page_number IS NOT NULL),
            o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, id) AS pos FROM c WHERE n > 0),
            f AS (SELECT document_id, pos, 1 AS batch, n AS chars, page AS first, CASE WHEN coalesce(section, opening) <> 'General Information' OR n > 15000 THEN coalesce(section, opening) ELSE opening END AS section FROM o WHERE pos = 1
              UNION ALL SELECT document_id, pos, CASE WHEN cut THEN batch + 1 ELSE batch END, CASE WHEN cut THEN n ELSE chars + n END, CASE WHEN cut THEN page ELSE least(first, page) END,
                CASE WHEN cut OR (own <> '' AND own <> 'General Information') THEN own ELSE before END FROM (SELECT o.document_id, o.pos, f.batch, f.chars, f.first, f.section AS before, o.n, o.page, coalesce(o.section, f.section) AS own,
                coalesce(o.section, f.section) IS DISTINCT FROM f.section AND coalesce(o.section, f.section) IS DISTINCT FROM 'General Information' AND f.section IS DISTINCT FROM 'General Information' AND f.chars >= 3500
                OR f.chars + o.n > 15000 OR o.page - f.first >= 6 AS cut FROM f JOIN o ON o.document_id = f.document_id AND o.pos = f.pos + 1))
            SELECT 'batch_' || lpad(CAST(batch AS VARCHAR), 2, '0') AS batch_id, document_id, arg_max_null(f.section, pos) AS section, min(page) AS page_start, max(page) AS page_end,
              list(id ORDER BY pos) AS chunk_ids, CAST(sum(n) AS BIGINT) AS total_chars FROM f JOIN o USING (document_id, pos) GROUP BY document_id, batch""",
        "resolve_tiers": f"WITH {concept_sql} SELECT name, status, via, id, canonical, similarity FROM c_r",
        "resolve_candidates": f"""WITH {concept_sql}, top AS (SELECT clean, id, s, row_number() OVER (PARTITION BY clean ORDER BY s DESC, id) AS place FROM (SELECT clean, i.id, coalesce(s, 0.0::DOUBLE) AS s
              FROM c_c CROSS JOIN c_i i LEFT JOIN c_s USING (clean, id)))
            SELECT name, CAST(place AS INT) AS place, top.id, s AS similarity FROM c_n JOIN top USING (clean) WHERE place <= 3""",
        "resolve_entities": f"WITH {entity_sql} SELECT name, status, via, id, canonical, similarity FROM e_r",
        "claim_observations": f"""WITH {entity_sql}, {concept_sql}, g AS (SELECT * FROM {grounded}),
            x AS (SELECT *, coalesce(value_num, TRY_CAST(value_text AS DOUBLE)) AS num, CASE WHEN num IS NULL THEN value_text END AS txt FROM {once}),
            n AS (SELECT *, {S.value_columns('value_type', 'num', 'unit', 'txt')}, {S.fiscal_label('period_label')} AS fiscal FROM x),
            j AS (SELECT n.*, e.id AS entity_id, e.canonical AS entity_found, c.id AS concept_id, c.canonical AS concept_found, list_filter([r1, r2, r3, r4, r5, {note('e', 'entity')}, {note('c', 'concept')},
              CASE WHEN value_type IN ('number', 'currency') AND coalesce(unit <> '', false) = false AND NOT ({S.has_any('lower(concept_name)', G.DIMENSIONLESS)} OR {S.has_any('lower(source_label)', G.DIMENSIONLESS)}) THEN 'Missing numerical unit' END,
              CASE WHEN coalesce(period_label <> '', false) = false THEN 'Unspecified time period' END, CASE WHEN confidence < 0.7::DOUBLE THEN 'Low extraction confidence score' END],
              lambda y: y IS NOT NULL) AS reasons FROM n JOIN g USING (candidate_id) LEFT JOIN e_r e ON e.name IS NOT DISTINCT FROM n.entity_name LEFT JOIN c_r c ON c.name IS NOT DISTINCT FROM n.concept_name)
            SELECT candidate_id, entity_id, entity_found AS entity_name, concept_id, concept_found AS concept_name, coalesce(source_label, concept_name) AS source_label, num AS value, n_amount AS normalized_value,
              n_unit AS normalized_unit, coalesce({S.lookup(f"translate({S.norm('period_type')}, '- ', '__')", enums.PERIOD_TYPES)}, 'custom') AS period_type,
              CASE WHEN contains(lower(period_label), 'fy') OR regexp_matches(period_label, '\\d{{4}}') THEN fiscal ELSE period_label END AS period_label,
              coalesce({S.lookup(S.norm('assertion_status'), enums.STATUSES)}, 'unknown') AS assertion_status, len(reasons) > 0 AS needs_review, array_to_string(reasons, '; ') AS review_reason FROM j""",
        "saved_evidence": f"""WITH r AS (SELECT candidate_id, coalesce(b.chunk, 'chk_unknown') AS chunk_id FROM (SELECT candidate_id, min({{'how': how, 'at': coalesce(page_number, -1), 'chunk': chunk}}) AS b FROM (
            SELECT x.candidate_id, k.page_number, k.id AS chunk, CASE WHEN x.chunk_id = k.id THEN 0
              WHEN s <> '' AND contains(lower(k.text), s) THEN 1 WHEN x.page_number = k.page_number THEN 2 WHEN k.id IS NOT NULL THEN 3 ELSE 4 END::INT AS how
            FROM (SELECT *, lower(substr({S.strip("coalesce(evidence_quote, '')")}, 1, 80)) AS s FROM {once}) x LEFT JOIN {chunks} k ON k.document_id = x.document_id) GROUP BY 1))
            SELECT candidate_id, document_id, section, r.chunk_id, evidence_quote AS quote FROM (SELECT * EXCLUDE (chunk_id) FROM {once}) JOIN r USING (candidate_id)""",
        "incremental_ingest": f"""{S.PAIRS.replace('FROM observations WHERE id IS NOT NULL QUALIFY', 'FROM (SELECT * FROM observations WHERE ingested_at IS NOT NULL) WHERE id IS NOT NULL QUALIFY')}
            SELECT verdict, count(*) AS pairs FROM judged WHERE verdict IS NOT NULL GROUP BY verdict""",
    }

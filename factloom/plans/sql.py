"""Fragments of the SQL that checks the queries, written for DuckDB."""

from __future__ import annotations

from factloom.functions import enums, grounding, names, units

SP = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def norm(x: str) -> str:
    return strip(f"lower({x})")


def lookup(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"


def member(x: str, words) -> str:
    return f"coalesce({x} IN ({', '.join(map(q, words))}), false)"


def has_any(x: str, words) -> str:
    return "(" + " OR ".join(f"coalesce(contains({x}, {q(w)}), false)" for w in words) + ")"


def first_of(x: str, words) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, {q(w)}) THEN {q(w)}" for w in words) + " END"


def currency_symbol(c: str) -> str:
    return first_of(c, units.CURRENCIES)


def unit_columns(unit: str) -> str:
    """SELECT list fragments u_clean, u_symbol, u_rest, u_currency, u_scale over a column, with lateral aliases."""
    keys = ", ".join(map(q, units.MULTIPLIERS))
    return f"""{norm(unit)} AS u_clean,
      coalesce({unit} <> '', false) AS u_set,
      {member('u_clean', units.PERCENT)} AS u_percent,
      {currency_symbol('u_clean')} AS u_symbol,
      CASE WHEN u_symbol IS NULL THEN u_clean ELSE {strip("replace(u_clean, u_symbol, ' ')")} END AS u_rest,
      CASE WHEN u_set AND u_percent THEN '%' WHEN u_set THEN {lookup('u_symbol', units.CURRENCIES)} END AS u_currency,
      CASE WHEN u_set AND NOT u_percent THEN list_filter(regexp_split_to_array(u_rest, '[\\s\\-_/]+'), lambda t: t IN ({keys}))[1] END AS u_scale"""


def value_columns(kind: str, amount: str, unit: str, text: str) -> str:
    factor = "CASE u_scale " + " ".join(f"WHEN {q(k)} THEN {v!r}::DOUBLE" for k, v in units.MULTIPLIERS.items()) + " ELSE 1.0::DOUBLE END"
    return f"""{unit_columns(unit)},
      coalesce({amount}, TRY_CAST(regexp_replace({text}, '[^0-9.\\-]', '', 'g') AS DOUBLE)) AS v_percent,
      coalesce({amount}, TRY_CAST(nullif(regexp_extract(replace({text}, ',', ''), '[-+]?\\d*\\.?\\d+'), '') AS DOUBLE)) AS v_number,
      {kind} = 'percentage' AS v_is_percent, {kind} IN ('number', 'currency') AS v_is_number,
      CASE WHEN v_is_percent THEN v_percent WHEN v_is_number THEN v_number ELSE {amount} END AS amount_read,
      CASE WHEN v_is_percent THEN v_percent WHEN v_is_number THEN v_number * ({factor}) END AS n_amount,
      CASE WHEN v_is_percent THEN '%' WHEN v_is_number AND v_number IS NOT NULL THEN
        CASE WHEN u_currency IS NOT NULL THEN u_currency WHEN coalesce(u_scale <> '', false) THEN 'unit'
             WHEN u_set THEN u_clean ELSE 'unit' END END AS n_unit"""


def fiscal_label(label: str) -> str:
    raw = strip(label)
    pattern = r"(\(.*?\)|(?:up to|as on|as of|end-)\s*.+)$"
    qualifier = f"nullif(regexp_extract({raw}, '{pattern}', 1, 'i'), '')"
    core = f"lower(CASE WHEN {qualifier} IS NULL THEN {raw} ELSE {strip(f'''regexp_replace({raw}, '{pattern}', '', 'i')''')} END)"
    year = f"coalesce(nullif(regexp_extract({core}, 'fy\\s*(20)?(\\d{{2}})', 2), ''), nullif(regexp_extract({core}, '20(\\d{{2}})[-/](\\d{{2}})', 2), ''))"
    return f"CASE WHEN coalesce({label} <> '', false) = false THEN {label} WHEN {year} IS NULL THEN {raw} ELSE 'FY' || {year} || coalesce(' ' || {strip(qualifier)}, '') END"


def period_columns(label: str, start: str, end: str) -> str:
    """p_label, p_start, p_end (dates of the label alone), p_type, p_key."""
    half = r"h([1-2])\s*(?:fy)?\s*(20)?(\d{2})"
    quarter = r"q([1-4])\s*(?:fy)?\s*(20)?(\d{2})"
    get = lambda pattern, n: f"nullif(regexp_extract(p_raw, '{pattern}', {n}, 'i'), '')"
    return f"""{strip(label)} AS p_raw, {fiscal_label(label)} AS p_label,
      {get(half, 1)} AS p_h, 2000 + CAST({get(half, 3)} AS INT) AS p_hy, CAST({get(quarter, 1)} AS INT) AS p_q, 2000 + CAST({get(quarter, 3)} AS INT) AS p_qy,
      2000 + CAST(nullif(regexp_extract(p_label, 'FY(\\d{{2}})', 1, 'i'), '') AS INT) AS p_y,
      CASE WHEN p_h = '1' THEN make_date(p_hy - 1, 4, 1) WHEN p_h = '2' THEN make_date(p_hy - 1, 10, 1)
           WHEN p_q < 4 THEN make_date(p_qy - 1, 1 + 3 * p_q, 1) WHEN p_q = 4 THEN make_date(p_qy, 1, 1)
           WHEN p_y IS NOT NULL THEN make_date(p_y - 1, 4, 1) END AS p_start,
      CASE WHEN p_h = '1' THEN make_date(p_hy - 1, 9, 30) WHEN p_h = '2' THEN make_date(p_hy, 3, 31)
           WHEN p_q = 1 THEN make_date(p_qy - 1, 6, 30) WHEN p_q = 2 THEN make_date(p_qy - 1, 9, 30)
           WHEN p_q = 3 THEN make_date(p_qy - 1, 12, 31) WHEN p_q = 4 THEN make_date(p_qy, 3, 31)
           WHEN p_y IS NOT NULL THEN make_date(p_y, 3, 31) END AS p_end,
      CASE WHEN p_h IS NOT NULL THEN 'half_year' WHEN p_q IS NOT NULL THEN 'quarter' WHEN p_y IS NOT NULL THEN 'fiscal_year' ELSE 'custom' END AS p_type,
      CASE WHEN coalesce({label} <> '', false) = false THEN
             CASE WHEN {start} IS NOT NULL AND {end} IS NOT NULL THEN CAST({start} AS VARCHAR) || '_' || CAST({end} AS VARCHAR) ELSE 'unknown' END
           WHEN p_q IS NOT NULL THEN 'Q' || p_q || '_FY' || {get(quarter, 3)}
           WHEN p_h IS NOT NULL THEN 'H' || p_h || '_FY' || {get(half, 3)}
           WHEN contains(lower(p_raw), 'fy') OR regexp_matches(p_raw, '\\d{{4}}-\\d{{2}}') THEN p_label
           ELSE replace(lower(p_raw), ' ', '') END AS p_key"""


def compare_periods(a: str, b: str) -> str:
    dated = f"{a}.d_start IS NOT NULL AND {a}.d_end IS NOT NULL AND {b}.d_start IS NOT NULL AND {b}.d_end IS NOT NULL"
    part = lambda x, y: f"(regexp_matches({x}.p_key, '^(Q[1-4]|H[12])_') AND substr({x}.p_key, 4) = {y}.p_key)"
    return f"""CASE WHEN {dated} THEN
        CASE WHEN {a}.d_start = {b}.d_start AND {a}.d_end = {b}.d_end THEN 'same'
             WHEN ({a}.d_start >= {b}.d_start AND {a}.d_end <= {b}.d_end) OR ({b}.d_start >= {a}.d_start AND {b}.d_end <= {a}.d_end) THEN 'nested'
             ELSE 'different' END
      WHEN {a}.p_key = {b}.p_key AND {a}.p_key <> 'unknown' THEN 'same'
      WHEN {part(a, b)} OR {part(b, a)} THEN 'nested' ELSE 'different' END"""


def canonical(x: str, table: dict[str, str]) -> str:
    return f"coalesce({lookup(norm(x), table)}, {norm(x)})"


def sibling(a: str, b: str) -> str:
    n = names
    sector = lambda x: f"({has_any(x, n.SECTORS)} AND {has_any(x, n.SECTOR_MEASURES)})"
    one_way = lambda x, y: f"""(({member(x, n.MACRO)} AND {sector(y)}) OR ({member(x, n.MACRO)} AND {has_any(y, n.DEMAND)})
        OR ({member(x, n.REVENUE)} AND {has_any(y, n.SEGMENTS)}) OR ({has_any(x, n.INFLATION)} AND {has_any(y, n.INFLATION_PARTS)}))"""  # noqa: E731
    both = lambda w: f"({has_any(a, w)} AND {has_any(b, w)})"
    return f"({a} <> {b} AND ({one_way(a, b)} OR {one_way(b, a)} OR {both(n.CREDIT)} OR {both(n.HEALTH)} OR {both(n.FISCAL)}))"


def scope(a: str, b: str) -> str:
    ne = lambda c: f"coalesce({a}.{c} <> '' AND {b}.{c} <> '' AND {norm(f'{a}.{c}')} <> {norm(f'{b}.{c}')}, false)"
    cons = f"coalesce({a}.consolidation NOT IN ('', 'unknown') AND {b}.consolidation NOT IN ('', 'unknown') AND lower({a}.consolidation) <> lower({b}.consolidation), false)"
    return f"CASE WHEN {cons} OR {ne('geography')} OR {ne('scope_level')} THEN 'different' ELSE 'compatible' END"


#: Observations once each, with names and all that the gate looks at.
OBSERVATIONS = f"""WITH obs AS (
    SELECT * FROM observations WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) = 1),
  named AS (SELECT o.*, e.canonical_name AS entity_name, c.canonical_name AS concept_name
    FROM obs o JOIN entities e ON o.entity_id = e.id JOIN concepts c ON o.concept_id = c.id),
  prepared AS (SELECT id, document_id, session_id, entity_id, concept_id, value_type, unit, geography, scope_level, consolidation,
      period_label, entity_name, concept_name, text_value, coalesce(period_type, 'custom') AS period_type,
      coalesce(assertion_status, 'unknown') AS assertion_status, coalesce(needs_review, false) AS needs_review,
      {canonical('entity_name', names.ENTITY_NAMES)} AS entity_key, {canonical('concept_name', names.CONCEPT_NAMES)} AS concept_key,
      {norm('concept_name')} AS concept_low, value_type IN ('number', 'percentage', 'currency') AS numeric_value,
      nullif({norm('geography')}, '') AS geo,
      {value_columns('value_type', 'value', 'unit', 'text_value')},
      {period_columns('period_label', 'period_start', 'period_end')},
      CASE WHEN period_start IS NOT NULL THEN period_start ELSE p_start END AS d_start,
      CASE WHEN period_start IS NOT NULL THEN period_end ELSE p_end END AS d_end
    FROM named)"""

def alias_list(c: str) -> str:
    """VARCHAR[] of the three notations of aliases."""
    s = f"trim({c})"
    return f"""CASE WHEN {c} IS NULL OR {s} IN ('', '[]', 'null') THEN NULL
        WHEN starts_with({s}, '["') THEN TRY_CAST(CAST({s} AS JSON) AS VARCHAR[])
        WHEN starts_with({s}, '[''') AND ends_with({s}, ']') THEN list_filter(regexp_split_to_array(substr({s}, 3, length({s}) - 4), '[''"], *[''"]'), lambda x: x <> '')
        WHEN NOT starts_with({s}, '[') THEN list_filter(list_transform(string_split({s}, ';'), lambda x: trim(x)), lambda x: x <> '') END"""


CLASH = """coalesce(a.numeric_value AND a.n_unit <> '' AND b.n_unit <> '' AND a.n_unit <> b.n_unit
    AND NOT (a.n_unit IN ('INR', 'USD', 'EUR', 'GBP') AND b.n_unit IN ('INR', 'USD', 'EUR', 'GBP')), false)"""

#: Pairs that pass the gate, with the cascade's verdict.
PAIRS = f"""{OBSERVATIONS},
  same_entity AS (SELECT a AS a, b AS b, {compare_periods('a', 'b')} AS period, a.concept_id = b.concept_id AS same_concept,
      {sibling('a.concept_low', 'b.concept_low')} AS siblings, {scope('a', 'b')} AS scope
    FROM prepared a JOIN prepared b ON a.entity_id = b.entity_id AND a.id < b.id AND a.value_type = b.value_type
    WHERE NOT a.needs_review AND NOT b.needs_review AND NOT {CLASH} AND coalesce(a.geo = b.geo, true)),
  gated AS (SELECT a, b, period, same_concept, scope FROM same_entity WHERE period <> 'different' AND (same_concept OR siblings)),
  signed AS (SELECT a, b, same_concept,
      CASE WHEN a.period_type <> b.period_type AND (a.period_type IN ('quarter', 'month', 'half_year') OR b.period_type IN ('quarter', 'month', 'half_year'))
             AND (a.period_type = 'fiscal_year' OR b.period_type = 'fiscal_year') THEN 'different_aggregation'
           WHEN period = 'nested' THEN 'nested' ELSE 'match' END AS period_match,
      CASE WHEN scope = 'compatible' THEN 'match'
           WHEN lower(coalesce(a.consolidation, '')) <> lower(coalesce(b.consolidation, '')) THEN 'different_consolidation'
           ELSE 'different_geography' END AS scope_match,
      CASE WHEN NOT a.numeric_value THEN 'match' WHEN a.n_unit IS DISTINCT FROM b.n_unit THEN 'incompatible'
           WHEN coalesce(a.unit, '') <> coalesce(b.unit, '') THEN 'normalized_match' ELSE 'match' END AS unit_match,
      CASE WHEN a.assertion_status = b.assertion_status THEN 'identical'
           WHEN 'actual' IN (a.assertion_status, b.assertion_status) AND 'estimate' IN (a.assertion_status, b.assertion_status) THEN 'actual_vs_estimate'
           WHEN 'actual' IN (a.assertion_status, b.assertion_status) AND 'forecast' IN (a.assertion_status, b.assertion_status) THEN 'actual_vs_forecast'
           WHEN 'actual' IN (a.assertion_status, b.assertion_status) AND 'target' IN (a.assertion_status, b.assertion_status) THEN 'actual_vs_target'
           ELSE 'different' END AS status_relation,
      coalesce(a.numeric_value AND a.n_unit IN ('INR', 'USD', 'EUR', 'GBP') AND b.n_unit IN ('INR', 'USD', 'EUR', 'GBP') AND a.n_unit <> b.n_unit, false) AS money
    FROM gated),
  judged AS (SELECT *, CASE
      WHEN NOT same_concept THEN CASE WHEN period_match = 'match' AND scope_match <> 'different_geography' AND unit_match <> 'incompatible' THEN 'sibling' END
      WHEN period_match = 'different_aggregation' OR scope_match = 'different_geography' OR (unit_match = 'incompatible' AND NOT money) THEN NULL
      WHEN money AND period_match = 'match' AND scope_match = 'match' THEN 'currency'
      WHEN period_match = 'nested' THEN 'nested' WHEN scope_match <> 'match' THEN 'scope' WHEN NOT a.numeric_value THEN NULL
      WHEN a.n_amount IS NULL OR b.n_amount IS NULL THEN NULL
      WHEN a.assertion_status <> 'unknown' AND b.assertion_status <> 'unknown' AND a.assertion_status <> b.assertion_status THEN 'status'
      WHEN abs(a.n_amount - b.n_amount) <= 1e-9::DOUBLE OR abs(a.n_amount - b.n_amount) / greatest(abs(a.n_amount), abs(b.n_amount), 1.0::DOUBLE) <= 0.001::DOUBLE THEN 'equal'
      ELSE 'differs' END AS verdict FROM signed)"""

VERDICT_TYPE = "CASE verdict WHEN 'sibling' THEN 'apparent_contradiction' WHEN 'currency' THEN 'unresolved' WHEN 'equal' THEN 'corroborated' WHEN 'differs' THEN 'contradicted' ELSE 'contextualized' END"
VERDICT_CONFIDENCE = "CAST(CASE verdict WHEN 'sibling' THEN 0.96 WHEN 'nested' THEN 0.95 WHEN 'scope' THEN 0.96 WHEN 'currency' THEN 0.95 WHEN 'status' THEN 0.90 WHEN 'equal' THEN 0.99 ELSE 0.93 END AS DOUBLE)"

ENUMS = enums
GROUNDING = grounding

"""DuckDB SQL for the registered queries, written apart from the operators: other functions, other join shapes."""

from __future__ import annotations

from ..operators.delivery import HEADERS
from ..operators.describe import INVOICE_SHORT
from ..tables import ABBREVIATIONS, AMBIGUOUS, CORPORATE_SUFFIXES, DOMAINS, ITEM_TYPES, PLACEHOLDERS, STOPWORDS, unit_rows
from .queries import ASKED, BRANDS, CATALOG, GLUED, MORE_UNITS, RECORDS, REVIEWS, UNIT_ROWS, URLS, header_name


def _rows(pairs) -> str:
    quote = lambda x: "NULL" if x is None else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(quote(x) for x in row) + ")" for row in pairs)


_SUFFIX = "|".join(CORPORATE_SUFFIXES)
_MARKERS = ", ".join(f"'{p}'" for p in PLACEHOLDERS)
_EMPTY = f"(trim(coalesce({{0}}, '')) = '' OR lower(trim({{0}})) IN ({_MARKERS}))"
_BRAND_KEY = f"trim(regexp_replace(trim(regexp_replace(lower(coalesce({{0}}, '')), '[^a-z0-9]+', ' ', 'g')), '(^| )({_SUFFIX})( ({_SUFFIX}))*$', ''))"
_MPN_KEY = "regexp_replace(upper(regexp_replace(coalesce(Mfg_Part_Num, ''), '[^A-Za-z0-9]+', '', 'g')), '(^|[^0-9])0+([0-9])', '\\1\\2', 'g')"
_FILLED = " + ".join(f"(CASE WHEN {_EMPTY.format(c)} THEN 0 ELSE 1 END)" for c in ("Mfg_Part_Num", "Part_Desc", "Part_Manuf", "E1_Brand"))
_KEYED = f"""c AS ({CATALOG}), k AS (SELECT *, {_MPN_KEY} AS mpn_key, CASE WHEN {_EMPTY.format("Part_Manuf")} THEN '' ELSE {_BRAND_KEY.format("Part_Manuf")} END AS brand_key, {_FILLED} AS filled FROM c),
m AS (SELECT *, mpn_key = '' OR row_number() OVER (PARTITION BY mpn_key, brand_key ORDER BY filled DESC, row_index) = 1 AS survives, count(*) OVER (PARTITION BY mpn_key, brand_key) AS n FROM k)"""
_PCT = "round_even(100.0 * ({0}) / nullif({1}, 0), 1)"

_UNIT_KEY = "replace(replace(regexp_replace(lower(trim(unit)), '[.\\s_-]+', '', 'g'), 'degrees', 'deg'), '°', 'deg')"
_UNITS = f"""r AS ({UNIT_ROWS}), uom(variant, approved) AS (VALUES {_rows(unit_rows())}), u AS (SELECT r.*, uom.approved FROM r LEFT JOIN uom ON uom.variant = {_UNIT_KEY})"""
_FRACTION = """CASE WHEN v::DOUBLE = floor(v::DOUBLE) THEN CAST(floor(v::DOUBLE) AS BIGINT)::VARCHAR
 WHEN (v::DOUBLE * 64) = floor(v::DOUBLE * 64) THEN (CASE WHEN v::DOUBLE >= 1 THEN CAST(floor(v::DOUBLE) AS BIGINT)::VARCHAR || '-' ELSE '' END)
  || (CAST((v::DOUBLE - floor(v::DOUBLE)) * 64 AS BIGINT) // gcd(CAST((v::DOUBLE - floor(v::DOUBLE)) * 64 AS BIGINT), 64))::VARCHAR || '/' || (64 // gcd(CAST((v::DOUBLE - floor(v::DOUBLE)) * 64 AS BIGINT), 64))::VARCHAR END"""

_EXPANDED = f"""c AS ({CATALOG}), short(a, long) AS (VALUES {_rows(ABBREVIATIONS.items())}),
p AS (SELECT row_index, unnest(regexp_extract_all(coalesce(Part_Desc, ''), '[A-Za-z]+|[^A-Za-z]+')) AS t, unnest(range(len(regexp_extract_all(coalesce(Part_Desc, ''), '[A-Za-z]+|[^A-Za-z]+')))) AS pos FROM c),
x AS (SELECT c.row_index, coalesce(g.expanded, '') AS expanded FROM c LEFT JOIN (SELECT row_index, string_agg(coalesce(short.long, t), '' ORDER BY pos) AS expanded FROM p LEFT JOIN short ON short.a = lower(t) GROUP BY row_index) g USING (row_index))"""
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TOKENS = f"[t FOR t IN [lower(y) FOR y IN regexp_extract_all({{0}}, '[A-Za-z]+')] IF len(t) > 1 AND t NOT IN ({_STOP})]"
_DW = ", ".join(f"'{w}'" for w in AMBIGUOUS["dw"][1])
_CLASSIFIED = f"""{_EXPANDED},
labels AS (SELECT label, ordinal, toks FROM (SELECT label, ordinal, {_TOKENS.format("label")} AS toks FROM (VALUES {_rows((t, n) for n, t in enumerate(ITEM_TYPES))}) AS l(label, ordinal)) WHERE len(toks) > 0),
lt AS (SELECT label, ordinal, len(toks) AS n_tokens, unnest(toks) AS tok FROM labels),
idf AS (SELECT tok, ln(((SELECT count(*) FROM labels) + 1) / (count(DISTINCT label) + 1)) + 1 AS w FROM lt GROUP BY tok),
tot AS (SELECT label, sum(w) AS total FROM lt JOIN idf USING (tok) GROUP BY label),
xt AS (SELECT row_index, expanded, list_distinct({_TOKENS.format("expanded")}) AS toks FROM x),
found2 AS (SELECT row_index, 0 AS kind, toks FROM xt UNION ALL SELECT row_index, 1, list_append(toks, 'dishwasher') FROM xt WHERE list_contains(toks, 'dw') AND list_has_any(toks, [{_DW}])),
bt AS (SELECT row_index, kind, unnest(list_distinct(toks)) AS tok FROM found2),
sc AS (SELECT row_index, kind, lt.label, lt.ordinal, sum(w) / any_value(total) + 0.001 * any_value(n_tokens) AS score FROM bt JOIN lt USING (tok) JOIN idf USING (tok) JOIN tot ON tot.label = lt.label GROUP BY row_index, kind, lt.label, lt.ordinal),
rk AS (SELECT *, row_number() OVER (PARTITION BY row_index, kind ORDER BY round(score, 9) DESC, ordinal) AS place FROM sc),
top AS (SELECT row_index, kind, max(CASE WHEN place = 1 THEN label END) AS l1, max(CASE WHEN place = 1 THEN score END) AS s1, max(CASE WHEN place = 2 THEN label END) AS l2, max(CASE WHEN place = 2 THEN score END) AS s2 FROM rk WHERE place <= 2 GROUP BY row_index, kind),
ph AS (SELECT xt.row_index, arg_max(label, len(label) * 1000 - ordinal) AS label FROM xt JOIN labels ON len(labels.toks) >= 2 AND contains(' ' || trim(regexp_replace(lower(expanded), '\\s+', ' ', 'g')) || ' ', ' ' || lower(label) || ' ') GROUP BY xt.row_index),
d AS (SELECT x.row_index, ph.label AS p, a.l1 AS al, a.s1 AS sa, a.l2 AS al2, a.s2 AS sa2, b.l1 AS bl, b.s1 AS sb, b.l2 AS bl2, b.s2 AS sb2 FROM x LEFT JOIN ph USING (row_index) LEFT JOIN top a ON a.row_index = x.row_index AND a.kind = 0 LEFT JOIN top b ON b.row_index = x.row_index AND b.kind = 1),
k AS (SELECT *, CASE WHEN p IS NOT NULL THEN 'phrase' WHEN sa >= 0.34 THEN 'strong' WHEN sb >= 0.34 THEN 'context' ELSE 'none' END AS kind FROM d),
f AS (SELECT row_index, CASE kind WHEN 'phrase' THEN p WHEN 'strong' THEN al WHEN 'context' THEN bl END AS item_type,
 CASE kind WHEN 'phrase' THEN 0.95 WHEN 'strong' THEN least(round_even(0.55 + 0.40 * least(sa, 1.0), 3), 0.94) WHEN 'context' THEN least(round_even(0.55 + 0.40 * least(sb, 1.0), 3), 0.69) ELSE 0.0 END::DOUBLE AS confidence,
 CASE kind WHEN 'phrase' THEN 'fallback_phrase' WHEN 'strong' THEN 'fallback_token_overlap' WHEN 'context' THEN 'fallback_token_overlap_ambiguous_context' ELSE 'unresolved' END AS method,
 CASE kind WHEN 'strong' THEN al2 WHEN 'context' THEN bl2 WHEN 'none' THEN al END AS runner_up,
 CASE kind WHEN 'strong' THEN round_even(CASE WHEN sa2 > 1 THEN 1 ELSE sa2 END, 3) WHEN 'context' THEN round_even(CASE WHEN sb2 > 1 THEN 1 ELSE sb2 END, 3) WHEN 'none' THEN round_even(CASE WHEN sa > 1 THEN 1 ELSE sa END, 3) END AS runner FROM k),
g AS (SELECT row_index, item_type, confidence, method, runner_up, item_type IS NULL OR confidence < 0.70 OR coalesce(confidence - runner < 0.12, false) AS needs_review FROM f)"""

_VALUE_KEY = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"
_OUTCOME = f"""q AS ({ASKED}),
p AS (SELECT *, CASE WHEN {_VALUE_KEY.format("classpath")} LIKE 'fittings coupling%' THEN 'Fittings > Coupling' WHEN {_VALUE_KEY.format("classpath")} LIKE 'valves ball valve%' THEN 'Valves > Ball Valve' END AS cp, {_VALUE_KEY.format("label")} AS lk, {_VALUE_KEY.format("value")} AS vk FROM q),
v(cp, lk, vk, canonical) AS (VALUES ('Fittings > Coupling', 'material', 'brass', 'Brass'), ('Fittings > Coupling', 'material', 'bronze', 'Bronze'), ('Fittings > Coupling', 'material', 'stainless steel', 'Stainless Steel'),
 ('Fittings > Coupling', 'connection type', 'threaded', 'Threaded'), ('Fittings > Coupling', 'connection type', 'sweat', 'Sweat'), ('Valves > Ball Valve', 'material', 'stainless steel', 'Stainless Steel'), ('Valves > Ball Valve', 'material', 'brass', 'Brass')),
a(cp, lk, is_open) AS (VALUES ('Fittings > Coupling', 'material', false), ('Fittings > Coupling', 'connection type', false), ('Fittings > Coupling', 'size', true), ('Valves > Ball Valve', 'material', false), ('Valves > Ball Valve', 'size', true)),
o AS (SELECT p.row_id, p.label, p.value, p.cp, p.lk, p.vk, CASE WHEN trim(p.value) = '' THEN 'blank' WHEN p.cp IS NULL THEN 'no_classpath' WHEN a.is_open IS NULL THEN 'not_applicable' WHEN a.is_open THEN 'open' WHEN v.canonical IS NOT NULL THEN 'in_vocabulary' ELSE 'not_permitted' END AS outcome, v.canonical
 FROM p LEFT JOIN a ON a.cp = p.cp AND a.lk = p.lk LEFT JOIN v ON v.cp = p.cp AND v.lk = p.lk AND v.vk = p.vk)"""

_HARD = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9\\s]+', '', 'g'), '\\s+', ' ', 'g'))"
_SCORES = f"""c AS ({CATALOG}), g AS (SELECT {_MPN_KEY} AS mk, CASE WHEN row_index % 4 <> 3 THEN Part_Desc END AS Part_Desc, CASE WHEN row_index % 7 = 0 THEN 'Other' ELSE E1_Brand END AS E1_Brand, Part_Manuf FROM c),
t AS (SELECT * FROM (SELECT {_MPN_KEY} AS mk, CASE WHEN row_index % 3 = 0 THEN lower(Part_Desc) ELSE Part_Desc END AS Part_Desc, coalesce(E1_Brand, '') AS E1_Brand, Part_Manuf, row_number() OVER (PARTITION BY {_MPN_KEY} ORDER BY row_index) AS rn FROM c) WHERE rn = 1),
l AS (SELECT 'E1_Brand' AS field, g.E1_Brand AS got, t.E1_Brand AS want FROM g JOIN t USING (mk) UNION ALL SELECT 'Part_Desc', g.Part_Desc, t.Part_Desc FROM g JOIN t USING (mk) UNION ALL SELECT 'Part_Manuf', g.Part_Manuf, t.Part_Manuf FROM g JOIN t USING (mk)),
b AS (SELECT field, trim(coalesce(want, '')) <> '' AS populated, trim(coalesce(want, '')) <> '' AND trim(coalesce(got, '')) <> '' AS attempted, trim(coalesce(want, '')) <> '' AND trim(coalesce(got, '')) = trim(want) AS exact,
 trim(coalesce(want, '')) <> '' AND (trim(coalesce(got, '')) = trim(want) OR ({_HARD.format("got")} = {_HARD.format("want")} AND {_HARD.format("want")} <> '')) AS alike FROM l),
s AS (SELECT field, count(*) FILTER (populated) AS total, count(*) FILTER (exact) AS exact, count(*) FILTER (alike) AS normalised, count(*) FILTER (attempted) AS attempted FROM b GROUP BY GROUPING SETS ((field), ()))"""

_LATEST = f"r AS ({REVIEWS}), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, field_key ORDER BY ts DESC, action DESC, new_value DESC) AS rn FROM r) WHERE rn = 1)"
_NOISE = ["add to cart", "your cart", "continue shopping", "free shipping", "secure checkout", "wishlist", "sale price", "regular price", "unit price", "sign in", "create account"]


def _richness() -> str:
    from ..operators.discover import SPEC_ROW, TECHNICAL

    hits = lambda words: " + ".join(f"(contains(lower(t), '{w}'))::INT" for w in words)
    rows = "len(regexp_extract_all(t, '" + SPEC_ROW.replace("'", "''") + "'))"
    return f"""WITH d AS (SELECT doc_id, trim(coalesce(text, '')) AS t FROM documents)
SELECT doc_id, round_even(least(len(t), 3000) / 150.0::DOUBLE + least({rows}, 15) * 5.0::DOUBLE + least({hits(TECHNICAL)}, 15) * 2.0::DOUBLE + CASE WHEN contains(lower(t), '=== extracted specification tables ===') THEN 12.0 ELSE 0.0 END::DOUBLE
 + CASE WHEN contains(lower(t), 'specifications') OR contains(lower(t), 'technical data') THEN 6.0 ELSE 0.0 END::DOUBLE - least({hits(_NOISE)}, 10) * 1.5::DOUBLE, 3)::DOUBLE AS score FROM d"""


_KINDS = ", ".join(f"({n}, '{kind}', '{name}')" for n, (kind, names) in enumerate(DOMAINS.items()) for name in names)
#: The fields of each text of TEXTS, written out from how that text is made.
_FIELDS = """p AS (SELECT p_partkey AS pk, p_partkey % 3 AS kind, p_size * 10 AS volts, p_size * 9 AS amps, -p_size AS cold, p_partkey % 300 AS hot FROM part),
raw AS (SELECT concat('P', pk::VARCHAR) AS product_id, kind, v.* FROM p, LATERAL (VALUES
 (0, 'product_name', true, concat('AX-', pk::VARCHAR), NULL, 0.85::DOUBLE, NULL), (1, 'category', true, 'Industrial Sensor', NULL, 0.90, NULL),
 (2, 'voltage_rating', true, volts::VARCHAR, 'V', 0.90, CASE WHEN volts > 1000 THEN 'Voltage outside 0 to 1000 V.' END),
 (3, 'current_rating', true, amps::VARCHAR, 'A', 0.88, CASE WHEN amps > 20 THEN 'More than 20 A on a compact connector.' END),
 (4, 'ip_rating', true, CASE kind WHEN 0 THEN 'IP67' WHEN 1 THEN 'IP-677' ELSE 'IP20' END, NULL, 0.94, CASE kind WHEN 1 THEN 'Not a standard IP code.' WHEN 2 THEN 'Submersible use, but an indoor IP code.' END),
 (5, 'connector_type', true, 'M12', NULL, 0.89, NULL),
 (6, 'operating_temperature_min', true, cold::VARCHAR, 'C', 0.85, CASE WHEN cold < -60 THEN 'Lowest temperature outside -60 to 100 °C.' WHEN cold > hot THEN 'Lowest temperature over the highest.' END),
 (7, 'operating_temperature_max', true, hot::VARCHAR, 'C', 0.85, CASE WHEN hot > 250 THEN 'Highest temperature outside -20 to 250 °C.' WHEN cold > hot THEN 'Lowest temperature over the highest.' END),
 (8, 'material', true, CASE kind WHEN 2 THEN 'nickel-plated brass' END, NULL, CASE kind WHEN 2 THEN 0.90 ELSE 0.0 END, NULL), (9, 'certifications', true, 'CE, ROHS', NULL, 0.92, NULL), (10, 'mounting_type', true, NULL, NULL, 0.0, NULL),
 (11, 'thread_size', false, 'M12', NULL, 0.82, NULL), (12, 'rated_voltage', false, concat(volts::VARCHAR, ' VDC'), NULL, 0.94, NULL), (13, 'rated_current', false, concat(amps::VARCHAR, ' A'), NULL, 0.94, NULL),
 (14, 'housing', false, 'nickel-plated brass, IP20, submersible', NULL, 0.94, NULL), (15, 'operating_temperature', false, concat(cold::VARCHAR, ' to ', hot::VARCHAR, ' C'), NULL, 0.94, NULL))
 AS v(pos, field_key, is_core, value, unit, confidence, error) WHERE field_key <> 'housing' OR kind = 2),
f AS (SELECT product_id, pos, field_key, is_core, value, CASE WHEN unit = 'C' THEN '°C' ELSE unit END AS unit, confidence, error, CASE WHEN error IS NOT NULL THEN 'flagged_validation_error' WHEN value IS NULL THEN 'missing' ELSE 'verified' END AS status FROM raw)"""
_SUMMARY = f"""{_FIELDS}, s AS (SELECT product_id, count(*) AS total_fields, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status LIKE 'flagged%') AS flagged, count(*) FILTER (status = 'missing') AS missing, 0::BIGINT AS enriched,
 round_even(avg(confidence) FILTER (value IS NOT NULL), 2)::DOUBLE AS overall_confidence FROM f GROUP BY product_id), t AS (SELECT *, CASE WHEN flagged + missing > 0 THEN 'needs_review' ELSE 'verified' END AS overall_status FROM s)"""
_GATED = f"""{_FIELDS}, g AS (SELECT product_id, field_key, CASE WHEN field_key = 'mounting_type' THEN 'Threaded' ELSE value END AS value,
 CASE WHEN field_key = 'mounting_type' THEN 'inferred, not sourced' WHEN value IS NULL THEN 'no value extracted' WHEN error IS NOT NULL THEN concat('failed a rule: ', error) END AS reason FROM f)"""
_KEPT_STATUS = "CASE WHEN l.action IN ('approve', 'override') THEN 'verified' WHEN l.action = 'reject' THEN 'missing' ELSE f.status END"
_TERSE = """e AS (SELECT row_index, v.* FROM (SELECT row_index, row_index % 8 AS k, p_size, lower(p_type) AS t FROM c JOIN part ON p_partkey = row_index) x, LATERAL (VALUES
 (0, 0, 'Size', '3/8', 'in', '3/8'), (0, 1, 'Material', 'Brass', NULL, 'brass'), (0, 2, 'Pressure Class', '150', NULL, '150#'), (1, 0, 'Size', x.p_size::VARCHAR, 'in', concat(x.p_size::VARCHAR, ' IN')),
 (1, 1, 'Material', 'Stainless Steel', NULL, 'stainless steel'), (1, 2, 'Connection Type', 'Threaded', NULL, 'threaded'), (2, 0, 'Finish', 'Chrome', NULL, 'chrome'), (2, 1, 'Handle Count', '2', NULL, '2-handle'),
 (3, 0, 'Size', '1-1/2', 'in', '1-1/2"'), (3, 1, 'Material', 'Malleable Iron', NULL, 'malleable iron'), (4, 0, 'Size', '2', 'in', '2"'), (4, 1, 'Material', 'PVC', NULL, 'pvc'), (4, 2, 'Schedule', '40', NULL, 'SCH 40'),
 (5, 0, 'Voltage', '24', 'volts', '24V')) AS v(kind, pos, label, value, unit, evidence) WHERE v.kind = x.k)"""
#: The fields of each text of LISTINGS, likewise.
_LISTED = """p AS (SELECT p_partkey AS pk, p_partkey % 4 AS kind, p_size AS s, p_brand AS brand FROM part),
n AS (SELECT *, CASE WHEN pk % 7 = 0 THEN concat('Belt ', pk::VARCHAR) WHEN kind = 0 THEN 'Sanding belt DCB518ASTS06G of aluminum' WHEN kind = 2 THEN 'Proximity Sensor' ELSE concat('SKU: DCB', pk::VARCHAR, CASE WHEN pk % 5 = 0 THEN ' UPC 12' ELSE '' END) END AS name,
 CASE WHEN pk % 7 = 0 THEN 0.95 WHEN kind = 2 THEN 0.86 ELSE 0.90 END AS sure FROM p),
f AS (SELECT concat('L', pk::VARCHAR) AS product_id, v.* FROM n, LATERAL (VALUES ('product_name', name, NULL, sure::DOUBLE, 'verified'),
 ('category', CASE kind WHEN 0 THEN 'Sanding Belt' WHEN 1 THEN 'Grinding Wheel' WHEN 2 THEN 'Industrial Sensor' ELSE 'Industrial Component' END, NULL, CASE kind WHEN 3 THEN 0.60 ELSE 0.92 END, CASE kind WHEN 3 THEN 'flagged_low_confidence' ELSE 'verified' END),
 ('material', CASE kind WHEN 2 THEN 'nylon' END, NULL, CASE kind WHEN 2 THEN 0.84 ELSE 0.0 END, CASE kind WHEN 2 THEN 'verified' WHEN 3 THEN 'missing' ELSE 'not_applicable' END),
 ('voltage_rating', NULL, NULL, 0.0, CASE WHEN kind < 2 THEN 'not_applicable' ELSE 'missing' END), ('current_rating', NULL, NULL, 0.0, CASE WHEN kind < 2 THEN 'not_applicable' ELSE 'missing' END),
 ('ip_rating', NULL, NULL, 0.0, CASE WHEN kind < 2 THEN 'not_applicable' ELSE 'missing' END), ('connector_type', NULL, NULL, 0.0, CASE WHEN kind < 2 THEN 'not_applicable' ELSE 'missing' END),
 ('operating_temperature_min', NULL, NULL, 0.0, CASE WHEN kind < 2 THEN 'not_applicable' ELSE 'missing' END), ('operating_temperature_max', NULL, NULL, 0.0, CASE WHEN kind < 2 THEN 'not_applicable' ELSE 'missing' END),
 ('certifications', NULL, NULL, 0.0, CASE WHEN kind < 2 THEN 'not_applicable' ELSE 'missing' END), ('mounting_type', NULL, NULL, 0.0, CASE WHEN kind < 2 THEN 'not_applicable' ELSE 'missing' END),
 ('mass', regexp_replace(round_even(s * 0.0283495::DOUBLE, 3)::VARCHAR, '\\.0$', ''), 'kg', 0.82, 'verified'), ('manufacturer_part_number', concat('DCB', pk::VARCHAR, CASE WHEN pk % 5 = 0 THEN ' UPC 12' ELSE '' END), NULL, 0.94, 'verified'),
 ('brand', CASE pk % 3 WHEN 0 THEN 'DeWalt' WHEN 1 THEN 'black & decker' ELSE brand END, NULL, 0.94, 'verified'), ('manufacturer', CASE WHEN pk % 2 = 0 THEN 'Stanley Black and Decker' ELSE concat('Maker ', brand) END, NULL, 0.94, 'verified'),
 ('grit', s::VARCHAR, NULL, 0.94, 'verified'), ('item_weight', concat(s::VARCHAR, ' oz total 2 lb'), 'lb', 0.94, 'verified')) AS v(field_key, value, unit, confidence, status))"""
_PARTS = "[x FOR x IN regexp_extract_all({0}, '[a-z0-9°µ.\\-/]+') IF x <> '']"
_FLAT = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
_STANDS = f"({{0}} <> '' AND (contains({{1}}, {{0}}) OR (len({_PARTS}) > 0 AND len([x FOR x IN {_PARTS} IF contains({{1}}, x)]) >= 0.8 * len({_PARTS}))))"


_JOIN = "array_to_string([x FOR x IN [{0}] IF coalesce(x, '') <> ''], '{1}')"


def _oxford(x: str) -> str:
    return f"CASE len({x}) WHEN 0 THEN NULL WHEN 1 THEN {x}[1] WHEN 2 THEN {x}[1] || ' and ' || {x}[2] ELSE array_to_string({x}[1:len({x}) - 1], ', ') || ', and ' || {x}[len({x})] END"


def _descriptions(rec: str) -> str:
    """CTEs up to ``texts (product_id, format, text, length, "limit", compliant)`` from ``rec``, a query for ``product_id, maker, mpn, item, a``
    with ``a`` a list of (label, shown, measure, is_key): the five formats by lists and their reductions."""
    short = "u"
    for long_form, form in INVOICE_SHORT:
        short = f"replace({short}, '{long_form}', '{form}')"
    return f"""rec AS ({rec}),
d1 AS (SELECT *, {_JOIN.format("maker, mpn", " ")} AS subject, [x.shown FOR x IN a IF x.is_key] AS ks, [x.shown FOR x IN a IF NOT x.is_key] AS os, [x.shown FOR x IN a] AS al,
 [CASE WHEN x.measure THEN x.shown || ' ' || lower(x.label) WHEN contains(lower(x.shown), lower(x.label)) THEN x.shown ELSE lower(x.label) || ' of ' || x.shown END FOR x IN a IF x.is_key] AS kp,
 [CASE WHEN x.measure THEN x.shown || ' ' || lower(x.label) WHEN contains(lower(x.shown), lower(x.label)) THEN x.shown ELSE lower(x.label) || ' of ' || x.shown END FOR x IN a IF NOT x.is_key] AS op,
 [CASE WHEN x.measure THEN x.shown || ' ' || x.label ELSE x.shown END FOR x IN a] AS spoken FROM rec),
d2 AS (SELECT *, list_concat([{_JOIN.format("item, mpn", " ")}], CASE WHEN len(ks) > 0 THEN ks ELSE al END) AS bits,
 list_reduce(list_concat([{_JOIN.format("maker, item, mpn", ", ")}], list_concat(ks, os)), lambda acc, x: CASE WHEN len(acc) < 60 AND len(acc || ', ' || x) <= 80 THEN acc || ', ' || x ELSE acc END) AS mobile,
 {_JOIN.format(f"{_JOIN.format('maker, mpn, item', ' ')}, array_to_string(ks, ', ')", ", ")} AS title, {_JOIN.format(f"{_JOIN.format('maker, item', ' ')}, array_to_string(spoken, ', ')", ", ")} AS long,
 {_JOIN.format(f"CASE WHEN subject <> '' AND item <> '' THEN subject || ' is a ' || item || '.' WHEN subject <> '' THEN subject || '.' ELSE upper(item[1]) || item[2:] || '.' END, 'It is rated for ' || {_oxford('kp')} || '.', 'Additional specifications include ' || {_oxford('op')} || '.'", " ")} AS web FROM d1),
d3 AS (SELECT *, [upper(array_to_string(bits[1:n], ' ')) FOR n IN range(1, len(bits) + 1)] AS us FROM d2),
d4 AS (SELECT *, CASE WHEN len(us[-1]) <= 40 THEN us[-1] ELSE [{short} FOR u IN us IF len({short}) <= 40][-1] END AS invoice FROM d3),
texts AS (SELECT product_id, v.format, v.text, len(v.text)::INTEGER AS length, v.lim AS "limit", len(v.text) BETWEEN v.lo AND v.hi AS compliant FROM d4, LATERAL (VALUES
 ('invoice', invoice, '<= 40', 0, 40), ('mobile', mobile, '60-80', 60, 80), ('title', title, '<= 200', 0, 200), ('long', long, '<= 1000', 0, 1000), ('web', web, '120-1500', 120, 1500)) AS v(format, text, lim, lo, hi))"""


_CATALOG_RECORDS = f"""SELECT s.row_index AS product_id, b.maker, s.Mfg_Part_Num AS mpn, t.item_type AS item, coalesce(l.a, []) AS a
FROM (WITH {_KEYED} SELECT row_index, Mfg_Part_Num FROM m WHERE survives) s JOIN (SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 OR p_partkey % 11 > 0 THEN concat(p_brand, ' Line') END AS maker FROM part) b ON b.p_partkey = s.row_index
JOIN (WITH {_CLASSIFIED} SELECT row_index, item_type FROM g) t ON t.row_index = s.row_index
LEFT JOIN (WITH c AS ({CATALOG}), {_TERSE} SELECT row_index, list(struct_pack(label := label, shown := concat_ws(' ', value, CASE unit WHEN 'volts' THEN 'V' ELSE unit END), measure := unit IS NOT NULL OR try_cast(value AS DOUBLE) IS NOT NULL, is_key := true) ORDER BY pos) AS a FROM e GROUP BY row_index) l ON l.row_index = s.row_index"""
#: Admitted fields of TEXTS as records: those that broke no rule, under public labels; a thread size only repeats the connector.
def _text_records(item: str = "Sensor", maker: str = "NULL::VARCHAR", mpn: str = "concat('AX-', product_id[2:])") -> str:
    return f"""WITH {_FIELDS}, o AS (SELECT product_id, v.place, v.label, concat_ws(' ', value, CASE unit WHEN '°C' THEN 'C' ELSE unit END) AS shown, unit IS NOT NULL AS measure, v.is_key FROM f JOIN (VALUES ('voltage_rating', 0, 'Voltage', true), ('current_rating', 1, 'Current', true),
 ('ip_rating', 2, 'Enclosure Rating', true), ('connector_type', 3, 'Connector Type', true), ('material', 4, 'Material', true), ('certifications', 6, 'Certifications', false), ('operating_temperature_min', 7, 'Min Operating Temperature', false),
 ('operating_temperature_max', 8, 'Max Operating Temperature', false), ('rated_voltage', 20, 'Rated Voltage', false), ('rated_current', 21, 'Rated Current', false), ('housing', 22, 'Housing', false), ('operating_temperature', 23, 'Operating Temperature', false)) AS v(field_key, place, label, is_key)
 ON v.field_key = f.field_key WHERE status = 'verified')
SELECT product_id, {maker} AS maker, {mpn} AS mpn, '{item}' AS item, list(struct_pack(label := label, shown := shown, measure := measure, is_key := is_key) ORDER BY place) AS a FROM o GROUP BY product_id"""


#: Documents in pages of 300 characters, joined again.
_JOINED = """d AS (SELECT doc_id, text FROM documents WHERE text <> ''), g AS (SELECT doc_id, text, unnest(range((len(text) - 1) // 300 + 1)) AS page_no FROM d),
j AS (SELECT doc_id, string_agg(concat('--- [Page ', page_no::VARCHAR, '] ---', chr(10), substring(text, page_no * 300 + 1, 300)), chr(10) || chr(10) ORDER BY page_no) FILTER (trim(substring(text, page_no * 300 + 1, 300)) <> '') AS text FROM g GROUP BY doc_id)"""
#: Documents under addresses of five kinds, and what becomes of each.
_BATCH = """d AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 5 AS k FROM documents),
b AS (SELECT concat(CASE k WHEN 0 THEN 'https://www.moen.com/p/' WHEN 1 THEN 'https://shop.example/p/' WHEN 2 THEN 'https://www.amazon.com/dp/' WHEN 3 THEN 'http://192.168.0.1/' ELSE 'https://gone.example/' END, doc_id::VARCHAR) AS url,
 CASE WHEN k = 4 THEN -1 ELSE len(text) END::INTEGER AS n_chars, CASE WHEN k IN (2, 3) THEN 'sourcing' WHEN k = 4 THEN 'fetch' WHEN trim(text) = '' THEN 'content' END AS stage,
 CASE WHEN k = 2 THEN 'marketplace not permitted' WHEN k = 3 THEN 'not fetchable: blocked network 192.168.0.0/16' WHEN k = 4 THEN 'no such page' WHEN trim(text) = '' THEN 'empty page' WHEN len(trim(text)) < 200 THEN 'sparse page' END AS reason FROM d)"""
_BETWEEN = "[\\s\\x0b\\p{Z}\\x{85}\\x1c-\\x1f._/\\-–—]*"


def _delivery() -> str:
    """Every column of the delivery table over TEXTS: what is filled, and '' for the rest."""
    pk, given = "product_id[2:]::BIGINT", "CASE WHEN product_id[2:]::BIGINT % 4 = 0 THEN concat('MX-', product_id[2:]) ELSE concat('AX-', product_id[2:]) END"
    brand = f"(SELECT CASE WHEN p_partkey % 2 = 0 THEN p_brand END FROM part WHERE p_partkey = {pk})"
    filled = {
        "MFR URL": f"CASE WHEN {pk} % 3 = 0 THEN 'https://www.moen.com/p' ELSE '' END", "Mfg_Part_Num": given, "MANUFACTURER_PART_NUMBER": given, "BRAND_NAME": "coalesce(b.brand, '')", "Classpath": "'Industrial Sensor'", "Class": "'Industrial Sensor'",
        "Product Name": "concat('AX-', product_id[2:])", "Standard/Approvals": "'CE, ROHS'", "MOBILE_DESC": "mobile", "INVOICE_DESC": "invoice", "SHORT_DESC": "title", "LONG_DESC1": "long", "MARKETING_DESCRIPTION": "web",
    }
    for n in range(1, 51):
        filled |= {f"ATTRIBUTE_{kind} {n}": f"coalesce(slots[{n}].{field}, '')" for kind, field in (("LABEL", "label"), ("VALUE", "value"), ("UOM", "uom"))}
    columns = ", ".join(f"{filled.get(h, chr(39) * 2)} AS \"{header_name(h)}\"" for h in HEADERS)
    labels = {"voltage_rating": "Voltage Rating", "current_rating": "Current Rating", "ip_rating": "IP Rating", "connector_type": "Connector Type", "operating_temperature_min": "Operating Temp Min", "operating_temperature_max": "Operating Temp Max", "material": "Material", "thread_size": "Thread Size", "rated_voltage": "Rated voltage", "rated_current": "Rated current", "housing": "Housing", "operating_temperature": "Operating temperature"}
    return f"""WITH w AS (WITH {_descriptions(_text_records("Industrial Sensor", brand, given))} SELECT product_id, {", ".join(f"max(text) FILTER (format = '{f}') AS {f}" for f in ("invoice", "mobile", "title", "long", "web"))} FROM texts GROUP BY product_id),
l(place, field_key, label) AS (VALUES {_rows((n, k, v) for n, (k, v) in enumerate(labels.items()))}),
s AS (WITH {_FIELDS} SELECT product_id, list(struct_pack(label := l.label, value := f.value, uom := CASE unit WHEN '°C' THEN 'C' ELSE coalesce(unit, '') END) ORDER BY place) AS slots FROM f JOIN l ON l.field_key = f.field_key WHERE value IS NOT NULL GROUP BY product_id),
b AS (SELECT concat('P', p_partkey::VARCHAR) AS product_id, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS brand FROM part)
SELECT product_id, {columns}, len(slots)::INTEGER AS slots_used, array_to_string([x FOR x IN [CASE WHEN {pk} % 4 = 1 THEN 'part number rejected: X1 UPC 5' END, CASE WHEN {pk} % 3 = 1 THEN 'source is no manufacturer''s: distributor' END, 'no taxonomy: the item type stands for the classpath'] IF x IS NOT NULL], '; ') AS warnings
FROM w JOIN s USING (product_id) JOIN b USING (product_id)"""


ORACLE_SQL: dict[str, str] = {
    "dedup_survivors": f"WITH {_KEYED} SELECT row_index, Mfg_Part_Num, Part_Manuf, mpn_key, brand_key FROM m WHERE survives",
    "dedup_report": f"""WITH {_KEYED} SELECT count(*) AS total_rows, count(*) FILTER (survives) AS unique_products, count(*) FILTER (NOT survives) AS duplicate_rows_removed, count(*) FILTER (survives AND n > 1 AND mpn_key <> '') AS "groups",
 count(*) FILTER (mpn_key = '') AS rows_without_part_number, {_PCT.format("count(*) FILTER (NOT survives)", "count(*)")}::DOUBLE AS duplicate_rate_pct FROM m""",
    "mpn_collisions": f"""WITH {_KEYED} SELECT mpn_key, string_agg(DISTINCT brand_key, ', ' ORDER BY brand_key) FILTER (brand_key <> '') AS brands, count(DISTINCT CASE WHEN brand_key <> '' THEN brand_key END) AS n_brands, count(*) AS n_rows
 FROM k WHERE mpn_key <> '' GROUP BY mpn_key HAVING count(DISTINCT CASE WHEN brand_key <> '' THEN brand_key END) > 1""",
    "unit_normalise": f"WITH {_UNITS} SELECT id, unit, CASE WHEN trim(unit) <> '' THEN coalesce(approved, trim(unit)) END AS approved, {_FRACTION.replace('v::', 'value::')} AS fraction FROM u",
    "unmapped_units": f"WITH {_UNITS} SELECT trim(unit) AS unit, count(*) AS n FROM u WHERE trim(unit) <> '' AND approved IS NULL GROUP BY 1",
    "decimal_fraction": f"WITH r AS ({UNIT_ROWS}) SELECT id, value, {_FRACTION.replace('v::', 'value::')} AS fraction, value::DOUBLE AS back FROM r",
    "expand_abbrev": f"WITH {_EXPANDED} SELECT row_index, expanded FROM x",
    "classify_types": f"WITH {_CLASSIFIED} SELECT * FROM g",
    "classify_stats": f"""WITH {_CLASSIFIED} SELECT count(*) AS n_rows, count(item_type) AS classified, count(*) - count(item_type) AS unresolved, count(*) FILTER (item_type IS NOT NULL AND needs_review) AS needs_review,
 round_even(coalesce(avg(CASE WHEN item_type IS NOT NULL THEN confidence END), 0), 3)::DOUBLE AS mean_confidence, 0::BIGINT AS with_classpath, {_PCT.format("count(item_type)", "count(*)")}::DOUBLE AS resolution_rate_pct FROM g""",
    "lov_validate": f"WITH {_OUTCOME} SELECT row_id, outcome, canonical FROM o",
    "lov_compliance": f"""WITH {_OUTCOME} SELECT count(*) FILTER (outcome IN ('in_vocabulary', 'not_applicable', 'not_permitted')) AS checked, count(*) FILTER (outcome = 'in_vocabulary') AS in_vocabulary,
 count(*) FILTER (outcome = 'in_vocabulary' AND canonical <> value) AS corrected, count(*) FILTER (outcome IN ('not_applicable', 'not_permitted', 'no_classpath')) AS violations, count(*) FILTER (outcome = 'open') AS open_skipped,
 count(DISTINCT CASE WHEN outcome = 'no_classpath' THEN row_id END) AS rows_without_classpath, {_PCT.format("count(*) FILTER (outcome = 'in_vocabulary')", "count(*) FILTER (outcome IN ('in_vocabulary', 'not_applicable', 'not_permitted'))")}::DOUBLE AS lov_compliance_pct FROM o""",
    "brand_exact": f"""WITH c AS ({CATALOG}), b AS ({BRANDS}), m AS (SELECT row_index, Part_Manuf, {_EMPTY.format("Part_Manuf")} AS blank, {_BRAND_KEY.format("Part_Manuf")} AS k FROM c)
SELECT row_index, b.MANUFACTURER_NAME AS manufacturer_name, b.BRAND_NAME AS brand_name, 1.0::DOUBLE AS brand_confidence, CASE WHEN blank THEN 'placeholder' ELSE 'exact' END AS brand_method, false AS brand_review
FROM m LEFT JOIN b ON NOT blank AND {_BRAND_KEY.format("b.MANUFACTURER_NAME")} = k""",
    "field_accuracy": f"""WITH {_SCORES} SELECT field, total, exact, normalised, attempted, coalesce({_PCT.format("exact", "total")}, 0)::DOUBLE AS exact_pct, coalesce({_PCT.format("normalised", "total")}, 0)::DOUBLE AS normalised_pct,
 coalesce({_PCT.format("normalised - exact", "total")}, 0)::DOUBLE AS formatting_only_pct, coalesce({_PCT.format("attempted", "total")}, 0)::DOUBLE AS coverage_pct FROM s""",
    "weakest_fields": f"WITH {_SCORES} SELECT field, exact, total, coalesce({_PCT.format('exact', 'total')}, 0)::DOUBLE AS exact_pct FROM s WHERE field IS NOT NULL ORDER BY exact_pct, field LIMIT 2",
    "rating_checks": f"WITH {_FIELDS} SELECT product_id, field_key, value, status FROM f WHERE pos IN (2, 3, 4, 6, 7)",
    "extract_fields": f"WITH {_FIELDS} SELECT product_id, field_key, value, unit, confidence, CASE WHEN value IS NOT NULL THEN true END AS is_grounded FROM raw",
    "validate_fields": f"WITH {_FIELDS} SELECT product_id, field_key, value, unit, status FROM f",
    "record_summary": f"WITH {_SUMMARY} SELECT * FROM t",
    "catalog_stats": f"""WITH {_SUMMARY} SELECT count(*) AS products, count(*) FILTER (overall_status = 'verified') AS verified_products, count(*) FILTER (overall_status = 'needs_review') AS review_products, sum(total_fields)::BIGINT AS fields,
 sum(verified)::BIGINT AS verified_fields, sum(flagged)::BIGINT AS flagged_fields, {_PCT.format("sum(verified)", "sum(total_fields)")}::DOUBLE AS verification_rate_pct, (count(*) * 0.25)::DOUBLE AS hours_saved FROM t""",
    "catalog_descriptions": f"""WITH {_descriptions(_CATALOG_RECORDS)} SELECT product_id, format, text, length, "limit", compliant FROM texts""",
    "compliance_summary": f"""WITH {_descriptions(_CATALOG_RECORDS)} SELECT format, count(*) AS built, count(*) FILTER (compliant) AS compliant, CASE WHEN bool_and(compliant) THEN '' ELSE format END AS failing, {_PCT.format("count(*) FILTER (compliant)", "count(*)")}::DOUBLE AS compliance_pct FROM texts GROUP BY format""",
    "delivery_table": _delivery(),
    "product_views": f"""WITH {_descriptions(_text_records())}, c AS (WITH {_FIELDS} SELECT product_id, count(*) FILTER (status = 'verified') AS n_admitted, count(*) FILTER (value IS NOT NULL AND status <> 'verified') AS n_withheld FROM f GROUP BY product_id)
SELECT product_id, format, text, compliant, n_admitted, n_withheld, 'Sensor' AS item_type, 'fallback_token_overlap' AS method FROM texts JOIN c USING (product_id) WHERE product_id = (SELECT max(product_id) FROM texts)""",
    "commerce_report": f"""WITH t AS (WITH {_GATED} SELECT count(*) FILTER (reason IS NULL) AS n_admitted, count(*) FILTER (value IS NOT NULL AND reason IS NOT NULL) AS n_withheld, count(*) FILTER (value IS NOT NULL) AS n FROM g),
d AS (WITH {_descriptions(_text_records())} SELECT count(*) AS built, count(*) FILTER (compliant) AS compliant FROM texts),
s AS (WITH {_SUMMARY} SELECT count(*) AS products, count(*) FILTER (overall_status = 'verified') AS verified_products, count(*) FILTER (overall_status = 'needs_review') AS review_products, sum(total_fields)::BIGINT AS fields, sum(verified)::BIGINT AS verified_fields, sum(flagged)::BIGINT AS flagged_fields FROM t)
SELECT n_admitted, n_withheld, 0::BIGINT AS n_inferred, {_PCT.format("n_admitted", "n")}::DOUBLE AS pass_pct, built, compliant, {_PCT.format("compliant", "built")}::DOUBLE AS compliance_pct, products, verified_products, review_products, fields, verified_fields, flagged_fields,
 {_PCT.format("verified_fields", "fields")}::DOUBLE AS verification_rate_pct, (products * 0.25)::DOUBLE AS hours_saved, products AS types_n_rows, products AS types_classified, 0::BIGINT AS types_unresolved, 0::BIGINT AS types_needs_review, 0.94::DOUBLE AS types_mean_confidence, 0::BIGINT AS types_with_classpath,
 100.0::DOUBLE AS types_resolution_rate_pct, products AS dedup_total_rows, products AS dedup_unique_products, 0::BIGINT AS dedup_duplicate_rows_removed, 0::BIGINT AS dedup_groups, 0::BIGINT AS dedup_rows_without_part_number, 0.0::DOUBLE AS dedup_duplicate_rate_pct, 0::BIGINT AS lov_checked, 0::BIGINT AS lov_in_vocabulary,
 0::BIGINT AS lov_corrected, 0::BIGINT AS lov_violations, 0::BIGINT AS lov_open_skipped, 0::BIGINT AS lov_rows_without_classpath, NULL::DOUBLE AS lov_lov_compliance_pct, 'manufacturer_only' AS policy, false AS approved_list FROM t, d, s""",
    "trust_gate": f"WITH {_GATED} SELECT product_id, field_key, reason IS NULL AS admitted, reason FROM g",
    "trust_totals": f"""WITH {_GATED} SELECT count(*) FILTER (reason IS NULL) AS n_admitted, count(*) FILTER (value IS NOT NULL AND reason IS NOT NULL) AS n_withheld, 0::BIGINT AS n_inferred,
 {_PCT.format("count(*) FILTER (reason IS NULL)", "count(*) FILTER (value IS NOT NULL)")}::DOUBLE AS pass_pct FROM g""",
    "delivery_slots": f"""WITH {_FIELDS}, o AS (SELECT *, CASE field_key WHEN 'voltage_rating' THEN 1 WHEN 'current_rating' THEN 2 WHEN 'ip_rating' THEN 3 WHEN 'connector_type' THEN 4 WHEN 'operating_temperature_min' THEN 5
 WHEN 'operating_temperature_max' THEN 6 WHEN 'material' THEN 7 WHEN 'mounting_type' THEN 8 ELSE pos + 100 END AS place FROM f WHERE value IS NOT NULL AND field_key NOT IN ('product_name', 'category', 'certifications'))
SELECT product_id, row_number() OVER (PARTITION BY product_id ORDER BY place) AS slot, field_key, value FROM o""",
    "review_queue": f"""WITH {_LATEST}, {_FIELDS} SELECT f.product_id, f.field_key, {_KEPT_STATUS} AS status FROM f LEFT JOIN l ON l.product_id = f.product_id AND l.field_key = f.field_key WHERE {_KEPT_STATUS} <> 'verified'""",
    "catalog_search": f"WITH {_FIELDS} SELECT product_id AS id, value AS ip_rating FROM f WHERE field_key = 'ip_rating' AND value = 'IP67'",
    "catalog_export": f"""WITH {_SUMMARY}, w AS (SELECT product_id, {", ".join(f"coalesce(max(CASE WHEN field_key = '{k}' THEN concat_ws(' ', value, unit) END) FILTER (value IS NOT NULL), '') AS {k}" for k in ("product_name", "category", "voltage_rating", "current_rating", "ip_rating", "connector_type", "material"))},
 string_agg(concat(upper(field_key[1]), replace(field_key[2:], '_', ' '), ': ', value), ' | ' ORDER BY pos) FILTER (NOT is_core) AS other FROM f GROUP BY product_id)
SELECT w.* EXCLUDE (other), replace(other, 'Thread size', 'Thread Size') AS other_specs, overall_status, concat(floor(overall_confidence * 100)::BIGINT::VARCHAR, '%') AS confidence, '' AS created_at FROM w JOIN t USING (product_id)""",
    "terse_attributes": f"WITH c AS ({CATALOG}), {_TERSE} SELECT row_index, pos, label, value, unit, evidence FROM e",
    "listing_fields": f"WITH {_LISTED} SELECT product_id, field_key, value, unit, confidence, status FROM f",
    "identity_columns": """SELECT concat('L', p_partkey::VARCHAR) AS product_id, CASE WHEN p_partkey % 4 = 0 THEN concat('MX-', p_partkey::VARCHAR) WHEN p_partkey % 5 <> 0 THEN concat('DCB', p_partkey::VARCHAR) ELSE '' END AS mpn,
 CASE WHEN p_partkey % 2 = 0 THEN 'Stanley Black & Decker' ELSE concat('Maker ', p_brand) END AS manufacturer, CASE p_partkey % 3 WHEN 0 THEN 'DEWALT' WHEN 1 THEN 'BLACK+DECKER' ELSE p_brand END AS brand,
 CASE p_partkey % 3 WHEN 0 THEN 'https://www.moen.com/p' ELSE '' END AS url,
 ((p_partkey % 4 = 1)::INT + (p_partkey % 2 = 0)::INT + (p_partkey % 3 < 2)::INT + (p_partkey % 3 = 1)::INT)::INTEGER AS n_warnings FROM part""",
    "newest_products": "SELECT o_orderkey AS product_id, o_orderdate::VARCHAR AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100",
    "catalog_validated": f"""WITH {_KEYED}, {_TERSE} SELECT e.row_index AS row_id, label, value, CASE WHEN kind > 1 THEN 'no_classpath' WHEN label = 'Size' THEN 'open' WHEN label = 'Material' THEN 'in_vocabulary' ELSE 'not_applicable' END AS outcome,
 CASE WHEN kind <= 1 AND label = 'Material' THEN value END AS canonical FROM e JOIN m ON m.row_index = e.row_index WHERE m.survives""",
    "lov_suggest": f"""WITH {_OUTCOME} SELECT row_id, label, value, outcome, CASE outcome WHEN 'not_permitted' THEN 'Bronze' WHEN 'not_applicable' THEN 'Material' ELSE 'Valves > Ball Valve' END AS suggestion
 FROM o WHERE (outcome = 'not_permitted' AND cp = 'Fittings > Coupling' AND lk = 'material' AND vk = 'bronz') OR (outcome = 'not_applicable' AND lk = 'materials') OR outcome = 'no_classpath'""",
    "grounding": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), b AS (SELECT a.doc_id, {_FLAT.format("a.text")} AS t, {_FLAT.format("substring(a.text, 11, 60)")} AS own, {_FLAT.format("coalesce(substring(z.text, 11, 60), '')")} AS other FROM d a LEFT JOIN d z ON z.doc_id + 1 = a.doc_id)
SELECT doc_id, {_STANDS.format("own", "t")} AS own_grounded, {_STANDS.format("other", "t")} AS foreign_grounded FROM b""",
    "short_runs": """WITH d AS (SELECT doc_id, [x FOR x IN [trim(y) FOR y IN regexp_split_to_array(coalesce(text, ''), '[.,\\n]')] IF x <> ''] AS c FROM documents), x AS (SELECT doc_id, unnest(c) AS t, unnest(range(len(c))) AS pos FROM d),
s AS (SELECT *, len(t) <= 25 AND len(string_split(t, ' ')) <= 4 AS short FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, short ORDER BY pos) AS island FROM s),
g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, short, island) AS n, row_number() OVER (PARTITION BY doc_id, short, island ORDER BY pos) AS place FROM r),
k AS (SELECT doc_id, CASE WHEN short AND n > 15 AND place = 4 THEN '[...omitted repetitive list content...]' ELSE t END AS t FROM g WHERE NOT short OR n <= 15 OR place <= 4)
SELECT doc_id, count(*) AS n_kept, count(*) FILTER (t = '[...omitted repetitive list content...]') AS n_marked, sum(len(t))::BIGINT AS n_chars FROM k GROUP BY doc_id""",
    "joined_pages": f"WITH {_JOINED} SELECT doc_id, md5(text) AS digest, len(text)::INTEGER AS n_chars FROM j",
    "snippet_pages": f"""WITH {_JOINED}, s AS (SELECT doc_id, v.* FROM d, LATERAL (VALUES ('head', substring(d.text, 1, 12)), ('middle', substring(d.text, len(d.text) // 2 + 1, 9)), ('last', right(d.text, 15)), ('none', chr(1))) AS v(field_key, snippet)),
a AS (SELECT s.doc_id, field_key, strpos(lower(j.text), lower(snippet)) AS place, j.text FROM s JOIN j USING (doc_id))
SELECT doc_id, field_key, CASE WHEN place = 0 THEN -1 ELSE list_max([x::INTEGER FOR x IN regexp_extract_all(substring(text, 1, place + 22), '--- \\[Page ([0-9]+)\\] ---', 1)]) END::INTEGER AS page_no FROM a""",
    "enriched_fields": """SELECT concat('E', p_partkey::VARCHAR) AS product_id, v.field_key, v.value, v.confidence, v.status FROM part, LATERAL (VALUES
 ('mounting_type', CASE p_partkey % 5 WHEN 0 THEN 'Threaded' ELSE '' END, CASE p_partkey % 5 WHEN 0 THEN 0.82 ELSE 0.0 END::DOUBLE, CASE p_partkey % 5 WHEN 0 THEN 'ai_enriched' ELSE 'missing' END),
 ('voltage_rating', CASE p_partkey % 5 WHEN 1 THEN '30' ELSE '' END, CASE p_partkey % 5 WHEN 1 THEN 0.7 ELSE 0.0 END, CASE p_partkey % 5 WHEN 1 THEN 'ai_enriched' ELSE 'missing' END),
 ('material', CASE p_partkey % 5 WHEN 2 THEN 'nickel-plated brass' ELSE '' END, CASE p_partkey % 5 WHEN 2 THEN 0.9 ELSE 0.0 END, CASE p_partkey % 5 WHEN 2 THEN 'verified' WHEN 3 THEN 'needs_review' ELSE 'missing' END)) AS v(field_key, value, confidence, status)""",
    "product_listing": f"""WITH r AS ({RECORDS}) SELECT id, created_at::VARCHAR AS created_at, json_extract_string(data_json, '$.status') AS status, json_extract_string(data_json, '$.clerk') AS clerk FROM r WHERE json_valid(data_json)""",
    "approved_list": """WITH h AS (SELECT lower(regexp_extract(CASE WHEN contains(url, '://') THEN url ELSE 'https://' || url END, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host FROM pages), p AS (SELECT [x FOR x IN string_split(regexp_replace(host, '^www[0-9]?\\.', ''), '.') IF x <> ''] AS parts FROM h)
SELECT DISTINCT CASE WHEN len(parts) >= 3 AND parts[-2] IN ('co', 'com', 'net', 'org', 'gov', 'edu', 'ac', 'or', 'ne') THEN parts[-3] WHEN len(parts) >= 2 THEN parts[-2] ELSE parts[1] END AS registrable FROM p WHERE len(parts) > 0""",
    "unit_table": f"""WITH x AS ({MORE_UNITS}), a(unit, approved, rank) AS (SELECT variant, approved, 0 FROM x UNION ALL SELECT approved, approved, 0 FROM x UNION ALL SELECT * FROM (VALUES {_rows((*r, 1) for r in unit_rows())}) AS s(v, a, n)),
k AS (SELECT {_UNIT_KEY} AS variant, approved, rank FROM a) SELECT variant, arg_min(approved, concat(rank::VARCHAR, approved)) AS approved FROM k GROUP BY variant""",
    "repaired_text": f"""WITH g AS ({GLUED}), s AS (SELECT p_partkey AS id, p_size::VARCHAR AS n, (p_size * 0.25)::VARCHAR AS v, p_name FROM part), f AS (SELECT *, {_FRACTION} AS fraction FROM s)
SELECT f.id, CASE f.id % 5 WHEN 0 THEN concat('Pipe of ', fraction, ' in by ', n, 'mm') ELSE g.text END AS as_fractions,
 CASE f.id % 5 WHEN 0 THEN concat('Pipe of ', v, ' in by ', n, ' mm') WHEN 1 THEN concat(n, ' in cover, ', n, ' V') WHEN 2 THEN concat('weighs ', n, ' lb') WHEN 3 THEN concat('model ', n, 'G of ', n, '-1/4 in') ELSE g.text END AS spaced FROM f JOIN g ON g.id = f.id""",
    "search_queries": f"""WITH c AS ({CATALOG}), m AS (SELECT row_index, {", ".join(f"CASE WHEN lower({x}) NOT IN ('', 'unbranded', 'no brand', 'n/a', 'none', 'null', 'unknown') THEN {x} END AS {n}" for n, x in ((n, f"trim(regexp_replace({n}, '\\s+', ' ', 'g'), ' -')") for n in ("Mfg_Part_Num", "Part_Manuf", "E1_Brand", "Part_Desc")))} FROM c)
SELECT row_index, concat_ws(' ', '"' || Mfg_Part_Num || '"', Part_Manuf, E1_Brand, substring(array_to_string(string_split(Part_Desc, ' ')[1:10], ' '), 1, 100)) AS query FROM m""",
    "usable_features": """SELECT concat('P', p_partkey::VARCHAR) AS product_id, concat(CASE WHEN p_partkey % 2 = 0 THEN concat('Runs ', p_size::VARCHAR, ' hours at 2 Ah | Runs ', p_size::VARCHAR, ' hours at 2 Ah pack | ') ELSE '' END, 'Brushless | ', p_name) AS features FROM part""",
    "page_numbers": f"""WITH n AS (SELECT DISTINCT upper(regexp_replace(regexp_extract(text, '^\\s*([A-Za-z]+\\s+[A-Za-z]+)', 1), '[^A-Za-z0-9]+', '', 'g')) AS number_key FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM documents)),
p AS (SELECT number_key, '(?i)(^|[^A-Za-z0-9])' || array_to_string(string_split(number_key, ''), '{_BETWEEN}') || '($|[^A-Za-z0-9])' AS pattern FROM n WHERE number_key <> ''),
c AS (SELECT doc_id, text, upper(regexp_replace(text, '[^A-Za-z0-9]+', '', 'g')) AS compact FROM documents), m AS MATERIALIZED (SELECT doc_id, text, number_key, pattern FROM c JOIN p ON contains(compact, number_key))
SELECT doc_id, number_key FROM m WHERE regexp_matches(text, pattern)""",
    "batch_outcomes": f"WITH {_BATCH} SELECT url, n_chars, stage, reason FROM b",
    "batch_totals": f"WITH {_BATCH} SELECT coalesce(stage, 'processed') AS stage, coalesce(reason, '') AS reason, count(*) AS n FROM b GROUP BY ALL",
    "review_latest": f"WITH {_LATEST} SELECT product_id, field_key, action, new_value FROM l",
    "content_richness": _richness(),
    "source_policy": f"""WITH u AS ({URLS}), h AS (SELECT page_id, page_id % 6 AS k, lower(regexp_extract(CASE WHEN contains(url, '://') THEN url ELSE 'https://' || url END, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM u),
p AS (SELECT *, [x FOR x IN string_split(regexp_replace(host, '^www[0-9]?\\.', ''), '.') IF x <> ''] AS parts FROM h),
r AS (SELECT *, CASE WHEN len(parts) >= 3 AND parts[-2] IN ('co', 'com', 'net', 'org', 'gov', 'edu', 'ac', 'or', 'ne') THEN parts[-3] WHEN len(parts) >= 2 THEN parts[-2] ELSE parts[1] END AS registrable FROM p),
n(o, kind, name) AS (VALUES {_KINDS}), q AS (SELECT r.*, (SELECT arg_min(kind, o) FROM n WHERE n.name = r.registrable) AS kind FROM r)
SELECT page_id, registrable, CASE WHEN k IN (3, 4, 5) THEN 'unfetchable' ELSE coalesce(kind, 'unknown') END AS category, k NOT IN (3, 4, 5) AND coalesce(kind, 'unknown') IN ('unknown', 'manufacturer') AS allowed,
 NOT (k NOT IN (3, 4, 5) AND coalesce(kind, '') = 'manufacturer') AS needs_review FROM q""",
    "url_safety": f"""WITH u AS ({URLS}) SELECT page_id, lower(regexp_extract(CASE WHEN contains(url, '://') THEN url ELSE 'https://' || url END, '^[a-z]+://([^/?#:]+)', 1)) AS host, page_id % 6 NOT IN (3, 4, 5) AS safe,
 CASE page_id % 6 WHEN 3 THEN 'blocked network 10.0.0.0/8' WHEN 4 THEN 'scheme not allowed' WHEN 5 THEN 'port not allowed' END AS refusal FROM u""",
}

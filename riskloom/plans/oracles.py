"""DuckDB SQL for the registered queries. Lexicons and rules are written into it from the fixed values."""

from __future__ import annotations

import re

from riskloom.functions import lexicon as L
from riskloom.functions.metadata import METRICS
from riskloom.sources import domain as D


def q(value) -> str:
    return "'" + str(value).replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def items(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def case(key: str, table: dict, default) -> str:
    return "CASE " + " ".join(f"WHEN {key} = {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {q(default)} END"


def hits(text: str, words) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({text}, {q(w)}) THEN 1 ELSE 0 END" for w in words) + ")"


def best(text: str, weights: dict) -> str:
    return "greatest(" + ", ".join(f"CASE WHEN contains({text}, {q(k)}) THEN {v}::DOUBLE ELSE 0::DOUBLE END" for k, v in weights.items()) + ")"


def filled(text: str) -> str:
    for mark, value in (("{N}", "nation"), ("{S}", "sup"), ("{B}", "brand"), ("{M}", "mpn"), ("{C}", "stocked")):
        text = f"replace({text}, '{mark}', {value})"
    return text


def placed(values, index: str) -> str:
    return f"replace(replace({items(values)}[{index} + 1], '{{N}}', nation), '{{n}}', lower(nation))"


def titled_case(text: str) -> str:
    """A label cleaned of quotes and runs of space, in title case if it is in small letters."""
    clean = f"regexp_replace(regexp_replace(trim({text}), '^[''\"]+|[''\"]+$', '', 'g'), '\\s+', ' ', 'g')"
    return f"list_transform([{clean}], lambda t: CASE WHEN lower(t) = t AND upper(t) <> t THEN array_to_string(list_transform(string_split(t, ' '), lambda w: upper(w[1]) || substr(w, 2)), ' ') ELSE t END)[1]"


def labels_of(v: str) -> str:
    """Labels of a JSON value: of a list, of the literal of a list, or of a scalar."""
    each = titled_case("x")
    return f"""list_transform(CASE json_type({v}) WHEN 'ARRAY' THEN regexp_extract_all({v}::VARCHAR, '"([^"]*)"', 1) WHEN 'OBJECT' THEN [] WHEN 'NULL' THEN []
        ELSE CASE WHEN starts_with({v} ->> '$', '[') AND ends_with({v} ->> '$', ']') THEN regexp_extract_all({v} ->> '$', '''([^'']*)''', 1) ELSE [{v} ->> '$'] END END, lambda x: {each})"""


def linked_as(kind: str, canonical: str, name: str, score: str, method: str, text: str, review: str = "false") -> str:
    return f"'{kind}' AS type, {canonical} AS canonical, {name} AS name, ({score})::DOUBLE AS score, {method} AS method, {text} AS surface, {review} AS review"


def best_links(of: str, key: str) -> str:
    return f"SELECT * FROM {of} QUALIFY row_number() OVER (PARTITION BY {key}, type, canonical ORDER BY score DESC, method, surface, name, review) = 1"


REASONS = """list_filter([CASE WHEN class_confidence < 0.6 THEN 'low_classification_confidence' END, CASE WHEN link_score < 0.7 AND n_mentions > 0 THEN 'low_entity_link_confidence' END,
        CASE WHEN n_mentions = 0 AND event_category NOT IN ('natural_disaster', 'other') THEN 'no_entities_for_event_type' END, CASE WHEN severity >= 70 AND class_confidence < 0.7 THEN 'high_severity_low_confidence_mismatch' END,
        CASE WHEN event_category IN ('factory_shutdown', 'logistics_disruption', 'export_sanction') AND n_links < 1 THEN 'supply_chain_event_no_entities' END], lambda x: x IS NOT NULL)"""
DOUBTS = """concat_ws(',', CASE WHEN n_sources < 2 THEN 'few_sources' END, CASE WHEN class_confidence < 0.6 THEN 'low_classification_confidence' END, CASE WHEN n_mentions > 0 AND link_score < 0.7 THEN 'weak_entity_matching' END,
        CASE WHEN n_links = 0 AND event_category NOT IN ('natural_disaster', 'other') THEN 'missing_entity_links' END, CASE WHEN verification < 0.5 AND n_sources >= 2 THEN 'weak_multi_source_agreement' END)"""
OVERALL = "round_even(greatest(0, least(1, class_confidence * 0.35::DOUBLE + link_score * 0.25::DOUBLE + mention_confidence * 0.15::DOUBLE + source_weight * 0.15::DOUBLE + verification * 0.10::DOUBLE)), 3)"
TIER = "CASE tier WHEN 1 THEN 1 WHEN 2 THEN 0.85 WHEN 3 THEN 0.65 ELSE 0.5 END::DOUBLE"
MEAN = "sum(CASE tier WHEN 1 THEN 100 WHEN 2 THEN 85 WHEN 3 THEN 65 ELSE 50 END) / (count(*) * 100.0::DOUBLE)"
KINDS = (("suppliers", "SUPPLIER"), ("manufacturers", "MANUFACTURER"), ("components", "COMPONENT"), ("locations", "LOCATION"))


def factored(several: str) -> str:
    """The factors' contributions."""
    weight = case("provider", {p: v[1] * 100.0 for p, v in L.PROVIDERS.items()}, 50.0)
    impact = "CASE WHEN n_links = 0 THEN 10.0 WHEN n_links >= 6 THEN 90.0 WHEN n_links >= 3 THEN 65.0 ELSE 40.0 END::DOUBLE"
    scores = ["base_severity", "coalesce(supplier_risk, 0) * 100.0", f"{weight}::DOUBLE", impact, "geo_score", "market_score", several]
    return ", ".join(f"round_even({v} * {w!r}::DOUBLE, 2) AS c_{k}" for v, (k, w) in zip(scores, L.WEIGHTS.items(), strict=True))


def top_three(item: str, separator: str) -> str:
    rows = ", ".join(f"({i}, {q(k)}, c_{k})" for i, k in enumerate(L.WEIGHTS))
    return f"(SELECT string_agg({item}, '{separator}' ORDER BY c DESC, i) FROM (SELECT * FROM (VALUES {rows}) v(i, f, c) ORDER BY c DESC, i LIMIT 3))"


TOTAL = "round_even(greatest(0, least(100, " + " + ".join(f"c_{k}" for k in L.WEIGHTS) + ")), 1)"
NORM = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
SUP = "'SUP' || lpad(({0})::VARCHAR, 3, '0')"
MPN = "'MPN' || lpad(({0})::VARCHAR, 6, '0')"

CTES = {
    "distributors": f"""SELECT {SUP.format('s_suppkey')} AS code, s_name AS name, n_name AS country, CASE s_suppkey % 4 WHEN 3 THEN 'no' WHEN 2 THEN ' TRUE ' ELSE 'Yes' END AS dealt_with,
        CASE WHEN s_acctbal < 0 THEN 0.9::DOUBLE WHEN s_acctbal < 3000 THEN 0.6::DOUBLE WHEN s_acctbal < 6000 THEN 0.3::DOUBLE ELSE 0::DOUBLE END AS risk FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "active": "SELECT * FROM distributors WHERE lower(trim(dealt_with)) IN ('yes', 'y', 'true', '1')",
    "manufacturers": "SELECT p_brand AS name, n_name AS country, replace(p_brand, '#', ' ') AS alias FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL) LEFT JOIN nation ON regexp_extract(p_brand, '([0-9]+)', 1)::INT % 25 = n_nationkey",
    "parts": f"SELECT {MPN.format('p_partkey')} AS mpn, coalesce(p_brand, '') AS manufacturer, coalesce(CASE WHEN p_type IN ('MEDIUM', 'PROMO') THEN lower(p_type) || '__parts' ELSE p_type END, 'catalog') AS category, p_name AS description FROM part",
    "stock": f"""SELECT {SUP.format('l_suppkey')} AS code, {MPN.format('l_partkey')} AS mpn, coalesce(p.manufacturer, '') AS manufacturer, coalesce(p.category, 'catalog') AS category,
        abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE) % 90)::INT AS lead_time_days, l_quantity AS quantity, l_orderkey * 8 + l_linenumber AS ordinal
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY mpn ORDER BY manufacturer, category) = 1) p ON p.mpn = {MPN.format('l_partkey')} WHERE {SUP.format('l_suppkey')} IN (SELECT code FROM active)""",
    "countries": "SELECT country FROM active WHERE country <> '' UNION SELECT country FROM manufacturers WHERE country <> ''",
    "filled": f"""SELECT event_id, ts, user_id, k, {items(L.PROVIDERS)}[user_id % 5 + 1] AS provider, 'NATION_' || (user_id % 25) AS nation, {SUP.format('event_id % 10')} AS sup, CASE WHEN event_id % 2 = 0 THEN 'Brand#' ELSE 'Brand ' END || (event_id % 25 + 1) AS brand, {items(D.STOCKED)}[event_id % 3 + 1] AS stocked, {MPN.format('event_id % 50')} AS mpn
        FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events)""",
    "articles0": f"""SELECT event_id AS article_id, provider, {case('provider', {n: p[0] for n, p in L.PROVIDERS.items()}, 3)} AS tier, {filled(f'{items(D.TITLES)}[event_id % 24 + 1]')} AS title, {filled(q(D.BODY))} AS body, CASE WHEN event_id % 9 <> 0 THEN 'https://news.example/' || provider || '/' || (event_id % 700) END AS url,
        CASE WHEN provider = 'marketaux' THEN (k - 60) / 100.0::DOUBLE END AS sentiment, CASE WHEN provider = 'gdacs' THEN {items(D.GDACS_TYPES)}[event_id % 7 + 1] END AS gdacs_type, CASE WHEN provider = 'gdacs' THEN {items(D.GDACS_LEVELS)}[event_id % 3 + 1] END AS alert_level,
        CASE WHEN provider = 'gdacs' AND k % 4 <> 0 THEN (k % 80) / 10.0::DOUBLE END AS magnitude, CASE WHEN provider = 'gdelt' THEN {items(D.GDELT_CATEGORIES)}[k % 3 + 1] END AS category, CASE WHEN provider = 'gdelt' THEN {items(D.GDELT_CODES)}[k % 4 + 1] END AS event_code,
        CASE WHEN provider = 'gdelt' THEN {items(D.GDELT_SUBS)}[k % 5 + 1] END AS subcategory, CASE WHEN provider = 'gdelt' THEN (k % 10) / 10.0::DOUBLE END AS significance,
        CASE provider WHEN 'gdelt' THEN CASE WHEN k % 2 = 0 THEN record ELSE '{{"raw": ' || record || '}}' END WHEN 'gdacs' THEN '{{"affected_countries": ' || {placed(D.AFFECTED, 'event_id % 4')} || more END AS metadata
        FROM (SELECT *, '{{"category": "' || {items(D.GDELT_CATEGORIES)}[k % 3 + 1] || '", "event_code": "' || {items(D.GDELT_CODES)}[k % 4 + 1] || '", "subcategory": "' || {items(D.GDELT_SUBS)}[k % 5 + 1] || '"' || more AS record
        FROM (SELECT *, ', "geo": ' || {placed(D.GEO, 'event_id % 8')} || ', "country": ' || {placed(D.COUNTRY, 'event_id % 3')} || ', "metrics": ' || {items(D.METRICS)}[event_id % 5 + 1] || '}}' AS more FROM filled))""",
    "geos": """SELECT *, CASE WHEN json_type(rec -> 'geo') = 'OBJECT' THEN rec -> 'geo' END AS geo, CASE WHEN json_type(rec -> 'metrics') = 'OBJECT' THEN rec -> 'metrics' END AS metrics
        FROM (SELECT article_id, whole, CASE WHEN json_type(whole -> 'raw') = 'OBJECT' THEN whole -> 'raw' ELSE whole END AS rec FROM (SELECT article_id, metadata::JSON AS whole FROM articles0 WHERE metadata IS NOT NULL))""",
    "coords": f"""SELECT article_id, try_cast(geo ->> 'latitude' AS DOUBLE) AS latitude, try_cast(geo ->> 'longitude' AS DOUBLE) AS longitude, nullif(array_to_string({labels_of('own')}, ', '), '') AS country, nullif({titled_case("geo ->> 'region'")}, '') AS region,
        coalesce({", ".join(f"try_cast(metrics ->> '{m}' AS DOUBLE)" for m in METRICS)}) AS metric FROM (SELECT *, CASE WHEN coalesce(geo ->> 'country', '') <> '' THEN geo -> 'country' ELSE whole -> 'country' END AS own FROM geos)""",
    "articles": "SELECT a.*, c.country AS geo_country FROM articles0 a LEFT JOIN coords c USING (article_id)",
    "place_values": """SELECT article_id, 1 AS o, 1 AS e, 'geo.country' AS source, geo -> 'country' AS v FROM geos UNION ALL SELECT article_id, 2, 1, 'geo.admin1', geo -> 'admin1' FROM geos UNION ALL SELECT article_id, 3, 1, 'geo.location', geo -> 'location' FROM geos
        UNION ALL SELECT article_id, 4, 1, 'raw.country', rec -> 'country' FROM geos UNION ALL SELECT article_id, 5, 1, 'provider.country', whole -> 'country' FROM geos
        UNION ALL SELECT article_id, 6, e, 'affected_countries', CASE WHEN json_type(x) = 'OBJECT' THEN CASE WHEN coalesce(x ->> 'countryname', '') <> '' THEN x -> 'countryname' ELSE x -> 'country' END ELSE x END
        FROM (SELECT article_id, unnest(list) AS x, generate_subscripts(list, 1) AS e FROM (SELECT article_id, (rec -> 'affected_countries')::JSON[] AS list FROM geos WHERE json_type(rec -> 'affected_countries') = 'ARRAY'))""",
    "places": f"""SELECT article_id, label, source, (row_number() OVER (PARTITION BY article_id ORDER BY o, e, p) - 1)::INT AS ordinal FROM (
        SELECT *, row_number() OVER (PARTITION BY article_id, lower(label) ORDER BY o, e, p) AS r FROM (SELECT article_id, o, e, source, unnest(list) AS label, generate_subscripts(list, 1) AS p FROM (SELECT *, {labels_of('v')} AS list FROM place_values WHERE v IS NOT NULL)) WHERE length(label) >= 2) WHERE r = 1""",
    "doc_articles": "SELECT doc_id AS article_id, 'gnews' AS provider, '' AS title, text AS body, NULL::VARCHAR AS category, NULL::VARCHAR AS event_code, NULL::VARCHAR AS subcategory, NULL::VARCHAR AS metadata FROM documents",
    "lex": "SELECT * FROM (VALUES " + ", ".join(f"({n}, {q(t)}, {q(w)}, {weight * (0.25 if t in L.CORE_TOPICS else 0.20)!r}::DOUBLE, {0.12 * weight!r}::DOUBLE)" for n, (t, w, weight) in enumerate((t, w, weight) for t, (weight, words) in L.TOPICS.items() for w in words)) + ") x(n, topic, word, score, meta)",
    "texts": "SELECT *, lower(trim(concat_ws(' ', title, body))) AS text FROM {articles}",
    "mfr": "SELECT article_id, count(*) AS n, string_agg(term, ',' ORDER BY length(term) DESC, term) AS found, string_agg('manufacturer:' || term, ',' ORDER BY length(term) DESC, term) AS names FROM texts JOIN (SELECT name AS term FROM manufacturers UNION SELECT alias FROM manufacturers) t ON length(term) >= 3 AND contains(text, lower(term)) AND regexp_matches(text, '\\b' || regexp_escape(lower(term)) || '\\b') GROUP BY 1",
    "cat": "SELECT article_id, count(*) AS n, string_agg('category:' || term, ',' ORDER BY length(term) DESC, term) AS names FROM texts JOIN (SELECT DISTINCT trim(regexp_replace(replace(replace(category, '__', ' '), '_', ' '), '\\s+', ' ', 'g')) AS term FROM stock) t ON contains(text, term) AND regexp_matches(text, '\\b' || regexp_escape(term) || '\\b') GROUP BY 1",
    "hit": "SELECT article_id, count(*) AS n, sum(score) AS score, string_agg(topic || ':' || word, ',' ORDER BY length(word) DESC, lex.n) AS names FROM texts JOIN lex ON contains(text, word) GROUP BY 1",
    "meta": "SELECT article_id, count(*) AS n, sum(meta) AS score, string_agg('metadata:' || topic || ':' || word, ',' ORDER BY length(word) DESC, lex.n) AS names FROM texts JOIN lex ON provider = 'gdelt' AND contains(lower(metadata), word) AND NOT contains(text, word) GROUP BY 1",
    "counted": f"""SELECT t.*, coalesce(h.n, 0) AS n_hits, coalesce(m.n, 0) AS n_mfr, coalesce(g.n, 0) AS n_cat, coalesce(m.found, '') AS manufacturers_found, coalesce(d.n, 0) AS n_meta, coalesce(h.score, 0) AS hit_score, coalesce(d.score, 0) AS meta_score, h.names AS h_names, m.names AS m_names, g.names AS c_names, d.names AS d_names,
        CASE WHEN provider = 'gdelt' AND upper(json_extract_string(metadata, '$.event_code')) IN ({items(L.SIGNAL_CODES)[1:-1]}) THEN upper(json_extract_string(metadata, '$.event_code')) END AS code, {hits('text', L.CONTEXT)} >= 2 AS context, list_filter({items(L.NEGATIVE)}, lambda w: contains(text, w))[1] AS neg
        FROM texts t LEFT JOIN hit h USING (article_id) LEFT JOIN mfr m USING (article_id) LEFT JOIN cat g USING (article_id) LEFT JOIN meta d USING (article_id)""",
    "scored0": """SELECT *, n_hits + n_mfr + n_cat + n_meta > 0 OR code IS NOT NULL AS any_match, concat_ws(',', h_names, m_names, c_names, CASE WHEN n_hits >= 2 THEN 'signal:multi_topic_cooccurrence' END, CASE WHEN n_mfr > 0 AND n_cat > 0 THEN 'signal:manufacturer_category_cooccurrence' END,
        CASE WHEN n_mfr > 0 AND n_hits > 0 THEN 'signal:manufacturer_topic_cooccurrence' END, d_names, 'metadata:gdelt_event_code:' || code, CASE WHEN n_mfr + n_cat >= 2 OR (n_mfr > 0 AND context) THEN 'signal:strong_context' END) AS names,
        hit_score + 0.35 * n_mfr + 0.20 * n_cat + CASE WHEN n_hits >= 2 THEN 0.15 ELSE 0 END + CASE WHEN n_mfr > 0 AND n_cat > 0 THEN 0.20 ELSE 0 END + CASE WHEN n_mfr > 0 AND n_hits > 0 THEN 0.10 ELSE 0 END + meta_score
            + CASE WHEN code IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN n_mfr + n_cat >= 2 OR (n_mfr > 0 AND context) THEN 0.10 ELSE 0 END AS raw FROM counted""",
    "scored": f"""SELECT *, round_even(exact, 4) AS score FROM (SELECT *, round_even(CASE WHEN provider = 'gdacs' THEN 1 WHEN text = '' OR neg IS NOT NULL THEN 0 WHEN NOT any_match THEN CASE WHEN context THEN 0.15 ELSE 0.12 END ELSE least(1.0, raw) END::DOUBLE, 9) AS exact,
        CASE WHEN provider = 'gdacs' THEN 'provider:auto_pass' WHEN text = '' THEN '' WHEN neg IS NOT NULL THEN 'negative:' || neg ELSE names END AS matched,
        CASE WHEN provider = 'gdacs' THEN 'provider_auto_pass' WHEN text = '' THEN 'empty_content' WHEN neg IS NOT NULL THEN 'negative_keyword_match' WHEN NOT any_match THEN CASE WHEN context THEN 'has_context_no_direct_match' ELSE 'no_keyword_or_entity_match' END ELSE 'keyword_entity_score' END AS reason,
        {case('provider', {p: v[2] for p, v in L.PROVIDERS.items()}, 0.40)}::DOUBLE AS least FROM scored0)""",
    "names": "SELECT code AS surface, code AS canonical, 'SUPPLIER' AS type FROM active UNION ALL SELECT name, name, 'MANUFACTURER' FROM manufacturers UNION ALL SELECT country, country, 'LOCATION' FROM countries",
    "phrases": "SELECT alias AS surface, name AS canonical, 'MANUFACTURER' AS type FROM manufacturers UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({q(k)}, {q(k)}, 'LOCATION')" for k in [*L.REGIONS, *L.LOCATIONS]) + ") v(a, b, c)",
    "words": "SELECT DISTINCT article_id, unnest(regexp_extract_all(lower(concat_ws(' ', title, body)), '[a-z0-9_#]+')) AS word FROM {articles}",
    "mentions": """SELECT article_id, canonical, type, lower(surface) AS surface, (instr(text, lower(surface)) - 1)::INT AS span_start, (instr(text, lower(surface)) - 1 + length(surface))::INT AS span_end FROM (
        SELECT article_id, text, surface, canonical, type, row_number() OVER (PARTITION BY article_id, lower(canonical), type ORDER BY length(surface) DESC, instr(text, lower(surface)), canonical) AS r FROM (
        SELECT article_id, surface, canonical, type FROM words JOIN names ON word = lower(surface) UNION SELECT article_id, surface, canonical, type FROM texts JOIN phrases ON contains(text, lower(surface)) WHERE regexp_matches(text, '\\b' || regexp_escape(lower(surface)) || '\\b')) JOIN texts USING (article_id)) WHERE r = 1""",
    "extracted": """SELECT article_id, surface, type, first(canonical ORDER BY confidence, canonical) AS canonical, min(confidence) AS confidence FROM (SELECT article_id, surface, type, canonical, 0.85::DOUBLE AS confidence FROM mentions
        UNION ALL SELECT article_id, lower(label), 'LOCATION', label, 0.92::DOUBLE FROM places) GROUP BY 1, 2, 3""",
    "told": "SELECT DISTINCT surface FROM extracted WHERE type = 'MANUFACTURER'",
    "sided": "SELECT surface, name, CASE WHEN length(surface) <= length(name) THEN surface ELSE lower(name) END AS s, CASE WHEN length(surface) <= length(name) THEN lower(name) ELSE surface END AS l FROM told, manufacturers UNION SELECT surface, name, lower(name), surface FROM told, manufacturers WHERE length(surface) = length(name)",
    "cuts": "SELECT DISTINCT surface, name, s, substr(l, greatest(k, 0)::INT + 1, (k + length(s) - greatest(k, 0))::INT) AS w FROM (SELECT *, unnest(range(1 - length(s), length(l))) AS k FROM sided)",
    "sequences": """SELECT s, w, 0 AS i, list_transform(range(length(s) + 1), lambda j: 0::BIGINT) AS best FROM (SELECT DISTINCT s, w FROM cuts)
        UNION ALL SELECT s, w, i + 1, [0::BIGINT] || list_transform(range(1, length(s) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda m: greatest(best[m + 1], best[m] + CASE WHEN substr(s, m::INT, 1) = substr(w, i + 1, 1) THEN 1 ELSE 0 END)))) FROM sequences WHERE i < length(w)""",
    "ratios": "SELECT surface, name, max(200.0::DOUBLE * best[length(s) + 1] / (length(s) + length(w))) AS score FROM cuts JOIN sequences USING (s, w) WHERE i = length(w) GROUP BY 1, 2",
    "fuzzy": "SELECT surface, name, score, row_number() OVER (PARTITION BY surface ORDER BY score DESC, name)::INT AS rank FROM ratios",
    "sold": "SELECT DISTINCT manufacturer AS maker, code FROM stock WHERE manufacturer <> ''",
    "tokens": "SELECT DISTINCT article_id, mpn FROM (SELECT article_id, unnest(regexp_extract_all(upper(concat_ws(' ', title, body)), '\\b[A-Z0-9]{3,}[A-Z0-9\\-/_]{2,}\\b')) AS mpn FROM {articles}) JOIN parts USING (mpn)",
    "base0": f"""SELECT article_id, {linked_as('MANUFACTURER', 'f.name', 'f.name', 'f.score / 100.0::DOUBLE', "'fuzzy_manufacturer'", 'surface')} FROM extracted e JOIN fuzzy f USING (surface) WHERE e.type = 'MANUFACTURER' AND f.rank = 1 AND f.score >= 75
        UNION ALL SELECT article_id, {linked_as('SUPPLIER', 'k.code', 'k.code', 'least(0.9, f.score / 100.0::DOUBLE)', "'manufacturer_supplier_map'", 'surface')} FROM extracted e JOIN fuzzy f USING (surface) JOIN (SELECT maker, code, row_number() OVER (PARTITION BY maker ORDER BY code) AS r FROM sold) k ON k.maker = f.name AND k.r <= 3 WHERE e.type = 'MANUFACTURER' AND f.rank = 1 AND f.score >= 75
        UNION ALL SELECT article_id, {linked_as('SUPPLIER', 'upper(surface)', 'upper(surface)', '1.0', "'exact_supplier_code'", 'surface')} FROM extracted e WHERE e.type = 'SUPPLIER' AND upper(surface) IN (SELECT code FROM active)
        UNION ALL SELECT article_id, {linked_as('LOCATION', 'surface', 'e.canonical', '0.8', "'keyword_location'", 'surface')} FROM extracted e WHERE e.type = 'LOCATION'
        UNION ALL SELECT article_id, {linked_as('COMPONENT', 'mpn', 'mpn', '1.0', "'exact_mpn'", 'mpn')} FROM tokens""",
    "base1": best_links("base0", "article_id"),
    "asets": "SELECT article_id, md5(string_agg(concat_ws('|', type, canonical, name, score, method, surface), ',' ORDER BY type, canonical)) AS set_id FROM base1 GROUP BY 1",
    "sets": "SELECT set_id, type, canonical, name, score, method, surface, review FROM base1 JOIN (SELECT set_id, min(article_id) AS article_id FROM asets GROUP BY 1) USING (article_id)",
    "near": "SELECT set_id, a.code, a.name, min(s.name) AS place FROM sets s JOIN active a ON contains(lower(s.name), lower(a.country)) OR contains(lower(a.country), lower(s.name)) WHERE s.type = 'LOCATION' GROUP BY 1, 2, 3",
    "near_made": "SELECT set_id, m.name AS maker, min(s.name) AS place FROM sets s JOIN manufacturers m ON contains(lower(s.name), lower(m.country)) OR contains(lower(m.country), lower(s.name)) WHERE s.type = 'LOCATION' GROUP BY 1, 2",
    "set1": f"""SELECT * FROM sets UNION ALL SELECT set_id, {linked_as('SUPPLIER', 'code', 'near.name', '0.6', "'location_supplier_map'", 'place', 'true')} FROM near UNION ALL SELECT set_id, {linked_as('MANUFACTURER', 'maker', 'maker', '0.58', "'location_manufacturer_map'", 'place', 'true')} FROM near_made""",
    "set2": f"""SELECT * FROM set1 UNION ALL SELECT set_id, {linked_as('MANUFACTURER', 'maker', 'maker', '0.62', "'supplier_manufacturer_map'", 'min(code)', 'true')} FROM (SELECT DISTINCT set_id, canonical AS code FROM set1 WHERE type = 'SUPPLIER') JOIN sold USING (code) GROUP BY set_id, maker""",
    "set3": best_links("set2", "set_id"),
    "catalog": "SELECT * FROM (SELECT 'SUPPLIER' AS type, code AS canonical, mpn FROM stock UNION SELECT 'MANUFACTURER', manufacturer, mpn FROM parts WHERE manufacturer <> '') QUALIFY row_number() OVER (PARTITION BY type, canonical ORDER BY mpn) <= 100",
    "inferred0": "SELECT set_id, mpn, min({'late': type = 'MANUFACTURER', 'holder': canonical}) AS h FROM set3 JOIN catalog USING (type, canonical) GROUP BY 1, 2",
    "inferred": "SELECT * FROM inferred0 QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY mpn) <= 100",
    "set4": f"""SELECT * FROM set3 UNION ALL SELECT set_id, {linked_as('COMPONENT', 'mpn', 'mpn', 'CASE WHEN h.late THEN 0.60 ELSE 0.62 END', "CASE WHEN h.late THEN 'manufacturer_catalog_map' ELSE 'supplier_inventory_map' END", 'h.holder', 'true')} FROM inferred""",
    "set_links": best_links("set4", "set_id"),
    "set_totals": "SELECT set_id, count(*)::INT AS n_links, max(score) AS link_score, max(risk) FILTER (risk > 0) AS supplier_risk FROM set_links LEFT JOIN distributors ON type = 'SUPPLIER' AND code = canonical GROUP BY 1",
    "linked": """SELECT s.*, coalesce(n.n, 0)::INT AS n_mentions, coalesce(n.c, 0)::DOUBLE AS mention_confidence, coalesce(k.n_links, 0)::INT AS n_links, coalesce(k.link_score, 0)::DOUBLE AS link_score, k.supplier_risk FROM scored s
        LEFT JOIN (SELECT article_id, count(*) AS n, sum(round(confidence * 100)::BIGINT) / (count(*) * 100.0::DOUBLE) AS c FROM extracted GROUP BY 1) n USING (article_id) LEFT JOIN (SELECT * FROM asets JOIN set_totals USING (set_id)) k USING (article_id) WHERE exact >= least""",
    "ruled": "SELECT article_id, first(category ORDER BY conf DESC, rank) AS category, first(kind ORDER BY conf DESC, rank) AS kind, max(conf) AS conf FROM ("
    + " UNION ALL ".join(f"SELECT article_id, {n} AS rank, {q(c)} AS category, {q(k)} AS kind, CASE WHEN {hits('text', w)} >= 2 THEN {min(f + 0.05, 1.0)!r} ELSE {f!r} END::DOUBLE AS conf FROM linked WHERE {hits('text', w)} >= 1" for n, (c, k, w, f) in enumerate(L.RULES))
    + " UNION ALL SELECT article_id, 50, 'financial_distress', 'credit_downgrade', CASE WHEN n_links > 0 THEN 0.80 ELSE 0.72 END::DOUBLE FROM linked WHERE provider = 'marketaux' AND sentiment <= -0.2) GROUP BY 1",
    "classified": f"""SELECT l.*, coalesce({case('gdacs_type', {k: v[0] for k, v in L.GDACS.items()}, None).replace('None', 'NULL')}, r.category, 'other') AS event_category, coalesce({case('gdacs_type', {k: v[1] for k, v in L.GDACS.items()}, None).replace('None', 'NULL')}, r.kind, 'unclassified') AS event_type,
        round_even(coalesce({case('gdacs_type', {k: v[2] for k, v in L.GDACS.items()}, None).replace('None', 'NULL')}::DOUBLE, CASE WHEN r.conf IS NOT NULL THEN least(1.0, r.conf + least(0.15, CASE WHEN n_links >= 6 THEN 0.15 WHEN n_links >= 3 THEN 0.10 WHEN n_links >= 1 THEN 0.05 ELSE 0 END + CASE WHEN n_mentions >= 3 THEN 0.05 ELSE 0 END)) END,
            CASE WHEN score >= 0.5 OR n_links + n_mentions >= 2 THEN CASE WHEN n_links + n_mentions >= 3 THEN 0.55 WHEN n_links + n_mentions >= 1 THEN 0.50 ELSE 0.45 END ELSE 0.25 END)::DOUBLE, 6) AS class_confidence
        FROM linked l LEFT JOIN ruled r USING (article_id)""",
    "based": f"""SELECT *, place AS loc, CASE WHEN provider = 'gdacs' THEN greatest(level, coalesce(least(100, magnitude * 12), level))
        WHEN event_category = 'financial_distress' THEN CASE WHEN n_links >= 2 THEN least(100, money + 10) ELSE money END
        WHEN event_category = 'natural_disaster' THEN CASE WHEN place > 0 THEN least(100, nature + place * 15) ELSE nature END
        WHEN event_category IN ('factory_shutdown', 'logistics_disruption', 'labor_action') THEN CASE WHEN urgent THEN least(100, work2 + 5) ELSE work2 END
        WHEN event_category = 'export_sanction' THEN CASE WHEN n_links >= 3 THEN least(100, trade + 10) ELSE trade END ELSE 30 END::DOUBLE AS b0
        FROM (SELECT *, CASE WHEN n_links >= 5 THEN least(100, work1 + 15) WHEN n_links >= 2 THEN least(100, work1 + 8) ELSE work1 END AS work2
        FROM (SELECT *, CASE WHEN event_category = 'logistics_disruption' AND place > 0 THEN least(100, work0 + place * 20) ELSE work0 END AS work1
        FROM (SELECT *, {case("lower(coalesce(alert_level, ''))", L.ALERT_LEVELS, 30.0)}::DOUBLE AS level, {best('text', L.LOCATIONS)} AS place, CASE WHEN {best('text', L.INTENSITY)} > 0 THEN 55 + {best('text', L.INTENSITY)} * 30 ELSE 55 END::DOUBLE AS work0,
            CASE WHEN sentiment IS NOT NULL THEN least(100, 40 + abs(sentiment) * 60) WHEN {hits('text', ['bankruptcy', 'default', 'crisis'])} > 0 THEN 75 ELSE 30 END::DOUBLE AS money,
            coalesce(least(100, try_cast(regexp_extract(text, 'magnitude\\s*([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) * 12), 30)::DOUBLE AS nature, {hits('text', L.URGENT)} > 0 AS urgent,
            (CASE WHEN {hits('text', ['ban', 'embargo', 'restrict', 'comprehensive'])} > 0 THEN 72 ELSE 60 END + CASE WHEN {hits('text', ['comprehensive', 'all', 'entire', 'full'])} > 0 THEN 10 ELSE 0 END)::DOUBLE AS trade FROM classified)))""",
    "based1": f"""SELECT b.*, round_even(b0, 1) AS base_severity, greatest(place, CASE WHEN geo_country IS NOT NULL THEN 0.55 ELSE 0 END::DOUBLE) * 100.0 AS geo_score, coalesce(c.metric * 100.0, {case('event_category', L.MARKET, 35.0)}::DOUBLE) AS market_score FROM based b LEFT JOIN coords c USING (article_id)""",
    "factors": f"SELECT *, {factored('0::DOUBLE')} FROM based1",
    "severe": f"SELECT *, {TOTAL} AS severity, {top_three('f', ',')} AS top_factors, {top_three('f || $$ ($$ || printf($$%.1f$$, c) || $$)$$', ', ')} AS driven FROM factors",
    "acted": f"""SELECT *, CASE WHEN {hits('text', L.SIGNALS)} > 0 THEN true WHEN event_category <> 'other' AND class_confidence >= 0.6 THEN true WHEN provider = 'gdacs' THEN true WHEN upper(category) IN ({items(L.QUIET_CATEGORIES)[1:-1]}) OR starts_with(upper(event_code), 'CO') THEN false
        WHEN contains(upper(subcategory), 'MILESTONE') OR contains(upper(subcategory), 'DEVELOPMENT') THEN false WHEN significance < 0.4 AND event_category = 'other' THEN false WHEN severity >= 55 THEN true WHEN n_links > 0 AND event_category <> 'other' THEN true ELSE false END AS actionable FROM severe""",
    "risk": f"""SELECT event_id, {items(D.CATEGORIES)}[event_id % 7 + user_id % 4 + 1] AS event_category, event_type, 'Event ' || (user_id % 40) || ' of ' || event_type AS title, 'Summary of ' || event_type || ' ' || k AS summary, least(100, floor(value))::DOUBLE AS severity,
        (k % 50) / 50.0::DOUBLE AS class_confidence, (k % 20) / 20.0::DOUBLE AS confidence, (user_id % 10) / 10.0::DOUBLE AS verification, (user_id % 4 + 1)::INT AS source_count, (k % 6)::INT AS n_components, {SUP.format('user_id % 10')} AS supplier_code, 'NATION_' || (user_id % 25) AS geo_country,
        CASE WHEN user_id % 3 <> 0 THEN (user_id % 90)::DOUBLE END AS latitude, CASE WHEN user_id % 3 <> 0 THEN (user_id % 180)::DOUBLE END AS longitude, {items(D.STATUSES)}[event_id % 4 + 1] AS status, strftime(ts, '%Y-%m-%d') AS run_id, ts AS retrieved_at FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events)""",
    "identified": f"SELECT *, sha256({NORM.format('title')} || '|' || coalesce(nullif(event_category, ''), 'other') || '|' || {NORM.format('geo_country')}) AS fingerprint FROM risk",
    "kept_rows": "SELECT fingerprint, first(event_id ORDER BY severity DESC, retrieved_at DESC, event_id) AS keep_id, max(severity) AS severity, count(*) - 1 AS n_duplicates FROM identified GROUP BY 1",
    "leads": "SELECT code AS supplier_code, round_even(sum(lead_time_days) / count(lead_time_days)::DOUBLE, 1) AS avg_lead FROM stock GROUP BY 1",
    "alerted": "SELECT event_id, severity, rule_id, rule_name FROM risk JOIN (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else q(v) for v in r) + ")" for r in L.ALERTS) + ") r(rule_id, rule_name, ms, mc, mv, mk) ON (ms IS NULL OR severity >= ms) AND (mc IS NULL OR source_count >= mc) AND (mv IS NULL OR verification >= mv) AND (mk IS NULL OR event_category = mk)",
    "confident": f"SELECT *, {OVERALL} AS overall_confidence, {DOUBTS} AS uncertainties FROM (SELECT *, {TIER} AS source_weight, 1 AS n_sources, 0::DOUBLE AS verification FROM severe)",
    "reviewed": f"SELECT article_id, unnest({REASONS}) AS reason FROM confident",
    "titled": "SELECT title, min(article_id) AS ordinal, list_distinct(list_filter(regexp_split_to_array(lower(trim(title)), '\\s+'), lambda x: x <> '')) AS w FROM articles GROUP BY title",
    "pairs0": f"""SELECT a.title AS a, a.ordinal AS oa, b.title AS b, b.ordinal AS ob, lower(trim(a.title)) = lower(trim(b.title)) AS same, len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w))::DOUBLE AS j,
        list_filter(a.w, lambda x: NOT list_contains({items(L.STOP_WORDS)}, x)) AS ca, list_filter(b.w, lambda x: NOT list_contains({items(L.STOP_WORDS)}, x)) AS cb FROM titled a JOIN titled b ON a.ordinal < b.ordinal AND list_has_any(a.w, b.w)""",
    "pairs": "SELECT * FROM (SELECT *, CASE WHEN same THEN 1 ELSE 0.3 * j + 0.7 * CASE WHEN len(ca) > 0 AND len(cb) > 0 THEN len(list_intersect(ca, cb)) / len(list_distinct(ca || cb))::DOUBLE ELSE j END END AS similarity FROM pairs0) WHERE similarity >= 0.75",
    "parents": "SELECT t.title, coalesce(p.a, t.title) AS parent FROM titled t LEFT JOIN (SELECT b, first(a ORDER BY similarity DESC, oa) AS a FROM pairs GROUP BY b) p ON p.b = t.title",
    "chain": "SELECT title, parent AS root FROM parents UNION SELECT c.title, p.parent FROM chain c JOIN parents p ON p.title = c.root WHERE p.parent <> c.root",
    "clusters": "SELECT c.title, c.root FROM chain c JOIN parents p ON p.title = c.root AND p.parent = c.root",
    "crows": "SELECT a.*, c.root FROM acted a JOIN clusters c USING (title) WHERE actionable",
    "clinks0": "SELECT root, s.type, s.canonical, s.name, s.score, s.method, s.surface, s.review FROM (SELECT DISTINCT root, set_id FROM crows JOIN asets USING (article_id)) JOIN set_links s USING (set_id)",
    "clinks": best_links("clinks0", "root"),
    "ctotals": "SELECT root, count(*)::INT AS n_links, max(score) AS link_score, max(risk) FILTER (risk > 0) AS supplier_risk FROM clinks LEFT JOIN distributors ON type = 'SUPPLIER' AND code = canonical GROUP BY 1",
    "cgroups": f"""SELECT root, count(*) AS source_count, count(DISTINCT provider) AS n_providers, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers, {MEAN} AS source_weight, sum(n_mentions)::BIGINT AS n_mentions, coalesce(sum(round(mention_confidence * n_mentions * 100)::BIGINT) / nullif(sum(n_mentions) * 100.0::DOUBLE, 0), 0)::DOUBLE AS mention_confidence,
        round_even(least(1, least(1, 0.35 + 0.25::DOUBLE * count(DISTINCT provider)) * least(1, {MEAN})), 3) AS verification, coalesce(string_agg(DISTINCT url, ',' ORDER BY url), '') AS urls FROM crows GROUP BY 1""",
    "creasons": f"SELECT root, list_sort(list_distinct(flatten(list({REASONS})))) AS reasons FROM crows GROUP BY 1",
    "cprimary": "SELECT root, article_id AS primary_id, title, event_category, provider, class_confidence, base_severity, geo_score, market_score FROM crows QUALIFY row_number() OVER (PARTITION BY root ORDER BY severity DESC, class_confidence DESC, article_id) = 1",
    "cevents0": "SELECT *, source_count AS n_sources FROM cgroups JOIN cprimary USING (root) JOIN creasons USING (root) LEFT JOIN ctotals USING (root)",
    "cevents1": f"SELECT * EXCLUDE (n_links, link_score), coalesce(n_links, 0)::INT AS n_links, coalesce(link_score, 0)::DOUBLE AS link_score FROM cevents0",
    "cevents": f"SELECT *, {TOTAL} AS severity FROM (SELECT *, {factored('CASE WHEN source_count <= 1 THEN verification * 50.0::DOUBLE ELSE greatest(0, least(100, 50.0::DOUBLE + verification * 50.0::DOUBLE + (source_count - 1) * 10.0::DOUBLE)) END')} FROM cevents1)",
    "cnested": "SELECT root, " + ", ".join(f"coalesce(string_agg(canonical || '|' || method, ',' ORDER BY canonical) FILTER (type = '{v}'), '') AS {k}" for k, v in KINDS) + " FROM clinks GROUP BY 1",
    "s_linked": f"""SELECT root, CASE type WHEN 'COMPONENT' THEN 'components' WHEN 'SUPPLIER' THEN 'distributors' WHEN 'MANUFACTURER' THEN 'manufacturers' ELSE 'locations' END AS section, 1 AS part, 0 AS place,
        CASE type WHEN 'COMPONENT' THEN 'MPN:' WHEN 'SUPPLIER' THEN '' WHEN 'MANUFACTURER' THEN 'MFR:' ELSE 'LOC:' END || canonical AS id, CASE WHEN type = 'COMPONENT' THEN name ELSE {titled_case('name')} END AS name FROM clinks""",
    "s_stored": "SELECT root, section, 0 AS part, place, id, name FROM cgroups, (VALUES ('manufacturers', 0, 'MFR:Old', 'Old maker'), ('manufacturers', 1, NULL, 'brand#3'), ('components', 0, 'mpn:MPN000007', 'MPN000007'), ('components', 1, 'MPN:MPN000009', 'Own name')) v(section, place, id, name) WHERE length(root) % 3 = 0",
    "s_chosen": "SELECT * FROM s_stored UNION ALL SELECT * FROM s_linked l WHERE NOT EXISTS (SELECT 1 FROM s_stored s WHERE s.root = l.root AND s.section = l.section)",
    "s_shown": "SELECT * FROM s_chosen WHERE section <> 'components' AND part = 0 UNION ALL SELECT * FROM s_chosen WHERE section <> 'components' AND part = 1 QUALIFY row_number() OVER (PARTITION BY root, section, lower(name) ORDER BY place, id, name) = 1",
    "s_told": "SELECT root, 'affected_manufacturers' AS section, 2 AS part, place, 'ai_mfr:' || lower(name) AS id, name FROM cgroups, (VALUES (0, 'Brand#1'), (1, 'Samsung'), (2, 'Brand#2')) v(place, name) WHERE length(root) % 2 = 0 AND length(root) % 5 <> 0",
    "s_affected": "SELECT * FROM (SELECT root, 'affected_manufacturers' AS section, 1 AS part, place, coalesce(id, 'name:' || lower(name)) AS id, name FROM s_shown WHERE section = 'manufacturers' UNION ALL SELECT * FROM s_told) QUALIFY row_number() OVER (PARTITION BY root, lower(name) ORDER BY part, place, id, name) = 1",
    "s_parts": """SELECT root, section, part, place, 'MPN:' || c.mpn AS id, CASE WHEN part = 0 AND lower(name) <> lower(c.mpn) THEN name ELSE coalesce(p.description, c.mpn) END AS name FROM (SELECT *, regexp_replace(id, '^(mpn|MPN):', '') AS mpn FROM s_chosen WHERE section = 'components') c
        LEFT JOIN (SELECT mpn, min(nullif(trim(description), '')) AS description FROM parts GROUP BY 1) p ON p.mpn = c.mpn""",
    "s_all": "SELECT * FROM s_shown UNION ALL SELECT * FROM s_affected UNION ALL SELECT * FROM s_parts",
    "b_base0": f"""SELECT event_id AS article_id, {linked_as('LOCATION', 'lower(geo_country)', 'geo_country', '0.8', "'keyword_location'", 'lower(geo_country)')} FROM risk WHERE status <> 'detected'
        UNION ALL SELECT event_id, {linked_as('SUPPLIER', 'supplier_code', 'supplier_code', '1.0', "'exact_supplier_code'", 'supplier_code')} FROM risk WHERE status <> 'detected' AND supplier_code IN (SELECT code FROM active)""",
}
#: The steps from base links to all links of their sets, once more for the links of stored events.
CHAIN = ["base0", "base1", "asets", "sets", "near", "near_made", "set1", "set2", "set3", "inferred0", "inferred", "set4", "set_links"]
CTES |= {f"b_{n}": re.sub(rf"\b({'|'.join(CHAIN)})\b", r"b_\1", CTES[n]) for n in CHAIN[1:]}


SECTIONS = ("components", "distributors", "manufacturers", "affected_manufacturers", "locations")
RECURSIVE = ("sequences", "chain")


def _sql(body: str, articles: str = "articles") -> str:
    """body with the CTEs that it and they name, each computed once; CTES lists each after those it names."""
    found, open_ = set(), [body]
    while open_:
        for word in re.findall(r"\b[a-z][a-z_0-9]*\b", re.sub(r"'[^']*'", "", open_.pop().replace("{articles}", articles))):
            if word in CTES and word not in found:
                found.add(word)
                open_.append(CTES[word])
    kept = lambda n: " AS (" if n in RECURSIVE else " AS MATERIALIZED ("
    parts = ", ".join(f"{n}{kept(n)}{sql.replace('{articles}', articles)})" for n, sql in CTES.items() if n in found)
    return f"WITH RECURSIVE {parts} {body}" if parts else body


_prior = lambda k: case("event_category", {c: v[k] for c, v in L.BASELINES.items()}, L.DEFAULT_BASELINE[k])
_clamp = lambda x: f"greatest(0, least(1, round_even(round(({x}) * 1e9) / 1e6, 0) / 1000))"
_P = [_clamp(f"{_prior(k)}::DOUBLE * (0.55 + severity / 100.0 * 0.55::DOUBLE)") for k in range(5)]

BODIES = {
    "suppliers": "SELECT * FROM active",
    "manufacturers": "SELECT * FROM manufacturers",
    "parts": "SELECT * FROM parts",
    "inventory": "SELECT * FROM stock",
    "categories": "SELECT DISTINCT category FROM parts",
    "registry_suppliers": "SELECT a.code, a.name, a.country, coalesce(m, '') AS manufacturers, coalesce(c, '') AS categories, coalesce(n, 0)::INT AS n_mpns FROM active a LEFT JOIN (SELECT code, string_agg(DISTINCT manufacturer, ',' ORDER BY manufacturer) AS m, string_agg(DISTINCT category, ',' ORDER BY category) AS c, count(DISTINCT mpn) AS n FROM stock GROUP BY 1) s ON s.code = a.code",
    "registry_manufacturers": "SELECT name AS manufacturer, country, least(500, coalesce(n, 0))::INT AS n_mpns, coalesce(f, '') AS first_mpn, coalesce(s, '') AS suppliers FROM manufacturers m LEFT JOIN (SELECT manufacturer, count(DISTINCT mpn) AS n, min(mpn) AS f FROM parts GROUP BY 1) p ON p.manufacturer = m.name LEFT JOIN (SELECT manufacturer, string_agg(DISTINCT code, ',' ORDER BY code) AS s FROM stock GROUP BY 1) k ON k.manufacturer = m.name",
    "registry_components": "SELECT p.mpn, p.manufacturer, p.category, coalesce(s.code, '') AS supplier FROM parts p LEFT JOIN (SELECT mpn, first(code ORDER BY ordinal, code) AS code FROM stock GROUP BY 1) s ON s.mpn = p.mpn",
    "registry_stats": "SELECT (SELECT count(*) FROM active) AS suppliers, (SELECT count(*) FROM manufacturers) AS manufacturers, (SELECT count(*) FROM parts) AS components",
    "countries": "SELECT * FROM countries",
    "union_sources": "SELECT 'documents' AS source, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents UNION ALL SELECT 'conversations', count(*), sum(length(text))::BIGINT FROM conversations UNION ALL SELECT 'pages', count(*), sum(length(html))::BIGINT FROM pages",
    "ingest_report": "SELECT provider, tier, count(*) AS n, min(article_id) AS first_id FROM articles GROUP BY 1, 2",
    "relevance": "SELECT article_id, provider, score, matched, manufacturers_found, reason FROM scored",
    "kept": "SELECT article_id, provider, score, least FROM scored WHERE exact >= least",
    "dropped": "SELECT article_id, provider, score, least, reason FROM scored WHERE exact < least",
    "by_provider": "SELECT provider, count(*) FILTER (exact >= least) AS kept, count(*) FILTER (exact < least) AS dropped FROM scored GROUP BY 1",
    "mentions": "SELECT article_id, canonical, type, span_start, span_end FROM mentions",
    "extraction_metrics": "SELECT sum(coalesce(n, 0))::BIGINT AS mentions, count(*) FILTER (n > 0) AS with_mentions, round_even(sum(coalesce(n, 0)) / count(*)::DOUBLE, 4) AS per_article, round_even(avg(c), 4) AS mean_confidence FROM articles LEFT JOIN (SELECT article_id, count(*) AS n, avg(confidence) AS c FROM extracted GROUP BY 1) USING (article_id)",
    "metadata_geo": "SELECT source, label, count(*) AS n FROM places GROUP BY 1, 2",
    "metadata_mentions": "SELECT article_id, label, source, ordinal, 0.92::DOUBLE AS confidence FROM places",
    "coordinates": "SELECT article_id, latitude, longitude, country, region, metric FROM coords",
    "extracted": "SELECT article_id, surface AS text, type, canonical, confidence FROM extracted",
    "fuzzy_manufacturers": "SELECT surface AS text, name, round_even(score, 6) AS score, rank FROM fuzzy WHERE rank <= 5 AND score >= 75",
    "link_candidates": "SELECT surface AS text, name, round_even(score, 6) AS score, rank FROM fuzzy WHERE rank <= 5 AND score >= 60",
    "expanded_links": "SELECT article_id, type, method, count(*) AS n, min(canonical) AS first, max(canonical) AS last, min(surface) AS text, round_even(max(score), 6) AS score, count(*) FILTER (review) AS n_review FROM asets JOIN set_links USING (set_id) GROUP BY 1, 2, 3",
    "cluster_modes": "SELECT root, sum(n)::BIGINT AS n, first(event_category ORDER BY n DESC, f) AS mode FROM (SELECT root, event_category, count(*) AS n, min(article_id) AS f FROM classified JOIN clusters USING (title) GROUP BY 1, 2) GROUP BY 1",
    "supplier_links": "SELECT article_id, canonical, code, 0.9::DOUBLE AS score FROM mentions JOIN sold s ON s.maker = canonical WHERE type = 'MANUFACTURER'",
    "mpn_links": "SELECT article_id, mpn FROM tokens",
    "location_suppliers": "SELECT DISTINCT n_name AS location, code FROM nation JOIN active ON contains(lower(n_name), lower(country)) OR contains(lower(country), lower(n_name))",
    "location_manufacturers": "SELECT DISTINCT n_name AS location, name FROM nation JOIN manufacturers ON contains(lower(n_name), lower(country)) OR contains(lower(country), lower(n_name))",
    "supplier_manufacturers": "SELECT DISTINCT code, manufacturer FROM stock",
    "components_capped": "SELECT code, count(*) AS n, min(mpn) AS first_mpn, max(mpn) AS last_mpn FROM (SELECT code, mpn, row_number() OVER (PARTITION BY code ORDER BY mpn) AS r FROM (SELECT DISTINCT code, mpn FROM stock)) WHERE r <= 100 GROUP BY 1",
    "classified": "SELECT article_id, event_category, event_type, class_confidence FROM classified",
    "class_distribution": "SELECT event_category, count(*) AS n, round_even(avg(class_confidence), 3) AS mean_confidence FROM classified GROUP BY 1",
    "base_severity": "SELECT article_id, base_severity FROM severe",
    "severity": "SELECT article_id, severity, top_factors, 'Severity ' || severity || '/100 driven by: ' || driven AS severity_summary, " + ", ".join(f"c_{k}" for k in L.WEIGHTS) + " FROM severe",
    "severity_metrics": "SELECT count(*) AS n, round_even(avg(severity), 2) AS mean_severity, count(*) FILTER (severity >= 70) AS n_high FROM severe",
    "title_pairs": "SELECT a, b, round_even(similarity, 6) AS similarity FROM pairs",
    "clusters": "SELECT * FROM clusters",
    "cluster_stats": "SELECT count(*) AS n_clusters, round_even(avg(n), 3) AS mean_size, max(n) AS max_size FROM (SELECT root, count(*) AS n FROM articles JOIN clusters USING (title) GROUP BY 1)",
    "actionable": "SELECT article_id, actionable FROM acted",
    "merged": "SELECT root, source_count, primary_id, title, event_category, severity, n_providers, providers, verification, n_links, round_even(link_score, 6) AS link_score, " + OVERALL + " AS overall_confidence, " + DOUBTS + """ AS uncertainties,
        array_to_string(CASE WHEN source_count >= 2 AND verification >= 0.6 THEN list_filter(reasons, lambda r: r <> 'low_classification_confidence') ELSE reasons END, ',') AS review_reasons, urls, coalesce(suppliers, '') AS suppliers, coalesce(manufacturers, '') AS manufacturers, coalesce(components, '') AS components, coalesce(locations, '') AS locations FROM cevents LEFT JOIN cnested USING (root)""",
    "verification": f"SELECT title, round_even(least(1, least(1, 0.35 + 0.25::DOUBLE * count(DISTINCT provider)) * least(1, {MEAN})), 3) AS verification FROM articles GROUP BY title",
    "confidence": "SELECT article_id, overall_confidence, uncertainties FROM confident",
    "review": "SELECT article_id, string_agg(reason, ',' ORDER BY CASE reason WHEN 'low_classification_confidence' THEN 0 WHEN 'low_entity_link_confidence' THEN 1 WHEN 'no_entities_for_event_type' THEN 2 WHEN 'high_severity_low_confidence_mismatch' THEN 3 ELSE 4 END) AS reasons FROM reviewed GROUP BY 1",
    "review_histogram": "SELECT reason, count(*) AS n FROM reviewed GROUP BY 1",
    "fingerprints": f"SELECT doc_id, sha256({NORM.format('text')} || '|other|' || {NORM.format('source')}) AS fingerprint FROM documents",
    "stable_ids": "SELECT event_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || ['8', '9', 'a', 'b'][(strpos('0123456789abcdef', substr(d, 17, 1)) - 1) % 4 + 1] || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS stable_id FROM (SELECT event_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || fingerprint::BLOB) AS d FROM identified)",
    "identity": "SELECT b.event_id, b.fingerprint, coalesce(known_id, min(b.event_id) OVER (PARTITION BY b.fingerprint)) AS resolved_id, CASE WHEN known_id IS NOT NULL OR row_number() OVER (PARTITION BY b.fingerprint ORDER BY b.event_id) > 1 THEN 'updated' ELSE 'detected' END AS new_status FROM identified b LEFT JOIN (SELECT fingerprint, min(event_id) AS known_id FROM identified WHERE verification >= 0.5 GROUP BY 1) k USING (fingerprint) WHERE b.verification < 0.5",
    "keepers": "SELECT * FROM kept_rows",
    "reparented": "SELECT event_id + 1000000 AS child_id, keep_id AS event_id FROM identified JOIN kept_rows USING (fingerprint)",
    "upsert": "SELECT event_id, severity + CASE WHEN verification >= 0.5 THEN 1 ELSE 0 END AS severity, CASE WHEN verification >= 0.5 THEN 'updated' ELSE status END AS status, run_id FROM risk",
    "event_results": """SELECT event_id, CASE WHEN severity >= 50 AND confidence >= 0.5 AND event_id % 3 <> 0 THEN 'again ' || event_category ELSE 'first' END AS result, run_id
        FROM risk WHERE status = 'detected' OR (severity >= 50 AND confidence >= 0.5 AND event_id % 3 <> 0)""",
    "event_articles": """SELECT event_id, article_id, r.p AS provider, r.s AS severity FROM (SELECT event_id % 500 AS event_id, supplier_code AS article_id,
        coalesce(min({'p': event_type, 's': severity}) FILTER (verification >= 0.5), min({'p': event_type, 's': severity})) AS r FROM risk GROUP BY ALL)""",
    "status_history": """SELECT event_id, status, run_id, CASE status WHEN 'updated' THEN 'updated' ELSE 'persisted' END AS action FROM
        (SELECT * FROM risk WHERE verification >= 0.5 UNION ALL SELECT * FROM risk)""",
    "alerts": "SELECT * FROM alerted",
    "gate": "SELECT CASE WHEN severity < 50 THEN 'severity_below_threshold' WHEN confidence < 0.5 THEN 'confidence_below_threshold' ELSE 'eligible' END AS reason, count(*) AS n FROM risk GROUP BY 1",
    "budget": "SELECT event_id, severity, severity >= 65 OR row_number() OVER (PARTITION BY severity >= 65 ORDER BY severity DESC, event_id) <= 10 AS selected FROM risk WHERE severity >= 50 AND confidence >= 0.5",
    "impact": f"""SELECT event_id, {_P[0]} AS supply_delay, {_P[1]} AS manufacturing, CASE WHEN source_count >= 2 THEN {_clamp(f'{_P[2]} + least(0.05, 0.02::DOUBLE * (source_count - 1))')} ELSE {_P[2]} END AS logistics, CASE WHEN n_components >= 3 THEN {_clamp(f'{_P[3]} + 0.08')} ELSE {_P[3]} END AS inventory, {_P[4]} AS price,
        greatest({_prior(5)}, trunc(lead * 0.5))::INT AS recovery_min, CASE WHEN 0.55 + severity / 100.0 * 0.55::DOUBLE >= 0.95 THEN trunc(greatest({_prior(6)}, lead, {_prior(5)}, trunc(lead * 0.5)) * 1.25) ELSE greatest({_prior(6)}, lead, {_prior(5)}, trunc(lead * 0.5)) END::INT AS recovery_max,
        {_clamp("0.35 + confidence * 0.35::DOUBLE + verification * 0.15::DOUBLE + least(0.15, (6 + CASE WHEN avg_lead IS NOT NULL THEN 1 ELSE 0 END) * 0.02::DOUBLE)")} AS prediction_confidence
        FROM (SELECT *, trunc(coalesce(avg_lead, 21))::INT AS lead FROM risk LEFT JOIN leads USING (supplier_code)) WHERE severity >= 35""",
    "refine": "SELECT event_id, severity FROM risk WHERE severity >= 35 ORDER BY severity DESC, event_id LIMIT 10",
    "adjusted": f"SELECT event_id, {_clamp('greatest(confidence - 0.15, least(confidence + 0.15, verification))')} AS adjusted FROM risk",
    "lead_times": "SELECT * FROM leads",
    "supply_links": "SELECT suppliers, manufacturers, components, locations, sum(n)::BIGINT AS n_articles FROM (SELECT set_id, " + ", ".join(f"coalesce(string_agg(canonical, ',' ORDER BY canonical) FILTER (type = '{v}'), '') AS {k}" for k, v in KINDS) + " FROM set_links GROUP BY 1) JOIN (SELECT set_id, count(*) AS n FROM asets GROUP BY 1) USING (set_id) GROUP BY 1, 2, 3, 4",
    "backfill": """SELECT event_id, r.status = 'detected' AS stored, CASE WHEN r.status = 'detected' THEN (r.supplier_code IN (SELECT code FROM active))::INT ELSE k.s END::BIGINT AS n_suppliers, coalesce(k.m, 0)::BIGINT AS n_manufacturers, coalesce(k.c, 0)::BIGINT AS n_components, coalesce(k.l, 1)::BIGINT AS n_locations,
        CASE WHEN verification >= 0.5 THEN 'analysis ' || r.status ELSE 'none' END AS analysis FROM risk r LEFT JOIN b_asets a ON a.article_id = r.event_id LEFT JOIN (SELECT set_id, count(*) FILTER (type = 'SUPPLIER') AS s, count(*) FILTER (type = 'MANUFACTURER') AS m, count(*) FILTER (type = 'COMPONENT') AS c, count(*) FILTER (type = 'LOCATION') AS l FROM b_set_links GROUP BY 1) k USING (set_id)""",
    "link_sections": "SELECT root, " + ", ".join(f"coalesce(string_agg(concat_ws('=', id, name), ';' ORDER BY part, place, id, name) FILTER (section = '{s}'), '') AS {s}" for s in SECTIONS) + " FROM cgroups LEFT JOIN s_all USING (root) GROUP BY 1",
    "alert_history": "SELECT rule_id, run_id, n, severity, run_id = max(run_id) OVER (PARTITION BY rule_id) AS is_last FROM (SELECT rule_id, run_id, count(*) AS n, max(a.severity) AS severity FROM alerted a JOIN risk USING (event_id) GROUP BY 1, 2)",
    "model_answers": f"""SELECT event_id, o IS NOT NULL AS readable, coalesce(trim(o ->> 'executive_summary'), '') AS executive_summary, coalesce(trim(o ->> 'business_impact'), '') AS business_impact,
        CASE WHEN json_type(o -> 'affected_manufacturers') = 'ARRAY' THEN array_to_string(list_filter(list_transform((o -> 'affected_manufacturers')::JSON[], lambda x: CASE WHEN json_type(x) IN ('NULL', 'OBJECT') THEN '' ELSE trim(x ->> '$') END), lambda x: x <> ''), '|') ELSE '' END AS affected, 0 AS n_actions,
        greatest(0, least(1, coalesce(try_cast(o ->> 'analysis_confidence' AS DOUBLE), 0))) AS analysis_confidence FROM (SELECT event_id, CASE WHEN json_type(j) = 'OBJECT' THEN j END AS o FROM (SELECT event_id, try_cast(c AS JSON) AS j
        FROM (SELECT event_id, trim(regexp_replace(regexp_replace(replace({items(D.ANSWERS)}[event_id % {len(D.ANSWERS)} + 1], '{{N}}', event_id::VARCHAR), '^```json', ''), '```$', ''), e' \\n') AS c FROM risk)))""",
    "snapshot": "SELECT article_id, provider, score, least, reason, title, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published FROM scored JOIN (SELECT event_id AS article_id, ts AS published_at FROM events) USING (article_id) WHERE exact < least",
    "run_audit": """SELECT 'relevance_prefilter' AS stage, unnest(['rows_in', 'rows_out']) AS name, unnest([count(*), count(*) FILTER (exact >= least)]) AS n FROM scored UNION ALL SELECT 'ner_extraction', unnest(['rows_out', 'of_metadata']), unnest([count(*), count(*) FILTER (confidence > 0.85)]) FROM extracted
        UNION ALL SELECT 'severity_estimation', unnest(['rows_out', 'named', 'high', 'actionable']), unnest([count(*), count(*) FILTER (event_category <> 'other'), count(*) FILTER (severity >= 70), count(*) FILTER (actionable)]) FROM acted
        UNION ALL SELECT 'risk_event_creation', unnest(['rows_in', 'rows_out', 'review']), unnest([sum(source_count)::BIGINT, count(*), count(*) FILTER (len(CASE WHEN source_count >= 2 AND verification >= 0.6 THEN list_filter(reasons, lambda r: r <> 'low_classification_confidence') ELSE reasons END) > 0)]) FROM cevents0""",
    "list": "SELECT *, status = 'detected' AS has_analysis, severity >= 35 AS has_prediction FROM (SELECT * EXCLUDE (n_components) FROM risk) WHERE event_category = 'other' AND severity >= 10 AND contains(lower(title || ' ' || summary || ' ' || geo_country || ' ' || event_type), 'of view') ORDER BY severity DESC, event_id LIMIT 50 OFFSET 5",
    "runs": "SELECT coalesce(run_id, 'unknown') AS run_id, count(*) AS n_events, max(severity) AS max_severity FROM risk GROUP BY 1",
    "summary": "SELECT CASE WHEN grouping(event_category) = 0 THEN 'category' WHEN grouping(status) = 0 THEN 'status' ELSE 'all' END AS kind, coalesce(event_category, status, '') AS value, count(*) AS n, round_even(avg(severity), 1) AS avg_severity, max(severity) AS max_severity, count(*) FILTER (status = 'detected') AS with_analysis, count(*) FILTER (severity >= 35) AS with_prediction FROM risk GROUP BY GROUPING SETS ((), (event_category), (status))",
    "geo": "SELECT event_id, title, event_category, severity, latitude, longitude, geo_country FROM risk WHERE severity >= 20 AND latitude IS NOT NULL",
    "alert_feed": "SELECT event_id, title, event_category, severity, status, run_id FROM risk WHERE severity >= 60 ORDER BY severity DESC, event_id LIMIT 200",
    "text_cleanup": f"SELECT doc_id, 'a b c' AS category, CASE WHEN length(trim(text)) > 40 THEN substr(trim(text), 1, 37) || '...' ELSE trim(text) END AS short, trim(regexp_replace(text, '\\s+$', '')) AS summary, doc_id::VARCHAR AS mpn, {NORM.format('text')} AS title FROM documents",
    "alert_sentences": """SELECT article_id, s || CASE WHEN alert_level IS NOT NULL THEN ' GDACS has issued a ' || alert_level || ' alert.' ELSE '' END AS sentence, h || CASE WHEN alert_level IS NOT NULL THEN ' GDACS has issued a ' || alert_level || ' alert.' ELSE '' END AS humanized FROM (SELECT article_id, alert_level,
        CASE WHEN gdacs_type = 'EQ' THEN CASE WHEN size IS NULL THEN 'An earthquake' ELSE 'A magnitude ' || size || ' earthquake' END || ' was detected' || place || CASE WHEN article_id % 3 = 0 THEN ' at a depth of ' || (article_id % 70) || ' km' ELSE '' END ELSE 'A ' || label || ' event was reported' || place || coalesce(' with severity ' || txt, '') END || '.' AS s,
        CASE WHEN gdacs_type = 'EQ' THEN CASE WHEN size IS NULL THEN 'An earthquake' ELSE 'A magnitude ' || size || ' earthquake' END || ' was detected' || place || CASE WHEN article_id % 3 = 0 THEN ' at a depth of ' || (article_id % 70) || ' km' ELSE '' END ELSE 'A ' || label || ' event was reported' || place || coalesce(' with severity ' || txt, '') END || '.' AS h
        FROM (SELECT *, coalesce(' in ' || geo_country, '') AS place, CASE gdacs_type WHEN 'FL' THEN 'flood' WHEN 'TC' THEN 'tropical cyclone' WHEN 'VO' THEN 'volcano' WHEN 'DR' THEN 'drought' WHEN 'WF' THEN 'wildfire' ELSE lower(gdacs_type) END AS label,
        CASE article_id % 3 WHEN 0 THEN (article_id % 9) || '.' || (article_id % 10) WHEN 1 THEN '7.1' END AS size, CASE article_id % 3 WHEN 0 THEN 'Magnitude ' || (article_id % 9) || '.' || (article_id % 10) || 'M, Depth: ' || (article_id % 70) || ' km' WHEN 1 THEN '7.1 strong' END AS txt FROM articles WHERE provider = 'gdacs'))""",
    "labels": "SELECT n_nationkey, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) || ', West Coast' AS label, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS plain, 2 AS n FROM nation",
    "audit": "SELECT count(*) AS rows_in, count(*) FILTER (exact >= least) AS rows_out, round_even(count(*) FILTER (exact >= least) * 100 / count(*)::DOUBLE, 2) AS retention FROM scored",
    "visible": "SELECT event_id, severity FROM risk WHERE severity >= 50 AND latitude IS NOT NULL",
    "uncovered": "SELECT e.type, e.surface AS text, count(*) AS n FROM extracted e WHERE NOT EXISTS (SELECT 1 FROM asets JOIN set_links l USING (set_id) WHERE asets.article_id = e.article_id AND lower(l.surface) = e.surface) GROUP BY 1, 2",
    "linking_rate": "SELECT m.n AS mentions, k.n AS links, round_even(k.n * 100 / m.n::DOUBLE, 2) AS rate FROM (SELECT count(*) AS n FROM extracted) m, (SELECT sum(n)::BIGINT AS n FROM asets JOIN (SELECT set_id, count(*) AS n FROM set_links GROUP BY 1) USING (set_id)) k",
    "exposure": "SELECT canonical AS code, sum(n)::BIGINT AS n_articles, max(severity) AS max_severity FROM (SELECT set_id, count(*) AS n, max(severity) AS severity FROM acted JOIN asets USING (article_id) WHERE actionable GROUP BY 1) JOIN set_links USING (set_id) WHERE type = 'SUPPLIER' GROUP BY 1",
    "tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}

BODIES["detail"] = f"""SELECT event_id, title, summary, severity, geo_country, 'analysis of ' || event_category AS analysis, supply_delay, recovery_max, least(supplier_code, run_id) || '/' || event_type || ',' || greatest(supplier_code, run_id) || '/' || event_type AS articles,
    coalesce((SELECT string_agg(rule_id, ',' ORDER BY rule_id) FROM alerted a WHERE a.event_id = 7), '') AS alerts FROM risk LEFT JOIN ({BODIES['impact']}) i USING (event_id) WHERE event_id = 7"""
ORACLES: dict[str, str] = {name: _sql(body) for name, body in BODIES.items()} | {"relevance_documents": _sql("SELECT article_id, score, reason FROM scored", "doc_articles")}

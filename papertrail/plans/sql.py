"""The SQL that queries are held against."""

from __future__ import annotations

from papertrail import dims
from papertrail.functions.ids import POWERS, PRODUCT
from papertrail.functions.text import STOP_WORDS
from papertrail.lexicon import Lexicon
from papertrail.operators.classify import RULES
from papertrail.plans.adapters import CHECKLIST, ORDERS_TODAY, PHOTOS, STATE, TODAY, VAULT

_CATEGORY = "CASE effective_type " + " ".join(f"WHEN '{t.name}' THEN '{t.category}'" for t in dims.DOC_TYPES) + " END"
_LABEL_OF = "CASE effective_type " + " ".join(f"WHEN '{t.name}' THEN '{t.label}'" for t in dims.DOC_TYPES) + " END"


def _rule(kind: str, words: str) -> str:
    """A rule's pattern without look-around: what may not stand beside a word is consumed, which finds the same texts."""
    if kind == "w":
        return f"(?i)(^|[^a-z])(?:{words})([^a-z]|$)"
    for beside, consumed in (("(?<![a-z])", "(?:^|[^a-z])"), ("(?![a-z])", "(?:[^a-z]|$)"), (r"(?<!\d)", "(?:^|[^0-9])"), (r"(?!\d)", "(?:[^0-9]|$)")):
        words = words.replace(beside, consumed)
    return f"(?i){words}"


def _scores() -> str:
    sums: dict[str, list[str]] = {}
    for name, kind, words, weight in RULES:
        sums.setdefault(name, []).append(f"CASE WHEN regexp_matches(ocr_text, '{_rule(kind, words)}') THEN {weight}::DOUBLE ELSE 0.0::DOUBLE END")
    return "scores AS (SELECT id, unnest([" + ", ".join(f"{{'t': '{t}', 'n': {dims.NAMES.index(t)}, 's': {' + '.join(x)}}}" for t, x in sums.items()) + "]) AS x FROM vault)"


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: length(w) > 1))"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_CATS = "[" + ", ".join(f"'{c}'" for c in dims.PHOTO_CATEGORIES) + "]"
_LABELS = f", labels AS (SELECT label::VARCHAR AS label, label AS ordinal, label < 5 AS is_document, {_CATS}[label % 8 + 1] AS category, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label)"
_STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
_TERMS = rf"""
index_rows AS (
  SELECT id AS chunk_id, id AS doc_id, list_filter(regexp_split_to_array(lower(concat_ws(' ', ocr_text, display_title)), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: w <> '') AS terms
  FROM (SELECT *, CASE WHEN effective_type <> doc_type THEN owner_name ELSE label || ' · ' || owner_name END AS display_title FROM vault)
), lens AS (SELECT chunk_id, doc_id, len(terms) AS len, terms FROM index_rows),
postings AS (SELECT chunk_id, doc_id, len, term AS word, count(*) AS tf FROM (SELECT chunk_id, doc_id, len, unnest(terms) AS term FROM lens) GROUP BY ALL),
wanted AS (
  SELECT query_id, unnest(list_slice(list_filter(words, lambda w, i: list_position(words, w) = i), 1, 16)) AS term
  FROM (SELECT item_id AS query_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: length(w) >= 2 AND w NOT IN {_STOP}) AS words0,
    list_filter(list_distinct_ordered, lambda w: true) AS words FROM (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: length(w) >= 2 AND w NOT IN {_STOP}) AS list_distinct_ordered FROM benchmark))
),
hit AS (
  SELECT query_id, term, chunk_id, doc_id, len, sum(tf)::BIGINT AS tf FROM wanted JOIN postings
    ON (CASE WHEN regexp_matches(term, '^[a-z]{{1,2}}$') THEN word = term ELSE starts_with(word, term) END) GROUP BY ALL
)
"""
_BM25 = """
, stats AS (SELECT count(*) AS n, avg(len) AS mean FROM lens WHERE len > 0),
df AS (SELECT query_id, term, count(*) AS df FROM hit GROUP BY ALL),
chunk_scores AS (
  SELECT query_id, chunk_id, doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score
  FROM hit JOIN df USING (query_id, term), stats GROUP BY ALL
), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS place FROM chunk_scores)
"""


def _ranked(k: int, name: str) -> str:
    return f", {name} AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM (SELECT query_id, doc_id, min(place) AS place, max(score) AS score FROM placed WHERE place <= {4 * k} GROUP BY ALL)) WHERE rank <= {k})"


_HOME = """
, cells AS (SELECT user_id, floor(lat / 0.05) AS y, floor(lon / 0.05) AS x, count(DISTINCT taken_at // 86400000) AS days, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon FROM photos GROUP BY ALL),
home AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY days * 10000 + n DESC, y, x) AS r FROM cells) WHERE r = 1)
"""
_KM = "2 * 6371.0 * asin(least(sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2)), 1.0))"
_TRIPS = (
    PHOTOS
    + _HOME
    + ", away AS (SELECT p.* FROM photos p JOIN home h USING (user_id) JOIN (SELECT user_id FROM photos GROUP BY user_id HAVING count(*) >= 3) USING (user_id) WHERE "
    + _KM.format("p.lat", "p.lon", "h.lat", "h.lon")
    + """ > 40),
gaps AS (SELECT *, coalesce(taken_at - lag(taken_at) OVER (PARTITION BY user_id ORDER BY taken_at, uri) > 129600000, true)::INT AS new FROM away),
numbered AS (SELECT * EXCLUDE (trip_id), sum(new) OVER (PARTITION BY user_id ORDER BY taken_at, uri ROWS UNBOUNDED PRECEDING) AS t FROM gaps),
trip AS (SELECT user_id, uri, taken_at, place, min(taken_at) OVER (PARTITION BY user_id, t) AS trip_id, count(*) OVER (PARTITION BY user_id, t) AS n FROM numbered)
"""
)
_ITEMS = dims.TEMPLATES["home_loan"]
_ITEM_ROWS = ", ".join(f"({i}, '{x.doc_type}', {x.count}, {str(x.optional).lower()}, {repr(x.rule) if x.rule else 'NULL'}, {x.months})" for i, x in enumerate(_ITEMS))
_JUDGED = (
    CHECKLIST
    + f""", items(position, effective_type, n, optional, rule, months) AS (VALUES {_ITEM_ROWS}),
found AS (SELECT d.*, i.position, i.n, i.optional, i.rule, i.months, date_trunc('month', effective_date)::DATE AS month FROM docs d JOIN items i USING (effective_type)),
fit AS (SELECT *, CASE WHEN rule IS NULL THEN true
   WHEN rule = 'within_months' THEN effective_date >= DATE '{ORDERS_TODAY}' - to_months(months::INT)
   WHEN rule = 'distinct_months' THEN month >= date_trunc('month', DATE '{ORDERS_TODAY}' - to_months(months::INT)) END AS fits FROM found),
again AS (SELECT *, coalesce(rule = 'distinct_months', false) AND fits AND row_number() OVER (PARTITION BY owner, position, fits, month ORDER BY effective_date DESC, confirmed DESC, confidence DESC, id) > 1 AS again FROM fit),
ranked AS (SELECT *, row_number() OVER (PARTITION BY owner, position, fits, again ORDER BY effective_date DESC, confirmed DESC, confidence DESC, id) AS rank FROM again),
judged AS (SELECT *, CASE WHEN NOT fits THEN 'too_old' WHEN again THEN 'same_month' WHEN rank > n THEN 'extra' ELSE 'found' END AS verdict FROM ranked)
"""
)
_KV = "kept AS (SELECT event_id AS id, event_type AS what FROM events WHERE event_id % 3 = 0), fresh AS (SELECT event_id AS id, 'new ' || event_type AS what FROM events WHERE event_id % 2 = 0)"
_TURN_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '')"


def _hint(lang: str) -> str:
    cases = " ".join(f"WHEN '{w}' THEN {x}::DOUBLE" for w, x in Lexicon().language_hints[lang].items())
    return f"coalesce(list_sum(list_transform({_TURN_WORDS}, lambda w: CASE w {cases} ELSE 0.0::DOUBLE END)), 0.0)"


_D, _P = str(PRODUCT), str(POWERS)
_SCRIPTS = {"latin": "Latin", "devanagari": "Devanagari", "telugu": "Telugu", "tamil": "Tamil", "kannada": "Kannada"}
_SCRIPT_LIST = ", ".join(rf"CASE WHEN length(regexp_replace(ocr_text, '\P{{{s}}}', '', 'g')) >= 3 AND length(regexp_replace(ocr_text, '\P{{{s}}}', '', 'g')) * 20 >= length(regexp_replace(ocr_text, '\P{{L}}', '', 'g')) THEN '{n}' END" for n, s in _SCRIPTS.items())

ORACLES: dict[str, str] = {
    "docs_in_other_table": VAULT + "SELECT id, doc_type, owner_name FROM vault WHERE id IN (SELECT doc_id FROM labels)",
    "docs_newest_first": VAULT + "SELECT id, captured_at FROM vault ORDER BY captured_at DESC, id",
    "docs_by_types": VAULT + "SELECT id, doc_type FROM vault WHERE doc_type IN ('PAN', 'PASSPORT', 'SALARY_SLIP')",
    "docs_expiring": VAULT + "SELECT id, expiry_on, expired FROM vault WHERE expiry_on IS NOT NULL ORDER BY expiry_on, id",
    "docs_recent_topk": VAULT + "SELECT id, captured_at FROM vault ORDER BY captured_at DESC, id LIMIT 10",
    "docs_oldest_of_wide": VAULT + "SELECT * FROM (SELECT id, effective_date FROM vault ORDER BY effective_date DESC, id LIMIT 50) ORDER BY effective_date, id LIMIT 6",
    "pending_dups": VAULT + "SELECT id, dup_of_doc_id FROM vault WHERE dup_of_doc_id IS NOT NULL",
    "derived_columns": VAULT + f"SELECT id, is_type_confident, effective_type, effective_date, {_CATEGORY} AS doc_category, expired, CASE WHEN effective_type <> doc_type THEN owner_name ELSE label || ' · ' || owner_name END AS display_title FROM vault",
    "doc_summaries": VAULT + "SELECT id, effective_type, effective_date, expiry_on, owner_name, doc_type_confidence AS confidence, is_user_confirmed AS confirmed FROM vault",
    "owner_filter": VAULT + "SELECT id, owner_name FROM vault WHERE contains(lower(owner_name), 'src1')",
    "owners_distinct": VAULT + "SELECT DISTINCT trim(owner_name) AS owner FROM vault WHERE trim(owner_name) <> ''",
    "date_range_filter": VAULT + "SELECT id, effective_date FROM vault WHERE effective_date BETWEEN DATE '2024-06-01' AND DATE '2024-12-31'",
    "vault_list_filter": VAULT + f"SELECT id, effective_type, owner_name FROM vault WHERE {_CATEGORY} = 'identity' AND (contains(lower({_LABEL_OF}), 'src1') OR contains(lower(owner_name), 'src1'))",
    "path_leniency": PHOTOS + "SELECT regexp_matches(lower(path), 'screenshot|download|whatsapp documents') AS lenient, count(*) AS n FROM photos GROUP BY 1",
    "text_density_gate": r"SELECT page_id, length(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[^\p{L}\p{Nd}]', '', 'g')) AS useful, length(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[^\p{L}\p{Nd}]', '', 'g')) >= 40 AS is_text FROM pages",
    "pending_enrichment": VAULT + "SELECT id, needs_llm, doc_type_confidence FROM vault WHERE NOT is_user_confirmed AND (needs_llm <> 0 OR (doc_type_confidence < 0.8 AND doc_type_source <> 'llm') OR id % 2 < 1)",
    "revalidate_shown": VAULT + "SELECT id, doc_type FROM vault WHERE doc_type IN ('PAN', 'TICKET', 'PASSPORT') AND (id % 9 <> 0)",
    "chat_history_ring": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 5",
    "page_of_offset": """WITH s AS (SELECT conv_id, turn, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS e, length(text) AS l FROM conversations),
        o AS (SELECT conv_id, sum(length(text) + 1)::BIGINT // 2 AS "offset" FROM conversations GROUP BY conv_id)
        SELECT conv_id AS doc_id, "offset", turn::INT AS page FROM s JOIN o USING (conv_id) WHERE "offset" < e AND "offset" >= e - l - 1""",
    "insert_ignore": f"WITH {_KV} SELECT * FROM kept UNION ALL SELECT * FROM fresh WHERE id NOT IN (SELECT id FROM kept)",
    "upsert_rows": f"WITH {_KV} SELECT * FROM fresh UNION ALL SELECT * FROM kept WHERE id NOT IN (SELECT id FROM fresh)",
    "latest_per_user": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "user_edits": VAULT + "SELECT id, CASE WHEN id % 6 = 0 THEN 'PAN' ELSE doc_type END AS doc_type, CASE WHEN id % 6 = 0 THEN 'user' ELSE doc_type_source END AS doc_type_source, is_user_confirmed OR id % 6 = 0 AS is_user_confirmed, CASE WHEN id % 6 = 0 THEN needs_llm & 2 ELSE needs_llm END AS needs_llm FROM vault",
    "owner_names_cleared": VAULT + "SELECT doc_type, count(CASE WHEN doc_type NOT IN ('TICKET', 'RECEIPT_INVOICE') THEN owner_name END) AS owned, count(*) AS docs FROM vault GROUP BY doc_type",
    "cascade_delete": VAULT + """, gone AS (SELECT id FROM vault WHERE dup_of_doc_id IS NOT NULL)
        SELECT 'documents' AS name, count(*) AS n FROM vault WHERE id NOT IN (FROM gone) UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (FROM gone)
        UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id // 2 NOT IN (FROM gone)""",
    "model_verdicts": VAULT + "SELECT id, CASE id % 3 WHEN 0 THEN doc_type WHEN 1 THEN 'OTHER_DOCUMENT' ELSE 'TICKET' END AS merged_type, CASE WHEN id % 3 < 2 OR doc_type = 'TICKET' THEN 0.9 ELSE 0.6 END AS confidence FROM vault WHERE NOT is_type_confident",
    "table_counts": "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS chunks",
    "status_counts": STATE + "SELECT status, count(*) AS n FROM state GROUP BY status",
    "category_counts": PHOTOS + "SELECT category, count(*) AS n FROM photos GROUP BY category",
    "trip_distinct_count": PHOTOS + "SELECT count(DISTINCT trip_id) AS trips FROM photos",
    "overview_top_types": VAULT + "SELECT effective_type, count(*) AS n FROM vault GROUP BY 1 ORDER BY n DESC, effective_type LIMIT 5",
    "suggestions": VAULT + f"SELECT effective_type, 'Show my ' || lower({_LABEL_OF}) AS suggestion FROM (SELECT effective_type, count(*) AS n FROM vault WHERE effective_type <> 'OTHER_DOCUMENT' GROUP BY 1 ORDER BY n DESC, effective_type LIMIT 3)",
    "doc_category_counts": VAULT + f"SELECT {_CATEGORY} AS doc_category, count(*) AS n FROM vault WHERE source_kind = 'gallery' GROUP BY 1",
    "index_funnel": STATE + "SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("done", "skipped_non_doc", "failed", "pending")) + ", count(*) AS total FROM state",
    "latency_percentiles": """WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events), g AS (SELECT event_type, list_sort(list(value)) AS v, avg(value) AS m, arg_min(value, r) AS l FROM k WHERE r <= 500 GROUP BY event_type)
        SELECT event_type, len(v) AS n, v[floor((len(v) - 1) * 0.5)::INT + 1] AS p50, v[floor((len(v) - 1) * 0.95)::INT + 1] AS p95, round(m, 6) AS avg, l AS last FROM g""",
    "ingest_throughput": STATE + "SELECT count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS remaining, round(avg(value) FILTER (status <> 'pending'), 6) AS ms_per_item, round(avg(value) FILTER (status <> 'pending') * count(*) FILTER (status = 'pending'), 3) AS eta_ms FROM state",
    "eval_hit_at_3": f"""WITH c AS (SELECT vec_id AS case_id, embedding AS q, label AS expected, CASE WHEN label < 5 THEN 'a' ELSE 'b' END AS lang FROM embeddings WHERE vec_id % 20 = 0),
        s AS (SELECT case_id, expected, lang, label, row_number() OVER (PARTITION BY case_id ORDER BY round({_DOT.format("embedding", "q")}, 6) DESC, vec_id) AS r FROM embeddings, c WHERE vec_id <> case_id),
        h AS (SELECT case_id, lang, max((label = expected)::INT) AS hit FROM s WHERE r <= 3 GROUP BY ALL)
        SELECT lang, count(*) AS cases, sum(hit)::BIGINT AS hits, floor(sum(hit) * 100 / count(*))::BIGINT AS percent FROM h GROUP BY ROLLUP (lang)""",
    "incremental_scan": STATE + "SELECT uri, generation FROM state WHERE generation > 500",
    "next_watermark": STATE + "SELECT coalesce(max(generation), 500) AS watermark FROM state",
    "pending_queue_topk": STATE + "SELECT uri, generation FROM state WHERE status = 'pending' ORDER BY generation, uri LIMIT 25",
    "skipped_recent_topk": STATE + "SELECT uri, updated_at FROM state WHERE status = 'skipped_non_doc' ORDER BY updated_at DESC, uri LIMIT 25",
    "unfiled_items": STATE + "SELECT uri, status FROM state WHERE status IN ('done', 'skipped_non_doc') AND generation % 2 <> 0",
    "photos_by_category_range": PHOTOS + "SELECT uri, taken_at FROM photos WHERE category = 'food' AND taken_at >= epoch_ms(TIMESTAMP '2024-01-05') AND taken_at < epoch_ms(TIMESTAMP '2024-01-21') ORDER BY taken_at DESC, uri LIMIT 60",
    "photos_at_place": PHOTOS + "SELECT uri, taken_at FROM photos WHERE lower(place) = 'nation_7' ORDER BY taken_at DESC, uri LIMIT 60",
    "photos_in_trips": PHOTOS + "SELECT uri, trip_id, taken_at FROM photos WHERE trip_id IS NOT NULL ORDER BY taken_at DESC, uri",
    "distinct_places": PHOTOS + "SELECT DISTINCT place FROM photos WHERE place IS NOT NULL",
    "unplaced_photos": PHOTOS + "SELECT uri, round(lat, 6) AS lat, round(lon, 6) AS lon FROM photos WHERE place IS NULL",
    "photos_with_documents": VAULT + ", " + PHOTOS.strip().removeprefix("WITH ") + "SELECT uri, p.doc_id, effective_type FROM photos p LEFT JOIN vault v ON p.doc_id = v.id WHERE p.doc_id IS NOT NULL",
    "trips_then_category": PHOTOS + """, e AS (SELECT uri, taken_at, 0 AS list FROM photos WHERE trip_id IS NOT NULL UNION ALL SELECT uri, taken_at, 1 FROM photos WHERE category = 'places')
        SELECT uri, any_value(taken_at) AS taken_at, min(list) AS list FROM e GROUP BY uri ORDER BY min(list), any_value(taken_at) DESC, uri LIMIT 60""",
    "home_cells": PHOTOS + _HOME + "SELECT user_id, round(lat, 6) AS home_lat, round(lon, 6) AS home_lon, days, n AS photos FROM home",
    "trips": _TRIPS + "SELECT user_id, uri, trip_id FROM trip WHERE n >= 3",
    "trip_summaries": _TRIPS + """, kept AS (SELECT * FROM trip WHERE n >= 3),
        pc AS (SELECT user_id, trip_id, place, count(*) AS c FROM kept WHERE place IS NOT NULL GROUP BY ALL), pl AS (SELECT *, row_number() OVER (PARTITION BY user_id, trip_id ORDER BY c DESC, place) AS r FROM pc)
        SELECT k.user_id, k.trip_id, min(taken_at) AS first, max(taken_at) AS last, count(*) AS photos, any_value(pl.place) AS place FROM kept k LEFT JOIN pl ON pl.user_id = k.user_id AND pl.trip_id = k.trip_id AND r = 1 GROUP BY k.user_id, k.trip_id""",
    "nearest_place": PHOTOS
    + """, places AS (SELECT c_name AS name, 10 + (c_custkey % 200) * 0.06::DOUBLE AS lat, 70 + (c_custkey % 150) * 0.055::DOUBLE AS lon, c_custkey * 100 AS population FROM customer),
        near AS (SELECT p.id, name, population, """
    + _KM.format("p.lat", "p.lon", "q.lat", "q.lon")
    + """ AS km FROM photos p JOIN places q ON abs(floor(p.lat) - floor(q.lat)) <= 1 AND abs(floor(p.lon) - floor(q.lon)) <= 1)
        SELECT id, name AS place, round(km, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(km - 3 * log10(greatest(population, 1)), 9), name) AS r FROM near WHERE km <= 30) WHERE r = 1""",
    "gate_verdict": "WITH x AS (SELECT 1)" + _LABELS + f""", s AS (SELECT vec_id AS id, l.label, ordinal, is_document, {_DOT.format("embedding", "v")} AS sim FROM embeddings, labels l),
        g AS (SELECT id, max(CASE WHEN is_document THEN sim END) AS d, max(CASE WHEN NOT is_document THEN sim END) AS n FROM s GROUP BY id),
        t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, ordinal) AS r FROM s) WHERE r = 1)
        SELECT id, label, is_document AND d - n >= 0 AS is_document, abs(d - n) < 0.02 AS uncertain, round(d - n, 6) AS margin FROM g JOIN t USING (id)""",
    "photo_categories": "WITH x AS (SELECT 1)" + _LABELS + f""", s AS (SELECT vec_id AS id, category, exp(8.0 * {_DOT.format("embedding", "v")}) AS e FROM embeddings, labels),
        q AS (SELECT id, category, sum(e) AS e FROM s GROUP BY ALL), p AS (SELECT id, category, e / sum(e) OVER (PARTITION BY id) AS p, list_position({_CATS}, category) AS o FROM q),
        b AS (SELECT id, arg_min({{'c': category, 'p': p}}, (-round(p, 9), o)) AS best, arg_min({{'c': category, 'p': p}}, (-round(p, 9), o)) FILTER (category NOT IN ('selfie', 'people')) AS other, coalesce(sum(p) FILTER (category IN ('selfie', 'people')), 0) AS person FROM p GROUP BY id),
        k AS (SELECT id, CASE WHEN best.c NOT IN ('selfie', 'people') OR id % 5 - 1 < 0 THEN best WHEN id % 5 - 1 = 0 THEN {{'c': other.c, 'p': other.p / (1 - person)}} WHEN id % 5 - 1 >= 3 THEN {{'c': 'people', 'p': person}} ELSE {{'c': best.c, 'p': person}} END AS k FROM b)
        SELECT id, CASE WHEN id % 13 = 0 THEN CASE WHEN id % 2 = 0 THEN 'bills' ELSE 'documents' END WHEN id % 11 = 0 THEN 'screenshot' WHEN k.c = 'documents' OR k.p < 0.4 THEN 'other' ELSE k.c END AS category,
          round(CASE WHEN id % 13 = 0 THEN CASE WHEN id % 2 = 0 THEN 0.7 ELSE 1.0 END WHEN id % 11 = 0 THEN 1.0 ELSE k.p END, 6) AS confidence FROM k""",
    "exact_duplicates": "WITH h AS (SELECT doc_id AS id, sha256(text) AS sha256 FROM documents) SELECT id, sha256, min(id) OVER w AS dup_of, count(*) OVER w AS copies FROM h WINDOW w AS (PARTITION BY sha256) QUALIFY copies > 1",
    "near_dup_text": f"""WITH s AS (SELECT doc_id AS id, list_sort({_WORDS.format("text")}) AS w FROM documents), o AS (SELECT w, min(id) AS id, len(w) AS n FROM s WHERE len(w) > 0 GROUP BY w),
        t AS (SELECT id, n, unnest(w) AS x FROM o), c AS (SELECT p.id AS a, q.id AS b, p.n + q.n AS total, count(*) AS k FROM t p JOIN t q ON p.x = q.x AND p.id < q.id GROUP BY ALL)
        SELECT a, b, round(k / (total - k), 9) AS similarity FROM c WHERE k / (total - k) >= 0.8""",
    "near_dup_classes": f"WITH s AS (SELECT doc_id AS id, list_sort({_WORDS.format('text')}) AS w FROM documents) SELECT id, min(id) OVER (PARTITION BY w) AS class_id FROM s",
    "near_dup_vector": f"SELECT * FROM (SELECT p.vec_id AS a, q.vec_id AS b, round({_DOT.format('p.embedding', 'q.embedding')}, 6) AS cosine FROM embeddings p JOIN embeddings q ON p.vec_id < q.vec_id) WHERE cosine >= 0.35",
    "near_duplicates": f"""WITH n AS (SELECT count(*) AS n FROM embeddings),
        d AS (SELECT doc_id AS id, text, ({" + ".join(f"coalesce(ascii(substr(text, {k}, 1)), 0) * {31 * k * k + 7}" for k in range(1, 9))}) % n AS vec_id FROM documents, n),
        b AS (SELECT id, {_WORDS.format("text")} AS w, list_transform(embedding, lambda x, i: x::DOUBLE + ((id + i - 1) % 3 - 1) * 0.025::DOUBLE) AS v FROM d JOIN embeddings USING (vec_id)),
        u AS (SELECT id, w, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM b),
        p AS (SELECT q.id, o.id AS dup_of, {_DOT.format("o.v", "q.v")} AS cosine, len(list_intersect(o.w, q.w)) AS k, len(o.w) + len(q.w) AS t FROM u o JOIN u q ON o.id < q.id)
        SELECT id, dup_of, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(cosine, 9) DESC, dup_of) AS r FROM p WHERE cosine >= 0.95 AND (t = 0 OR k / (t - k) >= 0.8)) WHERE r = 1""",
    "keyword_hits": VAULT + ", " + _TERMS + ", n AS (SELECT query_id, doc_id, count(DISTINCT chunk_id) AS hits FROM hit GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id) AS rank FROM n) SELECT query_id, count(*) AS docs, sum(hits)::BIGINT AS hits FROM r WHERE rank <= 50 GROUP BY query_id",
    "keyword_bm25": VAULT + ", " + _TERMS + _BM25 + _ranked(10, "best") + "SELECT query_id, doc_id, rank, round(score, 6) AS score FROM best",
    "vector_topk": f"""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id // 2 AS doc_id, max({_DOT.format("embedding", "e")}) AS score FROM embeddings, q GROUP BY ALL)
        SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s) WHERE rank <= 50""",
    "best_chunk_per_doc": f"WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0) SELECT query_id, vec_id // 2 AS doc_id, round(max({_DOT.format('embedding', 'e')}), 6) AS score FROM embeddings, q GROUP BY ALL",
    "rrf_fusion": VAULT + """, l AS (SELECT id, 0 AS list, row_number() OVER (ORDER BY effective_date DESC, id) AS rank FROM vault UNION ALL SELECT id, 1, row_number() OVER (ORDER BY doc_type_confidence DESC, id) FROM vault UNION ALL SELECT id, 2, row_number() OVER (ORDER BY needs_llm DESC, id) FROM vault),
        f AS (SELECT id, sum(1 / (60 + rank)) AS score, min((list, rank)) AS first FROM l WHERE rank <= 50 GROUP BY id)
        SELECT id AS doc_id, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 12) DESC, first, id) AS rank FROM f""",
    "hybrid_search": VAULT + ", " + _TERMS + _BM25 + _ranked(50, "keyword") + f""",
        vq AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)), vs AS (SELECT query_id, vec_id // 2 AS doc_id, max({_DOT.format("embedding", "e")}) AS score FROM embeddings, vq GROUP BY ALL),
        meaning AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM vs) WHERE rank <= 50),
        asked AS (SELECT item_id AS query_id, [{", ".join(f"'{n}'" for n in dims.NAMES)}][item_id % 27 + 1] AS t FROM benchmark WHERE item_id % 4 = 1),
        typed AS (SELECT query_id, id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY effective_date DESC, id) AS rank FROM asked JOIN vault ON t = effective_type),
        l AS (SELECT query_id, doc_id, 0 AS list, rank FROM keyword UNION ALL SELECT query_id, doc_id, 1, rank FROM meaning UNION ALL SELECT query_id, doc_id, 2, rank FROM typed),
        f AS (SELECT query_id, doc_id, sum(1 / (60 + rank)) AS score, min((list, rank)) AS first FROM l GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, doc_id) AS place FROM f),
        h AS (SELECT p.query_id, p.doc_id AS id, p.score, m.score AS cosine, k.doc_id IS NOT NULL AS keyword, place FROM p JOIN vault v ON v.id = p.doc_id LEFT JOIN asked a ON a.query_id = p.query_id LEFT JOIN keyword k ON k.query_id = p.query_id AND k.doc_id = p.doc_id LEFT JOIN meaning m ON m.query_id = p.query_id AND m.doc_id = p.doc_id
          WHERE (a.t IS NULL OR a.t = v.effective_type) AND v.effective_type <> 'TICKET' AND (k.doc_id IS NOT NULL OR a.t IS NOT NULL OR coalesce(m.score, 0) >= 0.5) AND contains(lower(owner_name), 'src'))
        SELECT query_id, id, round(score, 9) AS score, round(cosine, 6) AS cosine, keyword, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM h) WHERE rank <= 6""",
    "script_sets": VAULT + f"SELECT id, array_to_string(list_filter([{_SCRIPT_LIST}], lambda x: x IS NOT NULL), ',') AS scripts FROM vault",
    "language_hint_score": f"SELECT conv_id, turn, {_hint('te')} AS te, {_hint('hi')} AS hi FROM conversations",
    "keyword_scores": VAULT + ", " + _scores() + "SELECT id, x.t AS doc_type, x.s AS score FROM scores WHERE x.s > 0",
    "classify_docs": VAULT + ", " + _scores() + """, r AS (SELECT id, list(x ORDER BY x.s DESC, x.n) AS l FROM scores GROUP BY id), m AS (SELECT r.id, l[1].t AS t, l[1].s AS s, l[1].s - l[2].s AS m, regexp_matches(ocr_text, '(?i)P<IND') AS mrz FROM r JOIN vault USING (id))
        SELECT id, CASE WHEN mrz THEN 'PASSPORT' WHEN (s >= 4.0 AND m >= 2.0) OR (s >= 2.5 AND m >= 1.2) OR s >= 1.5 THEN t ELSE 'OTHER_DOCUMENT' END AS doc_type,
          round(CASE WHEN mrz THEN 0.97 WHEN (s >= 4.0 AND m >= 2.0) OR (s >= 2.5 AND m >= 1.2) THEN least(greatest(0.5 + 0.08 * m, 0.5), 0.92) ELSE 0.3 END, 6) AS confidence,
          NOT (mrz OR (s >= 4.0 AND m >= 2.0) OR (s >= 2.5 AND m >= 1.2)) AS needs_model FROM m""",
    "verhoeff_valid": f"""WITH r AS (SELECT l_orderkey, l_linenumber, lpad(l_orderkey::VARCHAR, 8, '7') || lpad((l_partkey % 10000)::VARCHAR, 4, '0') AS digits FROM lineitem)
        SELECT l_orderkey, l_linenumber, digits, list_reduce(list_transform(range(0, 12), lambda i: {_P}[(i % 8) * 10 + substr(digits, (12 - i)::INT, 1)::INT + 1]), lambda c, x: {_D}[c * 10 + x + 1], 0) = 0 AS valid FROM r""",
    "mask_ids": "SELECT c_custkey, 'XXXXXX' || right(c_name, 4) AS masked FROM customer",
    "titles": VAULT + f"""SELECT id, concat_ws(' · ', {_LABEL_OF}, owner_name, CASE WHEN effective_type IN ({", ".join(f"'{t.name}'" for t in dims.DOC_TYPES if t.expires)}) AND expiry_on IS NOT NULL THEN 'valid till ' || strftime(expiry_on, '%-d %b %Y')
        WHEN effective_type IN ({", ".join(f"'{t}'" for t in dims.MONTHLY)}) THEN strftime(effective_date, '%b %Y') ELSE strftime(effective_date, '%-d %b %Y') END) AS title FROM vault""",
    "checklist_found": _JUDGED + "SELECT owner, position, id, verdict FROM judged WHERE verdict IN ('found', 'same_month', 'extra')",
    "checklist_status": _JUDGED + """, c AS (SELECT owner, position, count(*) AS found FROM judged WHERE verdict = 'found' GROUP BY ALL)
        SELECT c_name AS owner, position, effective_type AS doc_type, coalesce(found, 0) AS found, CASE WHEN coalesce(found, 0) >= n THEN 'complete' WHEN optional AND found IS NULL THEN 'optional_missing' WHEN found > 0 THEN 'partial' ELSE 'missing' END AS status
        FROM customer CROSS JOIN items LEFT JOIN c ON c.owner = c_name AND c.position = items.position""".replace("SELECT c_name AS owner, position", "SELECT c_name AS owner, items.position"),
    "pack_order": _JUDGED + "SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY position, rank, id) AS place, id FROM judged WHERE verdict = 'found'",
    "renewal_templates": VAULT + "SELECT id, CASE effective_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.RENEWALS.items()) + f" ELSE '{dims.DEFAULT_RENEWAL}' END AS template FROM vault WHERE expiry_on IS NOT NULL",
    "reminders": VAULT + "SELECT id AS doc_id, o AS offset_days, (expiry_on - o)::DATE AS fire_on, CASE WHEN (expiry_on - o)::TIMESTAMP + INTERVAL 9 HOUR <= TIMESTAMP '2025-01-31 09:00:00' THEN 'skipped_past' ELSE 'scheduled' END AS state FROM vault, (VALUES (30), (7), (1)) t(o) WHERE expiry_on IS NOT NULL",
    "turn_context": "SELECT conv_id, turn, coalesce(lag(turn) OVER w, -1) AS last_turn, lag(role) OVER w AS last_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "ordinal_pick": "WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS l FROM conversations GROUP BY conv_id) SELECT conv_id, l[2] AS second, l[-1] AS last FROM c",
    "owner_relations": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Ravi' WHEN 1 THEN 'Asha' END AS owner FROM documents",
    "citations_kept": "SELECT doc_id, CASE WHEN doc_id = 7 THEN '7' WHEN doc_id = 6 THEN '6,7' ELSE doc_id::VARCHAR || ',7' END AS kept, CASE WHEN doc_id = 6 THEN '' ELSE (doc_id + 1)::VARCHAR END AS dropped FROM documents",
    "answer_summaries": VAULT + f"""SELECT effective_type, concat_ws(' ', CASE WHEN count(*) <= 1 THEN 'Here is your ' || {_LABEL_OF} || '.' ELSE {_LABEL_OF} || ': ' || count(*) || ' saved, for ' || array_to_string(list_sort(list(DISTINCT owner_name))[1:2], ', ') || '.' END,
        CASE WHEN count(*) > 2 THEN 'Showing the latest 2.' END, 'Use share to send it.') AS answer FROM vault GROUP BY effective_type""",
    "stream_ingest_counts": STATE + "SELECT status, count(*) AS n FROM state GROUP BY status",
    "validated_replies": """SELECT conv_id, turn, CASE conv_id % 5 WHEN 3 THEN 'question' WHEN 4 THEN NULL ELSE 'find' END AS kind, CASE WHEN conv_id % 5 < 4 THEN 'PAN' END AS doc_types, CASE WHEN conv_id % 5 < 4 THEN 'x' END AS dropped,
        CASE WHEN conv_id % 5 < 4 THEN DATE '2025-01-01' END AS date_from, CASE WHEN conv_id % 5 < 4 THEN DATE '2025-02-01' END AS date_to, conv_id % 5 = 4 AS retry FROM conversations WHERE role = 'user'""",
}

_KEYED = "WITH o AS (SELECT o_orderkey AS id, o_orderkey AS k, o_orderdate::DATE AS d FROM orders) "
_UNTIL = "(d + INTERVAL 480 MONTH)::DATE"
ORACLES |= {
    "entities_of_orders": _KEYED + """, e AS (SELECT id, unnest([
        {'kind': 'pan', 'value': printf('ABCDE%04dF', k % 10000), 'masked': printf('XXXXXX%03dF', k % 1000)},
        {'kind': 'amount', 'value': printf('%d.50', 1000 + k), 'masked': printf('%d.50', 1000 + k)},
        {'kind': 'amount', 'value': printf('%d', 500 + k % 7), 'masked': printf('%d', 500 + k % 7)},
        {'kind': 'policy_no', 'value': printf('AB/%06d-X', k % 1000000), 'masked': printf('AB/%06d-X', k % 1000000)},
        {'kind': 'ifsc', 'value': printf('SBIN0%06d', k % 1000000), 'masked': printf('SBIN0%06d', k % 1000000)},
        CASE WHEN k % 10 = 6 THEN {'kind': 'aadhaar', 'value': '234123412346', 'masked': 'XXXX XXXX 2346'} END,
        {'kind': 'vehicle_no', 'value': printf('AP09AB%04d', k % 10000), 'masked': printf('AP09AB%04d', k % 10000)},
        {'kind': 'phone', 'value': printf('9%04d%05d', k % 10000, k % 100000), 'masked': printf('XXXXXX%04d', k % 10000)},
        {'kind': 'abha', 'value': printf('u%06d@abdm', k % 1000000), 'masked': printf('u%06d@abdm', k % 1000000)}]) AS e FROM o)
        SELECT id, e.kind AS kind, e.value AS value, e.masked AS masked FROM e WHERE e IS NOT NULL""",
    "amount_max_of_orders": _KEYED + "SELECT id, printf('%d.50', 1000 + k) AS amount FROM o",
    "phones_of_orders": _KEYED + "SELECT id, printf('9%04d%05d', k % 10000, k % 100000) AS phone FROM o",
    "masked_orders": _KEYED + """SELECT id, printf('PAN ABCDE%04dF, total amount: %d.50 or Rs. %d', k % 10000, 1000 + k, 500 + k % 7) || chr(10) || printf('policy no: AB/%06d-X IFSC SBIN0%06d uid ', k % 1000000, k % 1000000)
        || CASE WHEN k % 10 = 6 THEN 'XXXX XXXX 2346' ELSE printf('2341 2341 %04d', 2340 + k % 10) END || chr(10) || printf('AP 09 AB %04d, call +91 9%04d %05d, mail u%06d@abdm', k % 10000, k % 10000, k % 100000, k % 1000000) AS text FROM o""",
    "dates_of_orders": _KEYED + f"SELECT id, 1 AS line, d AS date, 'day' AS precision FROM o UNION ALL SELECT id, 3, {_UNTIL}, 'day' FROM o",
    "expiry_of_orders": _KEYED + f"SELECT id, {_UNTIL} AS expiry_on, 'rule' AS expiry_source, d AS issued_on FROM o",
    "owners_of_customers": """SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 2) THEN array_to_string(list_transform(string_split(translate(lower(n_name), '_0123456789', ' abcdefghij'), ' '), lambda x: upper(x[1]) || x[2:]), ' ') END AS owner
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
}

#: Dates are compared as ISO text.
DATES = {
    "docs_newest_first": ["captured_at"],
    "docs_expiring": ["expiry_on"],
    "docs_recent_topk": ["captured_at"],
    "docs_oldest_of_wide": ["effective_date"],
    "derived_columns": ["effective_date"],
    "doc_summaries": ["effective_date", "expiry_on"],
    "date_range_filter": ["effective_date"],
    "reminders": ["fire_on"],
    "dates_of_orders": ["date"],
    "expiry_of_orders": ["expiry_on", "issued_on"],
    "validated_replies": ["date_from", "date_to"],
}
for _name, _columns in DATES.items():
    ORACLES[_name] = f"SELECT * REPLACE ({', '.join(f'{c}::VARCHAR AS {c}' for c in _columns)}) FROM ({ORACLES[_name]})"

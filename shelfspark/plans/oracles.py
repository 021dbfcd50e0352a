"""SQL that checks the core queries."""

from __future__ import annotations

from shelfspark.functions import text as T

WORDS = {
    0: ["balka", "v", "matritsa"], 1: ["prochnost"], 2: ["matritsa", "balka", "v", "i", "splav", "poroda", "na"], 3: ["neizvestno", "splav", "of"],
    4: ["splav", "poroda", "splav"], 5: ["the", "of", "function"],
}

_STATS = """
SELECT token, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS occurrences, count(DISTINCT object_id) AS n_groups
FROM (SELECT token, segment_id, object_id, pos, weight, count(*) AS n FROM postings GROUP BY ALL) GROUP BY token"""

# The nine columns of a line: quoted columns are masked first, so that a plain split finds the columns.
_BL = "[ \\t\\r\\x{00a0}\\x{feff}]*"
_LINES = f"""
WITH l AS (SELECT *, coalesce(raw_line, '') || ';' AS t FROM catalogue_raw),
c AS (SELECT *, regexp_extract_all(t, '({_BL}"(?:[^"]|"")*"{_BL}|{_BL}[^"; \\t\\r\\x{{00a0}}\\x{{feff}}][^;]*|{_BL});', 1) AS cells FROM l),
s AS (SELECT *, array_to_string(cells, ';') || ';' = t AS sound,
      list_transform(cells, lambda x: regexp_replace(x, '^{_BL}|{_BL}$', '', 'g')) AS trimmed FROM c),
v AS (SELECT *, list_transform(trimmed, lambda x: CASE WHEN x LIKE '"%' THEN
      regexp_replace(replace(x[2:-2], '""', '"'), '^{_BL}|{_BL}$', '', 'g') ELSE x END) AS vals FROM s),
r AS (SELECT *, CASE WHEN NOT sound THEN ['quoting'] WHEN len(cells) <> 9 THEN ['column_count'] ELSE list_filter([
  CASE WHEN vals[2] <> '' AND NOT (regexp_full_match(vals[2], '[0-9]{{4}}') AND coalesce(TRY_CAST(vals[2] AS INTEGER), 0) BETWEEN 1400 AND 2030) THEN 'bad_year' END,
  CASE WHEN vals[3] <> '' AND NOT regexp_full_match(vals[3], '[0-9]{{1,3}}([.][0-9]{{1,3}})*') THEN 'bad_udc' END,
  CASE WHEN vals[7] <> '' AND NOT regexp_full_match(vals[7], '[1-9][0-9]{{0,4}}') THEN 'bad_pages_count' END], lambda x: x IS NOT NULL) END AS reasons FROM v)"""

ORACLES = {
    "p1_found": f"SELECT token FROM ({_STATS}) WHERE n_rows * 1000 >= 15 * (SELECT count(*) FROM postings)",
    "p1_token_stats": _STATS,
    "p1_merged_codes": """
SELECT token, count(*) AS n_codes, min(code) AS first_code, max(code) AS last_code FROM (
  SELECT DISTINCT token, unnest(token_codes) AS code FROM index_chunks) WHERE code IS NOT NULL GROUP BY token""",
    "p1_weighted_postings": """
SELECT p.*, declared_freq FROM postings p JOIN (
  SELECT token, CAST(sum(token_freq) AS BIGINT) AS declared_freq FROM index_chunks GROUP BY token) l USING (token)""",
    "p4_found": f"{_LINES} SELECT DISTINCT line_id, unnest(reasons) AS reason FROM r",
    "p4_loaded": f"""{_LINES} SELECT line_id, file_name, line_no, received_at, raw_line, TRY_CAST(vals[1] AS BIGINT) AS object_id,
  TRY_CAST(nullif(vals[2], '') AS INTEGER) AS "year", vals[3] AS udc, vals[4] AS section_1, vals[5] AS section_2, vals[6] AS section_3,
  TRY_CAST(nullif(vals[7], '') AS INTEGER) AS pages_count, vals[8] AS author, vals[9] AS title FROM r WHERE len(reasons) = 0""",
}


# ---------------------------------------------------------------------------------------------- text and index

_C = T.TOKEN_CLASS
FIRST_LOADS = """f AS (SELECT object_id, field_id, field_value AS text FROM object_fields
  QUALIFY row_number() OVER (PARTITION BY object_id, field_id ORDER BY loaded_at NULLS FIRST, row_id) = 1)"""
_TOKENS = f"""{FIRST_LOADS},
tok AS (SELECT object_id, field_id, regexp_extract_all(text, '([^{_C}]*)([{_C}]+)', 1) AS gaps,
  regexp_extract_all(text, '([^{_C}]*)([{_C}]+)', 2) AS ws FROM f WHERE text IS NOT NULL),
t0 AS (SELECT object_id, field_id, unnest(range(len(ws))) AS i, unnest(gaps) AS g, unnest(ws) AS word FROM tok),
t AS (SELECT object_id, field_id, CAST(i AS INTEGER) AS i, CAST(sum(len(g) + len(word)) OVER (PARTITION BY object_id, field_id ORDER BY i) - len(word) AS INTEGER) AS "start",
  CAST(len(word) AS INTEGER) AS length, word FROM t0)"""
_SEGMENTS = f"""{_TOKENS},
s0 AS (SELECT object_id, field_id, i // 64 AS segment_no, min("start") AS seg_start, max("start" + length) - min("start") AS seg_length FROM t GROUP BY ALL),
s AS (SELECT row_number() OVER (ORDER BY object_id, field_id, segment_no) - 1 AS segment_id, * FROM s0)"""


def _cut(x: str, ending: str) -> str:
    return f"regexp_replace({x}, '(?:{ending})$', '')"


def _cut_after_a(x: str, first: str, second: str) -> str:
    return f"regexp_replace({x}, '(?:([ая])(?:{first})|(?:{second}))$', '\\1')"


def _normal(source: str) -> str:
    """CTEs that end in ``norm(word, token)`` of the distinct words of ``source``."""
    v = T.VOWELS
    roman = f"translate(lower(stem), '{T.SINGLE[0]}', '{T.SINGLE[1]}')"
    for a, b in T.SEVERAL:
        roman = f"replace({roman}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return f"""
n0 AS (SELECT DISTINCT word FROM {source}),
n1 AS (SELECT word, regexp_extract(word, '^[^{v}]*[{v}]') AS head,
  len(regexp_extract(word, '^[^{v}]*[{v}]+[^{v}][^{v}]*[{v}]+[^{v}]')) AS r2 FROM n0),
n2 AS (SELECT *, word[len(head) + 1:] AS rv FROM n1),
n3 AS (SELECT *, {_cut_after_a('rv', T.GERUND_1, T.GERUND_2)} AS ger, {_cut('rv', T.REFLEXIVE)} AS plain FROM n2),
n4 AS (SELECT *, {_cut('plain', T.ADJECTIVE)} AS adj, {_cut_after_a('plain', T.VERB_1, T.VERB_2)} AS verb FROM n3),
n5 AS (SELECT *, regexp_replace(CASE WHEN ger <> rv THEN ger WHEN adj <> plain THEN {_cut_after_a('adj', T.PARTICIPLE_1, T.PARTICIPLE_2)}
  WHEN verb <> plain THEN verb ELSE {_cut('plain', T.NOUN)} END, 'и$', '') AS two FROM n4),
n6 AS (SELECT *, CASE WHEN r2 > 0 AND len(head) + len(regexp_replace(two, 'ость?$', '')) >= r2 THEN regexp_replace(two, 'ость?$', '') ELSE two END AS three FROM n5),
n7 AS (SELECT *, {_cut('three', T.SUPERLATIVE)} AS best FROM n6),
n8 AS (SELECT *, CASE WHEN best <> three OR regexp_replace(best, 'нн$', 'н') <> best THEN regexp_replace(best, 'нн$', 'н') ELSE regexp_replace(three, 'ь$', '') END AS four FROM n7),
n9 AS (SELECT word, CASE WHEN len(word) <= 4 OR head = '' THEN word ELSE head || four END AS stem FROM n8),
norm AS (SELECT word, {roman} AS token FROM n9)"""


_INDEX = f"""{_SEGMENTS}, {_normal('t')},
o AS (SELECT token, segment_id, object_id, CAST(i % 64 AS INTEGER) AS pos, CASE WHEN regexp_matches(t.word, '^[{T.UPPER_CLASS}]') THEN 1 ELSE 0 END AS weight
  FROM t JOIN norm USING (word) JOIN s USING (object_id, field_id) WHERE segment_no = i // 64)"""
_LEX = "SELECT token, count(*) AS freq FROM o GROUP BY token"
_KEPT = "HAVING count(*) BETWEEN 5 AND 30000000"
_PAIRS = f"""{FIRST_LOADS},
tok AS (SELECT object_id, field_id, regexp_extract_all(lower(text), '[{_C}]+') AS ws FROM f WHERE text IS NOT NULL),
b AS (SELECT unnest(ws[:-2]) AS token, unnest(ws[2:]) AS next_token FROM tok WHERE len(ws) > 1)"""

_RANGES = "SELECT object_id, min(segment_id) AS first_segment, max(segment_id) + 1 AS end_segment FROM segments GROUP BY object_id"
_ONCE = """once AS (SELECT DISTINCT token, segment_id, object_id, pos, weight FROM postings),
lex AS (SELECT token, count(*) AS freq FROM once GROUP BY token HAVING count(*) BETWEEN 5 AND 30000000)"""

# ---------------------------------------------------------------------------------------------------- ranked search


def _keys(words: dict[int, list[str]] | str, trim: float = 0.5, budget: int = 50_000_000, compat: bool = False) -> str:
    rows = []
    for q, ts in words.items() if isinstance(words, dict) else ():
        rows += [f"({q}, {ts.index(t)}, '{t}')" for t in dict.fromkeys(ts[:10])]
    terms = words if isinstance(words, str) else f"VALUES {', '.join(rows)}"
    counted = f"s - freq <= {budget}" if compat else f"s <= {budget}"
    return f"""{_ONCE},
terms(query_id, key_idx, token) AS ({terms}),
known AS (SELECT query_id, key_idx, token, freq, 1 / ln(freq + 2.0) AS idf FROM terms JOIN lex USING (token)),
k0 AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS slot, sum(freq) OVER (w ROWS UNBOUNDED PRECEDING) AS s, count(*) OVER (PARTITION BY query_id) AS n_known,
  sum(idf) OVER (PARTITION BY query_id) AS known_idf FROM known WINDOW w AS (PARTITION BY query_id ORDER BY freq, key_idx)),
k1 AS (SELECT *, {trim} * sum(CASE WHEN {counted} THEN idf END) OVER (PARTITION BY query_id) AS min_weight FROM k0 WHERE slot <= 5),
keys AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n_keys FROM k1 WHERE s <= {budget})"""


def _search(words: dict | str, trim: float = 0.5, objects: str = "", compat: bool = False) -> str:
    last = """ QUALIFY n_keys = 1 OR row_number() OVER (PARTITION BY query_id, token ORDER BY segment_id DESC, object_id DESC, pos DESC, weight DESC) > 1""" if compat else ""
    escape = " OR segment_id = max(segment_id) OVER (PARTITION BY query_id)" if compat else ""
    where = f"WHERE object_id IN ({objects})" if objects else ""
    return f"""{_keys(words, trim, compat=compat)},
occ0 AS (SELECT * FROM once JOIN keys USING (token){last}),
occ1 AS (SELECT * FROM occ0 {where}),
occ AS (SELECT * FROM occ1 QUALIFY n_keys > 1 OR row_number() OVER (PARTITION BY query_id, segment_id ORDER BY pos, weight) = 1),
sw0 AS (SELECT query_id, segment_id, object_id, any_value(n_keys) AS n_keys, any_value(min_weight) AS min_weight, any_value(n_known) AS n_known,
  any_value(known_idf) AS known_idf, CAST(count(*) AS INTEGER) AS uniq, sum(idf) AS weight FROM
  (SELECT DISTINCT query_id, segment_id, object_id, slot, idf, n_keys, min_weight, n_known, known_idf FROM occ) GROUP BY 1, 2, 3),
sw AS (SELECT * FROM sw0 {'QUALIFY' if compat else 'WHERE'} n_keys = 1 OR round(weight, 12) >= round(min_weight, 12){escape}),
ends AS (SELECT a.query_id, a.segment_id, a.pos AS from_pos, b.slot, min(b.pos) AS e FROM (SELECT DISTINCT query_id, segment_id, pos FROM occ) a
  JOIN occ b ON a.query_id = b.query_id AND a.segment_id = b.segment_id AND b.pos >= a.pos GROUP BY ALL),
spans AS (SELECT query_id, segment_id, from_pos, max(e) AS to_pos, max(e) - from_pos + 1 AS len, count(*) AS n FROM ends GROUP BY 1, 2, 3),
best AS (SELECT sw.*, from_pos, to_pos, spans.len, weight + uniq / (1000.0 * spans.len) AS raw FROM sw JOIN spans USING (query_id, segment_id) WHERE n = uniq
  QUALIFY row_number() OVER (PARTITION BY query_id, segment_id ORDER BY spans.len, from_pos) = 1),
obj AS (SELECT query_id, object_id, max(raw) + sum(raw) / count(*) * ln(1.0 + count(*)) / 1e6 AS raw, count(*) AS matches_count FROM best GROUP BY 1, 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 12) DESC, object_id DESC) AS INTEGER) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM obj)"""


def _refined(words: dict, count: int = 10, objects: str = "") -> str:
    return f"""{_search(words, objects=objects)},
page AS (SELECT * FROM ranked WHERE rank <= {count}),
inside AS (SELECT o.*, b.len FROM occ o JOIN best b USING (query_id, segment_id) JOIN page p ON p.query_id = o.query_id AND p.object_id = o.object_id WHERE pos BETWEEN from_pos AND to_pos),
steps AS (SELECT *, lead(key_idx) OVER (PARTITION BY query_id, segment_id ORDER BY pos, weight, key_idx) - key_idx AS step FROM inside),
rel0 AS (SELECT query_id, object_id, segment_id, CAST(count(DISTINCT key_idx) AS INTEGER) AS matched_words, count(*) FILTER (step = 1) AS pairs, max(weight) AS cased,
  any_value(len) AS len, any_value(n_known) AS n_known, any_value(known_idf) AS known_idf FROM steps GROUP BY 1, 2, 3),
rel1 AS (SELECT query_id, segment_id, sum(idf) AS got FROM (SELECT DISTINCT query_id, segment_id, key_idx, idf FROM inside) GROUP BY 1, 2),
rel AS (SELECT *, (got + 1e-7) / (known_idf + 1e-7) * CASE WHEN n_known > 1 THEN 1.0 + pairs / CAST(n_known - 1 AS DOUBLE) ELSE 2.0 END / len
  * CASE WHEN cased > 0 THEN 1.1 ELSE 1.0 END AS relevance FROM rel0 JOIN rel1 USING (query_id, segment_id)),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, object_id ORDER BY matched_words DESC, round(relevance, 12) DESC, segment_id DESC) AS INTEGER) AS place FROM rel)"""


_BATCH = """SELECT query_id, min(k), token FROM (SELECT segment_id AS query_id, token, CAST(row_number() OVER (PARTITION BY segment_id ORDER BY pos) - 1 AS INTEGER) AS k
  FROM (SELECT DISTINCT segment_id, pos, token FROM postings WHERE segment_id % 50 = 0 AND pos < 5)) GROUP BY query_id, token"""
_PAGE = "SELECT query_id, rank, object_id, round(raw, 6) AS score, matches_count, total FROM ranked WHERE rank > {} AND rank <= {}"
_KEY_COLUMNS = "SELECT query_id, key_idx, slot, token, n_keys, n_known, round(min_weight, 6) AS min_weight, round(known_idf, 6) AS known_idf FROM keys"

# -------------------------------------------------------------------------------------------------------- catalogue

_NEWEST = """c0 AS (SELECT * FROM catalogue QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY updated_at DESC NULLS LAST, arrived_at DESC NULLS LAST, row_id DESC) = 1),
c1 AS (SELECT object_id, title, author, udc, coalesce("year", -1) AS "year", coalesce(pages_count, -1) AS pages_count, lib_sections,
  list_filter(list_transform(string_split(coalesce(udc, ''), '.'), lambda x: TRY_CAST(trim(x) AS INTEGER)), lambda x: x IS NOT NULL) AS parts FROM c0),
c AS (SELECT *, CASE WHEN len(parts) > 0 THEN '|' || array_to_string(parts, '|') || '|' END AS udc_key FROM c1)"""
_WORDS = f"""{_NEWEST},
cw AS (SELECT object_id, 'title' AS kind, unnest(regexp_extract_all(title, '[{_C}]+')) AS word FROM c UNION ALL
  SELECT object_id, 'author', unnest(regexp_extract_all(author, '[{_C}]+')) FROM c), {_normal('cw')},
tt AS (SELECT DISTINCT object_id, token FROM cw JOIN norm USING (word) WHERE kind = 'title'),
sn AS (SELECT object_id, token AS surname FROM cw JOIN norm USING (word) WHERE kind = 'author' QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY len(token) DESC, token DESC) = 1)"""


def _titled(tokens: list[str]) -> str:
    return " AND ".join(f"object_id IN (SELECT object_id FROM tt WHERE token = '{t}')" for t in tokens)


_MENTIONS = """m AS (SELECT object_id, CAST(sum(n) AS INTEGER) AS score FROM (
  SELECT object_id, 1 AS n FROM tt WHERE token IN ({0}) UNION ALL SELECT object_id, 1 FROM sn WHERE surname IN ({0})) GROUP BY 1 HAVING sum(n) >= {1})"""
_CODE = "CAST(CAST(('0x' || md5({})) AS UHUGEINT) % 1000000007 AS INTEGER)"
_SECTION = f"""{_LINES},
l3 AS (SELECT line_id, trim(vals[4]) AS a, trim(vals[5]) AS b, trim(vals[6]) AS c FROM r WHERE len(reasons) = 0),
codes AS (SELECT line_id, 0 AS level, {_CODE.format('a')} AS section_code, a || ';' AS path FROM l3 WHERE a <> '' UNION ALL
  SELECT line_id, 1, {_CODE.format('a || b')}, a || ';' || b || ';' FROM l3 WHERE a <> '' AND b <> '' UNION ALL
  SELECT line_id, 2, {_CODE.format('a || b || c')}, a || ';' || b || ';' || c || ';' FROM l3 WHERE a <> '' AND b <> '' AND c <> '')"""

# ------------------------------------------------------------------------------------------------------ composition

_ONE = {0: WORDS[0]}
_TWO = {0: WORDS[0], 1: WORDS[1]}
_SNIPPETS = """, snip AS (SELECT t.*, s.field_id, f.text[s.seg_start + 1:s.seg_start + s.seg_length] AS snippet
  FROM top t JOIN segments s USING (segment_id) JOIN f ON f.object_id = t.object_id AND f.field_id = s.field_id),
sw_ AS (SELECT segment_id, snippet, regexp_extract_all(snippet, '([^%C]*)([%C]+|$)', 1) AS gaps, regexp_extract_all(snippet, '([^%C]*)([%C]+|$)', 2) AS ws FROM (SELECT DISTINCT segment_id, snippet FROM snip)),
sp AS (SELECT query_id, segment_id, list(pos) AS ps FROM inside GROUP BY 1, 2),
mk AS (SELECT query_id, segment_id, ps, ws, regexp_replace(replace(array_to_string(list_transform(range(1, len(ws) + 1), lambda k: gaps[k] || CASE WHEN list_contains(ps, CAST(k - 1 AS INTEGER)) AND ws[k] <> ''
  THEN '<b>' || ws[k] || '</b>' ELSE ws[k] END), ''), '"', ''''), '\\s+', ' ', 'g') AS marked FROM sw_ JOIN sp USING (segment_id))""".replace("%C", _C)

ORACLES |= {
    "tokenize": f"WITH {_TOKENS} SELECT * FROM t",
    "token_case": f"""WITH {_TOKENS} SELECT word, count(*) AS n, CASE WHEN regexp_matches(word, '^[{T.UPPER_CLASS}]') THEN 1 ELSE 0 END AS case_fast,
  CASE WHEN regexp_matches(word, '^[{T.UPPER_CLASS}]+$') THEN 2 WHEN regexp_matches(word, '^[{T.UPPER_CLASS}]') THEN 1 ELSE 0 END AS case_rich FROM t GROUP BY word""",
    "normalize_tokens": f"WITH {_TOKENS}, {_normal('t')} SELECT word, token FROM norm",
    "segments": f"WITH {_SEGMENTS} SELECT segment_id, object_id, field_id, segment_no, seg_start, seg_length FROM s",
    "segment_span": f"WITH {_SEGMENTS} SELECT object_id, field_id, segment_no, text[seg_start + 1:seg_start + seg_length] AS snippet FROM s JOIN f USING (object_id, field_id)",
    "occurrence_pack": "SELECT token, segment_id * 268435456 + object_id * 256 + pos * 4 + weight AS code FROM postings",
    "occurrence_unpack": """SELECT chunk_id, code, code // 268435456 AS segment_id, (code // 256) % 1048576 AS object_id, CAST((code // 4) % 64 AS INTEGER) AS pos,
  CAST(code % 4 AS INTEGER) AS weight FROM (SELECT chunk_id, unnest(token_codes) AS code FROM index_chunks)""",
    "lexicon": f"WITH {_INDEX} {_LEX}",
    "lexicon_pruned": f"WITH {_INDEX} {_LEX} {_KEPT}",
    "postings": f"WITH {_INDEX} SELECT * FROM o WHERE token IN (SELECT token FROM o GROUP BY token {_KEPT})",
    "object_segment_range": _RANGES,
    "segments_of_object": f"SELECT object_id, unnest(range(first_segment, end_segment)) AS segment_id FROM ({_RANGES})",
    "segment_owner_asof": f"SELECT p.segment_id, r.object_id FROM (SELECT DISTINCT segment_id FROM postings) p ASOF LEFT JOIN ({_RANGES}) r ON p.segment_id >= r.first_segment",
    "lexicon_top800": f"WITH {_ONCE} SELECT token, freq FROM lex ORDER BY freq DESC, token DESC LIMIT 800",
    "lexicon_freq_bands": f"""WITH {_ONCE} SELECT count(*) AS tokens, CAST(sum(freq) AS BIGINT) AS occurrences, count(*) FILTER (freq > 500000) AS above_500000,
  count(*) FILTER (freq > 1000000) AS above_1000000 FROM lex""",
    "index_stats": "SELECT max(object_id) AS max_object_id, count(*) AS segments FROM segments",
    "bigram_counts": f"WITH {_PAIRS} SELECT token, next_token, count(*) AS n FROM b GROUP BY ALL",
    "bigram_top20": f"""WITH {_PAIRS}, p AS (SELECT token, next_token, count(*) AS n FROM b GROUP BY ALL),
h AS (SELECT token FROM p GROUP BY token HAVING sum(n) BETWEEN 100 AND 10000000),
k AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY n DESC, next_token DESC) AS rank FROM p WHERE token IN (SELECT token FROM h))
SELECT token, list(next_token ORDER BY rank) AS next_tokens FROM k WHERE rank <= 20 GROUP BY token""",
    "query_terms": f"WITH {_keys(WORDS)} SELECT query_id, key_idx, token, freq, round(idf, 6) AS idf FROM known",
    "key_selection": f"WITH {_keys(WORDS)} {_KEY_COLUMNS}",
    "key_budget": f"WITH {_keys(WORDS, budget=3000, compat=True)} {_KEY_COLUMNS}",
    "segment_simple_weight": f"WITH {_search(WORDS, 0.0)} SELECT query_id, segment_id, object_id, uniq, round(weight, 6) AS weight FROM sw",
    "crude_filter": f"WITH {_search(WORDS)} SELECT query_id, segment_id, object_id, uniq, round(weight, 6) AS weight FROM sw",
    "segment_shortest_span": f"WITH {_search(WORDS)} SELECT query_id, segment_id, len, from_pos, to_pos FROM best",
    "segment_score": f"WITH {_search(WORDS)} SELECT query_id, segment_id, object_id, round(raw, 6) AS score FROM best",
    "object_score": f"WITH {_search(WORDS)} SELECT query_id, object_id, round(raw, 6) AS score, matches_count FROM obj",
    "search_top_objects": f"WITH {_search(_ONE)} {_PAGE.format(0, 10)}",
    "search_single_term": f"WITH {_search({1: WORDS[1]})} {_PAGE.format(0, 10)}",
    "search_filtered": f"WITH {_NEWEST}, {_search(_ONE, objects='SELECT object_id FROM c WHERE year >= 2000')} {_PAGE.format(0, 10)}",
    "search_page2": f"WITH {_search(_ONE)} {_PAGE.format(10, 20)}",
    "search_compat": f"WITH {_search(WORDS, compat=True)} {_PAGE.format(0, 10)}",
    "search_words": f"WITH {_search(WORDS)} {_PAGE.format(0, 10)}",
    "search_saved": f"WITH {_search(WORDS)} {_PAGE.format(0, 10)}",
    "search_batch": f"WITH {_search(_BATCH)} {_PAGE.format(0, 10)}",
    "span_occurrences": f"WITH {_refined(WORDS)} SELECT query_id, segment_id, pos, key_idx, token, weight FROM inside",
    "segment_relevance": f"WITH {_refined(WORDS)} SELECT query_id, object_id, segment_id, matched_words, round(relevance, 6) AS relevance FROM rel",
    "top_segments": f"WITH {_refined(WORDS)} SELECT query_id, object_id, segment_id, place, matched_words, round(relevance, 6) AS relevance FROM top WHERE place <= 3",
    "search_full": f"""WITH {_refined(WORDS)}, ws AS (SELECT query_id, segment_id, string_agg(token || ':' || pos, ' ' ORDER BY pos, weight, key_idx) AS words FROM inside GROUP BY 1, 2),
b100 AS (SELECT * FROM top WHERE place <= 100)
SELECT b.query_id, rank, b.object_id, CAST(max(place) OVER (PARTITION BY b.query_id, b.object_id) - place AS INTEGER) AS n, b.segment_id, matched_words, round(relevance, 6) AS relevance, words
FROM b100 b JOIN page p ON p.query_id = b.query_id AND p.object_id = b.object_id JOIN ws ON ws.query_id = b.query_id AND ws.segment_id = b.segment_id""",
    "catalogue_load": f'WITH {_NEWEST} SELECT object_id, title, author, udc, "year", pages_count, udc_key FROM c',
    "title_and": f"WITH {_WORDS} SELECT object_id FROM c WHERE {_titled(['splav', 'po'])}",
    "year_range": f'WITH {_NEWEST} SELECT object_id, "year" FROM c WHERE "year" BETWEEN 1990 AND 2010',
    "year_unknown": f'WITH {_NEWEST} SELECT object_id, "year" FROM c WHERE "year" <= 1950',
    "udc_prefix": f"WITH {_NEWEST} SELECT object_id, udc FROM c WHERE udc_key LIKE '|66|2|%' OR udc_key LIKE '|55|%'",
    "author_surname": f"WITH {_WORDS} SELECT object_id, author, coalesce(surname, '') AS surname FROM c LEFT JOIN sn USING (object_id)",
    "author_equal": f"WITH {_WORDS} SELECT object_id FROM sn WHERE surname = 'bulubansk'",
    "pages_range": f"WITH {_NEWEST} SELECT object_id, pages_count FROM c WHERE pages_count BETWEEN 100 AND 200",
    "lib_section_codes": f"{_SECTION} SELECT line_id, CAST(level AS INTEGER) AS level, section_code FROM codes",
    "lib_section_filter": f"WITH {_NEWEST} SELECT object_id FROM c WHERE list_contains(lib_sections, 418533012)",
    "section_collisions": f"{_SECTION} SELECT section_code, count(DISTINCT path) AS paths FROM codes GROUP BY 1 HAVING count(DISTINCT path) > 1",
    "facet_and": f"""WITH {_WORDS} SELECT object_id FROM c WHERE {_titled(['i'])} AND "year" >= 1980 AND pages_count <= 300""",
    "plain_catalogue": """WITH p AS (SELECT string_split(trim(raw_line, ' '), ';') AS v FROM catalogue_raw WHERE raw_line IS NOT NULL)
SELECT TRY_CAST(v[1] AS BIGINT) AS object_id, CASE WHEN regexp_full_match(trim(v[2]), '[+-]?[0-9]+') THEN coalesce(TRY_CAST(trim(v[2]) AS INTEGER), -1) ELSE -1 END AS "year", v[3] AS udc,
  CASE WHEN regexp_full_match(trim(v[7]), '[+-]?[0-9]+') THEN coalesce(TRY_CAST(trim(v[7]) AS INTEGER), -1) ELSE -1 END AS pages_count, v[8] AS author, v[9] AS title FROM p""",
    "mention_rank": f"WITH {_WORDS}, {_MENTIONS.format(chr(39) + 'bulubansk' + chr(39) + ', ' + chr(39) + 'teor' + chr(39) + ', ' + chr(39) + 'splav' + chr(39), 2)} SELECT object_id, score FROM m",
    "combined_search": f"""WITH {_WORDS}, {_MENTIONS.format(chr(39) + 'teor' + chr(39) + ', ' + chr(39) + 'splav' + chr(39), 2)},
allowed AS (SELECT object_id FROM c WHERE "year" >= 1960),
{_search({0: ['teoriya', 'splav']}, objects='SELECT object_id FROM allowed')},
both_ AS (SELECT 0 AS tier, object_id, 0.0 AS score, 0 AS matches_count, row_number() OVER (ORDER BY score DESC, object_id DESC) AS k FROM m WHERE object_id IN (SELECT object_id FROM allowed)
  UNION ALL SELECT 1, object_id, round(raw, 6), matches_count, rank + (SELECT count(*) FROM m WHERE object_id IN (SELECT object_id FROM allowed)) FROM ranked)
SELECT g AS "start", CAST(k - 1 AS INTEGER) AS position, tier, object_id, score, matches_count, (SELECT count(*) FROM both_) AS total FROM both_ CROSS JOIN (VALUES (0), (8)) v(g) WHERE k > g AND k <= g + 8""",
    "snippets": f"WITH {FIRST_LOADS}, {_refined(_TWO)}{_SNIPPETS} SELECT query_id, object_id, place - 1 AS place, field_id, segment_id, snippet FROM snip WHERE place <= 2",
    "highlight": f"WITH {FIRST_LOADS}, {_refined(_TWO)}{_SNIPPETS} SELECT query_id, object_id, place - 1 AS place, marked FROM snip JOIN mk USING (query_id, segment_id) WHERE place <= 2",
    "digest": f"""WITH {FIRST_LOADS}, {_NEWEST}, {_refined({0: ['the', 'of']}, 100)}{_SNIPPETS}
SELECT query_id, CAST(len(list_filter(ps, lambda p: regexp_matches(ws[p + 1], '^[{T.UPPER_CLASS}]'))) AS INTEGER) AS cases, round(relevance, 6) AS relevance, marked, snip.object_id, segment_id,
  '[' || trim(coalesce(author, '')) || ' ' || coalesce(title, '') || ']' AS book
FROM snip JOIN mk USING (query_id, segment_id) JOIN c ON c.object_id = snip.object_id
WHERE place <= 100 AND len(ps) >= 2 AND list_max(ps) - list_min(ps) + 1 <= 3""",
    "service_json": f"""WITH {_WORDS}, {_MENTIONS.format(chr(39) + 'splav' + chr(39) + ', ' + chr(39) + 'na' + chr(39), 2)}, {FIRST_LOADS},
allowed AS (SELECT object_id FROM c WHERE "year" >= 1960),
{_refined({0: ['splav', 'na']}, 100, objects='SELECT object_id FROM allowed')}{_SNIPPETS},
named AS (SELECT object_id, row_number() OVER (ORDER BY score DESC, object_id DESC) AS k FROM m WHERE object_id IN (SELECT object_id FROM allowed)),
joined AS (SELECT object_id, 0.0 AS score, 0 AS matches_count, k, 0 AS tier FROM named
  UNION ALL SELECT object_id, raw, matches_count, rank + (SELECT count(*) FROM named), 1 FROM ranked),
shown AS (SELECT snip.object_id, list(marked ORDER BY place) AS snippets FROM snip JOIN mk USING (query_id, segment_id) WHERE place <= 2 GROUP BY 1)
SELECT (SELECT count(*) FROM joined) AS total, CAST(k - 1 AS INTEGER) AS result_index, lpad(CAST(j.object_id AS VARCHAR), 6, '0') AS id, title, round(j.score, 6) AS cumul_relev,
  matches_count AS segments_matched, CASE WHEN tier = 0 THEN CAST([] AS VARCHAR[]) ELSE snippets END AS snippets
FROM joined j JOIN c USING (object_id) LEFT JOIN shown USING (object_id) WHERE k > 2 AND k <= 10""",
}
ORACLES["bigram_sink"] = ORACLES["bigram_top20"]

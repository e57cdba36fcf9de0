"""The SQL that checks this package's queries, where SQL can express them."""

_SPACE = r"[\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_TERM = f"lower(trim(regexp_replace(t, '{_SPACE}', ' ', 'g')))"
_TRIM = f"regexp_replace(regexp_replace(t, '^{_SPACE}', ''), '{_SPACE}$', '')"

_TERMS = f"""
WITH long AS (
  SELECT 'domain' AS field_name, node_idx, unnest(domain) AS t FROM llm_extraction_results
  UNION ALL SELECT 'task', node_idx, unnest(task) FROM llm_extraction_results
  UNION ALL SELECT 'method', node_idx, unnest(method) FROM llm_extraction_results),
c AS (
  SELECT field_name, {_TERM} AS term, count(*) AS uses, count(DISTINCT node_idx) AS records FROM long
  WHERE node_idx IS NOT NULL AND t IS NOT NULL AND {_TERM} <> '' GROUP BY ALL),
m AS (
  SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records * 10 > (SELECT count(DISTINCT node_idx) FROM llm_extraction_results) THEN 'common' END AS mark FROM c)
"""

_PAIRS = f"""
WITH long AS (
  SELECT 'authors' AS field_name, node_idx, {_TRIM} AS item FROM (SELECT node_idx, unnest(authors) AS t FROM author_data_openalex)
  UNION ALL SELECT 'method', node_idx, {_TERM} FROM (SELECT node_idx, unnest(method) AS t FROM llm_extraction_results)),
i AS (SELECT DISTINCT * FROM long WHERE node_idx IS NOT NULL AND item IS NOT NULL AND item <> ''),
n AS (SELECT 'authors' AS field_name, count(DISTINCT node_idx) AS n FROM author_data_openalex UNION ALL SELECT 'method', count(DISTINCT node_idx) FROM llm_extraction_results),
k AS (SELECT field_name, item, count(*) AS c FROM i GROUP BY ALL),
p AS (SELECT a.field_name, a.item AS item_a, b.item AS item_b, count(*) AS shared FROM i a JOIN i b ON a.field_name = b.field_name AND a.node_idx = b.node_idx AND a.item < b.item GROUP BY ALL),
f AS (SELECT p.*, ka.c AS count_a, kb.c AS count_b, n.n FROM p JOIN k ka ON ka.field_name = p.field_name AND ka.item = item_a JOIN k kb ON kb.field_name = p.field_name AND kb.item = item_b JOIN n ON n.field_name = p.field_name)
"""

_SOURCE = f"nullif(lower(trim(regexp_replace(source, '{_SPACE}', ' ', 'g'))), '')"
_SEATS = f"""
WITH h AS (SELECT {_SOURCE} AS source, count(*) AS n FROM documents GROUP BY 1),
t AS (SELECT m.source, target_share, max_repeats, coalesce(n, 0) AS n FROM (SELECT {_SOURCE} AS source, target_share, max_repeats FROM mix_targets) m LEFT JOIN h ON h.source = m.source),
q AS (SELECT source, target_share / (2 * k + 1) AS quotient, k FROM (SELECT source, target_share, unnest(range(0, n * max_repeats)) AS k FROM t)),
r AS (SELECT source, row_number() OVER (ORDER BY quotient DESC, source) AS rk FROM q)
SELECT t.source, count(r.rk) AS seats FROM t LEFT JOIN r ON r.source = t.source AND rk <= (SELECT sum(n) FROM t) GROUP BY t.source"""

def _word_list(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(regexp_replace({text}, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def _letter_pairs(words: str) -> str:
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(0, length(w) + 1), lambda i: substr('^' || w || '$', i + 1, 2)))))"


_CANONICAL = f"""
WITH c0 AS (SELECT node_index, unnest(topk_candidates) AS c, generate_subscripts(topk_candidates, 1) AS cand_no FROM topic_prediction_results),
c1 AS (SELECT node_index, cand_no, c.category AS category, c.label_idx AS own FROM c0 QUALIFY row_number() OVER (PARTITION BY node_index, cand_no ORDER BY c.category NULLS FIRST, c.label_idx NULLS FIRST) = 1),
c AS (SELECT * FROM c1 WHERE category IS NULL OR category NOT IN (SELECT category FROM labelidx2category WHERE category IS NOT NULL)),
v AS (SELECT category, ws, {_letter_pairs('ws')} AS x FROM (SELECT category, {_word_list('category')} AS ws FROM (SELECT DISTINCT category FROM c WHERE category IS NOT NULL))),
e AS (SELECT label_idx, fs, {_letter_pairs('fs')} AS y FROM (SELECT DISTINCT label_idx, {_word_list('form')} AS fs FROM (SELECT label_idx, unnest([category, short_code]) AS form FROM labelidx2category) WHERE form IS NOT NULL)),
j AS (SELECT category, label_idx, ws, fs, len(list_intersect(x, y)) AS s, len(x) + len(y) AS t FROM v, e WHERE len(x) > 0 AND len(y) > 0),
k AS (SELECT category, label_idx, s / (t - s) AS jaccard FROM j WHERE s / (t - s) >= 0.4 - 1e-12 AND (
  len(list_filter(fs, lambda r: len(list_filter(ws, lambda w: w = r OR (length(w) >= 2 AND starts_with(r, w)) OR levenshtein(w, r) <= ceil(length(r) * 0.4))) = 0)) = 0
  OR levenshtein(array_to_string(ws, ''), array_to_string(fs, '')) <= ceil(length(array_to_string(fs, '')) * 0.2))),
b AS (SELECT category, label_idx FROM k QUALIFY row_number() OVER (PARTITION BY category ORDER BY jaccard DESC, label_idx) = 1),
o AS (SELECT c.node_index, c.cand_no, c.category, CAST(CASE WHEN c.category IS NULL OR regexp_full_match(c.category, '{_SPACE[:-1]}*')
  THEN CASE WHEN own IN (SELECT label_idx FROM labelidx2category) THEN own ELSE -1 END ELSE coalesce(b.label_idx, -1) END AS INTEGER) AS label_idx FROM c LEFT JOIN b ON b.category = c.category)
"""

SQL = {
    "p3_found": _CANONICAL + "SELECT node_index, CAST(cand_no AS INTEGER) AS cand_no, label_idx FROM o",
    "p3_unmatched": _CANONICAL + "SELECT category, count(*) AS n_candidates FROM o WHERE label_idx = -1 GROUP BY category",
    "p8_seats": _SEATS,
    "p1_found": _TERMS + "SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL",
    "p1_term_counts": _TERMS + "SELECT field_name, term, uses, records, mark FROM m",
    "p2_found": _PAIRS + "SELECT field_name, item_a, item_b FROM f WHERE shared >= 5 AND n * shared >= 3 * count_a * count_b",
    "p2_pair_counts": _PAIRS + "SELECT field_name, item_a, item_b, shared, count_a, count_b, CAST(n * shared AS DOUBLE) / (count_a * count_b) AS lift FROM f",
}

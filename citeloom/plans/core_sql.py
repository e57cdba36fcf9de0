"""The SQL that checks the queries of the reference's operators."""

from __future__ import annotations

from citeloom.functions.text import STOP_WORDS

_NUMBER = "CAST(CAST(trim(paper_id) AS DECIMAL(38,10)) AS BIGINT)"
_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _clean(text: str) -> str:
    return f"regexp_replace(lower(coalesce({text}, '')), '[^a-z\\s]', '', 'g')"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({_clean(text)}, '\\s+'), lambda w: length(w) >= 2)"


def _tokens(text: str) -> str:
    return f"list_filter({_words(text)}, lambda w: NOT list_contains({_STOPS}, w))"


_PAPERS = f"""papers AS (
  SELECT paper, s.title AS title, s.abstract AS abstract FROM (
    SELECT {_NUMBER} AS paper, max({{'at': loaded_at, 'title': coalesce(title, chr(0)), 'abstract': coalesce(abstract, chr(0))}}) AS x FROM titleabs WHERE {_NUMBER} IS NOT NULL GROUP BY 1),
    LATERAL (SELECT {{'title': nullif(x.title, chr(0)), 'abstract': nullif(x.abstract, chr(0))}} AS s))"""


def _tfidf(source: str, key: str) -> str:
    return f"""t AS (SELECT {key}, unnest({_tokens('text')}) AS term FROM {source}),
n AS (SELECT count(*) AS n FROM {source}),
v AS (SELECT term, count(DISTINCT {key}) AS df, count(*) AS cf FROM t GROUP BY term HAVING count(DISTINCT {key}) >= 2 AND count(DISTINCT {key}) <= 0.95 * (SELECT n FROM n) ORDER BY cf DESC, term LIMIT 5000),
s AS (SELECT {key}, t.term, count(*) * (ln((1 + (SELECT n FROM n)) / (1 + v.df)) + 1) AS score FROM t JOIN v ON v.term = t.term GROUP BY {key}, t.term, v.df),
k AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY round(score, 9) DESC, term) AS rk, term, round(score, 6) AS score FROM s QUALIFY rk <= 3)"""


_KEYWORDS = """kw0 AS (
  SELECT node_idx AS item_id, 'domain' AS field, unnest(domain) AS t FROM llm_extraction_results UNION ALL
  SELECT node_idx, 'task', unnest(task) FROM llm_extraction_results UNION ALL
  SELECT node_idx, 'method', unnest(method) FROM llm_extraction_results),
kw AS (SELECT DISTINCT item_id, field, lower(trim(t, ' ')) AS keyword FROM kw0 WHERE item_id IS NOT NULL AND t IS NOT NULL AND trim(t, ' ') <> '')"""

_USERS = _KEYWORDS + """,
ar AS (SELECT DISTINCT node_idx, authors FROM author_data_openalex WHERE node_idx IS NOT NULL),
an AS (SELECT node_idx, pos, trim(authors[pos], ' ') AS author_name FROM (SELECT node_idx, authors, unnest(range(1, len(authors) + 1)) AS pos FROM ar)
  WHERE authors[pos] IS NOT NULL AND trim(authors[pos], ' ') <> '' AND node_idx IN (SELECT item_id FROM kw)),
reg AS (SELECT CAST(row_number() OVER (ORDER BY s.n, s.p, author_name) - 1 AS BIGINT) AS user_id, author_name FROM (SELECT author_name, min({'n': node_idx, 'p': pos}) AS s FROM an GROUP BY author_name)),
ui AS (SELECT user_id, node_idx AS item_id, count(*) AS n FROM an JOIN reg USING (author_name) GROUP BY ALL)"""

_MAP = f"m AS (SELECT DISTINCT node_idx, {_NUMBER} AS paper FROM nodeidx2paperid)"


def _edges(where: str = "true") -> str:
    return f"""e0 AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem WHERE {where}),
e AS (SELECT src, dst, count(*) AS multiplicity FROM e0 WHERE dst IS NOT NULL AND src IS NOT NULL GROUP BY ALL)"""


_NEAR = """near AS (SELECT idx, pos, neighbor FROM (SELECT idx, neighbor, row_number() OVER (PARTITION BY idx ORDER BY side, neighbor) AS pos FROM
  (SELECT src AS idx, 0 AS side, dst AS neighbor FROM e UNION ALL SELECT dst, 1, src FROM e)) WHERE pos <= 50),
lab AS (SELECT p_partkey AS idx, dense_rank() OVER (ORDER BY p_brand) - 1 AS label_idx, p_size FROM part),
dist AS (SELECT idx, label_idx, count(*) AS cnt, sum(count(*)) OVER (PARTITION BY idx) AS total, row_number() OVER (PARTITION BY idx ORDER BY count(*) DESC, label_idx) AS rk
  FROM (SELECT near.idx, lab.label_idx FROM near JOIN lab ON lab.idx = near.neighbor AND p_size <= 25) GROUP BY idx, label_idx)"""

_SCORED = """sc AS (SELECT node_index, CAST(true_label_idx AS BIGINT) AS true_idx, CAST(c[1].label_idx AS BIGINT) AS pred_idx,
  coalesce(c[1].label_idx = true_label_idx, false) AS top1, coalesce(list_contains(list_transform(c[1:3], lambda x: x.label_idx), true_label_idx), false) AS top3
  FROM (SELECT DISTINCT node_index, true_label_idx, topk_candidates AS c FROM topic_prediction_results WHERE true_label_idx IS NOT NULL))"""


def _ranking(direction: str, seen: bool, user: str) -> str:
    hidden = "WHERE NOT EXISTS (SELECT 1 FROM final_user_interactions i WHERE i.user_id = q.query_id AND i.item_id = b.item_id)" if seen else ""
    return f"""WITH {_KEYWORDS},
bag AS (SELECT item_id, keyword, sum(CASE WHEN field = 'domain' THEN 2 ELSE 1 END) AS weight FROM kw GROUP BY ALL),
prof AS (SELECT DISTINCT user_id AS query_id, lower(trim(t, ' ')) AS keyword FROM (SELECT user_id, unnest(top_keywords) AS t FROM final_user_profiles WHERE user_id % 100 = 0) WHERE t IS NOT NULL AND trim(t, ' ') <> ''),
qn AS (SELECT query_id, sqrt(count(*)) AS norm FROM prof GROUP BY query_id),
bn AS (SELECT item_id, sqrt(sum(weight * weight)) AS norm FROM bag GROUP BY item_id),
hit AS (SELECT query_id, item_id, sum(weight) AS dot FROM prof JOIN bag USING (keyword) GROUP BY ALL),
s AS (SELECT q.query_id, b.item_id, (coalesce(dot / (q.norm * b.norm), 0) + 1) / 2 AS score FROM qn q CROSS JOIN bn b LEFT JOIN hit h ON h.query_id = q.query_id AND h.item_id = b.item_id {hidden})
SELECT query_id AS {user}, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) {direction}, item_id) AS rk, item_id, round(score, 6) AS score FROM s QUALIFY rk <= 5"""


_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"

_DRAWS = """p AS (SELECT DISTINCT user_id, item_id FROM final_user_interactions WHERE user_id IS NOT NULL AND item_id IS NOT NULL),
        i AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS number FROM (SELECT DISTINCT item_id FROM p)),
        d AS (SELECT user_id, item_id AS src, unnest(range(0, 8)) AS j FROM p),
        x AS (SELECT d.user_id, d.src, j, i.item_id FROM d JOIN i ON i.number = (d.user_id * 7919 + d.src * 104729 + j * 1299709 + 17) % (SELECT count(*) FROM i)),
        k AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = x.user_id AND p.item_id = x.item_id) QUALIFY row_number() OVER (PARTITION BY user_id, src ORDER BY j) <= 4)"""

_TOPIC_TEXT = """l AS (SELECT string_agg(category || ': ' || coalesce(description, 'no description'), chr(10) ORDER BY label_idx) AS listed, max(label_idx) + 1 AS n_labels FROM labelidx2category),
        rq AS (SELECT node_index, n_labels, min('Choose the best categories for the paper.' || chr(10) || 'Categories:' || chr(10) || listed || chr(10) || 'Title: ' || coalesce(title, '') || chr(10) || 'Abstract: ' || coalesce(abstract, '') || coalesce(chr(10) || 'Citation context: ' || citation_context, '')) AS text
          FROM topic_prediction_results, l WHERE NOT contains(coalesce(abstract, ''), 'ERROR') GROUP BY ALL),
        an AS (SELECT node_index, k + 1 AS rk, (CAST('0x' || substr(md5(text), 1, 8) AS BIGINT) + 7 * k) % n_labels AS label_idx FROM rq, (SELECT unnest(range(0, 3)) AS k))"""
_PENDING = f"""{_PAPERS}, {_MAP}, tx AS (SELECT node_idx, max(substr(coalesce(title, '') || ' ' || coalesce(abstract, ''), 1, 2000)) AS text FROM m JOIN papers USING (paper)
          WHERE node_idx IS NOT NULL AND node_idx NOT IN (SELECT node_idx FROM llm_extraction_results WHERE status = 'success' AND node_idx IS NOT NULL) GROUP BY node_idx),
        jb AS (SELECT node_idx, text, CASE WHEN NOT regexp_matches(text, '\\S') THEN 'missing' WHEN md5(text)[1] = '0' THEN 'failed' ELSE 'success' END AS status FROM tx)"""
_PHRASES = """pr AS (SELECT node_index AS prompt_id, min(title) AS text FROM topic_prediction_results WHERE node_index % 100 = 0 GROUP BY 1),
        wd AS (SELECT prompt_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM pr),
        ph AS (SELECT DISTINCT prompt_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')), list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS keyword FROM wd)"""


def _cost(calls: str) -> str:
    return f"""c AS (SELECT count(*) AS calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS i, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS o FROM {calls}),
        a AS (SELECT *, coalesce(CAST(i AS DOUBLE) / nullif(calls, 0), 0) AS ai, coalesce(CAST(o AS DOUBLE) / nullif(calls, 0), 0) AS ao FROM c),
        cs AS (SELECT calls, i AS total_input_tokens, o AS total_output_tokens, i + o AS total_tokens, round(ai, 6) AS avg_input_tokens, round(ao, 6) AS avg_output_tokens,
        round(ai * CAST(16000 AS DOUBLE), 3) AS projected_input_tokens, round(ao * CAST(16000 AS DOUBLE), 3) AS projected_output_tokens,
        round(ai * 16000e0 / 1e6 * 0.15e0, 6) AS projected_input_cost, round(ao * 16000e0 / 1e6 * 0.6e0, 6) AS projected_output_cost, round(ai * 16000e0 / 1e6 * 0.15e0 + ao * 16000e0 / 1e6 * 0.6e0, 6) AS projected_cost FROM a)"""


def _shown(direction: str) -> str:
    return f"""WITH r AS (SELECT * FROM ({_ranking(direction, True, 'user_id')})), {_KEYWORDS}, {_PAPERS}, {_MAP},
        ti AS (SELECT node_idx AS item_id, min(title) AS title FROM m JOIN papers USING (paper) WHERE title IS NOT NULL GROUP BY 1),
        au AS (SELECT node_idx AS item_id, min(authors_str) AS authors_str FROM (
          SELECT node_idx, CASE WHEN len(a) > 3 THEN array_to_string(a[1:3], ', ') || '...' WHEN len(a) > 0 THEN array_to_string(a, ', ') ELSE 'Unknown Authors' END AS authors_str
          FROM (SELECT node_idx, list_filter(authors, lambda x: x IS NOT NULL AND trim(x, ' ') <> '') AS a FROM author_data_openalex WHERE node_idx IS NOT NULL)) GROUP BY 1),
        po AS (SELECT DISTINCT user_id, lower(trim(t, ' ')) AS keyword FROM (SELECT user_id, unnest(top_keywords) AS t FROM final_user_profiles WHERE user_id % 100 = 0) WHERE t IS NOT NULL),
        ma AS (SELECT r.user_id, r.item_id, string_agg(DISTINCT kw.keyword, ', ' ORDER BY kw.keyword) AS matches FROM r JOIN kw ON kw.item_id = r.item_id JOIN po ON po.user_id = r.user_id AND po.keyword = kw.keyword GROUP BY ALL)
        SELECT r.user_id, r.rk, r.item_id, r.score, printf('%.1f%%', round(r.score * 100, 1)) AS score_percent, coalesce(title, 'Title Not Found') AS title, coalesce(authors_str, 'Unknown Authors') AS authors_str, coalesce(matches, '') AS matches
        FROM r LEFT JOIN ti ON ti.item_id = r.item_id LEFT JOIN au ON au.item_id = r.item_id LEFT JOIN ma ON ma.user_id = r.user_id AND ma.item_id = r.item_id"""


SQL = {
    "id_cardinality": "SELECT 'user_id' AS column_name, CAST(coalesce(max(user_id) + 1, 0) AS BIGINT) AS cardinality FROM final_user_interactions UNION ALL SELECT 'item_id', CAST(coalesce(max(item_id) + 1, 0) AS BIGINT) FROM final_user_interactions",
    "id_batches": "SELECT n // 40 AS batch_no, string_agg(paper_id, '|' ORDER BY paper_id) AS ids FROM (SELECT paper_id, row_number() OVER (ORDER BY paper_id) - 1 AS n FROM (SELECT DISTINCT trim(paper_id, ' ') AS paper_id FROM nodeidx2paperid) WHERE paper_id <> '') GROUP BY 1",
    "cost_report": f"""WITH {_cost("llm_extraction_results WHERE status = 'success'")},
        ln AS (SELECT unnest([{{'n': 'Calls', 'v': format('{{:,}}', calls)}}, {{'n': 'Input tokens', 'v': format('{{:,}}', total_input_tokens)}}, {{'n': 'Output tokens', 'v': format('{{:,}}', total_output_tokens)}}, {{'n': 'All tokens', 'v': format('{{:,}}', total_tokens)}},
          {{'n': 'Projected input tokens', 'v': format('{{:,}}', CAST(floor(projected_input_tokens) AS BIGINT))}}, {{'n': 'Projected output tokens', 'v': format('{{:,}}', CAST(floor(projected_output_tokens) AS BIGINT))}},
          {{'n': 'Projected input cost', 'v': printf('$%.4f', projected_input_cost)}}, {{'n': 'Projected output cost', 'v': printf('$%.4f', projected_output_cost)}}, {{'n': 'Projected cost', 'v': printf('$%.4f', projected_cost)}},
          {{'n': 'Share of input in cost', 'v': printf('%.2f%%', coalesce(projected_input_cost / nullif(projected_cost, 0), 0) * 100)}}]) AS x, unnest(range(1, 11)) AS line_no FROM cs)
        SELECT line_no, printf('%02d ', line_no) || x.n || ': ' || x.v AS line FROM ln""",
    "prompt_keywords": f"WITH {_PHRASES} SELECT prompt_id, keyword FROM ph",
    "prompt_ranking": f"""WITH {_KEYWORDS}, {_PHRASES},
        bag AS (SELECT item_id, keyword, sum(CASE WHEN field = 'domain' THEN 2 ELSE 1 END) AS weight FROM kw GROUP BY ALL),
        kn AS (SELECT DISTINCT prompt_id, trim(keyword, ' ') AS keyword FROM ph WHERE trim(keyword, ' ') IN (SELECT keyword FROM bag)),
        qn AS (SELECT prompt_id, sqrt(count(kn.keyword)) AS norm FROM (SELECT DISTINCT prompt_id FROM ph) LEFT JOIN kn USING (prompt_id) GROUP BY prompt_id),
        bn AS (SELECT item_id, sqrt(sum(weight * weight)) AS norm FROM bag GROUP BY item_id),
        hit AS (SELECT prompt_id, item_id, sum(weight) AS dot FROM kn JOIN bag USING (keyword) GROUP BY ALL),
        s AS (SELECT q.prompt_id, b.item_id, (coalesce(dot / nullif(q.norm * b.norm, 0), 0) + 1) / 2 AS score FROM qn q CROSS JOIN bn b LEFT JOIN hit h ON h.prompt_id = q.prompt_id AND h.item_id = b.item_id)
        SELECT prompt_id, row_number() OVER (PARTITION BY prompt_id ORDER BY round(score, 9) DESC, item_id) AS rk, item_id, round(score, 6) AS score FROM s QUALIFY rk <= 5""",
    "recommend_shown": _shown("DESC"),
    "recommend_bottom_shown": _shown("ASC"),
    "parse_usage": "SELECT node_idx, coalesce(input_tokens, 0) AS input_tokens, coalesce(output_tokens, 0) AS output_tokens FROM (SELECT DISTINCT node_idx, input_tokens, output_tokens FROM llm_extraction_results)",
    "enrichment_job": f"WITH {_PENDING} SELECT node_idx, status, CASE WHEN status = 'success' THEN length(text) // 4 ELSE 0 END AS input_tokens, CASE WHEN status = 'success' THEN length(text) // 16 ELSE 0 END AS output_tokens FROM jb",
    "enrichment_costing": f"WITH {_PENDING}, fi AS (SELECT * FROM jb ORDER BY node_idx LIMIT 100), ok AS (SELECT length(text) // 4 AS input_tokens, length(text) // 16 AS output_tokens FROM fi WHERE status = 'success'), {_cost('ok')} SELECT * FROM cs",
    "enrich_until_fatal": f"""WITH {_PENDING}, st AS (SELECT node_idx, CASE WHEN md5(text)[1:2] = '77' THEN 'fatal' ELSE status END AS status FROM jb WHERE status <> 'missing')
        SELECT node_idx, status FROM st WHERE node_idx <= coalesce((SELECT min(node_idx) FROM st WHERE status = 'fatal'), node_idx)""",
    "classify_offline": f"WITH {_TOPIC_TEXT} SELECT node_index AS node_idx, rk, label_idx FROM an",
    "classify_evaluate": f"""WITH {_TOPIC_TEXT}, tr AS (SELECT node_index, min(true_label_idx) AS t FROM topic_prediction_results GROUP BY 1),
        ev AS (SELECT tr.node_index, coalesce(bool_or(label_idx = t AND rk = 1), false) AS a, coalesce(bool_or(label_idx = t), false) AS b FROM tr JOIN an USING (node_index) WHERE t IS NOT NULL GROUP BY 1)
        SELECT count(*) AS n, round(count(*) FILTER (WHERE a) / count(*), 6) AS top1_acc, round(count(*) FILTER (WHERE b) / count(*), 6) AS top3_acc, count(*) FILTER (WHERE NOT b) AS n_miss, round(count(*) FILTER (WHERE NOT b) / count(*), 6) AS miss_rate FROM ev""",
    "training_negatives": f"""WITH {_DRAWS},
        s AS (SELECT p.user_id, p.item_id AS src, unnest(range(coalesce(n, 0) + 1, 5)) AS i FROM p LEFT JOIN (SELECT user_id, src, count(*) AS n FROM k GROUP BY ALL) c ON c.user_id = p.user_id AND c.src = p.item_id),
        u AS (SELECT a.user_id, i.item_id, row_number() OVER (PARTITION BY a.user_id ORDER BY i.item_id) - 1 AS place, count(*) OVER (PARTITION BY a.user_id) AS unseen
          FROM (SELECT DISTINCT user_id FROM s) a CROSS JOIN i WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = a.user_id AND p.item_id = i.item_id)),
        f AS (SELECT s.user_id, s.src, u.item_id FROM s JOIN u ON u.user_id = s.user_id AND u.place = CAST('0x' || substr(md5(concat_ws(':', s.user_id, s.src, s.i, 17)), 1, 15) AS BIGINT) % u.unseen)
        SELECT user_id, src AS "of", item_id FROM k UNION ALL SELECT user_id, src, item_id FROM f""",
    "clean_tokens": f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {_words('text')} AS w FROM documents)",
    "tfidf_vocab": f"WITH {_tfidf('documents', 'doc_id')} SELECT term, df, cf FROM v",
    "tfidf_top3": f"WITH {_tfidf('documents', 'doc_id')} SELECT doc_id, rk, term, score FROM k",
    "tfidf_paper_keywords": f"WITH {_PAPERS}, p AS (SELECT paper, coalesce(title, '') || ' ' || coalesce(abstract, '') AS text FROM papers), {_tfidf('p', 'paper')} SELECT paper, rk, term, score FROM k",
    "title_abstract_split": f"WITH {_PAPERS} SELECT paper, coalesce(title, '') AS title, length(coalesce(abstract, '')) AS n_abstract_chars, length('Title: ' || coalesce(title, '') || chr(10) || 'Abstract: ' || coalesce(abstract, '')) AS n_labelled_chars FROM papers",
    "strip_abstract_marker": "SELECT doc_id, length('Abstract ' || text) AS n_before, length(trim(regexp_replace('Abstract ' || text, 'Abstract', ''), ' ')) AS n_after FROM documents WHERE text IS NOT NULL",
    "prompt_truncate": "SELECT doc_id, length(substr(text, 1, 2000)) AS prompt_chars, length(text) > 2000 AS was_cut FROM documents WHERE text IS NOT NULL",
    "topic_prompts": """WITH l AS (SELECT string_agg(category || ': ' || coalesce(description, 'no description'), chr(10) ORDER BY label_idx) AS listed FROM labelidx2category)
        SELECT node_index, length('Choose the best categories for the paper.' || chr(10) || 'Categories:' || chr(10) || listed || chr(10) || 'Title: ' || coalesce(title, '') || chr(10) || 'Abstract: ' || coalesce(abstract, '') || coalesce(chr(10) || 'Citation context: ' || citation_context, '')) AS n_chars
        FROM (SELECT DISTINCT node_index, title, abstract, citation_context FROM topic_prediction_results), l""",
    "author_coverage": """WITH c AS (SELECT node_idx, bool_or(coalesce(len(list_filter(authors, lambda a: a IS NOT NULL AND trim(a, ' ') <> '')) > 0, false)) AS found FROM author_data_openalex WHERE node_idx IS NOT NULL GROUP BY node_idx)
        SELECT count(*) AS total, count(*) FILTER (WHERE found) AS found, round(count(*) FILTER (WHERE found) / count(*), 6) AS found_ratio FROM c""",
    "user_registry": f"WITH {_USERS} SELECT user_id, author_name FROM reg",
    "user_interactions": f"WITH {_USERS} SELECT user_id, item_id, n FROM ui",
    "user_top5_keywords": f"""WITH {_USERS}, o AS (SELECT node_idx AS item_id, no, lower(trim(l[ix], ' ')) AS keyword, ix FROM (SELECT node_idx, no, l, unnest(range(1, len(l) + 1)) AS ix FROM (
          SELECT node_idx, 0 AS no, domain AS l FROM llm_extraction_results UNION ALL SELECT node_idx, 1, task FROM llm_extraction_results UNION ALL SELECT node_idx, 2, method FROM llm_extraction_results))),
        fp AS (SELECT item_id, keyword, min(no * 4294967296 + ix) AS pos FROM o WHERE item_id IS NOT NULL AND keyword <> '' GROUP BY ALL),
        c AS (SELECT user_id, keyword, CAST(sum(n) AS BIGINT) AS cnt, min({{'item_id': item_id, 'pos': pos}}) AS f FROM ui JOIN fp USING (item_id) GROUP BY user_id, keyword)
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, f.item_id, f.pos, keyword) AS rk, keyword, cnt FROM c QUALIFY rk <= 5""",
    "user_paper_counts": f"WITH {_USERS} SELECT user_id, CAST(sum(n) AS BIGINT) AS total_papers FROM ui GROUP BY user_id",
    "heavy_users": """WITH c AS (SELECT user_id, count(*) AS cnt FROM final_user_interactions WHERE user_id IS NOT NULL GROUP BY user_id)
        SELECT * FROM c WHERE cnt >= 5 OR (SELECT max(cnt) FROM c) < 5""",
    "interaction_stats": "SELECT count(DISTINCT user_id) AS n_users, count(user_id) AS n_interactions, round(count(user_id) / count(DISTINCT user_id), 6) AS mean_per_user FROM final_user_interactions",
    "dense_reindex": "SELECT item_id, row_number() OVER (ORDER BY f NULLS FIRST, item_id) - 1 AS item_no FROM (SELECT item_id, min(created_at) AS f FROM final_user_interactions WHERE item_id IS NOT NULL GROUP BY item_id)",
    "interaction_keywords": """SELECT keyword, count(*) AS n FROM (SELECT unnest(list_transform(regexp_extract_all(coalesce(keywords, ''), '''([^'']*)''|"([^"]*)"'), lambda x: substr(x, 2, length(x) - 2))) AS keyword FROM final_user_interactions) GROUP BY keyword""",
    "semi_join_sample": f"WITH {_PAPERS}, {_MAP} SELECT paper, length(title) AS n_title_chars FROM papers WHERE paper IN (SELECT paper FROM m)",
    "anti_join_resume": "SELECT DISTINCT node_idx FROM nodeidx2paperid WHERE node_idx IS NOT NULL AND node_idx NOT IN (SELECT node_idx FROM llm_extraction_results WHERE status = 'success' AND node_idx IS NOT NULL)",
    "node_paper_text": f"WITH {_PAPERS}, {_MAP} SELECT node_idx, paper, length(concat_ws(' ', title, abstract)) AS n_chars FROM m JOIN papers USING (paper) WHERE length(concat_ws(' ', title, abstract)) > 0",
    "left_join_default": f"WITH {_PAPERS}, {_MAP} SELECT node_idx, paper, coalesce(title, 'Title Not Found') AS title FROM m LEFT JOIN papers USING (paper)",
    "first_match_lookup": "SELECT item_id, paper_id FROM final_user_interactions WHERE item_id IS NOT NULL AND paper_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY created_at NULLS FIRST, paper_id) = 1",
    "item_titles": f"""WITH {_PAPERS}, f AS (SELECT item_id, paper_id FROM final_user_interactions WHERE item_id IS NOT NULL AND paper_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY created_at NULLS FIRST, paper_id) = 1)
        SELECT item_id, p.paper, coalesce(title, 'Title Not Found') AS title FROM (SELECT item_id, {_NUMBER} AS paper FROM f) p LEFT JOIN papers ON papers.paper = p.paper""",
    "last_match_lookup": "SELECT item_id, paper_id FROM final_user_interactions WHERE item_id IS NOT NULL AND paper_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC NULLS LAST, paper_id DESC) = 1",
    "user_names": "SELECT user_id, coalesce(name, 'Unknown User') AS name FROM (SELECT DISTINCT user_id FROM final_user_interactions WHERE user_id IS NOT NULL) LEFT JOIN (SELECT user_id, min(trim(author_name, ' ')) AS name FROM final_user_profiles GROUP BY user_id) USING (user_id)",
    "authors_short": """SELECT node_idx, CASE WHEN len(a) > 3 THEN array_to_string(a[1:3], ', ') || '...' WHEN len(a) > 0 THEN array_to_string(a, ', ') ELSE 'Unknown Authors' END AS authors_str
        FROM (SELECT node_idx, list_filter(authors, lambda x: x IS NOT NULL AND trim(x, ' ') <> '') AS a FROM (SELECT DISTINCT node_idx, authors FROM author_data_openalex WHERE node_idx IS NOT NULL))""",
    "label_histogram": "SELECT label, count(true_label_idx) AS cnt FROM (SELECT unnest(range(0, CAST(max(true_label_idx) AS BIGINT) + 1)) AS label FROM topic_prediction_results) LEFT JOIN topic_prediction_results ON true_label_idx = label GROUP BY label",
    "distinct_labels": "SELECT count(DISTINCT label) AS n_labels, CAST(min(label) AS BIGINT) AS min_label, CAST(max(label) AS BIGINT) AS max_label FROM embeddings",
    "edge_dedup": f"WITH {_edges()} SELECT src, dst, multiplicity FROM e",
    "graph_degree": f"""WITH {_edges()}, o AS (SELECT src AS idx, count(*) AS c FROM e GROUP BY src), i AS (SELECT dst AS idx, count(*) AS c FROM e GROUP BY dst)
        SELECT p_partkey AS idx, coalesce(o.c, 0) AS out_deg, coalesce(i.c, 0) AS in_deg FROM part LEFT JOIN o ON o.idx = p_partkey LEFT JOIN i ON i.idx = p_partkey""",
    "graph_counts": f"WITH {_edges()} SELECT (SELECT count(DISTINCT p_partkey) FROM part) AS n_nodes, count(*) AS n_edges, count(*) FILTER (WHERE src = dst) AS n_self_loops FROM e",
    "neighbor_union_cap50": f"WITH {_edges()}, {_NEAR} SELECT idx, pos, neighbor FROM near",
    "neighbor_label_distribution": f"WITH {_edges()}, {_NEAR} SELECT idx, rk, label_idx, cnt, CAST(total AS BIGINT) AS total, round(cnt / total, 6) AS ratio FROM dist WHERE rk <= 5",
    "citation_context": f"""WITH {_edges("l_returnflag = 'R'")}, {_NEAR}, asked AS (SELECT p_partkey AS idx FROM part UNION SELECT (SELECT max(p_partkey) FROM part) + unnest(range(1, 6)))
        SELECT a.idx, CASE WHEN p.p_partkey IS NULL THEN 'not_in_graph' WHEN a.idx NOT IN (SELECT idx FROM near) THEN 'isolated' WHEN d.total IS NULL THEN 'unlabeled' ELSE 'evidence' END AS branch,
        CAST(coalesce(d.total, 0) AS BIGINT) AS total, d.label_idx AS top_label, round(d.cnt / d.total, 6) AS top_ratio
        FROM asked a LEFT JOIN part p ON p.p_partkey = a.idx LEFT JOIN (SELECT * FROM dist WHERE rk = 1) d ON d.idx = a.idx""",
    "keyword_vocab": f"WITH {_KEYWORDS} SELECT keyword, row_number() OVER (ORDER BY keyword) AS keyword_id FROM (SELECT DISTINCT keyword FROM kw)",
    "weighted_keyword_bag": f"""WITH {_KEYWORDS}, v AS (SELECT keyword, row_number() OVER (ORDER BY keyword) AS keyword_id FROM (SELECT DISTINCT keyword FROM kw))
        SELECT item_id, keyword_id, CAST(sum(CASE WHEN field = 'domain' THEN 2 ELSE 1 END) AS BIGINT) AS weight FROM kw JOIN v USING (keyword) GROUP BY ALL""",
    "keyword_overlap": f"""WITH {_KEYWORDS}, pairs AS (SELECT DISTINCT user_id, item_id FROM final_user_interactions WHERE user_id IS NOT NULL AND item_id IS NOT NULL),
        pool AS (SELECT DISTINCT user_id, lower(trim(t, ' ')) AS keyword FROM (SELECT user_id, unnest(top_keywords) AS t FROM final_user_profiles) WHERE t IS NOT NULL)
        SELECT p.user_id, p.item_id, count(pool.keyword) AS n_overlap FROM pairs p LEFT JOIN (SELECT DISTINCT item_id, keyword FROM kw) k ON k.item_id = p.item_id LEFT JOIN pool ON pool.user_id = p.user_id AND pool.keyword = k.keyword GROUP BY ALL""",
    "topk_accuracy": f"WITH {_SCORED} SELECT count(*) AS n, round(count(*) FILTER (WHERE top1) / count(*), 6) AS top1_acc, round(count(*) FILTER (WHERE top3) / count(*), 6) AS top3_acc, count(*) FILTER (WHERE NOT top3) AS n_miss, round(count(*) FILTER (WHERE NOT top3) / count(*), 6) AS miss_rate FROM sc",
    "top3_miss_confusion": f"WITH {_SCORED} SELECT true_idx, pred_idx, count(*) AS cnt FROM sc WHERE NOT top3 GROUP BY ALL ORDER BY cnt DESC, true_idx NULLS LAST, pred_idx NULLS LAST LIMIT 20",
    "per_class_miss_rate": f"WITH {_SCORED} SELECT true_idx, count(*) AS total, count(*) FILTER (WHERE NOT top3) AS miss, round(count(*) FILTER (WHERE NOT top3) / count(*), 6) AS miss_rate FROM sc GROUP BY true_idx",
    "miss_examples": f"WITH {_SCORED} SELECT node_index, true_idx, pred_idx FROM sc WHERE NOT top3 ORDER BY node_index NULLS FIRST, true_idx NULLS LAST, pred_idx NULLS LAST LIMIT 10",
    "llm_cost_summary": """WITH c AS (SELECT count(*) AS calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS i, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS o FROM llm_extraction_results WHERE status = 'success'),
        a AS (SELECT *, coalesce(CAST(i AS DOUBLE) / nullif(calls, 0), 0) AS ai, coalesce(CAST(o AS DOUBLE) / nullif(calls, 0), 0) AS ao FROM c)
        SELECT calls, i AS total_input_tokens, o AS total_output_tokens, i + o AS total_tokens, round(ai, 6) AS avg_input_tokens, round(ao, 6) AS avg_output_tokens,
        round(ai * CAST(16000 AS DOUBLE), 3) AS projected_input_tokens, round(ao * CAST(16000 AS DOUBLE), 3) AS projected_output_tokens,
        round(ai * 16000e0 / 1e6 * 0.15e0, 6) AS projected_input_cost, round(ao * 16000e0 / 1e6 * 0.6e0, 6) AS projected_output_cost, round(ai * 16000e0 / 1e6 * 0.15e0 + ao * 16000e0 / 1e6 * 0.6e0, 6) AS projected_cost FROM a""",
    "status_counts": "SELECT status, count(*) AS n FROM llm_extraction_results GROUP BY status",
    "cosine_topk": f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, ({_DOT} / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) + 1) / 2 AS score
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rk, vec_id, round(score, 6) AS score FROM s QUALIFY rk <= 5""",
    "dot_sigmoid_score": f"SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(1 / (1 + exp(-{_DOT})), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0",
    "prompt_recommend": _ranking("DESC", False, "query_id"),
    "recommend_topk_unseen": _ranking("DESC", True, "user_id"),
    "recommend_bottomk": _ranking("ASC", True, "user_id"),
    "negative_samples": """WITH p AS (SELECT DISTINCT user_id, item_id FROM final_user_interactions WHERE user_id IS NOT NULL AND item_id IS NOT NULL),
        i AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS number FROM (SELECT DISTINCT item_id FROM p)),
        d AS (SELECT user_id, item_id AS src, unnest(range(0, 8)) AS j FROM p),
        x AS (SELECT d.user_id, d.src, j, i.item_id FROM d JOIN i ON i.number = (d.user_id * 7919 + d.src * 104729 + j * 1299709 + 17) % (SELECT count(*) FROM i)),
        k AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = x.user_id AND p.item_id = x.item_id) QUALIFY row_number() OVER (PARTITION BY user_id, src ORDER BY j) <= 4)
        SELECT user_id, item_id, min(j) AS draw FROM k GROUP BY ALL""",
    "parse_llm_json": """WITH r AS (SELECT DISTINCT node_idx, domain, task, method FROM llm_extraction_results WHERE node_idx IS NOT NULL)
        SELECT * FROM (SELECT node_idx, 'domain' AS field, unnest(domain) AS value FROM r UNION ALL SELECT node_idx, 'task', unnest(task) FROM r UNION ALL SELECT node_idx, 'method', unnest(method) FROM r) WHERE value IS NOT NULL""",
    "parse_works_json": "SELECT paper_id, author FROM (SELECT paper_id, unnest(authors) AS author FROM (SELECT DISTINCT paper_id, authors FROM author_data_openalex) WHERE paper_id IS NOT NULL) WHERE author IS NOT NULL AND author <> ''",
    "enrich_with_status": f"WITH {_PAPERS} SELECT 'success' AS status, count(*) AS n FROM papers",
    "incremental_foreachbatch": "SELECT doc_id, 0 AS batch_id FROM documents",
}

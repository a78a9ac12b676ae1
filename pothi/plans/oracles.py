"""DuckDB SQL of the core queries."""

from __future__ import annotations

from pothi.functions.lexical import PROSE_WORDS_EN, PROSE_WORDS_MR, STOPWORDS, SUFFIXES
from pothi.operators.retrieval import TIER_WEIGHTS
from pothi.plans import building, citing, matching, texts

_SPACE = r"[\s\x{0085}\x{00A0}\x{2007}\x{202F}\x{3000}]"
_list = lambda xs: ", ".join("'" + x + "'" for x in xs)
_DEVA = r"[\x{0900}-\x{097F}]"
_CHUNKS = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY built_at DESC) = 1)"
_REQ = """(SELECT *, CAST(regexp_replace(ts, 'Z$', '+00:00') AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS tm FROM access_log
  QUALIFY row_number() OVER (PARTITION BY ts, name, method, path ORDER BY received_at, ip, mode, lang, work, question, category, note, status, ms) = 1)"""
_CAND = "(SELECT DISTINCT file || '#' || idx AS key, about_member, raw_text, key_people, locations, fingerprint_phrases FROM candidate)"


def _n(text: str, cls: str) -> str:
    return f"(length({text}) - length(regexp_replace({text}, '{cls}', '', 'g')))"


def _terms(source: str, key: str, text: str) -> str:
    stem = f"list_filter([{_list(SUFFIXES)}], lambda s: ends_with(tok, s) AND length(tok) - length(s) >= 2)[1]"
    stop = f"[{_list(STOPWORDS)}]"
    return f"""
  SELECT {key}, unnest(CASE
      WHEN contains(tok, '-') THEN list_concat([tok], list_filter(list_transform(string_split(tok, '-'), lambda p: trim(p)), lambda p: length(p) > 1 AND NOT list_contains({stop}, p)))
      WHEN length(tok) > 1 AND NOT list_contains({stop}, tok) THEN list_filter([tok, CASE WHEN regexp_matches(tok, '{_DEVA}') AND NOT list_contains({stop}, coalesce(root, 'the')) THEN root END], lambda x: x IS NOT NULL)
      ELSE [] END) AS term
  FROM (SELECT *, left(tok, length(tok) - length({stem})) AS root FROM (
    SELECT {key}, trim(unnest(regexp_split_to_array(lower({text}), '{_SPACE}+')), '.,;:!?"''()[]{{}}…') AS tok FROM {source}) WHERE tok <> '')"""


def _bm25(source: str, key: str, text: str, queries: str, qkey: str, qtext: str) -> str:
    return f"""
post AS (SELECT {key}, term, count(*) AS tf FROM ({_terms(source, key, text)}) GROUP BY ALL),
asked AS (SELECT DISTINCT {qkey}, term FROM ({_terms(queries, qkey, qtext)})),
dl AS (SELECT {key}, sum(tf) AS dl FROM post GROUP BY ALL),
st AS (SELECT (SELECT count(DISTINCT {key}) FROM {source}) AS n, greatest(1.0, (SELECT sum(dl) FROM dl) / greatest(1, (SELECT count(DISTINCT {key}) FROM {source}))) AS avgdl),
dft AS (SELECT term, count(*) AS df FROM post GROUP BY ALL),
scored AS (SELECT {qkey}, {key}, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM post JOIN asked USING (term) JOIN dft USING (term) JOIN dl USING ({key}) CROSS JOIN st GROUP BY ALL)"""


_DOCS = "(SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)"
_GOLD = "(SELECT item_id, query FROM gold WHERE query IS NOT NULL)"
_B = "WITH " + _bm25(_DOCS, "doc_id", "text", _GOLD, "item_id", "query")
_top = lambda k, src="scored", part="item_id", by="score DESC, doc_id", name="rank": f"SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {by}) AS {name} FROM {src} QUALIFY {name} <= {k}"
_TIER = "CASE kind WHEN 'canonical' THEN 'canonical' WHEN 'reference' THEN 'reference' ELSE 'recollections' END"
_EDGE = r"""[\.,;:!\?"''\(\)\[\]{}…।॥]"""
_READER = f"""(SELECT work_id, id, row_number() OVER (PARTITION BY work_id ORDER BY chunk_index, id) AS n, coalesce(chapter, '') AS chapter, length(text) AS len, length(text) < 250 AS is_heading, contains(text, '॥') AS is_verse
  FROM {_CHUNKS} WHERE kind_level = 'parent')"""


_DENSE = """dn AS (SELECT item_id, variant, v.vec_id AS doc_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
  FROM (SELECT item_id, 1 AS variant, item_id AS qid FROM gold WHERE query IS NOT NULL UNION ALL SELECT item_id, 2, item_id + 240 FROM gold WHERE query IS NOT NULL) JOIN embeddings q ON q.vec_id = qid CROSS JOIN embeddings v)"""
_RRF = lambda dense: f"""rk AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id, variant ORDER BY score DESC, doc_id) AS r FROM {dense} UNION ALL SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) FROM scored WHERE score > 0),
  fused AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + r)), 9) AS fused FROM rk GROUP BY ALL)"""  # noqa: E731
_ABOUT = """about AS (SELECT DISTINCT doc_id, kind, coalesce(d.author IN ('lokesh-mani-th', 'pinor-rudh'), false) AS prim, CASE WHEN kind = 'canonical' AND coalesce(d.author IN ('lokesh-mani-th', 'pinor-rudh'), false) THEN 0.003 ELSE 0 END AS bonus, n_chars
  FROM documents d LEFT JOIN works USING (work_id))"""


def _weights() -> str:
    return " ".join(f"WHEN intent = '{k}' THEN CASE {_TIER} WHEN 'canonical' THEN {a} WHEN 'reference' THEN {c} ELSE {b} END" for k, (a, b, c) in TIER_WEIGHTS.items())


_ASKED = f"""(SELECT item_id, CASE WHEN top = 0 OR (CASE WHEN a = top THEN 1 ELSE 0 END + CASE WHEN b = top THEN 1 ELSE 0 END + CASE WHEN c = top THEN 1 ELSE 0 END) > 1 THEN 'unknown' WHEN a = top THEN 'doctrinal' WHEN b = top THEN 'narrative' ELSE 'navigational' END AS intent
  FROM (SELECT *, greatest(a, b, c) AS top FROM (SELECT item_id, {texts._hits['doctrinal']} AS a, {texts._hits['narrative']} AS b, {texts._hits['navigational']} AS c FROM (SELECT item_id, lower(query) AS low FROM gold WHERE query IS NOT NULL))))"""
_WEIGHED = f"""wd AS (SELECT item_id, variant, doc_id, round(score + (CASE {_weights()} ELSE CASE {_TIER} WHEN 'canonical' THEN 0.02 WHEN 'reference' THEN -0.08 ELSE 0.02 END END) + CASE WHEN kind = 'canonical' AND prim THEN 0.04 ELSE 0 END, 6) AS score
  FROM dn JOIN about USING (doc_id) JOIN {_ASKED} USING (item_id))"""

SQL = {
    "C01_metadata_filter": f"SELECT id, kind, language FROM {_CHUNKS} WHERE kind = 'canonical' AND language = 'mr' AND kind_level = 'parent'",
    "C02_chunk_tier": f"SELECT {_TIER} AS tier, count(*) AS n FROM {_CHUNKS} GROUP BY ALL",
    "C03_intent_weights": f"""SELECT intent, kind, round(avg(coalesce(quality_score, 1.0) + (CASE {_weights()} ELSE CASE {_TIER} WHEN 'canonical' THEN 0.02 WHEN 'reference' THEN -0.08 ELSE 0.02 END END)
      + CASE WHEN kind = 'canonical' AND author IN ('lokesh-mani-th', 'pinor-rudh') THEN 0.04 ELSE 0 END), 6) AS avg_weight, count(*) AS n
      FROM {_CHUNKS} CROSS JOIN (SELECT unnest(['doctrinal', 'narrative', 'navigational', 'other']) AS intent) GROUP BY ALL""",
    "C07_log_paths": f"SELECT CASE WHEN starts_with(path, '/read/') THEN '/read/' ELSE path END AS route, count(*) AS n FROM {_REQ} WHERE path IN ('/ask', '/works') OR starts_with(path, '/read/') GROUP BY ALL",
    "C08_work_filter": "SELECT work_id, title, title_en FROM works WHERE contains(lower(title), 'river') OR contains(lower(title_en), 'river')",
    "C13_cite_is_clean": f"""SELECT CASE WHEN trim(cite_text) = '' THEN 'empty' WHEN regexp_matches(cite_text, '[\\x{{FFFD}}\\x{{200B}}\\x{{FEFF}}]') THEN 'broken' WHEN {_n('cite_text', _DEVA)} < 20 THEN 'few letters' WHEN {_n('cite_text', '[A-Za-z]')} > {_n('cite_text', _DEVA)} THEN 'latin' ELSE 'clean' END AS reason, count(*) AS n
      FROM {_CHUNKS} WHERE cite_text IS NOT NULL GROUP BY ALL""",
    "D01_manifest": f"""SELECT work_id, arg_min(kind, id) AS kind, (min_by({{'a': author}}, id)).a AS author, (min_by({{'a': title}}, id)).a AS title, array_to_string(list_sort(list_distinct(list(language) FILTER (language IS NOT NULL))), ',') AS languages, count(*) AS chunks FROM {_CHUNKS} GROUP BY work_id""",
    "D01_kind_rollup": f"SELECT kind, language, count(*) AS chunks, count(DISTINCT work_id) AS works FROM {_CHUNKS} GROUP BY GROUPING SETS ((kind), (language), ())",
    "D02_tallies": f"SELECT kind, kind_level, count(*) AS n, sum(token_estimate) AS tokens FROM {_CHUNKS} GROUP BY ALL",
    "D04_term_stats": f"SELECT term, count(*) AS df, sum(tf) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM ({_terms(_DOCS, 'doc_id', 'text')}) GROUP BY ALL) GROUP BY term",
    "D05_works_catalog": f"SELECT work_id, id AS first_id, title, language FROM {_CHUNKS} QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY id) = 1",
    "D07_gate": f"""SELECT doc_id, n_chars, broken, mojibake, devanagari, latin, CASE WHEN broken > 0.001 OR mojibake > 0.0005 THEN 'fail' WHEN devanagari < 0.35 THEN 'warn' ELSE 'pass' END AS verdict FROM (
      SELECT doc_id, length(text) AS n_chars, round({_n('text', '�')} / greatest(1, length(text)), 6) AS broken, round({_n('text', '[˜Ï¡Ô†¬»½ѽ]')} / greatest(1, length(text)), 6) AS mojibake, round({_n('text', _DEVA)} / greatest(1, length(text)), 6) AS devanagari, round({_n('text', '[A-Za-z]')} / greatest(1, length(text)), 6) AS latin FROM {_DOCS})""",
    "D12_ingest_check": f"""SELECT work_id, count(*) FILTER (kind_level = 'child') AS children, count(*) FILTER (kind_level = 'child' AND cite_text IS NOT NULL) AS citable, count(*) FILTER (kind_level = 'child' AND cite_text IS NULL) AS retrieval_only, count(*) FILTER (trim(cite_text) = '') AS empty_cites,
      count(*) FILTER (kind_level = 'child' AND parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM chunks WHERE kind_level = 'parent')) AS orphans FROM {_CHUNKS} GROUP BY work_id""",
    "E01_tokens": f"SELECT item_id, term, count(*) AS tf FROM ({_terms('gold', 'item_id', 'query')}) GROUP BY ALL",
    "E02_stems": f"""SELECT DISTINCT tok AS token, left(tok, length(tok) - length(suffix)) AS stem FROM (SELECT tok, list_filter([{_list(SUFFIXES)}], lambda s: ends_with(tok, s) AND length(tok) - length(s) >= 2)[1] AS suffix
      FROM (SELECT trim(unnest(regexp_split_to_array(lower(text), '{_SPACE}+')), '.,;:!?"''()[]{{}}…') AS tok FROM {_DOCS})) WHERE suffix IS NOT NULL AND regexp_matches(tok, '{_DEVA}')""",
    "E03_bm25_topk": f"{_B} {_top(10)}",
    "E05_multi_query": f"""WITH both_ AS (SELECT item_id || ':q' AS v, query AS text FROM gold UNION ALL SELECT item_id || ':a', expected_text_substr FROM gold WHERE expected_text_substr IS NOT NULL), {_bm25(_DOCS, 'doc_id', 'text', 'both_', 'v', 'text')},
      best AS (SELECT CAST(string_split(v, ':')[1] AS BIGINT) AS item_id, doc_id, max(score) AS score FROM scored GROUP BY ALL) {_top(5, 'best')}""",
    "E06_scoped_bm25": "WITH " + _bm25("(SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL AND lang = 'mr')", "doc_id", "text", _GOLD, "item_id", "query") + " " + _top(5),
    "F01_cosine_topk": """SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
      SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id) QUALIFY rank <= 10""",
    "F03_unit_vectors": "SELECT vec_id, 1.0 AS norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings",
    "F07_quality": f"""SELECT id, CASE WHEN solid > 0 THEN round(CASE WHEN n < 100 THEN 0.15 WHEN n < 200 THEN 0.6 ELSE 1 END * CASE WHEN letters / solid < 0.45 THEN 0.2 WHEN letters / solid < 0.6 THEN 0.6 ELSE 1 END
      * CASE WHEN digits / solid > 0.25 THEN 0.2 WHEN digits / solid > 0.15 THEN 0.6 ELSE 1 END * CASE WHEN 1 - letters / solid - digits / solid > 0.25 THEN 0.4 ELSE 1 END * CASE WHEN n >= 200 AND stops < 2 THEN 0.3 ELSE 1 END, 4) ELSE 0 END AS quality_score FROM (
      SELECT id, length(s) AS n, length(x) AS solid, {_n('x', r'[A-Za-z]|[\x{0900}-\x{0965}\x{0970}-\x{097F}]')} AS letters, {_n('x', '[0-9०-९]')} AS digits,
        len(list_filter(regexp_split_to_array(lower(s), '{_SPACE}+'), lambda w: list_contains([{_list(PROSE_WORDS_EN + PROSE_WORDS_MR)}], regexp_replace(w, '^{_EDGE}+|{_EDGE}+$', '', 'g')))) AS stops
      FROM (SELECT id, trim(text, ' ') AS s, regexp_replace(trim(text, ' '), '{_SPACE}+', '', 'g') AS x FROM {_CHUNKS}))""",
    "F08_token_estimate": f"SELECT id, greatest(1, CAST(floor(length(text) / CASE WHEN d THEN 3 ELSE 4 END) AS INT)) AS tokens, d AS devanagari FROM (SELECT id, text, CASE WHEN length(text) > 0 THEN {_n('text', _DEVA)} / length(text) > 0.3 ELSE false END AS d FROM {_CHUNKS})",
    "G01_child_to_parent": f"SELECT c.id, c.parent_id, length(p.text) AS parent_chars FROM {_CHUNKS} c LEFT JOIN {_CHUNKS} p ON c.parent_id = p.id AND p.kind_level = 'parent' WHERE c.kind_level = 'child'",
    "G02_carry_over": f"SELECT CASE WHEN built_at < TIMESTAMPTZ '2026-07-01 00:00:00+00' THEN 'carried' ELSE 'new' END AS state, count(*) AS n FROM {_CHUNKS} GROUP BY ALL",
    "G13_semi_join": "SELECT work_id, title FROM works WHERE work_id IN (SELECT work_id FROM quotes WHERE work_id <> '')",
    "H02_rrf": f"""{_B}, {_DENSE}, {_RRF('dn')} {_top(10, 'fused', 'item_id', 'fused DESC, doc_id')}""",
    "H01_ranks": "SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0",
    "H03_fused_candidates": f"""{_B}, {_DENSE}, {_ABOUT}, {_WEIGHED}, {_RRF('wd')}, fin AS (SELECT item_id, doc_id, round(fused + bonus, 9) AS fused FROM fused JOIN about USING (doc_id)) {_top(100, 'fin', 'item_id', 'fused DESC, doc_id')}""",
    "C05_quality_weights": f"""{_B}, {_DENSE}, {_ABOUT}, {_WEIGHED}, {_RRF('wd')}, fin AS (SELECT item_id, doc_id, round((fused + bonus) * CASE WHEN n_chars < 200 THEN 0.5 ELSE 1.0 END, 9) AS fused FROM fused JOIN about USING (doc_id)) {_top(10, 'fin', 'item_id', 'fused DESC, doc_id')}""",
    "C04_primary_bonus": f"WITH {_ABOUT} SELECT kind, prim AS is_primary, count(*) AS n, round(sum(bonus), 6) AS bonus FROM about GROUP BY ALL",
    "E04_zero_filled": f"{_B} SELECT item_id, count(*) AS n, count(*) FILTER (coalesce(score, 0) = 0) AS zeros, round(max(coalesce(score, 0)), 6) AS best FROM {_GOLD} CROSS JOIN (SELECT DISTINCT doc_id FROM {_DOCS}) LEFT JOIN scored USING (item_id, doc_id) GROUP BY item_id",
    "F05_best_cosine": f"WITH {_DENSE}, b AS (SELECT item_id, doc_id, max(score) AS score FROM dn GROUP BY ALL) {_top(20, 'b')}",
    "I01_candidates": f"{_B} {_top(100)}",
    "J03_near_vectors": "SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id) WHERE score >= 0.3",
    "D04_lengths": f"WITH l AS (SELECT doc_id, count(*) AS dl FROM ({_terms(_DOCS, 'doc_id', 'text')}) GROUP BY doc_id) SELECT doc_id, dl, (SELECT count(*) FROM l) AS n_docs, round((SELECT sum(dl) FROM l) / (SELECT count(*) FROM l), 6) AS avgdl FROM l",
    "I06_parents_without_cap": "WITH kids AS (SELECT * FROM " + _CHUNKS + " WHERE kind_level = 'child'), " + _bm25("kids", "id", "text", _GOLD, "item_id", "query") + f", ranked AS ({_top(100, 'scored', 'item_id', 'score DESC, id')}), "
    "f AS (SELECT item_id, parent_id, work_id, min(rank) AS best, count(*) AS m FROM ranked JOIN kids USING (id) GROUP BY ALL) SELECT item_id, parent_id, work_id, row_number() OVER (PARTITION BY item_id ORDER BY best) AS place, least(m, 3) AS children FROM f QUALIFY place <= 12",
    "H07_verse_runs": f"""WITH p AS {_READER}, o AS (SELECT *, is_verse OR (len < 600 AND NOT is_heading) AS op FROM p), r AS (SELECT *, n - row_number() OVER (PARTITION BY work_id, op ORDER BY n) AS isl FROM o)
      SELECT id, op AND bool_or(op AND is_verse) OVER (PARTITION BY work_id, op, isl) AS in_verse FROM r""",
    "H08_pages": f"""WITH p AS {_READER}, a AS (SELECT *, CASE WHEN chapter = lag(chapter) OVER w THEN 0 ELSE 1 END AS t FROM p WINDOW w AS (PARTITION BY work_id ORDER BY n)), b AS (SELECT *, sum(t) OVER (PARTITION BY work_id ORDER BY n) AS run FROM a),
      c AS (SELECT *, floor(coalesce(sum(CASE WHEN is_heading THEN 0 ELSE 1 END) OVER (PARTITION BY work_id, run ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 4) AS pg FROM b) SELECT id, dense_rank() OVER (PARTITION BY work_id ORDER BY run, pg) AS page FROM c""",
    "H09_pages_by_entry": f"WITH p AS {_READER}, a AS (SELECT *, CASE WHEN is_heading AND NOT coalesce(lag(is_heading) OVER (PARTITION BY work_id ORDER BY n), true) THEN 1 ELSE 0 END AS t FROM p) SELECT id, 1 + sum(t) OVER (PARTITION BY work_id ORDER BY n) AS page FROM a",
    "H12_daily_cap": f"SELECT CAST(CAST(tm AS DATE) AS VARCHAR) AS day, least(15, count(*)) AS admitted, count(*) AS n FROM {_REQ} GROUP BY ALL",
    "I03_source_cap": f"{_B}, b AS ({_top(50)}), s AS (SELECT item_id, trim(source, ' ') AS source, doc_id, score FROM b JOIN (SELECT DISTINCT doc_id, source FROM documents) USING (doc_id)), c AS ({_top(2, 's', 'item_id, source', 'score DESC, doc_id', 'in_source')}) SELECT item_id, source, doc_id, in_source FROM c",
    "I05_small_to_big": "WITH kids AS (SELECT * FROM " + _CHUNKS + " WHERE kind_level = 'child'), " + _bm25("kids", "id", "text", _GOLD, "item_id", "query") + f", ranked AS ({_top(100, 'scored', 'item_id', 'score DESC, id')}), "
    "f AS (SELECT item_id, parent_id, work_id, min(rank) AS best, count(*) AS m FROM ranked JOIN kids USING (id) GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY item_id, work_id ORDER BY best) AS iw FROM f QUALIFY iw <= 1) "
    "SELECT item_id, parent_id, work_id, row_number() OVER (PARTITION BY item_id ORDER BY best) AS place, least(m, 3) AS children FROM w QUALIFY place <= 12",
    "I08_tail": f"SELECT ts, name, path, status FROM {_REQ} ORDER BY tm DESC, concat_ws('|', name, method, path) DESC LIMIT 50",
    "I11_recent": f"SELECT name, path, row_number() OVER (PARTITION BY name ORDER BY tm DESC, path) AS place FROM (SELECT name, path, max(tm) AS tm FROM {_REQ} WHERE name <> '' AND path LIKE '/read/%' GROUP BY ALL) QUALIFY place <= 20",
    "J07_evict": f"SELECT work_id, count(*) AS n FROM {_CHUNKS} WHERE NOT starts_with(id, 'window-') AND NOT starts_with(id, 'salt-') GROUP BY work_id",
    "J08_title_dedupe": "SELECT DISTINCT lower(trim(title, ' ')) AS title, work_id FROM works WHERE trim(title, ' ') <> ''",
    "K05_clean_body": r"SELECT DISTINCT quote_id, md5(regexp_replace(replace(body, '�', ' '), '[\x{200B}\x{FEFF}\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}]', '', 'g')) AS body_md5 FROM quotes WHERE body IS NOT NULL",
    "K10_check_quotes": f"""WITH q AS (SELECT DISTINCT quote_id, work_id, body FROM quotes WHERE work_id <> ''), c AS (SELECT work_id, text FROM {_CHUNKS} WHERE kind_level = 'parent'),
      p AS (SELECT quote_id, max(CASE WHEN trim(coalesce(body, ''), ' ') = '' THEN 0 WHEN text IS NULL THEN 1 WHEN contains(trim(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'), ' '), trim(regexp_replace(body, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'), ' ')) THEN 3 ELSE 2 END) AS s FROM q LEFT JOIN c USING (work_id) GROUP BY quote_id)
      SELECT ['no body', 'no source', 'changed', 'verbatim'][s + 1] AS status, count(*) AS n FROM p GROUP BY ALL""",
    "K23_labels": "SELECT DISTINCT quote_id, CASE WHEN ord < 26 THEN chr(65 + ord) ELSE chr(65 + ord // 26 - 1) || chr(65 + ord % 26) END AS label FROM quotes",
    "K28_correct": "SELECT DISTINCT quote_id, CASE WHEN contains(body, 'the ') THEN md5(left(body, strpos(body, 'the ') - 1) || 'THE ' || substr(body, strpos(body, 'the ') + 4)) END AS corrected_md5 FROM quotes WHERE body IS NOT NULL",
    "K34_provenance": f"SELECT doc_id, sha256(text) AS sha256 FROM {_DOCS}",
    "S05_daily_counts": f"SELECT CAST(CAST(tm AS DATE) AS VARCHAR) AS day, count(*) AS n, count(DISTINCT name) AS readers, max(ms) AS slowest FROM {_REQ} GROUP BY ALL",
    "S04_stream_counts": f"SELECT CAST(CAST(tm AS DATE) AS VARCHAR) AS day, count(*) AS n FROM {_REQ} GROUP BY ALL",
    "A13_readable_works": f"SELECT work_id, array_to_string(list_sort(list_distinct(list(language) FILTER (language IS NOT NULL))), ',') AS languages, min(title) AS title FROM {_CHUNKS} WHERE kind = 'canonical' GROUP BY work_id",
    "D14_answer_shape": "SELECT answer_id, count(*) AS quotes, sum(length(coalesce(body, ''))) AS chars, max(CAST(read_page IS NOT NULL AS INT)) AS has_page FROM (SELECT DISTINCT quote_id, answer_id, body, read_page FROM quotes) GROUP BY answer_id",
    "G12_best_match": """WITH w AS (SELECT work_id, list_distinct(regexp_split_to_array(lower(trim(title_en, ' ')), ' +')) AS w FROM works WHERE title_en IS NOT NULL),
      p AS (SELECT a.work_id, b.work_id AS other, len(list_intersect(a.w, b.w)) AS shared, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS score FROM w a JOIN w b ON a.work_id <> b.work_id)
      SELECT work_id, other, shared, score FROM p WHERE shared > 0 AND (score >= 0.5 OR shared >= 3) QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY score DESC, other) = 1""",
    "H06_numbering": f"SELECT id, sum(CASE WHEN is_heading THEN 0 ELSE 1 END) OVER (PARTITION BY work_id ORDER BY n) AS body_no FROM {_READER}",
    "H11_chapter_starts": f"SELECT id, NOT coalesce(lag(chapter) OVER (PARTITION BY work_id ORDER BY n) = chapter, false) AS starts FROM {_READER}",
    "H13_first_per_chapter": f"SELECT work_id, chapter, id, n FROM {_READER} QUALIFY row_number() OVER (PARTITION BY work_id, chapter ORDER BY n) = 1",
    "I09_best_samples": f"SELECT id, quality_score FROM {_CHUNKS} WHERE quality_score IS NOT NULL ORDER BY quality_score DESC, id LIMIT 40",
    "I10_kept_links": """SELECT answer_id, count(*) FILTER (r <= 3) AS kept, count(*) FILTER (r > 3) AS dropped FROM (SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY ord, quote_id) AS r
      FROM (SELECT DISTINCT quote_id, answer_id, ord, work_id FROM quotes WHERE work_id <> '') WHERE work_id IN (SELECT work_id FROM works)) GROUP BY answer_id""",
    "J09_new_entries": """SELECT DISTINCT ts, name, path FROM access_log n WHERE received_at >= '2026-02-01' AND NOT EXISTS (SELECT 1 FROM access_log o WHERE o.received_at < '2026-02-01'
      AND o.ts IS NOT DISTINCT FROM n.ts AND o.name IS NOT DISTINCT FROM n.name AND o.path IS NOT DISTINCT FROM n.path)""",
    "J10_filled_ids": "SELECT coalesce(nullif(trim(name, ' '), ''), ts || '-' || (row_number() OVER (PARTITION BY ts ORDER BY path, name NULLS FIRST) - 1)) AS id, ts, path FROM (SELECT DISTINCT ts, name, path FROM access_log)",
    "K29_word_count": f"SELECT doc_id, len(regexp_extract_all(text, '[^ \\n]+')) AS n_words FROM {_DOCS}",
}
SQL |= texts.SQL | matching.SQL | citing.SQL | building.SQL
SQL |= {"G04_citation_aliases": matching._alias_sql("SELECT split_part(c, '|', 2) AS id, split_part(o, '|', 2) AS alias_id, confidence FROM al"), "D09_histogram": matching._alias_sql(matching.BINS)}

"""Queries of the scalar text functions over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pothi.functions import text as tx
from pothi.sources.tables import latest
from pothi.sources.tables import table as t


def _documents(s, d, *cols):
    return t(s, d, "documents", *cols).distinct()


def _quotes(s, d, *cols):
    return t(s, d, "quotes", "quote_id", *cols).distinct()


def _chunks(s, d, *cols):
    return latest(t(s, d, "chunks", *dict.fromkeys(("id", *cols, "built_at"))), ["id"], "built_at").drop("built_at")


def _telling(s, d, *cols):
    return t(s, d, "candidate", "file", "idx", *cols).distinct().withColumn("key", F.concat_ws("#", "file", "idx"))


def k02_quoted_spans(s, d):
    """What each quotation's body has between double quotation marks."""
    spans = tx.quoted_spans(F.col("body"))
    return _quotes(s, d, "body").where("body IS NOT NULL").select("quote_id", F.array_join(spans, "|").alias("spans"), F.size(spans).alias("n"))


def k03_intents(s, d):
    """Intents of the test questions and of those asked, and how often."""
    asked = t(s, d, "gold", "query").select(F.col("query").alias("q")).unionByName(t(s, d, "access_log", "question").select(F.col("question").alias("q")))
    return asked.distinct().groupBy(tx.intent(F.col("q")).alias("intent")).agg(F.count("*").alias("n"))


def k04_translation_needs(s, d):
    """Whether a test question wants a rendering in Devanagari, or one out of it."""
    q = F.col("query")
    return t(s, d, "gold", "item_id", "query").select("item_id", ((F.coalesce(F.length(q), F.lit(0)) > 0) & ~tx.has_devanagari(q)).alias("into"), tx.has_devanagari(q).alias("out_of"))


def k06_folded(s, d):
    return _documents(s, d, "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.md5(tx.folded(F.col("text"))).alias("folded_md5"), F.length(tx.folded(F.col("text"))).alias("n_chars"))


def k09_without_leaks(s, d):
    """Bodies whose numbers of a series are written as numbers of chunks, without those mentions."""
    leaky = F.replace("body", F.lit("No. "), F.lit("chunk "))
    return _quotes(s, d, "body").where("body IS NOT NULL").select("quote_id", F.md5(tx.without_leaks(leaky)).alias("clean_md5"))


def k12_verse_meaning(s, d):
    verse, meaning = tx.verse_and_meaning(F.col("text"))
    return _chunks(s, d, "text").select("id", F.md5(verse).alias("verse_md5"), F.md5(meaning).alias("meaning_md5"))


def k14_without_headings(s, d):
    """Chunks with their headings as lines before them, and those lines taken off."""
    headed = F.concat(F.lit("## "), F.coalesce("section", F.lit("")), F.lit("\n### "), F.coalesce("chapter", F.lit("")), F.lit("\n\n"), "text")
    return _chunks(s, d, "section", "chapter", "text").select("id", F.md5(tx.without_headings(headed)).alias("body_md5"))


def k15_without_emphasis(s, d):
    """Documents with their quotation marks as marks of emphasis, and those taken off."""
    marked = F.translate(F.replace(F.replace("text", F.lit("“"), F.lit("**")), F.lit("”"), F.lit("**")), "‘’", "*`")
    return _documents(s, d, "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.md5(tx.without_emphasis(marked)).alias("plain_md5"))


def k16_blocks(s, d):
    """Ornaments and verses among the blocks of each document, and the lines its verses come to."""
    blocks = _documents(s, d, "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", r"\n\s*\n")).alias("b"))
    lines = F.size(F.split(tx.verse_lines(F.col("b")), "\n"))
    return blocks.groupBy("doc_id").agg(F.count_if(tx.is_ornament(F.col("b"))).alias("ornaments"), F.count_if(tx.is_verse(F.col("b"))).alias("verses"), F.sum(F.when(tx.is_verse(F.col("b")), lines).otherwise(0)).alias("verse_lines"))


def k17_numbers(s, d):
    """Sum of the numbers in a document, in either kind of digits."""
    runs = F.regexp_extract_all("text", F.lit("[0-9०-९]+"), F.lit(0))
    sums = F.aggregate(F.transform(runs, tx.whole_number), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0).cast("bigint")))
    return _documents(s, d, "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.size(runs).alias("n"), sums.alias("total"))


def k18_slugs(s, d):
    return t(s, d, "works", "work_id", "title", "title_en").select("work_id", tx.slug(F.col("title")).alias("slug"), tx.slug(F.col("title_en")).alias("slug_en"))


def k20_fingerprints(s, d):
    """The telling sentences of each candidate."""
    kept = tx.fingerprints(F.col("raw_text"))
    return _telling(s, d, "raw_text").select("key", F.size(kept).alias("n"), F.md5(F.array_join(kept, "|")).alias("phrases_md5"))


def k21_plain_text(s, d):
    """Documents written as HTML and read back."""
    coded = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("\n"), F.lit(" <br/>"))
    return _documents(s, d, "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.md5(tx.plain_text(F.concat(F.lit("<p class='x'>"), coded, F.lit("&nbsp;&lt;end&gt;</p>")))).alias("text_md5"))


def k22_plain_words(s, d):
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{M}\p{N}]+", " "), " "), lambda w: w != "")
    return _documents(s, d, "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.size(words).alias("n_words"), F.md5(F.array_join(words, " ")).alias("words_md5"))


def k25_coerced(s, d):
    """Lists that arrive as JSON texts, read; what isn't one stays a text."""
    sent = _telling(s, d, "key_people", "one_line").select("key", F.explode(F.array(F.struct(F.lit("people").alias("field"), F.to_json("key_people").alias("v")), F.struct(F.lit("line").alias("field"), F.col("one_line").alias("v")))).alias("f"))
    v = F.col("f.v")
    read = F.when(v.rlike(r"^\s*\["), F.from_json(v, "array<string>"))
    return sent.select("key", "f.field", F.size(read).alias("n"), F.array_join(read, ",").alias("items"), F.when(read.isNull(), v).alias("text")).select("key", "field", F.when(F.col("n") >= 0, F.col("n")).alias("n"), "items", "text")


def k26_names(s, d):
    return t(s, d, "meta", "about_member").distinct().where("about_member IS NOT NULL").select("about_member", tx.shown_name(F.col("about_member")).alias("shown"))


def k29_shortened(s, d):
    return _quotes(s, d, "body").select("quote_id", tx.shortened(F.col("body"), 60).alias("short"))


def k33_running_heads(s, d):
    """Lines of the scans with misspelt headings put right, and whether they are heads of pages."""
    lines = _chunks(s, d, "kind_level", "text").where("kind_level = 'parent'").select("id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    put = F.regexp_replace(F.regexp_replace("line", r"\bPrat\b", "Part"), r"\bofthe\b", "of the")
    head = F.col("line").rlike(r"^\s*[\p{L}\p{M} ]{4,40}\s{2,}[0-9०-९]{1,4}\s*$") | F.col("line").rlike(r"^\s*[0-9०-९]{1,4}\s{2,}[\p{L}\p{M} ]{4,40}\s*$")
    return lines.select("id", (F.col("at") + 1).alias("line_no"), F.md5(put).alias("line_md5"), head.alias("is_head")).where("is_head").drop("is_head")


def k38_replaced_if(s, d):
    """Documents in which a word stands exactly twice have it replaced."""
    return _documents(s, d, "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.md5(tx.replaced_if(F.col("text"), "lamp", "LAMP", 2)).alias("text_md5"))


def k40_clean_pages(s, d):
    return _chunks(s, d, "kind_level", "text").where("kind_level = 'parent'").select("id", F.md5(tx.clean_page(F.col("text"))).alias("page_md5"))


def k41_kebabs(s, d):
    return t(s, d, "works", "work_id", "title", "title_en", "title_translit").select("work_id", *[tx.kebab(F.col(c)).alias(f"of_{c}") for c in ("title", "title_en", "title_translit")])


def k42_valid_quotes(s, d):
    """Which checks a quotation passes: a kind that exists, a page from 1 on, a body, a body without mentions of chunks."""
    q = _quotes(s, d, "kind", "read_page", "body")
    ok = lambda c: F.coalesce(c, F.lit(False))
    return q.select("quote_id", ok(F.col("kind").isin("canonical", "biography", "athvani", "reference")).alias("kind_ok"), ok(F.col("read_page").isNull() | (F.col("read_page") >= 1)).alias("page_ok"), ok(F.trim("body") != "").alias("body_ok"), F.coalesce(F.col("body") == tx.without_leaks(F.col("body")), F.lit(True)).alias("clean"))


def c11_long_enough(s, d):
    """Rows that pass each least length."""
    q = _quotes(s, d, "body").agg(F.count("*").alias("n"), F.count_if(F.length("body") >= 40).alias("long")).select(F.lit("quotes").alias("what"), "n", "long")
    p = _documents(s, d, "doc_id", "text").select(F.explode(F.split("text", "\n")).alias("p")).agg(F.count("*").alias("n"), F.count_if(F.length(F.trim("p")) >= 80).alias("long")).select(F.lit("paragraphs").alias("what"), "n", "long")
    c = _telling(s, d, "raw_text").agg(F.count("*").alias("n"), F.count_if(F.length(F.trim("raw_text")) >= 200).alias("long")).select(F.lit("segments").alias("what"), "n", "long")
    return q.unionByName(p).unionByName(c)


QUERIES = {n[0].upper() + n[1:]: f for n, f in list(globals().items()) if n[0] in "kc" and n[1:3].isdigit()}

_DOCS = "(SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)"
_QUOTES = "(SELECT DISTINCT quote_id, body FROM quotes)"
_CHUNKS = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY built_at DESC) = 1)"
_TELLING = "(SELECT DISTINCT file || '#' || idx AS key, raw_text FROM candidate)"
_SP = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SP}+', ' ', 'g'), ' ')"


def _leaks(x: str) -> str:
    mention = r"(?i)\bchunks?\s+\d+(?:\s*(?:and|to|&|,|–|—|-)\s*\d+)?\b"
    out = f"regexp_replace({x}, '{mention}', '', 'g')"
    for a, b in [(_SP + "+", " "), (r"\s*,\s*,+", ","), (r"\(\s*,", "("), (r",\s*\)", ")"), (r"\(\s*\)", ""), (r"\s+([,.;:])", r"\1")]:
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')"
    return f"CASE WHEN regexp_matches({x}, '{mention}') THEN trim(trim(trim({out}, ' '), ',;'), ' ') ELSE {x} END"


def _slug(x: str) -> str:
    latin = f"regexp_extract_all(coalesce({x}, ''), '[A-Za-z][A-Za-z0-9]+')"
    other = rf"left(trim(regexp_replace(lower(replace(trim(regexp_replace(coalesce({x}, ''), '[^\x{{0900}}-\x{{097F}}a-zA-Z0-9 \-]', '', 'g'), ' '), ' ', '-')), '-+', '-', 'g'), '-'), 60)"
    return f"CASE WHEN len({latin}) >= 3 THEN left(lower(array_to_string({latin}[1:8], '-')), 80) WHEN {other} <> '' THEN {other} ELSE 'untitled-story' END"


def _kebab(x: str) -> str:
    joined = f"trim(left(trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', '-', 'g'), '-'), 45), '-')"
    return f"CASE WHEN {joined} <> '' THEN {joined} ELSE 'story' END"


_cues = lambda xs: "[" + ", ".join("'" + x + "'" for x in xs) + "]"
_hits = {k: f"len(list_filter({_cues(v)}, lambda c: contains(low, c)))" for k, v in tx.CUES.items()}
_from, _to = tx.foldings()
_VERSE = "(contains(b, '॥') OR (len(ps) >= 3 AND list_sum(list_transform(ps, lambda p: length(p))) <= 80 * len(ps)))"
_PAGE = r"regexp_replace(regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g'), '(?m)^[ \t]*[0-9\x{0966}-\x{096F}]{1,4}[ \t]*(\n|\z)', '', 'g')"

SQL = {
    "K02_quoted_spans": f"""SELECT quote_id, array_to_string(sp, '|') AS spans, len(sp) AS n FROM (SELECT quote_id, list_filter(list_transform(regexp_extract_all(body, '["“”„]([^"“”„]{{2,}}?)["“”„]', 1), lambda x: {_squeeze('x')}), lambda x: length(x) >= 2) AS sp FROM {_QUOTES} WHERE body IS NOT NULL)""",
    "K03_intents": f"""SELECT CASE WHEN top = 0 OR (CASE WHEN a = top THEN 1 ELSE 0 END + CASE WHEN b = top THEN 1 ELSE 0 END + CASE WHEN c = top THEN 1 ELSE 0 END) > 1 THEN 'unknown' WHEN a = top THEN 'doctrinal' WHEN b = top THEN 'narrative' ELSE 'navigational' END AS intent, count(*) AS n
      FROM (SELECT *, greatest(a, b, c) AS top FROM (SELECT {_hits['doctrinal']} AS a, {_hits['narrative']} AS b, {_hits['navigational']} AS c FROM (SELECT lower(coalesce(q, '')) AS low FROM (SELECT query AS q FROM gold UNION SELECT question FROM access_log)))) GROUP BY ALL""",
    "K04_translation_needs": r"SELECT item_id, coalesce(length(query), 0) > 0 AND NOT regexp_matches(query, '[\x{0900}-\x{097F}]') AS into, coalesce(regexp_matches(query, '[\x{0900}-\x{097F}]'), false) AS out_of FROM gold",
    "K06_folded": f"SELECT doc_id, md5(translate(text, '{_from}', '{_to}')) AS folded_md5, length(text) AS n_chars FROM {_DOCS}",
    "K09_without_leaks": f"SELECT quote_id, md5({_leaks('b')}) AS clean_md5 FROM (SELECT quote_id, replace(body, 'No. ', 'chunk ') AS b FROM {_QUOTES} WHERE body IS NOT NULL)",
    "K12_verse_meaning": rf"""SELECT id, md5(CASE WHEN n IS NULL THEN e ELSE {_strip('left(e, n)')} END) AS verse_md5, md5(CASE WHEN n IS NOT NULL THEN {_strip('substr(e, n + 1)')} END) AS meaning_md5 FROM (
      SELECT id, e, CASE WHEN regexp_matches(e, '(?m)^\s*अर्थ($|[^\x{{0900}}-\x{{097F}}])') THEN length(regexp_extract(e, '(?s)^(.*?)(?m:^)\s*अर्थ(?:$|[^\x{{0900}}-\x{{097F}}])', 1)) WHEN regexp_matches(e, '\([^)\n]*[A-Za-z][^)\n]*\)') THEN length(regexp_extract(e, '(?s)^(.*?)\([^)\n]*[A-Za-z][^)\n]*\)', 1)) END AS n
      FROM (SELECT id, {_strip("coalesce(text, '')")} AS e FROM {_CHUNKS}))""",
    "K14_without_headings": f"SELECT id, md5(regexp_replace(regexp_replace(text, '^(\\s*#{{2,3}}[ \\t]+[^\\n]*\\n?)+', ''), '^\\n+', '')) AS body_md5 FROM {_CHUNKS}",
    "K15_without_emphasis": rf"SELECT doc_id, md5(replace(regexp_replace(regexp_replace(m, '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g'), '`', '')) AS plain_md5 FROM (SELECT doc_id, replace(replace(replace(replace(text, '“', '**'), '”', '**'), '‘', '*'), '’', '`') AS m FROM {_DOCS})",
    "K16_blocks": rf"""SELECT doc_id, count(*) FILTER (o) AS ornaments, count(*) FILTER (v) AS verses, sum(CASE WHEN v THEN n ELSE 0 END) AS verse_lines FROM (
      SELECT doc_id, s = '' OR (length(s) < 20 AND regexp_matches(s, '^[\s\*\-–—•॥ॐ०-९0-9.()]+$')) AS o, {_VERSE} AS v,
        CASE WHEN contains(b, chr(10)) OR NOT contains(b, '॥') OR len(ls) = 0 THEN length(b) - length(replace(b, chr(10), '')) + 1 ELSE len(ls) END AS n FROM (
        SELECT doc_id, b, {_strip('b')} AS s, list_filter(list_transform(string_split(b, '।'), lambda p: {_strip('p')}), lambda p: p <> '') AS ps, list_filter(list_transform(string_split(regexp_replace(b, '(॥[^॥\n]{{0,10}}॥|॥)', '\1' || chr(1), 'g'), chr(1)), lambda p: {_strip('p')}), lambda p: p <> '') AS ls
        FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) AS b FROM {_DOCS}))) GROUP BY doc_id""",
    "K17_numbers": f"SELECT doc_id, len(r) AS n, coalesce(list_sum(list_transform(r, lambda x: TRY_CAST(translate(x, '०१२३४५६७८९', '0123456789') AS BIGINT))), 0) AS total FROM (SELECT doc_id, regexp_extract_all(text, '[0-9\\x{{0966}}-\\x{{096F}}]+') AS r FROM {_DOCS})",
    "K18_slugs": f"SELECT work_id, {_slug('title')} AS slug, {_slug('title_en')} AS slug_en FROM works",
    "K20_fingerprints": rf"""WITH s AS (SELECT key, unnest(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(raw_text, '[*_>]', '', 'g'), '([.!?।])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x, i: {{'s': trim(x, ' '), 'pos': i}})) AS x FROM {_TELLING}),
      f AS (SELECT key, x.s AS s, x.pos AS pos, CASE WHEN regexp_matches(x.s, '[A-Z][a-zA-Z]{{3,}}') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(x.s, '["''“”‘’]') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(x.s, '[\x{{0900}}-\x{{097F}}]{{4,}}') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(x.s, '[A-Za-z]{{4,}}') THEN 1 ELSE 0 END AS score FROM s WHERE length(x.s) BETWEEN 40 AND 180),
      p AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY key, left(s, 30) ORDER BY score DESC, pos) = 1), k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, pos) <= 5)
      SELECT c.key, count(k.s) AS n, md5(coalesce(string_agg(k.s, '|' ORDER BY k.score DESC, k.pos), '')) AS phrases_md5 FROM {_TELLING} c LEFT JOIN k USING (key) GROUP BY c.key""",
    "K21_plain_text": rf"SELECT doc_id, md5(trim(regexp_replace(replace(text, chr(10), ' ' || chr(10)) || ' <end>', '[ \t]+(\n|$)', '\1', 'g'), ' ')) AS text_md5 FROM {_DOCS}",
    "K22_plain_words": rf"SELECT doc_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS words_md5 FROM (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM {_DOCS})",
    "K25_coerced": """WITH c AS (SELECT DISTINCT file || '#' || idx AS key, key_people, one_line FROM candidate)
      SELECT key, 'people' AS field, len(key_people) AS n, array_to_string(key_people, ',') AS items, NULL AS text FROM c UNION ALL SELECT key, 'line', NULL, NULL, one_line FROM c""",
    "K26_names": "SELECT DISTINCT about_member, array_to_string(list_transform(string_split(about_member, '_'), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS shown FROM meta WHERE about_member IS NOT NULL",
    "K29_shortened": f"SELECT quote_id, CASE WHEN length(s) > 60 THEN left(s, 59) || '…' ELSE s END AS short FROM (SELECT quote_id, {_squeeze(chr(99) + chr(111) + 'alesce(body, ' + chr(39) * 2 + ')')} AS s FROM {_QUOTES})",
    "K33_running_heads": rf"""SELECT id, line_no, md5(regexp_replace(regexp_replace(line, '\bPrat\b', 'Part', 'g'), '\bofthe\b', 'of the', 'g')) AS line_md5 FROM (SELECT id, unnest(list_transform(string_split(text, chr(10)), lambda l, i: {{'line': l, 'line_no': i}}), recursive := true) FROM {_CHUNKS} WHERE kind_level = 'parent')
      WHERE regexp_matches(line, '^\s*[\p{{L}}\p{{M}} ]{{4,40}}\s{{2,}}[0-9\x{{0966}}-\x{{096F}}]{{1,4}}\s*$') OR regexp_matches(line, '^\s*[0-9\x{{0966}}-\x{{096F}}]{{1,4}}\s{{2,}}[\p{{L}}\p{{M}} ]{{4,40}}\s*$')""",
    "K38_replaced_if": f"SELECT doc_id, md5(CASE WHEN length(text) - length(replace(text, 'lamp', '')) = 8 THEN replace(text, 'lamp', 'LAMP') ELSE text END) AS text_md5 FROM {_DOCS}",
    "K40_clean_pages": rf"SELECT id, md5({_strip(rf'''regexp_replace(regexp_replace({_PAGE}, '([A-Za-z])-\n([A-Za-z])', '\1\2', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')''')}) AS page_md5 FROM {_CHUNKS} WHERE kind_level = 'parent'",
    "K41_kebabs": f"SELECT work_id, {_kebab('title')} AS of_title, {_kebab('title_en')} AS of_title_en, {_kebab('title_translit')} AS of_title_translit FROM works",
    "K42_valid_quotes": f"""SELECT DISTINCT quote_id, coalesce(kind IN ('canonical', 'biography', 'athvani', 'reference'), false) AS kind_ok, read_page IS NULL OR read_page >= 1 AS page_ok, coalesce(trim(body, ' ') <> '', false) AS body_ok, coalesce(body = {_leaks('body')}, true) AS clean FROM quotes""",
    "C11_long_enough": rf"""SELECT 'quotes' AS what, count(*) AS n, count(*) FILTER (length(body) >= 40) AS long FROM {_QUOTES} UNION ALL SELECT 'paragraphs', count(*), count(*) FILTER (length(trim(p, ' ')) >= 80) FROM (SELECT unnest(string_split(text, chr(10))) AS p FROM {_DOCS})
      UNION ALL SELECT 'segments', count(*), count(*) FILTER (length(trim(raw_text, ' ')) >= 200) FROM {_TELLING}""",
}

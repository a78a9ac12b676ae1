"""Queries of citing and reading over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pothi.functions import text as tx
from pothi.operators import chunking as ch
from pothi.operators import citations as ci
from pothi.operators import corpus as co
from pothi.operators import reader as rd
from pothi.sources.tables import latest
from pothi.sources.tables import table as t


def _chunks(s, d, *cols):
    return latest(t(s, d, "chunks", *dict.fromkeys(("id", *cols, "built_at"))), ["id"], "built_at").drop("built_at")


def _quotes(s, d, *cols):
    return t(s, d, "quotes", "quote_id", *cols).distinct()


def k07_splice(s, d):
    """Each quotation's stretch of its own body by its anchors, and by its anchors without marks and case kept."""
    q = _quotes(s, d, "quote_start", "quote_end", "body")
    bare = lambda c: F.regexp_replace(tx.folded(F.col(c)), r"[,;:—-]", " ")
    once = ci.with_splice(q, "spliced", F.col("body"), F.col("quote_start"), F.col("quote_end"))
    return ci.with_splice(once, "folded", F.col("body"), bare("quote_start"), bare("quote_end")).select("quote_id", F.md5("spliced").alias("spliced_md5"), F.md5("folded").alias("folded_md5"))


def _passages(s, d):
    """The first passages of each work by letters, as an answer's: recollections restricted to what may be cited."""
    c = _chunks(s, d, "work_id", "kind_level", "kind", "title", "author", "section", "chapter", "text", "cite_text")
    nth = F.row_number().over(W.partitionBy("work_id").orderBy("id")) - 1
    lettered = c.withColumn("nth", nth).where("nth < 26").withColumn("passage", ci.passage_label(F.col("nth")))
    limited = (F.col("kind") == "athvani") & (F.col("kind_level") == "child")
    return lettered.withColumns({"restricted": limited & F.col("cite_text").isNotNull(), "retrieval_only": limited & F.col("cite_text").isNull()})


def k08_spliced(s, d):
    """Quotations spliced from the passages of their work."""
    q = _quotes(s, d, "passage", "quote_start", "quote_end", "body", "kind", "work_title", "author", "location", "work_id")
    out = ci.spliced(q, _passages(s, d).select("work_id", "passage", "text", "cite_text", "title", "author", "kind", "section", "chapter", "restricted", "retrieval_only"), "quote_id", ["work_id"])
    return out.withColumn("body", F.md5("body"))


def k10_check_quotes(s, d):
    q = _quotes(s, d, "work_id", "body").where("work_id <> ''")
    c = _chunks(s, d, "work_id", "kind_level", "text").where("kind_level = 'parent'").select("work_id", "text")
    return ci.check(q, c, "quote_id", "work_id", "body", "text").groupBy("status").agg(F.count("*").alias("n"))


def k24_prompts(s, d):
    """The quotations of an answer as one text: a header each, parted by rules."""
    q = _quotes(s, d, "answer_id", "ord", "work_title", "author", "body")
    some = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("-"))
    block = F.concat(F.lit("["), ci.passage_label(F.col("ord")), F.lit("] "), some("work_title"), F.lit(" · "), some("author"), F.lit("\n"), F.coalesce("body", F.lit("")))
    return q.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "quote_id", block.alias("b")))), lambda x: x["b"]), "\n---\n").alias("p")).select("answer_id", F.md5("p").alias("prompt_md5"))


def k27_locations(s, d):
    """Where a quotation of a work stands: section and chapter of the work's first parent, else what was given."""
    first = _chunks(s, d, "work_id", "kind_level", "section", "chapter").where("kind_level = 'parent'").groupBy("work_id").agg(F.min_by(F.struct("section", "chapter"), "id").alias("f"))
    q = _quotes(s, d, "work_id", "location").join(first, "work_id", "left")
    return q.select("quote_id", ci.location(F.col("f.section"), F.col("f.chapter"), F.col("location")).alias("place"))


def k32_attributions(s, d):
    """Work and author of a quotation without saying the same twice, and its place."""
    q = _quotes(s, d, "work_title", "author", "location")
    w, a, p = (F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")) for c in ("work_title", "author", "location"))
    name = F.when(a.isNotNull() & (w.isNull() | ~F.contains(F.lower(w), F.lower(a))), tx.shown_name(a))
    return q.select("quote_id", F.concat_ws(", ", w, name, p).alias("attribution"))


def k39_body_paragraphs(s, d):
    """Paragraphs of a paraphrase: parted by blank lines, else whole when it is long, else none."""
    q = _quotes(s, d, "paraphrase")
    parts = F.filter(F.transform(F.split(F.coalesce("paraphrase", F.lit("")), r"\n{2,}"), F.trim), lambda x: x != "")
    kept = F.when(F.size(parts) > 1, parts).when(F.length(F.coalesce("paraphrase", F.lit(""))) >= 40, F.array(F.trim("paraphrase"))).otherwise(F.array().cast("array<string>"))
    return q.select("quote_id", F.size(kept).alias("n"), F.md5(F.array_join(kept, "|")).alias("body_md5"))


def s03_replay(s, d):
    """An answer's stored quotations as the events a client saw: one to open, one a quotation, one to close."""
    q = _quotes(s, d, "answer_id", "ord", "body")
    per = q.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("ord", "quote_id"))).alias("qs"))
    event = lambda kind, ref: F.struct(F.lit(kind).alias("event"), ref.cast("string").alias("ref"))
    events = F.concat(F.array(event("retrieval", F.size("qs"))), F.transform("qs", lambda x: event("array_item", x["quote_id"])), F.array(event("done", F.col("answer_id"))))
    return per.select("answer_id", F.posexplode(events).alias("seq", "e")).select("answer_id", "seq", "e.event", "e.ref")


def c10_under_cited(s, d):
    """Answers with passages but without any quotation, though they say two hundred characters or more; the paraphrases are what an answer says."""
    q = _quotes(s, d, "answer_id", "passage", "body", "paraphrase", "quote_start")
    per = q.groupBy("answer_id").agg(F.count("passage").alias("passages"), F.count_if(F.coalesce("body", F.lit("")) != "").alias("cited"), F.sum(F.length(F.coalesce("paraphrase", F.lit(""))) + F.length(F.coalesce("quote_start", F.lit("")))).alias("chars"))
    return per.select("answer_id", "passages", "cited", ((F.col("passages") >= 1) & (F.col("cited") == 0) & (F.col("chars") >= 20)).alias("under_cited"))


def d11_coverage(s, d):
    """Answers that cite at least once, of all of each kind of first quotation."""
    q = _quotes(s, d, "answer_id", "ord", "kind", "body")
    per = q.groupBy("answer_id").agg(F.min_by("kind", F.struct("ord", "quote_id")).alias("kind"), F.max((F.coalesce("body", F.lit("")) != "").cast("int")).alias("grounded"))
    return per.groupBy("kind").agg(F.count("*").alias("answers"), F.sum("grounded").alias("grounded"), F.round(F.avg("grounded"), 6).alias("share"))


def _works_text(s, d):
    """Parents with their headings before them, one text each."""
    p = _chunks(s, d, "work_id", "kind_level", "section", "chapter", "text").where("kind_level = 'parent'")
    head = F.concat(F.lit("## "), F.coalesce("section", F.lit("")), F.when(F.coalesce("chapter", F.lit("")) != "", F.concat(F.lit("\n\n### "), "chapter")).otherwise(""), F.lit("\n\n"))
    return p.select("id", F.concat(head, "text").alias("text"))


def m12_parsed(s, d):
    return rd.parsed(_works_text(s, d), "id", "text").select(F.col("key").alias("id"), "n", F.md5("body").alias("body_md5"), "chapter", "char_start", "char_end")


def m12_verse_book(s, d):
    """Documents read as a book of verses."""
    docs = t(s, d, "documents", "doc_id", "text").distinct()
    return rd.parsed(docs, "doc_id", "text", verse=True).groupBy(F.col("key").alias("doc_id")).agg(F.count("*").alias("n"), F.count_if("is_verse").alias("verses"), F.sum(F.length("body")).alias("chars"))


def g14_contents(s, d):
    """Headings of the works and the page each begins on, at four bodies a page."""
    paras = rd.parsed(_works_text(s, d), "id", "text", headings=True)
    pages = rd.pages_fixed(paras, "key", "n", "chapter", "is_heading").select("key", "n", "page")
    return rd.contents(paras, pages).select(F.col("key").alias("id"), "level", "title", "n", "page")


def m13_headings(s, d):
    return ch.heading_index(_works_text(s, d), "id", "text").select(F.col("key").alias("id"), "char_start", "level", "title")


def h05_headings(s, d):
    """Section and chapter of every line of the works."""
    lines = co.headings(_works_text(s, d), "id", F.split("text", "\n"))
    return lines.groupBy(F.col("key").alias("id"), "section", "chapter").agg(F.count("*").alias("lines"))


def g11_heading_of_piece(s, d):
    """Section and chapter in force at the end of each third of a work's text."""
    pieces = _works_text(s, d).select(F.col("id").alias("key"), F.length("text").alias("n")).select("key", "n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("no")).select("key", "no", F.greatest(F.lit(1), F.floor(F.col("n") * F.col("no") / 3)).cast("int").alias("char_end"))
    return ch.headings_of(pieces, ch.heading_index(_works_text(s, d), "id", "text")).select(F.col("key").alias("id"), "no", "section", "chapter")


def _work_paragraphs(s, d):
    c = _chunks(s, d, "work_id", "kind_level", "chunk_index", "chapter", "char_start", "text").where("kind_level = 'parent'")
    n = F.row_number().over(W.partitionBy("work_id").orderBy("chunk_index", "id"))
    return c.select("work_id", n.alias("n"), F.coalesce("chapter", F.lit("")).alias("chapter"), F.col("text").alias("body"), "char_start")


def g10_quote_pages(s, d):
    q = _quotes(s, d, "work_id", "body").where("work_id <> '' AND body <> ''")
    return rd.pages_of_quotes(q, _work_paragraphs(s, d), "quote_id", "work_id", "body")


def g15_read_pages(s, d):
    """The page a canonical quotation stands on: by its text, else by its number among the work's passages."""
    q = _quotes(s, d, "work_id", "body", "kind", "ord").where("kind = 'canonical' AND work_id <> ''")
    paras = _work_paragraphs(s, d)
    pages = rd.pages_fixed(paras.withColumn("st", F.lit(False)), "work_id", "n", "chapter", "st").select("work_id", "n", "page")
    by_text = rd.pages_of_quotes(q.where("body <> ''"), paras, "quote_id", "work_id", "body").withColumnRenamed("n", "by_text")
    last = paras.groupBy("work_id").agg(F.max("n").alias("most"))
    found = q.join(by_text, "quote_id", "left").join(last, "work_id", "left").withColumn("n", F.coalesce("by_text", F.least(F.col("ord") + 1, F.col("most"))))
    return found.join(pages, ["work_id", "n"], "left").select("quote_id", "page")


def k31_joined_paragraphs(s, d):
    """Lines of the scans as paragraphs: one that goes on where the line before had no end joins it, a hyphen at the end goes."""
    lines = _chunks(s, d, "kind_level", "text").where("kind_level = 'parent'").select("id", F.posexplode(F.split("text", "\n")).alias("at", "l")).select("id", "at", F.trim("l").alias("l")).where("l <> ''")
    w = W.partitionBy("id").orderBy("at")
    goes_on = F.coalesce(~F.lag("l").over(w).rlike("[.!?।॥…:”’\"]$"), F.lit(False))
    run = lines.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(w))
    piece = F.when(F.col("l").rlike("-$"), F.regexp_replace("l", "-$", "")).otherwise(F.concat("l", F.lit(" ")))
    return run.groupBy("id", "run").agg(F.count("*").alias("n_lines"), F.md5(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", piece.alias("p")))), lambda x: x["p"]), ""))).alias("par_md5"))


QUERIES = {n[0].upper() + n[1:]: f for n, f in list(globals().items()) if n[0] in "kcdgmhs" and n[1:3].isdigit()}

_CHUNKS = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY built_at DESC) = 1)"
_SP = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_strip = lambda x: f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"
_from, _to = tx.foldings()
_fold = lambda x: f"translate({x}, '{_from}', '{_to}')"
_pat = lambda x: rf"nullif(array_to_string(regexp_extract_all(coalesce({x}, ''), '[\p{{L}}\p{{N}}_]+'), '[^\p{{L}}\p{{N}}_]+'), '')"
_CLEAN = lambda x: rf"regexp_replace(replace({x}, '�', ' '), '[\x{{200B}}\x{{FEFF}}\x{{0000}}-\x{{0008}}\x{{000B}}\x{{000C}}\x{{000E}}-\x{{001F}}\x{{007F}}-\x{{009F}}]', '', 'g')"


def _splice(source: str, text: str, start: str, end: str, keep: str) -> str:
    """Rows of ``source`` with ``sp``, by the prefixes that the patterns cut off."""
    return f"""(SELECT {keep}, CASE WHEN pre IS NULL THEN NULL ELSE {_strip("substr(tx, length(pre) + 1, CASE WHEN p2 IS NULL OR p1 = p2 THEN length(m1) WHEN reach IS NOT NULL THEN length(m1) + length(reach) WHEN b <> '' THEN length(m1) + length(b) ELSE length(tx) END)")} END AS sp FROM (
      SELECT *, CASE WHEN regexp_matches(rest, p2) THEN regexp_extract(rest, '(?s)^.*?' || p2) END AS reach, regexp_extract(substr(tx, length(pre) + length(m1) + 1), '(?s)^.*?(?:[।.!?]["''’”\\)\\]]?(?:\\s|$)|\\n\\s*\\n)') AS b FROM (
        SELECT *, substr(wi, length(pre) + length(m1) + 1) AS rest FROM (
          SELECT *, CASE WHEN regexp_matches(wi, p1) THEN regexp_extract(wi, '(?s)^(.*?)' || p1, 1) END AS pre, regexp_extract(wi, p1) AS m1 FROM (
            SELECT {keep}, {text} AS tx, CASE WHEN coalesce(regexp_matches({text}, {_pat(start)}), false) THEN {text} ELSE {_fold(text)} END AS wi,
              CASE WHEN coalesce(regexp_matches({text}, {_pat(start)}), false) THEN {_pat(start)} ELSE {_pat(_fold(start))} END AS p1, CASE WHEN coalesce(regexp_matches({text}, {_pat(start)}), false) THEN {_pat(end)} ELSE {_pat(_fold(end))} END AS p2 FROM {source})))))"""


_Q = "(SELECT DISTINCT quote_id, quote_start, quote_end, body FROM quotes)"
_BARE = lambda c: f"regexp_replace({_fold(c)}, '[,;:—-]', ' ', 'g')"
_PASSAGES = f"""(SELECT work_id AS wid, chr(65 + CAST(row_number() OVER (PARTITION BY work_id ORDER BY id) - 1 AS INT)) AS letter, row_number() OVER (PARTITION BY work_id ORDER BY id) AS nth, text, cite_text, title, author AS p_author, kind AS p_kind, section, chapter,
  kind = 'athvani' AND kind_level = 'child' AND cite_text IS NOT NULL AS restricted, kind = 'athvani' AND kind_level = 'child' AND cite_text IS NULL AS barred FROM {_CHUNKS} QUALIFY nth <= 26)"""
_WORKS = f"(SELECT id, '## ' || coalesce(section, '') || CASE WHEN coalesce(chapter, '') <> '' THEN chr(10) || chr(10) || '### ' || chapter ELSE '' END || chr(10) || chr(10) || text AS text FROM {_CHUNKS} WHERE kind_level = 'parent')"
_MD = lambda x: rf"replace(regexp_replace(regexp_replace({x}, '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g'), '`', '')"
_BLOCKS = rf"""bl AS (SELECT id, pos, p, sum(length(p)) OVER (PARTITION BY id ORDER BY pos) AS e FROM (SELECT id, unnest(list_transform(string_split(regexp_replace(text, '(\n{{2,}})', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x, i: {{'p': x, 'pos': i}}), recursive := true) FROM {_WORKS})),
  bk AS (SELECT id, pos, {_strip('p')} AS b, e - length(p) AS char_start, e AS char_end FROM bl WHERE pos % 2 = 1 AND {_strip('p')} <> ''),
  hd AS (SELECT *, length(regexp_extract(b, '^(#{{1,6}})\s', 1)) AS level, {_MD(_strip("regexp_extract(b, '^#{1,6}" + chr(92) + "s+(.*)', 1)"))} AS title, regexp_extract(b, '^\*\*(.+?)\*\*[.:]?$', 1) AS bold FROM bk),
  cp AS (SELECT *, coalesce(last_value(CASE WHEN level BETWEEN 1 AND 3 THEN title WHEN level = 0 AND bold <> '' THEN bold END IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos), '') AS chapter FROM hd)"""
_PARAS = f"(SELECT work_id, row_number() OVER (PARTITION BY work_id ORDER BY chunk_index, id) AS n, coalesce(chapter, '') AS chapter, text AS body FROM {_CHUNKS} WHERE kind_level = 'parent')"
_NORM = lambda x: f"trim(regexp_replace({_MD(x)}, '{_SP}+', ' ', 'g'), ' ')"
_ANCHORED = f"""win AS (SELECT quote_id, work_id, a * 3 + b AS w, substr(q, [0, 30, 60, 100, 150][a + 1] + 1, [60, 40, 24][b + 1]) AS k FROM (SELECT quote_id, work_id, {_NORM('body')} AS q FROM (SELECT DISTINCT quote_id, work_id, body FROM quotes WHERE work_id <> '' AND body <> '')) CROSS JOIN range(5) x(a) CROSS JOIN range(3) y(b)),
  hit AS (SELECT quote_id, n FROM (SELECT quote_id, w, n FROM win JOIN (SELECT work_id, n, {_NORM('body')} AS p FROM {_PARAS}) USING (work_id) WHERE length(k) >= 12 AND contains(p, k)) QUALIFY row_number() OVER (PARTITION BY quote_id ORDER BY w, n) = 1)"""

SQL = {
    "K07_splice": f"SELECT quote_id, md5(a.sp) AS spliced_md5, md5(b.sp) AS folded_md5 FROM {_splice(_Q, 'body', 'quote_start', 'quote_end', 'quote_id, quote_start, quote_end, body')} a JOIN {_splice(_Q, 'body', _BARE('quote_start'), _BARE('quote_end'), 'quote_id, quote_start, quote_end, body')} b USING (quote_id)",
    "K08_spliced": f"""WITH q AS (SELECT DISTINCT quote_id, trim(coalesce(passage, ''), ' ') AS passage, coalesce(quote_start, '') AS qs, coalesce(quote_end, '') AS qe, coalesce(body, '') AS own, kind, work_title, author, location, work_id FROM quotes),
      j AS (SELECT q.*, p.*, letter IS NOT NULL AS known, passage <> '' OR qs <> '' OR qe <> '' AS ref, coalesce(CASE WHEN restricted THEN coalesce(nullif(cite_text, ''), nullif(text, '')) ELSE coalesce(nullif(text, ''), nullif(cite_text, '')) END, '') AS src FROM q LEFT JOIN {_PASSAGES} p ON q.work_id = p.wid AND q.passage = p.letter),
      s AS {_splice('j', 'src', 'qs', 'qe', 'quote_id, src, qs, qe')},
      r AS (SELECT j.*, s.sp, ref AND known AND NOT coalesce(barred, false) AS given, CASE WHEN NOT ref OR NOT known THEN own WHEN barred THEN '' WHEN s.sp IS NOT NULL THEN s.sp WHEN j.src <> '' THEN j.src ELSE own END AS raw FROM j JOIN s USING (quote_id)),
      k AS (SELECT *, CASE WHEN given AND p_kind IN ('canonical', 'biography', 'athvani', 'reference') THEN p_kind WHEN kind IN ('canonical', 'biography', 'athvani', 'reference') THEN kind ELSE 'canonical' END AS kd, {_CLEAN('raw')} AS bd FROM r)
      SELECT quote_id, md5(bd) AS body, CASE WHEN given THEN coalesce(nullif(title, ''), nullif(wid, ''), nullif(work_title, ''), '') ELSE coalesce(work_title, '') END AS work_title, CASE WHEN given AND restricted THEN '' WHEN given THEN coalesce(nullif(p_author, ''), nullif(author, ''), '') ELSE coalesce(author, '') END AS author, kd AS kind,
        coalesce(CASE WHEN known THEN coalesce(nullif(concat_ws(' · ', nullif(trim(section, ' '), ''), nullif(trim(chapter, ' '), '')), ''), location) ELSE location END, '') AS location, CASE WHEN given AND kd = 'canonical' THEN coalesce(wid, '') ELSE '' END AS work_id, CASE WHEN NOT ref THEN own <> '' ELSE given AND sp IS NOT NULL END AS clean, trim(bd, ' ') <> '' AS kept FROM k""",
    "K24_prompts": """WITH q AS (SELECT DISTINCT quote_id, answer_id, ord, work_title, author, body FROM quotes) SELECT answer_id, md5(string_agg('[' || CASE WHEN ord < 26 THEN chr(65 + ord) ELSE chr(65 + ord // 26 - 1) || chr(65 + ord % 26) END || '] ' || coalesce(nullif(trim(work_title, ' '), ''), '-') || ' · ' || coalesce(nullif(trim(author, ' '), ''), '-') || chr(10) || coalesce(body, ''), chr(10) || '---' || chr(10) ORDER BY ord, quote_id)) AS prompt_md5 FROM q GROUP BY answer_id""",
    "K27_locations": f"""SELECT quote_id, coalesce(nullif(concat_ws(' · ', nullif(trim(section, ' '), ''), nullif(trim(chapter, ' '), '')), ''), location) AS place FROM (SELECT DISTINCT quote_id, work_id, location FROM quotes) LEFT JOIN (SELECT work_id, section, chapter FROM {_CHUNKS} WHERE kind_level = 'parent' QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY id) = 1) USING (work_id)""",
    "K32_attributions": """SELECT quote_id, concat_ws(', ', w, CASE WHEN a IS NOT NULL AND (w IS NULL OR NOT contains(lower(w), lower(a))) THEN array_to_string(list_transform(string_split(replace(a, '_', ' '), '-'), lambda x: array_to_string(list_transform(string_split(x, ' '), lambda y: upper(left(y, 1)) || lower(substr(y, 2))), ' ')), '-') END, p) AS attribution
      FROM (SELECT DISTINCT quote_id, nullif(trim(work_title, ' '), '') AS w, nullif(trim(author, ' '), '') AS a, nullif(trim(location, ' '), '') AS p FROM quotes)""",
    "K39_body_paragraphs": r"""SELECT quote_id, len(k) AS n, md5(array_to_string(k, '|')) AS body_md5 FROM (SELECT quote_id, CASE WHEN len(ps) > 1 THEN ps WHEN length(x) >= 40 THEN [trim(x, ' ')] ELSE [] END AS k FROM (SELECT quote_id, coalesce(paraphrase, '') AS x, list_filter(list_transform(regexp_split_to_array(coalesce(paraphrase, ''), '\n{2,}'), lambda p: trim(p, ' ')), lambda p: p <> '') AS ps FROM (SELECT DISTINCT quote_id, paraphrase FROM quotes)))""",
    "S03_replay": """WITH q AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY ord, quote_id) AS r, count(*) OVER (PARTITION BY answer_id) AS c FROM (SELECT DISTINCT quote_id, answer_id, ord, body FROM quotes))
      SELECT answer_id, r AS seq, 'array_item' AS event, CAST(quote_id AS VARCHAR) AS ref FROM q UNION ALL SELECT DISTINCT answer_id, 0, 'retrieval', CAST(c AS VARCHAR) FROM q UNION ALL SELECT DISTINCT answer_id, c + 1, 'done', CAST(answer_id AS VARCHAR) FROM q""",
    "C10_under_cited": "SELECT answer_id, count(passage) AS passages, count(*) FILTER (coalesce(body, '') <> '') AS cited, count(passage) >= 1 AND count(*) FILTER (coalesce(body, '') <> '') = 0 AND sum(length(coalesce(paraphrase, '')) + length(coalesce(quote_start, ''))) >= 20 AS under_cited FROM (SELECT DISTINCT quote_id, answer_id, passage, body, paraphrase, quote_start FROM quotes) GROUP BY answer_id",
    "D11_coverage": "SELECT kind, count(*) AS answers, sum(g) AS grounded, round(avg(g), 6) AS share FROM (SELECT answer_id, arg_min(kind, (ord, quote_id)) AS kind, max(CASE WHEN coalesce(body, '') <> '' THEN 1 ELSE 0 END) AS g FROM (SELECT DISTINCT quote_id, answer_id, ord, kind, body FROM quotes) GROUP BY answer_id) GROUP BY kind",
    "M12_parsed": f"WITH {_BLOCKS} SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) AS n, md5(CASE WHEN level > 0 THEN title ELSE {_MD('b')} END) AS body_md5, chapter, char_start, char_end FROM cp WHERE level >= 4 OR (level = 0 AND bold = '' AND length(b) >= 80)",
    "G14_contents": f"""WITH {_BLOCKS}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM cp WHERE level > 0 OR (bold = '' AND length(b) >= 80)), a AS (SELECT *, CASE WHEN chapter = lag(chapter) OVER (PARTITION BY id ORDER BY n) THEN 0 ELSE 1 END AS t FROM k), r AS (SELECT *, sum(t) OVER (PARTITION BY id ORDER BY n) AS run FROM a),
      c AS (SELECT *, floor(coalesce(sum(CASE WHEN level BETWEEN 1 AND 3 THEN 0 ELSE 1 END) OVER (PARTITION BY id, run ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 4) AS pg FROM r), p AS (SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY run, pg) AS page FROM c)
      SELECT id, level, regexp_replace(title, '\\.$', '') AS title, n, page FROM p WHERE level BETWEEN 2 AND 3 OR (level >= 4 AND regexp_matches(title, '^[IVXL]+\\.?$'))""",
    "M13_headings": rf"""SELECT id, char_start, length(regexp_extract(l, '^(#{{2,3}})[ \t]+(.+?)\s*$', 1)) AS level, regexp_extract(l, '^(#{{2,3}})[ \t]+(.+?)\s*$', 2) AS title FROM (SELECT id, l, coalesce(sum(length(l) + 1) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM (SELECT id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {{'l': x, 'pos': i}}), recursive := true) FROM {_WORKS})) WHERE regexp_matches(l, '^#{{2,3}}[ \t]+.+?\s*$')""",
    "H05_headings": rf"""WITH l AS (SELECT id, pos, l, CASE WHEN regexp_matches(l, '^##[ \t]+\S') THEN regexp_extract(l, '^##[ \t]+(.+?)\s*$', 1) END AS s, CASE WHEN regexp_matches(l, '^###[ \t]+\S') THEN regexp_extract(l, '^###[ \t]+(.+?)\s*$', 1) END AS c FROM (SELECT id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {{'l': x, 'pos': i}}), recursive := true) FROM {_WORKS})),
      g AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos), '') AS section, count(s) OVER (PARTITION BY id ORDER BY pos) AS k FROM l) SELECT id, section, chapter, count(*) AS lines FROM (SELECT *, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY id, k ORDER BY pos), '') AS chapter FROM g) GROUP BY ALL""",
    "G11_heading_of_piece": rf"""WITH h AS (SELECT id, char_start, regexp_extract(l, '^(#{{2,3}})[ \t]', 1) AS m, regexp_extract(l, '^#{{2,3}}[ \t]+(.+?)\s*$', 1) AS title FROM (SELECT id, l, coalesce(sum(length(l) + 1) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM (SELECT id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {{'l': x, 'pos': i}}), recursive := true) FROM {_WORKS})) WHERE regexp_matches(l, '^#{{2,3}}[ \t]+.+')),
      p AS (SELECT id, no, greatest(1, CAST(floor(length(text) * no / 3) AS INT)) AS e FROM {_WORKS} CROSS JOIN range(1, 4) r(no)), s AS (SELECT p.id, no, e, max(char_start) FILTER (m = '##' AND char_start < e) AS sa FROM p LEFT JOIN h USING (id) GROUP BY ALL), c AS (SELECT s.id, no, sa, max(char_start) FILTER (m = '###' AND char_start < e AND char_start >= coalesce(sa, 0)) AS ca FROM s LEFT JOIN h USING (id) GROUP BY ALL)
      SELECT c.id, no, coalesce(a.title, '') AS section, coalesce(b.title, '') AS chapter FROM c LEFT JOIN h a ON a.id = c.id AND a.char_start = sa LEFT JOIN h b ON b.id = c.id AND b.char_start = ca""",
    "G10_quote_pages": f"WITH {_ANCHORED} SELECT quote_id, n FROM hit",
    "G15_read_pages": f"""WITH {_ANCHORED}, p AS {_PARAS}, a AS (SELECT *, CASE WHEN chapter = lag(chapter) OVER (PARTITION BY work_id ORDER BY n) THEN 0 ELSE 1 END AS t FROM p), r AS (SELECT *, sum(t) OVER (PARTITION BY work_id ORDER BY n) AS run FROM a),
      g AS (SELECT work_id, n, dense_rank() OVER (PARTITION BY work_id ORDER BY run, (row_number() OVER (PARTITION BY work_id, run ORDER BY n) - 1) // 4) AS page FROM (SELECT work_id, n, run FROM r)), q AS (SELECT DISTINCT quote_id, work_id, ord FROM quotes WHERE kind = 'canonical' AND work_id <> '')
      SELECT quote_id, page FROM (SELECT q.quote_id, q.work_id, coalesce(hit.n, least(ord + 1, m)) AS n FROM q LEFT JOIN hit USING (quote_id) LEFT JOIN (SELECT work_id, max(n) AS m FROM p GROUP BY work_id) USING (work_id)) LEFT JOIN g USING (work_id, n)""".replace("dense_rank() OVER (PARTITION BY work_id ORDER BY run, (row_number() OVER (PARTITION BY work_id, run ORDER BY n) - 1) // 4) AS page FROM (SELECT work_id, n, run FROM r)", "dense_rank() OVER (PARTITION BY work_id ORDER BY run, k) AS page FROM (SELECT work_id, n, run, (row_number() OVER (PARTITION BY work_id, run ORDER BY n) - 1) // 4 AS k FROM r)"),
    "K31_joined_paragraphs": """WITH l AS (SELECT id, pos, trim(l, ' ') AS l FROM (SELECT id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'l': x, 'pos': i}), recursive := true) FROM CH WHERE kind_level = 'parent') WHERE trim(l, ' ') <> ''),
      r AS (SELECT *, sum(CASE WHEN coalesce(NOT regexp_matches(pl, '[.!?।॥…:”’"]$'), false) THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY pos) AS run FROM (SELECT *, lag(l) OVER (PARTITION BY id ORDER BY pos) AS pl FROM l))
      SELECT id, run, count(*) AS n_lines, md5(trim(string_agg(CASE WHEN ends_with(l, '-') THEN left(l, length(l) - 1) ELSE l || ' ' END, '' ORDER BY pos), ' ')) AS par_md5 FROM r GROUP BY id, run""".replace("CH", _CHUNKS),
}

"""Queries of building and checking a corpus over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pothi import sinks
from pothi.functions import text as tx
from pothi.operators import chunking as ch
from pothi.operators import corpus as co
from pothi.plans.lineage import new_path
from pothi.sources import trees
from pothi.sources.tables import latest
from pothi.sources.tables import table as t


def _chunks(s, d, *cols):
    return latest(t(s, d, "chunks", *dict.fromkeys(("id", *cols, "built_at"))), ["id"], "built_at").drop("built_at")


def _documents(s, d, *cols):
    return t(s, d, "documents", *cols).distinct()


def _recurring(texts, doc):
    """Lines that recur eight times in a file and on a fifth of its pages, of texts(doc, text); a page has 1800 characters."""
    pages = texts.groupBy(doc).agg(F.greatest(F.lit(1), F.floor(F.sum(F.length("text")) / 1800)).alias("pages"))
    lines = texts.select(doc, F.explode(F.split("text", "\n")).alias("l")).select(doc, F.trim("l").alias("line")).where((F.length("line") > 3) & (F.length("line") <= 80) & ~F.col("line").rlike(r"^[०-९\d\s।॥\-\.]+$"))
    counted = lines.groupBy(doc, "line").agg(F.count("*").alias("n")).join(pages, doc)
    return counted.where(F.col("n") >= F.greatest(F.lit(8), F.floor(F.col("pages") * 0.2)))


def d06_running_headers(s, d):
    """Lines that recur in the texts of a source, taken as one file."""
    return _recurring(_documents(s, d, "doc_id", "source", "text").where("text IS NOT NULL").select(F.trim("source").alias("source"), "text"), "source")


def d07_file_gate(s, d):
    """Every file's shares of broken, miscoded and Devanagari characters, its recurring lines, and a verdict."""
    f = _chunks(s, d, "source_path", "kind_level", "text").where("kind_level = 'parent'")
    count = lambda c: F.sum(F.length("text") - F.length(F.regexp_replace("text", c, "")))
    sums = f.groupBy("source_path").agg(F.sum(F.length("text")).alias("n"), count("�").alias("b"), count("[˜Ï¡Ô†¬»½ѽ]").alias("m"), count("[ऀ-ॿ]").alias("v"))
    leaks = _recurring(f.select("source_path", "text"), "source_path").groupBy("source_path").agg(F.count("*").alias("leaks"))
    share = lambda c: F.round(F.col(c) / F.greatest(F.lit(1), F.col("n")), 6)
    out = sums.join(leaks, "source_path", "left").select("source_path", share("b").alias("broken"), share("m").alias("mojibake"), share("v").alias("devanagari"), F.coalesce("leaks", F.lit(0)).alias("leaks"))
    return out.withColumn("verdict", F.when((F.col("broken") > 0.001) | (F.col("mojibake") > 0.0005) | (F.col("leaks") > 0), "fail").when(F.col("devanagari") < 0.35, "warn").otherwise("pass"))


def d08_verdict(s, d):
    c = _chunks(s, d, "kind_level", "text", "cite_text").where("cite_text IS NOT NULL")
    return co.verdict(co.gate(c, "id", "text"), co.gate(c, "id", "cite_text")).groupBy("verdict").agg(F.count("*").alias("n"))


def c09_noise_filters(s, d):
    """Documents whose words are mostly short, often numbers, or those of page heads."""
    w = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{M}\p{N}]+", " "), " "), lambda x: x != "")
    docs = _documents(s, d, "doc_id", "text").select("doc_id", w.alias("w")).where("size(w) > 0")
    share = lambda f: F.size(F.filter("w", f)) / F.size("w")
    head = F.size(F.filter("w", lambda x: x.isin("chapter", "part", "chap", "page", "vol", "i", "ii", "iii")))
    return docs.select("doc_id", (share(lambda x: F.length(x) <= 3) > 0.6).alias("ocr_noise"), (share(lambda x: x.rlike("^[0-9०-९]+$")) > 0.3).alias("index_entries"), ((head >= 3) | (head / F.size("w") > 0.5)).alias("page_header"))


def g03_orphans(s, d):
    """Children without a parent in builds before July, works without any chunk, and works of chunks that aren't in the catalogue."""
    early = t(s, d, "chunks", "id", "parent_id", "kind_level", "work_id", "built_at")
    lost = co.orphans(early.where("kind_level = 'child'"), early.where("kind_level = 'parent' AND built_at >= timestamp'2026-07-01'"), "parent_id", "id").select(F.lit("child without parent").alias("what"), "id")
    works, used = t(s, d, "works", "work_id"), t(s, d, "chunks", "work_id").distinct()
    bare = works.join(used, "work_id", "left_anti").select(F.lit("work without chunk").alias("what"), F.col("work_id").alias("id"))
    unknown = used.join(works, "work_id", "left_anti").select(F.lit("unknown work").alias("what"), F.col("work_id").alias("id"))
    return lost.unionByName(bare).unionByName(unknown).groupBy("what").agg(F.count_distinct("id").alias("n"), F.min("id").alias("first"))


def h14_section_slices(s, d):
    """Each chapter's text: the parents from where it begins to where the next does."""
    c = _chunks(s, d, "work_id", "kind_level", "chunk_index", "chapter", "text").where("kind_level = 'parent'")
    w = W.partitionBy("work_id").orderBy("chunk_index", "id")
    turn = F.when(F.coalesce(F.lag("chapter").over(w) == F.col("chapter"), F.lit(False)), 0).otherwise(1)
    run = c.withColumns({"n": F.row_number().over(w), "slice": F.sum(turn).over(w)})
    return run.groupBy("work_id", "slice").agg(F.first("chapter").alias("chapter"), F.min("n").alias("first"), F.max("n").alias("last"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n")).alias("text_md5"))


def f06_embedded_text(s, d):
    """What would be embedded of a chunk: what may be cited, else its text."""
    return _chunks(s, d, "cite_text", "text").select("id", F.md5(F.coalesce(F.nullif("cite_text", F.lit("")), F.nullif("text", F.lit("")), F.lit(""))).alias("text_md5"))


def f09_quality_table(s, d):
    """Chunks by whether they are junk, and whether their stored score is that of their text."""
    q = co.quality(_chunks(s, d, "text", "quality_score").withColumnRenamed("quality_score", "stored"))
    return q.groupBy((F.col("quality_score") < 0.5).alias("junk"), F.col("stored").isNull().alias("unscored")).agg(F.count("*").alias("n"))


def d16_changed(s, d):
    """What a new build has to do with each chunk: nothing, write its columns anew, or encode its text anew."""
    c = t(s, d, "chunks", "id", "text", "title", "section", "chapter", "built_at").where("id IS NOT NULL")
    row = F.struct("text", "title", "section", "chapter")
    ends = c.groupBy("id").agg(F.min_by(row, F.struct("built_at", F.md5("text"))).alias("old"), F.max_by(row, F.struct("built_at", F.md5("text"))).alias("new"), F.count_distinct("built_at").alias("builds"))
    same = lambda f: F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}"))
    state = F.when(F.col("builds") == 1, "single").when(~same("text"), "encode").when(~(same("title") & same("section") & same("chapter")), "metadata").otherwise("skip")
    return ends.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def b01_routed(s, d):
    """Parents and children in tables of their own, and the counts of what was written."""
    c = _chunks(s, d, "kind_level", "kind", "language", "token_estimate", "text")
    paths = {k: new_path(s, k) for k in ("parent", "child")}
    sinks.write_routed(c, "kind_level", paths)
    read = lambda k: s.read.parquet(paths[k]).groupBy("kind_level", "kind").agg(F.count("*").alias("n"), F.sum("token_estimate").alias("tokens"))
    return read("parent").unionByName(read("child"))


def b03_versions(s, d):
    """Two builds of the chunks side by side, neither changed by the other."""
    root, c = new_path(s, "versions"), t(s, d, "chunks", "id", "built_at", "text")
    sinks.write_version(c.where("built_at < timestamp'2026-07-01'"), root, "early")
    sinks.write_version(c, root, "all")
    return sinks.versions(s, root).groupBy("version").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


def b04_meta(s, d):
    """The chunks without their text, written and read."""
    path = new_path(s, "meta")
    sinks.write_meta(_chunks(s, d, "work_id", "kind", "text"), path)
    back = s.read.parquet(path)
    return back.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("work_id").alias("works")).withColumn("columns", F.lit(",".join(sorted(back.columns))))


def b05_queue(s, d):
    """Requests appended in two batches, then merged: the latest of each reader and path."""
    log = t(s, d, "access_log", "name", "path", "status", "received_at").where("name IS NOT NULL AND path IS NOT NULL")
    path, to = new_path(s, "queue"), new_path(s, "queue")
    sinks.append(log.where("received_at < timestamp'2026-02-01'"), path)
    sinks.append(log.where("received_at >= timestamp'2026-02-01' AND status < 400"), path)
    sinks.rewrite(s, path, log.where("received_at >= timestamp'2026-02-01' AND status >= 400"), ["name", "path"], "received_at", to)
    return s.read.parquet(to).groupBy("status").agg(F.count("*").alias("n"))


def b07_lines(s, d):
    """Works as JSON lines, read back."""
    path = new_path(s, "lines")
    sinks.write_lines(t(s, d, "works"), path)
    good, bad = trees.json_lines(s, path, "work_id STRING, title STRING, title_en STRING, author STRING, kind STRING, languages ARRAY<STRING>")
    return good.select("work_id", "title", F.array_join("languages", ",").alias("languages")).unionByName(bad.select(F.col("_bad").alias("work_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("languages")))


def b08_contents(s, d):
    """Works and chunks of each kind as a page of text; its lines."""
    m = co.manifest(_chunks(s, d, "work_id", "kind", "author", "title", "language"))
    page = sinks.rendered(m, "kind", "work_id", "chunks")
    return s.createDataFrame([(i, l) for i, l in enumerate(page.split("\n"))], "line_no int, line string")


def a14_work_paths(s, d):
    """Folders of the works and of their old copies, and which of them are works."""
    w = t(s, d, "works", "work_id", "path")
    seen = w.select("path").unionByName(w.select(F.concat(F.regexp_replace("path", "/$", ""), F.lit(".bak/")).alias("path"))).unionByName(w.select(F.regexp_replace("path", "/([^/]+)/$", "/.$1/").alias("path")))
    name = F.element_at(F.split(F.regexp_replace("path", "/$", ""), "/"), -1)
    return seen.select(name.alias("folder"), (~name.rlike(r"^\.|\.bak|\.pre-|\.old")).alias("is_work")).groupBy("is_work").agg(F.count("*").alias("n"), F.count_distinct("folder").alias("folders"))


def a15_resolved_paths(s, d):
    """The file of each work in a language: in Marathi if there is one, else in the first language that has one, else its folder."""
    files = _chunks(s, d, "work_id", "source_path").where("source_path IS NOT NULL").select("work_id", "source_path").distinct()
    lang = F.element_at(F.split("source_path", "/"), -2)
    best = files.groupBy("work_id").agg(F.min(F.struct(F.when(lang == "mr", 0).otherwise(1).alias("p"), lang.alias("l"), "source_path")).alias("r"))
    return t(s, d, "works", "work_id", "path").join(best, "work_id", "left").select("work_id", F.coalesce("r.source_path", "path").alias("file"), F.coalesce("r.l", F.lit("")).alias("language"))


def a16_page_blocks(s, d):
    """Paragraphs of scanned pages kept as JSON of blocks: in reading order, heads and feet left out, HTML read."""
    p = _chunks(s, d, "kind_level", "text").where("kind_level = 'parent'")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    block = lambda l, i: F.struct(F.when(i % 7 != 3, F.size(lines) - i).alias("reading_order"), F.when(l.rlike("^\\s*[0-9०-९]+\\s*$"), "PageNumber").otherwise("Text").alias("label"), F.concat(F.lit("<p>"), F.replace(l, F.lit("&"), F.lit("&amp;")), F.lit("<br/></p>")).alias("html"))
    pages = p.select("id", F.to_json(F.struct(F.transform(lines, block).alias("blocks"))).alias("page"))
    read = F.from_json("page", "blocks array<struct<reading_order:int,label:string,html:string>>")
    each = pages.select("id", F.posexplode(read["blocks"]).alias("at", "b")).where("b.label <> 'PageNumber'").select("id", "at", F.coalesce("b.reading_order", F.lit(1_000_000_000)).alias("o"), tx.plain_text(F.col("b.html")).alias("x")).where("x <> ''")
    return each.groupBy("id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "at", "x"))), lambda x: x["x"]), "\n")).alias("page_md5"))


def a20_browser(s, d):
    """Works with their languages: how many texts and words each has, and how the first begins."""
    c = _chunks(s, d, "work_id", "language", "kind_level", "text").where("kind_level = 'parent'").select("work_id", F.coalesce("language", F.lit("")).alias("language"), "id", "text")
    per = c.groupBy("work_id", "language").agg(F.count("*").alias("texts"), F.sum(F.regexp_count("text", F.lit(r"[^ \n]+"))).alias("words"), F.min_by("text", "id").alias("t"))
    return per.select("work_id", "language", "texts", "words", tx.shortened(F.col("t"), 40).alias("preview"))


def j01_union_sources(s, d):
    """Texts of all sources in their order."""
    part = lambda n, name, df, key, text: df.select(F.lit(n).alias("ord"), F.lit(name).alias("src"), F.col(key).cast("string").alias("key"), F.length(text).alias("chars"))
    c = _chunks(s, d, "kind_level", "text")
    told = t(s, d, "meta", "variants").select(F.explode("variants").alias("v")).select(F.col("v.file").alias("file"), F.col("v.text").alias("text"))
    sent = t(s, d, "candidate", "file", "idx", "raw_text").distinct().select(F.concat_ws("#", "file", "idx").alias("key"), "raw_text")
    parts = [part(1, "parents", c.where("kind_level = 'parent'"), "id", "text"), part(2, "children", c.where("kind_level = 'child'"), "id", "text"), part(3, "documents", _documents(s, d, "doc_id", "text"), "doc_id", "text"), part(4, "quotes", t(s, d, "quotes", "quote_id", "body").distinct(), "quote_id", "body"), part(5, "tellings", told, "file", "text"), part(6, "candidates", sent, "key", "raw_text")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("ord", "src").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.sum("chars").alias("chars"))


def d15_row_alignment(s, d):
    """Rows of three tables that should agree: chunks, their quality scores, their texts to embed."""
    c = t(s, d, "chunks", "id", "quality_score", "text").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.count("quality_score").alias("scored"), F.count("text").alias("texts"))
    return c.withColumn("aligned", (F.col("rows") == F.col("ids")) & (F.col("ids") == F.col("scored")) & (F.col("scored") == F.col("texts")))


def d03_library_stats(s, d):
    """Stories by member: with texts, with several tellings, consolidated, tellings by language."""
    m = t(s, d, "meta", "about_member", "variants", "consolidated")
    n = F.coalesce(F.size("variants"), F.lit(0))
    told = F.filter("variants", lambda v: F.coalesce(F.length(v["text"]), F.lit(0)) > 0)
    mr = F.size(F.filter("variants", lambda v: v["language"] == "mr"))
    return m.groupBy("about_member").agg(F.count("*").alias("stories"), F.count_if(F.size(told) > 0).alias("with_text"), F.count_if(n >= 2).alias("several"), F.sum(F.greatest(n, F.lit(0))).alias("variants"), F.sum(F.greatest(mr, F.lit(0))).alias("in_marathi"), F.count_if(F.col("consolidated").isNotNull()).alias("consolidated"))


def m05_segments(s, d):
    """Tellings of a file that came as one text: joined by asterisks and parted again."""
    c = t(s, d, "candidate", "file", "idx", "raw_text").distinct()
    whole = c.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "raw_text"))), lambda x: x["raw_text"]), "\n* * *\n").alias("text"))
    return ch.segments(whole, "file", "text").select(F.col("key").alias("file"), "seg_no", F.md5("text").alias("text_md5"))


def m01_packed(s, d):
    """Documents packed to pieces with their offsets."""
    return ch.parents(_documents(s, d, "doc_id", "text"), "doc_id", "text").select(F.col("key").alias("doc_id"), "parent_no", "char_start", "char_end", F.md5("text").alias("text_md5"))


def m03_emitted(s, d):
    """Parents and children that documents give, as entries of verse and meaning and as prose."""
    docs = _documents(s, d, "doc_id", "text")
    count = lambda v: ch.emitted(docs, "doc_id", "text", verse_and_meaning=v).groupBy("kind_level").agg(F.count("*").alias("n"), F.count("cite_text").alias("citable"), F.sum("token_estimate").alias("tokens")).withColumn("entries", F.lit(v))
    return count(False).unionByName(count(True))


QUERIES = {n[0].upper() + n[1:]: f for n, f in list(globals().items()) if n[0] in "abcdfghjm" and n[1:3].isdigit()}

_CHUNKS = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY built_at DESC) = 1)"
_DOCS = "(SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)"
_HEADS = rf"""fl AS (SELECT source_path, greatest(1, floor(sum(length(text)) / 1800)) AS pages FROM {_CHUNKS} WHERE kind_level = 'parent' GROUP BY source_path),
  ln AS (SELECT source_path, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM {_CHUNKS} WHERE kind_level = 'parent'),
  rh AS (SELECT source_path, line, count(*) AS n, any_value(pages) AS pages FROM ln JOIN fl USING (source_path) WHERE length(line) > 3 AND length(line) <= 80 AND NOT regexp_matches(line, '^[०-९\d\s।॥\-\.]+$') GROUP BY ALL HAVING count(*) >= greatest(8, floor(any_value(pages) * 0.2)))"""
_n = lambda x, c: f"(length({x}) - length(regexp_replace({x}, '{c}', '', 'g')))"
_GATE = lambda x: rf"(SELECT id, length({x}) AS n, round({_n(x, '�')} / greatest(1, length({x})), 6) AS broken, round({_n(x, '[˜Ï¡Ô†¬»½ѽ]')} / greatest(1, length({x})), 6) AS moji, round({_n(x, r'[\x{0900}-\x{097F}]')} / greatest(1, length({x})), 6) AS deva FROM {_CHUNKS} WHERE cite_text IS NOT NULL)"
_TELL = "(SELECT DISTINCT file, idx, raw_text FROM candidate)"

SQL = {
    "D06_running_headers": rf"""WITH t AS (SELECT trim(source, ' ') AS source, text FROM (SELECT DISTINCT doc_id, source, text FROM documents WHERE text IS NOT NULL)), p AS (SELECT source, greatest(1, floor(sum(length(text)) / 1800)) AS pages FROM t GROUP BY source),
      l AS (SELECT source, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM t) SELECT source, line, count(*) AS n, any_value(pages) AS pages FROM l JOIN p USING (source) WHERE length(line) > 3 AND length(line) <= 80 AND NOT regexp_matches(line, '^[०-९\d\s।॥\-\.]+$') GROUP BY ALL HAVING count(*) >= greatest(8, floor(any_value(pages) * 0.2))""",
    "D07_file_gate": rf"""WITH {_HEADS}, g AS (SELECT source_path, sum(length(text)) AS n, sum({_n('text', '�')}) AS b, sum({_n('text', '[˜Ï¡Ô†¬»½ѽ]')}) AS m, sum({_n('text', r'[\x{0900}-\x{097F}]')}) AS v FROM {_CHUNKS} WHERE kind_level = 'parent' GROUP BY source_path)
      SELECT *, CASE WHEN broken > 0.001 OR mojibake > 0.0005 OR leaks > 0 THEN 'fail' WHEN devanagari < 0.35 THEN 'warn' ELSE 'pass' END AS verdict FROM (SELECT source_path, round(b / greatest(1, n), 6) AS broken, round(m / greatest(1, n), 6) AS mojibake, round(v / greatest(1, n), 6) AS devanagari, coalesce(k, 0) AS leaks FROM g LEFT JOIN (SELECT source_path, count(*) AS k FROM rh GROUP BY source_path) USING (source_path))""",
    "D08_verdict": f"""SELECT CASE WHEN w.n / greatest(1, o.n) < 0.55 THEN 'KEEP' WHEN round(w.moji * w.n) <= round(o.moji * o.n) AND round(w.broken * w.n) <= round(o.broken * o.n) AND NOT (o.deva - w.deva) * 100 > 5 AND (round(o.moji * o.n) - round(w.moji * w.n)) + (round(o.broken * o.n) - round(w.broken * w.n)) > 0 THEN 'REPLACE' ELSE 'REVIEW' END AS verdict, count(*) AS n
      FROM {_GATE('text')} o JOIN {_GATE('cite_text')} w USING (id) GROUP BY ALL""",
    "C09_noise_filters": rf"""SELECT doc_id, len(list_filter(w, lambda x: length(x) <= 3)) / len(w) > 0.6 AS ocr_noise, len(list_filter(w, lambda x: regexp_matches(x, '^[0-9\x{{0966}}-\x{{096F}}]+$'))) / len(w) > 0.3 AS index_entries, h >= 3 OR h / len(w) > 0.5 AS page_header FROM (SELECT *, len(list_filter(w, lambda x: list_contains(['chapter', 'part', 'chap', 'page', 'vol', 'i', 'ii', 'iii'], x))) AS h FROM (
      SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM {_DOCS}) WHERE len(w) > 0)""",
    "G03_orphans": """WITH l AS (SELECT 'child without parent' AS what, id FROM chunks WHERE kind_level = 'child' AND (parent_id IS NULL OR parent_id NOT IN (SELECT id FROM chunks WHERE kind_level = 'parent' AND built_at >= TIMESTAMPTZ '2026-07-01 00:00:00+00')) UNION ALL SELECT 'work without chunk', work_id FROM works WHERE work_id NOT IN (SELECT work_id FROM chunks WHERE work_id IS NOT NULL)
      UNION ALL SELECT 'unknown work', work_id FROM chunks WHERE work_id NOT IN (SELECT work_id FROM works)) SELECT what, count(DISTINCT id) AS n, min(id) AS first FROM l GROUP BY what""",
    "H14_section_slices": f"""WITH c AS (SELECT work_id, chapter, text, row_number() OVER w AS n, CASE WHEN chapter = lag(chapter) OVER w THEN 0 ELSE 1 END AS t FROM {_CHUNKS} WHERE kind_level = 'parent' WINDOW w AS (PARTITION BY work_id ORDER BY chunk_index, id)), r AS (SELECT *, sum(t) OVER (PARTITION BY work_id ORDER BY n) AS slice FROM c)
      SELECT work_id, slice, any_value(chapter) AS chapter, min(n) AS first, max(n) AS last, md5(string_agg(text, chr(10) ORDER BY n)) AS text_md5 FROM r GROUP BY work_id, slice""",
    "F06_embedded_text": f"SELECT id, md5(coalesce(nullif(cite_text, ''), nullif(text, ''), '')) AS text_md5 FROM {_CHUNKS}",
    "D16_changed": """WITH e AS (SELECT id, arg_min({'t': text, 'a': title, 'b': section, 'c': chapter}, (built_at, md5(text))) AS o, arg_max({'t': text, 'a': title, 'b': section, 'c': chapter}, (built_at, md5(text))) AS n, count(DISTINCT built_at) AS k FROM chunks GROUP BY id)
      SELECT CASE WHEN k = 1 THEN 'single' WHEN o.t IS DISTINCT FROM n.t THEN 'encode' WHEN o.a IS DISTINCT FROM n.a OR o.b IS DISTINCT FROM n.b OR o.c IS DISTINCT FROM n.c THEN 'metadata' ELSE 'skip' END AS state, count(*) AS n FROM e GROUP BY ALL""",
    "B01_routed": f"SELECT kind_level, kind, count(*) AS n, sum(token_estimate) AS tokens FROM {_CHUNKS} GROUP BY ALL",
    "B03_versions": "SELECT 'early' AS version, count(*) AS n, count(DISTINCT id) AS ids FROM chunks WHERE built_at < TIMESTAMPTZ '2026-07-01 00:00:00+00' UNION ALL SELECT 'all', count(*), count(DISTINCT id) FROM chunks",
    "B04_meta": f"SELECT kind, count(*) AS n, count(DISTINCT work_id) AS works, 'id,kind,work_id' AS columns FROM {_CHUNKS} GROUP BY kind",
    "B05_queue": "SELECT status, count(*) AS n FROM (SELECT * FROM access_log WHERE name IS NOT NULL AND path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name, path ORDER BY received_at DESC) = 1) GROUP BY status",
    "B07_lines": "SELECT work_id, title, array_to_string(languages, ',') AS languages FROM works",
    "A14_work_paths": "SELECT true AS is_work, count(*) AS n, count(DISTINCT path) AS folders FROM works UNION ALL SELECT false, 2 * count(*), 2 * count(DISTINCT path) FROM works",
    "A15_resolved_paths": f"""SELECT w.work_id, coalesce(f.source_path, path) AS file, coalesce(l, '') AS language FROM works w LEFT JOIN (SELECT work_id, source_path, split_part(source_path, '/', -2) AS l FROM {_CHUNKS} WHERE source_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY CASE WHEN split_part(source_path, '/', -2) = 'mr' THEN 0 ELSE 1 END, split_part(source_path, '/', -2), source_path) = 1) f USING (work_id)""",
    "A16_page_blocks": rf"""WITH l AS (SELECT id, len(ls) AS k, unnest(list_transform(ls, lambda x, i: {{'x': x, 'pos': i - 1}}), recursive := true) FROM (SELECT id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS ls FROM {_CHUNKS} WHERE kind_level = 'parent')),
      b AS (SELECT id, pos, CASE WHEN pos % 7 <> 3 THEN k - pos ELSE 1000000000 END AS o, trim(regexp_replace(x, '[ \t]+$', ''), ' ') AS x FROM l WHERE NOT regexp_matches(x, '^\s*[0-9\x{{0966}}-\x{{096F}}]+\s*$')) SELECT id, count(*) AS n, md5(string_agg(trim(x, ' ' || chr(10)), chr(10) ORDER BY o, pos)) AS page_md5 FROM b WHERE x <> '' GROUP BY id""",
    "A20_browser": rf"""SELECT work_id, language, texts, words, CASE WHEN length(q) > 40 THEN left(q, 39) || '…' ELSE q END AS preview FROM (SELECT work_id, language, count(*) AS texts, sum(len(regexp_extract_all(text, '[^ \n]+'))) AS words, trim(regexp_replace(arg_min(text, id), '[\s\x{{000B}}\x{{0085}}\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'), ' ') AS q FROM (SELECT work_id, coalesce(language, '') AS language, id, text FROM {_CHUNKS} WHERE kind_level = 'parent') GROUP BY ALL)""",
    "J01_union_sources": f"""SELECT ord, src, count(*) AS n, count(DISTINCT key) AS keys, sum(chars) AS chars FROM (SELECT CASE kind_level WHEN 'parent' THEN 1 ELSE 2 END AS ord, CASE kind_level WHEN 'parent' THEN 'parents' ELSE 'children' END AS src, id AS key, length(text) AS chars FROM {_CHUNKS} UNION ALL SELECT 3, 'documents', CAST(doc_id AS VARCHAR), length(text) FROM (SELECT DISTINCT doc_id, text FROM documents)
      UNION ALL SELECT 4, 'quotes', CAST(quote_id AS VARCHAR), length(body) FROM (SELECT DISTINCT quote_id, body FROM quotes) UNION ALL SELECT 5, 'tellings', v.file, length(v.text) FROM (SELECT unnest(variants) AS v FROM meta) UNION ALL SELECT 6, 'candidates', file || '#' || idx, length(raw_text) FROM {_TELL}) GROUP BY ord, src""",
    "D15_row_alignment": "SELECT count(*) AS rows, count(DISTINCT id) AS ids, count(quality_score) AS scored, count(text) AS texts, count(*) = count(DISTINCT id) AND count(DISTINCT id) = count(quality_score) AND count(quality_score) = count(text) AS aligned FROM chunks",
    "D03_library_stats": "SELECT about_member, count(*) AS stories, count(*) FILTER (len(list_filter(coalesce(variants, []), lambda v: coalesce(length(v.text), 0) > 0)) > 0) AS with_text, count(*) FILTER (coalesce(len(variants), 0) >= 2) AS several, sum(coalesce(len(variants), 0)) AS variants, sum(coalesce(len(list_filter(variants, lambda v: v.language = 'mr')), 0)) AS in_marathi, count(*) FILTER (consolidated IS NOT NULL) AS consolidated FROM meta GROUP BY about_member",
    "M05_segments": rf"""WITH p AS (SELECT file, unnest(list_transform(regexp_split_to_array(text, '\n\s*\*\s*\*\s*\*\s*\n'), lambda x, i: {{'x': trim(x, ' '), 'pos': i}}), recursive := true) FROM (SELECT file, string_agg(raw_text, chr(10) || '* * *' || chr(10) ORDER BY idx, raw_text) AS text FROM {_TELL} GROUP BY file))
      SELECT file, row_number() OVER (PARTITION BY file ORDER BY pos) AS seg_no, md5(x) AS text_md5 FROM p WHERE length(x) >= 200""",
    "H04_children": rf"""WITH t AS (SELECT doc_id, trim(text, ' ') AS t FROM {_DOCS}), m AS (SELECT doc_id, CASE WHEN length(t) > 0 AND {_n('t', r'[\x{0900}-\x{097F}]')} / length(t) > 0.3 AND regexp_matches(t, '[।॥]') THEN regexp_replace(t, '([।॥])\s*', '\1' || chr(1), 'g') ELSE regexp_replace(t, '([.!?।॥])\s+', '\1' || chr(1), 'g') END AS m FROM t),
      p AS (SELECT doc_id, unnest(list_transform(string_split(m, chr(1)), lambda x, i: {{'x': trim(x, ' '), 'pos': i}}), recursive := true) FROM m) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS child_no, md5(x) AS text_md5, md5(string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS embed_md5 FROM p WHERE x <> ''""",
    "G09_paragraph_at": rf"""WITH b AS (SELECT doc_id, pos, x, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM (SELECT doc_id, unnest(list_transform(string_split(regexp_replace(text, '(\n\s*\n)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x, i: {{'x': x, 'pos': i}}), recursive := true) FROM {_DOCS} WHERE text <> '')),
      p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, e - length(x) AS s, e FROM b WHERE pos % 2 = 1 AND trim(x, ' ') <> ''), q AS (SELECT doc_id, o AS "offset" FROM (SELECT doc_id FROM {_DOCS} WHERE text <> '') CROSS JOIN (SELECT unnest([0, 500, 5000]) AS o))
      SELECT q.doc_id, "offset", coalesce(max(n) FILTER (s <= "offset" AND "offset" < e), min(n) FILTER (s > "offset"), max(n)) AS n FROM q LEFT JOIN p USING (doc_id) GROUP BY ALL""",
}

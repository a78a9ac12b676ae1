"""Further queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pothi import hooks
from pothi.functions.lexical import mostly_devanagari
from pothi.operators import alignment as al
from pothi.operators import corpus as co
from pothi.operators import matching as ma
from pothi.operators import retrieval as re_
from pothi.plans import matching as mq
from pothi.plans import queries as qs
from pothi.plans.lineage import new_path
from pothi.sources import trees
from pothi.sources.tables import table as t


def a07_front_matter(s, d):
    """Works written as texts with a header and read back; every seventh header is broken."""
    w = t(s, d, "works", "work_id", "title", "author", "kind")
    n = F.conv(F.substring(F.md5("work_id"), 1, 4), 16, 10).cast("int")
    some = lambda c: F.coalesce(F.regexp_replace(c, "[\n:]", " "), F.lit(""))
    text = F.concat(F.when(n % 7 == 0, "--\n").otherwise("---\n"), F.lit("title: "), some("title"), F.lit("\nauthor: '"), some("author"), F.lit("'\nkind: x\nkind: "), some("kind"), F.lit("\n---\nBody of "), "work_id")
    fields, body = trees.front_matter(F.col("text"))
    return w.select("work_id", text.alias("text")).select("work_id", fields.alias("f"), body.alias("b")).select("work_id", F.col("f")["title"].alias("title"), F.col("f")["author"].alias("author"), F.col("f")["kind"].alias("kind"), F.md5("b").alias("body_md5"))


def a11_tolerant_lines(s, d):
    """Quotations as JSON lines, some cut in half, read line by line."""
    q = t(s, d, "quotes", "quote_id", "body").distinct().where("body IS NOT NULL")
    path = new_path(s, "lines")
    whole = F.to_json(F.struct("quote_id", F.md5("body").alias("h")))
    q.select(F.when(F.col("quote_id") % 9 == 0, F.left(whole, F.lit(12))).otherwise(whole).alias("value")).write.text(path)
    return trees.tolerant_lines(s, path, "h").groupBy("h").agg(F.count("*").alias("n"))


def f02_filled(s, d):
    """The first filled title of each work, else its id."""
    return t(s, d, "works", "work_id", "title_en", "title", "title_translit").select("work_id", trees.first_filled("title_en", "title_translit", "title", "work_id").alias("title"))


def k13_children(s, d):
    """Whether a chunk is split as verse or as prose, and into how many children."""
    c = qs._chunks(s, d, "text")
    parts = co.children(c, "id", "text").groupBy(F.col("key").alias("id")).agg(F.count("*").alias("children"))
    x = F.trim("text")
    return c.join(parts, "id").select("id", (mostly_devanagari(x) & x.rlike("[।॥]")).alias("verse"), "children")


def d10_hit_at_k(s, d):
    """Whether an expected work is among the first ten, whether one of its texts holds the expected passage's beginning, and how many of the ten are junk; skipped where nothing is expected."""
    best = re_.top(qs._scores(s, d), "item_id", "score", "doc_id", 10)
    docs = co.quality(qs._documents(s, d, "doc_id", "work_id", "text"))
    g = t(s, d, "gold", "item_id", "query", "expected", "expected_text_substr").where("query IS NOT NULL")
    hits = g.join(best, "item_id", "left").join(docs, "doc_id", "left")
    expected = F.coalesce(F.array_contains("expected", F.col("work_id")), F.lit(False))
    held = F.coalesce(F.col("text").contains(F.left("expected_text_substr", F.lit(60))), F.lit(False))
    per = hits.groupBy("item_id").agg(F.max(expected).alias("hit"), F.max(F.col("expected_text_substr").isNull() | held).alias("passage"), F.count_if(F.col("quality_score") < 0.5).alias("junk"), F.max(F.coalesce(F.size("expected"), F.lit(0)) > 0).alias("asked"))
    return per.select("item_id", F.when(~F.col("asked"), "SKIP").when(F.col("hit") & F.col("passage"), "PASS").otherwise("FAIL").alias("status"), "hit", "passage", "junk")


def d12_ingest_check(s, d):
    """Children, citable ones, orphans, empty citations and citations that begin a line with the word for meaning, of each work."""
    c = qs._chunks(s, d, "work_id", "kind_level", "parent_id", "cite_text")
    lost = co.orphans(c.where("kind_level = 'child'"), c.where("kind_level = 'parent'"), "parent_id", "id").groupBy("work_id").agg(F.count("*").alias("orphans"))
    child = F.col("kind_level") == "child"
    leak = F.coalesce(F.col("cite_text").rlike(r"(?m)^\s*अर्थ(?![ऀ-ॿ])"), F.lit(False))
    sums = c.groupBy("work_id").agg(F.count_if(child).alias("children"), F.count_if(child & F.col("cite_text").isNotNull()).alias("citable"), F.count_if(child & F.col("cite_text").isNull()).alias("retrieval_only"), F.count_if(F.trim("cite_text") == "").alias("empty_cites"), F.count_if(leak).alias("marker_leaks"))
    return sums.join(lost, "work_id", "left").na.fill(0, ["orphans"])


def d17_sweep_summary(s, d):
    """Least and greatest cosine of the ten best of each test question, and how many of them are biographies."""
    best = re_.top(qs._dense(s, d).groupBy("item_id", "doc_id").agg(F.max("score").alias("score")), "item_id", "score", "doc_id", 10).join(qs._about(s, d).select("doc_id", "kind"), "doc_id")
    return best.groupBy("item_id").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.round(F.avg((F.coalesce("kind", F.lit("")) == "biography").cast("double")), 6).alias("biographies"))


def m14_routed(s, d):
    """Where a telling goes: to the story it surely belongs to, to be looked at, or to a new story; one like an earlier one is looked at. The index is that of the batch's beginning."""
    ties = ma.story_ties(mq._candidates(s, d), mq._stories(s, d)).groupBy("key").agg(F.max("bucket").alias("bucket"))
    like = mq.g06_cross_match(s, d).select(F.col("key_b").alias("key")).distinct().withColumn("like", F.lit(True))
    route = F.when(F.col("bucket") == "HIGH", "merge").when((F.col("bucket") == "MEDIUM") | F.coalesce("like", F.lit(False)), "queue").otherwise("new")
    return ties.join(like, "key", "left").select("key", route.alias("route"))


def _retellings(s, d):
    m = t(s, d, "meta", "story_id", "variants").select("story_id", F.explode("variants").alias("v")).select("story_id", F.col("v.file").alias("file"), F.col("v.text").alias("text")).where("text IS NOT NULL").distinct()
    a, b = m.alias("a"), m.alias("b")
    return a.join(b, (F.col("a.story_id") == F.col("b.story_id")) & (F.col("a.file") < F.col("b.file"))).select(F.col("a.file").alias("file_a"), F.col("b.file").alias("file_b"), F.col("a.text").alias("ours"), F.col("b.text").alias("theirs"))


def m08_alignment(s, d):
    """How many words of two tellings of a story stand in matching blocks."""
    return al.aligned(_retellings(s, d), ["file_a", "file_b"], "ours", "theirs").drop("gaps")


def i07_divergences(s, d):
    """The ten largest gaps between two tellings of a story."""
    gaps = al.aligned(_retellings(s, d), ["file_a", "file_b"], "ours", "theirs").select("file_a", "file_b", F.posexplode("gaps").alias("at", "g"))
    return gaps.select("file_a", "file_b", (F.col("at") + 1).alias("place"), "g.size", F.md5("g.ours").alias("ours_md5"), F.md5("g.theirs").alias("theirs_md5"))


def i12_budgets(s, d):
    """How many passages the questions of each mode take, all sources and one work asked for."""
    given = hooks.Settings()
    modes = s.createDataFrame([(m, n, given.per_source(m, False), given.per_source(m, True)) for m, n in given.budgets.items()], "mode string, budget int, per_source int, scoped int")
    asked = t(s, d, "access_log", "mode", "question").where("question IS NOT NULL").groupBy("mode").agg(F.count("*").alias("n"))
    return asked.join(F.broadcast(modes), "mode", "left").select("mode", "n", F.coalesce("budget", F.lit(given.budgets["qa"])).alias("budget"), F.coalesce("per_source", F.lit(given.cap)).alias("per_source"), F.coalesce("scoped", F.lit(given.budgets["qa"])).alias("scoped"))


QUERIES = {n[0].upper() + n[1:]: f for n, f in list(globals().items()) if n[0] in "adfikm" and n[1:3].isdigit()}


def sql() -> dict[str, str]:
    """DuckDB SQL, from the pieces of the other modules."""
    from pothi.plans import oracles as o

    some = lambda c: f"coalesce(regexp_replace({c}, '[\\n:]', ' ', 'g'), '')"
    broken = "CAST(('0x' || substr(md5(work_id), 1, 4)) AS INT) % 7 = 0"
    return {
        "F09_quality_table": f"SELECT quality_score < 0.5 AS junk, stored IS NULL AS unscored, count(*) AS n FROM ({o.SQL['F07_quality']}) JOIN (SELECT id, quality_score AS stored FROM {o._CHUNKS}) USING (id) GROUP BY ALL",
        "B08_contents": f"""WITH m AS (SELECT work_id, coalesce(arg_min(kind, id), '') AS kind, count(*) AS c FROM {o._CHUNKS} GROUP BY work_id), l AS (SELECT kind, 0 AS a, 0 AS b, '## ' || CASE WHEN kind = '' THEN '-' ELSE kind END || ' (' || count(*) || ')' AS line FROM m GROUP BY kind
          UNION ALL SELECT kind, 1, row_number() OVER (PARTITION BY kind ORDER BY c DESC, work_id), '- ' || work_id || ': ' || c FROM m UNION ALL SELECT DISTINCT kind, 2, 0, '' FROM m) SELECT CAST(row_number() OVER (ORDER BY kind, a, b) - 1 AS INT) AS line_no, line FROM l""",
        "H10_pages_by_density": f"""WITH RECURSIVE p AS {o._READER}, a AS (SELECT *, CASE WHEN chapter = lag(chapter) OVER (PARTITION BY work_id ORDER BY n) THEN 0 ELSE 1 END AS turn FROM p),
          f AS (SELECT work_id, n, CAST(1 AS BIGINT) AS page, CASE WHEN is_heading THEN 0 ELSE len END AS size, 1 AS rows, CASE WHEN is_heading THEN 0 ELSE 1 END AS bodies FROM a WHERE n = 1
            UNION ALL SELECT a.work_id, a.n, page + cut, CASE WHEN cut = 1 THEN 0 ELSE size END + CASE WHEN is_heading THEN 0 ELSE len END, CASE WHEN cut = 1 THEN 0 ELSE rows END + 1, CASE WHEN cut = 1 THEN 0 ELSE bodies END + CASE WHEN is_heading THEN 0 ELSE 1 END
            FROM (SELECT a.*, f.page, f.size, f.rows, f.bodies, CASE WHEN a.turn = 1 OR (f.bodies >= 3 AND (f.rows >= 40 OR f.size >= 1500)) THEN 1 ELSE 0 END AS cut FROM f JOIN a ON a.work_id = f.work_id AND a.n = f.n + 1) a)
          SELECT work_id, n, CAST(page AS INT) AS page FROM f""",
        "I02_mmr": """WITH RECURSIVE cand AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, v.embedding::DOUBLE[] AS e, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id
            QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, v.vec_id) <= 100),
          st AS (SELECT DISTINCT query_id, 0 AS pick, CAST([] AS STRUCT(i BIGINT, l INTEGER, e DOUBLE[])[]) AS ps, CAST(NULL AS BIGINT) AS vec_id, CAST(NULL AS DOUBLE) AS mmr FROM cand
            UNION ALL SELECT query_id, pick, ps, vec_id, mmr FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mmr DESC, score DESC, vec_id) AS r FROM (
              SELECT s.query_id, s.pick + 1 AS pick, list_append(s.ps, {'i': c.vec_id, 'l': c.label, 'e': c.e}) AS ps, c.vec_id, c.score, 0.7 * c.score - (1 - 0.7) * coalesce(list_max(list_transform(list_filter(s.ps, lambda p: p.l = c.label), lambda p: list_dot_product(p.e, c.e))), 0) AS mmr
              FROM st s JOIN cand c ON s.query_id = c.query_id WHERE s.pick < 12 AND len(list_filter(s.ps, lambda p: p.i = c.vec_id)) = 0 AND len(list_filter(s.ps, lambda p: p.l = c.label)) < 2 AND len(list_filter(s.ps, lambda p: list_dot_product(p.e, c.e) >= 0.35)) = 0)) WHERE r = 1)
          SELECT query_id, vec_id, pick FROM st WHERE pick > 0""",
        "A07_front_matter": f"""SELECT work_id, CASE WHEN NOT b THEN trim(t, ' ') END AS title, CASE WHEN NOT b THEN a END AS author, CASE WHEN NOT b THEN trim(k, ' ') END AS kind, md5(CASE WHEN b THEN '--' || chr(10) || 'title: ' || t || chr(10) || 'author: ''' || a || '''' || chr(10) || 'kind: x' || chr(10) || 'kind: ' || k || chr(10) || '---' || chr(10) || 'Body of ' || work_id ELSE 'Body of ' || work_id END) AS body_md5
          FROM (SELECT work_id, {some('title')} AS t, {some('author')} AS a, {some('kind')} AS k, {broken} AS b FROM works)""",
        "A11_tolerant_lines": "SELECT h, count(*) AS n FROM (SELECT CASE WHEN quote_id % 9 = 0 THEN '' ELSE md5(body) END AS h FROM (SELECT DISTINCT quote_id, body FROM quotes WHERE body IS NOT NULL)) GROUP BY h",
        "F02_filled": "SELECT work_id, coalesce(nullif(trim(title_en, ' '), ''), nullif(trim(title_translit, ' '), ''), nullif(trim(title, ' '), ''), work_id) AS title FROM works",
        "K13_children": rf"""WITH t AS (SELECT id, trim(text, ' ') AS t FROM {o._CHUNKS}), v AS (SELECT id, t, length(t) > 0 AND {o._n('t', r'[\x{0900}-\x{097F}]')} / length(t) > 0.3 AND regexp_matches(t, '[।॥]') AS verse FROM t)
          SELECT id, verse, len(list_filter(string_split(CASE WHEN verse THEN regexp_replace(t, '([।॥])\s*', '\1' || chr(1), 'g') ELSE regexp_replace(t, '([.!?।॥])\s+', '\1' || chr(1), 'g') END, chr(1)), lambda x: trim(x, ' ') <> '')) AS children FROM v""",
        "D10_hit_at_k": f"""{o._B}, best AS ({o._top(10)}), qq AS ({o.SQL['F07_quality'].replace(o._CHUNKS, "(SELECT DISTINCT doc_id AS id, text FROM documents WHERE text IS NOT NULL)")}), h AS (SELECT g.item_id, coalesce(list_contains(expected, work_id), false) AS e, expected_text_substr IS NULL OR coalesce(contains(dd.text, left(expected_text_substr, 60)), false) AS p, coalesce(quality_score < 0.5, false) AS j, coalesce(len(expected), 0) > 0 AS asked
          FROM gold g LEFT JOIN best USING (item_id) LEFT JOIN (SELECT DISTINCT doc_id, work_id, text FROM documents) dd USING (doc_id) LEFT JOIN qq ON qq.id = doc_id WHERE g.query IS NOT NULL)
          SELECT item_id, CASE WHEN NOT bool_or(asked) THEN 'SKIP' WHEN bool_or(e) AND bool_or(p) THEN 'PASS' ELSE 'FAIL' END AS status, bool_or(e) AS hit, bool_or(p) AS passage, count(*) FILTER (j) AS junk FROM h GROUP BY item_id""",
        "D12_ingest_check": o.SQL["D12_ingest_check"].replace("AS empty_cites,", "AS empty_cites, count(*) FILTER (regexp_matches(cite_text, '(?m)^\\s*अर्थ($|[^\\x{0900}-\\x{097F}])')) AS marker_leaks,"),
        "D17_sweep_summary": f"WITH {o._DENSE}, {o._ABOUT}, b AS (SELECT item_id, doc_id, max(score) AS score FROM dn GROUP BY ALL), k AS ({o._top(10, 'b')}) SELECT item_id, min(score) AS low, max(score) AS high, round(avg(CASE WHEN kind = 'biography' THEN 1.0 ELSE 0.0 END), 6) AS biographies FROM k JOIN about USING (doc_id) GROUP BY item_id",
        "M14_routed": f"""WITH ties AS ({mq.SQL['G05_story_match']}), xm AS ({mq.SQL['G06_cross_match']}) SELECT key, CASE WHEN bool_or(bucket = 'HIGH') THEN 'merge' WHEN bool_or(bucket = 'MEDIUM') OR key IN (SELECT key_b FROM xm) THEN 'queue' ELSE 'new' END AS route FROM ties GROUP BY key""",
        "I12_budgets": "SELECT mode, count(*) AS n, CASE mode WHEN 'pravachan' THEN 15 WHEN 'reading' THEN 5 ELSE 12 END AS budget, 2 AS per_source, CASE mode WHEN 'pravachan' THEN 15 WHEN 'reading' THEN 5 ELSE 12 END AS scoped FROM access_log WHERE question IS NOT NULL GROUP BY mode",
    }


def m04_cleaned_volumes(s, d):
    """Scanned texts cleaned, with what was done to each."""
    from pothi.operators.volumes import clean_volumes

    p = qs._chunks(s, d, "kind_level", "text").where("kind_level = 'parent'")
    return clean_volumes(p, "id", "text").withColumnRenamed("key", "id").withColumn("text", F.md5("text"))


QUERIES["M04_cleaned_volumes"] = m04_cleaned_volumes

"""Queries of scope, stories, aliases and the ingest of tellings over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pothi.functions import text as tx
from pothi.operators import ingest as ig
from pothi.operators import matching as ma
from pothi.operators import scope as sc
from pothi.plans.lineage import cut
from pothi.sources.tables import latest
from pothi.sources.tables import table as t


EDGES = [0.0, 0.2, 0.4, 0.6, 0.82, 0.86, 0.90, 0.94, 0.98, 1.01]


def _candidates(s, d, *more):
    c = t(s, d, "candidate", "file", "idx", "about_member", "raw_text", "key_people", "locations", "fingerprint_phrases", *more).distinct()
    return c.withColumn("key", F.concat_ws("#", "file", "idx"))


def _stories(s, d):
    """Stories with the phrases of their tellings: a telling that is a candidate's text has that candidate's, and the one line is one."""
    m = t(s, d, "meta", "story_id", "about_member", "key_people", "locations", "one_line", "variants")
    told = m.select("story_id", F.explode("variants").alias("v")).select("story_id", F.col("v.text").alias("raw_text")).distinct()
    phrases = told.join(_candidates(s, d).select("raw_text", F.explode("fingerprint_phrases").alias("phrase")), "raw_text").groupBy("story_id").agg(F.collect_set("phrase").alias("told"))
    own = F.filter(F.array("one_line"), lambda p: p.isNotNull())
    return m.drop("variants").join(phrases, "story_id", "left").withColumn("fingerprint_phrases", F.array_union(own, F.coalesce("told", F.array().cast("array<string>"))))


def g05_story_match(s, d):
    """Ties for being of one member are one row; see the operator."""
    return ma.story_ties(_candidates(s, d), _stories(s, d))


def g06_cross_match(s, d):
    """Candidates of one member that share a phrase, and those alike by their one line."""
    return ma.cross_match(_candidates(s, d, "one_line"), "key", "about_member", "fingerprint_phrases", "one_line")


def k01_title_keys(s, d):
    works = t(s, d, "works", "work_id", "title", "title_en", "title_translit")
    return works.select("work_id", *[sc.title_key(F.coalesce(F.col(c), F.lit(""))).alias(f"of_{c}") for c in ("title", "title_en", "title_translit")])


def _questions(s, d):
    """Questions that name works: by an English title in quotation marks, by one without, by the beginning of one."""
    named = t(s, d, "works", "work_id", "title_en", "title").where("title_en IS NOT NULL")
    ask = lambda kind, q: named.select(F.concat(F.lit(kind), "work_id").alias("qid"), q.alias("question"))
    quoted = ask("q:", F.concat(F.lit("What does “"), "title_en", F.lit("” teach?")))
    plain = ask("p:", F.concat(F.lit("Where does "), F.lower("title_en"), F.lit(" speak of rivers?")))
    part = ask("h:", F.concat(F.lit('Is "'), F.substring("title_en", 1, 9), F.lit('" a letter?')))
    asked = t(s, d, "access_log", "question").where("question IS NOT NULL").distinct().select(F.concat(F.lit("l:"), F.md5("question")).alias("qid"), "question")
    return quoted.unionByName(plain).unionByName(part).unionByName(asked)


def g07_quoted_titles(s, d):
    return sc.quoted_matches(_questions(s, d), "qid", "question", sc.titles(t(s, d, "works"), "work_id", ["title", "title_en", "title_translit"]))


def g08_mentioned_work(s, d):
    return sc.mentioned_work(_questions(s, d), "qid", "question", sc.titles(t(s, d, "works"), "work_id", ["title", "title_en", "title_translit"]))


def k19_people(s, d):
    """People and places named in the text of each candidate, by dictionaries of the names the stories have."""
    names = lambda c, kind: t(s, d, "meta", c).select(F.explode(c).alias("id")).distinct().select(F.lit(kind).alias("kind"), "id", F.col("id").alias("term"))
    return ig.tagged(_candidates(s, d), "key", "raw_text", names("key_people", "people").unionByName(names("locations", "places")))


def k20_one_lines(s, d):
    return _candidates(s, d, "one_line").select("key", F.md5(ig.one_line(F.col("raw_text"), F.col("one_line"))).alias("line_md5"))


def _incoming(s, d):
    """Tellings that belong to a story: those of its member and one line."""
    m = t(s, d, "meta", "story_id", "about_member", "one_line").where("one_line IS NOT NULL")
    return _candidates(s, d, "one_line").join(m, ["about_member", "one_line"]).select("story_id", F.col("key").alias("file"), "key_people", "locations")


def j05_merge_variants(s, d):
    m = t(s, d, "meta", "story_id", "key_people", "variants")
    have = m.select("story_id", "key_people", F.transform("variants", lambda v: v["file"]).alias("files"))
    return ig.merged(have, _incoming(s, d)).select("story_id", F.array_join("people", ",").alias("people"), F.size("files").alias("n_files"))


def j06_story_index(s, d):
    m = t(s, d, "meta", "story_id", "key_people", "locations", "variants")
    index = m.select("story_id", "key_people", "locations", F.transform("variants", lambda v: v["file"]).alias("files")).where("size(files) >= 2")
    new = ig.indexed(index, _incoming(s, d))
    return new.select("story_id", F.array_join("key_people", ",").alias("people"), F.size("files").alias("n_files"))


def j04_shared_sets(s, d):
    """People and places a candidate shares with the one before it in its file, and all that either has."""
    w = W.partitionBy("file").orderBy("idx")
    c = _candidates(s, d).withColumns({"p": F.lag("key_people").over(w), "l": F.lag("locations").over(w)}).where("p IS NOT NULL")
    return c.select("key", F.size(F.array_intersect("key_people", "p")).alias("people"), F.size(F.array_union("key_people", "p")).alias("either"), F.size(F.array_intersect("locations", "l")).alias("places"))


def k11_gram_similarity(s, d):
    """Likeness of the tellings of one story, by whole texts."""
    m = t(s, d, "meta", "story_id", "variants").select("story_id", F.explode("variants").alias("v")).select("story_id", F.col("v.file").alias("file"), F.col("v.text").alias("text")).where("text IS NOT NULL").distinct()
    # Merged, never sent whole to the driver and the tasks: texts grow with the input.
    told = m.select("story_id", "file", ma.plain(F.col("text")).alias("plain"))
    a, b = (told.select("story_id", F.col("file").alias(f"file_{x}"), F.col("plain").alias(f"plain_{x}")) for x in "ab")
    pairs = a.join(b.hint("merge"), "story_id").where("file_a < file_b")
    return ma.gram_likeness(pairs, ["file_a", "file_b"], "plain_a", "plain_b").withColumnRenamed("likeness", "similarity")


def _aliases(s, d):
    c = cut(latest(t(s, d, "chunks", "id", "kind_level", "kind", "language", "cite_text", "built_at"), ["id"], "built_at").where("kind_level = 'child' AND cite_text IS NOT NULL").drop("built_at"))
    return ma.aliases(c.where("kind <> 'canonical'"), c.where("kind = 'canonical'"), "id", "language", "cite_text", least=0.0)


def g04_citation_aliases(s, d):
    """For each citable passage of other works its likest canonical one, where any word is shared."""
    return _aliases(s, d).select("id", "alias_id", "confidence")


def d09_histogram(s, d):
    """How sure the aliases of 0.82 and more are, in half-open bins."""
    bin_ = F.coalesce(*[F.when((F.col("confidence") >= a) & (F.col("confidence") < b), a) for a, b in zip(EDGES, EDGES[1:])])
    return _aliases(s, d).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


QUERIES = {n[0].upper() + n[1:]: f for n, f in list(globals().items()) if n[0] in "gkjd" and n[1:3].isdigit()}

_CAND = "(SELECT DISTINCT file || '#' || idx AS key, file, idx, about_member, raw_text, key_people, locations, fingerprint_phrases, one_line FROM candidate)"
_CHUNKS = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY built_at DESC) = 1)"
_GRAMS = lambda x: f"(SELECT CASE WHEN q = '' THEN [] WHEN length(q) < 5 THEN [q] ELSE list_distinct(list_transform(range(1, length(q) - 3), lambda i: substr(q, i, 5))) END FROM (SELECT trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'), ' ') AS q))"
_JACC = lambda a, b: f"round(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END, 6)"


def _key(x: str) -> str:
    """Title keys of texts in Latin letters, and of others without the two marks that combine."""
    out = f"lower(translate(strip_accents({x}), '़्', ''))"
    for old, new in tx.SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    stop = "[" + ", ".join(f"'{w}'" for w in tx.TITLE_STOPWORDS) + "]"
    return rf"array_to_string(list_filter(regexp_split_to_array({out}, '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '' AND NOT list_contains({stop}, w)), '')"


_TITLES = f"""titles AS (SELECT work_id, title, {_key('title')} AS k FROM (SELECT work_id, min(title) AS title FROM (SELECT work_id, trim(unnest([title, title_en, title_translit]), ' ') AS title FROM works) WHERE length(title) >= 2 GROUP BY work_id, lower(title)))"""
_QUESTIONS = """questions AS (SELECT 'q:' || work_id AS qid, 'What does “' || title_en || '” teach?' AS question FROM works WHERE title_en IS NOT NULL UNION ALL SELECT 'p:' || work_id, 'Where does ' || lower(title_en) || ' speak of rivers?' FROM works WHERE title_en IS NOT NULL
  UNION ALL SELECT 'h:' || work_id, 'Is "' || substr(title_en, 1, 9) || '" a letter?' FROM works WHERE title_en IS NOT NULL UNION ALL SELECT 'l:' || md5(question), question FROM (SELECT DISTINCT question FROM access_log WHERE question IS NOT NULL))"""
_QUOTED = f"""spans AS (SELECT DISTINCT qid, {_key('span')} AS k FROM (SELECT qid, unnest(list_filter(list_transform(regexp_extract_all(question, '["“”„]([^"“”„]{{2,}}?)["“”„]', 1), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'), ' ')), lambda x: length(x) >= 2)) AS span FROM questions)),
  quoted AS (SELECT DISTINCT qid, work_id FROM spans s JOIN titles t ON length(s.k) >= 5 AND length(t.k) >= 5 AND (contains(s.k, t.k) OR contains(t.k, s.k)))"""
_STORIES = f"""stories AS (SELECT m.story_id, m.about_member, m.key_people, m.locations, list_distinct(list_concat(CASE WHEN m.one_line IS NULL THEN [] ELSE [m.one_line] END, coalesce(p.told, []))) AS phrases FROM meta m LEFT JOIN (
  SELECT story_id, list(DISTINCT phrase) AS told FROM (SELECT story_id, v.text AS raw_text FROM (SELECT story_id, unnest(variants) AS v FROM meta)) JOIN (SELECT raw_text, unnest(fingerprint_phrases) AS phrase FROM {_CAND}) USING (raw_text) GROUP BY story_id) p USING (story_id))"""
_PAIRS = f"""{_STORIES}, raw AS (SELECT c.key, story_id, coalesce(c.about_member = s.about_member, false) AS about, len(list_intersect(coalesce(c.key_people, []), coalesce(s.key_people, []))) AS people, len(list_intersect(coalesce(c.locations, []), coalesce(s.locations, []))) AS places,
    len(list_filter(s.phrases, lambda p: p <> '' AND contains(c.raw_text, p))) AS hits, c.about_member FROM {_CAND} c CROSS JOIN stories s),
  sc AS (SELECT *, CASE WHEN about THEN 2 ELSE 0 END + CASE WHEN people >= 2 THEN 1 ELSE 0 END + CASE WHEN places >= 1 THEN 1 ELSE 0 END + CASE WHEN hits >= 2 THEN 1 ELSE 0 END AS score FROM raw),
  tops AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY people DESC, story_id) AS r, first_value(hits) OVER (PARTITION BY key ORDER BY people DESC, story_id) AS best_hits FROM (SELECT * FROM sc QUALIFY score = max(score) OVER (PARTITION BY key)))"""
_WORDS = lambda c: f"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[\\x{{0900}}-\\x{{097F}}A-Za-z0-9]+'))"
_INCOMING = f"(SELECT m.story_id, c.key AS file, c.key_people, c.locations FROM {_CAND} c JOIN meta m ON c.about_member = m.about_member AND c.one_line = m.one_line)"


def _alias_sql(tail: str) -> str:
    from pothi.plans.oracles import _bm25

    base = f"(SELECT coalesce(language, '') || '|' || id AS {{0}}, coalesce(language, '') AS lang, cite_text FROM {_CHUNKS} WHERE kind_level = 'child' AND cite_text IS NOT NULL AND length(cite_text) >= 40 AND kind {{1}} 'canonical')"
    c, o = base.format("c", "<>"), base.format("o", "=")
    return f"""WITH cc AS {c}, oo AS {o}, {_bm25('oo', 'o', 'cite_text', 'cc', 'c', 'cite_text')},
      b AS (SELECT c, o FROM scored JOIN (SELECT c, lang AS l1 FROM cc) USING (c) JOIN (SELECT o, lang AS l2 FROM oo) USING (o) WHERE l1 = l2 AND score > 0 QUALIFY row_number() OVER (PARTITION BY c ORDER BY score DESC, o) <= 8),
      gc AS (SELECT c, {_GRAMS('cite_text')} AS g FROM cc), go AS (SELECT o, {_GRAMS('cite_text')} AS g FROM oo),
      j AS (SELECT c, o, {_JACC('gc.g', 'go.g')} AS confidence FROM b JOIN gc USING (c) JOIN go USING (o)),
      al AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY c ORDER BY confidence DESC, o) = 1) {tail}"""


BINS = "SELECT CASE " + " ".join(f"WHEN confidence >= {a} AND confidence < {b} THEN {a}" for a, b in zip(EDGES, EDGES[1:])) + " END AS bin, count(*) AS n FROM al GROUP BY ALL"
SQL = {
    "G05_story_match": f"""WITH {_PAIRS}, rowed AS (SELECT key, CASE WHEN score >= 4 AND best_hits >= 1 THEN 'HIGH' WHEN score >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS bucket, score, CASE WHEN score < 2 OR (score = 2 AND about) THEN NULL ELSE story_id END AS story_id, CASE WHEN score = 2 AND about THEN about_member END AS all_of, r FROM tops)
      SELECT DISTINCT key, bucket, CASE WHEN bucket = 'LOW' THEN 0 ELSE score END AS score, story_id, all_of FROM rowed WHERE bucket <> 'HIGH' OR r = 1""",
    "G06_cross_match": f"""WITH c AS (SELECT key, about_member AS g, coalesce(fingerprint_phrases, []) AS ps, {_WORDS('one_line')} AS ws FROM {_CAND}), p AS (SELECT a.key AS key_a, b.key AS key_b, len(list_intersect(a.ps, b.ps)) AS shared, len(list_intersect(a.ws, b.ws)) AS m, len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)) AS e, len(a.ws) AS n1, len(b.ws) AS n2 FROM c a JOIN c b ON a.g = b.g AND a.key < b.key)
      SELECT key_a, key_b, shared, CASE WHEN shared = 0 THEN round(m / e, 2) END AS jaccard FROM p WHERE shared > 0 OR (n1 > 0 AND n2 > 0 AND m / e >= 0.5)""",
    "K01_title_keys": "SELECT work_id, " + ", ".join(f"{_key(f'''coalesce({c}, '')''')} AS of_{c}" for c in ("title", "title_en", "title_translit")) + " FROM works",
    "G07_quoted_titles": f"WITH {_TITLES}, {_QUESTIONS}, {_QUOTED} SELECT qid, work_id FROM quoted",
    "G08_mentioned_work": f"""WITH {_TITLES}, {_QUESTIONS}, {_QUOTED}, q AS (SELECT qid, list_sort(list(DISTINCT work_id)) AS ws FROM quoted GROUP BY qid), i AS (SELECT qid, list_sort(list(DISTINCT work_id)) AS ws FROM questions JOIN titles t ON length(title) >= 8 AND t.k <> '' AND contains({_key('question')}, t.k) GROUP BY qid)
      SELECT u.qid, CASE WHEN len(coalesce(q.ws, i.ws)) = 1 THEN coalesce(q.ws, i.ws)[1] END AS work_id, CASE WHEN coalesce(q.ws, i.ws) IS NULL THEN 'none' WHEN len(coalesce(q.ws, i.ws)) > 1 THEN 'ambiguous' WHEN q.ws IS NOT NULL THEN 'quoted' ELSE 'substring' END AS method, coalesce(len(coalesce(q.ws, i.ws)), 0) AS n FROM (SELECT DISTINCT qid FROM questions) u LEFT JOIN q USING (qid) LEFT JOIN i USING (qid)""",
    "K19_people": f"""WITH names AS (SELECT DISTINCT 'people' AS kind, unnest(key_people) AS id FROM meta UNION SELECT DISTINCT 'places', unnest(locations) FROM meta) SELECT key, kind, id FROM {_CAND} JOIN names ON contains(lower(raw_text), lower(id)) WHERE id <> ''""",
    "K20_one_lines": rf"""SELECT key, md5(CASE WHEN length(coalesce(one_line, '')) BETWEEN 15 AND 200 THEN trim(one_line, ' ') WHEN len(ps) > 0 THEN left(ps[1], 240) ELSE left(CASE WHEN coalesce(one_line, '') <> '' THEN one_line ELSE raw_text END, 240) END) AS line_md5
      FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(raw_text, '\n\s*\n'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'), ' ')), lambda p: length(p) >= 30) AS ps FROM {_CAND})""",
    "J05_merge_variants": f"""WITH n AS (SELECT story_id, list(DISTINCT file) AS files, flatten(list(key_people)) AS people FROM {_INCOMING} GROUP BY story_id)
      SELECT story_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(m.key_people, []), coalesce(n.people, [])))), ',') AS people, len(list_distinct(list_concat(coalesce(list_transform(m.variants, lambda v: v.file), []), coalesce(n.files, [])))) AS n_files FROM meta m FULL JOIN n USING (story_id)""",
    "J06_story_index": f"""WITH i AS (SELECT story_id, key_people, list_transform(variants, lambda v: v.file) AS files FROM meta WHERE len(variants) >= 2), n AS (SELECT story_id, list(DISTINCT file) AS files, arg_min(key_people, file) AS people FROM {_INCOMING} GROUP BY story_id)
      SELECT story_id, array_to_string(CASE WHEN i.story_id IS NOT NULL THEN i.key_people ELSE n.people END, ',') AS people, len(list_distinct(list_concat(coalesce(i.files, []), coalesce(n.files, [])))) AS n_files FROM i FULL JOIN n USING (story_id)""",
    "J04_shared_sets": f"""SELECT key, len(list_intersect(key_people, p)) AS people, len(list_distinct(list_concat(key_people, p))) AS either, len(list_intersect(locations, l)) AS places FROM (SELECT *, lag(key_people) OVER w AS p, lag(locations) OVER w AS l FROM {_CAND} WINDOW w AS (PARTITION BY file ORDER BY idx)) WHERE p IS NOT NULL""",
    "K11_gram_similarity": f"""WITH m AS (SELECT DISTINCT story_id, v.file AS file, v.text AS text FROM (SELECT story_id, unnest(variants) AS v FROM meta) WHERE v.text IS NOT NULL), g AS (SELECT story_id, file, {_GRAMS('text')} AS g FROM m)
      SELECT a.file AS file_a, b.file AS file_b, {_JACC('a.g', 'b.g')} AS similarity FROM g a JOIN g b ON a.story_id = b.story_id AND a.file < b.file""",
}

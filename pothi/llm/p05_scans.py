r"""Noise in text from scanned pages (problem 5).

A scanned text is taken apart into lines. Digits are masked to find running
headers: of the short lines without a final mark, those are headers whose
masked form stands with a page number (on its line or the next) in the
collection. Lines between two lines of text that hold page furniture and no
double blank line are inside a paragraph if the text before has no final mark,
or has one but fills the line. Words are grouped by their skeleton, in which
letters that scanners take for each other are one; a word that the collection's
clean text doesn't know is a misreading of the known word of its skeleton; where
there are several, and where a known word has rivals, the neighbouring words
choose by how often clean text has them together. A word unknown as a whole
(names) is one if putting one letter right turns letter groups that clean words
lack into common ones. Everything but the last
is joins, aggregations and windows per record.

Defined results: a null text has no lines and no rows; an empty one has one
blank line; repeated ids count once (the latest build); extra columns are
ignored; scans are the rows whose source path is in the volume table, others
give no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from pothi.plans.lineage import cut
from pothi.sources.tables import latest

# Letters that scanners take for each other, seen letter and letter meant.
SEEN = "0c15fbubभइठपय"
MEANT = "oelsthnवमडटषथ"
SEEN_LATIN, MEANT_LATIN = "0c15fbu", "oelsthn"
SEEN_INDIC, MEANT_INDIC = "बभइठपय", "वमडटषथ"

_SKELETON = rf"replace(replace(replace(replace(replace(translate(lower({{0}}), '{SEEN_LATIN}{SEEN_INDIC}', '{MEANT_LATIN}{MEANT_INDIC}'), 'रा', 'ण'), 'श', 'ण'), 'rn', 'm'), 'vv', 'w'), 'ख', 'रव')"


def skeleton(column: str) -> str:
    """SQL of the confusable-glyph skeleton of a word."""
    return _SKELETON.format(column)


_LINES = r"""
SELECT *, lag(kind = 'blank', 1, false) OVER w AS after_blank,
  lag(kind = 'number', 1, false) OVER w OR lead(kind = 'number', 1, false) OVER w AS beside_number
FROM (
  SELECT source_path, id, at + 1 AS line_no, line, CASE
    WHEN NOT line RLIKE '\\S' THEN 'blank'
    WHEN line RLIKE '^[\\s\\[(|॥—–-]*((पृष्ठ|पान|(?i:page|pg|p))\\.?\\s*)?([\\p{Nd}lOoISZBi]{0,3}\\p{Nd}[\\p{Nd}lOoISZBi]{0,3}|(?i:[ivxlc]{1,7})|[lOoIS]{1,3})[\\s\\])|॥—–.-]*$' AND NOT line RLIKE '^[^(]*\\)' THEN 'number'
    WHEN length(line) < 60 AND NOT line RLIKE '[.!?।॥…”’"]\\s*$' AND line RLIKE '^\\s*[\\p{Nd}lOoISZ]{1,4}\\s{2,}\\S|\\S(\\s{2,}|\\s*\\|\\s*)[\\p{Nd}lOoISZ]{1,4}\\s*$' THEN 'numbered'
    WHEN line RLIKE '^\\s*\\p{Nd}{1,3}\\.\\s+\\S' AND length(line) < 60 THEN 'section'
    WHEN length(trim(line)) <= 42 AND size(split(trim(line), '\\s+')) <= 7 AND NOT line RLIKE '[.!?।॥…”’",;—¬\\u00AD-]\\s*$' THEN 'short'
    ELSE 'text' END AS kind
  FROM scans LATERAL VIEW posexplode(split(text, '\\n')) AS at, line
) WINDOW w AS (PARTITION BY id ORDER BY line_no)
"""

_KEY = r"regexp_replace(regexp_replace(line, '^\\s*[\\p{Nd}lOoISZ]{1,4}\\s{2,}|(\\s{2,}|\\s*\\|\\s*)[\\p{Nd}lOoISZ]{1,4}\\s*$', ''), '[^\\p{L}\\p{M}0-9]', '')"

_FORMS = "SELECT form FROM (SELECT {key} AS form, kind = 'numbered' OR beside_number AS numbered FROM lines WHERE kind IN ('numbered', 'short')) GROUP BY form HAVING count_if(numbered) >= 2 OR count_if(numbered) >= 0.2 * count(*) AND count_if(numbered) >= 1"

# Lines that can't be headers have a key of their own, so that they don't all meet in one task.
_KINDS = """
SELECT l.*, CASE WHEN kind = 'numbered' OR kind = 'short' AND f.form IS NOT NULL THEN 'header' WHEN kind IN ('number', 'blank') THEN kind ELSE 'text' END AS what
FROM (SELECT *, CASE WHEN kind = 'short' THEN {key} ELSE concat_ws('|', '', id, line_no) END AS form FROM lines) AS l LEFT JOIN forms AS f ON l.form = f.form
"""

_WIDTHS = "SELECT source_path, percentile_approx(length(trim(line)), 0.98, 1000) AS width FROM kinds WHERE what = 'text' GROUP BY source_path"

# One row per line of text, with what stands between it and the next.
_TEXT = r"""
SELECT *, lead(line_no) OVER w AS next_no, lead(line) OVER w AS next_line, lag(blanks_after, 1, 1) OVER w > 0 AS opens
FROM (
  SELECT source_path, id, tno, max(CASE WHEN what = 'text' THEN line_no END) AS line_no, max(CASE WHEN what = 'text' THEN trim(line) END) AS line, max(CASE WHEN what = 'text' THEN kind END) AS kind,
    bool_or(what IN ('number', 'header')) AS furniture, count_if(what = 'blank') AS blanks_after, bool_or(what = 'blank' AND after_blank) AS double_blank
  FROM (SELECT *, count_if(what = 'text') OVER (PARTITION BY id ORDER BY line_no) AS tno FROM kinds)
  WHERE tno > 0 GROUP BY source_path, id, tno
) WINDOW w AS (PARTITION BY id ORDER BY tno)
"""

_JOINED = r"""
SELECT t.*, t.furniture AND next_no IS NOT NULL AND NOT double_blank AND NOT (kind IN ('section', 'short') AND opens) AND (
    NOT line RLIKE '[.!?।॥…”’"]$' OR length(line) + 1 + length(split(trim(next_line), '\\s+')[0]) > width - 2) AS rejoin,
  line RLIKE '\\p{L}\\p{M}*[\\u200d]?[-¬\\u00AD‐]$' AND next_line RLIKE '^\\s*[\\p{L}\\p{M}\\p{N}]' AND (furniture OR blanks_after = 0) AS split_word,
  regexp_extract(line, '([\\p{L}\\p{M}\\p{N}\\u200d\\u200c]+)[-¬\\u00AD‐]$', 1) AS head, regexp_extract(trim(next_line), '^([\\p{L}\\p{M}\\p{N}\\u200d\\u200c]+)', 1) AS rest
FROM texts AS t JOIN widths AS w ON t.source_path <=> w.source_path
"""

_VOCABULARY = r"SELECT word, count(*) AS n FROM clean LATERAL VIEW explode(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}\\u200d\\u200c]+(-[\\p{L}\\p{M}]+)*', 0)) AS word GROUP BY word"

# Compounds also count for their parts.
_KNOWN = r"SELECT word, sum(n) AS n FROM (SELECT part AS word, n FROM vocabulary LATERAL VIEW explode(split(word, '-')) AS part) GROUP BY word"


class Scans:
    """Lines of the scans of ``chunks`` (those with a source path of ``volumes``) and what is wrong with them."""

    def __init__(self, chunks: DataFrame, volumes: DataFrame):
        self.spark = chunks.sparkSession
        paths = volumes.select("source_path").where("source_path IS NOT NULL").distinct()
        rows = chunks.where("id IS NOT NULL AND text IS NOT NULL").select("id", "source_path", "kind_level", "text", "built_at")
        parents = latest(rows.where("kind_level = 'parent'").join(paths, "source_path", "left_semi").drop("kind_level"), ["id"], "built_at")
        self.scans = parents
        clean = rows.where("kind_level = 'child'").select("text")
        lines = self._sql(_LINES, scans=parents)
        key = skeleton(_KEY)
        forms = self._sql(_FORMS.replace("{key}", key), lines=lines)
        self.kinds = cut(self._sql(_KINDS.replace("{key}", key), lines=lines, forms=forms))
        texts = self._sql(_TEXT, kinds=self.kinds)
        joined = self._sql(_JOINED, texts=texts, widths=self._sql(_WIDTHS, kinds=self.kinds))
        self.clean = clean
        self.vocabulary = cut(self._sql(_VOCABULARY, clean=clean))
        self.known = self._sql(_KNOWN, vocabulary=self.vocabulary)
        self.text = cut(self._own_hyphens(joined))

    def _sql(self, query: str, **views: DataFrame) -> DataFrame:
        query = query.replace("{", "{{").replace("}", "}}")
        for name in views:
            query = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", query)
        return self.spark.sql(query, **views)

    def _own_hyphens(self, joined: DataFrame) -> DataFrame:
        """split_word holds only where the hyphen isn't the word's own."""
        compounds = self.vocabulary.where("word LIKE '%-%'").selectExpr("lower(word) AS compound", "n").groupBy("compound").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n_compound")
        whole = self.vocabulary.where("word NOT LIKE '%-%'").selectExpr("lower(word) AS whole", "n").groupBy("whole").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n_whole")
        # Lines without a parted word have a key of their own, so that they don't all meet in one task.
        own = "concat_ws('|', '', id, line_no)"
        keyed = joined.selectExpr("*", f"CASE WHEN split_word AND line RLIKE '[-‐]$' THEN concat(lower(head), '-', lower(rest)) ELSE {own} END AS compound_", f"CASE WHEN split_word THEN concat(lower(head), lower(rest)) ELSE {own} END AS whole_")
        marked = keyed.join(compounds, keyed["compound_"] == compounds["compound"], "left").join(whole, keyed["whole_"] == whole["whole"], "left")
        return marked.selectExpr(*joined.columns, "split_word AND coalesce(n_compound, 0) <= coalesce(n_whole, 0) AS hyphen", "split_word AND coalesce(n_compound, 0) > coalesce(n_whole, 0) AS own_hyphen")

    def tokens(self) -> DataFrame:
        """id, line_no, next_no, at, word, cut: words of the lines; a parted word is one, with the length of its first part."""
        return self._sql(_TOKENS, text=self.text)

    def misreadings(self) -> DataFrame:
        """word, meant: words of the scans that clean text doesn't know, and what they should be."""
        seen = self.tokens().select("word").distinct()
        known = cut(self.known)
        unknown = seen.join(known, "word", "left_anti").where(r"word RLIKE '\\p{L}' AND length(word) > 1")
        sk = skeleton("word")
        best = self._sql(f"SELECT sk, max_by(word, n) AS meant, max(n) AS n FROM (SELECT {sk} AS sk, word, n FROM known) GROUP BY sk", known=known)
        by_word = self._sql(f"SELECT word, u.sk, meant, n FROM (SELECT word, {sk} AS sk FROM unknown) AS u LEFT JOIN best AS b ON u.sk = b.sk", unknown=unknown, best=best)
        by_word = cut(by_word)
        found = by_word.where("meant IS NOT NULL AND lower(meant) <> lower(word)").select("word", "meant")
        grams = self._sql(_GRAMS, known=known)
        tries = self._sql(_TRIES.format(seen=SEEN_LATIN + SEEN_INDIC, meant=MEANT_LATIN + MEANT_INDIC), unmatched=by_word.where("meant IS NULL").select("word"))
        scored = self._sql(_SCORED, tries=tries, grams=grams)
        cased = "CASE WHEN upper(left(word, 1)) = left(word, 1) AND lower(left(word, 1)) <> left(word, 1) THEN concat(upper(left(meant, 1)), substring(meant, 2)) ELSE meant END AS meant"
        digits = by_word.where(r"meant IS NULL AND word RLIKE '^[A-Za-z]*[A-Za-z][015][A-Za-z015]*$' AND length(regexp_replace(word, '[^A-Za-z]', '')) >= 3").selectExpr("word", "translate(word, '015', 'ols') AS meant")
        found = found.unionByName(digits).unionByName(scored.join(digits.select("word"), "word", "left_anti"))
        return found.selectExpr("word", cased)

    def by_context(self) -> DataFrame:
        """id, line_no, word, meant: words of the scans whose skeleton clean text has several forms of, and the form their neighbours speak for.

        An unknown word takes the form its neighbours stand with most often in clean
        text, then the most frequent. A known one is a misreading where they stand
        with another form three times or more and never with it.
        """
        forms = self._sql(f"SELECT form, n, {skeleton('form')} AS sk FROM (SELECT lower(word) AS form, sum(n) AS n FROM known GROUP BY lower(word))", known=self.known)
        groups = cut(self._sql("SELECT sk, collect_list(struct(form, n)) AS forms FROM forms GROUP BY sk HAVING count(*) > 1", forms=forms))
        rivals = groups.selectExpr("explode(forms) AS f").selectExpr("f.form AS form")
        uses = self._sql(_USES, clean=self.clean, rivals=rivals)
        seen = self._sql(_AMONG.replace("{sk}", skeleton("w")), text=self.text, groups=groups)
        supported = self._sql(_SUPPORTED, seen=seen, uses=uses)
        return self._sql(_CHOSEN, supported=supported)

    def found(self) -> DataFrame:
        """id, line_no, what."""
        furniture = self.kinds.where("what IN ('number', 'header')").selectExpr("id", "line_no", "CASE what WHEN 'number' THEN 'pagenum' ELSE what END AS what")
        marks = self.text.selectExpr("id", "line_no", "explode(filter(array(CASE WHEN hyphen THEN 'hyphen' END, CASE WHEN rejoin THEN 'rejoin' END), x -> x IS NOT NULL)) AS what")
        wrong = self.tokens().join(self.misreadings(), "word").selectExpr("id", "CASE WHEN cut IS NOT NULL AND levenshtein(left(word, cut), left(meant, cut)) = 0 THEN next_no ELSE line_no END AS line_no", "'misread' AS what").distinct()
        by_context = self.by_context().selectExpr("id", "line_no", "'misread' AS what")
        return furniture.unionByName(marks).unionByName(wrong.unionByName(by_context).distinct())

    def volumes(self) -> DataFrame:
        """source_path, page_nums_stripped, paragraphs_rejoined."""
        numbers = self.kinds.groupBy("source_path").agg({"*": "count"}).select("source_path")
        pages = self._sql("SELECT source_path, count_if(what = 'number') AS page_nums_stripped FROM kinds GROUP BY source_path", kinds=self.kinds)
        joins = self._sql("SELECT source_path, count_if(rejoin) AS paragraphs_rejoined FROM text GROUP BY source_path", text=self.text)
        return numbers.join(pages, "source_path").join(joins, "source_path", "left").na.fill(0, ["paragraphs_rejoined"])

    def paragraphs(self) -> DataFrame:
        """id, par_no, text: lines joined to paragraphs, furniture gone, words mended."""
        fixes = self.misreadings()
        tokens = self.tokens().join(fixes, "word").selectExpr("id", "line_no", "word", "meant", "cut")
        single = tokens.where("cut IS NULL").select("id", "line_no", "word", "meant").unionByName(self.by_context()).distinct()
        mends = self._sql("SELECT id, line_no, collect_list(struct(word, meant)) AS mends FROM mended GROUP BY id, line_no", mended=single)
        wholes = self._sql("SELECT id AS id_, line_no AS no_, max(meant) AS whole FROM mended WHERE cut IS NOT NULL GROUP BY id, line_no", mended=tokens)
        lines = self.text.join(mends, ["id", "line_no"], "left").join(wholes, (self.text["id"] == wholes["id_"]) & (self.text["line_no"] == wholes["no_"]), "left")
        return self._sql(_PARAGRAPHS, lines=lines)


# How often clean text has a word before and after each form that has a rival.
_USES = r"""
SELECT form, side, near, count(*) AS n FROM (
  SELECT lower(w) AS form, at, words FROM (SELECT words FROM clean LATERAL VIEW explode(array(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}\\u200d\\u200c]+', 0))) AS words) LATERAL VIEW posexplode(words) AS at, w
) AS c JOIN rivals AS r USING (form) LATERAL VIEW inline(array(struct(-1 AS side, lower(get(words, at - 1)) AS near), struct(1 AS side, lower(get(words, at + 1)) AS near))) AS side, near
WHERE near IS NOT NULL GROUP BY form, side, near
"""

# Words of the scans with a skeleton of several forms, and their neighbours on the line.
_AMONG = r"""
SELECT id, line_no, at, w AS word, lower(w) AS own, forms, lower(get(words, at - 1)) AS prev, lower(get(words, at + 1)) AS next
FROM (SELECT *, {sk} AS sk FROM (SELECT id, line_no, words FROM text LATERAL VIEW explode(array(regexp_extract_all(line, '[\\p{L}\\p{M}\\p{N}\\u200d\\u200c]+', 0))) AS words) LATERAL VIEW posexplode(words) AS at, w) AS t
JOIN groups AS g USING (sk)
"""

_SUPPORTED = r"""
SELECT id, line_no, at, first(word) AS word, own, form, first(total) AS total, sum(coalesce(u.n, 0)) AS support
FROM (
  SELECT id, line_no, at, word, own, f.form AS form, f.n AS total, side, near FROM seen LATERAL VIEW explode(forms) AS f
  LATERAL VIEW inline(array(struct(-1 AS side, prev AS near), struct(1 AS side, next AS near))) AS side, near
) AS s LEFT JOIN uses AS u USING (form, side, near)
GROUP BY id, line_no, at, own, form
"""

_CHOSEN = r"""
SELECT id, line_no, word, CASE WHEN upper(left(word, 1)) = left(word, 1) AND lower(left(word, 1)) <> left(word, 1) THEN concat(upper(left(best, 1)), substring(best, 2)) ELSE best END AS meant FROM (
  SELECT id, line_no, at, first(word) AS word, own, max_by(form, struct(support, total)) AS best, max(support) AS most, max(CASE WHEN form = own THEN support END) AS mine FROM supported GROUP BY id, line_no, at, own)
WHERE best <> own AND (mine IS NULL OR mine = 0 AND most >= 3)
"""

_TOKENS = r"""
SELECT id, line_no, next_no, word, CAST(NULL AS INT) AS cut
FROM (
  SELECT id, line_no, next_no, line, split_word, lag(split_word, 1, false) OVER (PARTITION BY id ORDER BY line_no) AS goes_on FROM text
) LATERAL VIEW explode(regexp_extract_all(
    regexp_replace(CASE WHEN goes_on THEN regexp_replace(line, '^[\\p{L}\\p{M}\\p{N}\\u200d\\u200c]+', '') ELSE line END, '[\\p{L}\\p{M}\\p{N}\\u200d\\u200c]+[-¬\\u00AD‐]$', ''),
    '[\\p{L}\\p{M}\\p{N}\\u200d\\u200c]+', 0)) AS word
UNION ALL
SELECT id, line_no, next_no, concat(head, rest) AS word, length(head) AS cut FROM text WHERE hyphen
UNION ALL
SELECT id, line_no, next_no, part AS word, CAST(NULL AS INT) AS cut FROM text LATERAL VIEW explode(array(head, rest)) AS part WHERE own_hyphen
"""

# How many known words hold each group of four letters, word edges among them.
_GRAMS = r"""
SELECT gram, count(*) AS types FROM (
  SELECT DISTINCT word, gram FROM (SELECT word, concat('^', word, '$') AS w FROM known WHERE length(word) > 2)
  LATERAL VIEW explode(transform(sequence(1, greatest(1, length(w) - 3)), i -> substring(w, i, 4))) AS gram)
GROUP BY gram
"""

# Each unknown word as it is and with one letter put right, and the groups around that letter.
_TRIES = r"""
SELECT word, at, meant, gram, is_meant FROM (
  SELECT word, at, concat(left(word, at - 1), right_letter, substring(word, at + 1)) AS meant FROM (
    SELECT word, at, translate(substring(word, at, 1), '{seen}', '{meant}') AS right_letter, substring(word, at, 1) AS letter
    FROM unmatched LATERAL VIEW explode(sequence(1, length(word))) AS at)
  WHERE right_letter <> letter
) LATERAL VIEW explode(array(true, false)) AS is_meant
LATERAL VIEW explode(transform(sequence(greatest(1, at - 2), greatest(greatest(1, at - 2), least(at + 1, length(word) - 1))), i -> substring(concat('^', CASE WHEN is_meant THEN meant ELSE word END, '$'), i, 4))) AS gram
"""

_SCORED = r"""
SELECT word, max_by(meant, gain) AS meant FROM (
  SELECT word, at, meant, avg(CASE WHEN is_meant THEN ln(1 + coalesce(types, 0)) END) - avg(CASE WHEN NOT is_meant THEN ln(1 + coalesce(types, 0)) END) AS gain,
    min(CASE WHEN is_meant THEN coalesce(types, 0) END) AS least
  FROM tries AS t LEFT JOIN grams AS g ON t.gram = g.gram GROUP BY word, at, meant)
WHERE gain >= 1.5 AND least >= 1 GROUP BY word
"""

_PARAGRAPHS = r"""
SELECT id, par_no, array_join(transform(array_sort(collect_list(struct(line_no, piece))), p -> p.piece), '') AS text
FROM (
  SELECT id, line_no, sum(starts) OVER (PARTITION BY id ORDER BY line_no) AS par_no,
    concat(regexp_replace(CASE WHEN hyphen THEN regexp_replace(mended, '[\\p{L}\\p{M}\\p{N}\\u200d\\u200c]+[-¬\\u00AD‐]$', coalesce(whole, concat(head, rest))) ELSE mended END, '\\s+$', ''),
      CASE WHEN hyphen OR own_hyphen THEN '' ELSE ' ' END) AS piece
  FROM (
    SELECT *, CASE WHEN lag(furniture OR blanks_after > 0, 1, true) OVER w AND NOT lag(rejoin, 1, false) OVER w THEN 1 ELSE 0 END AS starts,
      aggregate(coalesce(mends, array()), CASE WHEN lag(hyphen, 1, false) OVER w THEN regexp_replace(line, '^[\\p{L}\\p{M}\\p{N}\\u200d\\u200c]+', '') ELSE line END, (s, m) -> replace(s, m.word, m.meant)) AS mended
    FROM lines WINDOW w AS (PARTITION BY id ORDER BY line_no)))
GROUP BY id, par_no
"""

r"""Text cut off by field limits (problem 10), in SQL.

A whole text ends where texts of its kind end. Word trigrams of all distinct
texts are counted by where their third word stands: inside a sentence, before a
mark, or as the last word of a text without a mark. A line or sentence begins
with blanks of its own in the trigram, so the first words of a line have one
too. The final trigram of a text joins those counts; its last word may be broken
off, so longer third words count as places where the text goes on. A text that
ends without a mark is cut where its final trigram almost never (less than one
place in fifty) ends other texts so, and whole by habit where it does (closing
formulas, places, dates). One that ends in an ellipsis on a word is cut where
its trigram almost never ends a sentence either.

In a script written without blanks or marks the trigram's part is taken by the
last letters, in several lengths: a text is whole if in one length, over two
other places or more, half of them or more are before a blank.

Only where the trigram is unknown or rare do patterns and single words decide: a
line without letters, in brackets, led by a dash, dated, or of one word known
elsewhere is whole; what ends in an unknown word, in the middle of a line's
habit, or at a length its source cuts at, is cut. A final mark makes a text
whole, unless it is a replacement character's, a number's that hardly ever ends
a sentence, or an abbreviation's that hardly ever ends a line.

Texts aren't exchanged to be counted once: a filter of constant size tells the
texts that may have copies, only those are. Another tells the contexts some text
ends in, so that other trigrams don't leave their task; both may let more
through, never less, and the joins behind them are exact.

Defined results: null, empty and blank texts are not cut and in no row. Repeated
ids count once (the smallest row), copies of a text share its verdict and are
counted once in the statistics. Rows without an id are left out, a null source
is a source of its own. A word of more than ``MOST_LETTERS`` letters (of a script
without blanks) counts as a whole only, not by its beginnings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from pothi.plans.lineage import cut as cut_lineage

# Signs that end sentences become \u0001, digits 0; other punctuation is dropped, blanks are one.
_ENDS = ".!?।॥。！？…"
_DIGITS = "0123456789०१२३४५६७८९೦೧೨೩೪೫೬೭೮೯๐๑๒๓๔๕๖๗๘๙"
_BLANKS = "\\t\\r 　"
_DROPPED = ",;:()[]“”‘’\"'«»「」『』、，（）—–-*/·"
_PLAIN = f"translate(lower(line), '{_ENDS}{_DIGITS}{_BLANKS}{_DROPPED}'".replace("\"'«", "\"\\'«") + ", '" + "\\u0001" * len(_ENDS) + "0" * len(_DIGITS) + "    ')"

MOST_COPIES = 1_000_000
MOST_LETTERS = 64
# A share of the places under which a trigram almost never ends a text, and the places from which on that can be told.
ALMOST_NEVER, ENOUGH = 0.02, 50
# Words of the filter of contexts (64 bits each), and the parts a frequent final trigram is joined in.
FILTER, SALT = 1 << 18, 8

_HEADS = r"""
SELECT key, source, h, n_chars, n_lines, trim(substring_index(end, '\n', -1)) AS line
FROM (SELECT key, trim(source) AS source, xxhash64(text) AS h, length(text) AS n_chars, length(text) - length(replace(text, '\n', '')) + 1 AS n_lines, rtrim(' \n\t\r 　', text) AS end
  FROM {rows} WHERE key IS NOT NULL AND text IS NOT NULL)
WHERE end <> ''
"""

_COPIED = "SELECT h AS k FROM {heads} GROUP BY h HAVING count(*) > 1"

_BITS = "SELECT k & {last} AS at, bit_or(shiftleft(1L, CAST(shiftrightunsigned(k, 58) AS INT))) AS bits FROM {{keys}} GROUP BY 1"
_FILTER = "SELECT transform(array_sort(collect_list(struct(id, coalesce(bits, 0L) AS bits))), x -> x.bits) AS bits FROM range({size}) LEFT JOIN {{words}} ON id = at"
_MIGHT = "get((SELECT bits FROM {{{view}}}), CAST({k} & {last} AS INT)) & shiftleft(1L, CAST(shiftrightunsigned({k}, 58) AS INT)) <> 0"

# One copy of each text: most at once, those that may have copies by an exchange.
_DISTINCT = "SELECT text FROM (SELECT text, xxhash64(text) AS h FROM {rows} WHERE key IS NOT NULL AND text IS NOT NULL) WHERE NOT (MIGHT)"
_ONE_OF = "SELECT min(text) AS text FROM (SELECT text, xxhash64(text) AS h FROM {rows} WHERE key IS NOT NULL AND text IS NOT NULL) WHERE MIGHT GROUP BY h"

# One row per line that isn't blank.
_LINES = r"""
SELECT trim(line) AS line, at = size(parts) - 1 AS is_last
FROM (SELECT split(rtrim(' \n\t\r 　', text), '\n') AS parts FROM {distinct}) LATERAL VIEW posexplode(parts) AS at, line
WHERE trim(line) <> ''
"""

_CONTEXT = r"""xxhash64(
    CASE WHEN at = 0 THEN led WHEN endswith(words[at - 1], '\u0001') THEN '^' WHEN at = 1 THEN led WHEN endswith(words[at - 2], '\u0001') THEN '^' ELSE words[at - 2] END,
    CASE WHEN at = 0 THEN led WHEN endswith(words[at - 1], '\u0001') THEN '^' ELSE words[at - 1] END)"""
_LED = "CASE WHEN left(line, 1) IN ('—', '–', '-') THEN '—' ELSE '|' END"

# kind 3: the words after a context that some text ends in; kind 1: the words some text ends in.
_COUNTS = r"""
SELECT kind, ctx, rtrim('\u0001', raw) AS word, count_if(at < n - 1 AND NOT mark) AS inside, count_if(mark) AS marked, count_if(mark AND at = n - 1) AS line_end,
  count_if(at = n - 1 AND NOT mark AND is_last) AS bare, count_if(at = n - 1 AND NOT mark AND NOT is_last) AS open
FROM (
  SELECT at, n, is_last, raw, endswith(raw, '\u0001') AS mark, context
  FROM (
    SELECT at, size(words) AS n, is_last, raw, CONTEXT AS context
    FROM (SELECT is_last, words, led FROM (SELECT line, is_last, LED AS led FROM {lines}) LATERAL VIEW explode(array(split(trim(PLAIN), ' +'))) AS words) LATERAL VIEW posexplode(words) AS at, raw)
) LATERAL VIEW inline(array(struct(3 AS kind, context AS ctx), struct(1 AS kind, 0L AS ctx))) AS kind, ctx
WHERE MIGHT
GROUP BY kind, ctx, rtrim('\u0001', raw)
""".replace("CONTEXT", _CONTEXT).replace("LED", _LED).replace("PLAIN", _PLAIN)

# What is asked for: a beginning of a word after a context. Longer words count where the text goes on.
_EVIDENCE = r"""
SELECT need, sum(CASE WHEN whole THEN inside ELSE 0 END) AS inside, sum(CASE WHEN whole THEN marked ELSE 0 END) AS marked, sum(CASE WHEN whole THEN line_end ELSE 0 END) AS line_end,
  sum(CASE WHEN whole THEN bare ELSE 0 END) AS bare, sum(CASE WHEN whole THEN open ELSE 0 END) AS open, sum(CASE WHEN whole THEN 0 ELSE inside + marked + bare END) AS longer, sum(CASE WHEN whole THEN 0 ELSE bare END) AS longer_bare
FROM (
  SELECT *, xxhash64(kind, ctx, left(word, k)) AS need, k = length(word) AS whole
  FROM {counts} LATERAL VIEW explode(CASE WHEN kind = 1 THEN array(length(word)) WHEN length(word) <= LETTERS THEN sequence(0, length(word)) ELSE array(0, length(word)) END) AS k)
WHERE MIGHT GROUP BY need
""".replace("LETTERS", str(MOST_LETTERS))

# Last letters in a script without blanks or marks, of several lengths; ^ is the start of a run. The end of a text counts for nothing.
_LENGTHS_OF_ENDS = "array(6, 12, 16, 20, 24, 28)"
_UNSPACED = r"""
SELECT seen.tail, count_if(seen.ends) AS ends, count(*) AS places
FROM (
  SELECT run, is_last AND at = size(runs) - 1 AND endswith(line, run) AS of_text
  FROM (SELECT line, is_last, regexp_extract_all(line, '[\\p{{L}}\\p{{M}}\\p{{N}}]+', 0) AS runs FROM {unspaced} WHERE line RLIKE '[฀-๿]') LATERAL VIEW posexplode(runs) AS at, run
  WHERE run RLIKE '[฀-๿]'
) LATERAL VIEW explode(LENGTHS) AS n LATERAL VIEW explode(concat(
  CASE WHEN NOT of_text THEN array(struct(CASE WHEN length(run) < n THEN concat('^', run) ELSE right(run, n) END AS tail, true AS ends)) ELSE array() END,
  CASE WHEN length(run) > 1 THEN transform(sequence(1, least(n - 1, length(run) - 1)), k -> struct(concat('^', left(run, k)) AS tail, false AS ends)) ELSE array() END,
  CASE WHEN length(run) > n THEN transform(sequence(1, length(run) - n), i -> struct(substring(run, i, n) AS tail, false AS ends)) ELSE array() END)) AS seen
WHERE MIGHT GROUP BY seen.tail
""".replace("LENGTHS", _LENGTHS_OF_ENDS)

# One row per distinct text.
_SINGLE = "SELECT h, coalesce(source, '') AS source, n_chars, n_lines, line FROM {heads} WHERE NOT (MIGHT)"
_SINGLE_OF = "SELECT h, row.* FROM (SELECT h, min(struct(coalesce(source, '') AS source, n_chars, n_lines, line)) AS row FROM {heads} WHERE MIGHT GROUP BY h)"

# One row per distinct text, with all that its verdict takes but counts.
_FINALS = r"""
SELECT h, source, n_chars, n_lines, size(words) AS n_words, size(norm) > 0 AND norm[0] <> '' AS worded,
  line RLIKE '�["”’…]*$' AS broken, line RLIKE '\\p{{L}}' AS lettered,
  right(line, 4) RLIKE '[.!?।॥。！？]["”’»」』)]*$' AND NOT right(line, 5) RLIKE '(\\.\\.|…)["”’»」』)]*$' AS marked,
  right(line, 5) RLIKE '(\\.\\.|…)["”’»」』)]*$' AS trailing, right(line, 2) RLIKE '\\p{{Nd}}\\.$' AS number_mark, endswith(line, '.') AS stop,
  line RLIKE '[฀-๿]$' AS unspaced, words[size(words) - 1] RLIKE '^\\p{{P}}+$' AND words[size(words) - 1] <> words[0] AND NOT right(line, 1) RLIKE '[)\\]）」』”’"]' AS mark_apart,
  line RLIKE '^[\\[(（].*[\\])）]$' AS bracketed, n_lines > 1 AND size(words) <= 4 AND line RLIKE '^[—–-]' AS dashed, n_lines > 1 AND size(words) <= 4 AND line RLIKE '[,،、] ?(\\p{{L}}+ )?\\p{{Nd}}+$' AS dated,
  right(line, 1) RLIKE '[,;:،、—–-]' AS comma,
  CASE WHEN line RLIKE '[฀-๿]$' THEN transform(LENGTHS, n -> CASE WHEN length(last_run) < n THEN concat('^', last_run) ELSE right(last_run, n) END) END AS ends,
  context, xxhash64(3, context, rtrim('\u0001', norm[size(norm) - 1])) AS trigram, xxhash64(3, context, '') AS bigram, xxhash64(1, 0L, rtrim('\u0001', norm[size(norm) - 1])) AS word
FROM (
  SELECT t.*, words, norm, regexp_extract(line, '[\\p{{L}}\\p{{M}}\\p{{N}}]+$', 0) AS last_run, CONTEXT AS context
  FROM (SELECT *, LED AS led FROM {single}) AS t
  LATERAL VIEW explode(array(split(line, '(?U)\\s+'))) AS words LATERAL VIEW explode(array(split(trim(PLAIN), ' +'))) AS norm)
""".replace("CONTEXT", _CONTEXT.replace("words", "norm").replace("at = 0", "size(norm) = 1").replace("at = 1", "size(norm) = 2").replace("at - 1", "size(norm) - 2").replace("at - 2", "size(norm) - 3")).replace("LED", _LED).replace("PLAIN", _PLAIN).replace("LENGTHS", _LENGTHS_OF_ENDS)

_ASKING = "worded AND lettered AND (NOT marked OR number_mark OR stop)"
_CONTEXTS = f"SELECT explode(array(context, word)) AS k FROM {{finals}} WHERE {_ASKING} UNION ALL SELECT xxhash64(tail) AS k FROM {{finals}} LATERAL VIEW explode(ends) AS tail"
_ASKED = f"SELECT h, role, need FROM {{finals}} LATERAL VIEW inline(array(struct('t' AS role, trigram AS need), struct('b' AS role, bigram AS need), struct('w' AS role, word AS need))) AS role, need WHERE {_ASKING}"
_NEEDS = "SELECT DISTINCT need AS k FROM {asked}"

# Final trigrams that many texts share are joined in parts.
_ANSWERS = r"""
SELECT h, max(CASE WHEN role = 't' THEN e END) AS t, max(CASE WHEN role = 'b' THEN e END) AS b, max(CASE WHEN role = 'w' THEN e END) AS w
FROM (SELECT h, role, need, pmod(h, SALT) AS salt FROM {asked}) AS a
JOIN (SELECT need, salt, struct(inside, marked, line_end, bare, open, longer, longer_bare) AS e FROM {evidence} LATERAL VIEW explode(sequence(0, SALT - 1)) AS salt) AS e ON a.need = e.need AND a.salt = e.salt
GROUP BY h
""".replace("SALT", str(SALT))

_UNSPACED_ANSWERS = r"""
SELECT f.h, max(u.ends / u.places) AS before_blank FROM (SELECT h, tail FROM {finals} LATERAL VIEW explode(ends) AS tail) AS f JOIN {unspaced} AS u ON f.tail = u.tail
WHERE u.places >= 2 GROUP BY f.h
"""

_LENGTHS = r"""
SELECT source, n_chars, same, n_texts FROM (SELECT source, n_chars, count(*) AS same FROM {finals} GROUP BY source, n_chars) JOIN (SELECT source AS s, count(*) AS n_texts FROM {finals} GROUP BY source) ON source = s
WHERE same >= 3 AND same >= 0.02 * n_texts
"""

# The own end of a text is left out of the counts of its trigram and its word.
_VERDICTS = r"""
SELECT h, CASE
  WHEN broken THEN 'broken character'
  WHEN NOT worded OR NOT lettered THEN NULL
  WHEN marked AND number_mark AND places3 >= ENOUGH AND finals3 < NEVER * places3 THEN 'number'
  WHEN marked AND stop AND NOT number_mark AND coalesce(w.marked, 0) > ENOUGH AND w.line_end - 1 < NEVER * w.marked THEN 'abbreviation'
  WHEN marked THEN NULL
  WHEN trailing AND places3 > 0 AND finals3 < NEVER * places3 THEN 'trigram'
  WHEN trailing AND (same IS NOT NULL OR mark_apart) THEN 'field limit'
  WHEN trailing AND seen1 < 1 THEN 'word'
  WHEN trailing THEN NULL
  WHEN unspaced THEN CASE WHEN before_blank < 0.5 THEN 'trigram' END
  WHEN places3 >= ENOUGH AND bare3 < NEVER * places3 THEN 'trigram'
  WHEN bare3 >= NEVER * places3 AND bare3 > 0 AND NOT comma THEN NULL
  WHEN bracketed OR dashed OR dated THEN NULL
  WHEN places3 > 0 AND (n_words > 1 OR n_lines = 1 OR seen1 < 1) THEN 'trigram'
  WHEN places3 = 0 AND coalesce(b.longer, 0) - 1 >= 3 AND b.longer_bare - 1 >= 0.5 * (b.longer - 1) AND NOT comma THEN NULL
  WHEN n_words = 1 AND n_lines > 1 AND seen1 >= 1 THEN NULL
  WHEN seen1 < 1 THEN 'word'
  ELSE 'sentence' END AS reason
FROM (
  SELECT f.*, a.b, a.w, same, before_blank, coalesce(a.t.inside + a.t.marked + a.t.bare + a.t.longer - 1, 0) AS places3, coalesce(a.t.marked + a.t.bare - 1, 0) AS finals3, coalesce(a.t.bare - 1, 0) AS bare3,
    coalesce(a.w.inside + a.w.marked + a.w.bare + a.w.open - 1, 0) AS seen1
  FROM {finals} AS f LEFT JOIN {answers} AS a ON f.h = a.h LEFT JOIN {lengths} AS l ON f.source = l.source AND f.n_chars = l.n_chars LEFT JOIN {ends} AS u ON f.h = u.h)
""".replace("ENOUGH", str(ENOUGH)).replace("NEVER", str(ALMOST_NEVER))


def truncation(df: DataFrame, key: str, text: str, source: str, most_copies: int = MOST_COPIES) -> DataFrame:
    """key, source, is_cut, reason: one row per text that is neither null nor blank.

    The filter of texts with copies is made for ``most_copies``; with more of
    them more texts than need be are exchanged.
    """
    spark = df.sparkSession
    size = 1 << max(0, (most_copies // 4).bit_length())

    def sql(query: str, might: tuple[str, str, int] | None = None, **views: DataFrame) -> DataFrame:
        if might:
            view, k, words = might
            query = query.replace("MIGHT", _MIGHT.format(view=view, k=k, last=words - 1))
        return spark.sql(query, **views)

    def filter_of(keys: DataFrame, words: int) -> DataFrame:
        return cut_lineage(sql(_FILTER.format(size=words), words=sql(_BITS.format(last=words - 1), keys=keys)))

    rows = df.selectExpr(f"`{key}` AS key", f"`{text}` AS text", f"`{source}` AS source")
    heads = cut_lineage(sql(_HEADS, rows=rows))
    copied = filter_of(sql(_COPIED, heads=heads), size)
    # Cut, here and below, so that no plan has more than one filter in it: the driver holds them with each of its stages.
    distinct = cut_lineage(sql(_DISTINCT, ("copied", "h", size), rows=rows, copied=copied).unionByName(sql(_ONE_OF, ("copied", "h", size), rows=rows, copied=copied)))
    lines = sql(_LINES, distinct=distinct)
    single = sql(_SINGLE, ("copied", "h", size), heads=heads, copied=copied).unionByName(sql(_SINGLE_OF, ("copied", "h", size), heads=heads, copied=copied))
    finals = cut_lineage(sql(_FINALS, single=single))
    contexts = filter_of(sql(_CONTEXTS, finals=finals), FILTER)
    asked = sql(_ASKED, finals=finals)
    needs = filter_of(sql(_NEEDS, asked=asked), FILTER)
    counts = cut_lineage(sql(_COUNTS, ("contexts", r"CASE WHEN kind = 1 THEN xxhash64(1, 0L, rtrim('\u0001', raw)) ELSE ctx END", FILTER), lines=lines, contexts=contexts))
    evidence = cut_lineage(sql(_EVIDENCE, ("needs", "need", FILTER), counts=counts, needs=needs))
    unspaced = cut_lineage(sql(_UNSPACED, ("contexts", "xxhash64(seen.tail)", FILTER), unspaced=sql(_LINES, distinct=distinct.where("text RLIKE '[฀-๿]'")), contexts=contexts))
    verdicts = sql(_VERDICTS, finals=finals, answers=sql(_ANSWERS, asked=asked, evidence=evidence), lengths=sql(_LENGTHS, finals=finals), ends=sql(_UNSPACED_ANSWERS, finals=finals, unspaced=unspaced))
    keys = sql("SELECT key, row.source, row.h FROM (SELECT key, min(struct(h, source)) AS row FROM {heads} GROUP BY key)", heads=heads)
    return sql("SELECT t.key, t.source, v.reason IS NOT NULL AS is_cut, v.reason FROM {keys} AS t JOIN {verdicts} AS v ON t.h = v.h", keys=keys, verdicts=verdicts)


def rates(found: DataFrame) -> DataFrame:
    """source, n_texts, n_cut, rate."""
    return found.sparkSession.sql(
        "SELECT source, count(*) AS n_texts, count_if(is_cut) AS n_cut, round(count_if(is_cut) / count(*), 6) AS rate FROM {found} GROUP BY source", found=found
    )

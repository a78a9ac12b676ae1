"""Scalar text functions on JVM built-ins; nulls stay null unless said otherwise."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscore of all scripts, marks left out; pieces of regular expressions.
WORD, GAP = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]+"

# Cues of a question's intent.
CUES = {
    "doctrinal": [
        "teaching", "philosophy", "philosophical", "doctrine", "meaning", "concept", "principle", "what does", "explain", "quote", "passages", "verse",
        "scripture", "the literature", "views on", "view on", "thoughts on", "thought on", "nature of", "शिकवण", "तत्त्वज्ञान", "अर्थ", "सिद्धांत", "तत्त्व",
        "उतारे", "उतारा", "वचन", "उपदेश", "विचार", "स्वरूप",
    ],
    "narrative": [
        "athvani", "story", "stories", "incident", "incidents", "anecdote", "anecdotes", "memory", "memories", "recollection", "recollections", "event",
        "events", "happened", "episode", "आठवण", "प्रसंग", "गोष्ट", "कथा", "घटना", "घडले", "घडला", "घडली",
    ],
    "navigational": ["which works", "which books", "what books", "list", "index", "catalogue", "catalog", "structure", "how many", "कोणते ग्रंथ", "यादी", "सूची"],
}
# Words that tell no titles apart, and spellings that are folded, in the order they are.
TITLE_STOPWORDS = "the a an of to in on as and is for at by with from into onto".split()
SPELLINGS = [("sation", "zation"), ("isation", "ization"), ("ised", "ized"), ("iser", "izer"), ("ising", "izing"), ("isable", "izable")]


def strip(text: Column) -> Column:
    """Without white space of any script at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """White space runs become one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


@cache
def foldings() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one ASCII letter and marks, and those letters."""
    out = {}
    for cp in range(0x80, 0x10000):
        ch = chr(cp)
        base = [c for c in unicodedata.normalize("NFKD", ch) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != ch and base[0].isascii() and base[0].isalpha():
            out[ch] = base[0]
    return "".join(out), "".join(out.values())


def folded(text: Column) -> Column:
    """Letters with marks as plain ASCII letters; the length stays."""
    return F.translate(text, *foldings())


def quoted_spans(text: Column) -> Column:
    """What stands between double quotation marks, two characters or more."""
    found = F.regexp_extract_all(text, F.lit('["“”„]([^"“”„]{2,}?)["“”„]'), F.lit(1))
    return F.filter(F.transform(found, squeeze), lambda s: F.length(s) >= 2)


def intent(question: Column) -> Column:
    """The intent with most cues in a question, ``unknown`` when none has any or two have as many."""
    low = F.lower(F.coalesce(question, F.lit("")))
    hits = {name: F.size(F.filter(F.array(*map(F.lit, cues)), lambda c: F.contains(low, c))) for name, cues in CUES.items()}
    best = F.greatest(*hits.values())
    several = sum((F.when(h == best, 1).otherwise(0) for h in hits.values()), F.lit(0)) > 1
    found = F.when((best == 0) | several, "unknown")
    for name, h in hits.items():
        found = found.when(h == best, name)
    return found


def has_devanagari(text: Column) -> Column:
    return F.coalesce(text.rlike("[ऀ-ॿ]"), F.lit(False))


def decomposed_key(text: Column) -> Column:
    """Key of a title whose letters have no marks: spellings folded, stopwords, blanks and signs gone."""
    low = F.lower(text)
    for old, new in SPELLINGS:
        low = F.replace(low, F.lit(old), F.lit(new))
    return F.array_join(F.filter(F.split(low, GAP), lambda w: (w != "") & ~w.isin(*TITLE_STOPWORDS)), "")


def without_leaks(text: Column) -> Column:
    """Text without mentions of numbered chunks and the punctuation they leave behind."""
    mention = r"(?i)\bchunks?\s+\d+(?:\s*(?:and|to|&|,|–|—|-)\s*\d+)?\b"
    out = F.regexp_replace(text, mention, "")
    for pattern, put in [(r"(?U)\s+", " "), (r"\s*,\s*,+", ","), (r"\(\s*,", "("), (r",\s*\)", ")"), (r"\(\s*\)", ""), (r"\s+([,.;:])", "$1")]:
        out = F.regexp_replace(out, pattern, put)
    return F.when(text.rlike(mention), F.trim(F.btrim(F.trim(out), F.lit(",;")))).otherwise(text)


def verse_and_meaning(entry: Column) -> tuple[Column, Column]:
    """A verse and its meaning: parted at a line that opens with the word for meaning, else at an English gloss in brackets; no meaning when neither is there."""
    e = strip(F.coalesce(entry, F.lit("")))
    marked = F.regexp_instr(e, F.lit(r"(?m)^\s*अर्थ(?![ऀ-ॿ])"))
    glossed = F.regexp_instr(e, F.lit(r"\([^)\n]*[A-Za-z][^)\n]*\)"))
    at = F.when(marked > 0, marked).when(glossed > 0, glossed)
    return F.when(at.isNull(), e).otherwise(strip(F.substring(e, F.lit(1), at - 1))), F.when(at.isNotNull(), strip(F.substring(e, at, F.length(e))))


def without_headings(text: Column) -> Column:
    """Text without the heading lines it begins with."""
    return F.regexp_replace(F.regexp_replace(text, r"^(\s*#{2,3}[ \t]+[^\n]*\n?)+", ""), r"^\n+", "")


def without_emphasis(text: Column) -> Column:
    """Text without marks of bold, italic and code."""
    return F.replace(F.regexp_replace(F.regexp_replace(text, r"\*\*(.+?)\*\*", "$1"), r"\*(.+?)\*", "$1"), F.lit("`"), F.lit(""))


def is_ornament(block: Column) -> Column:
    """Whether a block is blank or fewer than twenty signs and digits only."""
    s = strip(block)
    return (s == "") | ((F.length(s) < 20) & s.rlike(r"^[\s\*\-–—•॥ॐ०-९0-9.()]+$"))


def is_verse(block: Column) -> Column:
    """Whether a block has a double danda, or three parts or more at dandas of at most eighty characters on average."""
    parts = F.filter(F.transform(F.split(block, "।"), strip), lambda p: p != "")
    size = F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(p))
    return F.contains(block, F.lit("॥")) | ((F.size(parts) >= 3) & (size <= 80 * F.size(parts)))


def verse_lines(block: Column) -> Column:
    """A verse on one line parted after each double danda, numbered ones whole."""
    marked = F.regexp_replace(block, r"(॥[^॥\n]{0,10}॥|॥)", "$1\u0001")
    lines = F.filter(F.transform(F.split(marked, "\u0001"), strip), lambda p: p != "")
    return F.when(F.contains(block, F.lit("\n")) | ~F.contains(block, F.lit("॥")) | (F.size(lines) == 0), block).otherwise(F.array_join(lines, "\n"))


def whole_number(digits: Column) -> Column:
    """Number of a run of ASCII or Devanagari digits, 0 of an empty one; null with anything else in it."""
    return F.when(digits == "", F.lit(0).cast("bigint")).when(digits.rlike("^[0-9०-९]+$"), F.translate(digits, "०१२३४५६७८९", "0123456789").try_cast("bigint"))


def slug(text: Column, words: int = 8) -> Column:
    """Up to eight Latin words when there are three, else what letters and digits there are; never empty."""
    latin = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z][A-Za-z0-9]+"), F.lit(0))
    kept = F.lower(F.replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^ऀ-ॿa-zA-Z0-9 \-]", "")), F.lit(" "), F.lit("-")))
    other = F.left(F.btrim(F.regexp_replace(kept, "-+", "-"), F.lit("-")), F.lit(60))
    return F.when(F.size(latin) >= 3, F.left(F.lower(F.array_join(F.slice(latin, 1, words), "-")), F.lit(80))).when(other != "", other).otherwise("untitled-story")


def kebab(text: Column, most: int = 45) -> Column:
    """ASCII letters and digits of a text joined by hyphens; ``story`` when there are none."""
    joined = F.btrim(F.left(F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(most)), F.lit("-"))
    return F.when(joined != "", joined).otherwise("story")


def shown_name(identifier: Column) -> Column:
    """An identifier as a name: blanks for underscores, capitals at word beginnings, after hyphens too."""
    return F.array_join(F.transform(F.split(F.translate(identifier, "_", " "), "-"), F.initcap), "-")


def fingerprints(text: Column, most: int = 5) -> Column:
    """The most telling sentences of 40 to 180 characters: names, quotations and long words tell; no two begin alike."""
    sentences = F.transform(F.split(F.regexp_replace(text, "[*_>]", ""), r"(?<=[.!?।])\s+|\n+"), F.trim)
    fit = F.filter(sentences, lambda s: F.length(s).between(40, 180))
    point = lambda s, p: F.when(s.rlike(p), 1).otherwise(0)
    score = lambda s: point(s, "[A-Z][a-zA-Z]{3,}") + point(s, "[\"'“”‘’]") + point(s, "[ऀ-ॿ]{4,}") + point(s, "[A-Za-z]{4,}")
    ranked = F.array_sort(F.transform(fit, lambda s, i: F.struct((-score(s)).alias("by"), i.alias("at"), s.alias("s"))))
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("kept"))
    head = lambda x: F.left(x["s"], F.lit(30))
    new = lambda a, x: ~F.array_contains(a["seen"], head(x)) & (F.size(a["kept"]) < most)
    taken = F.aggregate(ranked, start, lambda a, x: F.when(new(a, x), F.struct(F.array_append(a["seen"], head(x)).alias("seen"), F.array_append(a["kept"], x["s"]).alias("kept"))).otherwise(a))
    return taken["kept"]


def plain_text(html: Column) -> Column:
    """Text of a piece of HTML: breaks are line ends, tags go, the common entities are undone, line ends have no blanks before them."""
    out = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", "\n"), "<[^>]+>", "")
    for entity, sign in [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]:
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return strip(F.regexp_replace(out, r"[ \t]+(?=\n|$)", ""))


def shortened(text: Column, n: int = 160) -> Column:
    """A squeezed text of at most ``n`` characters, the last an ellipsis when it was longer."""
    s = squeeze(F.coalesce(text, F.lit("")))
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n - 1)), F.lit("…"))).otherwise(s)


def replaced_if(text: Column, old: str, new: str, expected: int) -> Column:
    """Text with all ``old`` replaced, if it has exactly ``expected`` of them, else as it is."""
    without = F.replace(text, F.lit(old), F.lit(""))
    return F.when(F.length(text) - F.length(without) == expected * len(old), F.replace(text, F.lit(old), F.lit(new))).otherwise(text)


def clean_page(text: Column) -> Column:
    """A page without lines that hold only its number and blanks at line ends; words parted at line ends made whole, blank lines single."""
    out = F.regexp_replace(F.regexp_replace(text, r"[ \t]+(?=\n|$)", ""), r"(?m)^[ \t]*[0-9०-९]{1,4}[ \t]*(\n|\z)", "")
    return strip(F.regexp_replace(F.regexp_replace(out, r"([A-Za-z])-\n([A-Za-z])", "$1$2"), r"\n{3,}", "\n\n"))

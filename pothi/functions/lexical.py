"""Tokens for lexical retrieval, and scalar text features, on JVM built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words left out of the index.
STOPWORDS = """a an the and or but in on at to of for with by from as is are was were be been being have has had do does did not
that this it its he she they we you i his her their our your my what which who whom when where why how all each every both more
than so if no nor yet still such about also just there then now will would could should may might must can
आणि किंवा पण तर हे हा ही त्या त्यांचे मध्ये वर च ला ने से को""".split()
# Marathi case endings, in the order they are tried.
SUFFIXES = """ांविषयी ांमध्ये ांमधील ाविषयी ामध्ये ामधील ावरील ातील ांचे ांचा ांची ांना ांनी ाकडे ांत ाचे ाचा ाची ाने ाशी ाला ावर
ेचे ेचा ेची ेने ेशी ेला ेवर ीचे ीचा ीची ीने ीशी ीला हून तून""".split()
EDGES = ".,;:!?\"'()[]{}…"
#: White space of all scripts, spelled out so that Java and RE2 agree.
SPACE = r"[\s\x{0085}\x{00A0}\x{2007}\x{202F}\x{3000}]"
# Function words that tell prose from lists.
PROSE_WORDS_EN = "the a an of in on and to is are was were be been it that this with for as by from or at".split()
PROSE_WORDS_MR = "आणि आहे या तो हे मध्ये पण व की नाही होते त्या हा ही तें त्यांनी असे होता".split()


def words(text: Column) -> Column:
    return F.split(F.lower(text), SPACE + "+")


def _first_of() -> dict[str, int]:
    """Of each ending the length of the first listed one that it ends in: what is taken off where it is the longest that fits."""
    return {long: len(next(s for s in SUFFIXES if long.endswith(s))) for long in SUFFIXES}


def stem(token: Column) -> Column:
    """Token without the first listed ending that leaves two characters; null if none does.

    One pattern finds the longest ending that leaves two; all others that fit are
    endings of it, so that the first listed of them is known.
    """
    longest = F.regexp_extract(token, f"(?s)^.{{2,}}?({'|'.join(SUFFIXES)})$", 1)
    shorter = {long: n for long, n in _first_of().items() if n != len(long)}
    off = F.length(longest)
    for n in sorted(set(shorter.values())):
        off = F.when(longest.isin(*[x for x, m in shorter.items() if m == n]), n).otherwise(off)
    return F.when(longest != "", F.left(token, F.length(token) - off))


def trimmed(token: Column) -> Column:
    """Token without punctuation at its edges."""
    return F.btrim(token, F.lit(EDGES))


def _terms_of(t: Column, root: Column) -> Column:
    """The terms of a trimmed token and its stem: itself and its parts at hyphens, or itself and its stem."""
    plain = (F.length(t) > 1) & ~t.isin(*STOPWORDS)
    parts = F.filter(F.transform(F.split(t, "-"), lambda p: F.trim(p)), lambda p: (F.length(p) > 1) & ~p.isin(*STOPWORDS))
    inflected = root.isNotNull() & ~root.isin(*STOPWORDS)
    return F.when(t == "", F.array().cast("array<string>")).when(F.contains(t, F.lit("-")), F.concat(F.array(t), parts)).when(plain & inflected, F.array(t, root)).when(plain, F.array(t)).otherwise(F.array().cast("array<string>"))


def with_terms(df, token: str, name: str = "term"):
    """``df`` with a row for each term its trimmed tokens give: itself and its parts at hyphens, or itself and its stem."""
    t, root = F.col(token), F.col("_root")
    rooted = df.withColumn("_root", F.when(t.rlike("[ऀ-ॿ]"), stem(t)))
    return rooted.withColumn("_terms", _terms_of(t, root)).select(*[c for c in df.columns if c != token], F.explode("_terms").alias(name))


def term_list(text: Column) -> Column:
    """All terms of a text, as often as it has them, in one array."""
    told = F.transform(words(text), lambda w: F.struct(trimmed(w).alias("t")))
    rooted = F.transform(told, lambda x: F.struct(x["t"].alias("t"), F.when(x["t"].rlike("[ऀ-ॿ]"), stem(x["t"])).alias("root")))
    return F.flatten(F.transform(rooted, lambda x: _terms_of(x["t"], x["root"])))


def count_class(text: Column, java_class: str) -> Column:
    """Number of characters of a class."""
    return F.length(text) - F.length(F.regexp_replace(text, java_class, ""))


def mostly_devanagari(text: Column) -> Column:
    return F.when(F.length(text) > 0, count_class(text, "[ऀ-ॿ]") / F.length(text) > 0.3).otherwise(F.lit(False))


def token_estimate(text: Column) -> Column:
    """A third of the characters in Devanagari, else a quarter; one at least."""
    return F.greatest(F.lit(1), F.when(mostly_devanagari(text), F.floor(F.length(text) / 3)).otherwise(F.floor(F.length(text) / 4))).cast("int")


def title_key(title: Column) -> Column:
    """Letters and digits of a title, lower case, without blanks and signs."""
    return F.regexp_replace(F.lower(title), r"[^\p{L}\p{M}\p{N}]+", "")

"""Building and checking a corpus: quality, roll-ups, children, incremental builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pothi.functions.lexical import PROSE_WORDS_EN, PROSE_WORDS_MR, SPACE, count_class, mostly_devanagari


def quality(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with quality_score: 1 for prose, less for fragments, lists, digits, symbols and texts without function words."""
    s = F.trim(F.coalesce(F.col(text), F.lit("")))
    solid = F.regexp_replace(s, SPACE + "+", "")
    edge = r"[\.,;:!\?\"'\(\)\[\]{}…।॥]"
    tokens = F.transform(F.split(F.lower(s), SPACE + "+"), lambda t: F.regexp_replace(t, f"^{edge}+|{edge}+$", ""))
    stops = F.size(F.filter(tokens, lambda t: t.isin(*PROSE_WORDS_EN, *PROSE_WORDS_MR)))
    measured = df.withColumns({"_n": F.length(s), "_solid": F.length(solid), "_letters": count_class(solid, "[A-Za-z]|[ऀ-ॿ&&[^०-९]]"), "_digits": count_class(solid, "[0-9०-९]"), "_stops": stops})
    l, d = F.col("_letters") / F.col("_solid"), F.col("_digits") / F.col("_solid")
    y = 1 - l - d
    score = (
        F.when(F.col("_n") < 100, 0.15).when(F.col("_n") < 200, 0.6).otherwise(1.0)
        * F.when(l < 0.45, 0.2).when(l < 0.6, 0.6).otherwise(1.0)
        * F.when(d > 0.25, 0.2).when(d > 0.15, 0.6).otherwise(1.0)
        * F.when(y > 0.25, 0.4).otherwise(1.0)
        * F.when((F.col("_n") >= 200) & (F.col("_stops") < 2), 0.3).otherwise(1.0)
    )
    return measured.withColumn("quality_score", F.when(F.col("_solid") > 0, F.round(score, 4)).otherwise(0.0)).drop("_n", "_solid", "_letters", "_digits", "_stops")


def children(df: DataFrame, key: str, text: str, window: int = 1) -> DataFrame:
    """key, child_no, text, embed_text: verses part at dandas, prose at sentence marks; embed_text has the neighbours too."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    verse = mostly_devanagari(t) & t.rlike("[।॥]")
    marked = F.when(verse, F.regexp_replace(t, r"([।॥])\s*", "$1\u0001")).otherwise(F.regexp_replace(t, r"([.!?।॥])\s+", "$1\u0001"))
    parts = df.select(F.col(key).alias("key"), F.posexplode(F.split(marked, "\u0001")).alias("at", "part")).select("key", "at", F.trim("part").alias("text")).where("text <> ''")
    w = W.partitionBy("key").orderBy("at")
    near = F.array_join(F.collect_list("text").over(w.rowsBetween(-window, window)), " ")
    return parts.select("key", (F.row_number().over(w) - 1).alias("child_no"), "text", near.alias("embed_text"))


def manifest(chunks: DataFrame, order: str = "id") -> DataFrame:
    """One row per work: first-seen kind, author and title, its languages and number of chunks."""
    first = lambda c: F.min_by(c, order).alias(c)
    return chunks.groupBy("work_id").agg(first("kind"), first("author"), first("title"), F.array_sort(F.collect_set("language")).alias("languages"), F.count("*").alias("chunks"))


def carry_over(new: DataFrame, old: DataFrame, key: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``new`` whose ``payload`` the old build has, and those it lacks."""
    return new.join(old.select(key, payload), key), new.join(old.select(key), key, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, link: str, key: str) -> DataFrame:
    """Children whose parent doesn't exist."""
    return child.join(parent.select(F.col(key).alias(link)).distinct(), link, "left_anti")


def headings(df: DataFrame, key: str, lines: Column) -> DataFrame:
    """key, line_no, line, section, chapter: the last ``##`` heading above a line, and the last ``###`` since it."""
    at = df.select(F.col(key).alias("key"), F.posexplode(lines).alias("line_no", "line"))
    w = W.partitionBy("key").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    level = lambda marks: F.when(F.col("line").rlike(f"^{marks}[ \\t]+\\S"), F.regexp_extract("line", f"^{marks}[ \\t]+(.+?)\\s*$", 1))
    seen = at.withColumns({"_s": level("##"), "_c": level("###")})
    part = seen.withColumns({"section": F.coalesce(F.last("_s", True).over(w), F.lit("")), "_g": F.count("_s").over(w)})
    inner = W.partitionBy("key", "_g").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return part.withColumn("chapter", F.coalesce(F.last("_c", True).over(inner), F.lit(""))).drop("_s", "_c", "_g")


def gate(df: DataFrame, key: str, text: str) -> DataFrame:
    """Shares of broken, mis-coded, Devanagari and Latin characters, and a verdict."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.greatest(F.lit(1), F.length(t))
    m = df.select(F.col(key).alias("key"), F.length(t).alias("n_chars"), F.round(count_class(t, "�") / n, 6).alias("broken"), F.round(count_class(t, "[˜Ï¡Ô†¬»½ѽ]") / n, 6).alias("mojibake"), F.round(count_class(t, "[ऀ-ॿ]") / n, 6).alias("devanagari"), F.round(count_class(t, "[A-Za-z]") / n, 6).alias("latin"))
    return m.withColumn("verdict", F.when((F.col("broken") > 0.001) | (F.col("mojibake") > 0.0005), "fail").when(F.col("devanagari") < 0.35, "warn").otherwise("pass"))


def verdict(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, verdict: whether the new reading of a text should replace the old; both as by ``gate``, joined on key."""
    o, n = old.alias("o"), new.alias("n")
    count = lambda t, c: F.round(F.col(f"{t}.{c}") * F.col(f"{t}.n_chars"))
    cleaner = (count("n", "mojibake") <= count("o", "mojibake")) & (count("n", "broken") <= count("o", "broken"))
    gone = (count("o", "mojibake") - count("n", "mojibake")) + (count("o", "broken") - count("n", "broken")) > 0
    drop = (F.col("o.devanagari") - F.col("n.devanagari")) * 100 > 5
    short = F.col("n.n_chars") / F.greatest(F.lit(1), F.col("o.n_chars")) < 0.55
    return o.join(n, F.col("o.key") == F.col("n.key")).select(F.col("o.key").alias("key"), F.when(short, "KEEP").when(cleaner & ~drop & gone, "REPLACE").otherwise("REVIEW").alias("verdict"))


def running_headers(lines: DataFrame, doc: str, line: str, pages: Column | int, least: int = 8, share: float = 0.2) -> DataFrame:
    """doc, line, n: lines that recur on a share of the pages."""
    short = lines.select(doc, F.trim(line).alias("line")).where((F.length("line") > 3) & (F.length("line") <= 80) & ~F.col("line").rlike(r"^[०-९\d\s।॥\-\.]+$"))
    return short.groupBy(doc, "line").agg(F.count("*").alias("n")).where(F.col("n") >= F.greatest(F.lit(least), F.floor((F.lit(pages) if isinstance(pages, int) else pages) * share)))

"""Packing paragraphs into parents, cleaning scanned volumes, segments of letters."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TARGET, LARGEST, OVERLAP = 2000, 2800, 200
_SENTENCE = re.compile(r"(?<=[.!?।])\s+")


def _sentences(paragraph: str, target: int) -> list[str]:
    """Sentences of a long paragraph packed to ``target``; Devanagari of up to 1.6 targets stays whole."""
    deva = len(re.findall("[ऀ-ॿ]", paragraph))
    if deva > 0.3 * max(1, len(paragraph)) and len(paragraph) <= 1.6 * target:
        return [paragraph]
    out, now = [], ""
    for s in _SENTENCE.split(paragraph):
        if now and len(now) + 1 + len(s) > target:
            out.append(now)
            now = s
        else:
            now = f"{now} {s}" if now else s
    return [*out, now] if now else out


def packed(text: str, target: int = TARGET, largest: int = LARGEST, overlap: int = OVERLAP) -> list[tuple[str, int, int]]:
    """Pieces of about ``target`` characters with their offsets in the packed text.

    Paragraphs are taken in turn until the next would not fit. A piece that one
    more paragraph made full is followed by one that begins with its last
    ``overlap`` characters, from a paragraph's beginning where there is one. A
    paragraph of more than ``largest`` stands for itself, in sentences packed
    likewise; nothing overlaps around it.
    """
    out: list[tuple[str, int, int]] = []
    now: list[str] = []
    start = 0
    size = lambda: sum(map(len, now)) + 2 * max(0, len(now) - 1)

    def put(parts: list[str]) -> None:
        body = "\n\n".join(parts).strip()
        if body:
            out.append((body, start, start + len(body)))

    for p in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        if len(p) > largest:
            for part in ([now] if now else []) + [[x] for x in _sentences(p, target)]:
                long = sum(map(len, part)) + 2 * (len(part) - 1)
                put(part)
                start += long + 2
            now = []
            continue
        if now and size() + len(p) + 2 > target:
            put(now)
            start += size() + 2
            tail = out[-1][0][-overlap:] if overlap > 0 and out else ""
            at = tail.find("\n\n")
            tail = (tail[at + 2 :] if at > 0 else tail).strip()
            now = [tail] if tail else []
        now.append(p)
    if now:
        put(now)
    return out


def pack(text: str, target: int = TARGET, largest: int = LARGEST, overlap: int = OVERLAP) -> list[str]:
    """The pieces of ``packed`` without their offsets."""
    return [body for body, _, _ in packed(text, target, largest, overlap)]


def parents(df: DataFrame, key: str, text: str, target: int = TARGET) -> DataFrame:
    """key, parent_no, text, char_start, char_end: documents are independent, so nothing is exchanged. Null and blank texts have no parents."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, *p) for k, t in zip(pdf["key"], pdf["text"]) for i, p in enumerate(packed(t, target))]
            yield pd.DataFrame(rows, columns=["key", "parent_no", "text", "char_start", "char_end"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL").mapInPandas(run, f"key {kind}, parent_no int, text string, char_start int, char_end int")


def heading_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, char_start, level, title: headings of two and three marks at the beginning of a line."""
    lines = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    before = F.coalesce(F.sum(F.length("line") + 1).over(W.partitionBy("key").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pattern = r"^(#{2,3})[ \t]+(.+?)\s*$"
    return lines.withColumn("char_start", before).where(F.col("line").rlike(pattern)).select("key", "char_start", F.length(F.regexp_extract("line", pattern, 1)).alias("level"), F.regexp_extract("line", pattern, 2).alias("title"))


def headings_of(pieces: DataFrame, index: DataFrame) -> DataFrame:
    """pieces(key, no, char_end) with section and chapter: the last heading of each level that begins before a piece ends; a section ends its chapters."""
    marks = index.select("key", F.col("char_start").alias("at"), F.lit(0).alias("side"), "level", "title", F.lit(None).cast("int").alias("no"))
    ends = pieces.select("key", (F.col("char_end") - 1).alias("at"), F.lit(1).alias("side"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("title"), F.col("no").cast("int").alias("no"))
    w = W.partitionBy("key").orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0)
    both = marks.unionByName(ends).withColumns({"section": F.coalesce(F.last(F.when(F.col("level") == 2, F.col("title")), True).over(w), F.lit("")), "_s": F.count(F.when(F.col("level") == 2, 1)).over(w)})
    inner = W.partitionBy("key", "_s").orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("chapter", F.coalesce(F.last(F.when(F.col("level") == 3, F.col("title")), True).over(inner), F.lit(""))).where("side = 1").select("key", "no", "section", "chapter")


def emitted(df: DataFrame, key: str, text: str, verse_and_meaning: bool = False, target: int = TARGET) -> DataFrame:
    """key, id, parent_id, kind_level, section, chapter, text, embed_text, cite_text, token_estimate, char_start, char_end: parents of a text and their children.

    Children are sentences or verses with their neighbours to embed, and cited
    whole; of entries of verse and meaning only the verse is cited, and nothing
    where no meaning is found.
    """
    from pothi.functions.lexical import token_estimate
    from pothi.functions.text import verse_and_meaning as split_entry
    from pothi.functions.text import without_headings
    from pothi.operators.corpus import children

    pieces = parents(df, key, text, target).withColumnRenamed("parent_no", "no")
    labels = headings_of(pieces, heading_index(df, key, text))
    named = pieces.join(labels, ["key", "no"], "left").withColumn("id", F.concat_ws("--", F.col("key").cast("string"), F.lpad(F.col("no").cast("string"), 4, "0")))
    empty = F.lit(None).cast("string")
    tops = named.select("key", "id", empty.alias("parent_id"), F.lit("parent").alias("kind_level"), "section", "chapter", without_headings(F.col("text")).alias("text"), empty.alias("embed_text"), empty.alias("cite_text"), F.col("char_start"), F.col("char_end"))
    if verse_and_meaning:
        units = named.select("id", F.posexplode(F.filter(F.transform(F.split("text", r"\n\s*\n"), F.trim), lambda p: p != "")).alias("at", "entry"))
        verse, meaning = split_entry(F.col("entry"))
        kids = units.select("id", "at", without_headings(F.col("entry")).alias("t"), without_headings(F.col("entry")).alias("e"), F.when(meaning.isNotNull() & (verse != ""), without_headings(verse)).alias("c"))
    else:
        parts = children(named, "id", "text")
        kids = parts.select(F.col("key").alias("id"), F.col("child_no").alias("at"), without_headings(F.col("text")).alias("t"), without_headings(F.col("embed_text")).alias("e"), without_headings(F.col("text")).alias("c"))
    low = kids.join(named.select("id", "key", "section", "chapter"), "id").select("key", F.concat_ws("--", "id", F.lpad(F.col("at").cast("string"), 3, "0")).alias("id"), F.col("id").alias("parent_id"), F.lit("child").alias("kind_level"), "section", "chapter", F.col("t").alias("text"), F.col("e").alias("embed_text"), F.col("c").alias("cite_text"), F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end"))
    return tops.unionByName(low).withColumn("token_estimate", token_estimate(F.col("text")))


def lines_by_gap(words: DataFrame, page: str, order: str, y: str, gap: float) -> DataFrame:
    """``words`` with line_no: a new line where the height differs from the word before by more than ``gap``."""
    w = W.partitionBy(page).orderBy(order)
    turn = F.when(F.abs(F.col(y) - F.lag(y).over(w)) > gap, 1).otherwise(0)
    return words.withColumn("line_no", F.sum(turn).over(w))


def segments(df: DataFrame, key: str, text: str, least: int = 200) -> DataFrame:
    """key, seg_no, text: tellings of a letter, parted at lines of asterisks, else at numbered headings, else whole; short ones left out."""
    star, number = r"\n\s*\*\s*\*\s*\*\s*\n", r"\n(?=\s*[0-9०-९]{1,2}[.)]\s)"
    by_star, by_number = F.split(text, star), F.split(F.concat(F.lit("\n"), F.col(text)), number)
    parts = F.when(F.size(by_star) >= 2, by_star).when(F.size(by_number) >= 4, by_number).otherwise(F.array(F.col(text)))
    at = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(parts).alias("at", "t")).where(F.length(F.trim("t")) >= least)
    return at.select("key", F.row_number().over(W.partitionBy("key").orderBy("at")).alias("seg_no"), F.trim("t").alias("text"))

"""Reading views: paragraphs, verse runs, pages, anchors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pothi.functions.text import is_ornament, is_verse, squeeze, strip, verse_lines, without_emphasis
from pothi.operators.within import first_holder
from pothi.plans.lineage import cut


def paragraphs(df: DataFrame, key: str, text: str, split: str = r"\n\s*\n") -> DataFrame:
    """key, n, body, char_start, char_end: blocks of a text with their true offsets."""
    raw = df.select(F.col(key).alias("key"), F.posexplode(F.split(F.regexp_replace(F.col(text), f"({split})", "\u0001$1\u0001"), "\u0001")).alias("at", "piece"))
    w = W.partitionBy("key").orderBy("at")
    placed = raw.withColumn("end", F.sum(F.length("piece")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    body = placed.where("at % 2 = 0").select("key", F.trim("piece").alias("body"), (F.col("end") - F.length("piece")).alias("char_start"), F.col("end").alias("char_end"), "at").where("body <> ''")
    return body.withColumn("n", F.row_number().over(w)).select("key", "n", "body", "char_start", "char_end")


def verse_runs(df: DataFrame, key: str, order: str, verse: str, heading: str, length: str, short: int = 200) -> DataFrame:
    """``df`` with in_verse: verses, and short paragraphs in one run with a verse."""
    open_ = F.col(verse) | ((F.col(length) < short) & ~F.col(heading))
    w = W.partitionBy(key).orderBy(order)
    marked = df.withColumn("_open", open_).withColumn("_run", F.sum(F.when(F.col("_open") & F.lag("_open", 1, True).over(w), 0).otherwise(1)).over(w))
    has = F.max(F.when(F.col("_open"), F.col(verse)).otherwise(False)).over(W.partitionBy(key, "_run", "_open"))
    return marked.withColumn("in_verse", F.col("_open") & has).drop("_open", "_run")


def pages_fixed(df: DataFrame, key: str, order: str, chapter: str, structural: str, per_page: int = 4) -> DataFrame:
    """``df`` with page: at most ``per_page`` bodies, a new page at each change of chapter."""
    w = W.partitionBy(key).orderBy(order)
    turn = F.when(F.coalesce(F.lag(chapter).over(w) == F.col(chapter), F.lit(False)), 0).otherwise(1)
    run = df.withColumn("_run", F.sum(turn).over(w))
    before = F.sum(F.when(F.col(structural), 0).otherwise(1)).over(W.partitionBy(key, "_run").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    paged = run.withColumn("_page", F.floor(F.coalesce(before, F.lit(0)) / per_page))
    return paged.withColumn("page", F.dense_rank().over(W.partitionBy(key).orderBy("_run", "_page"))).drop("_run", "_page")


def pages_by_entry(df: DataFrame, key: str, order: str, heading: str) -> DataFrame:
    """``df`` with page: a heading begins one unless the row before is a heading."""
    w = W.partitionBy(key).orderBy(order)
    turn = F.when(F.col(heading) & ~F.coalesce(F.lag(heading).over(w), F.lit(True)), 1).otherwise(0)
    return df.withColumn("page", 1 + F.sum(turn).over(w))


def pages_by_density(df: DataFrame, key: str, order: str, chapter: str, structural: str, length: str, chars: int = 1500, rows: int = 40, least: int = 3) -> DataFrame:
    """key, order, page: pages fill to ``chars`` of body or to ``rows`` rows, with ``least`` bodies; headings ride free, a change of chapter begins a page.

    A resettable sum, so a fold; but chapters don't depend on each other: each run
    of one is folded by itself and gets the pages of those before it added.
    """
    kinds = dict(df.dtypes)
    w = W.partitionBy(key).orderBy(order)
    turn = F.when(F.coalesce(F.lag(chapter).over(w) == F.col(chapter), F.lit(False)), 0).otherwise(1)
    run = df.select(key, order, structural, length, F.sum(turn).over(w).alias("_run"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        page, size, n, bodies, out = 1, 0, 0, 0, []
        for free, long in zip(pdf[structural], pdf[length]):
            if bodies >= least and (n >= rows or size >= chars):
                page, size, n, bodies = page + 1, 0, 0, 0
            out.append(page)
            n += 1
            if not free:
                size, bodies = size + int(long), bodies + 1
        return pd.DataFrame({key: pdf[key], order: pdf[order], "_run": pdf["_run"], "_page": out})

    paged = run.groupBy(key, "_run").applyInPandas(fold, f"{key} {kinds[key]}, {order} {kinds[order]}, _run long, _page int")
    before = F.coalesce(F.sum("_pages").over(W.partitionBy(key).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = paged.groupBy(key, "_run").agg(F.max("_page").alias("_pages")).select(key, "_run", before.alias("_before"))
    return paged.join(offsets, [key, "_run"]).select(key, order, (F.col("_page") + F.col("_before")).cast("int").alias("page"))


def paragraph_at(offsets: DataFrame, paras: DataFrame, key: str, offset: str) -> DataFrame:
    """Each offset with the paragraph that holds it, else the next, else the last.

    An as-of join by one union and one window: no offset meets more than one row.
    """
    starts = paras.select(key, F.col("char_start").alias("at"), F.lit(0).alias("side"), F.struct("n", "char_start", "char_end").alias("p"), F.lit(None).cast("long").alias(offset))
    asked = offsets.select(key, F.col(offset).cast("long").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(starts.schema["p"].dataType).alias("p"), F.col(offset).cast("long").alias(offset))
    both = starts.withColumn("at", F.col("at").cast("long")).unionByName(asked)
    # Both frames grow row by row; looking ahead is looking back in the reverse order.
    back = W.partitionBy(key).orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(key).orderBy(F.desc("at"), F.desc("side")).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumns({"before": F.last("p", True).over(back), "after": F.last("p", True).over(ahead)}).where("side = 1")
    inside = F.col("before").isNotNull() & (F.col(offset) < F.col("before.char_end"))
    return found.select(key, offset, F.when(inside, F.col("before.n")).otherwise(F.coalesce("after.n", "before.n")).alias("n"))


def parsed(df: DataFrame, key: str, text: str, verse: bool = False, headings: bool = False, least: int = 80) -> DataFrame:
    """key, n, body, chapter, level, is_heading, is_subheading, is_verse, char_start, char_end: a work's text as numbered paragraphs.

    Blocks are parted by blank lines; their offsets are those of the whole text,
    front matter counted. Headings of up to three marks, and blocks that are bold
    only, name the chapter of what follows; deeper ones are paragraphs of their own.
    Blocks of fewer than ``least`` characters are left out; with ``verse`` only
    ornaments are, verses get a line each and short neighbours of verses are verses.
    With ``headings`` those of up to three marks are paragraphs too. A null or
    empty text has none.
    """
    front = F.regexp_extract(text, r"(?s)^---.*?\n---\n", 0)
    raw = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.length(front).alias("skip"), F.expr(f"substring(`{text}`, length(regexp_extract(`{text}`, '(?s)^---.*?\\n---\\n', 0)) + 1)").alias("t"))
    marks = r"(\n{2,})" if not headings else r"(\n{2,}|\n(?=#{1,6}\s))"
    pieces = raw.select("key", "skip", F.posexplode(F.split(F.regexp_replace("t", marks, "\u0001$1\u0001"), "\u0001")).alias("at", "piece"))
    w = W.partitionBy("key").orderBy("at")
    placed = pieces.withColumn("end", F.col("skip") + F.sum(F.length("piece")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    block = strip(F.col("piece"))
    blocks = placed.where("at % 2 = 0").select("key", "at", block.alias("b"), (F.col("end") - F.length("piece")).alias("char_start"), F.col("end").alias("char_end")).where("b <> ''")
    level = F.length(F.regexp_extract("b", r"^(#{1,6})\s", 1))
    title = without_emphasis(strip(F.regexp_extract("b", r"^#{1,6}\s+(.*)", 1)))
    bold = F.regexp_extract("b", r"^\*\*(.+?)\*\*[.:]?$", 1)
    told = blocks.withColumns({"level": level, "title": title, "bold": bold})
    names = F.when(F.col("level").between(1, 3), F.col("title")).when((F.col("level") == 0) & (F.col("bold") != ""), strip(F.col("bold")))
    chapter = F.coalesce(F.last(names, True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(""))
    body = (F.col("level") == 0) & (F.col("bold") == "") & (~is_ornament(F.col("b")) if verse else F.length("b") >= least)
    kept = told.withColumn("chapter", chapter).where(body | (F.col("level") >= 4) | (F.col("level").between(1, 3) & F.lit(headings)))
    is_v = (F.col("level") == 0) & (is_verse(F.col("b")) if verse else F.lit(False))
    out = kept.select(
        "key", F.row_number().over(w).alias("n"), F.when(F.col("level") > 0, F.col("title")).when(is_v, verse_lines(F.col("b"))).otherwise(without_emphasis(F.col("b"))).alias("body"), "chapter", "level",
        F.col("level").between(1, 3).alias("is_heading"), (F.col("level") >= 4).alias("is_subheading"), is_v.alias("is_verse"), "char_start", "char_end",
    )
    if not verse:
        return out
    runs = verse_runs(out.withColumn("_len", F.length("body")), "key", "n", "is_verse", "is_heading", "_len")
    return runs.withColumn("is_verse", F.col("is_verse") | F.col("in_verse")).drop("in_verse", "_len")


def contents(paragraphs: DataFrame, pages: DataFrame) -> DataFrame:
    """key, level, title, n, page: headings of parsed(..., headings=True) and the page each begins on; pages(key, n, page)."""
    heads = paragraphs.where((F.col("level").between(2, 3)) | ((F.col("level") >= 4) & F.col("body").rlike(r"^[IVXL]+\.?$")))
    return heads.join(pages, ["key", "n"], "left").select("key", "level", F.regexp_replace("body", r"\.$", "").alias("title"), "n", F.coalesce("page", F.lit(1)).alias("page"))


# Where the windows of a quotation begin, and how wide they are.
STARTS, WIDTHS, SHORTEST = [0, 30, 60, 100, 150], [60, 40, 24], 12


def pages_of_quotes(quotes: DataFrame, paras: DataFrame, quote: str, key: str, body: str) -> DataFrame:
    """quote, n: the paragraph that holds a window of a quotation's text; of the windows the first that any paragraph holds, of those the first.

    quotes(quote, key, body) and paras(key, n, body). Windows are found by
    ``first_holder``, so that a quotation doesn't meet the paragraphs of its work.
    """
    norm = lambda c: squeeze(without_emphasis(c))
    order = F.array(*[F.struct(F.lit(i).alias("w"), F.lit(a).alias("a"), F.lit(n).alias("n")) for i, (a, n) in enumerate((a, n) for a in STARTS for n in WIDTHS)])
    said = quotes.select(F.col(quote).alias("_quote"), F.col(key).alias("_key"), norm(F.col(body)).alias("_text"), F.explode(order).alias("_o"))
    windows = said.select("_quote", "_key", F.col("_o.w").alias("_w"), F.substring("_text", F.col("_o.a") + 1, F.col("_o.n")).alias("_window")).where(F.length("_window") >= SHORTEST)
    asked = cut(windows)
    held = paras.select(F.col(key).alias("link"), norm(F.col("body")).alias("text"), "n")
    first = first_holder(asked.select(F.col("_key").alias("link"), F.col("_window").alias("stretch")), held)
    met = asked.join(first.select(F.col("link").alias("_key"), F.col("stretch").alias("_window"), F.col("n").alias("_n")), ["_key", "_window"])
    return met.groupBy(F.col("_quote").alias(quote)).agg(F.min_by("_n", F.struct("_w", "_n")).alias("n"))

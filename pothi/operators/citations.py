"""Quotations: splicing from their source, checking, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pothi.functions.text import GAP, WORD, folded, strip
from pothi.operators.within import first_holder


def clean_body(body: Column) -> Column:
    """Replacement characters become blanks; zero-width spaces, marks of byte order and controls go, joiners stay."""
    return F.regexp_replace(F.regexp_replace(body, "�", " "), r"[\x{200B}\x{FEFF}\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}]", "")


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _pattern(anchor: Column) -> Column:
    """Pattern of the words of an anchor, whatever stands between them; null without words."""
    words = F.regexp_extract_all(F.coalesce(anchor, F.lit("")), F.lit(WORD), F.lit(0))
    return F.when(F.size(words) > 0, F.array_join(words, GAP))


_BOUNDARY = r"[।.!?][\"'’”\)\]]?(?=\s|$)|\n\s*\n"


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns computed here and not again where they are used."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_h")).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_h.{n}").alias(n) for n in columns])


def with_splice(df: DataFrame, name: str, text: Column, start: Column, end: Column) -> DataFrame:
    """``df`` with column ``name``, the stretch of ``text`` from the words of ``start`` to those of ``end`` after them.

    Punctuation and blanks between words don't count; where the start isn't found,
    it is looked for among letters without marks, and the stretch is taken from the
    text as it stands. Without an end, or one of the same words, it is the start;
    with one that isn't found it goes on to the end of the sentence or paragraph.
    Null without a start that is found.
    """
    one = _held(df, _text=text, _plain=_pattern(start), _end=_pattern(end), _fold=_pattern(folded(start)), _fold_end=_pattern(folded(end)))
    exact = F.coalesce(F.regexp_instr("_text", F.col("_plain")), F.lit(0)) > 0
    two = _held(one, _in=F.when(exact, F.col("_text")).otherwise(folded(F.col("_text"))), _first=F.when(exact, F.col("_plain")).otherwise(F.col("_fold")), _last=F.when(exact, F.col("_end")).otherwise(F.col("_fold_end")))
    match = lambda x, p: F.length(F.call_function("regexp_extract", F.col(x), F.col(p), F.lit(0)))
    three = _held(two, _at=F.regexp_instr("_in", F.col("_first")), _found=match("_in", "_first"))
    stop = F.col("_at") + F.col("_found")
    four = _held(three, _rest=F.substring("_in", stop, F.length("_in")), _after=F.substring("_text", stop, F.length("_text")))
    five = _held(four, _reach=F.regexp_instr("_rest", F.col("_last")), _bound=F.regexp_instr("_after", F.lit(_BOUNDARY)))
    to_bound = F.when(F.col("_bound") > 0, F.col("_bound") - 1 + F.length(F.regexp_extract("_after", _BOUNDARY, 0))).otherwise(F.length("_after"))
    length = F.when(F.col("_last").isNull() | (F.col("_last") == F.col("_first")), F.col("_found")).when(F.col("_reach") > 0, F.col("_found") + F.col("_reach") - 1 + match("_rest", "_last")).otherwise(F.col("_found") + to_bound)
    found = F.when(F.col("_at") > 0, strip(F.substring("_text", F.col("_at"), length)))
    return _held(five, **{name: found}).select(*[F.col(f"`{c}`") for c in df.columns], name)


def splice(text: Column, start: Column, end: Column) -> Column:
    """As ``with_splice``, for exact text: the stretch from the first ``start`` to the first ``end`` after; to the sentence end without one."""
    at = F.when(F.coalesce(start, F.lit("")) != "", F.instr(text, start))
    rest = F.substring(text, at, F.length(text))
    beyond = F.substring(rest, F.length(start) + 1, F.length(rest))
    stop = F.instr(beyond, end)
    whole = F.regexp_extract(rest, r"(?s)^.*?[.!?।॥](?=\s|$)", 0)
    to_end = F.substring(rest, F.lit(1), F.length(start) + stop + F.length(end) - 1)
    return F.when(at > 0, F.when((F.coalesce(end, F.lit("")) != "") & (stop > 0), to_end).when(whole != "", whole).otherwise(rest))


KINDS = ("canonical", "biography", "athvani", "reference")


def spliced(quotes: DataFrame, passages: DataFrame, key: str, link: list[str]) -> DataFrame:
    """key, body, work_title, author, kind, location, work_id, clean, kept: quotations with what their passages say.

    quotes(key, link, passage, quote_start, quote_end, body, work_title, author,
    kind, location) refer to passages(link, passage, text, cite_text, title,
    author, kind, work_id, section, chapter, restricted, retrieval_only). What is
    found in the passage overrides a body that came along; the whole passage
    stands in where the start isn't found. A restricted passage gives only what
    may be cited and no author, one for retrieval only gives no body. Quotations
    without any reference keep their body, those of unknown passages too. ``kept``
    says whether a body is left, ``clean`` whether the stretch was found.
    """
    q = quotes.withColumn("_passage", F.trim(F.coalesce("passage", F.lit(""))))
    renamed = [F.col(c).alias(c if c in link else "_passage" if c == "passage" else f"p_{c}") for c in passages.columns]
    p = passages.select(*renamed, *[F.col(c).alias(f"p_{c}") for c in link], F.lit(True).alias("_known"))
    both = q.join(p, [*link, "_passage"], "left")
    some = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(None))
    has_ref = (F.col("_passage") != "") | (F.coalesce("quote_start", F.lit("")) != "") | (F.coalesce("quote_end", F.lit("")) != "")
    restricted, barred = F.coalesce("p_restricted", F.lit(False)), F.coalesce("p_retrieval_only", F.lit(False))
    source = F.coalesce(F.when(restricted, F.coalesce(some(F.col("p_cite_text")), some(F.col("p_text")))).otherwise(F.coalesce(some(F.col("p_text")), some(F.col("p_cite_text")))), F.lit(""))
    stretch = F.col("_stretch")
    own = F.coalesce("body", F.lit(""))
    known = F.coalesce(F.col("_known"), F.lit(False))
    raw = F.when(~has_ref | ~known, own).when(barred, "").when(stretch.isNotNull(), stretch).when(source != "", source).otherwise(own)
    given = has_ref & known & ~barred
    kind = F.when(given & F.col("p_kind").isin(*KINDS), F.col("p_kind")).when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("canonical")
    body = clean_body(raw)
    return with_splice(both, "_stretch", source, F.col("quote_start"), F.col("quote_end")).select(
        key, body.alias("body"),
        F.when(given, F.coalesce(some(F.col("p_title")), some(F.col("p_work_id")), some(F.col("work_title")), F.lit(""))).otherwise(F.coalesce("work_title", F.lit(""))).alias("work_title"),
        F.when(given & restricted, "").when(given, F.coalesce(some(F.col("p_author")), some(F.col("author")), F.lit(""))).otherwise(F.coalesce("author", F.lit(""))).alias("author"),
        kind.alias("kind"), F.coalesce(F.when(known, location(F.col("p_section"), F.col("p_chapter"), F.col("location"))).otherwise(F.col("location")), F.lit("")).alias("location"),
        F.when(given & (kind == "canonical"), F.coalesce("p_work_id", F.lit(""))).otherwise("").alias("work_id"),
        F.when(~has_ref, own != "").otherwise(given & stretch.isNotNull()).alias("clean"), (F.trim(body) != "").alias("kept"),
    )


def check(quotes: DataFrame, sources: DataFrame, key: str, link: str, body: str, text: str) -> DataFrame:
    """key, status: ``verbatim`` when the squeezed body stands in a source, ``changed``, ``no source`` or ``no body``.

    Bodies and sources are squeezed once. Bodies are found by ``first_holder``, so
    that one doesn't meet the sources of its work.
    """
    said = quotes.select(F.col(key).alias("_key"), F.col(link).alias("_link"), squeezed(F.coalesce(F.col(body), F.lit(""))).alias("_body")).distinct()
    held = sources.where(F.col(text).isNotNull()).select(F.col(link).alias("_link"), squeezed(F.col(text)).alias("_text"))
    found = first_holder(said.select(F.col("_link").alias("link"), F.col("_body").alias("stretch")), held.select(F.col("_link").alias("link"), F.col("_text").alias("text"), F.lit(1).alias("n")))
    verbatim = found.select(F.col("link").alias("_link"), F.col("stretch").alias("_body"), F.lit(True).alias("_found"))
    told = sources.where(F.col(text).isNotNull()).select(F.col(link).alias("_link")).distinct().withColumn("_told", F.lit(True))
    per = said.join(told, "_link", "left").join(verbatim, ["_link", "_body"], "left")
    best = per.groupBy("_key").agg(F.max(F.when(F.col("_body") == "", 0).when(F.col("_told").isNull(), 1).when(F.col("_found"), 3).otherwise(2)).alias("_s"))
    return best.select(F.col("_key").alias(key), F.element_at(F.array(F.lit("no body"), F.lit("no source"), F.lit("changed"), F.lit("verbatim")), F.col("_s") + 1).alias("status"))


def location(section: Column, chapter: Column, given: Column) -> Column:
    """Section and chapter of a citation, else what was given."""
    both = F.concat_ws(" · ", F.nullif(F.trim(section), F.lit("")), F.nullif(F.trim(chapter), F.lit("")))
    return F.when(both != "", both).otherwise(given)


def passage_label(index: Column) -> Column:
    """0, 1 ... 25, 26 become A, B ... Z, AA."""
    letter = lambda i: F.char(F.lit(65) + i)
    return F.when(index < 26, letter(index)).otherwise(F.concat(letter(F.floor(index / 26) - 1), letter(index % 26)))


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """Text with the first ``old`` replaced; null when there is none."""
    at = F.instr(text, old)
    return F.when(at > 0, F.overlay(text, new, at, F.length(old)))

"""Matching records: stories, titles, near passages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pothi.plans.lineage import cut


def plain(text: Column) -> Column:
    """A squeezed lower-case text."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def gram_likeness(pairs: DataFrame, names: list[str], a: str, b: str, n: int = 5) -> DataFrame:
    """names, likeness: the Jaccard similarity, to six places, of the runs of ``n`` characters of two plain texts of a row.

    The same as of their ``char_grams``, whose many short texts are neither kept
    nor exchanged: the runs of a pair are made where the pair is.
    """

    def grams(t: str) -> set[str]:
        return {t[i : i + n] for i in range(len(t) - n + 1)} if len(t) >= n else {t} - {""}

    def run(batches):
        last, of_last = None, set()
        for batch in batches:
            both, either = [], []
            for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist()):
                if x != last:
                    last, of_last = x, grams(x)
                other = grams(y)
                both.append(len(of_last & other))
                either.append(len(of_last) + len(other) - both[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(both, pa.int32()), pa.array(either, pa.int32())], names=[*names, "_both", "_either"])

    kinds = dict(pairs.dtypes)
    met = pairs.select(*names, a, b).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", _both int, _either int")
    return met.select(*names, F.round(F.when(F.col("_either") > 0, F.col("_both") / F.col("_either")).otherwise(0.0), 6).alias("likeness"))


def char_grams(text: Column, n: int = 5) -> Column:
    """Distinct runs of ``n`` characters of a squeezed lower-case text; the text itself when shorter."""
    t = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) < n, F.array(t)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n)))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(0.0)


def phrase_hits(candidates: DataFrame, stories: DataFrame) -> DataFrame:
    """key, story_id, hits: how many phrases of a story stand in a candidate's text, where any does.

    A phrase is looked for in the texts that have its longest inner word; one of
    one or two words in those with a word that holds its first. What is joined are
    words and phrases; a text comes along only to what its words speak for.
    """
    told = stories.select("story_id", F.explode(F.array_distinct("fingerprint_phrases")).alias("p")).where("p <> ''")
    parts = F.split("p", r"[ \n]")
    middle = F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts) - 2))
    longest = F.array_max(F.transform(middle, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    filled = F.filter(parts, lambda w: w != "")
    phrases = told.select("p").distinct().select("p", F.when(F.size(parts) >= 3, longest).alias("w"), F.coalesce(F.get(filled, F.lit(0)), F.lit("")).alias("part"))
    texts = candidates.select("key", "raw_text").where("raw_text IS NOT NULL")
    words = texts.select("key", F.explode(F.array_distinct(F.split("raw_text", r"[ \n]"))).alias("w")).distinct()
    # Short phrases meet the distinct words of all texts by a letter run, and the texts by those words.
    run = lambda c: F.left(c, F.when(F.length(c) >= 3, 3).otherwise(F.length(c)))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("w") - (n - 1))), lambda i: F.substring("w", i, F.lit(n)))
    short = phrases.where("w IS NULL").select("p", "part", run(F.col("part")).alias("g"))
    held = words.select("w").distinct().select("w", F.explode(F.array_distinct(F.concat(runs(1), runs(2), runs(3), F.array(F.lit(""))))).alias("g")).join(short, "g").where(F.col("w").contains(F.col("part"))).select("w", "p")
    keyed = phrases.where("w IS NOT NULL").select("w", "p").unionByName(held).distinct()
    likely = words.join(keyed, "w").select("key", "p").distinct()
    found = likely.join(texts, "key").where(F.col("raw_text").contains(F.col("p"))).select("key", "p").distinct()
    return found.join(told, "p").groupBy("key", "story_id").agg(F.count_distinct("p").cast("int").alias("hits"))


def story_scores(candidates: DataFrame, stories: DataFrame) -> DataFrame:
    """key, story_id, score, about, people, places, hits of candidates and stories that share a place, two people, or two phrases.

    Of pairs that share the member only, none is written: they all score 2, and
    ``story_ties`` names them by the member.
    """
    names = lambda df, key, c: df.select(key, F.explode(F.array_distinct(c)).alias("name"))
    shared = lambda c, n: names(candidates, "key", c).join(names(stories, "story_id", c), "name").groupBy("key", "story_id").agg(F.count("*").cast("int").alias(n))
    both = shared("key_people", "people").join(shared("locations", "places"), ["key", "story_id"], "full_outer").join(phrase_hits(candidates, stories), ["key", "story_id"], "full_outer")
    met = both.na.fill(0, ["people", "places", "hits"]).where("people >= 2 OR places >= 1 OR hits >= 2")
    # Texts and phrases stay behind; a pair takes along the two members.
    pair = met.join(candidates.select("key", F.col("about_member").alias("member")), "key").join(stories.select("story_id", "about_member"), "story_id")
    about = F.coalesce(F.col("member") == F.col("about_member"), F.lit(False))
    score = F.when(about, 2).otherwise(0) + F.when(F.col("people") >= 2, 1).otherwise(0) + F.when(F.col("places") >= 1, 1).otherwise(0) + F.when(F.col("hits") >= 2, 1).otherwise(0)
    return pair.select("key", "story_id", about.alias("about"), "people", "places", "hits", score.alias("score"))


def story_match(candidates: DataFrame, stories: DataFrame) -> DataFrame:
    """key, bucket, story_id: as ``story_ties``, but with a row for each story that ties."""
    ties = story_ties(candidates, stories)
    members = stories.select(F.col("story_id").alias("of_member"), F.col("about_member").alias("all_of"))
    return ties.join(members, "all_of", "left").select("key", "bucket", F.coalesce("story_id", "of_member").alias("story_id"))


def story_ties(candidates: DataFrame, stories: DataFrame) -> DataFrame:
    """key, bucket, score, story_id, all_of: HIGH with the one best story, MEDIUM with all that tie, LOW with none.

    A member counts 2, two people 1, a place 1, two phrases 1. HIGH needs 4 and a
    phrase of the best story (of most people, then of least id). Where stories tie
    at 2 for being of the candidate's member, one row names them all by ``all_of``,
    the member, instead of one row a story; stories of others have rows of their own.
    """
    scored = cut(story_scores(candidates, stories).where("score >= 2"))
    members = stories.where("about_member IS NOT NULL").select("about_member").distinct().withColumn("told", F.lit(True))
    base = candidates.select("key", "about_member").join(members, "about_member", "left").select("key", F.when(F.col("told"), F.col("about_member")).alias("of"))
    tops = scored.groupBy("key").agg(F.max("score").alias("most"))
    best = base.join(tops, "key", "left").select("key", "of", F.greatest(F.coalesce("most", F.lit(0)), F.when(F.col("of").isNotNull(), 2).otherwise(0)).alias("best"))
    first = F.row_number().over(W.partitionBy("key").orderBy(F.desc("people"), "story_id"))
    tied = scored.join(best, "key").where("score = best AND best >= 2").withColumn("first", first)
    sure = F.max(F.when(F.col("first") == 1, (F.col("hits") >= 1) & (F.col("best") >= 4))).over(W.partitionBy("key"))
    rows = tied.withColumn("sure", sure).where("NOT sure OR first = 1").where("best > 2 OR NOT about").select("key", F.when(F.col("sure"), "HIGH").otherwise("MEDIUM").alias("bucket"), F.col("best").alias("score"), "story_id", F.lit(None).cast("string").alias("all_of"))
    whole = best.where("best = 2 AND of IS NOT NULL").select("key", F.lit("MEDIUM").alias("bucket"), F.col("best").alias("score"), F.lit(None).cast("string").alias("story_id"), F.col("of").alias("all_of"))
    low = best.where("best < 2").select("key", F.lit("LOW").alias("bucket"), F.lit(0).alias("score"), F.lit(None).cast("string").alias("story_id"), F.lit(None).cast("string").alias("all_of"))
    return rows.unionByName(whole).unionByName(low)


def word_pairs(df: DataFrame, key: str, group: str, words: str) -> DataFrame:
    """key_a, key_b, jaccard of all pairs of a group whose sets of words have a Jaccard of 0.5 or more.

    Of n words, rarest first, the first n - ceil(n / 2) + 1 are joined; two sets
    that are alike enough share one of them.
    """
    sets = df.select(F.col(key).alias("k"), F.col(group).alias("g"), F.array_distinct(words).alias("ws")).where("g IS NOT NULL AND size(ws) > 0")
    token = sets.select("k", "g", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    ranked = token.join(token.groupBy("g", "w").agg(F.count("*").alias("df")), ["g", "w"]).withColumn("r", F.row_number().over(W.partitionBy("g", "k").orderBy("df", "w")))
    first = ranked.where("r <= n - ceil(n / 2) + 1")
    a, b = first.alias("a"), first.alias("b")
    near = (F.col("a.g") == F.col("b.g")) & (F.col("a.w") == F.col("b.w")) & (F.col("a.k") < F.col("b.k")) & (F.col("a.n") <= 2 * F.col("b.n")) & (F.col("b.n") <= 2 * F.col("a.n"))
    met = a.join(b, near).select(F.col("a.k").alias("key_a"), F.col("b.k").alias("key_b")).distinct()
    of = lambda end: sets.select(F.col("k").alias(f"key_{end}"), F.col("ws").alias(f"ws_{end}"))
    scored = met.join(of("a"), "key_a").join(of("b"), "key_b").select("key_a", "key_b", jaccard(F.col("ws_a"), F.col("ws_b")).alias("jaccard"))
    return scored.where("jaccard >= 0.5")


def cross_match(df: DataFrame, key: str, group: str, phrases: str, line: str) -> DataFrame:
    """key_a, key_b, shared, jaccard: rows of a group that share a phrase, and else those whose lines are alike.

    Rows without a group aren't compared. ``shared`` counts phrases in common; where there
    are none, ``jaccard`` of the words of the lines is 0.5 or more, to two places.
    """
    each = df.where(F.col(group).isNotNull()).select(F.col(key).alias("k"), F.col(group).alias("g"), F.explode(F.array_distinct(phrases)).alias("p"))
    a, b = each.alias("a"), each.alias("b")
    met = a.join(b, (F.col("a.p") == F.col("b.p")) & (F.col("a.g") == F.col("b.g")) & (F.col("a.k") < F.col("b.k")))
    shared = met.groupBy(F.col("a.k").alias("key_a"), F.col("b.k").alias("key_b")).agg(F.count("*").alias("shared"))
    lines = df.select(F.col(key).alias("k"), F.col(group).alias("g"), F.regexp_extract_all(F.lower(F.coalesce(F.col(line), F.lit(""))), F.lit("[ऀ-ॿA-Za-z0-9]+"), F.lit(0)).alias("ws"))
    alike = word_pairs(lines, "k", "g", "ws").join(shared, ["key_a", "key_b"], "left_anti")
    return shared.withColumn("jaccard", F.lit(None).cast("double")).unionByName(alike.select("key_a", "key_b", F.lit(0).cast("bigint").alias("shared"), F.round("jaccard", 2).alias("jaccard")))


def aliases(containers: DataFrame, originals: DataFrame, key: str, language: str, text: str, blocking: int = 8, least: float = 0.55, shortest: int = 40) -> DataFrame:
    """id, alias_id, confidence: for each container the likest original of its language.

    A container is compared with the ``blocking`` originals that score best by BM25
    for its text, by the Jaccard similarity of their runs of five characters; texts
    of fewer than ``shortest`` characters aren't compared. Both tables are read
    more than once: they are best cut from what they come from.
    """
    from pothi.operators.retrieval import bm25_best, top

    long = lambda df, k: df.where(F.length(text) >= shortest).select(F.concat_ws("|", F.coalesce(F.col(language), F.lit("")), F.col(key)).alias(k), F.coalesce(F.col(language), F.lit("")).alias(f"lang_{k}"), F.col(text).alias(f"text_{k}"))
    c, o = long(containers, "c"), long(originals, "o")
    pairs = bm25_best(o, "o", "text_o", "lang_o", c, "c", "text_c", "lang_c", blocking).select("c", "o")
    told = lambda df, k: df.select(k, plain(F.col(f"text_{k}")).alias(f"plain_{k}"))
    sized = gram_likeness(pairs.join(told(o, "o"), "o").join(told(c, "c"), "c"), ["c", "o"], "plain_c", "plain_o").withColumnRenamed("likeness", "confidence")
    name = lambda col: F.substring_index(col, "|", -1)
    return top(sized, "c", "confidence", "o", 1).where(F.col("confidence") >= least).select(name("c").alias("id"), name("o").alias("alias_id"), "confidence")

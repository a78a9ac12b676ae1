"""Which work a question is about."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pothi.functions.text import decomposed_key, quoted_spans, strip

LEAST_KEY, LEAST_TITLE = 5, 8


def _bare(text: pd.Series) -> pd.Series:
    bare = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return text.map(lambda s: s if s is None or s.isascii() else bare(s))


def title_key(text: Column) -> Column:
    """Key of a title or of words that may be one: without marks, case, stopwords, blanks and signs."""
    # Spark has no normal forms; texts go to Python in Arrow batches for that step.
    return decomposed_key(F.pandas_udf(_bare, "string")(text))


def titles(works: DataFrame, work: str, columns: list[str]) -> DataFrame:
    """work_id, title, title_key: each title of a work once, whatever its case; of two characters or more."""
    each = works.where(F.col(work).isNotNull()).select(F.col(work).alias("work_id"), F.explode(F.array(*columns)).alias("title"))
    named = each.select("work_id", strip(F.col("title")).alias("title")).where("length(title) >= 2")
    once = named.groupBy("work_id", F.lower("title").alias("low")).agg(F.min("title").alias("title"))
    return once.select("work_id", "title", title_key(F.col("title")).alias("title_key"))


def _bounded(catalogue: DataFrame, most: int) -> DataFrame:
    """The catalogue for all tasks while it has at most ``most`` titles, else left to the planner."""
    return F.broadcast(catalogue) if catalogue.limit(most + 1).count() <= most else catalogue


def quoted_matches(questions: DataFrame, key: str, question: str, catalogue: DataFrame, most_titles: int = 100_000) -> DataFrame:
    """key, work_id: works that a stretch in quotation marks names, whole or in part, or that are named within it."""
    spans = questions.select(F.col(key), F.explode(quoted_spans(F.col(question))).alias("span")).select(key, title_key(F.col("span")).alias("k")).where(F.length("k") >= LEAST_KEY).distinct()
    named = _bounded(catalogue.select("work_id", "title_key").where(F.length("title_key") >= LEAST_KEY).distinct(), most_titles)
    return spans.join(named, F.col("title_key").contains(F.col("k")) | F.col("k").contains(F.col("title_key"))).select(key, "work_id").distinct()


def mentioned_work(questions: DataFrame, key: str, question: str, catalogue: DataFrame, most_titles: int = 100_000) -> DataFrame:
    """key, work_id, method, n: the one work a question names.

    What stands in quotation marks goes first (``quoted``), then titles of eight
    characters or more anywhere in the question (``substring``); two works or more
    make it ``ambiguous``, none ``none``; n is how many were found.
    """
    quoted = quoted_matches(questions, key, question, catalogue, most_titles).groupBy(key).agg(F.collect_set("work_id").alias("quoted"))
    long = _bounded(catalogue.where((F.length("title") >= LEAST_TITLE) & (F.col("title_key") != "")).select("work_id", "title_key").distinct(), most_titles)
    keyed = questions.select(key, title_key(F.col(question)).alias("k"))
    inside = keyed.join(long, F.col("k").contains(F.col("title_key"))).groupBy(key).agg(F.collect_set("work_id").alias("inside"))
    both = questions.select(key).distinct().join(quoted, key, "left").join(inside, key, "left")
    found = F.coalesce("quoted", "inside")
    method = F.when(found.isNull(), "none").when(F.size(found) > 1, "ambiguous").when(F.col("quoted").isNotNull(), "quoted").otherwise("substring")
    return both.select(key, F.when(F.size(found) == 1, F.get(found, F.lit(0))).alias("work_id"), method.alias("method"), F.coalesce(F.size(found), F.lit(0)).alias("n")).withColumn("n", F.greatest(F.lit(0), "n"))

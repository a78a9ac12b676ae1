"""Taking in tellings: names in their text, one line, merging them into stories and their index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pothi.functions.text import squeeze, strip


def tagged(df: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """key, kind, id of every term of dictionary(kind, id, term) that stands in a text, whatever its case.

    Terms are found by the three letters they begin with, so that a text meets only
    terms whose beginning it has; shorter terms meet all texts.
    """
    terms = dictionary.where("term <> ''").select("kind", "id", F.lower("term").alias("term")).distinct()
    low = df.select(F.col(key).alias("key"), F.lower(text).alias("low")).where("low IS NOT NULL")
    starts = low.select("key", "low", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("low") - 2)), lambda i: F.substring("low", i, F.lit(3))))).alias("start"))
    long = starts.join(terms.where("length(term) >= 3").withColumn("start", F.left("term", F.lit(3))), "start").where(F.col("low").contains(F.col("term")))
    short = low.join(F.broadcast(terms.where("length(term) < 3")), F.col("low").contains(F.col("term")))
    return long.select("key", "kind", "id").unionByName(short.select("key", "kind", "id")).distinct()


def one_line(text: Column, heading: Column) -> Column:
    """The heading if it has 15 to 200 characters, else the first paragraph of 30 or more, at most 240 of it, else what there is."""
    fit = F.filter(F.transform(F.split(text, r"\n\s*\n"), squeeze), lambda p: F.length(p) >= 30)
    some = F.coalesce(heading, F.lit(""))
    return F.when(F.length(some).between(15, 200), strip(some)).when(F.size(fit) > 0, F.left(F.get(fit, F.lit(0)), F.lit(240))).otherwise(F.left(F.when(some != "", some).otherwise(text), F.lit(240)))


def _arrived(incoming: DataFrame) -> DataFrame:
    """story_id, new_files, new_people of incoming(story_id, file, key_people): each file once."""
    return incoming.groupBy("story_id").agg(F.collect_set("file").alias("new_files"), F.array_distinct(F.flatten(F.collect_list("key_people"))).alias("new_people"))



def merged(stories: DataFrame, incoming: DataFrame) -> DataFrame:
    """story_id, people, files: stories(story_id, key_people, files) with what came in; a file that is there already adds nothing but its people."""
    none = F.array().cast("array<string>")
    both = stories.join(_arrived(incoming), "story_id", "full_outer")
    people = F.array_sort(F.array_distinct(F.concat(F.coalesce("key_people", none), F.coalesce("new_people", none))))
    return both.select("story_id", F.filter(people, lambda p: p.isNotNull()).alias("people"), F.array_union(F.coalesce("files", none), F.coalesce("new_files", none)).alias("files"))


def indexed(index: DataFrame, incoming: DataFrame) -> DataFrame:
    """story_id, key_people, locations, files: an entry keeps what it was seeded with and only gains files; a new one is seeded by its first file."""
    none = F.array().cast("array<string>")
    first = incoming.groupBy("story_id").agg(F.min_by(F.struct("key_people", "locations"), "file").alias("seed"), F.collect_set("file").alias("new_files"))
    both = index.withColumn("_old", F.lit(True)).join(first, "story_id", "full_outer")
    kept = lambda c: F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"seed.{c}")).alias(c)
    return both.select("story_id", kept("key_people"), kept("locations"), F.array_union(F.coalesce("files", none), F.coalesce("new_files", none)).alias("files"))

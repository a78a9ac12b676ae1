"""Reading corpus trees: texts with front matter by path, JSON lines, scanned pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FRONT = r"(?s)^---\s*\n(.*?)\n---\s*\n"


def text_tree(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """path, author, kind, work_id, lang, front, body: one row per text under author/kind/work/lang, working copies left out."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    part = F.split("path", "/")
    at = lambda k: F.try_element_at(part, F.lit(-k))
    rows = raw.select("path", at(5).alias("author"), at(4).alias("kind"), at(3).alias("work_id"), at(2).alias("lang"), F.regexp_extract("raw", _FRONT, 1).alias("front"), F.regexp_replace("raw", _FRONT, "").alias("body"))
    return rows.where(~F.col("work_id").rlike(r"^\.|\.bak|\.pre-|\.old"))


def first_filled(*columns: str):
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines file, and its malformed lines."""
    whole = T.StructType.fromDDL(schema).add("_bad", T.StringType())
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.where("r._bad IS NULL").select("r.*").drop("_bad"), rows.where("r._bad IS NOT NULL").select(F.col("value").alias("_bad"))


def scanned_words(spark: SparkSession, path: str) -> DataFrame:
    """page, at, word, x0, y0, x1, y1: words with their boxes from an XML of OBJECT pages."""
    schema = "PARAM STRING, HIDDENTEXT STRUCT<PAGECOLUMN: STRUCT<REGION: STRUCT<PARAGRAPH: STRUCT<LINE: STRUCT<WORD: ARRAY<STRUCT<_VALUE: STRING, _coords: STRING>>>>>>>"
    pages = spark.read.format("xml").option("rowTag", "OBJECT").schema(schema).load(path)
    boxed = pages.select(F.monotonically_increasing_id().alias("page"), F.posexplode("HIDDENTEXT.PAGECOLUMN.REGION.PARAGRAPH.LINE.WORD").alias("at", "w"))
    xy = F.split("w._coords", ",")
    return boxed.select("page", "at", F.col("w._VALUE").alias("word"), *[F.try_element_at(xy, F.lit(k)).cast("double").alias(c) for k, c in ((1, "x0"), (2, "y0"), (3, "x1"), (4, "y1"))])


def front_matter(text: Column) -> tuple[Column, Column]:
    """Fields of the front matter of a text (plain ``name: value`` lines; others and a broken header give none), and its body."""
    head = F.regexp_extract(text, _FRONT, 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[A-Za-z_]\w*:( |$)"))
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), "^[\"'](.*)[\"']$", "$1").alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    # The last of repeated names holds.
    last = F.transform(names, lambda n: F.struct(n.alias("k"), F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"].alias("v")))
    return F.map_from_entries(last), F.regexp_replace(text, _FRONT, "")


def tolerant_lines(spark: SparkSession, path: str, field: str) -> DataFrame:
    """at, value: one field of each line of a JSON-lines file that isn't blank, empty where the line is broken or has none."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.coalesce(F.get_json_object("value", f"$.{field}"), F.lit("")).alias(field), F.col("value").alias("line"))

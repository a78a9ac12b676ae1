"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pothi.sources.tables import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from pothi.llm.p06_shared_spans import SharedSpans

    return SharedSpans(table(spark, d, "chunks", "id", "work_id", "cite_text"), "id", "work_id", "cite_text").pairs


def p6_share(spark: SparkSession, d: str) -> DataFrame:
    """Of each citable chunk, how much stands in chunks of other works."""
    from pothi.llm.p06_shared_spans import SharedSpans, coverage

    chunks = table(spark, d, "chunks", "id", "work_id", "cite_text").where("cite_text is not null")
    parts = coverage(SharedSpans(chunks, "id", "work_id", "cite_text").spans)
    covered = parts.groupBy("id").agg(F.sum(F.col("end") - F.col("start")).alias("shared_chars"), F.count("*").alias("n_spans"))
    sizes = chunks.groupBy("id").agg(F.max(F.length("cite_text")).alias("n_chars"))
    shared = F.coalesce("shared_chars", F.lit(0))
    return sizes.join(covered, "id", "left").select("id", "n_chars", shared.cast("bigint").alias("shared_chars"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.round(F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0), 6).alias("share"))


def _tellings(spark: SparkSession, d: str) -> DataFrame:
    sent = table(spark, d, "candidate", "file", "idx", "raw_text").select(F.concat_ws("#", "file", F.col("idx").cast("string")).alias("key"), F.col("raw_text").alias("text"))
    kept = table(spark, d, "meta", "variants").select(F.explode("variants").alias("v")).select(F.col("v.file").alias("key"), F.col("v.text").alias("text"))
    return sent.unionByName(kept)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from pothi.llm.p07_near_duplicates import NearDuplicates

    return NearDuplicates(_tellings(spark, d), "key", "text", 3, 0.5).pairs()


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    from pothi.llm.p07_near_duplicates import NearDuplicates

    return NearDuplicates(_tellings(spark, d), "key", "text", 3, 0.5).groups()


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    from pothi.llm.p09_leaks import leaks

    return leaks(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", table(spark, d, "gold"), "item_id", ["query", "expected_text_substr"])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """How much of each item's query and answer a document gives away."""
    return _leaks(spark, d).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "part", "hits", "runs", F.round(F.col("hits") / F.col("runs"), 6).alias("share"))


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents that say an item's query or answer again with words left out, put in or replaced."""
    from pothi.llm.p09_leaks import near_leaks

    found = near_leaks(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", table(spark, d, "gold"), "item_id", ["query", "expected_text_substr"], "expected_text_substr")
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def _truncation(spark: SparkSession, d: str) -> DataFrame:
    from pothi.llm.p10_truncation import truncation

    return truncation(table(spark, d, "documents", "doc_id", "text", "source"), "doc_id", "text", "source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _truncation(spark, d).where("is_cut").select(F.col("key").alias("doc_id"))


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts its texts."""
    from pothi.llm.p10_truncation import rates

    return rates(_truncation(spark, d))


def _scans(spark: SparkSession, d: str):
    from pothi.llm.p05_scans import Scans

    return Scans(table(spark, d, "chunks", "id", "source_path", "kind_level", "text", "built_at"), table(spark, d, "vol_stats", "source_path"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).found()


def p5_volumes(spark: SparkSession, d: str) -> DataFrame:
    """Page numbers and rejoined paragraphs of each scanned file."""
    return _scans(spark, d).volumes()


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The scanned texts as continuous paragraphs."""
    return _scans(spark, d).paragraphs()


def _garbled(spark: SparkSession, d: str):
    from pothi.llm.p02_encoding import Garbled

    return Garbled(table(spark, d, "chunks", "id", "work_id", "text"), "id", "work_id", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).affected().select("id")


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The affected chunks with their text put right."""
    return _garbled(spark, d).repaired()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from pothi.llm.p03_lookalikes import equal_looking, one_form

    bodies = one_form(table(spark, d, "quotes", "quote_id", "body"), "quote_id", "body")
    cites = one_form(table(spark, d, "chunks", "id", "cite_text"), "id", "cite_text")
    return equal_looking(bodies, cites).select(F.col("key_a").alias("quote_id"), F.col("key_b").alias("id"))


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every quotation in its one form."""
    from pothi.llm.p03_lookalikes import one_form

    return one_form(table(spark, d, "quotes", "quote_id", "body"), "quote_id", "body", keep=True).select(F.col("key").alias("quote_id"), "form").distinct()


def p1_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentence units of all chunks and quotations."""
    from pothi.llm.p01_sentences import sentences

    chunks = table(spark, d, "chunks", "id", "text").select(F.lit("chunk").alias("kind"), F.col("id").alias("key"), "text")
    quotes = table(spark, d, "quotes", "quote_id", "body").select(F.lit("quote").alias("kind"), F.col("quote_id").cast("string").alias("key"), F.col("body").alias("text"))
    units = sentences(chunks.unionByName(quotes).where("key IS NOT NULL").withColumn("key", F.concat_ws(" ", "kind", "key")), "key", "text")
    return units.select(F.substring("key", 1, 5).alias("rec_kind"), F.expr("substring(key, 7)").alias("rec_key"), "unit_no", "after", "end_char")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from pothi.llm.p01_sentences import sentences

    sample = table(spark, d, "unit_sample", "rec_kind", "rec_key").distinct()
    chunks = table(spark, d, "chunks", "id", "text").select(F.lit("chunk").alias("rec_kind"), F.col("id").alias("rec_key"), "text")
    quotes = table(spark, d, "quotes", "quote_id", "body").select(F.lit("quote").alias("rec_kind"), F.col("quote_id").cast("string").alias("rec_key"), F.col("body").alias("text"))
    judged = chunks.unionByName(quotes).join(sample, ["rec_kind", "rec_key"], "left_semi").withColumn("key", F.concat_ws(" ", "rec_kind", "rec_key"))
    units = sentences(judged, "key", "text")
    return units.select(F.substring("key", 1, 5).alias("rec_kind"), F.expr("substring(key, 7)").alias("rec_key"), "end_char")


def _languages(spark: SparkSession, d: str) -> DataFrame:
    from pothi.llm.p04_language import languages

    return languages(table(spark, d, "chunks", "id", "kind_level", "language", "text", "built_at"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from pothi.llm.p04_language import mislabelled

    return mislabelled(_languages(spark, d)).drop("confidence")


def p4_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk's stretches with language and confidence."""
    return _languages(spark, d).select("id", "named", F.explode("segs").alias("s")).select("id", "named", "s.seg_start", "s.language", "s.confidence", "s.sentences", "s.ambiguous")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document in a container of each capacity."""
    from pothi.llm.p08_packing import lengths, packed
    from pothi.plans.lineage import cut

    items = cut(lengths(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text"))
    return packed(items, table(spark, d, "context_sizes", "size_id", "capacity")).withColumnRenamed("key", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_sentences, p2_found, p2_repaired, p3_found, p3_forms, p4_found, p4_languages, p5_found, p5_volumes, p5_paragraphs, p6_found, p6_share, p7_found, p7_groups, p8_packed, p9_found, p9_leaks, p9_near, p10_found, p10_sources)}

_SP = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_WORDS = lambda x: rf"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '\p{{P}}+', '', 'g'), '{_SP}+'), lambda w: w <> '')"
_RUNS = lambda w, n: f"CASE WHEN len({w}) >= {n} THEN list_distinct(list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))) ELSE [] END"
_LEAKS = f"""docs AS (SELECT doc_id, unnest({_RUNS('w', 15)}) AS r FROM (SELECT doc_id, {_WORDS('text')} AS w FROM documents WHERE text IS NOT NULL)),
  parts AS (SELECT item_id, part, {_RUNS('w', 15)} AS rs FROM (SELECT item_id, part, {_WORDS('x')} AS w FROM (SELECT item_id, 'query' AS part, query AS x FROM gold UNION ALL SELECT item_id, 'expected_text_substr', expected_text_substr FROM gold) WHERE x IS NOT NULL)),
  met AS (SELECT doc_id, item_id, part, count(DISTINCT r) AS hits, any_value(len(rs)) AS runs FROM (SELECT item_id, part, rs, unnest(rs) AS r FROM parts) JOIN docs USING (r) GROUP BY ALL)"""
_SPANS = """win AS (SELECT DISTINCT id, w, i AS s, hash(substr(t, i, 220)) AS h FROM (SELECT id, coalesce(work_id, '') AS w, cite_text AS t, unnest(range(1, length(cite_text) - 218)) AS i FROM (SELECT DISTINCT id, work_id, cite_text FROM chunks WHERE length(cite_text) >= 220)))"""
SQL: dict[str, str] = {
    "p6_found": f"WITH {_SPANS} SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM win a JOIN win b ON a.h = b.h AND a.w <> b.w AND a.id < b.id",
    "p6_share": f"""WITH {_SPANS}, shared AS (SELECT DISTINCT id, s FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(DISTINCT w) > 1)), isl AS (SELECT id, s, sum(n) OVER (PARTITION BY id ORDER BY s) AS k FROM (SELECT id, s, CASE WHEN s > lag(s) OVER (PARTITION BY id ORDER BY s) + 220 THEN 1 ELSE 0 END AS n FROM shared)),
      cov AS (SELECT id, sum(e) AS c, count(*) AS m FROM (SELECT id, k, max(s) - min(s) + 220 AS e FROM isl GROUP BY id, k) GROUP BY id) SELECT id, n_chars, CAST(coalesce(c, 0) AS BIGINT) AS shared_chars, coalesce(m, 0) AS n_spans, round(CASE WHEN n_chars > 0 THEN coalesce(c, 0) / n_chars ELSE 0 END, 6) AS share FROM (SELECT id, max(length(cite_text)) AS n_chars FROM chunks WHERE cite_text IS NOT NULL GROUP BY id) LEFT JOIN cov USING (id)""",
    "p7_found": f"""WITH t AS (SELECT DISTINCT file || '#' || idx AS key, raw_text AS text FROM candidate UNION SELECT v.file, v.text FROM (SELECT unnest(variants) AS v FROM meta)), g AS (SELECT key, {_RUNS('w', 3)} AS rs FROM (SELECT key, {_WORDS('text')} AS w FROM t WHERE key IS NOT NULL AND text IS NOT NULL)), e AS (SELECT key, len(rs) AS n, unnest(rs) AS r FROM g)
      SELECT a.key AS key_a, b.key AS key_b FROM e a JOIN e b ON a.r = b.r AND a.key < b.key GROUP BY a.key, b.key HAVING count(*) >= 0.5 * (any_value(a.n) + any_value(b.n) - count(*))""",
    "p9_found": f"WITH {_LEAKS} SELECT DISTINCT doc_id, item_id FROM met",
    "p9_leaks": f"WITH {_LEAKS} SELECT doc_id, item_id, part, hits, runs, round(hits / runs, 6) AS share FROM met",
}

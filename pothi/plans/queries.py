"""Queries of the core over the driver's tables; the keys begin with the operator they show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pothi.functions import lexical as lx
from pothi.functions import text as tx
from pothi.operators import citations as ci
from pothi.operators import corpus as co
from pothi.operators import logs as lo
from pothi.operators import reader as rd
from pothi.operators import retrieval as re_
from pothi.plans import building, citing, matching, texts
from pothi.sources.tables import latest
from pothi.sources.tables import table as t


def _chunks(s, d, *cols):
    """Chunks of the latest build."""
    newest = latest(t(s, d, "chunks", *dict.fromkeys(("id", *cols, "built_at"))), ["id"], "built_at")
    return newest if "built_at" in cols else newest.drop("built_at")


def _documents(s, d, *cols):
    return t(s, d, "documents", *cols).distinct()


def _gold(s, d):
    return t(s, d, "gold", "item_id", "query", "expected").where("query IS NOT NULL")


def _scores(s, d):
    return re_.bm25(_documents(s, d, "doc_id", "text").where("text IS NOT NULL"), "doc_id", "text", _gold(s, d), "item_id", "query")


def c01_metadata_filter(s, d):
    return _chunks(s, d, "kind", "language", "kind_level").where((F.col("kind") == "canonical") & F.col("language").eqNullSafe("mr") & (F.col("kind_level") == "parent")).select("id", "kind", "language")


def c02_chunk_tier(s, d):
    return _chunks(s, d, "kind").select(re_.tier(F.col("kind")).alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))


def c03_intent_weights(s, d):
    chunks = _chunks(s, d, "kind", "author", "quality_score")
    intents = s.createDataFrame([(i,) for i in ("doctrinal", "narrative", "navigational", "other")], "intent string")
    primary = F.coalesce(F.col("author").isin("lokesh-mani-th", "pinor-rudh"), F.lit(False))
    w = F.coalesce("quality_score", F.lit(1.0)) + re_.tier_weight(F.col("intent"), re_.tier(F.col("kind")), primary)
    return chunks.crossJoin(F.broadcast(intents)).groupBy("intent", "kind").agg(F.round(F.avg(w), 6).alias("avg_weight"), F.count("*").alias("n"))


def c07_log_paths(s, d):
    p = F.col("path")
    return lo.requests(t(s, d, "access_log")).where(p.isin("/ask", "/works") | F.startswith(p, F.lit("/read/"))).groupBy(F.when(F.startswith(p, F.lit("/read/")), "/read/").otherwise(p).alias("route")).agg(F.count("*").alias("n"))


def c08_work_filter(s, d):
    title = lambda c: F.coalesce(F.lower(c), F.lit("")).contains("river")
    return t(s, d, "works", "work_id", "title", "title_en").where(title(F.col("title")) | title(F.col("title_en")))


def c13_cite_is_clean(s, d):
    c = F.col("cite_text")
    deva, latin = lx.count_class(c, "[ऀ-ॿ]"), lx.count_class(c, "[A-Za-z]")
    reason = F.when(F.trim(c) == "", "empty").when(c.rlike(r"[\x{FFFD}\x{200B}\x{FEFF}]"), "broken").when(deva < 20, "few letters").when(latin > deva, "latin").otherwise("clean")
    return _chunks(s, d, "cite_text").where("cite_text IS NOT NULL").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def d01_manifest(s, d):
    m = co.manifest(_chunks(s, d, "work_id", "kind", "author", "title", "language"))
    return m.select("work_id", "kind", "author", "title", F.array_join("languages", ",").alias("languages"), "chunks")


def d01_kind_rollup(s, d):
    return _chunks(s, d, "work_id", "kind", "language").groupingSets([["kind"], ["language"], []], "kind", "language").agg(F.count("*").alias("chunks"), F.countDistinct("work_id").alias("works"))


def d02_tallies(s, d):
    return _chunks(s, d, "kind", "kind_level", "token_estimate").groupBy("kind", "kind_level").agg(F.count("*").alias("n"), F.sum("token_estimate").alias("tokens"))


def d04_term_stats(s, d):
    """Documents and places of every term."""
    post = re_.postings(_documents(s, d, "doc_id", "text"), "doc_id", "text")
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def d04_lengths(s, d):
    """Terms of each document, of all and on average."""
    per = re_.terms(_documents(s, d, "doc_id", "text"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("dl"))
    total = per.agg(F.count("*").alias("n_docs"), F.sum("dl").alias("tokens"))
    return per.crossJoin(F.broadcast(total)).select("doc_id", "dl", "n_docs", F.round(F.col("tokens") / F.col("n_docs"), 6).alias("avgdl"))


def d05_works_catalog(s, d):
    c = _chunks(s, d, "work_id", "title", "language")
    return c.groupBy("work_id").agg(F.min_by(F.struct("id", "title", "language"), "id").alias("f")).select("work_id", F.col("f.id").alias("first_id"), F.col("f.title").alias("title"), F.col("f.language").alias("language"))


def d07_gate(s, d):
    return co.gate(_documents(s, d, "doc_id", "text").where("text IS NOT NULL"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def e01_tokens(s, d):
    return re_.terms(t(s, d, "gold", "item_id", "query"), "item_id", "query").groupBy("item_id", "term").agg(F.count("*").alias("tf"))


def e02_stems(s, d):
    tok = F.explode(F.array_distinct(lx.words(F.col("text"))))
    w = _documents(s, d, "doc_id", "text").select(tok.alias("raw")).select(lx.trimmed(F.col("raw")).alias("token")).where(F.col("token").rlike("[ऀ-ॿ]")).distinct()
    return w.select("token", lx.stem(F.col("token")).alias("stem")).where("stem IS NOT NULL")


def e03_bm25_topk(s, d):
    return re_.top(_scores(s, d), "item_id", "score", "doc_id", 10)


def e05_multi_query(s, d):
    g = t(s, d, "gold", "item_id", "query", "expected_text_substr")
    both = g.select(F.concat("item_id", F.lit(":q")).alias("v"), F.col("query").alias("text")).unionByName(g.select(F.concat("item_id", F.lit(":a")).alias("v"), F.col("expected_text_substr").alias("text")))
    scores = re_.bm25(_documents(s, d, "doc_id", "text").where("text IS NOT NULL"), "doc_id", "text", both, "v", "text")
    best = scores.withColumn("item_id", F.split("v", ":")[0].cast("bigint")).groupBy("item_id", "doc_id").agg(F.max("score").alias("score"))
    return re_.top(best, "item_id", "score", "doc_id", 5)


def e06_scoped_bm25(s, d):
    docs = _documents(s, d, "doc_id", "text", "lang").where("text IS NOT NULL AND lang = 'mr'")
    return re_.top(re_.bm25(docs, "doc_id", "text", _gold(s, d), "item_id", "query"), "item_id", "score", "doc_id", 5)


def _vectors(s, d):
    v = t(s, d, "embeddings", "vec_id", "embedding", "label")
    return v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def f01_cosine_topk(s, d):
    v, q = _vectors(s, d)
    return re_.top(re_.cosine_scores(v, "vec_id", "embedding", q, "query_id", "query_vector", best=11).where("vec_id <> query_id"), "query_id", "score", "vec_id", 10)


def f03_unit_vectors(s, d):
    v, _ = _vectors(s, d)
    u = re_.unit(F.col("embedding"))
    return v.select("vec_id", F.round(re_.dot(u, u), 6).alias("norm"), F.round(F.get(u, F.lit(0)), 6).alias("first"))


def f07_quality(s, d):
    # The score is computed where a row stands; only scores are exchanged.
    return latest(co.quality(t(s, d, "chunks", "id", "text", "built_at")).select("id", "quality_score", "built_at"), ["id"], "built_at").drop("built_at")


def f08_token_estimate(s, d):
    each = t(s, d, "chunks", "id", "text", "built_at").select("id", lx.token_estimate(F.col("text")).alias("tokens"), lx.mostly_devanagari(F.col("text")).alias("devanagari"), "built_at")
    return latest(each, ["id"], "built_at").drop("built_at")


def g01_child_to_parent(s, d):
    each = t(s, d, "chunks", "id", "parent_id", "kind_level", "text", "built_at").select("id", "parent_id", "kind_level", F.length("text").alias("chars"), "built_at")
    c = latest(each, ["id"], "built_at")
    p = c.where("kind_level = 'parent'").select(F.col("id").alias("parent_id"), F.col("chars").alias("parent_chars"))
    return c.where("kind_level = 'child'").select("id", "parent_id").join(p, "parent_id", "left")


def g02_carry_over(s, d):
    c = _chunks(s, d, "built_at", "quality_score")
    have, lack = co.carry_over(c.select("id", "built_at"), c.where("built_at < timestamp'2026-07-01'").select("id", "quality_score"), "id", "quality_score")
    return have.select("id", F.lit("carried").alias("state")).unionByName(lack.select("id", F.lit("new").alias("state"))).groupBy("state").agg(F.count("*").alias("n"))


def g09_paragraph_at(s, d):
    docs = _documents(s, d, "doc_id", "text").where("text IS NOT NULL AND text <> ''")
    paras = rd.paragraphs(docs, "doc_id", "text").withColumnRenamed("key", "doc_id")
    asked = docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(500), F.lit(5000))).alias("offset"))
    return rd.paragraph_at(asked, paras, "doc_id", "offset")


def g13_semi_join(s, d):
    used = t(s, d, "quotes", "work_id").where("work_id <> ''").distinct()
    return t(s, d, "works", "work_id", "title").join(used, "work_id", "left_semi")


def _dense(s, d):
    """item_id, variant, doc_id, score: the vectors of the documents of the same number against two vectors of each test question."""
    v = t(s, d, "embeddings", "vec_id", "embedding")
    asked = _gold(s, d).select("item_id", F.explode(F.array(F.struct(F.lit(1).alias("variant"), F.col("item_id").alias("vec_id")), F.struct(F.lit(2).alias("variant"), (F.col("item_id") + 240).alias("vec_id")))).alias("q")).select("item_id", "q.variant", "q.vec_id")
    q = asked.join(v, "vec_id").select((F.col("item_id") * 10 + F.col("variant")).alias("query_id"), F.col("embedding").alias("query_vector"))
    scores = re_.cosine_scores(v, "vec_id", "embedding", q, "query_id", "query_vector")
    return scores.select(F.floor(F.col("query_id") / 10).alias("item_id"), (F.col("query_id") % 10).cast("int").alias("variant"), F.col("vec_id").alias("doc_id"), "score")


def h01_ranks(s, d):
    v, q = _vectors(s, d)
    return re_.ranked(re_.cosine_scores(v, "vec_id", "embedding", q, "query_id", "query_vector"), ["query_id"], "score", "vec_id").select("query_id", "vec_id", F.col("r").alias("rank"))


def h02_rrf(s, d):
    lexical = _scores(s, d).select("item_id", "doc_id", F.lit("lexical").alias("list"), "score")
    dense = _dense(s, d).select("item_id", "doc_id", F.concat(F.lit("dense "), "variant").alias("list"), "score")
    return re_.top(re_.fuse(lexical.unionByName(dense), "item_id", "doc_id", "list", "score"), "item_id", "fused", "doc_id", 10)


def _about(s, d):
    works = t(s, d, "works", "work_id", "kind")
    docs = _documents(s, d, "doc_id", "work_id", "author", "n_chars").join(F.broadcast(works), "work_id", "left")
    return docs.select("doc_id", "kind", F.coalesce(F.col("author").isin("lokesh-mani-th", "pinor-rudh"), F.lit(False)).alias("is_primary"), F.when(F.col("n_chars") < 200, 0.5).alias("quality"))


def _intents(s, d):
    return _gold(s, d).select("item_id", tx.intent(F.col("query")).alias("intent"))


def h03_fused_candidates(s, d):
    """The pool of a hundred documents of each test question."""
    return re_.fused_candidates(_dense(s, d), _scores(s, d), _about(s, d), "item_id", "doc_id", _intents(s, d))


def c04_primary_bonus(s, d):
    """What intent, tier and the bonus of primary authors add to a document of each kind."""
    add = F.when((re_.tier(F.col("kind")) == "canonical") & F.col("is_primary"), re_.FUSED_BONUS).otherwise(0.0)
    return _about(s, d).groupBy("kind", "is_primary").agg(F.count("*").alias("n"), F.round(F.sum(add), 6).alias("bonus"))


def c05_quality_weights(s, d):
    """The first ten of the pool when its scores are weighed by quality."""
    return re_.fused_candidates(_dense(s, d), _scores(s, d), _about(s, d), "item_id", "doc_id", _intents(s, d), 10, weigh_quality=True)


def e04_zero_filled(s, d):
    """Scores of the test questions for all documents, those without a common word too, summed up."""
    q = _gold(s, d)
    every = re_.with_zeros(_scores(s, d), q, "item_id", _documents(s, d, "doc_id", "text").where("text IS NOT NULL"), "doc_id")
    return every.groupBy("item_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") == 0).alias("zeros"), F.round(F.max("score"), 6).alias("best"))


def f05_best_cosine(s, d):
    """The better of a question's two cosines for each document, of the twenty best."""
    best = _dense(s, d).groupBy("item_id", "doc_id").agg(F.max("score").alias("score"))
    return re_.top(best, "item_id", "score", "doc_id", 20)


def i01_candidates(s, d):
    return re_.top(_scores(s, d), "item_id", "score", "doc_id", 100)


def i06_parents_without_cap(s, d):
    c = _chunks(s, d, "parent_id", "work_id", "kind_level", "text").where("kind_level = 'child'")
    ranked = re_.top(re_.bm25(c, "id", "text", _gold(s, d), "item_id", "query"), "item_id", "score", "id", 100)
    return re_.parents_of(ranked.join(c.select("id", "parent_id", "work_id"), "id"), "item_id", "rank", "parent_id", "work_id", 12, 1_000_000, 3)


def j03_near_vectors(s, d):
    """Vectors whose cosine with one of the stated ones is 0.3 or more."""
    v, q = _vectors(s, d)
    return re_.cosine_scores(v, "vec_id", "embedding", q, "query_id", "query_vector").where("vec_id <> query_id AND score >= 0.3")


def h04_children(s, d):
    docs = _documents(s, d, "doc_id", "text").where("text IS NOT NULL")
    return co.children(docs, "doc_id", "text").select(F.col("key").alias("doc_id"), "child_no", F.md5("text").alias("text_md5"), F.md5("embed_text").alias("embed_md5"))


def _reader(s, d):
    c = _chunks(s, d, "work_id", "kind_level", "chunk_index", "chapter", "text", "language").where("kind_level = 'parent'")
    n = F.row_number().over(W.partitionBy("work_id").orderBy("chunk_index", "id"))
    return c.select("work_id", "id", n.alias("n"), F.coalesce("chapter", F.lit("")).alias("chapter"), F.length("text").alias("len"), (F.length("text") < 250).alias("is_heading"), F.col("text").rlike("॥").alias("is_verse"))


def h07_verse_runs(s, d):
    return rd.verse_runs(_reader(s, d), "work_id", "n", "is_verse", "is_heading", "len", 600).select("id", "in_verse")


def h08_pages(s, d):
    return rd.pages_fixed(_reader(s, d), "work_id", "n", "chapter", "is_heading").select("id", "page")


def h09_pages_by_entry(s, d):
    return rd.pages_by_entry(_reader(s, d), "work_id", "n", "is_heading").select("id", "page")


def h10_pages_by_density(s, d):
    return rd.pages_by_density(_reader(s, d), "work_id", "n", "chapter", "is_heading", "len")


def h12_daily_cap(s, d):
    return lo.daily_cap(lo.requests(t(s, d, "access_log")).withColumn("tie", F.concat_ws("|", "name", "method", "path")), "at", "tie", 15).groupBy(F.to_date("at").cast("string").alias("day")).agg(F.count_if("admitted").alias("admitted"), F.count("*").alias("n"))


def i02_mmr(s, d):
    v, q = _vectors(s, d)
    best = re_.top(re_.cosine_scores(v, "vec_id", "embedding", q, "query_id", "query_vector", best=101).where("vec_id <> query_id"), "query_id", "score", "vec_id", 100).drop("rank")
    # The values behind the picks lie on edges of rounding (seven-tenths of six places) and are compared in the tests.
    return re_.mmr(best.join(v, "vec_id"), "query_id", "vec_id", "label", "score", "embedding", duplicate=0.35).drop("mmr")


def i03_source_cap(s, d):
    best = re_.top(_scores(s, d), "item_id", "score", "doc_id", 50).join(_documents(s, d, "doc_id", "source").select("doc_id", F.trim("source").alias("source")), "doc_id")
    return re_.top(best, ["item_id", "source"], "score", "doc_id", 2, "in_source").select("item_id", "source", "doc_id", "in_source")


def i05_small_to_big(s, d):
    c = _chunks(s, d, "parent_id", "work_id", "kind_level", "text").where("kind_level = 'child'")
    g = _gold(s, d)
    ranked = re_.top(re_.bm25(c, "id", "text", g, "item_id", "query"), "item_id", "score", "id", 100)
    return re_.parents_of(ranked.join(c.select("id", "parent_id", "work_id"), "id"), "item_id", "rank", "parent_id", "work_id", 12, 1, 3)


def i08_tail(s, d):
    log = lo.requests(t(s, d, "access_log")).withColumn("tie", F.concat_ws("|", "name", "method", "path"))
    return lo.tail(log, "at", "tie", 50).select("ts", "name", "path", "status")


def i11_recent(s, d):
    log = lo.requests(t(s, d, "access_log")).where("name <> '' AND path LIKE '/read/%'")
    return lo.recent(log, "name", "path", "at").select("name", "path", "place")


def j07_evict(s, d):
    return _chunks(s, d, "work_id").where(~F.col("id").startswith("window-") & ~F.col("id").startswith("salt-")).groupBy("work_id").agg(F.count("*").alias("n"))


def j08_title_dedupe(s, d):
    return t(s, d, "works", "work_id", "title").where("trim(title) <> ''").select(F.lower(F.trim("title")).alias("title"), "work_id").distinct()


def k05_clean_body(s, d):
    q = t(s, d, "quotes", "quote_id", "body").where("body IS NOT NULL").distinct()
    return q.select("quote_id", F.md5(ci.clean_body(F.col("body"))).alias("body_md5"))


def k23_labels(s, d):
    q = t(s, d, "quotes", "quote_id", "answer_id", "ord").distinct()
    return q.select("quote_id", ci.passage_label(F.col("ord")).alias("label"))


def k28_correct(s, d):
    q = t(s, d, "quotes", "quote_id", "body").where("body IS NOT NULL").distinct()
    return q.select("quote_id", F.md5(ci.replace_first(F.col("body"), F.lit("the "), F.lit("THE "))).alias("corrected_md5"))


def k34_provenance(s, d):
    return _documents(s, d, "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("sha256"))


def s05_daily_counts(s, d):
    r = lo.requests(t(s, d, "access_log"))
    return r.groupBy(F.to_date("at").cast("string").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("name").alias("readers"), F.max("ms").alias("slowest"))


def s04_stream_counts(s, d):
    from pothi.streaming.access_log import daily_counts_stream

    return daily_counts_stream(s, d)


def a13_readable_works(s, d):
    c = _chunks(s, d, "work_id", "kind", "language", "title").where("kind = 'canonical'")
    return c.groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"), F.min("title").alias("title"))


def d14_answer_shape(s, d):
    q = t(s, d, "quotes", "quote_id", "answer_id", "body", "read_page").distinct()
    return q.groupBy("answer_id").agg(F.count("*").alias("quotes"), F.sum(F.length(F.coalesce("body", F.lit("")))).alias("chars"), F.max(F.col("read_page").isNotNull().cast("int")).alias("has_page"))


def g12_best_match(s, d):
    words = t(s, d, "works", "work_id", "title_en").where("title_en IS NOT NULL").select("work_id", F.array_distinct(F.split(F.lower(F.trim("title_en")), " +")).alias("w"))
    token = words.select("work_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    a, b = token.alias("a"), token.alias("b")
    met = a.join(b, (F.col("a.word") == F.col("b.word")) & (F.col("a.work_id") != F.col("b.work_id"))).groupBy(F.col("a.work_id").alias("work_id"), F.col("b.work_id").alias("other"), F.col("a.n").alias("n1"), F.col("b.n").alias("n2")).agg(F.count("*").alias("shared"))
    scored = met.withColumn("score", F.round(F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared")), 6)).where("score >= 0.5 OR shared >= 3")
    return re_.top(scored, "work_id", "score", "other", 1).select("work_id", "other", "shared", "score")


def h06_numbering(s, d):
    w = W.partitionBy("work_id").orderBy("n")
    return _reader(s, d).select("id", F.sum((~F.col("is_heading")).cast("int")).over(w).alias("body_no"))


def h11_chapter_starts(s, d):
    w = W.partitionBy("work_id").orderBy("n")
    return _reader(s, d).select("id", (~F.coalesce(F.lag("chapter").over(w) == F.col("chapter"), F.lit(False))).alias("starts"))


def h13_first_per_chapter(s, d):
    return _reader(s, d).groupBy("work_id", "chapter").agg(F.min_by("id", "n").alias("id"), F.min("n").alias("n"))


def i09_best_samples(s, d):
    return _chunks(s, d, "quality_score").where("quality_score IS NOT NULL").orderBy(F.desc("quality_score"), "id").limit(40).select("id", "quality_score")


def i10_kept_links(s, d):
    q = t(s, d, "quotes", "quote_id", "answer_id", "ord", "work_id").distinct().where("work_id <> ''")
    valid = q.join(t(s, d, "works", "work_id"), "work_id", "left_semi")
    rank = F.row_number().over(W.partitionBy("answer_id").orderBy("ord", "quote_id"))
    return valid.withColumn("r", rank).groupBy("answer_id").agg(F.count_if(F.col("r") <= 3).alias("kept"), F.count_if(F.col("r") > 3).alias("dropped"))


def j09_new_entries(s, d):
    log = t(s, d, "access_log", "ts", "name", "path", "received_at")
    old = log.where("received_at < timestamp'2026-02-01'").select("ts", "name", "path").distinct()
    new = log.where("received_at >= timestamp'2026-02-01'").dropDuplicates(["ts", "name", "path"])
    same = [new[c].eqNullSafe(old[c]) for c in ("ts", "name", "path")]
    return new.join(old, same, "left_anti").select("ts", "name", "path")


def j10_filled_ids(s, d):
    log = t(s, d, "access_log", "ts", "name", "path").distinct()
    nth = F.row_number().over(W.partitionBy("ts").orderBy("path", "name"))
    return log.select(F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.concat("ts", F.lit("-"), (nth - 1).cast("string"))).alias("id"), "ts", "path")


def k29_word_count(s, d):
    return _documents(s, d, "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.regexp_count("text", F.lit(r"[^ \n]+")).alias("n_words"))


_ALL = [f for n, f in list(globals().items()) if n[0] in "acdefghijks" and n[1:3].isdigit() and callable(f)]
QUERIES = {**{f.__name__[0].upper() + f.__name__[1:]: f for f in _ALL}, **texts.QUERIES, **matching.QUERIES, **citing.QUERIES, **building.QUERIES}

"""Operators that would make all pairs, and the ways that don't."""

import random

from pyspark.sql import functions as F

from pothi.operators import matching as ma
from pothi.operators import retrieval as rt


def _texts(n, seed):
    rng = random.Random(seed)
    return [(f"{seed}-{i:02d}", rng.choice(["en", "mr"]), " ".join(rng.choice(["river", "lamp", "नदीला", "stone", "village-road", "teacher", "दिवा"]) for _ in range(rng.randint(1, 9)))) for i in range(n)]


def test_best_in_blocks_are_the_best_of_all_pairs(spark):
    docs = spark.createDataFrame(_texts(40, 1), "o string, lang_o string, text_o string")
    asked = spark.createDataFrame(_texts(30, 2), "c string, lang_c string, text_c string")
    every = rt.bm25(docs, "o", "text_o", asked, "c", "text_c").join(asked, "c").join(docs, "o").where("lang_c = lang_o AND score > 0")
    want = {(r.c, r.o, r.score, r["rank"]) for r in rt.top(every, "c", "score", "o", 4).collect()}
    got = {(r.c, r.o, r.score, r["rank"]) for r in rt.bm25_best(docs, "o", "text_o", "lang_o", asked, "c", "text_c", "lang_c", 4, texts=7, asking=5).collect()}
    assert got == want and len(want) > 60


def test_likeness_of_plain_texts_is_that_of_their_runs(spark):
    rows = [("a", "The  River ran", "the river\nruns"), ("b", "", ""), ("c", "abc", "ABC"), ("d", "abc", "abcd"), ("e", "", "abcdef"), ("f", "नदी वाहते आहे", "नदी वाहते होती")]
    df = spark.createDataFrame(rows, "k string, x string, y string")
    want = {r.k: r.s for r in df.select("k", F.round(ma.jaccard(ma.char_grams(F.col("x")), ma.char_grams(F.col("y"))), 6).alias("s")).collect()}
    told = df.select("k", ma.plain(F.col("x")).alias("x"), ma.plain(F.col("y")).alias("y"))
    assert {r.k: r.likeness for r in ma.gram_likeness(told, ["k"], "x", "y").collect()} == want


def test_tellings_of_a_story_are_merged_whatever_their_size(spark):
    from pothi.plans.matching import k11_gram_similarity

    found = k11_gram_similarity(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "array_distinct" not in plan


def test_rough_scores_let_no_best_text_go():
    import numpy as np

    rng = np.random.default_rng(3)
    for n, k in ((400, 3), (60, 8), (5, 8), (3000, 8)):
        docs = [np.sort(rng.choice(n, min(m, n), replace=False)) for m in (3, 9, n // 40 + 1, n // 4 + 1, n // 2 + 1, n, n)]
        # Scores that differ in the seventh digit only, and scores that don't.
        weights = [1 + rng.uniform(0, 1e-6, len(d)) if n == 3000 else rng.uniform(0.1, 2, len(d)) for d in docs]
        term, doc, weight = np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate(docs), np.concatenate(weights)
        asked = [(np.arange(len(docs)), np.array([9.0, 7.0, 3.0, 3.0, 1.0, 0.01, 0.01])), (np.array([4, 5]), np.array([1.0, 2.0])), (np.array([0, 7]), np.array([1.0, 5.0])), (np.array([8]), np.array([5.0]))]
        for (of, idf), (near, got) in zip(asked, rt._best_of(k, n, 9, term, doc, weight, asked), strict=True):
            whole = np.zeros(n)
            for t, i in zip(of, idf):
                whole[doc[term == t]] += i * weight[term == t]
            best = np.argsort(-whole, kind="stable")[:k]
            assert {i for i in best if whole[i] > 0} <= set(near) and np.allclose(got, whole[near])


def test_texts_are_taken_apart_without_an_exchange_of_their_terms(spark):
    docs = spark.createDataFrame(_texts(40, 1), "o string, lang_o string, text_o string")
    asked = spark.createDataFrame(_texts(30, 2), "c string, lang_c string, text_c string")
    found = rt.bm25_best(docs, "o", "text_o", "lang_o", asked, "c", "text_c", "lang_c", 4)
    # What meets are arrays of hashes; neither terms nor texts come along.
    kinds = found._jdf.queryExecution().analyzed().toString()
    assert "text_o" not in kinds.split("CoGroup")[-1] and "tf#" not in kinds

"""Sides of the operators that small data doesn't reach by itself, and results on the test tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pothi.llm import p01_sentences as p1
from pothi.llm import p02_encoding as p2
from pothi.llm import p03_lookalikes as p3
from pothi.llm import p04_language as p4
from pothi.llm import p08_packing as p8
from pothi.llm.p06_shared_spans import SharedSpans
from pothi.llm.p07_near_duplicates import NearDuplicates
from pothi.llm.p10_truncation import truncation

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("piece", [120, 500])
def test_prefix_scan_equals_one_run_on_real_texts(spark, piece):
    rows = spark.read.parquet(f"{DATA}/chunks.parquet").select("id", "text").unionByName(spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), "text")).distinct()
    want = {}
    for r in rows.where("text IS NOT NULL").collect():
        want.setdefault(r.id, set()).update(p1.unit_ends(r.text))
    got = {}
    for r in p1.sentences(rows, "id", "text", piece=piece).collect():
        got.setdefault(r.key, set()).add(r.end_char)
    assert got == {k: v for k, v in want.items() if v}


def test_planted_garbling_is_undone(spark):
    rng = random.Random(3)
    words = ["नदी", "दिवा", "घर", "गुरु", "ātman", "“naïve”", "— Rao", "café", "ಮನೆ"]
    good = {f"g{i}": " ".join(rng.choice(words) for _ in range(30)) for i in range(60)}
    rows, want = [], {}
    for i, (k, t) in enumerate(good.items()):
        chain = ["latin-1", "cp1252", None][i % 3]
        try:
            bad = t.encode().decode(chain) if chain else t
        except UnicodeDecodeError:
            chain, bad = "latin-1", t.encode().decode("latin-1")
        rows.append((k, "v" if chain else "w", bad))
        if chain:
            want[k] = t
    fixed = {r.id: r.text for r in p2.Garbled(spark.createDataFrame(rows, "id string, work string, text string"), "id", "work", "text").repaired().collect()}
    assert set(fixed) == set(want) and sum(fixed[k] == want[k] for k in want) >= 0.95 * len(want)


@pytest.mark.parametrize("a, b", [("आज", "अाज"), ("ओवी", "अोवी"), ("औषध", "अौषध"), ("ऐक", "एेक"), ("આજ", "અાજ")])
def test_vowels_drawn_with_signs_look_the_same(spark, a, b):
    form = lambda t: p3.normalised(spark, t)
    assert form(a) == form(b) != form(a[1:])


def test_features_of_long_words_are_those_of_short_ones():
    for w in ("x" * 60, "ประตูบานใหญ่ที่ปากทางเข้าวัด", "village" * 9):
        low = f"<{w.lower()}>"
        assert p4.word_features(w) == [p4._hash(f"{n}{low[i : i + n]}") for n in (1, 2, 3, 4) for i in range(len(low) - n + 1)] + [p4._hash(low)] * 3


def test_hot_windows_meet_in_parts(spark, monkeypatch):
    from pothi.llm import p06_shared_spans as p6

    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(f"k{i:02d}", f"w{i % 7}", "".join(rng.choice("stuv ") for _ in range(50)) + passage + str(i)) for i in range(40)]
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] != b[1]}
    for part in (500, 3):
        monkeypatch.setattr(p6, "PART", part)
        s = SharedSpans(spark.createDataFrame(rows, "id string, w string, t string"), "id", "w", "t", hot=5)
        assert {(r.id_a, r.id_b) for r in s.pairs.collect()} == want


@pytest.mark.parametrize("hot, each, buckets", [(2000, 1 << 20, 1 << 17), (3, 50, 64), (1, 20, 4)])
def test_near_duplicates_in_blocks_and_parts_equal_brute_force(spark, hot, each, buckets):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base, rows = [[rng.choice(words) for _ in range(40)] for _ in range(6)], []
    for i in range(120):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(0, 14)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((f"k{i:03d}", " ".join(t[: rng.choice([3, 5, 9, 40, 40, 40])])))
    sets = {k: set(zip(*(t.split()[i:] for i in range(3)))) for k, t in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] | sets[b] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    n = NearDuplicates(spark.createDataFrame(rows, "k string, t string"), "k", "t", 3, 0.5, buckets=buckets, hot=hot, each=each)
    got = [(r.key_a, r.key_b) for r in n.pairs().collect()]
    assert set(got) == want and len(got) == len(want)


def test_containers_are_filled(spark):
    rng = random.Random(9)
    sizes = [rng.randrange(20, 700) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "key long, n_tokens int")
    got = p8.packed(items, spark.createDataFrame([(1, 2048)], "size_id int, capacity int"))
    n = got.select("container").distinct().count()
    assert n <= 1.02 * sum(sizes) / 2048 + 1


def test_most_cut_texts_are_told_by_their_trigram(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = {r.reason: r.n for r in truncation(docs, "doc_id", "text", "source").where("is_cut").groupBy("reason").agg(F.count("*").alias("n")).collect()}
    assert told["trigram"] > 0.5 * sum(told.values())


def test_places_on_lines_of_their_own_are_whole(spark):
    rng = random.Random(4)
    subj, verb, obj = ["The cook", "My aunt", "A pilgrim"], ["sought the", "kept the", "sang the"], ["copper lamp", "old bell", "river song"]
    said = lambda: f"{rng.choice(subj)} {rng.choice(verb)} {rng.choice(obj)}."
    docs = [(i, " ".join(said() for _ in range(4)) + f" It rained in {['Umptal', 'Harhalli'][i % 2]} then.", "s") for i in range(200)]
    docs += [(1000, said() + "\nUmptal", "s"), (1001, said() + "\nThe", "s"), (1002, said() + "\nYours in remembrance", "s"), (1003, said() + "\n\nYours in remembrance", "t"), (1004, said() + "\nMy au", "s")]
    found = truncation(spark.createDataFrame(docs, "i long, t string, src string"), "i", "t", "src")
    cut = {r.key for r in found.where("is_cut").collect()}
    assert {1001, 1004} <= cut and not cut & {1000, 1002, 1003}

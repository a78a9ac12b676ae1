import random

from pyspark.sql import functions as F

from pothi.operators import citations as ci
from pothi.operators import corpus as co
from pothi.operators import logs as lo
from pothi.operators import matching as ma
from pothi.operators import reader as rd
from pothi.sources.tables import latest


def test_quality_prose_and_junk(spark):
    prose = "The old teacher spoke of the quiet path in the evening and it was as if the river had stopped for him. " * 3
    rows = [(1, prose), (2, "## Heading"), (3, "12 34 56 " * 40), (4, None), (5, "  ")]
    got = {r.id: r.quality_score for r in co.quality(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert got[1] == 1.0 and got[2] < 0.5 and got[3] < 0.2 and got[4] == 0.0 and got[5] == 0.0


def test_children_prose_verse_and_windows(spark):
    rows = [(1, "One. Two? Three!"), (2, "देव एक। देव दोन॥ "), (3, None), (4, "")]
    got = [(r.key, r.child_no, r.text, r.embed_text) for r in co.children(spark.createDataFrame(rows, "id int, text string"), "id", "text").orderBy("key", "child_no").collect()]
    assert got == [(1, 0, "One.", "One. Two?"), (1, 1, "Two?", "One. Two? Three!"), (1, 2, "Three!", "Two? Three!"), (2, 0, "देव एक।", "देव एक। देव दोन॥"), (2, 1, "देव दोन॥", "देव एक। देव दोन॥")]


def test_headings_reset_chapters(spark):
    text = "a\n## S1\n### C1\nb\n## S2\nc"
    got = [(r.line, r.section, r.chapter) for r in co.headings(spark.createDataFrame([(1, text)], "id int, t string"), "id", F.split("t", "\n")).orderBy("line_no").collect()]
    assert [g for g in got if g[0] in "abc"] == [("a", "", ""), ("b", "S1", "C1"), ("c", "S2", "")]


def test_orphans_and_carry_over(spark):
    kids = spark.createDataFrame([("a", "p"), ("b", "x"), ("c", None)], "id string, parent_id string")
    assert {r.id for r in co.orphans(kids, spark.createDataFrame([("p",)], "id string"), "parent_id", "id").collect()} == {"b", "c"}
    have, lack = co.carry_over(kids, spark.createDataFrame([("a", 1)], "id string, v int"), "id", "v")
    assert [r.id for r in have.collect()] == ["a"] and {r.id for r in lack.collect()} == {"b", "c"}


def test_latest_build_wins(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("a", 2, "new"), ("b", None, "x")], "id string, t int, v string")
    assert {(r.id, r.v) for r in latest(df, ["id"], "t").collect()} == {("a", "new"), ("b", "x")}


def _para(spark, rows):
    return spark.createDataFrame([("w", i, *r) for i, r in enumerate(rows)], "w string, n int, ch string, h boolean, len int")


def test_pages_fixed_sizes(spark):
    page = lambda rows: [r.page for r in rd.pages_fixed(_para(spark, rows), "w", "n", "ch", "h").orderBy("n").collect()]
    assert page([("A", False, 1)] * 2 + [("B", False, 1)]) == [1, 1, 2]
    assert page([("A", False, 1)] * 9) == [1] * 4 + [2] * 4 + [3]


def test_pages_density_and_entry(spark):
    got = [r.page for r in rd.pages_by_density(_para(spark, [("A", False, 200)] * 10), "w", "n", "ch", "h", "len").orderBy("n").collect()]
    assert got == [1] * 8 + [2] * 2
    heads = [("A", True, 1), ("A", True, 1), ("A", False, 1), ("A", True, 1)]
    assert [r.page for r in rd.pages_by_entry(_para(spark, heads), "w", "n", "h").orderBy("n").collect()] == [1, 1, 1, 2]


def test_verse_runs_equal_fixpoint(spark):
    rng = random.Random(1)
    rows = [(f"k{i // 12}", i % 12, rng.random() < 0.2, rng.random() < 0.15, rng.choice([50, 300])) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, n int, v boolean, h boolean, len int")
    got = {(r.k, r.n): r.in_verse for r in rd.verse_runs(df, "k", "n", "v", "h", "len").collect()}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        verse = [r[2] for r in own]
        while True:
            new = [v or (not own[i][3] and own[i][4] < 200 and any(0 <= j < len(own) and verse[j] for j in (i - 1, i + 1))) for i, v in enumerate(verse)]
            if new == verse:
                break
            verse = new
        assert [got[k, i] for i in range(len(own))] == verse


def test_paragraph_at(spark):
    paras = rd.paragraphs(spark.createDataFrame([(1, "abc\n\ndefg\n\n\nhi")], "id int, t string"), "id", "t").withColumnRenamed("key", "id")
    assert [(r.n, r.body, r.char_start, r.char_end) for r in paras.orderBy("n").collect()] == [(1, "abc", 0, 3), (2, "defg", 5, 9), (3, "hi", 12, 14)]
    asked = spark.createDataFrame([(1, o) for o in (0, 2, 4, 6, 10, 13, 99)], "id int, o int")
    assert {r.o: r.n for r in rd.paragraph_at(asked, paras, "id", "o").collect()} == {0: 1, 2: 1, 4: 2, 6: 2, 10: 3, 13: 3, 99: 3}


def test_story_match_buckets(spark):
    stories = spark.createDataFrame([("s1", "m", ["a", "b"], ["x"], ["old lamp", "red door"]), ("s2", "m", ["c"], [], [])], "story_id string, about_member string, key_people array<string>, locations array<string>, fingerprint_phrases array<string>")
    cands = spark.createDataFrame([("k1", "m", "the old lamp by the red door", ["a", "b"], ["x"]), ("k2", "m", "nothing", None, None), ("k3", None, "old lamp", [], [])], "key string, about_member string, raw_text string, key_people array<string>, locations array<string>")
    got = {(r.key, r.bucket, r.story_id) for r in ma.story_match(cands, stories).collect()}
    assert got == {("k1", "HIGH", "s1"), ("k2", "MEDIUM", "s1"), ("k2", "MEDIUM", "s2"), ("k3", "LOW", None)}


def test_splice_and_replace(spark):
    df = spark.createDataFrame([("One two three. Four.", "two", "Four"), ("One two three. Four.", "two", "nine"), ("One", "x", "y"), ("a.a", "", None), (None, "a", "b")], "t string, s string, e string")
    assert [r.x for r in df.select(ci.splice(F.col("t"), F.col("s"), F.col("e")).alias("x")).collect()] == ["two three. Four", "two three.", None, None, None]
    assert df.select(ci.replace_first(F.col("t"), F.lit("o"), F.lit("0")).alias("x")).first().x == "One tw0 three. Four."


def test_clean_body_keeps_joiners(spark):
    df = spark.createDataFrame([("a�b​c﻿d‍e\x07\n",)], "t string")
    assert df.select(ci.clean_body(F.col("t")).alias("x")).first().x == "a bcd‍e\n"


def test_daily_cap_counts_over_hours(spark):
    rows = [(f"2026-01-0{1 + i // 30}T{(i % 30) % 24:02d}:00:0{i % 7}Z", i) for i in range(60)]
    df = spark.createDataFrame(rows, "ts string, id int").withColumn("at", lo.log_time(F.col("ts")))
    got = lo.daily_cap(df, "at", "id", 10)
    by_day = {r.d: r.n for r in got.groupBy(F.to_date("at").alias("d")).agg(F.count_if("admitted").alias("n")).collect()}
    assert set(by_day.values()) == {10}
    first = sorted(rows[:30])[:10]
    assert {r.id for r in got.where("admitted").collect()} >= {i for _, i in first}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id int, text string")
    assert co.quality(empty).count() == co.children(empty, "id", "text").count() == rd.paragraphs(empty, "id", "text").count() == 0


def test_story_match_reads_places_and_phrases_of_tellings(spark, tmp_path):
    from pothi.plans.queries import QUERIES

    meta = [("s1", "m", ["a", "b"], ["x"], "no such line", [("old lamp. red door.",)]), ("s2", "m", ["a", "b"], ["y"], None, None)]
    cand = [("f", 1, "m", "old lamp. red door.", ["a", "b"], ["x"], ["old lamp.", "red door."]), ("f", 2, "m", "the old lamp. and a red door.", ["a", "b"], ["x"], []), ("f", 3, "n", "none", None, None, None)]
    spark.createDataFrame(meta, "story_id string, about_member string, key_people array<string>, locations array<string>, one_line string, variants array<struct<text string>>").write.parquet(f"{tmp_path}/meta.parquet")
    spark.createDataFrame(cand, "file string, idx int, about_member string, raw_text string, key_people array<string>, locations array<string>, fingerprint_phrases array<string>").write.parquet(f"{tmp_path}/candidate.parquet")
    got = {(r.key, r.bucket, r.story_id) for r in QUERIES["G05_story_match"](spark, str(tmp_path)).collect()}
    assert got == {("f#1", "HIGH", "s1"), ("f#2", "HIGH", "s1"), ("f#3", "LOW", None)}


def test_cross_match_equals_brute_force(spark, tmp_path):
    from pothi.plans.queries import QUERIES

    rng = random.Random(3)
    words = ["lamp", "Bell", "river", "घर", "दिवा", "x1", "tank"]
    rows = [("f", i, rng.choice(["m", "n", None]), rng.choice([["p1"], ["p2", "p3"], [f"q{i}"], [], None]), rng.choice([None, "", ", ".join(rng.choices(words, k=rng.randrange(1, 6)))])) for i in range(60)]
    spark.createDataFrame([(f, i, m, "", [], [], p, o) for f, i, m, p, o in rows], "file string, idx int, about_member string, raw_text string, key_people array<string>, locations array<string>, fingerprint_phrases array<string>, one_line string").write.parquet(f"{tmp_path}/candidate.parquet")
    want = set()
    for x in rows:
        for y in rows:
            a, b = f"f#{x[1]}", f"f#{y[1]}"
            if a < b and x[2] and x[2] == y[2]:
                both = len(set(x[3] or []) & set(y[3] or []))
                u, v = (set((z[4] or "").lower().replace(",", "").split()) for z in (x, y))
                if both or u and v and 2 * len(u & v) >= len(u | v):
                    want.add((a, b, both))
    got = [(r.key_a, r.key_b, r.shared) for r in QUERIES["G06_cross_match"](spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want) and any(n == 0 for *_, n in want)

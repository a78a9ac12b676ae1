from pyspark.sql import functions as F

from pothi.operators import chunking as ch
from pothi.sources import trees


def test_text_tree_and_front_matter(spark, tmp_path):
    for work, text in (("lamp", "---\ntitle: A\n---\nBody\n"), ("old.bak", "x"), ("bell", "No front")):
        p = tmp_path / "rao" / "books" / work / "mr"
        p.mkdir(parents=True)
        (p / "text.md").write_text(text)
    got = {(r.author, r.kind, r.work_id, r.lang, r.front, r.body.strip()) for r in trees.text_tree(spark, str(tmp_path)).collect()}
    assert got == {("rao", "books", "lamp", "mr", "title: A", "Body"), ("rao", "books", "bell", "mr", "", "No front")}


def test_json_lines_keeps_bad_lines_apart(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\nnot json\n\n{"id": 2}\n')
    good, bad = trees.json_lines(spark, str(tmp_path / "a.jsonl"), "id INT")
    assert {r.id for r in good.collect()} == {1, 2} and bad.count() >= 1


def test_first_filled(spark):
    df = spark.createDataFrame([("", " ", "c"), (None, "b", "c"), (None, None, None)], "a string, b string, c string")
    assert [r.x for r in df.select(trees.first_filled("a", "b", "c").alias("x")).collect()] == ["c", "b", None]


def test_pack_keeps_all_text_and_size(spark):
    paras = [f"p{i} " + "word " * 90 for i in range(12)]
    out = ch.pack("\n\n".join(paras))
    assert all(any(p.strip() in o for o in out) for p in paras) and max(map(len, out)) <= 2000 + 200 + 470
    long = "Sentence one is here. " * 300
    assert all(len(o) <= 2100 for o in ch.pack(long)) and ch.pack("  ") == []
    df = spark.createDataFrame([(1, "\n\n".join(paras)), (2, None), (3, "")], "id int, t string")
    assert {r.key for r in ch.parents(df, "id", "t").collect()} == {1}


def test_segments(spark):
    a, b = "x" * 250, "y" * 260
    df = spark.createDataFrame([(1, f"{a}\n* * *\n{b}\n***\nshort"), (2, a), (3, f"1. {a}\n2. {b}\n3. {a}"), (4, None)], "id int, t string")
    assert {(r.key, r.seg_no) for r in ch.segments(df, "id", "t").collect()} == {(1, 1), (1, 2), (2, 1), (3, 1), (3, 2), (3, 3)}


def test_lines_by_gap(spark):
    df = spark.createDataFrame([(1, i, y) for i, y in enumerate([10.0, 11.0, 30.0, 30.5, 50.0])], "p int, at int, y double")
    assert [r.line_no for r in ch.lines_by_gap(df, "p", "at", "y", 5).orderBy("at").collect()] == [0, 0, 1, 1, 2]

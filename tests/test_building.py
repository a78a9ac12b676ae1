import random
import re

import pytest
from pyspark.sql import functions as F

from pothi import hooks, sinks
from pothi.operators import chunking as ch
from pothi.operators import citations as ci
from pothi.operators import matching as ma
from pothi.operators import reader as rd
from pothi.operators import retrieval as re_
from pothi.plans import lineage


def test_packed_offsets_overlap_and_long_paragraphs():
    paras = ["a" * 900, "b" * 900, "c" * 150, "d" * 900]
    out = ch.packed("\n\n".join(paras))
    assert [o[0] for o in out] == ["\n\n".join(paras[:3]), "c" * 150 + "\n\n" + "d" * 900]
    assert [o[1:] for o in out] == [(0, 1954), (1956, 1956 + 1052)]
    long = "One sentence here. " * 200
    mixed = ch.packed("e" * 50 + "\n\n" + long.strip() + "\n\n" + "f" * 50)
    assert mixed[0][0] == "e" * 50 and mixed[-1][0] == "f" * 50 and all(len(t) <= 2000 for t, _, _ in mixed)
    assert [b - a for t, a, b in mixed] == [len(t) for t, _, _ in mixed] and ch.packed(" \n\n ") == []


def test_emitted_parents_and_children(spark):
    text = "## S\n### C\n\nFirst sentence. Second one!\n\nओवी ॥\nअर्थ - हे."
    df = spark.createDataFrame([("w", text), ("n", None), ("e", "")], "id string, t string")
    rows = ch.emitted(df, "id", "t").orderBy("id").collect()
    parent = [r for r in rows if r.kind_level == "parent"]
    assert [(r.id, r.section, r.chapter) for r in parent] == [("w--0000", "S", "C")] and not parent[0].text.startswith("#")
    assert all(r.cite_text == r.text and r.parent_id == "w--0000" for r in rows if r.kind_level == "child")
    entries = [r for r in ch.emitted(df, "id", "t", verse_and_meaning=True).collect() if r.kind_level == "child"]
    assert {r.cite_text for r in entries} == {None, "ओवी ॥"}


def test_headings_of_pieces_reset_chapters(spark):
    text = "## A\n### B\nx\n## C\ny"
    df = spark.createDataFrame([("k", text)], "key string, text string")
    index = ch.heading_index(df, "key", "text")
    assert [(r.char_start, r.level, r.title) for r in index.orderBy("char_start").collect()] == [(0, 2, "A"), (5, 3, "B"), (13, 2, "C")]
    ends = spark.createDataFrame([("k", 1, 6), ("k", 2, 14), ("k", 0, 1)], "key string, no int, char_end int")
    assert {r.no: (r.section, r.chapter) for r in ch.headings_of(ends, index).collect()} == {0: ("A", ""), 1: ("A", "B"), 2: ("C", "")}


def test_parsed_work(spark):
    long = "A paragraph that is long enough to stay, with *words* in it and a good many more of them here."
    text = f"---\ntitle: x\n---\n## One\n\n{long}\n\nshort\n\n**Bold name**\n\n#### I.\n\n{long}"
    df = spark.createDataFrame([("w", text), ("n", None), ("e", "")], "id string, t string")
    rows = rd.parsed(df, "id", "t").orderBy("n").collect()
    assert [(r.n, r.chapter, r.is_subheading) for r in rows] == [(1, "One", False), (2, "Bold name", True), (3, "Bold name", False)]
    assert rows[0].body == long.replace("*", "") and text[rows[0].char_start : rows[0].char_end] == long
    verse = rd.parsed(spark.createDataFrame([("v", "ओवी एक ॥१॥ ओवी दोन ॥२॥\n\n* * *\n\nलहान")], "id string, t string"), "id", "t", verse=True).orderBy("n").collect()
    assert [(r.body, r.is_verse) for r in verse] == [("ओवी एक ॥१॥\nओवी दोन ॥२॥", True), ("लहान", True)]


def test_pages_of_quotes_equal_brute_force(spark):
    rng = random.Random(6)
    words = ["lamp", "river", "बेल", "old", "singing", "door"]
    paras = [("w", n, " ".join(rng.choice(words) for _ in range(30))) for n in range(1, 9)] + [("w", 9, "x" * 80), ("v", 1, None)]
    quotes = [(i, "w", p[2][rng.randrange(0, 40) :][:120]) for i, p in enumerate(paras[:9])] + [(20, "w", "nothing of the kind here at all"), (21, "w", ""), (22, "v", "lamp river old door"), (23, "w", "zz " + paras[3][2])]
    got = {r.q: r.n for r in rd.pages_of_quotes(spark.createDataFrame(quotes, "q int, w string, b string"), spark.createDataFrame(paras, "w string, n int, body string"), "q", "w", "b").collect()}
    want = {}
    for q, w, b in quotes:
        for a in rd.STARTS:
            for k in rd.WIDTHS:
                key = re.sub(r"\s+", " ", b).strip()[a : a + k]
                hit = next((n for w2, n, t in paras if w2 == w and t and len(key) >= 12 and key in t), None)
                if hit and q not in want:
                    want[q] = hit
    assert got == want


def test_with_splice(spark):
    rows = [("Oṃ: the quiet, lamp. Then gone.", "the quiet lamp", "Then"), ("Bhāva is here; and more. End", "bhava is", None), ("Bhāva is here", "Bhava is", "here"), ("One two. Three", "two", "nine"), ("x", "", None), (None, "a", "b"), ("a b c", "b", "b")]
    got = [r.s for r in ci.with_splice(spark.createDataFrame(rows, "t string, a string, e string"), "s", F.col("t"), F.col("a"), F.col("e")).collect()]
    assert got == ["the quiet, lamp. Then", None, "Bhāva is here", "two.", None, None, "b"]


def test_spliced_citations(spark):
    q = [(1, "A", "one", "two", "model", "athvani"), (2, "Z", "one", None, "own", None), (3, None, None, None, "free", "x"), (4, "B", "one", None, "leak", None), (5, "C", "verse", None, None, None), (6, "A", "absent", None, None, None)]
    quotes = spark.createDataFrame([(k, 9, p, s, e, b, None, None, kind, None) for k, p, s, e, b, kind in q], "quote_id int, answer int, passage string, quote_start string, quote_end string, body string, work_title string, author string, kind string, location string").withColumn("work_id", F.lit("q"))
    ps = [(9, "A", "Now one and two. More.", None, "Title", "rao", "canonical", "w", "S", "C", False, False), (9, "B", "one secret", None, "T", "x", "athvani", "w", None, None, False, True), (9, "C", "verse meaning", "verse", "T", "x", "canonical", "w", None, None, True, False)]
    passages = spark.createDataFrame(ps, "answer int, passage string, text string, cite_text string, title string, author string, kind string, work_id string, section string, chapter string, restricted boolean, retrieval_only boolean")
    got = {r.quote_id: (r.body, r.author, r.kind, r.location, r.clean, r.kept) for r in ci.spliced(quotes, passages, "quote_id", ["answer"]).collect()}
    assert got == {
        1: ("one and two", "rao", "canonical", "S · C", True, True), 2: ("own", "", "canonical", "", False, True), 3: ("free", "", "canonical", "", True, True),
        4: ("", "", "canonical", "", False, False), 5: ("verse", "", "canonical", "", True, True), 6: ("Now one and two. More.", "rao", "canonical", "S · C", False, True),
    }


def test_check_of_quotations_equals_brute_force(spark):
    rng = random.Random(8)
    src = [(f"w{i % 3}", " ".join(rng.choice("abcdefg") * rng.randrange(1, 4) for _ in range(40))) for i in range(9)] + [("w9", None)]
    qs = [(i, s[0], re.sub(" ", "  ", s[1][5:30]) if i % 2 else s[1][5:30] + "Z") for i, s in enumerate(src[:9])] + [(20, "w0", " "), (21, "none", "a b c"), (22, "w9", "a b"), (23, "w1", "aa")]
    got = {r.q: r.status for r in ci.check(spark.createDataFrame(qs, "q int, w string, b string"), spark.createDataFrame(src, "w string, t string"), "q", "w", "b", "t").collect()}
    norm = lambda t: re.sub(r"\s+", " ", t).strip()
    for q, w, b in qs:
        own = [norm(t) for w2, t in src if w2 == w and t]
        assert got[q] == ("no body" if not b.strip() else "no source" if not own else "verbatim" if any(norm(b) in t for t in own) else "changed")


def test_density_pages_by_chapter(spark):
    rows = [("w", i, ch_, False, 400) for i, ch_ in enumerate("AAAAAABBBA")]
    got = {r.n: r.page for r in rd.pages_by_density(spark.createDataFrame(rows, "w string, n int, c string, h boolean, len int"), "w", "n", "c", "h", "len").collect()}
    assert [got[i] for i in range(10)] == [1, 1, 1, 1, 2, 2, 3, 3, 3, 4]


def test_bm25_counts_repeated_rows_once_on_both_sides(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["lamp", "bell", "river", "self-made", "भुवनातील"]) for _ in range(12))) for i in range(20)]
    q = spark.createDataFrame([(1, "lamp भुवन river"), (2, None)], "q int, t string")
    score = lambda rows, n: {(r.q, r.id): r.score for r in re_.bm25(spark.createDataFrame(rows, "id int, text string"), "id", "text", q, "q", "t", most_terms=n).collect()}
    assert score(docs, 1000) == score(docs + docs[:7], 1000) == score(docs + docs[3:5], 0) != {}


def test_ties_name_members_once(spark):
    stories = spark.createDataFrame([(f"s{i}", "m", [], [], []) for i in range(5)] + [("t", "n", ["a", "b"], ["x"], [])], "story_id string, about_member string, key_people array<string>, locations array<string>, fingerprint_phrases array<string>")
    cands = spark.createDataFrame([("k1", "m", "t", ["a", "b"], ["x"]), ("k2", "q", "t", None, None)], "key string, about_member string, raw_text string, key_people array<string>, locations array<string>")
    ties = {(r.key, r.bucket, r.score, r.story_id, r.all_of) for r in ma.story_ties(cands, stories).collect()}
    assert ties == {("k1", "MEDIUM", 2, None, "m"), ("k1", "MEDIUM", 2, "t", None), ("k2", "LOW", 0, None, None)}
    assert {r.story_id for r in ma.story_match(cands, stories).where("key = 'k1'").collect()} == {"t", *[f"s{i}" for i in range(5)]}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", 1, "x"), ("c", 2, "y"), ("c", 3, None)], "k string, v int, text string")
    sinks.write_routed(df, "k", {"p": f"{tmp_path}/p", "c": f"{tmp_path}/c"})
    assert spark.read.parquet(f"{tmp_path}/c").count() == 2
    with pytest.raises(ValueError):
        sinks.write_routed(df, "k", {"p": f"{tmp_path}/p"})
    sinks.write_version(df, f"{tmp_path}/v", "a")
    with pytest.raises(Exception):
        sinks.write_version(df, f"{tmp_path}/v", "a")
    sinks.append(df, f"{tmp_path}/q")
    sinks.append(df, f"{tmp_path}/q")
    sinks.rewrite(spark, f"{tmp_path}/q", df.withColumn("v", F.lit(9)), ["k"], "v", f"{tmp_path}/q2")
    assert {(r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/q2").collect()} == {("p", 9), ("c", 9)}
    assert sinks.rendered(df, "k", "text", "v") == "## c (2)\n- -: 3\n- y: 2\n\n## p (1)\n- x: 1\n"


def test_hooks_fail_open(spark):
    assert hooks.rewritten("q", None) is None and hooks.rewritten("q", lambda q: 1 / 0) is None and hooks.rewritten("q", lambda q: " q ") is None and hooks.rewritten("q", str.upper) == "Q"
    assert hooks.translated("lamp", lambda q: "दिवा", True) == "दिवा" and hooks.translated("lamp", lambda q: "lamps", True) is None and hooks.translated("दिवा", lambda q: "lamp", True) is None
    assert hooks.intent_of("unknown", "q", lambda q: "narrative") == "narrative" and hooks.intent_of("unknown", "q", lambda q: "x") == "unknown" and hooks.intent_of("doctrinal", "q", None) == "doctrinal"
    old, new = {"citations": []}, {"citations": [1]}
    assert hooks.regenerated(old, True, lambda: new) == new and hooks.regenerated(old, True, lambda: {}) == old and hooks.regenerated(old, True, lambda: new, True) == old
    df = spark.createDataFrame([(1, i, "q", "x" * i, i) for i in range(1, 5)], "q int, k int, question string, text string, r int")
    order = lambda scorer: [r.k for r in hooks.reranked(df, "q", "k", "question", "text", "r", scorer, 3).orderBy("rank").collect()]
    assert order(lambda ps: [len(t) for _, t in ps]) == [4, 3, 2] and order(None) == [1, 2, 3] and order(lambda ps: [1.0]) == [1, 2, 3]
    assert hooks.Settings().per_source("qa", False) == 2 and hooks.Settings().per_source("reading", True) == 5


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        lineage.shared_folder(Session())


def test_cosine_blocks_rounds_and_bests_agree(spark):
    rng = random.Random(7)
    vecs = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(60)] + [(99, None)]
    v = spark.createDataFrame(vecs, "k long, e array<double>").repartition(3)
    q = v.where("k < 12").selectExpr("k AS q", "e AS qe")
    whole = {(r.q, r.k, r.score) for r in re_.cosine_scores(v, "k", "e", q, "q", "qe").collect()}
    assert len(whole) == 12 * 60
    assert {(r.q, r.k, r.score) for r in re_.cosine_scores(v, "k", "e", q, "q", "qe", block=5, most=4).collect()} == whole
    top = lambda df: {(r.q, r.k, r.rank) for r in re_.top(df, "q", "score", "k", 5).collect()}
    assert top(re_.cosine_scores(v, "k", "e", q, "q", "qe", best=5)) == top(re_.cosine_scores(v, "k", "e", q, "q", "qe"))


def test_scanned_words_have_boxes(spark, tmp_path):
    from pothi.sources import trees

    word = '<WORD coords="1,2,3,4">lamp</WORD>'
    (tmp_path / "a.xml").write_text(f"<DOC><OBJECT><HIDDENTEXT><PAGECOLUMN><REGION><PARAGRAPH><LINE>{word}{word}</LINE></PARAGRAPH></REGION></PAGECOLUMN></HIDDENTEXT></OBJECT></DOC>")
    got = trees.scanned_words(spark, str(tmp_path / "a.xml")).collect()
    assert [(r.at, r.word, r.x0, r.y1) for r in got] == [(0, "lamp", 1.0, 4.0), (1, "lamp", 1.0, 4.0)]


def test_volumes_are_cleaned(spark):
    from pothi.operators.volumes import clean_volumes, cleaned

    text = "पुष्प १\n\nOne goes  \n\n१२\n\non here.\n\n\n\nTwo ends.\n13\nThree ॥\n14\nfour\n____\n\n15\nपुष्प २\n\n_____\n\nसंपर्क: x\ny"
    out, n = cleaned(text)
    assert out == "पुष्प १\n\nOne goes on here.\n\nTwo ends.\nThree ॥\nfour"
    assert n == {"input_lines": 24, "output_lines": 7, "page_nums_stripped": 4, "paragraphs_rejoined": 1, "backmatter_lines_dropped": 6, "separator_lines_dropped": 2, "trailing_ws_stripped": 1, "blank_runs_collapsed": 2}
    assert cleaned("") == ("", dict.fromkeys(n, 0))
    df = spark.createDataFrame([("a", text), ("b", None)], "id string, t string")
    assert [(r.key, r.page_nums_stripped) for r in clean_volumes(df, "id", "t").collect()] == [("a", 4)]


def test_phrase_hits_equal_brute_force(spark):
    rng = random.Random(11)
    words = ["lamp", "old", "a", "दिवा", "the", "river"]
    texts = [(f"k{i}", " ".join(rng.choice(words) for _ in range(12))) for i in range(20)] + [("n", None)]
    phrases = [(f"s{i}", [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4]))) for _ in range(3)] + ["", "a"]) for i in range(12)] + [("t", None)]
    got = {(r.key, r.story_id): r.hits for r in ma.phrase_hits(spark.createDataFrame(texts, "key string, raw_text string"), spark.createDataFrame(phrases, "story_id string, fingerprint_phrases array<string>")).collect()}
    want = {(k, s): sum(p in t for p in set(ps) if p) for k, t in texts if t for s, ps in phrases if ps}
    assert got == {k: n for k, n in want.items() if n}

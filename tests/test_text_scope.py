import random
import re

import pytest
from pyspark.sql import functions as F

from pothi.functions import text as tx
from pothi.operators import ingest as ig
from pothi.operators import scope as sc


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "fn, given, want",
    [
        (tx.quoted_spans, 'a "b c" “d  e” \'f\' "x"', ["b c", "d e"]),
        (tx.quoted_spans, None, None),
        (tx.intent, "Explain the philosophy of this verse", "doctrinal"),
        (tx.intent, "a story", "narrative"),
        (tx.intent, "list the story", "unknown"),
        (tx.intent, None, "unknown"),
        (tx.folded, "Bhāgavadgītā é ñ भु", "Bhagavadgita e n भु"),
        (tx.without_leaks, "as chunk 3 and 4, says (chunk 2), this", "as, says, this"),
        (tx.without_leaks, "chunks of bread", "chunks of bread"),
        (tx.without_headings, "## A\n### B\n\nbody\n## C", "body\n## C"),
        (tx.without_emphasis, "**a** *b* `c`", "a b c"),
        (tx.is_ornament, "* * *", True),
        (tx.is_ornament, "॥ गुरु ॥", False),
        (tx.is_verse, "एक। दोन। तीन।", True),
        (tx.is_verse, "एक. दोन.", False),
        (tx.verse_lines, "अ ॥१॥ आ ॥२॥", "अ ॥१॥\nआ ॥२॥"),
        (tx.whole_number, "१२3", 123),
        (tx.whole_number, "12a", None),
        (tx.slug, "The Old Lamp of 1920", "the-old-lamp-of"),
        (tx.slug, "गुरु वाणी!", "गुरु-वाणी"),
        (tx.slug, None, "untitled-story"),
        (tx.kebab, "Ā lamp, lit", "lamp-lit"),
        (tx.kebab, None, "story"),
        (tx.shown_name, "suran_gere-x", "Suran Gere-X"),
        (tx.plain_text, "<p>a<br/>b &amp;lt; c </p>", "a\nb < c"),
        (tx.clean_page, "12\nbro-\nken \n\n\n\nx\n७\n", "broken\n\nx"),
    ],
)
def test_scalar_functions(spark, fn, given, want):
    assert one(spark, given, fn) == want


def test_shortened_and_counted_replacement(spark):
    assert one(spark, "a  b c", lambda c: tx.shortened(c, 4)) == "a b…" and one(spark, None, tx.shortened) == ""
    assert one(spark, "x y x", lambda c: tx.replaced_if(c, "x", "z", 2)) == "z y z" and one(spark, "x y", lambda c: tx.replaced_if(c, "x", "z", 2)) == "x y"


def test_verse_and_meaning(spark):
    cut = lambda t: spark.createDataFrame([(t,)], "t string").select(*[c.alias(n) for n, c in zip("vm", tx.verse_and_meaning(F.col("t")))]).first()
    assert tuple(cut("ओवी ॥\nअर्थ - हे असे.")) == ("ओवी ॥", "अर्थ - हे असे.")
    assert tuple(cut("ओवी (the lamp) पुढे")) == ("ओवी", "(the lamp) पुढे")
    assert tuple(cut("अर्थात हे")) == ("अर्थात हे", None) and tuple(cut(None)) == ("", None)


def test_fingerprints_take_telling_sentences_once_a_beginning(spark):
    a, b = "A pilgrim from Harhalli kept the copper lamp for him.", "A pilgrim from Harhalli kept the old bell for me too."
    text = f"{a} {b} short. " + "त्या दिवशी सर्व मंडळी देवळात जमली होती आणि भजन झाले."
    got = one(spark, text, tx.fingerprints)
    assert a in got and b not in got and len(got) == 2 and one(spark, None, tx.fingerprints) is None


WORKS = [("w1", "Amar Sandesh", None), ("w2", "Bhāgavad Gītā as Realisation", "x"), ("w3", "Rivers", None), ("w4", None, "  "), ("w5", "amar sandesh", "Amar Sandesh")]


def test_mentioned_work(spark):
    works = spark.createDataFrame(WORKS, "work_id string, title string, title_en string")
    titles = sc.titles(works, "work_id", ["title", "title_en"])
    assert titles.count() == 4
    qs = spark.createDataFrame([("a", 'what is "bhagavadgita realization"?'), ("b", "the bhagavad gita as realisation says"), ("c", "amar sandesh"), ("d", "rivers"), ("e", None), ("f", 'in "Rivers" only')], "q string, t string")
    got = {r.q: (r.work_id, r.method, r.n) for r in sc.mentioned_work(qs, "q", "t", titles).collect()}
    assert got == {"a": ("w2", "quoted", 1), "b": ("w2", "substring", 1), "c": (None, "ambiguous", 2), "d": (None, "none", 0), "e": (None, "none", 0), "f": ("w3", "quoted", 1)}
    assert {r.q: r.method for r in sc.mentioned_work(qs, "q", "t", titles, most_titles=0).collect()} == {k: v[1] for k, v in got.items()}


def test_tagged_equals_substring_search(spark):
    rng = random.Random(4)
    terms = [("people", "p1", "Rao"), ("people", "p2", "ab"), ("places", "l1", "umpgere"), ("places", "l1", "पूर"), ("people", "p3", "")]
    texts = [(f"k{i}", "".join(rng.choice(["Rao ", "ab", "Umpgere", "नंदपूर", " x "]) for _ in range(4))) for i in range(30)] + [("n", None), ("e", "")]
    got = {tuple(r) for r in ig.tagged(spark.createDataFrame(texts, "k string, t string"), "k", "t", spark.createDataFrame(terms, "kind string, id string, term string")).collect()}
    assert got == {(k, kind, i) for k, t in texts if t for kind, i, term in terms if term and term.lower() in t.lower()}


def test_merging_is_idempotent_and_the_index_keeps_its_seed(spark):
    have = spark.createDataFrame([("s1", ["b"], ["f1"], ["x"]), ("s2", None, None, None)], "story_id string, key_people array<string>, files array<string>, locations array<string>")
    new = spark.createDataFrame([("s1", "f1", ["a"], ["y"]), ("s1", "f2", ["b", None], ["y"]), ("s3", "f9", None, None), ("s3", "f8", ["z"], ["q"])], "story_id string, file string, key_people array<string>, locations array<string>")
    got = {r.story_id: (r.people, sorted(r.files)) for r in ig.merged(have.drop("locations"), new.unionByName(new)).collect()}
    assert got == {"s1": (["a", "b"], ["f1", "f2"]), "s2": ([], []), "s3": (["z"], ["f8", "f9"])}
    index = {r.story_id: (r.key_people, sorted(r.files)) for r in ig.indexed(have, new).collect()}
    assert index == {"s1": (["b"], ["f1", "f2"]), "s2": (None, []), "s3": (["z"], ["f8", "f9"])}


def test_one_line(spark):
    df = spark.createDataFrame([("x" * 40 + "\n\nrest", "short"), ("tiny", None), ("t", "a heading of some length")], "t string, h string")
    assert [r.x for r in df.select(ig.one_line(F.col("t"), F.col("h")).alias("x")).collect()] == ["x" * 40, "tiny", "a heading of some length"]


def test_folding_keeps_length():
    a, b = tx.foldings()
    assert len(a) == len(b) and re.fullmatch("[A-Za-z]+", b)

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pothi.llm import p01_sentences as p1
from pothi.llm import p02_encoding as p2
from pothi.llm import p03_lookalikes as p3
from pothi.llm import p04_language as p4
from pothi.llm import p08_packing as p8
from pothi.llm.components import components
from pothi.llm.p05_scans import Scans
from pothi.llm.p06_shared_spans import SharedSpans, anchors, coverage
from pothi.llm.p07_near_duplicates import NearDuplicates
from pothi.llm.p09_leaks import common_words, leaks, near_leaks
from pothi.llm.p10_truncation import rates, truncation


def units(text):
    ends = p1.unit_ends(text)
    return [text[a:b].strip() for a, b in zip([0, *ends], ends)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Dr. V. P. Rao left at 8.45 a.m. He came back.", ["Dr. V. P. Rao left at 8.45 a.m.", "He came back."]),
        ("He said, “It is late. Go home.” She left.", ["He said, “It is late. Go home.”", "She left."]),
        ("‘Who?’ asked the cook. He slept ... and then woke... It rained.", ["‘Who?’ asked the cook.", "He slept ... and then woke...", "It rained."]),
        ("“ऋण फार जुने होते?” असे गुरु यांनी विचारले. पुढे.", ["“ऋण फार जुने होते?” असे गुरु यांनी विचारले.", "पुढे."]),
        ("‘मन शांत है?’ गुरु ने पूछा। वह गया।", ["‘मन शांत है?’ गुरु ने पूछा।", "वह गया।"]),
        ("एक दोन।\nतीन चार॥ १२ ॥ पुढे.", ["एक दोन।\nतीन चार॥ १२ ॥", "पुढे."]),
        ("ロカンは「来た。見た。」と言った。次。", ["ロカンは「来た。見た。」と言った。", "次。"]),
        ("ಗುರುಗಳು “ಬಂದರು. ಹೋದರು.” ಎಂದರು. ಡಾ. ರಾವ್ ಬಂದರು.", ["ಗುರುಗಳು “ಬಂದರು. ಹೋದರು.” ಎಂದರು.", "ಡಾ. ರಾವ್ ಬಂದರು."]),
        ("no mark at all", ["no mark at all"]),
        ("", []),
        (None, []),
        ("  \n ", []),
    ],
)
def test_sentence_units(text, want):
    assert (units(text) if text is not None else p1.unit_ends(text)) == want


def test_long_texts_by_prefix_scan_equal_short_ones(spark):
    rng = random.Random(2)
    bits = ["He came. ", "“Go? Now!” said he. ", "एक दोन।\nतीन॥ ४ ॥\n", "‘A. B.’ Then ", "word " * 7, "‘मन है?’ गुरु ने पूछा। "]
    rows = [(f"k{i}", "".join(rng.choice(bits) for _ in range(60))) for i in range(6)] + [("n", None), ("e", "")]
    df = spark.createDataFrame(rows, "k string, t string")
    got = {}
    for r in p1.sentences(df, "k", "t", piece=90).collect():
        got.setdefault(r.key, set()).add(r.end_char)
    assert got == {k: set(p1.unit_ends(t)) for k, t in rows if t}


def test_encoding_chains_and_repair(spark):
    good = "सत्संगाचे फळ — “ātman” naïve Château"
    rows = [("a", "w", good), ("b", "w", good.encode().decode("latin-1")), ("c", "w", "ΓÇö the end"), ("d", "v", "plain"), ("e", None, None), ("f", "v", ""), ("g", "v", "lost � sign"), ("b", "w", good.encode().decode("latin-1")), ("h", "v", "The plaque “ÂME ET PÃO” мир λόγος £3 ½")]
    g = p2.Garbled(spark.createDataFrame(rows, "id string, work string, text string"), "id", "work", "text")
    assert sorted(r.id for r in g.affected().collect()) == ["b", "c", "g"]
    fixed = {r.id: r.text for r in g.repaired().collect()}
    assert fixed["b"] == good and fixed["c"] == "— the end"


def test_unwind_round_trips():
    for chain, charset in (("cp437", "cp437"), ("mac_roman", "mac_roman"), ("cp850", "cp850")):
        text = "गुरु म्हणाले, “मन”"
        assert p2.unwind(text.encode().decode(charset), chain)[0] == text
    twice = "é—".encode().decode("latin-1").encode().decode("latin-1")
    assert p2.unwind(twice, "latin-1+latin-1")[0] == "é—"


def test_look_alikes(spark):
    rows = [(1, "naïve the a"), (2, "naïve thе ａ​"), (3, "naive the a"), (4, "कर्म।"), (5, "कर्म|"), (6, "ऱ"), (7, "ऱ"), (8, None), (9, "​"), (10, ""), (11, "कार्‍य"), (12, "कार्य"), (2, "naïve thе ａ​")]
    f = p3.one_form(spark.createDataFrame(rows, "k int, t string"), "k", "t", keep=True)
    form = {r.key: r.form for r in f.collect()}
    assert form[1] == form[2] != form[3] and form[4] == form[5] and form[6] == form[7] and form[9] == form[10] == "" and form[11] != form[12]
    pairs = {(r.key_a, r.key_b) for r in p3.equal_looking(f, f).collect()}
    assert pairs == {(a, b) for a, b in itertools.permutations([1, 2], 2)} | {(4, 5), (5, 4), (6, 7), (7, 6)}


def test_marks_are_ordered_as_by_the_standard(spark):
    import unicodedata

    texts = ["ạ́", "ạ́", "ếx", "ẛ̣", "が", "ಕೊ"]
    f = p3.one_form(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t", keep=True)
    got = {r.key: r.form for r in f.collect()}
    assert [got[i] for i in range(len(texts))] == [unicodedata.normalize("NFC", t) for t in texts]


def test_languages_of_mixed_texts(spark):
    d = "/root/testdata/sf0.01/chunks.parquet"
    rows = spark.read.parquet(d)
    found = p4.languages(rows.select("id", "kind_level", "language", "text", "built_at"), per_class=300)
    segs = found.select("id", F.size(F.array_distinct(F.transform("segs", lambda s: s["language"]))).alias("n"), F.get("segs", F.lit(0))["language"].alias("first"), "named")
    agree = segs.where("n = 1 AND named IN ('en', 'mr', 'kn', 'ja')").select(F.avg((F.col("first") == F.col("named")).cast("double"))).first()[0]
    assert agree > 0.93
    assert found.count() == rows.select("id").distinct().count()


def test_label_spellings():
    assert [p4.label_language(x) for x in ("mr-IN", "मराठी", "EN_us", "mul", "", None, "xx")] == ["mr", "mr", "en", "mixed", None, None, None]


def test_scan_noise(spark):
    page = ["The quiet path of inquiry was long and the lamp of the forgive-", "12", "QUIET PATH", "ness burned all night in the old house by the tank near hill", "and thc end came.", "", "Next one stands."]
    clean = "The quiet path of inquiry was long and the lamp of forgiveness burned. and the end came. Next one stands the the the"
    rows = [(f"p{i}", f"s{i}", "parent", "\n".join([*page[:1], str(12 + i), *page[2:]]), None) for i in range(3)] + [("c", None, "child", clean, None), ("n", "s0", "parent", None, None)]
    df = spark.createDataFrame(rows, "id string, source_path string, kind_level string, text string, built_at timestamp")
    s = Scans(df, spark.createDataFrame([(f"s{i}",) for i in range(3)], "source_path string"))
    got = {(r.id, r.line_no, r.what) for r in s.found().collect()}
    for i in range(3):
        assert {(f"p{i}", 1, "hyphen"), (f"p{i}", 1, "rejoin"), (f"p{i}", 2, "pagenum"), (f"p{i}", 3, "header"), (f"p{i}", 5, "misread")} <= got
    texts = {r.text.strip() for r in s.paragraphs().where("id = 'p0'").collect()}
    assert any("forgiveness burned" in t and "the end came." in t for t in texts)
    assert {(r.page_nums_stripped, r.paragraphs_rejoined) for r in s.volumes().collect()} == {(1, 1)}


def _texts(rng, n, length):
    return ["".join(rng.choice("abcdefghij ") for _ in range(length)) for _ in range(n)]


@pytest.mark.parametrize("hot", [48, 1])
def test_shared_spans_equal_brute_force(spark, hot):
    rng = random.Random(4)
    base = _texts(rng, 5, 400)
    rows = []
    for i in range(24):
        b = rng.choice(base)
        a = rng.choice([0, 5, 130])
        n = rng.choice([100, 219, 224, 225, 226, 260])
        rows.append((f"k{i:02d}", f"w{i % 5}", _texts(rng, 1, rng.randrange(0, 150))[0] + b[a : a + n] + _texts(rng, 1, 90)[0]))
    rows += [("n", "w1", None), ("e", "w1", ""), rows[0]]
    want = set()
    for (a, wa, x), (b, wb, y) in itertools.combinations(sorted({r for r in rows if r[2]}), 2):
        if wa != wb and {x[i : i + 220] for i in range(len(x) - 219)} & {y[i : i + 220] for i in range(len(y) - 219)}:
            want.add((a, b))
    s = SharedSpans(spark.createDataFrame(rows, "id string, w string, t string"), "id", "w", "t", hot=hot)
    assert {(r.id_a, r.id_b) for r in s.pairs.collect()} == want and want
    assert {r.id for r in coverage(s.spans).collect()} == {k for p in want for k in p}


def test_anchors_of_short_and_null_texts():
    assert len(anchors(None)[0]) == len(anchors("x" * 219)[0]) == 0 and len(anchors("x" * 220)[0]) == 1


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(40)] for _ in range(6)]
    rows = []
    for i in range(60):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(0, 8)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((f"k{i:02d}", " ".join(t)))
    rows += [("null", None), ("empty", ""), ("short", "a b"), rows[0], ("copy", rows[1][1].upper() + ".")]
    sets = {k: set(zip(*(t.lower().replace(".", "").split()[i:] for i in range(3)))) for k, t in rows if t}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] | sets[b] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    n = NearDuplicates(spark.createDataFrame(rows, "k string, t string"), "k", "t", 3, 0.5)
    assert {(r.key_a, r.key_b) for r in n.pairs().collect()} == want
    groups = {r.key: r.group_id for r in n.groups().collect()}
    assert len(groups) == len({k for k, _ in rows}) and all(groups[a] == groups[b] for a, b in want)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r.cls, r.component) for r in components(links).collect()} == {(i, 0) for i in range(21)} | {(100, 100), (101, 100)}


@pytest.mark.parametrize("sizes", [[], [5], [10, 10, 3, 7, 5, 5, 1] * 9, list(range(1, 60))])
def test_packing_fits_and_keeps_all(spark, sizes):
    items = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "key long, n_tokens int")
    caps = spark.createDataFrame([(1, 16), (2, 64), (3, None), (4, 0)], "size_id int, capacity int")
    got = p8.packed(items, caps).collect()
    for size, cap in ((1, 16), (2, 64)):
        own = [r for r in got if r.size_id == size]
        per, fill = {}, {}
        for r in own:
            per.setdefault(r.key, []).append((r.first_token, r.n_tokens))
            fill[r.container] = fill.get(r.container, 0) + r.n_tokens
        assert {k: sum(n for _, n in v) for k, v in per.items()} == dict(enumerate(sizes))
        assert all(len(v) == 1 for k, v in per.items() if sizes[k] <= cap)
        assert all(f <= cap for f in fill.values()) and all(r.unused == cap - fill[r.container] for r in own)
        assert len(fill) <= 1.35 * max(1, -(-sum(sizes) // cap)) + 1


def test_least_squares_is_non_negative_and_near():
    a = p8.combinations(16, 3)
    x = np.abs(np.random.default_rng(0).normal(size=a.shape[1])).astype(np.float32)
    y = p8.non_negative_least_squares(a, a @ x, 600)
    assert (y >= 0).all() and np.abs(a @ y - a @ x).max() < 0.5


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(words) for _ in range(25)), None if i % 3 else " ".join(rng.choice(words) for _ in range(60))) for i in range(12)]
    docs = [(99, None), (98, ""), (97, "w1 w2")]
    for k in range(40):
        src = rng.choice([x for x in rng.choice(items)[1:] if x]).split()
        n = rng.choice([14, 15, 20])
        a = rng.randrange(0, max(1, len(src) - n))
        docs.append((k, " ".join(["Up", "front,"] + src[a : a + n] + ["end."])))
    runs = {}
    for i, *parts in items:
        for t in parts:
            w = (t or "").split()
            for j in range(len(w) - 14):
                runs.setdefault(tuple(w[j : j + 15]), set()).add(i)
    want = set()
    for k, t in docs:
        w = (t or "").lower().replace(",", "").replace(".", "").split()
        for j in range(len(w) - 14):
            want |= {(k, i) for i in runs.get(tuple(w[j : j + 15]), ())}
    d, it = spark.createDataFrame([*docs, docs[-1]], "id long, t string"), spark.createDataFrame(items, "i int, q string, a string")
    for most in (4_000_000, 10):
        assert {(r.id, r.item) for r in leaks(d, "id", "t", it, "i", ["q", "a"], most_runs=most).collect()} == want


def test_near_leaks_are_found_without_a_common_run(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    said = [[rng.choice(words) for _ in range(60)] for _ in range(6)]
    told = [[w if i % 9 else "other" for i, w in enumerate(t)] for t in said[:4]]
    shuffled = rng.sample(said[4], 60)
    docs = [(i, " ".join([rng.choice(words) for _ in range(50)] + t + [rng.choice(words) for _ in range(70)])) for i, t in enumerate([*told, shuffled])]
    docs += [(i, " ".join(rng.choice(words) for _ in range(150))) for i in range(10, 150)] + [(200, None), (201, ""), (202, "w1 w2"), docs[0]]
    items = [(i, " ".join(t), " ".join(said[(i + 1) % 6][:20]) if i % 2 else None) for i, t in enumerate(said)] + [(7, None, "w1"), (8, "w1 w2", None)]
    d, it = spark.createDataFrame(docs, "id long, t string"), spark.createDataFrame(items, "i int, q string, a string")
    found = near_leaks(d, "id", "t", it, "i", ["q"], "a").collect()
    assert {(r.id, r.item) for r in found} == {(i, i) for i in range(4)} and len(found) == 4
    assert all(r.common >= 0.6 * r.words for r in found) and {r.item for r in found if r.answered is None} == {0, 2}
    assert leaks(d, "id", "t", it, "i", ["q", "a"]).isEmpty()


def test_longest_common_subsequences_are_those_of_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        table_ = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table_[i + 1][j + 1] = table_[i][j] + 1 if x == y else max(table_[i][j + 1], table_[i + 1][j])
        assert common_words(a, {w: sum(1 << i for i, x in enumerate(b) if x == w) for w in b}, len(b)) == table_[-1][-1]


def test_truncation(spark):
    rng = random.Random(7)
    subj, verb, obj = ["The cook", "My aunt", "A pilgrim"], ["sought the", "kept the", "sang the"], ["copper lamp", "old bell", "river song"]
    said = lambda: f"{rng.choice(subj)} {rng.choice(verb)} {rng.choice(obj)}."
    docs = [(i, " ".join(said() for _ in range(4)), "s") for i in range(300)]
    docs += [(1000, said() + " The cook sought t", "s"), (1001, said() + " My aunt kept the", "s"), (1002, said() + "\n\n— Rao", "s"), (1003, said() + "\n\n(To be continued)", "s"), (1004, said() + "\n\n***", "s"), (1005, said() + "\nUmptal, 1929", None), (1006, "ends in a br�", "s"), (1007, None, "s"), (1008, " ", "s"), (1009, said() + " A pilgrim sang the…", "s"), (1000, said() + " The cook sought t", "s"), (1010, said() + "\n\n12", "s")]
    found = truncation(spark.createDataFrame(docs, "i long, t string, src string"), "i", "t", "src")
    got = {r.key: r.is_cut for r in found.collect()}
    assert {k for k, v in got.items() if v} == {1000, 1001, 1006, 1009}
    assert 1007 not in got and 1008 not in got
    assert {r.source: r.n_cut for r in rates(found).collect()} == {"s": 4, None: 0}


def test_empty_tables(spark):
    e = spark.createDataFrame([], "id string, w string, text string, source_path string, kind_level string, built_at timestamp")
    assert SharedSpans(e, "id", "w", "text").pairs.count() == 0
    assert p1.sentences(e, "id", "text").count() == 0
    assert p2.Garbled(e, "id", "w", "text").affected().count() == 0
    assert p3.one_form(e, "id", "text").count() == 0
    assert NearDuplicates(e, "id", "text", 3, 0.5).pairs().count() == 0
    assert truncation(e, "id", "text", "w").count() == 0
    assert Scans(e, e).found().count() == 0


@pytest.mark.parametrize("n", [30, 300])
def test_truncation_without_blanks_between_words_goes_by_the_rate(spark, n):
    rng = random.Random(n)
    first, then, last = ["แม่ครัวเก็บ", "ยายพบ", "พระอ่าน"], ["จดหมายถึงแม่", "แผนที่ทางเก่า"], ["ในห้องชั้นบน", "ริมทุ่งนา", "บนเรือ"]
    said = lambda: rng.choice(first) + rng.choice(then) + (rng.choice(last) if rng.random() < 0.8 else "")
    docs = [(i, " ".join([said() for _ in range(8)] + [first[0] + then[0] + rng.choice(last)]), "s") for i in range(n)]
    cuts = [(1000 + i, " ".join([said(), rng.choice(first) + then[i % 2]]), "s") for i in range(6)]
    cuts += [(1006 + i, said() + " " + first[i % 3] + "จดหมายถึ", "s") for i in range(4)]
    found = truncation(spark.createDataFrame(docs + cuts, "i long, t string, src string"), "i", "t", "src")
    assert {r.key for r in found.where("is_cut").collect()} == {k for k, _, _ in cuts}


@pytest.mark.parametrize("most_copies", [1000, 0])
def test_copies_of_a_cut_text_do_not_vouch_for_it(spark, most_copies):
    rng = random.Random(8)
    subj, verb, obj = ["The cook", "My aunt", "A pilgrim"], ["sought the", "kept the", "sang the"], ["copper lamp", "old bell", "river song"]
    said = lambda: f"{rng.choice(subj)} {rng.choice(verb)} {rng.choice(obj)}."
    docs = [(i, " ".join(said() for _ in range(4)), "s") for i in range(200)]
    docs += [(1000 + i, said() + f" {i} lamps.\nHill house", "s") for i in range(5)]
    two, one, dots = said() + "\nYesterday the", said() + "\nZamin", said() + " A pilgrim sang the…"
    cuts = [(2000 + i, two, "s") for i in range(4)] + [(3000 + i, one, "s") for i in range(4)] + [(4000 + i, dots, "s") for i in range(120)]
    found = truncation(spark.createDataFrame(docs + cuts + cuts[:2], "i long, t string, src string"), "i", "t", "src", most_copies=most_copies)
    assert {r.key for r in found.where("is_cut").collect()} == {k for k, _, _ in cuts}


def test_the_final_trigram_decides_texts_without_a_mark(spark):
    rng = random.Random(9)
    subj, verb, obj = ["The cook", "My aunt", "A pilgrim"], ["sought the", "kept the", "sang the"], ["copper lamp", "old bell", "river song"]
    said = lambda: f"{rng.choice(subj)} {rng.choice(verb)} {rng.choice(obj)}."
    docs = [(i, " ".join(said() for _ in range(4)), "s") for i in range(200)]
    notes = [(1000 + i, f"Note {'abcdef'[i]} on the water rights of Umptal", "s") for i in range(6)]
    cuts = [(2000, said() + "\nThe cook sought", "s"), (2001, "Yesterday the old man went down", "s"), (2002, said() + "\n(A pilgrim sang the)", "s"), (2003, said() + " My aunt kept the", "s")]
    inside = [(3000 + i, f"{said()} A pilgrim sang the bell (a pilgrim sang the) lamp.", "s") for i in range(5)]
    found = truncation(spark.createDataFrame(docs + notes + cuts + inside, "i long, t string, src string"), "i", "t", "src")
    assert {r.key for r in found.where("is_cut").collect()} == {2000, 2001, 2002, 2003}

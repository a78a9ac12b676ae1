import random

from pothi.operators import within


def test_first_holders_are_those_of_brute_force(spark):
    rng = random.Random(5)
    letters = "ab नदी𝒳 "
    texts = [(rng.choice("wxy"), "".join(rng.choice(letters) for _ in range(rng.randint(0, 400))), i) for i in range(60)] + [("w", None, 60), (None, "abab", 61)]
    asked = {("w", ""), ("z", "ab"), ("x", "qq")}
    for link, text, _ in texts[:60]:
        for n in (1, 2, 3, 4, 5, 11, 12, 23, 24, 39, 40, 59, 60, 61, 119, 130, 240, 300):
            if len(text) >= n:
                at = rng.randrange(len(text) - n + 1)
                asked |= {(link, text[at : at + n]), (rng.choice("wxy"), text[at : at + n]), (link, text[at : at + n - 1] + "q")}
    got = {(r.link, r.stretch): r.n for r in within.first_holder(spark.createDataFrame(sorted(asked), "link string, stretch string"), spark.createDataFrame(texts, "link string, text string, n int")).collect()}
    want = {(k, s): min(n for link, t, n in texts if link == k and t and s in t) for k, s in asked if s and any(link == k and t and s in t for link, t, _ in texts)}
    assert got == want and len(want) > 500


def test_nothing_asked_is_held_by_nothing(spark):
    none = spark.createDataFrame([("w", "")], "link string, stretch string")
    assert within.first_holder(none, spark.createDataFrame([("w", "ab", 1)], "link string, text string, n int")).isEmpty()


def test_pages_of_quotes_don_t_copy_a_paragraph_for_each_of_its_words(spark):
    from pothi.operators import reader

    paras = spark.createDataFrame([("w", i, f"the lamp by the river burns all night {i} " * 9) for i in range(30)], "key string, n int, body string")
    quotes = spark.createDataFrame([("q", "w", "all night 7 the lamp by the river burns all night 7")], "quote string, key string, body string")
    found = reader.pages_of_quotes(quotes, paras, "quote", "key", "body")
    assert [tuple(r) for r in found.collect()] == [("q", 7)]
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString() and "explode" not in found._jdf.queryExecution().analyzed().toString().lower().replace("posexplode", "")


def test_bodies_are_checked_without_a_copy_of_a_source_for_each_of_its_words(spark):
    from pothi.operators import citations

    sources = spark.createDataFrame([("w", f"the lamp  by the river\nburns all night {i} " * 9) for i in range(30)] + [("v", "ab")], "work string, text string")
    quotes = spark.createDataFrame([("a", "w", "river burns all\nnight 7 the lamp"), ("b", "w", "night 7 the lamp by a river"), ("c", "x", "the lamp"), ("d", "w", " "), ("e", "v", "b"), ("f", "w", "lamp")], "quote string, work string, body string")
    found = citations.check(quotes, sources, "quote", "work", "body", "text")
    assert {r.quote: r.status for r in found.collect()} == {"a": "verbatim", "b": "changed", "c": "no source", "d": "no body", "e": "verbatim", "f": "verbatim"}
    assert "explode" not in found._jdf.queryExecution().analyzed().toString().lower()

r"""Visually identical text with different characters (problem 3).

Text comes in one form in which equal-looking texts are equal. Of a text only
its unsettled clusters change: characters with a mapping, and letters followed
by marks that compose or stand out of order. Clusters are exploded to
positioned code points, joined with the table of decompositions and
look-alikes, marks are ordered by class, letters and marks recomposed, and the
strings rebuilt. That is done once per distinct cluster; texts without any
aren't touched. The tables are computed from the Unicode data of Python and
have a few thousand rows whatever the data, so they are broadcast.

The form is a key for comparing: look-alikes of other scripts become Latin
letters, and danda and visarga the bar and colon they look like, on either side.
Characters that add something to see (superscripts, fractions, circled digits)
keep it. Joiners after a virama change the letter's shape and stay.

Defined results: a null text has no row; an empty text, or one of invisible
characters only, an empty form, which equals nothing in ``equal_looking``; keys
that occur twice count once per distinct text; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pothi.plans.lineage import cut

# Look-alikes of Latin letters and of signs, in pairs.
LOOKALIKES = {
    **dict(zip("аеорсухіѕјԁԛԝһӏѵ", "aeopcyxisjdqwhlv")),
    **dict(zip("АВЕКМНОРСТХУІЅЈԌ", "ABEKMHOPCTXYISJG")),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX")),
    **dict(zip("ον", "ov")),
    "।": "|", "॥": "||", "ः": ":", "‐": "-", "‑": "-", "−": "-", "﹣": "-", "…": "...",
}
# Independent vowels and the signs that make another vowel's shape of them, in pairs with it.
DRAWN = {
    "अ": "ाआ ोओ ौऔ ॉऑ ॊऒ", "आ": "ेओ ैऔ ॅऑ ॆऒ", "ए": "ेऐ", "ऎ": "ॆऐ", "उ": "ुऊ", "ऋ": "ृॠ",
    "অ": "াআ", "ঋ": "ৃৠ", "ઋ": "ૃૠ", "અ": "ાઆ ોઓ ૌઔ ૅઍ ેએ ૈઐ ૉઑ", "ਅ": "ਾਆ ੈਐ ੌਔ", "ੲ": "ਿਇ ੀਈ ੇਏ", "ੳ": "ੁਉ ੂਊ",
    "ଅ": "ାଆ", "ఒ": "ౌఔ ోఓ", "ಒ": "ೌಔ", "ಋ": "ೃೠ",
}
# Decompositions that don't change what is seen.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
LIGATURES = range(0xFB00, 0xFB07)
VIRAMAS = "्্੍્୍்్್്්"
JOINERS = "‌‍"


def _whole(ch: str) -> str:
    """Fully decomposed code points of a character, look-alikes mapped."""
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if tag in SAME_LOOK or ord(ch) in LIGATURES:
        return "".join(_whole(chr(int(x, 16))) for x in rest.split())
    if tag and not tag.startswith("<"):
        return "".join(_whole(chr(int(x, 16))) for x in f"{tag} {rest}".split())
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    kind = unicodedata.category(ch)
    if kind == "Zs" or ch == "\t":
        return " "
    if ch in JOINERS:
        return ch
    if kind == "Cf" or kind == "Cc" and ch not in "\n\r" or 0xFE00 <= ord(ch) <= 0xFE0F or ch in "͏ᅟᅠ឴឵ㅤﾠ":
        return ""
    return ch


@cache
def _tables() -> tuple[list[tuple[str, str]], list[tuple[str, int]], dict[str, str]]:
    """Mappings, classes of marks, and compositions by pair."""
    mapping, classes, pairs = [], [], {}
    for cp in range(0x20000):
        ch = chr(cp)
        if 0xD800 <= cp < 0xE000 or 0xAC00 <= cp < 0xD7A4:
            continue
        if c := unicodedata.combining(ch):
            classes.append((ch, c))
        if (to := _whole(ch)) != ch:
            mapping.append((ch, to))
        d = unicodedata.decomposition(ch)
        if d and not d.startswith("<") and " " in d and unicodedata.normalize("NFC", ch) == ch:
            pairs["".join(chr(int(x, 16)) for x in d.split())] = ch
    for base, drawn in DRAWN.items():
        pairs |= {base + x[0]: x[1] for x in drawn.split()}
    return mapping, classes, pairs


def _cls(chars) -> str:
    """Pattern class of characters, by ranges."""
    points, out = sorted({ord(c) for c in chars}), []
    start = last = points[0]
    for p in points[1:] + [0x110001]:
        if p != last + 1:
            out.append(f"\\U{start:08x}" + (f"-\\U{last:08x}" if last > start else ""))
            start = p
        last = p
    return "[" + "".join(out) + "]"


@cache
def _changing() -> str:
    """Characters that change wherever they stand."""
    return "".join(ch for ch, to in _tables()[0] if unicodedata.normalize("NFC", to) != ch)


@cache
def _seconds() -> tuple[list[str], dict[str, set[str]]]:
    """Marks that compose with letters of any script, and others with the letters they compose with."""
    seconds: dict[str, set[str]] = {}
    for pair in _tables()[2]:
        seconds.setdefault(pair[1], set()).add(pair[0])
    general = [s for s in seconds if 0x300 <= ord(s) < 0x370 or ord(s) in (0x3099, 0x309A)]
    return general, {s: f for s, f in seconds.items() if s not in general}


@cache
def unsettled() -> re.Pattern:
    """Clusters that may change: changing characters, joiners, letters with marks that compose or stand out of order."""
    general, own = _seconds()
    marks = _cls(ch for ch, _ in _tables()[1])
    pairs = [f"{_cls(first)}{_cls(second)}" for second, first in own.items()]
    return re.compile("|".join([f"{_cls(_changing())}{marks}*", f"(?s:.){_cls(general)}{marks}*", *pairs, f"(?s:.){marks}{{2,}}", f"(?<!{_cls(VIRAMAS)}){_cls(JOINERS)}"]))


@cache
def _triggers() -> re.Pattern:
    """Characters without which a text is settled: one class, so that looking is cheap."""
    general, own = _seconds()
    return re.compile(_cls([*_changing(), *general, *own, *JOINERS]) + "|" + _cls(ch for ch, _ in _tables()[1]) + "{2}")


def _taken_apart(keep: bool):
    """Per row the digest of the text; if it is settled that is the form's, else its pieces, every second one a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, clusters = _triggers().search, unsettled()
        for batch in batches:
            digests, pieces = [], []
            for text in batch.column("text").to_pylist():
                digests.append(hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest())
                parts = None
                if find(text):
                    parts, at = [], 0
                    for m in clusters.finditer(text):
                        parts += [text[at : m.start()], m.group()]
                        at = m.end()
                    parts = [*parts, text[at:]] if parts else None
                pieces.append(parts if parts or not keep else [text])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(digests, pa.string()), pa.array(pieces, pa.list_(pa.string()))], names=["key", "digest", "pieces"])

    return run


def settled(clusters: DataFrame) -> DataFrame:
    """piece, form: each distinct cluster of clusters(piece) in its one form."""
    spark = clusters.sparkSession
    mapping, classes, pairs = _tables()
    maps = F.broadcast(spark.createDataFrame([(a, b) for a, b in mapping], "ch string, to string"))
    ranks = F.broadcast(spark.createDataFrame(classes, "ch string, ccc int"))
    composing = F.broadcast(spark.createDataFrame([(pairs,)], "compose map<string,string>"))
    points = clusters.select("piece", F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("i")).withColumn("ch", F.expr("substring(piece, i, 1)"))
    lone = (F.col("ch").isin(*JOINERS)) & (F.length("piece") == 1)
    mapped = points.join(maps, "ch", "left").select("piece", "i", F.when(lone, F.lit("")).otherwise(F.coalesce("to", "ch")).alias("to"))
    parts = mapped.where("to <> ''").select("piece", "i", "to", F.explode(F.sequence(F.lit(1), F.length("to"))).alias("j")).select("piece", "i", "j", F.expr("substring(to, j, 1)").alias("ch"))
    ranked = parts.join(ranks, "ch", "left").select("piece", "i", "j", "ch", F.coalesce("ccc", F.lit(0)).alias("ccc"))
    from pyspark.sql import Window as W

    starter = F.sum(F.when(F.col("ccc") == 0, 1).otherwise(0)).over(W.partitionBy("piece").orderBy("i", "j"))
    ordered = ranked.withColumn("s", starter).groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("s", "ccc", "i", "j", "ch"))).alias("cs"))

    def step(acc: Column, c: Column) -> Column:
        both = F.try_element_at(F.col("compose"), F.concat(acc["last"], c["ch"]))
        free = (acc["rest"] == "") | ((acc["ccc"] < c["ccc"]) & (acc["ccc"] > 0))
        joined = F.struct(acc["done"].alias("done"), both.alias("last"), acc["rest"].alias("rest"), acc["ccc"].alias("ccc"))
        fresh = F.struct(F.concat(acc["done"], acc["last"], acc["rest"]).alias("done"), c["ch"].alias("last"), F.lit("").alias("rest"), F.lit(0).alias("ccc"))
        added = F.struct(acc["done"].alias("done"), acc["last"].alias("last"), F.concat(acc["rest"], c["ch"]).alias("rest"), c["ccc"].alias("ccc"))
        return F.when((acc["last"] != "") & both.isNotNull() & free, joined).when(c["ccc"] == 0, fresh).otherwise(added)

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("last"), F.lit("").alias("rest"), F.lit(0).alias("ccc"))
    form = F.aggregate("cs", start, step, lambda a: F.concat(a["done"], a["last"], a["rest"]))
    done = ordered.crossJoin(composing).select("piece", form.alias("form"))
    return clusters.join(done, "piece", "left").select("piece", F.coalesce("form", F.lit("")).alias("form"))


def one_form(df: DataFrame, key: str, text: str, keep: bool = False) -> DataFrame:
    """key, digest, form_digest: digests of a text and of its form; with ``keep`` also the form itself."""
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    apart = cut(rows.mapInArrow(_taken_apart(keep), f"key {kind}, digest string, pieces array<string>"))
    moving = apart.where("size(pieces) > 1")
    # Texts stored alike have one form.
    parts = moving.dropDuplicates(["digest"]).select("digest", F.posexplode("pieces").alias("at", "piece"))
    forms = settled(parts.where("at % 2 = 1").select("piece").distinct())
    kept = parts.where("at % 2 = 0").select("digest", "at", F.col("piece").alias("s"))
    put = parts.where("at % 2 = 1").join(forms, "piece").select("digest", "at", F.col("form").alias("s"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda p: p["s"]), "")
    rebuilt = kept.unionByName(put).groupBy("digest").agg(whole.alias("form")).select("digest", F.md5("form").alias("form_digest"), *["form"] * keep)
    still = apart.where("coalesce(size(pieces), 0) <= 1").select("key", "digest", F.col("digest").alias("form_digest"), *[F.get("pieces", F.lit(0)).alias("form")] * keep)
    return still.unionByName(moving.select("key", "digest").join(rebuilt, "digest").select("key", "digest", "form_digest", *["form"] * keep))


_EMPTY = hashlib.md5(b"").hexdigest()


def equal_looking(a: DataFrame, b: DataFrame) -> DataFrame:
    """key_a, key_b: rows of two results of ``one_form`` that look the same and are stored otherwise."""
    some = lambda df, k: df.where(F.col("form_digest") != _EMPTY).select(F.col("key").alias(f"key_{k}"), F.col("digest").alias(f"d_{k}"), "form_digest").distinct()
    return some(a, "a").join(some(b, "b"), "form_digest").where("d_a <> d_b").select("key_a", "key_b").distinct()


def normalised(spark: SparkSession, text: str) -> str:
    """The form of one string, for trying things out."""
    return one_form(spark.createDataFrame([(1, text)], "key int, text string"), "key", "text", keep=True).first().form

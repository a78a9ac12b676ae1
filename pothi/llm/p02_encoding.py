"""Garbled text from wrong character encoding (problem 2).

A garbled stretch is UTF-8 read as some other charset, once or twice. Which
chain of charsets a record went through is latent. Every suspicious run of
characters is turned back into bytes under each chain and gives evidence by the
UTF-8 sequences found in them. Expectation-maximization then shares what the
records of a source tell about its chains: the E step weighs each chain of a
record by its evidence and by the rates of its source, the M step sums those
weights per source, smoothed by the rates of all sources. A record is affected
where the posterior of a garbling chain exceeds one half, and is repaired by
the chain of greatest posterior. One weak sequence so counts for more in a
source full of garbled text than in a clean one.

Only records with a suspicious run (a JVM pattern) reach Python; the tables of
the rounds hold one row per such record and chain, and sources enter by sums.

Defined results: null and empty texts are clean; a null source is a source of
its own; repeated ids count once (the greatest suspicious row); a replacement
character is evidence of a decoding that lost bytes, chain ``lost``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pothi.plans.lineage import cut

# Charsets text is commonly misread in.
CHARSETS = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8_r"]
CHAINS = CHARSETS + [f"{c}+{c}" for c in CHARSETS]
# Log odds against a sequence of two or more bytes by chance, and against a replacement character.
ODDS = {2: 6.9, 3: 9.2, 4: 4.0, "lost": 11.0}
UNLIKELY = 2.0
_LIKELY = re.compile("[\u00a0-\u017f\u0900-\u0dff\u0e00-\u0e7f\u1e00-\u1eff\u2000-\u206f\u20a0-\u214f\u3000-\u30ff\u4e00-\u9fff\ufb00-\ufb06\uff00-\uffef\u0391-\u03c9\u0410-\u044f]")
SMOOTHING = 20.0
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}")
_OWN_SCRIPTS = "ऀ-෿฀-๿ᰀ-᳿぀-ヿ㐀-鿿가-힯＀-￯"
_RUN = re.compile(f"[^\x00-\x7f{_OWN_SCRIPTS}]+")


def _images(charset: str) -> dict[str, int]:
    """Byte of each character above ASCII; bytes without one stand for themselves as controls or for a lost character."""
    out: dict[str, int] = {}
    lost = []
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(charset)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
            lost.append(b)
    if lost:
        out["�"] = lost[0]
    return out


_IMAGES = {c: _images(c) for c in CHARSETS}


def suspicious() -> str:
    """Java pattern of a character that can be a lead byte before one that can be a continuation.

    Blocks of characters that no charset has are passed over by a short class
    first, as the long ones take a comparison a range.
    """
    lead = {x for m in _IMAGES.values() for x, b in m.items() if b >= 0xC2} - {"�"}
    following = {x for m in _IMAGES.values() for x, b in m.items() if b < 0xC0}
    blocks = [(0x00, 0x9F), (0x0900, 0x0DFF), (0x0E00, 0x0E7F), (0x3000, 0x9FFF)]
    free = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in blocks if not any(a <= ord(x) <= b for x in lead))
    cls = lambda xs: "[" + "".join(f"\\u{ord(x):04x}" for x in sorted(xs)) + "]"
    return f"(?=[^{free}])(?:{cls(lead)}{cls(following)}|\\ufffd)"


def undo(text: str, charset: str, halfway: bool = False) -> tuple[str, float]:
    """Text with the UTF-8 sequences of its runs decoded, and the log odds against them by chance; halfway controls may come out."""
    images, found = _IMAGES[charset], 0.0

    def run(m: re.Match) -> str:
        nonlocal found
        chars = m.group()
        raw = bytes(images.get(x, 0x20) for x in chars)
        out, at = [], 0
        for s in _SEQUENCE.finditer(raw):
            piece = s.group().decode("utf-8")
            if ord(piece) < 0xA0 and not halfway or unicodedata.category(piece) in ("Co", "Cn", "Cs"):
                continue
            out += [chars[at : s.start()], piece]
            at = s.end()
            found += ODDS[len(s.group())] if _LIKELY.match(piece) else UNLIKELY
        return "".join(out) + chars[at:]

    return _RUN.sub(run, text), found


def unwind(text: str, chain: str) -> tuple[str, float]:
    charset, _, twice = chain.partition("+")
    once, n = undo(text, charset, bool(twice))
    if not twice:
        return once, n
    again, m = undo(once, charset)
    return (again, n + m) if m else (text, 0.0)


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for id_, source, text in zip(*(batch.column(c).to_pylist() for c in ("id", "source", "text"))):
            for chain in CHAINS:
                n = unwind(text, chain)[1]
                if n:
                    rows.append((id_, source, chain, n))
            if "�" in text:
                rows.append((id_, source, "lost", ODDS["lost"]))
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64())], names=["id", "source", "chain", "n"])


SALT = 16


class Garbled:
    """Affected records of ``df`` and their repair; a record's chains are one row, sources enter by sums."""

    def __init__(self, df: DataFrame, key: str, source: str, text: str, rounds: int = 4):
        rows = df.select(F.col(key).alias("id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text")).where(F.col("id").isNotNull())
        self.suspects = rows.where(F.col("text").rlike(suspicious())).groupBy("id").agg(F.max(F.struct("source", "text")).alias("r")).select("id", "r.source", "r.text")
        evidence = self.suspects.mapInArrow(_evidence, "id string, source string, chain string, n double")
        chains = F.collect_list(F.struct("chain", F.least("n", F.lit(400.0)).alias("ll")))
        records = cut(evidence.groupBy("id", "source").agg(F.array_sort(chains).alias("chains")))
        sizes = cut(rows.groupBy("source").agg(F.count_distinct("id").alias("rows")))
        everything = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("all_rows"))
        # The rates start equal for all sources.
        prior = F.lit(0.02 / len(CHAINS))
        known = records.withColumn("odds", F.transform("chains", lambda c: F.struct(c["chain"].alias("chain"), c["ll"].alias("ll"), prior.alias("prior"))))
        for _ in range(rounds):
            by_source = self._posterior(known).select("source", F.explode("odds").alias("o")).groupBy("source", F.col("o.chain").alias("chain")).agg(F.sum("o.p").alias("w"))
            by_source = cut(by_source)
            # As many rows as there are chains.
            by_chain = by_source.groupBy("chain").agg(F.sum("w").alias("w_all")).crossJoin(F.broadcast(everything)).select("chain", ((F.col("w_all") + 0.1) / (F.col("all_rows") + 1)).alias("rate"))
            rates = by_source.join(F.broadcast(by_chain), "chain").join(sizes, "source").select("source", "chain", ((F.col("w") + SMOOTHING * F.col("rate")) / (F.col("rows") + SMOOTHING)).alias("prior"))
            known = self._with(records, rates)
        self._known = known

    @staticmethod
    def _with(records: DataFrame, rates: DataFrame) -> DataFrame:
        """``records`` with the rates of their sources; a source with many records is joined in parts."""
        maps = rates.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("chain", "prior"))).alias("priors")).select("source", "priors", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part"))
        joined = records.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).hint("merge").join(maps, ["source", "part"])
        return joined.select("id", "source", "chains", F.transform("chains", lambda c: F.struct(c["chain"].alias("chain"), c["ll"].alias("ll"), F.col("priors")[c["chain"]].alias("prior"))).alias("odds"))

    @staticmethod
    def _posterior(known: DataFrame) -> DataFrame:
        """p of each chain of a record; what is missing to one is the record being right as it is."""
        add = lambda a, x: a + x
        clean = F.log(F.greatest(F.lit(1e-6), 1 - F.aggregate(F.transform("odds", lambda o: o["prior"]), F.lit(0.0), add)))
        logs = F.transform("odds", lambda o: F.log(o["prior"]) + o["ll"])
        topped = known.withColumns({"clean": clean, "logs": logs}).withColumn("top", F.greatest(F.array_max("logs"), "clean"))
        scaled = F.transform("logs", lambda x: F.exp(x - F.col("top")))
        total = topped.withColumn("scaled", scaled).withColumn("total", F.aggregate("scaled", F.lit(0.0), add) + F.exp(F.col("clean") - F.col("top")))
        return total.select("id", "source", F.zip_with("odds", "scaled", lambda o, x: F.struct(o["chain"].alias("chain"), (x / F.col("total")).alias("p"))).alias("odds"))

    def affected(self, least: float = 0.5) -> DataFrame:
        """id, source, chain, p: the affected records, their likeliest chain and the posterior of being garbled."""
        best = self._posterior(self._known)
        ranked = F.array_max(F.transform("odds", lambda o: F.struct(o["p"].alias("p"), o["chain"].alias("chain"))))
        summed = best.select("id", "source", F.aggregate("odds", F.lit(0.0), lambda a, o: a + o["p"]).alias("p"), ranked["chain"].alias("chain"))
        return summed.where(F.col("p") > least).select("id", "source", "chain", F.round("p", 6).alias("p"))

    def repaired(self) -> DataFrame:
        """id, chain, p, text: the affected records with their text put right as far as it can be had."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t if c == "lost" else unwind(t, c)[0] for t, c in zip(batch.column("text").to_pylist(), batch.column("chain").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("chain"), batch.column("p"), pa.array(texts, pa.string())], names=["id", "chain", "p", "text"])

        found = self.affected().select("id", "chain", "p").join(self.suspects.select("id", "text"), "id")
        return found.select("id", "chain", "p", "text").mapInArrow(run, "id string, chain string, p double, text string")

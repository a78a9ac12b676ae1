"""Which texts hold which stretches, exactly, without meeting them pair by pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pothi.plans.lineage import cut

_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
# Lengths hashes are made of, each at most twice the one before, and those a stretch is looked for by.
_LENGTHS = (1, 2, 4, 8, 12, 24, 40, 60, 120, 240)
TIERS = (1, 4, 12, 24, 40, 60, 120, 240)
#: So many characters are worked on at once; words of 64 bits of the largest filter, bits set in it for a stretch.
PIECE, LARGEST, BITS = 1 << 18, 1 << 22, 3


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the batches, about ``PIECE`` characters of ``text`` at a time."""
    for batch in batches:
        ends = np.cumsum([len(t) for t in batch.column("text").to_pylist()])
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + PIECE, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def _places(batch: pa.RecordBatch, tiers: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Tier, hashes, rows and offsets of all stretches of the lengths of ``tiers`` inside a text of batch(lh, text)."""
    texts = batch.column("text").to_pylist()
    sizes = np.array([len(t) for t in texts])
    row = np.repeat(np.arange(len(texts)), sizes)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    link = batch.column("lh").to_numpy().view(np.uint64)
    h = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    have = 1
    with np.errstate(over="ignore"):
        h = (h + np.uint64(1)) * _MIX
        for n in _LENGTHS:
            if n > max(tiers) or n > len(row):
                return
            if n > have:
                a, b = h[: len(h) - (n - have)], h[n - have :]
                h = ((a ^ (a >> _TURN)) * _MIX + (b ^ (b >> np.uint64(31)))) * _MIX
                have = n
            if n in tiers:
                inside = np.flatnonzero(row[: len(h)] == row[n - 1 :])
                k = (h[inside] ^ link[row[inside]]) * _MIX
                yield n, k ^ (k >> _TURN), row[inside], offset[inside]


def _bit(k: np.ndarray, i: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of the ``i``-th place of hashes in a filter."""
    with np.errstate(over="ignore"):
        k = (k ^ (k >> np.uint64(29 + i))) * (_MIX + np.uint64(2 * i))
    return (k >> np.uint64(8)) & np.uint64(words - 1), k >> np.uint64(58)


def _filter(grams: DataFrame, tiers: list[int], words: int) -> np.ndarray:
    """A filter of ``words`` (a power of two) 64-bit words of grams(lh, text); the driver gets at most one row a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            sizes = np.array([len(t) for t in batch.column("text").to_pylist()])
            for n, k, row, offset in _places(batch, tiers):
                k = k[(offset == 0) & (sizes[row] == n)]
                for at, bit in (_bit(k, i, words) for i in range(BITS)):
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array((np.uint64(1) << bit).view(np.int64))], names=["at", "bit"])

    got = grams.mapInArrow(run, "at int, bit bigint").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def first_holder(stretches: DataFrame, texts: DataFrame) -> DataFrame:
    """link, stretch, n: the least n of texts(link, text, n) of the same link that hold a stretch of stretches(link, stretch); stretches none holds have no row.

    A stretch goes by its beginning, of the longest of ``TIERS`` that it has. The
    hashes of all beginnings make a filter, all places of a text are tried against
    it in numpy, and only what follows at a place it may hold leaves the task. The
    filter may let others through, never hold one back; an exact join decides.
    Null texts hold nothing; rows without a link and empty stretches are left out.
    """
    tier = F.lit(TIERS[0])
    for n in TIERS[1:]:
        tier = F.when(F.length("stretch") >= n, n).otherwise(tier)
    asked = cut(stretches.where("link IS NOT NULL AND stretch <> ''").select("link", "stretch").distinct().select("link", "stretch", tier.alias("tier"), F.left("stretch", tier).alias("gram")))
    longest = {r.tier: r.most for r in asked.groupBy("tier").agg(F.max(F.length("stretch")).alias("most")).collect()}
    grams = asked.select("link", "gram").distinct()
    kind = dict(texts.dtypes)["n"]
    if not longest:
        return asked.select("link", "stretch", F.lit(None).cast(kind).alias("n"))
    tiers = sorted(longest)
    words = min(LARGEST, 1 << max(10, (grams.count() // 2).bit_length()))
    shared = texts.sparkSession.sparkContext.broadcast(_filter(grams.select(F.xxhash64("link").alias("lh"), F.col("gram").alias("text")), tiers, words))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in _pieces(batches):
            links, texts_, ns = (batch.column(c).to_pylist() for c in ("link", "text", "n"))
            least: dict[tuple, int] = {}
            for tier, k, row, offset in _places(batch, tiers):
                for i in range(BITS):
                    at, bit = _bit(k, i, len(known))
                    hit = (known[at] >> bit) & np.uint64(1) == 1
                    k, row, offset = k[hit], row[hit], offset[hit]
                most = longest[tier]
                for r, o in zip(row.tolist(), offset.tolist()):
                    place = (links[r], tier, texts_[r][o : o + most])
                    if place not in least or ns[r] < least[place]:
                        least[place] = ns[r]
            if least:
                link, of, tail = zip(*least)
                yield pa.RecordBatch.from_arrays([pa.array(link, pa.string()), pa.array([t[:n] for t, n in zip(tail, of)], pa.string()), pa.array(tail, pa.string()), pa.array(of, pa.int32()), pa.array(list(least.values()), pa.int64())], names=["link", "gram", "tail", "tier", "n"])

    held = texts.where("link IS NOT NULL AND text IS NOT NULL").select(F.xxhash64("link").alias("lh"), "link", "text", F.col("n").cast("bigint").alias("n"))
    tails = held.mapInArrow(follow, "link string, gram string, tail string, tier int, n bigint")
    met = asked.join(tails, ["link", "gram", "tier"]).where(F.startswith("tail", "stretch"))
    return met.groupBy("link", "stretch").agg(F.min("n").cast(kind).alias("n"))

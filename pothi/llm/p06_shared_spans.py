"""Long exact spans shared between records (problem 6).

Sliding spans: every text is cut into units and every run of consecutive units
is hashed, hashes meet globally, and what they cover is confirmed code point by
code point. A run of whole sentences can miss a shared span (220 characters
may hold parts of two sentences and no whole one), so the unit here is one code
point, a run is ``gram`` of them, and of the runs only those are kept that have
the least hash of some ``min_len - gram + 1`` neighbours. Two texts with
``min_len`` characters in common have one such neighbourhood in common, hence
its least run: the choice loses nothing.

Anchors (kept runs) that stand in one work only are dropped by a map-side
combined count. The others fetch their surroundings of at most
``2 * min_len - gram`` code points; within an anchor the surroundings are
compared directly. Anchors that occur more than ``hot`` times go another exact
way: each emits the hashes of all its windows of ``min_len`` code points, and
records meet only over equal windows.

Defined results: null, empty and shorter texts share nothing; null groups count
as one group; a key that occurs twice counts once; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pothi.plans.lineage import cut

GRAM, MIN_LEN, HOT, PART = 64, 220, 48, 500
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POS_BITS = np.uint64(22)
_PIECE = 1 << 20


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(27))


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` code points, by doubling."""
    if len(points) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        step, done, rest = _mixed(points.astype(np.uint64) + _BASE), 0, n
        size, power, out = 1, _BASE, None
        while rest:
            if rest & 1:
                if out is None:
                    out, out_power = step, power
                else:
                    length = len(points) - (done + size) + 1
                    out = out[:length] * power + step[done : done + length]
                    out_power = out_power * power
                done += size
            rest >>= 1
            if rest:
                step = step[:-size] * power + step[size:]
                power, size = power * power, size * 2
        return _mixed(out)


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return np.minimum(keys[: len(keys) - (width - size)], keys[width - size :]) if size < width else keys


def anchors(text: str | None, gram: int = GRAM, min_len: int = MIN_LEN) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a text."""
    if text is None or len(text) < min_len:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    points, low = _code_points(text), (np.uint64(1) << _POS_BITS) - np.uint64(1)
    positions, hashes = [], []
    for start in range(0, max(1, len(points) - min_len + 1), _PIECE):
        h = gram_hashes(points[start : start + _PIECE + min_len - 1], gram)
        least = _sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), min_len - gram + 1) & low
        at = least[np.concatenate(([True], least[1:] != least[:-1]))].astype(np.int64)
        positions.append(at + start)
        hashes.append(h[at])
    at, h = np.concatenate(positions), np.concatenate(hashes)
    at, first = np.unique(at, return_index=True)
    return at, h[first]


def _anchor_batches(gram: int, min_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(t, gram, min_len) for t in batch.column("text").to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(p) for p, _ in found])
            take = pa.array(rows)
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(take), batch.column("grp").take(take), pa.array(np.concatenate([p for p, _ in found]).astype(np.int32)), pa.array(np.concatenate([h for _, h in found]).view(np.int64))],
                    names=["id", "grp", "pos", "h"],
                )

    return run


def _surroundings(gram: int, min_len: int):
    side = min_len - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, grps, poss, hs, ctx = [], [], [], [], []
            for id_, grp, text, hits in zip(*(batch.column(c).to_pylist() for c in ("id", "grp", "text", "hits"))):
                points = _code_points(text)
                padded = np.concatenate([np.zeros(side, np.uint32), points, np.zeros(side, np.uint32)])
                for hit in hits:
                    ids.append(id_)
                    grps.append(grp)
                    poss.append(hit["pos"])
                    hs.append(hit["h"])
                    ctx.append(padded[hit["pos"] : hit["pos"] + 2 * side + gram].tobytes())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(grps, pa.string()), pa.array(poss, pa.int32()), pa.array(hs, pa.int64()), pa.array(ctx, pa.binary())], names=["id", "grp", "pos", "h", "ctx"])

    return run


def _runs(a: np.ndarray, b: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """How far two surroundings agree to the left and to the right of the anchor."""
    same = (a == b) & (a != 0)
    left, right = same[:, :side][:, ::-1], same[:, -side:]
    far = lambda m: np.where(m.all(1), m.shape[1], np.argmin(m, 1))
    return far(left), far(right)


def _compare(gram: int, min_len: int, hot: int):
    """Pairs within each anchor; rows come sorted by anchor."""
    side = min_len - gram

    def group(ids, grps, pos, ctx):
        i, j = np.triu_indices(len(ids), 1)
        apart = grps[i] != grps[j]
        i, j = i[apart], j[apart]
        out = []
        for k in range(0, len(i), 4096):
            p, q = i[k : k + 4096], j[k : k + 4096]
            points = ctx
            equal = (points[p][:, side : side + gram] == points[q][:, side : side + gram]).all(1)
            left, right = _runs(points[p], points[q], side)
            ok = equal & (left + right + gram >= min_len)
            out.append((p[ok], q[ok], left[ok], right[ok]))
        return out

    def run(batches):
        carry = None
        for pdf in batches:
            if carry is not None:
                import pandas as pd

                pdf = pd.concat([carry, pdf], ignore_index=True)
            last = pdf["h"].to_numpy() == pdf["h"].iloc[-1] if len(pdf) else np.empty(0, bool)
            carry = pdf[last]
            yield from done(pdf[~last])
        if carry is not None and len(carry):
            yield from done(carry)

    def done(pdf):
        import pandas as pd

        if not len(pdf):
            return
        h, ids, grps, pos = (pdf[c].to_numpy() for c in ("h", "id", "grp", "pos"))
        ctx = np.frombuffer(b"".join(pdf["ctx"]), np.uint32).reshape(len(pdf), -1)
        cuts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
        rows = []
        for s, e in zip(cuts[:-1], cuts[1:]):
            if e - s < 2:
                continue
            for p, q, left, right in group(ids[s:e], grps[s:e], pos[s:e], ctx[s:e]):
                rows += zip(ids[s:e][p], ids[s:e][q], pos[s:e][p] - left, pos[s:e][q] - left, left + right + gram)
        if rows:
            yield pd.DataFrame(rows, columns=["id_1", "id_2", "start_1", "start_2", "n"])

    return run


def _windows(gram: int, min_len: int):
    side = min_len - gram

    def run(batches):
        for batch in batches:
            ids, grps, pos = (batch.column(c).to_pylist() for c in ("id", "grp", "pos"))
            ctx = batch.column("ctx").to_pylist()
            for id_, grp, p, raw in zip(ids, grps, pos, ctx):
                points = np.frombuffer(raw, np.uint32)
                real = np.flatnonzero(points)
                h = gram_hashes(points[real[0] : real[-1] + 1], min_len).view(np.int64)
                n = len(h)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([id_] * n, pa.string()), pa.array([grp] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32) + (p - side + int(real[0])), pa.int32()), pa.array(h)], names=["id", "grp", "start", "w"])

    return run


class SharedSpans:
    """Shared spans of ``df``; ``pairs`` and ``spans`` are lazy frames.

    pairs(id_a, id_b): keys of different groups with at least ``min_len``
    consecutive code points in common, id_a < id_b.
    spans(id, start, end): stretches of a record that stand in a record of
    another group.
    """

    def __init__(self, df: DataFrame, key: str, group: str, text: str, min_len: int = MIN_LEN, gram: int = GRAM, hot: int = HOT):
        self.min_len = min_len
        rows = df.select(F.col(key).alias("id"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("grp"), F.col(text).alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= min_len))
        kept = cut(rows.mapInArrow(_anchor_batches(gram, min_len), "id string, grp string, pos int, h bigint").distinct())
        stats = kept.groupBy("h").agg(F.count("*").alias("n"), F.min("grp").alias("g0"), F.max("grp").alias("g1")).where("g0 <> g1").select("h", (F.col("n") > hot).alias("is_hot"))
        hits = kept.join(stats, "h").groupBy("id", "grp").agg(F.collect_list(F.struct("pos", "h", "is_hot")).alias("hits"))
        texts = rows.join(hits, ["id", "grp"])
        some = lambda flag: F.filter("hits", lambda x: x["is_hot"] == flag)
        about = lambda flag: texts.select("id", "grp", "text", some(flag).alias("hits")).where(F.size("hits") > 0).mapInArrow(_surroundings(gram, min_len), "id string, grp string, pos int, h bigint, ctx binary")
        cool = about(False).repartition("h").sortWithinPartitions("h", "id", "pos")
        self._cool = cool.mapInPandas(_compare(gram, min_len, hot), "id_1 string, id_2 string, start_1 int, start_2 int, n int")
        windows = about(True).mapInArrow(_windows(gram, min_len), "id string, grp string, start int, w bigint").distinct()
        shared = windows.groupBy("w").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1")).where("g0 <> g1").select("w")
        self._hot = windows.join(shared, "w")

    @property
    def pairs(self) -> DataFrame:
        ordered = lambda a, b: [F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")]
        cool = self._cool.select(*ordered("id_1", "id_2"))
        # A window that many records have is met in parts: each record in one part, and with all others there.
        members = self._hot.select("w", "id", "grp").distinct()
        parts = members.groupBy("w").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        split = members.join(parts, "w")
        a = split.select("w", "id", "grp", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")).alias("a")
        b = split.select("w", "id", "grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).alias("b")
        hot = a.join(b, (F.col("a.w") == F.col("b.w")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.grp") != F.col("b.grp"))).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
        return cool.unionByName(hot).where("id_a <> id_b").distinct()

    @property
    def spans(self) -> DataFrame:
        end = lambda c, n: (F.col(c) + n).alias("end")
        both = self._cool.select(F.explode(F.array(F.struct(F.col("id_1").alias("id"), F.col("start_1").alias("start"), end("start_1", F.col("n"))), F.struct(F.col("id_2").alias("id"), F.col("start_2").alias("start"), end("start_2", F.col("n"))))).alias("s")).select("s.*")
        hot = self._hot.select("id", "start", end("start", F.lit(self.min_len)))
        return both.unionByName(hot).distinct()


def coverage(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a record made one: id, start, end."""
    from pyspark.sql import Window as W

    w = W.partitionBy("id").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    return marked.withColumn("island", F.sum("new").over(w)).groupBy("id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")

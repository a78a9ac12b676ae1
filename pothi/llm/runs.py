"""Hashes of runs of consecutive words, by numpy over whole batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pothi.functions.words import plain_words

_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: Column) -> Column:
    """Hashes of the plain words of a text; empty for a null text."""
    return F.transform(plain_words(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))


def run_hashes(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``n`` words; ``starts`` parts the rows (one more than rows)."""
    length = len(words) - n + 1
    if length <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        w = (words ^ (words >> np.uint64(31))) * _BASE
        h = np.zeros(length, np.uint64)
        for k in range(n):
            h = h * _BASE + w[k : k + length]
        h = (h ^ (h >> np.uint64(29))) * _BASE
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = row[:length] == row[n - 1 : n - 1 + length]
    return h[inside], row[:length][inside]


def _values(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    words = batch.column("words")
    starts = words.offsets.to_numpy()
    values = words.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]]
    return values.view(np.uint64), starts - starts[0]


def bits_of(df: DataFrame, column: str, words: int) -> np.ndarray:
    """A filter of ``words`` (a power of two) 64-bit words with a bit set for each hash of a column.

    The driver gets at most one row a word.
    """
    h = F.col(column)
    bit = F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(`{column}`, 58) AS INT))")
    set_ = df.groupBy(h.bitwiseAND(F.lit(words - 1)).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[set_.column("at").to_numpy()] = set_.column("bits").to_numpy().view(np.uint64)
    return out


#: So many words or runs are worked on at once in a task, whatever the batches are.
PIECE = 1 << 18


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, about ``PIECE`` elements of a list column at a time; a row is never parted."""
    for batch in batches:
        ends, at = batch.column(column).offsets.to_numpy(), 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, "right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop


def runs_of(n: int, known: np.ndarray | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """id, run: every run; with ``known`` (a filter), only runs it may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "words"):
            h, row = run_hashes(*_values(batch), n)
            if known is not None and len(h):
                hit = (known[h & np.uint64(len(known) - 1)] >> (h >> np.uint64(58))) & np.uint64(1) == 1
                h, row = h[hit], row[hit]
            if len(h):
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(h.view(np.int64))], names=["id", "run"])

    return run


def run_sets(df: DataFrame, n: int) -> DataFrame:
    """key, digest, runs: a hash of the text and the sorted distinct runs of ``n`` words of each row of df(key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "words"):
            h, row = run_hashes(*_values(batch), n)
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            if len(h):
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))
                h, row = h[new], row[new]
            offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("digest"), lists], names=["key", "digest", "runs"])

    hashed = df.select("key", F.xxhash64("text").alias("digest"), word_hashes(F.col("text")).alias("words"))
    return hashed.mapInArrow(run, "key string, digest bigint, runs array<bigint>")


def loads(lists: DataFrame, buckets: int) -> np.ndarray:
    """How many of all runs of lists(runs) fall into each of ``buckets`` (a power of two) by their hash.

    Counted in the tasks and summed by bucket; the driver gets at most one row a bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in pieces(batches, "runs"):
            total += np.bincount(_runs(batch)[0] & (buckets - 1), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    counted = lists.select("runs").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return out


def _runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Runs of all rows, and where each row's begin."""
    lists = batch.column("runs")
    starts = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]], starts - starts[0]


def _lists_of(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary values of the stretches of ``values`` that begin at ``starts``."""
    size = values.dtype.itemsize
    offsets = pa.array((np.append(starts, len(values)) * size).astype(np.int32)).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _flat(column: pa.ChunkedArray | pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of binary values, and where each row's begin."""
    raw = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int32)
    data = np.frombuffer(raw.buffers()[2][offsets[0] : offsets[-1]] if len(raw) and offsets[-1] > offsets[0] else b"", dtype)
    return data, (offsets - offsets[0]) // data.dtype.itemsize


def _block(runs: np.ndarray, blocks: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (((runs.view(np.uint64) * _BASE) >> np.uint64(33)) % np.uint64(blocks)).astype(np.int32)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where the stretches of equal rows begin."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def too_common(load: np.ndarray, hot: int) -> np.ndarray:
    """Buckets so loaded that one of their runs must be common; those runs aren't counted one by one."""
    return load > 2 * load.mean() + hot


def frequencies(lists: DataFrame, load: np.ndarray, hot: int, each: int) -> DataFrame:
    """cls, counts of lists(cls, runs): in how many classes each run of a class stands, one list per block of runs in the order of the runs.

    Runs of too common buckets are left out. A block holds about ``each`` runs.
    """
    shared = lists.sparkSession.sparkContext.broadcast(load)
    blocks = int(load.sum() / each) + 1

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = shared.value
        common = too_common(load, hot)
        for batch in pieces(batches, "runs"):
            runs, starts = _runs(batch)
            row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            keep = ~common[runs & (len(load) - 1)]
            runs, row = runs[keep], row[keep]
            block = _block(runs, blocks)
            order = np.lexsort((runs, block, row))
            runs, row, block = runs[order], row[order], block[order]
            at = _starts(row, block)
            yield pa.RecordBatch.from_arrays([pa.array(block[at]), batch.column("cls").take(pa.array(row[at])), _lists_of(runs, at)], names=["block", "cls", "runs"])

    def count(table: pa.Table) -> pa.Table:
        runs, starts = _flat(table.column("runs"), np.int64)
        cls = table.column("cls").to_numpy()
        _, first = np.unique(cls, return_index=True)
        once = np.zeros(len(cls), bool)
        once[first] = True
        keep = np.repeat(once, np.diff(starts))
        runs, n = runs[keep], np.diff(starts)[once]
        _, back, counts = np.unique(runs, return_inverse=True, return_counts=True)
        return pa.table({"cls": cls[once], "block": np.full(len(n), table.column("block")[0].as_py() if len(table) else 0, np.int32), "counts": _lists_of(counts[back].astype(np.uint32), np.cumsum(n) - n)})

    return lists.select("cls", "runs").mapInArrow(spread, "block int, cls bigint, runs binary").groupBy("block").applyInArrow(count, "cls bigint, block int, counts binary")


def anchored(counted: DataFrame, load: np.ndarray, threshold: float, hot: int, each: int) -> DataFrame:
    """block, cls, n, side, anchors, places of counted(cls, runs, counts): by what its classes are found, a row per class and block.

    A row of ``n`` runs goes by the rarest ``n - ceil(threshold n) + SHARED`` of them;
    those of one class only find nothing and stay behind. An anchor is 32 bits of a run;
    what falls together by chance only lets more pairs be looked at. An anchor of
    more than ``hot`` classes is split into parts: as side 1 a class is in one
    part, as side 2 in all.
    """
    shared = counted.sparkSession.sparkContext.broadcast(load)
    # Anchors that are split come once and once a part.
    copies = np.where(load > hot, 1 + -(-load // hot), 1)
    blocks, run_blocks = int((load * copies).sum() * (1 - threshold) / each) + 1, int(load.sum() / each) + 1

    def rows(cls, n, row, place, anchors, side):
        block = (anchors >> np.uint64(33)) % np.uint64(blocks)
        order = np.lexsort((block, row))
        block, row = block[order], row[order]
        at = _starts(row, block)
        return pa.RecordBatch.from_arrays(
            [pa.array(block[at].astype(np.int32)), cls.take(pa.array(row[at])), pa.array(n[row[at]].astype(np.int32)), pa.array(np.full(len(at), side, np.int32)), _lists_of(anchors[order].astype(np.uint32), at), _lists_of(place[order].astype(np.uint32), at)],
            names=["block", "cls", "n", "side", "anchors", "places"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = shared.value
        common = too_common(load, hot)
        for batch in pieces(batches, "runs"):
            runs, starts = _runs(batch)
            n = np.diff(starts)
            row = np.repeat(np.arange(len(n)), n)
            bucket = runs & (len(load) - 1)
            of = load[bucket] + (np.int64(1) << 40)
            counted = ~common[bucket]
            # Counts come in the order of rows, blocks and runs.
            order = np.lexsort((runs, _block(runs, run_blocks), row))
            order = order[counted[order]]
            of[order] = _flat(batch.column("counts"), np.uint32)[0]
            order = np.lexsort((runs, of, row))
            place = np.arange(len(runs)) - starts[:-1][row]
            keep = (place < (n - np.ceil(n * threshold - 1e-9).astype(np.int64))[row] + SHARED) & (of[order] > 1)
            kept, row, place = order[keep], row[keep], place[keep]
            parts, cls = ((of[kept] & ((np.int64(1) << 40) - 1)) + hot - 1) // hot, batch.column("cls")
            with np.errstate(over="ignore"):
                mixed = lambda r, part: ((r.view(np.uint64) ^ (r.view(np.uint64) >> np.uint64(29))) + part.astype(np.uint64)) * _BASE
                few, many = parts <= 1, parts > 1
                yield rows(cls, n, row[few], place[few], mixed(runs[kept[few]], np.zeros(few.sum())), 0)
                if many.any():
                    r, h, p, at = row[many], runs[kept[many]], parts[many], place[many]
                    yield rows(cls, n, r, at, mixed(h, cls.to_numpy()[r] % p), 1)
                    # All parts of all of these can be far more than the batch: some at a time.
                    total = np.concatenate(([0], np.cumsum(p)))
                    for s in range(0, int(total[-1]), _AT_ONCE):
                        k = np.arange(s, min(s + _AT_ONCE, int(total[-1])))
                        i = np.searchsorted(total, k, "right") - 1
                        yield rows(cls, n, r[i], at[i], mixed(h[i], k - total[i]), 2)

    return counted.select("cls", "runs", "counts").mapInArrow(run, "block int, cls bigint, n int, side int, anchors binary, places binary")


_AT_ONCE = 1 << 18
#: So many anchors two classes must have in common, so many more a class goes by.
SHARED = 5


def meetings(anchored: DataFrame, threshold: float) -> DataFrame:
    """a, b, met, least: classes of like size that meet at anchors early enough in both, a block's part of them; a < b.

    Of two sets with ``need`` runs in common the first ``least`` of these (five,
    or all of fewer) have ``need - least`` others after them in both. Only anchors
    with room for those count, and a pair without ``least`` of them is none.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        cls, n, side = (table.column(c).to_numpy() for c in ("cls", "n", "side"))
        anchor, offsets = _flat(table.column("anchors"), np.uint32)
        place = _flat(table.column("places"), np.uint32)[0].astype(np.int64)
        names, rank = np.unique(cls, return_inverse=True)
        row = np.repeat(np.arange(len(cls)), np.diff(offsets))
        key, who, size = ((side[row] > 0).astype(np.int64) << 34) | (anchor.astype(np.int64) << 2) | side[row], rank[row], n[row].astype(np.int64)
        order = np.lexsort((who, key))
        key, who, size, place = key[order], who[order], size[order], place[order]
        part, role = key >> 2, key & 3
        # Each meets those after it of its anchor; of a split one, side 1 meets side 2.
        end = np.searchsorted(part, part, "right")
        first = np.where(role == 1, np.searchsorted(key, (part << 2) | 2), np.arange(len(key)) + 1)
        many = np.where(role == 2, 0, end - first)
        total = np.concatenate(([0], np.cumsum(many)))
        # The pairs of a block have no bound: they leave some at a time, and are summed behind.
        for s in range(0, int(total[-1]), _AT_ONCE):
            pair = np.arange(s, min(s + _AT_ONCE, int(total[-1])))
            i = np.searchsorted(total, pair, "right") - 1
            j = first[i] + pair - total[i]
            need = np.ceil((size[i] + size[j]) * (threshold / (1 + threshold)) - 1e-9)
            least = np.minimum(need, SHARED)
            near = (who[i] != who[j]) & (size[i] - place[i] > need - least) & (size[j] - place[j] > need - least)
            a, b = who[i[near]], who[j[near]]
            keys, at, counts = np.unique(np.minimum(a, b) * len(names) + np.maximum(a, b), return_index=True, return_counts=True)
            if len(keys):
                columns = [names[keys // len(names)], names[keys % len(names)], counts, least[near][at].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "met", "least"])

    return anchored.groupBy("block").applyInArrow(meet, "a bigint, b bigint, met bigint, least int")

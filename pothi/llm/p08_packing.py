"""Filling fixed-capacity containers with items (problem 8).

Items are texts by their length in tokens of a public tokenizer; one longer
than the capacity is parted into full containers and a rest. The items are
spread over shards of bounded size by their hash, and each shard is packed by
itself in one task. In a shard, lengths are rounded up to 64ths of the capacity;
combinations of up to ``depth`` lengths whose sum fills the last 64th are
enumerated, non-negative least squares finds how often to use each against the
shard's histogram, the counts are rounded down as far as items last, and what
remains is packed greedily, longest first into the fullest container it fits.

Defined results: null and empty texts have no tokens and are in no container;
repeated ids count once (the longest text); ties go by id; special-token strings
are ordinary text; a capacity of null or below one gets no containers.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
SHARD, BINS, DEPTH, ROUNDS = 150_000, 64, 4, 150
_encoders: dict[str, object] = {}


def encoder(path: str):
    """tiktoken encoding of a rank file, once per process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("pothi", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def lengths(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """key, n_tokens of every text that has tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(encode(t)) for t in batch.column("text").to_pylist()], pa.int32())], names=["key", "n_tokens"])

    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where("key IS NOT NULL AND text <> ''")
    return rows.mapInArrow(count, "key bigint, n_tokens int").groupBy("key").agg(F.max("n_tokens").alias("n_tokens")).where("n_tokens > 0")


def combinations(bins: int = BINS, depth: int = DEPTH) -> np.ndarray:
    """Matrix of use counts, one column per combination of up to ``depth`` lengths filling ``bins``."""
    cols: list[list[int]] = []

    def add(rest: int, least: int, parts: list[int]) -> None:
        if rest >= least and len(parts) < depth:
            cols.append([*parts, rest])
        if len(parts) + 1 < depth:
            for x in range(least, rest // 2 + 1):
                add(rest - x, x, [*parts, x])

    add(bins, 1, [])
    m = np.zeros((bins + 1, len(cols)), np.float32)
    for j, c in enumerate(cols):
        for x in c:
            m[x, j] += 1
    return m


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 with a x near b, by accelerated projected gradients."""
    step = 1.0 / max(1e-9, float(np.linalg.norm(a @ a.T, 2)))
    x = y = np.zeros(a.shape[1], np.float32)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (a.T @ (a @ y - b)))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + ((t - 1) / t_new) * (new - x)
        x, t = new, t_new
    return x


def pack(sizes: np.ndarray, capacity: int, combos: np.ndarray) -> np.ndarray:
    """Container number of each item; sizes come longest first."""
    n_bins = combos.shape[0] - 1
    where = np.full(len(sizes), -1, np.int64)
    length = np.minimum(n_bins, -(-sizes.astype(np.int64) * n_bins // capacity))
    order = np.argsort(length, kind="stable")
    first = np.searchsorted(length[order], np.arange(n_bins + 2))
    left = (first[1:] - first[:-1]).astype(np.int64)  # items of each length not yet placed
    used = np.zeros(n_bins + 1, np.int64)
    repeat = np.floor(non_negative_least_squares(combos, left.astype(np.float32)) + 1e-3).astype(np.int64)
    made = 0
    for j in np.argsort(-repeat, kind="stable"):
        if repeat[j] == 0:
            break
        need = combos[:, j].astype(np.int64)
        parts = np.flatnonzero(need)
        times = int(min(repeat[j], (left[parts] // need[parts]).min()))
        if times <= 0:
            continue
        for x in parts:
            take = order[first[x] + used[x] : first[x] + used[x] + need[x] * times]
            where[take] = made + np.repeat(np.arange(times), need[x])
            used[x] += need[x] * times
            left[x] -= need[x] * times
        made += times
    rest = np.flatnonzero(where < 0)
    room = np.full(made, capacity, np.int64)
    np.subtract.at(room, where[where >= 0], sizes[where >= 0])
    free = sorted((int(r), i) for i, r in enumerate(room) if r > 0)
    for i in rest:
        size = int(sizes[i])
        at = bisect.bisect_left(free, (size, -1))
        if at < len(free):
            r, c = free.pop(at)
        else:
            r, c, made = capacity, made, made + 1
        where[i] = c
        if r > size:
            bisect.insort(free, (r - size, c))
    return where


def packed(items: DataFrame, capacities: DataFrame, shard: int = SHARD) -> DataFrame:
    """size_id, container, key, part, first_token, n_tokens, unused: every item in a container of each capacity.

    items(key, n_tokens), capacities(size_id, capacity). ``unused`` is the room left in the container.
    """
    sizes = capacities.where("capacity >= 1").select("size_id", F.col("capacity").cast("int").alias("capacity")).distinct()
    parted = items.crossJoin(F.broadcast(sizes)).select("size_id", "capacity", "key", "n_tokens", F.explode(F.sequence(F.lit(0), F.expr("int((n_tokens - 1) div capacity)"))).alias("part"))
    pieces = parted.select("size_id", "capacity", "key", "part", (F.col("part") * F.col("capacity")).alias("first_token"), F.least("capacity", F.col("n_tokens") - F.col("part") * F.col("capacity")).cast("int").alias("n"))
    counts = items.agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).first()
    smallest = sizes.agg(F.min("capacity")).first()[0] or 1
    shards = max(1, -(-(counts.n + (counts.t or 0) // smallest) // shard))
    spread = pieces.withColumn("shard", F.pmod(F.xxhash64("key", "part"), F.lit(shards)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "key", "part"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        capacity = int(pdf["capacity"].iloc[0])
        where = pack(pdf["n"].to_numpy(), capacity, combinations(min(BINS, capacity)))
        fill = np.bincount(where, weights=pdf["n"].to_numpy())
        pdf["container"] = f"{pdf['shard'].iloc[0]}-" + pd.Series(where).astype(str)
        pdf["unused"] = (capacity - fill[where]).astype("int32")
        return pdf.rename(columns={"n": "n_tokens"})[["size_id", "container", "key", "part", "first_token", "n_tokens", "unused"]]

    return spread.groupBy("size_id", "shard").applyInPandas(one, "size_id int, container string, key bigint, part int, first_token int, n_tokens int, unused int")

"""Evaluation texts leaking into training text (problem 9).

A leak is a run of ``n`` consecutive words of a test text inside a document.
Projections on latent dimensions rank paraphrases but lose such runs (README),
so the search is over the runs themselves: every run of every document is
hashed from the hashes of its words and meets the runs of the test texts. Words
are hashed once on the JVM, runs come from them in numpy, one pass per batch. A
filter of constant size keeps in their task the runs that no test text has; it
may let others through, never hold one back, and an exact join decides.

Leaks without such a run, of words left out, put in or replaced, are the work of
``near_leaks``: a randomised SVD of the TF-IDF of passages, those near a test
text by the cosine, their longest common subsequence of words, and how much of
the answer stands in the document.

Defined results: null and short texts leak nothing; documents without an id are
left out; an id that occurs twice counts once; items that share a text are all
reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pothi.llm.runs import bits_of, pieces, runs_of, word_hashes

RUN = 15
MOST_RUNS = 4_000_000
SALT = 8


def _hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), word_hashes(F.col(text)).alias("words"))


def leaks(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_texts: list[str], n: int = RUN, most_runs: int = MOST_RUNS) -> DataFrame:
    """id, item, part, hits, runs: how many of the runs of each text of an item a document holds.

    The filter is made for ``most_runs`` runs; with more of them it lets more through.
    """
    parts = [
        _hashed(items, item_key, c).mapInArrow(runs_of(n, None), "id bigint, run bigint").distinct().select(F.col("id").alias("item"), F.lit(c).alias("part"), "run")
        for c in item_texts
    ]
    wanted = parts[0]
    for p in parts[1:]:
        wanted = wanted.unionByName(p)
    known = bits_of(wanted, "run", 1 << max(0, (most_runs // 4).bit_length()))
    found = _hashed(docs, doc_key, doc_text).mapInArrow(runs_of(n, known), "id bigint, run bigint")
    # A run that many documents have is joined in parts.
    spread = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    met = found.distinct().withColumn("salt", F.pmod("id", F.lit(SALT)).cast("int")).join(spread, ["run", "salt"])
    total = wanted.groupBy("item", "part").agg(F.count("*").alias("runs"))
    hits = met.groupBy("id", "item", "part").agg(F.count("*").alias("hits"))
    return hits.join(total, ["item", "part"]).select("id", "item", "part", "hits", "runs")


# Words of a window of a test text and of a passage of a document, which holds any such window whole, and of a step of both.
WINDOW, PASSAGE, STEP = 40, 60, 20
# Words fall into so many features; dimensions of the projection and those the sketch has more; parts in which a sketch is summed.
FEATURES, RANK, MORE, SLICES = 1 << 15, 64, 16, 32
NEAR, LEAST = 0.7, 0.6


def _windows(words: np.ndarray, width: int) -> list[np.ndarray]:
    """Windows of ``width`` words, ``STEP`` apart, the last one at the end."""
    if len(words) <= width:
        return [words]
    return [words[at : at + width] for at in [*range(0, len(words) - width, STEP), len(words) - width]]


def _features(windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and count of windows of hashes of words, in the order of rows."""
    row = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
    both, n = np.unique(row * FEATURES + (np.concatenate(windows).view(np.uint64) >> np.uint64(20)).astype(np.int64) % FEATURES, return_counts=True)
    return both // FEATURES, both % FEATURES, n


def _weighed(windows: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and TF-IDF of windows, of length one."""
    row, feature, n = _features(windows)
    value = ((1 + np.log(n)) * idf[feature]).astype(np.float32)
    norm = np.sqrt(np.bincount(row, value.astype(np.float64) ** 2, len(windows)))
    return row, feature, value / np.maximum(norm, 1e-12)[row].astype(np.float32)


def _projected(row: np.ndarray, feature: np.ndarray, value: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Rows that aren't empty, projected."""
    return np.add.reduceat(value[:, None] * basis[feature], np.flatnonzero(np.diff(row, prepend=-1)))


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]]:
    """Passages of the documents of batches(id, words), some thousand words at a time, and the row of each."""
    for batch in pieces(batches, "words"):
        lists = batch.column("words")
        starts, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        each = [(i, w) for i in range(batch.num_rows) if starts[i + 1] > starts[i] for w in _windows(values[starts[i] : starts[i + 1]], PASSAGE)]
        for at in range(0, len(each), 1024):
            of, windows = zip(*each[at : at + 1024])
            yield batch, list(windows), np.array(of)


def _idf(docs: DataFrame) -> np.ndarray:
    """Of each feature by the passages of docs(id, words) that have it; the driver gets a row a feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for _, windows, _ in _passages(batches):
            total[:FEATURES] += np.bincount(_features(windows)[1], minlength=FEATURES)
            total[FEATURES] += len(windows)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    got = docs.mapInArrow(count, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(FEATURES + 1)
    df[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return np.log((1 + df[FEATURES]) / (1 + df[:FEATURES])) + 1


def _times(docs: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A times ``basis``, of the matrix A of all passages of docs(id, words).

    Each task sums its passages; the sums, as large as ``basis``, are added up in
    slices, so that the driver gets one of them.
    """
    shared = docs.sparkSession.sparkContext.broadcast((idf, basis))
    width = basis.shape[1]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis = shared.value
        total = np.zeros(basis.shape, np.float32)
        for _, windows, _ in _passages(batches):
            row, feature, value = _weighed(windows, idf)
            order = np.argsort(feature, kind="stable")
            rows = _projected(row, feature, value, basis)
            first = np.flatnonzero(np.diff(feature[order], prepend=-1))
            total[feature[order][first]] += np.add.reduceat(value[order, None] * rows[row[order]], first)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([x.tobytes() for x in np.split(total, SLICES)], pa.binary())], names=["at", "part"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"at": table.column("at")[:1], "part": pa.array([sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table.column("part").to_pylist()).astype(np.float32).tobytes()], pa.binary())})

    # As many sums as tasks run at a time, not as the input has splits.
    few = docs.coalesce(max(1, 2 * docs.sparkSession.sparkContext.defaultParallelism))
    got = few.mapInArrow(multiply, "at int, part binary").groupBy("at").applyInArrow(add, "at int, part binary").toArrow()
    out = np.zeros((SLICES, FEATURES // SLICES, width), np.float32)
    for at, x in zip(got.column("at").to_pylist(), got.column("part").to_pylist()):
        out[at] = np.frombuffer(x, np.float32).reshape(-1, width)
    return out.reshape(FEATURES, width)


def latent(docs: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The first ``rank`` right singular vectors of the passages of docs(id, words), by a randomised SVD: a sketch by random vectors, one step of iteration, the exact SVD in what they span."""
    start = np.random.default_rng(0).standard_normal((FEATURES, rank + MORE)).astype(np.float32)
    basis = np.linalg.qr(_times(docs, idf, start))[0].astype(np.float32)
    inner = basis.T.astype(np.float64) @ _times(docs, idf, basis)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    return (basis @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


def common_words(a: list[int], places: dict[int, int], n: int) -> int:
    """Length of the longest common subsequence of ``a`` and a text of ``n`` words given by the bits of each word's places."""
    full = open_ = (1 << n) - 1
    for w in a:
        hit = open_ & places.get(w, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return n - open_.bit_count()


def near_leaks(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_texts: list[str], answer: str, near: float = NEAR, least: float = LEAST) -> DataFrame:
    """id, item, part, common, words, answered: documents with a passage that says a window of an item's text again, by its best window.

    Passages of ``PASSAGE`` words and windows of ``WINDOW`` are projected on the
    latent dimensions of the passages. All passages, not only some nearest ones,
    of a cosine of ``near`` with a window are compared with it, word by word: the
    longest common subsequence has to hold ``least`` of its ``words``.
    ``answered`` is how much of the distinct words of ``answer`` the document has,
    null without one. Items (test sets, which don't grow with the corpus) go to
    all tasks; texts of fewer than ``RUN`` words aren't looked for. What is near
    by its words only, below that cosine, is not found.
    """
    texts = _hashed(docs, doc_key, doc_text)
    parts = [_hashed(items, item_key, c).select("id", F.lit(c).alias("part"), "words") for c in item_texts]
    said = parts[0]
    for p in parts[1:]:
        said = said.unionByName(p)
    asked = [(r.id, r.part, w) for r in said.distinct().collect() if len(r.words) >= RUN for w in _windows(np.array(r.words, np.int64), WINDOW)]
    answers: dict[int, set[int]] = {}
    for r in _hashed(items, item_key, answer).collect():
        answers.setdefault(r.id, set()).update(r.words)
    kind = "id bigint, item bigint, part string, common int, words int, answered double"
    if not asked:
        return docs.sparkSession.createDataFrame([], kind)
    idf = _idf(texts)
    basis = latent(texts, idf)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    wanted = unit(_projected(*_weighed([w for _, _, w in asked], idf), basis))
    places = []
    for _, _, w in asked:
        bits: dict[int, int] = {}
        for i, x in enumerate(w.tolist()):
            bits[x] = bits.get(x, 0) | 1 << i
        places.append(bits)
    shared = docs.sparkSession.sparkContext.broadcast((idf, basis, wanted, [(i, p, len(w)) for i, p, w in asked], places, answers))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis, wanted, names, places, answers = shared.value
        for batch, windows, of in _passages(batches):
            cosine = unit(_projected(*_weighed(windows, idf), basis)) @ wanted.T
            out = []
            for passage, q in zip(*np.nonzero(cosine >= near)):
                item, part, n = names[q]
                common = common_words(windows[passage].tolist(), places[q], n)
                if common >= least * n:
                    words = answers.get(item)
                    row = int(of[passage])
                    held = None if not words else len(words & set(batch.column("words")[row].as_py())) / len(words)
                    out.append((batch.column("id")[row].as_py(), item, part, common, n, held))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()))], names=["id", "item", "part", "common", "words", "answered"])

    found = texts.mapInArrow(search, kind)
    best = F.max(F.struct((F.col("common") / F.col("words")).alias("s"), "common", "words", "answered")).alias("b")
    return found.groupBy("id", "item", "part").agg(best).select("id", "item", "part", "b.common", "b.words", F.round("b.answered", 6).alias("answered"))

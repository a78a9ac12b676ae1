"""What a task holds at once doesn't grow with batches, hot anchors or the pairs of a block."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from pothi.llm import runs


class Caught:
    """Stands in for a DataFrame and keeps the function that tasks would run."""

    def __init__(self):
        self.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))
        self.select = self.groupBy = lambda *_: self
        self.mapInArrow = self.applyInArrow = lambda f, _: f


def test_batches_are_taken_in_pieces():
    rows, each = 10_000, 300
    words = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * each), pa.array(np.arange(rows * each)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), words], names=["id", "words"])
    parts = list(runs.pieces(iter([batch, batch.slice(0, 0)]), "words"))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert max(p.num_rows for p in parts) * each <= runs.PIECE


def _split_anchors():
    """A hundred classes of ten runs, all in buckets so loaded that their anchors are split into 10,000 parts."""
    n, each, hot = 100, 10, 2000
    load = np.zeros(1 << 10, np.int64)
    load[:each] = hot * 10_000
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * each), pa.array(np.tile(np.arange(each), n)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), lists, pa.array([b""] * n, pa.binary())], names=["cls", "runs", "counts"])
    return runs.anchored(Caught(), load, 0.5, hot, 1 << 30)(iter([batch])), n, each


def test_split_anchors_leave_a_task_some_at_a_time():
    out, n, each = _split_anchors()
    sizes = {1: [], 2: []}
    for b in out:
        if b.num_rows:
            sizes[b.column("side")[0].as_py()] += [sum(len(x.as_py()) // 4 for x in b.column("anchors"))]
    assert sum(sizes[1]) == n * each and sum(sizes[2]) == n * each * 10_000
    assert max(sizes[2]) <= 1 << 18


def test_pairs_of_a_block_leave_a_task_some_at_a_time():
    n = 2000
    number = np.full(n, 1, np.uint32).tobytes()
    cells = [number[i * 4 : i * 4 + 4] for i in range(n)]
    table = {"block": np.zeros(n, np.int32), "cls": np.arange(n), "n": np.full(n, 10, np.int32), "side": np.zeros(n, np.int32), "anchors": pa.array(cells, pa.binary()), "places": pa.array([b"\0\0\0\0"] * n, pa.binary())}
    out = list(runs.meetings(Caught(), 0.5)(iter(pa.table(table).to_batches())))
    assert sum(b.num_rows for b in out) == n * (n - 1) // 2 and max(b.num_rows for b in out) <= 1 << 18


def test_the_plan_of_verdicts_holds_no_filter(spark):
    from pothi.llm.p10_truncation import truncation

    docs = spark.createDataFrame([(i, f"The lamp burns by the river {i}. It is lit in the evening" + "." * (i % 2), "s") for i in range(12)], "doc_id long, text string, source string")
    found = truncation(docs, "doc_id", "text", "source")
    assert "subquery" not in found._jdf.queryExecution().executedPlan().toString().lower() and found.count() == 12

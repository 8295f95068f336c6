"""The pair fold of word co-occurrences: bounded whatever an Arrow batch holds, the same with and without sent words."""
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from maskfold.operators import words as W


class Rows:
    """Takes the function that tasks run out of the plan."""
    def mapInArrow(self, run, _):
        self.run = run
        return self

    select = where = groupBy = agg = applyInArrow = lambda self, *_: self


def test_a_full_arrow_batch_is_folded_in_parts(spark):
    draw = np.random.default_rng(1)
    lists = pa.ListArray.from_arrays(np.arange(0, 2_000_001, 500), pa.array([f"w{k}" for k in range(5000)]).take(pa.array(draw.integers(0, 5000, 2_000_000))))
    known = type("Sent", (), {"value": pa.array([f"w{k}" for k in range(5000)])})
    for pairs in (lambda rows: W._pairs(rows, "ws", 4), lambda rows: W._packed_pairs(rows, "ws", 4, known, 2_000_000)):
        rows = Rows()
        pairs(rows)
        tracemalloc.start()
        try:
            made = sum(b.num_rows for b in rows.run([pa.RecordBatch.from_arrays([lists], names=["ws"])]))
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert made and peak < 220e6


def test_words_are_numbered_in_the_task_or_by_joins(spark, monkeypatch):
    draw = np.random.default_rng(6)
    docs = [([f"w{int(k)}" for k in draw.zipf(1.6, n) if k < 400],) for n in (1, 2, 127, 128, 129, 132, 133, 300, 900)]
    df = spark.createDataFrame(docs, "ws array<string>").repartition(3)
    real, found = W._pairs, []
    monkeypatch.setattr(W, "_pairs", lambda *a: found.append(1) or real(*a))
    monkeypatch.setattr(W, "GROUP", 200)  # many groups

    def lengths():
        return {r.word: round(float(np.linalg.norm(r.v)), 9) for r in W.fitted_vectors(df, F.col("ws"), d=3, least=3).collect()}

    one = lengths()
    assert len(one) > 10 and not found
    monkeypatch.setattr(W, "MAX_COLUMNS", 2 * len(one))  # two of the three columns at once
    assert lengths() == one and not found
    monkeypatch.setattr(W, "MAX_SENT", 0)
    assert lengths() == one and found


def test_packed_numbers_come_back():
    for x in (np.array([], np.int64), np.array([0]), np.array([5, 0, 2 ** 62, 255, 256])):
        assert W._spread(W._squeezed(x), len(x)).tolist() == x.tolist()

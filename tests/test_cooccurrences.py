"""Co-occurrences of words folded in slices of documents."""
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from maskfold.operators import words as W


def test_slices_count_every_pair_once(spark):
    rng = np.random.default_rng(3)
    docs = [[f"w{k}" for k in rng.integers(0, 9, n)] for n in (0, 1, 2, 5, 511, 512, 513, 514, 516, 1024, 1030)]
    plain = Counter()
    for ws in docs:
        for i, w in enumerate(ws):
            for j in range(1, 5):
                if i + j < len(ws):
                    plain[w, ws[i + j]] += 12 // j
                    plain[ws[i + j], w] += 12 // j
    df = spark.createDataFrame([(ws,) for ws in docs], "ws array<string>").unionByName(
        spark.createDataFrame([(None,)], "ws array<string>"))
    # a pair leaves a task as one row for both orders
    assert W._pairs(df, "ws", 4).where("a > b").count() == 0
    got = {(r.word, r.context): r.weight for r in W.cooccurrences(df).collect()}
    assert got == {k: v / 12 for k, v in plain.items()}


def test_fitted_vectors_reproduce_the_decomposition(spark):
    rng = np.random.default_rng(4)
    docs = [[f"t{t}x{k}" for k in rng.integers(0, 6, 60)] for t in range(3) for _ in range(8)]
    df = spark.createDataFrame([(ws,) for ws in docs], "ws array<string>")
    got = {r.word: np.array(r.v) for r in W.fitted_vectors(df, F.col("ws"), d=4, least=1).collect()}
    weight = Counter()
    for ws in docs:
        for i in range(len(ws)):
            for j in range(1, 5):
                if i + j < len(ws):
                    weight[ws[i], ws[i + j]] += 1 / j
                    weight[ws[i + j], ws[i]] += 1 / j
    names = sorted({a for a, _ in weight})
    m = np.array([[weight[a, b] for b in names] for a in names])
    s = m.sum(1)
    with np.errstate(divide="ignore"):
        m = np.maximum(np.log(m * m.sum() / np.outer(s, s)), 0)
    assert sorted(got) == names
    v = np.array([got[n] for n in names])
    # the three topics are the leading directions
    values = np.sort(np.abs(np.linalg.eigvalsh(m)))[::-1]
    assert np.allclose(np.sort(np.linalg.norm(v, axis=0) ** 2)[::-1][:3], values[:3], rtol=0.02)

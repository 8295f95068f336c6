"""Word vectors: nearest entries, pooled documents and fitted vectors against dense numpy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from maskfold.functions import text as TX
from maskfold.operators.words import fitted_vectors, nearest_entries, pooled_vectors, word_counts


def vectors(spark, rows, key="word"):
    return spark.createDataFrame([(w, None if v is None else [float(c) for c in v], 1) for w, v in rows], f"{key} string, v array<double>, way int") \
        .repartition(2)


def brute(queries, entries, excluded):
    out = {}
    for q, v in queries:
        best = None
        for w, e in entries:
            if not v or not e or not any(v) or not any(e) or (q, w) in excluded:
                continue
            c = round(float(np.dot(v, e) / np.linalg.norm(v) / np.linalg.norm(e)), 9)
            if best is None or (-c, w) < best:
                best = (-c, w)
        out[q] = None if best is None else (best[1], -best[0])
    return out


@pytest.mark.parametrize("with_exclusions", [False, True])
def test_nearest_entries(spark, with_exclusions):
    draw = np.random.default_rng(3)
    entries = [(f"w{i:03}", draw.integers(-2, 3, 3).tolist()) for i in range(150)]  # many equal directions, some zero
    entries += [("null", None), ("empty", []), ("w000x", [2 * c for c in entries[0][1]])]
    queries = [(w, v) for w, v in entries[:40]] + [("zero", [0, 0, 0]), ("nothing", None), ("far", [1e9, 1, 0])]
    excluded = {(q, q) for q, _ in queries} | {(q, "w001") for q, _ in queries} if with_exclusions else set()
    frame = spark.createDataFrame(sorted(excluded), "query string, word string") if excluded else None
    got = {r.query: None if r.word is None else (r.word, round(r.cosine, 9)) for r in nearest_entries(
        vectors(spark, queries, "query"), vectors(spark, entries), frame).collect()}
    assert got == brute(queries, entries, excluded)


def test_entries_all_excluded(spark):
    q, e = vectors(spark, [("a", [1, 0])], "query"), vectors(spark, [("x", [1, 0]), ("y", [0, 1])])
    both = spark.createDataFrame([("a", "x"), ("a", "y")], "query string, word string")
    assert [tuple(r) for r in nearest_entries(q, e, both).collect()] == [("a", None, None)]


def test_word_counts_and_pooling(spark):
    docs = [(1, "a b a c  a"), (2, ""), (3, None), (4, "zz zz"), (5, "b")]
    table = [("a", [3, 4]), ("b", [0, 2]), ("c", [0, 0])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    counts = word_counts(d, TX.words(F.coalesce("text", F.lit(""))))
    assert sorted(map(tuple, counts.collect())) == [(1, "a", 3), (1, "b", 1), (1, "c", 1), (4, "zz", 2), (5, "b", 1)]
    got = {r.doc_id: (r.n_words, r.n_known, [round(x, 9) for x in r.x]) for r in pooled_vectors(counts, vectors(spark, table), 2).collect()}
    assert got == {1: (5, 5, [0.36, 0.68]), 5: (1, 1, [0.0, 1.0])}
    plain = {r.doc_id: r.x for r in pooled_vectors(counts, vectors(spark, table), 2, normalize=False).collect()}
    assert plain[1] == [9 / 5, 14 / 5]


def test_fitted_vectors_span_the_leading_space(spark):
    draw = np.random.default_rng(9)
    topics = [[f"t{k}w{i}" for i in range(8)] for k in range(3)]
    docs = [(i, " ".join(draw.choice(topics[i % 3], 30))) for i in range(60)] + [(99, "rare words here"), (100, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.word: np.array(r.v) for r in fitted_vectors(d, TX.words("text"), d=6, least=4, rounds=12).collect()}
    assert set(got) == {w for t in topics for w in t}
    # the same matrix, dense
    words = sorted(got)
    at = {w: i for i, w in enumerate(words)}
    m = np.zeros((len(words), len(words)))
    for _, text in docs[:60]:
        ws = text.split()
        for i, w in enumerate(ws):
            for j in range(1, 5):
                if i + j < len(ws):
                    m[at[w], at[ws[i + j]]] += 1 / j
                    m[at[ws[i + j]], at[w]] += 1 / j
    with np.errstate(divide="ignore"):
        pmi = np.maximum(np.log(m * m.sum() / np.outer(m.sum(1), m.sum(0))), 0)
    u, s, _ = np.linalg.svd(pmi)
    x = np.stack([got[w] for w in words])
    gram = (u[:, :3] * s[:3]) @ u[:, :3].T  # three topics: three large values
    lead = np.linalg.norm(x, axis=0).argsort()[::-1][:3]
    assert np.linalg.norm(x[:, lead] @ x[:, lead].T - gram) < 0.02 * np.linalg.norm(gram)
    same = np.mean([np.dot(got[a], got[b]) / np.linalg.norm(got[a]) / np.linalg.norm(got[b]) for a in topics[0] for b in topics[0]])
    other = np.mean([np.dot(got[a], got[b]) / np.linalg.norm(got[a]) / np.linalg.norm(got[b]) for a in topics[0] for b in topics[1]])
    assert same > 0.7 > 0.2 > other

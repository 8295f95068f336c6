"""Blocked kNN / LOF / ECOD against brute force; MMD properties; stats tails."""
import math

import numpy as np
import pytest
import pandas as pd
from pyspark.sql import functions as F

from maskfold.operators.ecod import ecod_scores
from maskfold.operators.knn import knn, lof_scores
from maskfold.operators.mmd import closed_form_bandwidths, mmd_masks
from maskfold.plans.q_report import two_sided_t


def _frame(spark, X, start=0):
    return spark.createDataFrame([(start + i, list(map(float, x))) for i, x in enumerate(X)], "row_id long, x array<double>")


def test_knn_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    Q, R = rng.normal(size=(70, 5)), rng.normal(size=(90, 5))
    got = knn(_frame(spark, Q), _frame(spark, R, 1000), 4, block_rows=16).toPandas()
    D = np.sqrt(((Q[:, None] - R[None]) ** 2).sum(-1))
    for i in range(len(Q)):
        exp = 1000 + np.argsort(D[i], kind="stable")[:4]
        g = got[got.qid == i].sort_values("nn_rank")
        assert list(g.rid) == list(exp)


def test_knn_masks_project(spark):
    rng = np.random.default_rng(1)
    Q, R = rng.normal(size=(20, 4)), rng.normal(size=(30, 4))
    masks = [[1, 1, 0, 0], [0, 0, 1, 1]]
    got = knn(_frame(spark, Q), _frame(spark, R, 100), 1, masks=masks, block_rows=8).toPandas()
    for j, m in enumerate(masks):
        w = np.array(m)
        D = (((Q[:, None] - R[None]) ** 2) * w).sum(-1)
        for i in range(len(Q)):
            assert got[(got.qid == i) & (got.subspace_id == j)].rid.iloc[0] == 100 + int(np.argmin(D[i]))


def test_lof_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    T, S, k = rng.normal(size=(60, 3)), rng.normal(size=(15, 3)) * 2, 5
    got = lof_scores(_frame(spark, T), _frame(spark, S, 500), k, block_rows=16).toPandas().set_index("row_id")
    Dtt = np.sqrt(((T[:, None] - T[None]) ** 2).sum(-1))
    np.fill_diagonal(Dtt, np.inf)
    nn = np.argsort(Dtt, 1, kind="stable")[:, :k]
    kd = np.take_along_axis(Dtt, nn, 1)[:, -1]
    reach = np.maximum(kd[nn], np.take_along_axis(Dtt, nn, 1))
    lrd = 1 / (reach.mean(1) + 1e-10)
    Dst = np.sqrt(((S[:, None] - T[None]) ** 2).sum(-1))
    for i in range(len(S)):
        nb = np.argsort(Dst[i], kind="stable")[:k]
        lp = 1 / (np.maximum(kd[nb], Dst[i, nb]).mean() + 1e-10)
        assert abs(got.loc[500 + i, "score"] - lrd[nb].mean() / lp) < 1e-9


def test_ecod_equals_numpy(spark):
    rng = np.random.default_rng(3)
    X = np.round(rng.gamma(2, size=(80, 3)), 1)
    got = ecod_scores(_frame(spark, X), ["row_id"]).toPandas().set_index("row_id")
    n = len(X)
    left = np.stack([(X[:, j][None] <= X[:, j][:, None]).sum(1) / n for j in range(3)], 1)
    right = np.stack([(X[:, j][None] >= X[:, j][:, None]).sum(1) / n for j in range(3)], 1)
    ol, orr = -np.log(left), -np.log(right)
    mu = X.mean(0)
    skew = ((X - mu) ** 3).mean(0)
    oa = np.where(skew < 0, ol, orr)
    exp = np.maximum(np.maximum(ol.sum(1), orr.sum(1)), oa.sum(1))
    assert np.allclose(got.sort_index()["score"].to_numpy(), exp, atol=1e-9)


def test_mmd_properties(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(50, 4))
    df = _frame(spark, X)
    masks = spark.createDataFrame([(0, [1, 1, 1, 1], 0.5), (1, [1, 0, 1, 0], 0.5)], "subspace_id int, mask array<int>, proba double")
    r = {row["subspace_id"]: row for row in mmd_masks(df, masks, block_rows=16).collect()}
    assert abs(r[0]["mmd2"]) < 1e-9          # u = 1: u*X = X
    assert r[1]["mmd2"] > 0
    # closed-form bandwidth equals the brute-force pooled off-diagonal mean
    Y = X * np.array([1, 0, 1, 0])
    Z = np.vstack([X, Y])
    D = ((Z[:, None] - Z[None]) ** 2).sum(-1)
    B = len(X)
    brute = (D.sum() - 0) / (4 * B * B - 2 * B)
    bw = {r["subspace_id"]: r["bandwidth"] for r in closed_form_bandwidths(df, masks).collect()}[1]
    assert abs(bw - brute) < 1e-9


def test_two_sided_t(spark):
    # quantiles of Student's t at 5 %, odd and even degrees of freedom
    rows = [(12.706204736432095, 1), (4.302652729911275, 2), (3.182446305284263, 3), (2.2281388519649385, 10),
            (2.0301079282503425, 35), (0.0, 4)]
    got = [r[0] for r in spark.createDataFrame(rows, "t double, df int").coalesce(1)
           .select(two_sided_t(F.col("t"), F.col("df").cast("double"))).collect()]
    assert all(abs(p - 0.05) < 1e-9 for p in got[:-1]) and got[-1] == 1.0


def test_missing_scores_and_components(spark):
    from maskfold.operators.ecod import ecod_columns
    from maskfold.operators.metrics import binary_metrics
    rows = [(0.1, 0), (0.9, 1), (None, 1), (float("nan"), 0), (0.4, None)]
    scored = spark.createDataFrame(rows, "score double, outlier int")
    with pytest.raises(Exception, match="missing"):
        binary_metrics(scored).collect()
    kept = binary_metrics(scored, nulls="drop").first()
    assert kept["n_test"] == 2 and kept["auc"] == 1.0
    x = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, None]), (2, [None, None]), (3, [3.0, 2.0])], "row_id long, x array<double>")
    with pytest.raises(Exception, match="missing"):
        ecod_scores(x).collect()
    got = {r["row_id"]: r["score"] for r in ecod_scores(x, nulls="neutral").collect()}
    assert set(got) == {0, 1, 2, 3} and got[2] == 0.0 and got[3] > got[1]
    wide = x.select("row_id", F.get("x", 0).alias("a"), F.get("x", 1).alias("b"))
    wide_got = {r["row_id"]: r["score"] for r in ecod_columns(wide, ["a", "b"], keep=["row_id"], nulls="neutral").collect()}
    assert all(abs(wide_got[i] - got[i]) < 1e-12 for i in got)


def test_hash_takes_any_id_and_seeds_are_independent(spark):
    from maskfold.functions.hashing import h
    ids = spark.range(4000).select((F.col("id") * 3 + F.lit(2**62)).alias("id"))
    draws = ids.select(*[(h("id", s) % 5 == 0).alias(f"s{s}") for s in (0, 1, 2)]).collect()
    size = [sum(r[k] for r in draws) for k in range(3)]
    assert all(700 < n < 900 for n in size)
    for a, b in ((0, 1), (0, 2), (1, 2)):
        assert 110 < sum(r[a] and r[b] for r in draws) < 215  # near 4 % of the rows



def test_column_normalize_and_hash_sample(spark):
    from maskfold.operators.mmd import column_l2_normalize, hash_sample
    rng = np.random.default_rng(5)
    X = rng.normal(size=(30, 3))
    X[:, 2] = 0.0
    got = column_l2_normalize(_frame(spark, X)).orderBy("row_id").toPandas()
    G = np.stack(got["x"].to_numpy())
    exp = X / np.where(np.linalg.norm(X, axis=0) == 0, 1, np.linalg.norm(X, axis=0))
    assert np.allclose(G, exp)
    a = [r["row_id"] for r in hash_sample(_frame(spark, X), 10, seed=1).collect()]
    b = [r["row_id"] for r in hash_sample(_frame(spark, X).repartition(5), 10, seed=1).collect()]
    assert len(a) == 10 and sorted(a) == sorted(b)


def test_distance_has_one_plan_for_every_mask_table(spark):
    from maskfold.operators.distance import subspace_distance
    rng = np.random.default_rng(9)
    X, U = rng.normal(size=(12, 5)), rng.integers(0, 2, (70, 5))
    masks = spark.createDataFrame([(j, u.tolist(), 1 / 70) for j, u in enumerate(U)], "subspace_id int, mask array<int>, proba double")
    for cells in (10_000, 40):  # 40 cells: nine chunks, some of them perhaps empty
        got = {r["row_id"]: r["distance"] for r in subspace_distance(_frame(spark, X), masks, 5, max_cells=cells).collect()}
        want = np.linalg.norm(X[:, None, :] * (1 - U[None]), axis=2).min(1) / math.sqrt(5)
        assert all(abs(got[i] - want[i]) < 1e-12 for i in range(12))


def test_mmd_of_soft_masks_in_blocks_and_chunks(spark, monkeypatch):
    import maskfold.operators.mmd as M
    monkeypatch.setattr(M, "TILE", 7)
    rng = np.random.default_rng(11)
    X = rng.normal(size=(60, 5))
    us = [[1, 0, 1, 1, 0], [0.3, 1, 0, 0.5, 2], [0, 0, 0, 0, 0], [1, 1, 1, 1, 1]]
    masks = spark.createDataFrame([(j, [float(c) for c in u], 0.25) for j, u in enumerate(us)], "subspace_id int, mask array<double>, proba double")
    monkeypatch.setattr(M, "mask_chunks", lambda m: ([(r["subspace_id"], r["mask"])] for r in m.orderBy("subspace_id").collect()))
    got = {r["subspace_id"]: r for r in mmd_masks(_frame(spark, X), masks, "rq_mix_linear", block_rows=16).collect()}
    kernel = lambda a, b: M.KERNELS["rq_mix_linear"](((a[:, None] - b[None]) ** 2).sum(-1), None, a @ b.T).mean()
    for j, u in enumerate(us):
        Y = X * np.array(u)
        for name, want in (("kxx", kernel(X, X)), ("kxy", kernel(X, Y)), ("kyy", kernel(Y, Y))):
            assert abs(got[j][name] - want) < 1e-9


def test_mask_chunks_hold_every_mask_once(spark):
    from maskfold.operators.mmd import mask_chunks
    masks = spark.createDataFrame([(j, [1] * 10, 0.1) for j in range(50)], "subspace_id int, mask array<int>, proba double")
    chunks = list(mask_chunks(masks, max_cells=100))
    assert len(chunks) > 3 and sorted(s for c in chunks for s, _ in c) == list(range(50))


def test_fixtures_in_mmd_and_distance(spark):
    from maskfold.functions import text as TX
    from maskfold.operators.distance import subspace_distance
    from maskfold.sources.fixtures import correlated_gaussian, plane_axis_mixture, shifted_patterns
    masks = spark.createDataFrame([(0, [1, 1, 0], 0.5), (1, [0, 0, 1], 0.5)], "subspace_id int, mask array<int>, proba double")
    plane = plane_axis_mixture(spark, 200, 1.0)
    r = {x["subspace_id"]: x["mmd2"] for x in mmd_masks(plane, masks).collect()}
    assert abs(r[0]) < 1e-9 < 0.05 < r[1]  # the plane is its own projection
    both = subspace_distance(plane_axis_mixture(spark, 100, 0.5), masks, 3).agg(F.max("distance")).first()[0]
    assert both < 1e-12  # every row lies in one of the two subspaces
    x = correlated_gaussian(spark, 300)
    pairs = [np.corrcoef(np.array([[q.x[i], q.x[j]] for q in x.collect()]).T)[0, 1] for i, j in ((0, 1), (3, 4), (0, 3), (5, 6))]
    assert min(pairs[:2]) > 0.95 and max(map(abs, pairs[2:])) < 0.3
    words = shifted_patterns(spark, ["a b", "c"], 3).select("row_id", F.size(TX.words("x")).alias("n")).orderBy("row_id").collect()
    assert [r.n for r in words] == [2, 2, 2, 2, 2, 2]

"""Ranking metrics and running totals against brute force (ties, hot values)."""
import numpy as np
import pandas as pd

from maskfold.operators.cumulative import running_totals
from maskfold.operators.metrics import binary_metrics


def brute(scores, y, q=0.8):
    pos, neg = scores[y == 1], scores[y == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    order = np.unique(scores)[::-1]
    ap, P = 0.0, y.sum()
    for t in order:
        sel = scores >= t
        at = (scores == t)
        tp = (y[sel] == 1).sum()
        ap += (y[at] == 1).sum() / P * tp / sel.sum()
    thr = np.quantile(scores, q)
    pred = scores > thr
    tp = (pred & (y == 1)).sum()
    fp = (pred & (y == 0)).sum()
    fn = ((~pred) & (y == 1)).sum()
    f1 = 2 * tp / (2 * tp + fp + fn) if (2 * tp + fp + fn) else 0.0
    return auc, ap, f1


def test_metrics_match_brute_force(spark):
    rng = np.random.default_rng(1)
    n = 600
    s = np.round(rng.normal(size=n), 1)  # many ties
    s[:200] = 0.0                        # one hot value holding a third of the rows
    y = (rng.random(n) < 0.3).astype(int)
    g = np.where(np.arange(n) % 2 == 0, "a", "b")
    df = spark.createDataFrame(pd.DataFrame({"g": g, "score": s, "outlier": y}))
    out = {r["g"]: r for r in binary_metrics(df, ["g"], digits=None, n_buckets=4).collect()}
    for key in ("a", "b"):
        m = g == key
        auc, ap, f1 = brute(s[m], y[m])
        assert abs(out[key]["auc"] - auc) < 1e-12
        assert abs(out[key]["prauc"] - ap) < 1e-12
        assert abs(out[key]["f1"] - f1) < 1e-12


def test_auc_of_flipped_scores(spark):
    rng = np.random.default_rng(2)
    s = rng.random(300)
    y = (rng.random(300) < 0.4).astype(int)
    a = binary_metrics(spark.createDataFrame(pd.DataFrame({"score": s, "outlier": y})), digits=None).first()["auc"]
    b = binary_metrics(spark.createDataFrame(pd.DataFrame({"score": 1 - s, "outlier": y})), digits=None).first()["auc"]
    assert abs(a + b - 1) < 1e-12


def test_running_totals_exact_across_buckets(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 500, 2000)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 2000), "v": v}).groupby(["k", "v"]).size().reset_index(name="c")
    df = spark.createDataFrame(pdf)
    got = running_totals(df, ["k"], "v", ["c"], n_buckets=8).toPandas().sort_values(["k", "v"])
    pdf = pdf.sort_values(["k", "v"])
    exp = pdf.groupby("k")["c"].cumsum().to_numpy()
    assert (got["c_cum"].to_numpy() == exp).all()
    assert (got["c_tot"].to_numpy() == pdf.groupby("k")["c"].transform("sum").to_numpy()).all()

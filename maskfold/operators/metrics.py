"""Exact ranking metrics (AGG-19..22, AGG-36) as distributed aggregates.

Scores are first collapsed to one row per distinct (group, score) with positive
and negative counts; running counts come from ``running_totals`` (bucketed,
never one task per group).  From them:

* ROC AUC  = sum p * (cn - n/2) / (P * N)          (Mann-Whitney with ties)
* AP       = sum p * tp / (tp + fp) / P            (step-wise, descending)
* F1 at the q-quantile threshold (linear interpolation, strict '>')
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cumulative import running_totals


def binary_metrics(scored: DataFrame, group_cols=(), score_col: str = "score",
                   label_col: str = "outlier", q: float = 0.8, n_buckets: int | None = None,
                   digits: int | None = 6, nulls: str = "error") -> DataFrame:
    """Null and NaN scores and null labels raise an error, or are left out with nulls="drop".
    One row per group: auc, prauc, f1, n_test, n_outlier, pct_outlier, pct_inlier."""
    g = list(group_cols)
    y = F.col(label_col).cast("long")
    value = F.col(score_col)
    if nulls == "drop":
        scored = scored.where(value.isNotNull() & ~F.isnan(value.cast("double")) & y.isNotNull())
    else:  # a missing score or label has no rank: say so instead of ranking it
        value = F.when(value.isNull() | F.isnan(value.cast("double")) | y.isNull(),
                       F.raise_error(F.lit("a score or label is missing; pass nulls='drop' to leave such rows out"))).otherwise(value)
    agg = scored.groupBy(*g, value.alias("score")).agg(
        F.sum(y).alias("p"), (F.count(F.lit(1)) - F.sum(y)).alias("n"), F.count(F.lit(1)).alias("c"))
    j = running_totals(agg, g, "score", ["p", "n", "c"], n_buckets=n_buckets)
    P, N, T = F.col("p_tot"), F.col("n_tot"), F.col("c_tot")
    pos = F.lit(q) * (T - 1)
    lo, hi = F.floor(pos), F.ceil(pos)
    before = F.col("c_cum") - F.col("c")
    at_lo = (before <= lo) & (lo < F.col("c_cum"))
    at_hi = (before <= hi) & (hi < F.col("c_cum"))
    tp_ge = P - F.col("p_cum") + F.col("p")
    fp_ge = N - F.col("n_cum") + F.col("n")
    grouped = j.groupBy(*g) if g else j.groupBy()
    m = grouped.agg(
        F.max(P).alias("tot_p"), F.max(N).alias("tot_n"), F.max(T).alias("tot_t"),
        F.sum(F.col("p") * (F.col("n_cum") - F.col("n") / 2.0)).alias("_auc_num"),
        F.sum(F.col("p") * tp_ge / (tp_ge + fp_ge)).alias("_ap_num"),
        F.max(F.when(at_lo, F.col("score"))).alias("_vlo"),
        F.max(F.when(at_hi, F.col("score"))).alias("_vhi"),
        F.max(F.when(at_lo, F.col("p_cum"))).alias("_plo"),
        F.max(F.when(at_lo, F.col("n_cum"))).alias("_nlo"),
        F.max(F.when(at_hi, F.col("p_cum"))).alias("_phi"),
        F.max(F.when(at_hi, F.col("n_cum"))).alias("_nhi"),
        F.max(pos).alias("_pos"))
    # threshold by linear interpolation; v_lo and v_hi are adjacent order
    # statistics, so "score > thr" keeps everything above v_lo, or above v_hi
    # when the threshold lands exactly on v_hi.
    thr = F.col("_vlo") + (F.col("_pos") - F.floor("_pos")) * (F.col("_vhi") - F.col("_vlo"))
    on_hi = thr >= F.col("_vhi")
    tp = F.col("tot_p") - F.when(on_hi, F.col("_phi")).otherwise(F.col("_plo"))
    fp = F.col("tot_n") - F.when(on_hi, F.col("_nhi")).otherwise(F.col("_nlo"))
    r = m.select(
        *g,
        F.try_divide(F.col("_auc_num"), F.col("tot_p") * F.col("tot_n")).alias("auc"),
        F.try_divide(F.col("_ap_num"), F.col("tot_p")).alias("prauc"),
        F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + (F.col("tot_p") - tp)), F.lit(0.0)).alias("f1"),
        F.col("tot_t").cast("long").alias("n_test"),
        F.col("tot_p").cast("long").alias("n_outlier"),
        (F.col("tot_p") / F.col("tot_t") * 100.0).alias("pct_outlier"),
        (100.0 - F.col("tot_p") / F.col("tot_t") * 100.0).alias("pct_inlier"))
    if digits is not None:
        for c in ("auc", "prauc", "f1", "pct_outlier", "pct_inlier"):
            r = r.withColumn(c, F.round(c, digits))
    return r


def metrics_sql(scored_cte: str, group_cols=(), q: float = 0.8, digits: int = 6) -> str:
    """The same metrics as plain SQL over a CTE named ``scored_cte`` with columns
    (group..., score, outlier); used as the oracle."""
    g = list(group_cols)
    gl = ", ".join(g)
    gp = (gl + ", ") if g else ""
    part = f"PARTITION BY {gl} " if g else ""
    on = " AND ".join(f"a.{c} = b.{c}" for c in g) if g else "TRUE"
    sel_g = ", ".join(f"a.{c}" for c in g)
    sel_gp = (sel_g + ", ") if g else ""
    grp = f"GROUP BY {sel_g}" if g else ""
    return f"""
_agg AS (SELECT {gp}score, SUM(outlier) AS p, COUNT(*) - SUM(outlier) AS n
         FROM {scored_cte} GROUP BY {gp}score),
_cum AS (SELECT *, SUM(p) OVER w AS p_cum, SUM(n) OVER w AS n_cum
         FROM _agg WINDOW w AS ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
_tot AS (SELECT {gp}SUM(p) AS tot_p, SUM(n) AS tot_n FROM _agg {('GROUP BY ' + gl) if g else ''}),
_thr AS (SELECT {gp}quantile_cont(score, {q}) AS thr FROM {scored_cte} {('GROUP BY ' + gl) if g else ''}),
_m AS (SELECT {sel_gp}
          SUM(a.p * (a.n_cum - a.n / 2.0)) / (MAX(b.tot_p) * MAX(b.tot_n)) AS auc,
          SUM(a.p * (b.tot_p - a.p_cum + a.p) / ((b.tot_p - a.p_cum + a.p) + (b.tot_n - a.n_cum + a.n))) / MAX(b.tot_p) AS prauc,
          MAX(b.tot_p) AS tot_p, MAX(b.tot_n) AS tot_n
       FROM _cum a JOIN _tot b ON {on} {grp}),
_f AS (SELECT {sel_gp}
          SUM(CASE WHEN a.score > b.thr THEN a.p ELSE 0 END) AS TP,
          SUM(CASE WHEN a.score > b.thr THEN a.n ELSE 0 END) AS FP
       FROM _agg a JOIN _thr b ON {on} {grp}),
_metrics AS (SELECT {sel_gp}
          ROUND(a.auc, {digits}) AS auc, ROUND(a.prauc, {digits}) AS prauc,
          ROUND(COALESCE(2.0 * b.TP / NULLIF(2.0 * b.TP + b.FP + (a.tot_p - b.TP), 0), 0.0), {digits}) AS f1,
          CAST(a.tot_p + a.tot_n AS BIGINT) AS n_test, CAST(a.tot_p AS BIGINT) AS n_outlier,
          ROUND(a.tot_p / (a.tot_p + a.tot_n) * 100.0, {digits}) AS pct_outlier,
          ROUND(100.0 - a.tot_p / (a.tot_p + a.tot_n) * 100.0, {digits}) AS pct_inlier
       FROM _m a JOIN _f b ON {on})"""


def classification_report(df: DataFrame, label_col: str = "label", pred_col: str = "pred",
                          digits: int = 6) -> DataFrame:
    """AGG-36: per-class precision/recall/F1/support plus accuracy, macro and
    weighted averages, in long form (class string, precision, recall, f1, support)."""
    y, p = F.col(label_col), F.col(pred_col)
    classes = df.select(y.alias("cls")).union(df.select(p.alias("cls"))).distinct()
    true_c = df.groupBy(y.alias("cls")).agg(F.count(F.lit(1)).alias("support"))
    pred_c = df.groupBy(p.alias("cls")).agg(F.count(F.lit(1)).alias("predicted"))
    tp_c = df.filter(y == p).groupBy(y.alias("cls")).agg(F.count(F.lit(1)).alias("tp"))
    per = classes.join(true_c, "cls", "left").join(pred_c, "cls", "left").join(tp_c, "cls", "left").fillna(0)
    per = per.select(
        "cls", F.col("support").cast("long").alias("support"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0)).alias("recall"), "tp")
    per = per.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                         F.col("precision") + F.col("recall")), F.lit(0.0)))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"), F.count(F.lit(1)).alias("k"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                  (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                  (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    rows = per.select(F.col("cls").cast("string").alias("class"), "precision", "recall", "f1", "support")
    acc = tot.select(F.lit("accuracy").alias("class"), (F.col("tp") / F.col("n")).alias("precision"),
                     (F.col("tp") / F.col("n")).alias("recall"), (F.col("tp") / F.col("n")).alias("f1"),
                     F.col("n").cast("long").alias("support"))
    mac = tot.select(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"),
                     F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("n").cast("long").alias("support"))
    wei = tot.select(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                     F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").cast("long").alias("support"))
    out = rows.unionByName(acc).unionByName(mac).unionByName(wei)
    for c in ("precision", "recall", "f1"):
        out = out.withColumn(c, F.round(c, digits))
    return out

"""Scorer queries: ECOD, kNN / LOF, random baseline, feature bagging, and
subspace ensembles over the fixed masks (MDL-08, 10..15, 19; AGG-15..18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.distance import subspace_distance
from ..operators.ecod import ecod_columns, ecod_long, ecod_scores, ecod_subspace_scores
from ..operators.ensemble import (bagging_masks_long, final_score, pick_one, random_scores,
                                  weighted_average, weighted_mean_over_m)
from ..operators.knn import knn, lof_scores
from ..operators.masks import fixed_masks
from ..operators.metrics import binary_metrics, metrics_sql
from ..sources.datasets import embedding_dataset, width
from ..sources.tables import table
from .catalog import register
from .sqlparts import WIDTH_SQL, emb_dataset_sql, emb_long_sql, fixed_mask_weights_sql, fixed_masks_long_sql
from ..functions.hashing import h, h_sql

LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# ---------------------------------------------------------------- ECOD (lineitem)
def _ecod_line_sql():
    parts, joins, sl, sr, sa = [], [], [], [], []
    for i, c in enumerate(LINE_COLS):
        parts.append(f"""
e{i}_cnt AS (SELECT CAST({c} AS DOUBLE) AS v, COUNT(*) AS c FROM lineitem GROUP BY 1),
e{i}_cum AS (SELECT v, c, SUM(c) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c_cum,
                    SUM(c) OVER () AS c_tot FROM e{i}_cnt),
e{i}_sk AS (SELECT SUM(c * v * v * v) / SUM(c) - 3 * (SUM(c * v) / SUM(c)) * SUM(c * v * v) / SUM(c) + 2 * POW(SUM(c * v) / SUM(c), 3) AS m3 FROM e{i}_cnt),
e{i} AS (SELECT v, -LN(c_cum / c_tot) AS o_l, -LN((c_tot - c_cum + c) / c_tot) AS o_r,
                CASE WHEN m3 < 0 THEN -LN(c_cum / c_tot) ELSE -LN((c_tot - c_cum + c) / c_tot) END AS o_a
         FROM e{i}_cum, e{i}_sk)""")
        joins.append(f"JOIN e{i} ON CAST(l.{c} AS DOUBLE) = e{i}.v")
        sl.append(f"e{i}.o_l")
        sr.append(f"e{i}.o_r")
        sa.append(f"e{i}.o_a")
    return ",".join(parts) + f""",
scored AS (SELECT ROUND(GREATEST({' + '.join(sl)}, {' + '.join(sr)}, {' + '.join(sa)}), 6) AS score,
                  CAST(l.l_returnflag = 'R' AS INTEGER) AS outlier
           FROM lineitem l {' '.join(joins)})"""


def ecod_lineitem(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    s = ecod_columns(li, LINE_COLS, keep=["l_returnflag"])
    return s.select(F.round("score", 6).alias("score"),
                    (F.col("l_returnflag") == "R").cast("int").alias("outlier"))


@register("ecod_lineitem_metrics", f"WITH {_ecod_line_sql()}, {metrics_sql('scored')} SELECT * FROM _metrics")
def q_ecod_lineitem_metrics(spark, sf_dir):
    """MDL-10 over the 4 numeric lineitem columns (every row), evaluated against returnflag R."""
    return binary_metrics(ecod_lineitem(spark, sf_dir))


@register("ecod_lineitem_score_profile", f"""WITH {_ecod_line_sql()}
SELECT outlier, CAST(COUNT(*) AS BIGINT) AS n, ROUND(AVG(score), 6) AS mean_score,
       ROUND(MAX(score), 6) AS max_score, ROUND(MIN(score), 6) AS min_score FROM scored GROUP BY outlier""")
def q_ecod_lineitem_score_profile(spark, sf_dir):
    """MDL-10 per-row scores over all lineitem rows, summarised by class."""
    s = ecod_lineitem(spark, sf_dir)
    return s.groupBy("outlier").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"),
                                    F.round(F.max("score"), 6).alias("max_score"),
                                    F.round(F.min("score"), 6).alias("min_score"))


# ---------------------------------------------------------------- ECOD (embeddings)
_ECOD_EMB_SQL = f"""
ds AS ({emb_dataset_sql(0)}),
xl AS ({emb_long_sql('ds', 'row_id')}),
cnt AS (SELECT dim, v, COUNT(*) AS c FROM xl GROUP BY dim, v),
cum AS (SELECT dim, v, c, SUM(c) OVER (PARTITION BY dim ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c_cum,
               SUM(c) OVER (PARTITION BY dim) AS c_tot FROM cnt),
sk AS (SELECT dim, SUM(c * v * v * v) / SUM(c) - 3 * (SUM(c * v) / SUM(c)) * SUM(c * v * v) / SUM(c) + 2 * POW(SUM(c * v) / SUM(c), 3) AS m3 FROM cnt GROUP BY dim),
tab AS (SELECT cum.dim, v, -LN(c_cum / c_tot) AS o_l, -LN((c_tot - c_cum + c) / c_tot) AS o_r, m3 < 0 AS neg
        FROM cum JOIN sk ON cum.dim = sk.dim),
o AS (SELECT x.row_id, x.dim, t.o_l, t.o_r, CASE WHEN t.neg THEN t.o_l ELSE t.o_r END AS o_a
      FROM xl x JOIN tab t ON x.dim = t.dim AND x.v = t.v)"""

_ECOD_EMB_SCORED = _ECOD_EMB_SQL + """,
scored AS (SELECT o.row_id, ds.label, ds.outlier, ROUND(GREATEST(SUM(o_l), SUM(o_r), SUM(o_a)), 6) AS score
           FROM o JOIN ds ON o.row_id = ds.row_id WHERE ds.split = 'test' GROUP BY o.row_id, ds.label, ds.outlier)"""


def ecod_embeddings(spark, sf_dir):
    ds = embedding_dataset(spark, sf_dir, 0)
    s = ecod_scores(ds, ["row_id"])
    return ds.filter("split = 'test'").select("row_id", "label", "outlier") \
        .join(s, "row_id").select("row_id", "label", "outlier", F.round("score", 6).alias("score"))


@register("ecod_embedding_scores", f"WITH {_ECOD_EMB_SCORED} SELECT row_id, label, outlier, score FROM scored")
def q_ecod_embedding_scores(spark, sf_dir):
    """MDL-10 / WIN-04: ECOD fitted on train inliers + test rows, scores of test rows."""
    return ecod_embeddings(spark, sf_dir)


@register("ecod_embedding_metrics", f"WITH {_ECOD_EMB_SCORED}, {metrics_sql('scored')} SELECT * FROM _metrics")
def q_ecod_embedding_metrics(spark, sf_dir):
    return binary_metrics(ecod_embeddings(spark, sf_dir))


# ---------------------------------------------------------------- subspace ECOD ensemble
def _masks_long(spark, d: int):
    m = fixed_masks(spark, d, 8)
    return m, m.select("subspace_id", F.posexplode("mask").alias("dim", "u")).filter("u = 1") \
        .select("subspace_id", F.col("dim").cast("int").alias("dim"))


_SUB_ECOD_SQL = _ECOD_EMB_SQL + f""",
ml AS ({fixed_masks_long_sql()}),
mw AS ({fixed_mask_weights_sql(8)}),
per AS (SELECT o.row_id, m.subspace_id, GREATEST(SUM(o_l), SUM(o_r), SUM(o_a)) AS s
        FROM o JOIN ml m ON o.dim = m.dim AND m.u = 1 GROUP BY o.row_id, m.subspace_id),
ens AS (SELECT per.row_id, SUM(per.s * mw.proba) / SUM(mw.proba) AS ensemble,
               SUM(per.s * mw.proba) / COUNT(*) AS ensemble_m
        FROM per JOIN mw ON per.subspace_id = mw.subspace_id GROUP BY per.row_id)"""


def _sub_ecod(spark, sf_dir):
    ds = embedding_dataset(spark, sf_dir, 0)
    masks, ml = _masks_long(spark, width(ds))
    o = ecod_long(ds, ["row_id"])
    per = ecod_subspace_scores(o, ml, ["row_id"])
    test = ds.filter("split = 'test'").select("row_id", "label", "outlier")
    return ds, masks, per, test


@register("subspace_ecod_ensemble", f"""WITH {_SUB_ECOD_SQL}
SELECT ds.row_id, ds.label, ds.outlier, ROUND(ens.ensemble, 6) AS ensemble, ROUND(ens.ensemble_m, 6) AS ensemble_m
FROM ens JOIN ds ON ens.row_id = ds.row_id WHERE ds.split = 'test'""")
def q_subspace_ecod_ensemble(spark, sf_dir):
    """MDL-19 + MDL-15 (ensemble-only, lambda=0) + AGG-15 / AGG-17: ECOD on all
    8 masked views in one job, weighted average and the /m text variant."""
    ds, masks, per, test = _sub_ecod(spark, sf_dir)
    a = weighted_average(per, masks, ["row_id"])
    b = weighted_mean_over_m(per, masks, ["row_id"], out_col="ensemble_m")
    return test.join(a, "row_id").join(b, "row_id").select(
        "row_id", "label", "outlier", F.round("ensemble", 6).alias("ensemble"),
        F.round("ensemble_m", 6).alias("ensemble_m"))


_FINAL_SQL = _SUB_ECOD_SQL + f""",
msk AS ({fixed_masks_long_sql()}),
dist AS (SELECT x.row_id, m.subspace_id, SQRT(SUM(x.v * x.v * (1 - m.u) * (1 - m.u))) AS d
         FROM xl x JOIN msk m ON x.dim = m.dim GROUP BY x.row_id, m.subspace_id),
dmin AS (SELECT row_id, MIN(d) / SQRT({WIDTH_SQL}) AS distance FROM dist GROUP BY row_id),
scored AS (SELECT ds.row_id, ds.outlier, ROUND(1.0 * ens.ensemble + 10.0 * dmin.distance, 6) AS score
           FROM ens JOIN dmin ON ens.row_id = dmin.row_id JOIN ds ON ds.row_id = ens.row_id
           WHERE ds.split = 'test')"""


@register("subspace_ensemble_final_metrics", f"WITH {_FINAL_SQL}, {metrics_sql('scored')} SELECT * FROM _metrics")
def q_subspace_ensemble_final_metrics(spark, sf_dir):
    """MDL-13 with given masks: delta * ECOD ensemble + lambda * distance (AGG-18), evaluated."""
    ds, masks, per, test = _sub_ecod(spark, sf_dir)
    ens = weighted_average(per, masks, ["row_id"])
    dist = subspace_distance(ds.filter("split = 'test'"), masks, width(ds)).select("row_id", "distance")
    fs = final_score(ens, dist, 1.0, 10.0)
    return binary_metrics(test.join(fs, "row_id").select("outlier", F.round("score", 6).alias("score")))


@register("subspace_ensemble_pick_one", f"""WITH {_SUB_ECOD_SQL}
SELECT ds.row_id, ds.outlier, per.subspace_id,
       ROUND(mw.proba / (SELECT SUM(proba) FROM mw) * per.s, 6) AS ensemble
FROM per JOIN ds ON per.row_id = ds.row_id JOIN mw ON per.subspace_id = mw.subspace_id
WHERE ds.split = 'test' AND {h_sql('per.row_id', 5)} % 8 = per.subspace_id""")
def q_subspace_ensemble_pick_one(spark, sf_dir):
    """AGG-16: the "exact" ensemble, one hashed detector per row times its weight."""
    ds = embedding_dataset(spark, sf_dir, 0)
    masks, ml = _masks_long(spark, width(ds))
    test = ds.filter("split = 'test'").select("row_id", "label", "outlier")
    drawn = F.pmod(h("row_id", 5), F.lit(8)).cast("int")
    # each row meets the dimensions of its own view only
    o = ecod_long(ds, ["row_id"]).join(test.select("row_id"), "row_id").withColumn("subspace_id", drawn)
    own = o.join(ml, ["subspace_id", "dim"]).groupBy("row_id", "subspace_id").agg(
        F.greatest(F.sum("o_l"), F.sum("o_r"), F.sum("o_a")).alias("score"))
    p = pick_one(own, masks, 8, seed=5)
    return test.join(p, "row_id").select(
        "row_id", "outlier", drawn.alias("subspace_id"), F.round("ensemble", 6).alias("ensemble"))


# ---------------------------------------------------------------- feature bagging
_BAG_SQL = _ECOD_EMB_SQL + f""",
bdims AS (SELECT CAST(e AS INTEGER) AS subspace_id, CAST(i AS INTEGER) AS dim,
                 {WIDTH_SQL} // 2 + {h_sql('e', 13)} % ({WIDTH_SQL} - {WIDTH_SQL} // 2) AS k,
                 ROW_NUMBER() OVER (PARTITION BY e ORDER BY {h_sql("e || ':' || i", 14)}, i) AS r
          FROM range(10) AS te(e), (SELECT UNNEST(range(CAST({WIDTH_SQL} AS BIGINT))) AS i) AS ti),
bm AS (SELECT subspace_id, dim FROM bdims WHERE r <= k),
per AS (SELECT o.row_id, bm.subspace_id, GREATEST(SUM(o_l), SUM(o_r), SUM(o_a)) AS s
        FROM o JOIN bm ON o.dim = bm.dim GROUP BY o.row_id, bm.subspace_id),
scored AS (SELECT per.row_id, ds.outlier, ROUND(AVG(per.s), 6) AS score FROM per JOIN ds ON per.row_id = ds.row_id
           WHERE ds.split = 'test' GROUP BY per.row_id, ds.outlier)"""


@register("feature_bagging_ecod_metrics", f"WITH {_BAG_SQL}, {metrics_sql('scored')} SELECT * FROM _metrics")
def q_feature_bagging_ecod_metrics(spark, sf_dir):
    """MDL-11: 10 hashed feature subsets of size d/2..d-1, ECOD on each, averaged."""
    ds = embedding_dataset(spark, sf_dir, 0)
    bm = bagging_masks_long(spark, width(ds))
    o = ecod_long(ds, ["row_id"])
    per = ecod_subspace_scores(o, bm, ["row_id"])
    avg = per.groupBy("row_id").agg(F.avg("score").alias("score"))
    test = ds.filter("split = 'test'").select("row_id", "outlier")
    return binary_metrics(test.join(avg, "row_id").select("outlier", F.round("score", 6).alias("score")))


# ---------------------------------------------------------------- random baseline
@register("random_baseline_metrics", f"""WITH ds AS ({emb_dataset_sql(0)}),
scored AS (SELECT outlier, ROUND({h_sql('row_id', 1)} / 2147483648.0, 6) AS score FROM ds WHERE split = 'test'),
{metrics_sql('scored')} SELECT * FROM _metrics""")
def q_random_baseline_metrics(spark, sf_dir):
    """MDL-12: random scores evaluated with the same metric operator."""
    ds = embedding_dataset(spark, sf_dir, 0).filter("split = 'test'")
    s = random_scores(ds, seed=1)
    return binary_metrics(s.select("outlier", F.round("score", 6).alias("score")))


# ---------------------------------------------------------------- kNN / LOF
def _pairs_sql(a: str, b: str, self_excl: bool = False) -> str:
    cond = "WHERE a.row_id <> b.row_id" if self_excl else ""
    return f"""SELECT a.row_id AS qid, b.row_id AS rid,
        SQRT(list_sum(list_transform(range(len(a.embedding)), lambda i:
             (CAST(a.embedding[i + 1] AS DOUBLE) - CAST(b.embedding[i + 1] AS DOUBLE)) *
             (CAST(a.embedding[i + 1] AS DOUBLE) - CAST(b.embedding[i + 1] AS DOUBLE))))) AS dist
        FROM {a} a, {b} b {cond}"""


_KNN_SQL = f"""
ds AS ({emb_dataset_sql(0)}),
tr AS (SELECT row_id, embedding FROM ds WHERE split = 'train'),
te AS (SELECT row_id, embedding FROM ds WHERE split = 'test'),
p AS ({_pairs_sql('te', 'tr')}),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY dist, rid) AS nn_rank FROM p)"""


@register("knn_neighbors", f"""WITH {_KNN_SQL}
SELECT qid AS row_id, rid AS neighbor_id, CAST(nn_rank AS INTEGER) AS nn_rank, ROUND(dist, 6) AS dist
FROM rk WHERE nn_rank <= 5""")
def q_knn_neighbors(spark, sf_dir):
    """JN-10 / WIN-05: exact 5 nearest training inliers of every test row (block-pair kNN)."""
    ds = embedding_dataset(spark, sf_dir, 0)
    tr, te = ds.filter("split = 'train'"), ds.filter("split = 'test'")
    nn = knn(te, tr, 5)
    return nn.select(F.col("qid").alias("row_id"), F.col("rid").alias("neighbor_id"),
                     F.col("nn_rank").cast("int").alias("nn_rank"), F.round("dist", 6).alias("dist"))


def _lof_sql(k: int) -> str:
    return f"""
ds AS ({emb_dataset_sql(0)}),
tr AS (SELECT row_id, embedding FROM ds WHERE split = 'train'),
te AS (SELECT row_id, embedding FROM ds WHERE split = 'test'),
pt AS ({_pairs_sql('tr', 'tr', True)}),
rt AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY dist, rid) AS r FROM pt) WHERE r <= {k}),
kd AS (SELECT qid AS rid, MAX(dist) AS kdist FROM rt GROUP BY qid),
lrd AS (SELECT rt.qid AS rid, 1.0 / (AVG(GREATEST(kd.kdist, rt.dist)) + 1e-10) AS lrd_o
        FROM rt JOIN kd ON rt.rid = kd.rid GROUP BY rt.qid),
pe AS ({_pairs_sql('te', 'tr')}),
re AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY dist, rid) AS r FROM pe) WHERE r <= {k}),
lof AS (SELECT re.qid AS row_id, AVG(lrd.lrd_o) / (1.0 / (AVG(GREATEST(kd.kdist, re.dist)) + 1e-10)) AS score
        FROM re JOIN kd ON re.rid = kd.rid JOIN lrd ON re.rid = lrd.rid GROUP BY re.qid),
scored AS (SELECT lof.row_id, ds.label, ds.outlier, ROUND(lof.score, 6) AS score
           FROM lof JOIN ds ON lof.row_id = ds.row_id)"""


LOF_K = 20


def lof_embeddings(spark, sf_dir):
    ds = embedding_dataset(spark, sf_dir, 0)
    tr, te = ds.filter("split = 'train'"), ds.filter("split = 'test'")
    s = lof_scores(tr, te, LOF_K)
    return te.select("row_id", "label", "outlier").join(s, "row_id").select(
        "row_id", "label", "outlier", F.round("score", 6).alias("score"))


@register("lof_scores", f"WITH {_lof_sql(LOF_K)} SELECT row_id, label, outlier, score FROM scored")
def q_lof_scores(spark, sf_dir):
    """MDL-08: novelty LOF (k=20) fitted on train inliers, per test row."""
    return lof_embeddings(spark, sf_dir)


@register("lof_metrics", f"WITH {_lof_sql(LOF_K)}, {metrics_sql('scored')} SELECT * FROM _metrics")
def q_lof_metrics(spark, sf_dir):
    return binary_metrics(lof_embeddings(spark, sf_dir))


# ---------------------------------------------------------------- any scorer under ensembles and bagging
def ecod_views(ds, masks_long):
    """UDF-03 scorer contract: (subspace_id, row_id, score) of every masked view of the test rows."""
    return ecod_subspace_scores(ecod_long(ds, ["row_id"]), masks_long, ["row_id"])


def lof_views(ds, masks_long, k: int = LOF_K):
    """The same contract by LOF fitted on the train rows; the masks are a few 0/1 lists."""
    kept: dict[int, set] = {}
    for r in masks_long.select("subspace_id", "dim").collect():
        kept.setdefault(r["subspace_id"], set()).add(r["dim"])
    ids = sorted(kept)
    lists = [[int(i in kept[j]) for i in range(width(ds))] for j in ids]
    s = lof_scores(ds.filter("split = 'train'"), ds.filter("split = 'test'"), k, masks=lists)
    return s.withColumn("subspace_id", F.get(F.array(*map(F.lit, ids)), F.col("subspace_id")))


SCORERS = {"ecod": ecod_views, "lof": lof_views}


def ensemble_metrics(spark, sf_dir, scorer: str):
    """MDL-22: fit and score any scorer on the fixed masks, weighted average, metrics."""
    ds = embedding_dataset(spark, sf_dir, 0)
    masks, ml = _masks_long(spark, width(ds))
    ens = weighted_average(SCORERS[scorer](ds, ml), masks, ["row_id"])
    test = ds.filter("split = 'test'").select("row_id", "outlier")
    return binary_metrics(test.join(ens, "row_id").select("outlier", F.round("ensemble", 6).alias("score")))


def bagging_metrics(spark, sf_dir, scorer: str):
    ds = embedding_dataset(spark, sf_dir, 0)
    avg = SCORERS[scorer](ds, bagging_masks_long(spark, width(ds))).groupBy("row_id").agg(F.avg("score").alias("score"))
    test = ds.filter("split = 'test'").select("row_id", "outlier")
    return binary_metrics(test.join(avg, "row_id").select("outlier", F.round("score", 6).alias("score")))


def _lof_views_sql(masks: str, k: int = LOF_K) -> str:
    """CTEs up to ``per`` (subspace_id, row_id, s); ``masks``: CTE body (subspace_id, dim) of the kept dimensions."""
    def pairs(a, b):
        return (f"SELECT m.subspace_id, a.row_id AS qid, b.row_id AS rid, SQRT(SUM((a.v - b.v) * (a.v - b.v))) AS dist "
                f"FROM xl a JOIN xl b ON a.dim = b.dim JOIN vm m ON m.dim = a.dim "
                f"WHERE a.split = '{a}' AND b.split = '{b}' AND a.row_id <> b.row_id GROUP BY ALL")
    near = "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY subspace_id, qid ORDER BY dist, rid) AS r FROM {}) WHERE r <= " + str(k)
    return f"""
ds AS ({emb_dataset_sql(0)}),
xl AS (SELECT row_id, split, UNNEST(range(len(embedding))) AS dim, CAST(UNNEST(embedding) AS DOUBLE) AS v FROM ds),
vm AS ({masks}),
pt AS ({pairs('train', 'train')}), rt AS ({near.format('pt')}),
kd AS (SELECT subspace_id, qid AS rid, MAX(dist) AS kdist FROM rt GROUP BY ALL),
lrd AS (SELECT rt.subspace_id, rt.qid AS rid, 1.0 / (AVG(GREATEST(kdist, dist)) + 1e-10) AS lrd_o
        FROM rt JOIN kd ON rt.rid = kd.rid AND rt.subspace_id = kd.subspace_id GROUP BY ALL),
pe AS ({pairs('test', 'train')}), re AS ({near.format('pe')}),
per AS (SELECT re.subspace_id, re.qid AS row_id, AVG(lrd_o) / (1.0 / (AVG(GREATEST(kdist, dist)) + 1e-10)) AS s
        FROM re JOIN kd ON re.rid = kd.rid AND re.subspace_id = kd.subspace_id
        JOIN lrd ON re.rid = lrd.rid AND re.subspace_id = lrd.subspace_id GROUP BY ALL)"""


@register("subspace_lof_ensemble_metrics", f"""WITH {_lof_views_sql(f"SELECT subspace_id, dim FROM ({fixed_masks_long_sql()}) WHERE u = 1")},
mw AS ({fixed_mask_weights_sql(8)}),
scored AS (SELECT ds.outlier, ROUND(SUM(per.s * mw.proba) / SUM(mw.proba), 6) AS score
           FROM per JOIN mw ON per.subspace_id = mw.subspace_id JOIN ds ON ds.row_id = per.row_id GROUP BY ds.row_id, ds.outlier),
{metrics_sql('scored')} SELECT * FROM _metrics""")
def q_subspace_lof_ensemble_metrics(spark, sf_dir):
    """UDF-03 + MDL-22: the ensemble with LOF in the scorer's place."""
    return ensemble_metrics(spark, sf_dir, "lof")


@register("feature_bagging_lof_metrics", f"""WITH {_lof_views_sql(f'''SELECT subspace_id, dim FROM (
  SELECT CAST(e AS INTEGER) AS subspace_id, CAST(i AS INTEGER) AS dim, {WIDTH_SQL} // 2 + {h_sql('e', 13)} % ({WIDTH_SQL} - {WIDTH_SQL} // 2) AS k,
         ROW_NUMBER() OVER (PARTITION BY e ORDER BY {h_sql("e || ':' || i", 14)}, i) AS r
  FROM range(10) AS te(e), (SELECT UNNEST(range(CAST({WIDTH_SQL} AS BIGINT))) AS i) AS ti) WHERE r <= k''')},
scored AS (SELECT ds.outlier, ROUND(AVG(per.s), 6) AS score FROM per JOIN ds ON ds.row_id = per.row_id GROUP BY ds.row_id, ds.outlier),
{metrics_sql('scored')} SELECT * FROM _metrics""")
def q_feature_bagging_lof_metrics(spark, sf_dir):
    """MDL-11 with LOF in the scorer's place."""
    return bagging_metrics(spark, sf_dir, "lof")

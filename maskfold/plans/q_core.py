"""Core slice: embeddings -> one-class split -> fixed masks -> distance score
-> AUC / AP / F1; plus the preparation and mask-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.distance import subspace_distance
from ..operators.masks import (average_subspace, drop_zero_masks, fixed_masks, leftover_mask,
                               sample_subspaces, subspace_distribution, top_subspaces, with_leftover)
from ..operators.metrics import binary_metrics, metrics_sql
from ..sources.datasets import embedding_dataset, embedding_matrix, width
from .catalog import register
from .sqlparts import WIDTH_SQL, emb_dataset_sql, emb_long_sql, fixed_mask_weights_sql, fixed_masks_long_sql

def distance_scores(spark, sf_dir, inlier=0, m=8):
    ds = embedding_dataset(spark, sf_dir, inlier).filter("split = 'test'")
    d = width(ds)
    s = subspace_distance(ds, fixed_masks(spark, d, m), d, out_col="score")
    return s.select("row_id", "label", "outlier", F.round("score", 6).alias("score"))


_SCORES_SQL = f"""
ds AS ({emb_dataset_sql(0)}),
xl AS ({emb_long_sql('ds', 'row_id')}),
masks AS ({fixed_masks_long_sql()}),
dist AS (SELECT x.row_id, m.subspace_id, SQRT(SUM(x.v * x.v * (1 - m.u) * (1 - m.u))) AS d
         FROM xl x JOIN masks m ON x.dim = m.dim GROUP BY x.row_id, m.subspace_id),
scored AS (SELECT s.row_id, ds.label, ds.outlier, ROUND(MIN(s.d) / SQRT({WIDTH_SQL}), 6) AS score
           FROM dist s JOIN ds ON s.row_id = ds.row_id WHERE ds.split = 'test'
           GROUP BY s.row_id, ds.label, ds.outlier)"""


@register("subspace_distance_scores", f"WITH {_SCORES_SQL} SELECT row_id, label, outlier, score FROM scored")
def q_subspace_distance_scores(spark, sf_dir):
    """AGG-14 / MDL-14 (distance-only detector, delta = 0) per test row."""
    return distance_scores(spark, sf_dir)


@register("subspace_distance_metrics",
          f"WITH {_SCORES_SQL}, {metrics_sql('scored')} SELECT * FROM _metrics")
def q_subspace_distance_metrics(spark, sf_dir):
    """Flagship: distance-to-nearest-subspace detector evaluated (AGG-19..22)."""
    return binary_metrics(distance_scores(spark, sf_dir), score_col="score")


@register("prepared_embeddings", f"""
WITH ds AS ({emb_dataset_sql(0)})
SELECT row_id, split, label, outlier, CAST(len(embedding) AS INTEGER) AS n_dims,
       ROUND(SQRT(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))), 6) AS x_norm
FROM ds""")
def q_prepared_embeddings(spark, sf_dir):
    """SRC-06, PRJ-01..04: one-class split of the embedding matrix."""
    ds = embedding_dataset(spark, sf_dir, 0)
    return ds.select("row_id", "split", "label", "outlier", F.size("x").alias("n_dims"),
                     F.round(V.l2_norm("x"), 6).alias("x_norm"))


_DRAW_SQL = f"""
w AS ({fixed_mask_weights_sql(8)}),
cw AS (SELECT subspace_id, weight, SUM(weight) OVER (ORDER BY subspace_id) - weight AS w_lo,
              SUM(weight) OVER (ORDER BY subspace_id) AS w_hi, SUM(weight) OVER () AS w_total FROM w),
drawn AS (SELECT e.vec_id AS row_id, c.subspace_id
          FROM embeddings e JOIN cw c
            ON {{draw}} >= c.w_lo AND {{draw}} < c.w_hi),
ml AS ({fixed_masks_long_sql()}),
mtext AS (SELECT subspace_id, string_agg(CAST(u AS VARCHAR), '' ORDER BY dim) AS mask_key,
                 SUM(u) AS n_dims FROM ml GROUP BY subspace_id)"""


def _draw_sql():
    from ..functions.hashing import h_sql
    L = 840 + 420 + 280 + 210 + 168 + 140 + 120 + 105
    return _DRAW_SQL.replace("{draw}", f"({h_sql('e.vec_id', 11)} % {L})")


def _drawn(spark, sf_dir):
    x = embedding_matrix(spark, sf_dir)
    masks = fixed_masks(spark, width(x), 8)
    return sample_subspaces(x, masks, seed=11), masks


@register("subspace_frequencies", f"""
WITH {_draw_sql()}
SELECT m.mask_key, CAST(m.n_dims AS BIGINT) AS n_dims, CAST(COUNT(*) AS BIGINT) AS n_drawn,
       ROUND(COUNT(*) / (SELECT COUNT(*) FROM embeddings), 6) AS proba
FROM drawn d JOIN mtext m ON d.subspace_id = m.subspace_id GROUP BY m.mask_key, m.n_dims""")
def q_subspace_frequencies(spark, sf_dir):
    """MDL-05/07 sampling one mask per data row, AGG-11 distinct masks + relative frequency."""
    drawn, _ = _drawn(spark, sf_dir)
    dist = subspace_distribution(drawn)
    return dist.select(V.mask_text("mask").alias("mask_key"),
                       F.aggregate("mask", F.lit(0), lambda a, v: a + v).cast("long").alias("n_dims"),
                       F.col("n_drawn").cast("long").alias("n_drawn"), F.round("proba", 6).alias("proba"))


@register("top_subspaces", f"""
WITH {_draw_sql()},
freq AS (SELECT m.mask_key, COUNT(*) / (SELECT COUNT(*) FROM embeddings) AS proba
         FROM drawn d JOIN mtext m ON d.subspace_id = m.subspace_id GROUP BY m.mask_key),
top AS (SELECT * FROM freq ORDER BY proba DESC, mask_key LIMIT 5)
SELECT mask_key, ROUND(proba / (SELECT SUM(proba) FROM top), 6) AS proba FROM top""")
def q_top_subspaces(spark, sf_dir):
    """SRT-01/02 + PRJ-13: top-k (k=5) masks renormalised; all-zero masks removed first."""
    drawn, _ = _drawn(spark, sf_dir)
    dist = drop_zero_masks(subspace_distribution(drawn))
    t = top_subspaces(dist, 5)
    return t.select(F.col("_key").alias("mask_key"), F.round("proba", 6).alias("proba"))


@register("average_subspace", f"""
WITH {_draw_sql()}
SELECT CAST(m.dim AS INTEGER) AS dim, ROUND(AVG(m.u), 6) AS rate
FROM drawn d JOIN ml m ON d.subspace_id = m.subspace_id GROUP BY m.dim""")
def q_average_subspace(spark, sf_dir):
    """AGG-13: per-dimension selection rate over the drawn masks."""
    drawn, _ = _drawn(spark, sf_dir)
    a = average_subspace(drawn)
    return a.select(F.col("dim").cast("int").alias("dim"), F.round("rate", 6).alias("rate"))


@register("leftover_subspace", f"""
WITH {_draw_sql()},
used AS (SELECT m.dim, MAX(m.u) AS used FROM drawn d JOIN ml m ON d.subspace_id = m.subspace_id GROUP BY m.dim),
lo AS (SELECT string_agg(CAST(1 - used AS VARCHAR), '' ORDER BY dim) AS mask_key,
              SUM(1 - used) AS n_dims FROM used)
SELECT mask_key, CAST(n_dims AS BIGINT) AS n_dims FROM lo WHERE n_dims > 0""")
def q_leftover_subspace(spark, sf_dir):
    """AGG-12: the dimensions no drawn mask uses, as one extra mask."""
    drawn, _ = _drawn(spark, sf_dir)
    lo = leftover_mask(drawn)
    return lo.select(V.mask_text("mask").alias("mask_key"),
                     F.aggregate("mask", F.lit(0), lambda a, v: a + v).cast("long").alias("n_dims"))


@register("subspaces_with_leftover", f"""
WITH {_draw_sql()},
freq AS (SELECT m.mask_key, COUNT(*) / (SELECT COUNT(*) FROM embeddings) AS p
         FROM drawn d JOIN mtext m ON d.subspace_id = m.subspace_id GROUP BY m.mask_key),
used AS (SELECT m.dim, MAX(m.u) AS used FROM drawn d JOIN ml m ON d.subspace_id = m.subspace_id GROUP BY m.dim),
lo AS (SELECT string_agg(CAST(1 - used AS VARCHAR), '' ORDER BY dim) AS mask_key, 1.0 AS p FROM used HAVING SUM(1 - used) > 0),
al AS (SELECT mask_key, p FROM freq UNION ALL SELECT mask_key, p FROM lo)
SELECT mask_key, ROUND(p / (SELECT SUM(p) FROM al), 6) AS proba FROM al""")
def q_subspaces_with_leftover(spark, sf_dir):
    """AGG-12: the drawn masks and the leftover one, with weights (p, 1) that are scaled to 1 together."""
    drawn, _ = _drawn(spark, sf_dir)
    return with_leftover(subspace_distribution(drawn)).select(V.mask_text("mask").alias("mask_key"), F.round("proba", 6).alias("proba"))


@register("normalized_subspace_distance", f"""WITH ds AS ({emb_dataset_sql(0)}),
xl AS ({emb_long_sql('ds', 'row_id')}),
masks AS ({fixed_masks_long_sql()}),
n AS (SELECT x.row_id, m.subspace_id, SUM(v * v) AS xx, SUM(v * v * u) AS xu, SUM(v * v * u * u) AS uu
      FROM xl x JOIN masks m ON x.dim = m.dim GROUP BY ALL),
d AS (SELECT row_id, SQRT(GREATEST(xx / POW(GREATEST(SQRT(xx), 1e-12), 2) + uu / POW(GREATEST(SQRT(uu), 1e-12), 2)
        - 2 * xu / (GREATEST(SQRT(xx), 1e-12) * GREATEST(SQRT(uu), 1e-12)), 0)) AS d FROM n)
SELECT d.row_id, ds.outlier, ROUND(MIN(d) / SQRT({WIDTH_SQL}), 6) AS distance FROM d JOIN ds ON ds.row_id = d.row_id
WHERE ds.split = 'test' GROUP BY d.row_id, ds.outlier""")
def q_normalized_subspace_distance(spark, sf_dir):
    """UDF-02 + AGG-14 + PRJ-08: the distance to the nearest subspace after a transform of both sides, here unit length."""
    ds = embedding_dataset(spark, sf_dir, 0).filter("split = 'test'")
    d = width(ds)
    s = subspace_distance(ds, fixed_masks(spark, d, 8), d, transform=V.row_l2_normalize)
    return s.select("row_id", "outlier", F.round("distance", 6).alias("distance"))


def class_masks(x):
    """A caller's masks (UDF-04): per label the components whose mean within the label is above their mean."""
    long = x.where("label is not null").select("label", F.posexplode("x").alias("dim", "v"))
    mean = long.groupBy("dim").agg(F.avg("v").alias("all"))
    m = long.groupBy("label", "dim").agg(F.avg("v").alias("own")).join(mean, "dim")
    return m.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("dim", (F.col("own") > F.col("all")).cast("int").alias("u")))).alias("s")) \
        .select(F.col("label").alias("subspace_id"), F.transform("s", lambda t: t["u"]).alias("mask"))


@register("class_mask_distance", f"""WITH xl AS (SELECT vec_id AS row_id, label, UNNEST(range(len(embedding))) AS dim, CAST(UNNEST(embedding) AS DOUBLE) AS v FROM embeddings),
a AS (SELECT dim, AVG(v) AS m FROM xl WHERE label IS NOT NULL GROUP BY dim),
c AS (SELECT xl.label, xl.dim, CAST(AVG(v) > ANY_VALUE(a.m) AS INTEGER) AS u FROM xl JOIN a ON a.dim = xl.dim WHERE label IS NOT NULL GROUP BY ALL),
d AS (SELECT xl.row_id, c.label, SQRT(SUM(v * v * (1 - u))) AS d FROM xl JOIN c ON c.dim = xl.dim GROUP BY ALL)
SELECT row_id, ROUND(MIN(d) / SQRT({WIDTH_SQL}), 6) AS distance FROM d GROUP BY row_id""")
def q_class_mask_distance(spark, sf_dir):
    """UDF-04 + AGG-14: the distance of every row to the nearest of the caller's subspaces, one per label."""
    x = embedding_matrix(spark, sf_dir)
    return subspace_distance(x, class_masks(x), width(x)).select("row_id", F.round("distance", 6).alias("distance"))

"""Fitted models as versioned tables: fit and save, load and score rows that came later (SRC-18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.distance import subspace_distance
from ..operators.ecod import TERMS, fit_ecdf, fitted_terms
from ..operators.knn import lof_fit, lof_score
from ..operators.masks import fixed_masks
from ..session import scratch_path
from ..sources.datasets import embedding_dataset, width
from ..sources.models import ModelStore
from .catalog import register
from .q_scorers import LOF_K, _lof_sql
from .sqlparts import WIDTH_SQL, fixed_masks_long_sql


def fit_model(train, store: ModelStore, k: int = LOF_K) -> int:
    """Masks, the ECDF tables of every dimension, and what LOF knows of the training rows, as one version."""
    ranges, values = fit_ecdf(train)
    d = width(train)
    return store.save({"masks": fixed_masks(train.sparkSession, d, 8), "ranges": ranges, "values": values,
                       "train": train.select("row_id", "x"), "neighbours": lof_fit(train, k)}, k=k, width=d)


def score_rows(rows, store: ModelStore, version: int | None = None):
    """(row_id, distance, ecod, lof) of rows (row_id, x) by a saved model; nothing is fitted again."""
    parameters, t = store.load(version)
    dist = subspace_distance(rows, t["masks"], parameters["width"]).select("row_id", "distance")
    terms = fitted_terms(rows, t["ranges"], t["values"]).groupBy("row_id").agg(*[F.sum(c).alias(c) for c in TERMS])
    lof = lof_score(t["neighbours"], t["train"], rows, parameters["k"]).select("row_id", F.col("score").alias("lof"))
    return dist.join(terms.select("row_id", F.greatest(*TERMS).alias("ecod")), "row_id").join(lof, "row_id")


@register("fitted_model_scores", f"""WITH {_lof_sql(LOF_K)},
fl AS (SELECT row_id, split, UNNEST(range(len(embedding))) AS dim, CAST(UNNEST(embedding) AS DOUBLE) AS v FROM ds),
tr_ AS (SELECT dim, v FROM fl WHERE split = 'train'), te_ AS (SELECT row_id, dim, v FROM fl WHERE split = 'test'),
m AS (SELECT dim, COUNT(*) AS n, SUM(v * v * v) / COUNT(*) - 3 * AVG(v) * SUM(v * v) / COUNT(*) + 2 * POW(AVG(v), 3) < 0 AS neg FROM tr_ GROUP BY dim),
r AS (SELECT te_.row_id, te_.dim, COUNT(*) FILTER (WHERE tr_.v <= te_.v) AS le, COUNT(*) FILTER (WHERE tr_.v < te_.v) AS lt
      FROM te_ JOIN tr_ ON te_.dim = tr_.dim GROUP BY ALL),
o AS (SELECT r.row_id, -LN(GREATEST(le, 1) / n) AS o_l, -LN((n - LEAST(lt, n - 1)) / n) AS o_r, neg FROM r JOIN m ON r.dim = m.dim),
e AS (SELECT row_id, GREATEST(SUM(o_l), SUM(o_r), SUM(CASE WHEN neg THEN o_l ELSE o_r END)) AS ecod FROM o GROUP BY row_id),
ml AS ({fixed_masks_long_sql()}),
dd AS (SELECT te_.row_id, subspace_id, SQRT(SUM(v * v * (1 - u) * (1 - u))) AS d FROM te_ JOIN ml ON te_.dim = ml.dim GROUP BY ALL),
di AS (SELECT row_id, MIN(d) / SQRT({WIDTH_SQL}) AS distance FROM dd GROUP BY row_id)
SELECT scored.row_id, ROUND(distance, 6) AS distance, ROUND(ecod, 6) AS ecod, scored.score AS lof
FROM scored JOIN e ON e.row_id = scored.row_id JOIN di ON di.row_id = scored.row_id""")
def q_fitted_model_scores(spark, sf_dir):
    """SRC-18: masks, ECDF tables and neighbours fitted on the training rows and saved as a version; a second
    store on the same folder loads it and scores the test rows."""
    ds = embedding_dataset(spark, sf_dir, 0)
    path = scratch_path(spark, "model")
    fit_model(ds.where("split = 'train'"), ModelStore(spark, path))
    s = score_rows(ds.where("split = 'test'").select("row_id", "x"), ModelStore(spark, path))
    return s.select("row_id", *[F.round(c, 6).alias(c) for c in ("distance", "ecod", "lof")])

"""Projections of numeric rows, soft masks per epoch and the pairing of scores with labels
(PRJ-07..10, PRJ-12, FN-14, FN-15, FN-20, SRT-05, SRC-19, JN-12)."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.hashing import h_sql
from ..operators.masks import fixed_masks, sample_subspaces, subspace_distribution
from ..operators.metrics import binary_metrics, metrics_sql
from ..operators.mmd import column_l2_normalize, hash_sample
from ..session import scratch_path, staged
from ..sources.datasets import embedding_matrix, width
from ..sources.models import ModelStore
from ..sources.tables import table
from .catalog import register
from .q_core import _draw_sql

_X_SQL = """xl AS (SELECT vec_id AS row_id, UNNEST(range(len(embedding))) AS dim, CAST(UNNEST(embedding) AS DOUBLE) AS v FROM embeddings)"""


def mean_vector(x, x_col="x"):
    """One row: the mean of every component (d sums)."""
    per = x.select(F.posexplode(x_col).alias("dim", "v")).groupBy("dim").agg(F.avg("v").alias("m"))
    return per.agg(F.sort_array(F.collect_list(F.struct("dim", "m"))).alias("_s")).select(F.transform("_s", lambda t: t["m"]).alias("means"))


@register("imputed_projections", f"""WITH {_draw_sql()}, {_X_SQL},
mu AS (SELECT dim, AVG(v) AS m FROM xl GROUP BY dim),
p AS (SELECT d.row_id, d.subspace_id, x.v, ml.u, x.v * ml.u AS s, x.v * ml.u + (1 - ml.u) * mu.m AS i
      FROM drawn d JOIN xl x ON x.row_id = d.row_id JOIN ml ON ml.subspace_id = d.subspace_id AND ml.dim = x.dim JOIN mu ON mu.dim = x.dim)
SELECT row_id, subspace_id, CAST(SUM(u) AS INTEGER) AS n_kept, ROUND(SQRT(SUM(CASE WHEN u = 1 THEN v * v ELSE 0 END)), 6) AS kept_norm,
       ROUND(SQRT(SUM(s * s)), 6) AS soft_norm, ROUND(SQRT(SUM(i * i)), 6) AS imputed_norm, ROUND(AVG(ABS(v - s)), 6) AS mean_l1,
       ROUND(SQRT(SUM((v - i) * (v - i))), 6) AS imputed_l2, ROUND(SUM(v * i) / SQRT(SUM(v * v) * SUM(i * i)), 6) AS imputed_cosine
FROM p GROUP BY ALL""")
def q_imputed_projections(spark, sf_dir):
    """PRJ-07/08/09 + FN-20: each row under its drawn mask, cut to the kept components, with zeros, and with the column
    means in place of the others; mean L1, L2 and cosine distances to the row."""
    x = embedding_matrix(spark, sf_dir)
    drawn = sample_subspaces(x, fixed_masks(spark, width(x), 8), seed=11)
    p = x.join(drawn, "row_id").join(F.broadcast(mean_vector(x)), how="inner", on=F.lit(True))
    p = p.select("row_id", "subspace_id", "x", V.hard_project("x", "mask").alias("kept"), V.soft_project("x", "mask").alias("soft"),
                 V.impute_project("x", "mask", "means").alias("imputed"))
    return p.select("row_id", "subspace_id", F.size("kept").alias("n_kept"), F.round(V.l2_norm("kept"), 6).alias("kept_norm"),
                    F.round(V.l2_norm("soft"), 6).alias("soft_norm"), F.round(V.l2_norm("imputed"), 6).alias("imputed_norm"),
                    F.round(V.l1_mean_dist("x", "soft"), 6).alias("mean_l1"), F.round(V.l2_dist("x", "imputed"), 6).alias("imputed_l2"),
                    F.round(V.cosine("x", "imputed"), 6).alias("imputed_cosine"))


@register("row_standardized", f"""WITH {_X_SQL},
m AS (SELECT row_id, AVG(v) AS mu, STDDEV_SAMP(v) AS sd FROM xl GROUP BY row_id),
z AS (SELECT xl.row_id, dim, (v - mu) / sd AS z FROM xl JOIN m ON m.row_id = xl.row_id),
n AS (SELECT row_id, SQRT(SUM(z * z)) AS nrm, MAX(z) AS hi, MIN(z) AS lo FROM z GROUP BY row_id)
SELECT row_id, ROUND(nrm, 6) AS norm, ROUND(hi / nrm, 6) AS largest, ROUND(lo / nrm, 6) AS smallest FROM n""")
def q_row_standardized(spark, sf_dir):
    """PRJ-12: rows standardised across their components (ddof 1), then of unit length."""
    x = embedding_matrix(spark, sf_dir).select("row_id", V.row_standardize("x").alias("z"))
    x = x.select("row_id", V.l2_norm("z").alias("norm"), V.row_l2_normalize("z").alias("z"))
    return x.select("row_id", F.round("norm", 6).alias("norm"), F.round(F.array_max("z"), 6).alias("largest"),
                    F.round(F.array_min("z"), 6).alias("smallest"))


@register("normalized_sample", f"""WITH {_X_SQL},
n AS (SELECT dim, SQRT(SUM(v * v)) AS nrm FROM xl GROUP BY dim),
s AS (SELECT vec_id AS row_id, row_number() OVER (ORDER BY {h_sql('vec_id', 23)}, vec_id) AS r FROM embeddings),
k AS (SELECT row_id FROM s WHERE r <= (SELECT COUNT(*) // 4 FROM embeddings)),
z AS (SELECT xl.row_id, xl.dim, v / CASE WHEN nrm = 0 THEN 1 ELSE nrm END AS z FROM xl JOIN n ON n.dim = xl.dim JOIN k ON k.row_id = xl.row_id)
SELECT row_id, ROUND(SQRT(SUM(z * z)), 6) AS norm, ROUND(MAX(CASE WHEN dim = 0 THEN z END), 6) AS first FROM z GROUP BY row_id""")
def q_normalized_sample(spark, sf_dir):
    """PRJ-10 + SRT-05: columns scaled to unit length, and of those rows a uniform sample of a quarter without replacement."""
    x = column_l2_normalize(embedding_matrix(spark, sf_dir))
    sample = hash_sample(x, x.count() // 4, seed=23)
    return sample.select("row_id", F.round(V.l2_norm("x"), 6).alias("norm"), F.round(F.get("x", 0), 6).alias("first"))


# ---------------------------------------------------------------- soft masks per epoch
EPOCHS = 2


def soft_masks(x, epoch: int):
    """A soft mask a row: the components' shares of the largest one, sharper each epoch."""
    top = F.array_max(F.transform("x", lambda v: F.abs(v)))
    return x.select("row_id", F.transform("x", lambda v: F.pow(F.abs(v) / top, epoch + 1.0)).alias("soft"))


class EpochTables:
    """SRC-19: one table an epoch; writing an epoch again replaces it at once, since readers take its last complete version."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def write(self, epoch: int, df) -> None:
        ModelStore(self.spark, f"{self.path}/epoch={epoch}").save({"subspaces": df})

    def read(self, epochs):
        parts = [ModelStore(self.spark, f"{self.path}/epoch={e}").load()[1]["subspaces"].withColumn("epoch", F.lit(e)) for e in epochs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def unique_subspaces(soft, digits: int = 1):
    """FN-14/15 + AGG-11: soft masks rounded to ``digits`` and counted, with the masks that they mean: at least a half,
    and above 1/d."""
    d = subspace_distribution(soft.select(V.round_array("soft", digits).alias("mask")))
    least = 1.0 / F.size("mask")
    return d.select("mask", "n_drawn", "proba", V.binarize("mask", 0.5).alias("half"),
                    F.transform("mask", lambda v: (v > least).cast("int")).alias("above"))


@register("soft_mask_epochs", f"""WITH {_X_SQL},
t AS (SELECT row_id, MAX(ABS(v)) AS top FROM xl GROUP BY row_id),
s AS (SELECT CAST(e AS INTEGER) AS epoch, xl.row_id, dim, ROUND(POW(ABS(v) / top, e + 1.0), 1) AS u
      FROM xl JOIN t ON t.row_id = xl.row_id, range({EPOCHS}) AS te(e)),
m AS (SELECT epoch, row_id, string_agg(CAST(CAST(ROUND(u * 10) AS BIGINT) AS VARCHAR), ',' ORDER BY dim) AS mask_key,
             SUM(CAST(u >= 0.5 AS INTEGER)) AS n_half, SUM(CAST(u > 1.0 / (SELECT MAX(len(embedding)) FROM embeddings) AS INTEGER)) AS n_above
      FROM s GROUP BY epoch, row_id)
SELECT epoch, mask_key, CAST(COUNT(*) AS BIGINT) AS n_drawn, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY epoch), 9) AS proba,
       CAST(MAX(n_half) AS BIGINT) AS n_half, CAST(MAX(n_above) AS BIGINT) AS n_above FROM m GROUP BY epoch, mask_key""")
def q_soft_mask_epochs(spark, sf_dir):
    """SRC-19 + FN-14/15: the distinct rounded masks of two epochs, each written as a table of its own (the second one
    twice, of which the last counts) and read back."""
    x = embedding_matrix(spark, sf_dir)
    tables = EpochTables(spark, scratch_path(spark, "epochs"))
    tables.write(1, unique_subspaces(soft_masks(x, 0)))
    for epoch in range(EPOCHS):
        tables.write(epoch, unique_subspaces(soft_masks(x, epoch)))
    count = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    return tables.read(range(EPOCHS)).select(
        "epoch", F.array_join(F.transform("mask", lambda v: F.round(v * 10).cast("long").cast("string")), ",").alias("mask_key"),
        F.col("n_drawn").cast("long").alias("n_drawn"), F.round("proba", 9).alias("proba"), count("half").alias("n_half"),
        count("above").alias("n_above"))


# ---------------------------------------------------------------- scores and labels
def pair_scores(scores, labels, key: str = "row_id"):
    """JN-12: (pairs, counts) of scores and labels by key: inner rows, and how many rows on either side had no partner.  The
    counts are observed by the job that writes the pairs."""
    seen = Observation("pairing")
    s = scores.withColumn("_s", F.lit(1))
    both = s.join(labels.withColumn("_l", F.lit(1)), key, "full")
    both = both.observe(seen, F.count(F.when(F.col("_s").isNotNull() & F.col("_l").isNotNull(), 1)).alias("paired"),
                        F.count(F.when(F.col("_l").isNull(), 1)).alias("scores_alone"),
                        F.count(F.when(F.col("_s").isNull(), 1)).alias("labels_alone"))
    pairs = staged(both.where("_s is not null and _l is not null").drop("_s", "_l"), "pairs")
    return pairs, seen.get


@register("score_label_pairing", f"""WITH s AS (SELECT vec_id AS row_id,
       ROUND(SQRT(list_sum(list_transform(embedding[1:8], lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))), 6) AS score FROM embeddings),
l AS (SELECT doc_id AS row_id, CAST(quality <> 1 AS INTEGER) AS outlier FROM labels),
scored AS (SELECT s.row_id, score, outlier FROM s JOIN l ON s.row_id = l.row_id),
{metrics_sql('scored')},
c AS (SELECT CAST(COUNT(*) FILTER (WHERE s.row_id IS NOT NULL AND l.row_id IS NOT NULL) AS BIGINT) AS paired,
             CAST(COUNT(*) FILTER (WHERE l.row_id IS NULL) AS BIGINT) AS scores_alone,
             CAST(COUNT(*) FILTER (WHERE s.row_id IS NULL) AS BIGINT) AS labels_alone
      FROM s FULL JOIN l ON s.row_id = l.row_id)
SELECT auc, prauc, f1, paired, scores_alone, labels_alone FROM _metrics, c""")
def q_score_label_pairing(spark, sf_dir):
    """JN-12: scores of the vectors (the length of their first eight components) paired with the document labels of the
    same number, of which either side has rows that the other lacks."""
    e = table(spark, sf_dir, "embeddings")
    scores = e.select(F.col("vec_id").alias("row_id"), F.round(V.l2_norm(F.slice(V.as_double_array("embedding"), 1, 8)), 6).alias("score"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), (F.col("quality") != 1).cast("int").alias("outlier"))
    pairs, counts = pair_scores(scores, labels)
    m = binary_metrics(pairs.select("score", "outlier")).select("auc", "prauc", "f1")
    return m.select("*", *[F.lit(counts[c]).cast("long").alias(c) for c in ("paired", "scores_alone", "labels_alone")])

"""Combining per-subspace scores (AGG-15..18) and simple scorers (MDL-11, MDL-12).

Per-subspace scores arrive in long form ``(group..., subspace_id, row_id, score)``;
the subspace table (``subspace_id, proba``) is small and joins by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import h, uniform


def weighted_average(scores: DataFrame, probs: DataFrame, id_cols=("row_id",), group_cols=(),
                     out_col: str = "ensemble") -> DataFrame:
    """AGG-15: sum_j s_j p_j / sum_j p_j per row."""
    g, ids = list(group_cols), list(id_cols)
    j = scores.join(probs.select("subspace_id", "proba"), "subspace_id")
    return j.groupBy(*g, *ids).agg(
        (F.sum(F.col("score") * F.col("proba")) / F.sum("proba")).alias(out_col))


def weighted_mean_over_m(scores: DataFrame, probs: DataFrame, id_cols=("row_id",), group_cols=(),
                         out_col: str = "ensemble") -> DataFrame:
    """AGG-17 (text variant): sum_j p_j s_j / m (m = number of subspaces)."""
    g, ids = list(group_cols), list(id_cols)
    j = scores.join(probs.select("subspace_id", "proba"), "subspace_id")
    return j.groupBy(*g, *ids).agg(
        (F.sum(F.col("score") * F.col("proba")) / F.count(F.lit(1))).alias(out_col))


def pick_one(scores: DataFrame, probs: DataFrame, n_subspaces: int, seed: int = 5,
             id_col: str = "row_id", group_cols=(), out_col: str = "ensemble") -> DataFrame:
    """AGG-16 "exact": every row is scored by one subspace drawn uniformly
    (hash of the row id), times that subspace's normalised weight."""
    g = list(group_cols)
    tot = probs.agg(F.sum("proba").alias("_ps"))
    pick = scores.filter(F.pmod(h(id_col, seed), F.lit(n_subspaces)) == F.col("subspace_id"))
    return pick.join(probs.select("subspace_id", "proba"), "subspace_id") \
        .join(F.broadcast(tot), how="inner", on=F.lit(True)) \
        .select(*g, id_col, (F.col("proba") / F.col("_ps") * F.col("score")).alias(out_col))


def final_score(ensemble: DataFrame | None, distance: DataFrame | None, delta: float, lam: float,
                id_cols=("row_id",), group_cols=()) -> DataFrame:
    """AGG-18: delta * ensemble + lambda * distance; a branch whose weight is 0
    is not computed at all (decided when the plan is built)."""
    keys = list(group_cols) + list(id_cols)
    if delta != 0 and lam != 0:
        j = ensemble.join(distance, keys)
        return j.select(*keys, (F.lit(delta) * F.col("ensemble") + F.lit(lam) * F.col("distance")).alias("score"))
    if delta != 0:
        return ensemble.select(*keys, (F.lit(delta) * F.col("ensemble")).alias("score"))
    return distance.select(*keys, (F.lit(lam) * F.col("distance")).alias("score"))


def random_scores(df: DataFrame, seed: int = 1, id_col: str = "row_id", out_col: str = "score") -> DataFrame:
    """MDL-12: random-score baseline, uniform per row id."""
    return df.withColumn(out_col, uniform(id_col, seed))


# Member count and seed of the feature-bagging mask draw.
BAGGING_MEMBERS = 10
BAGGING_SEED = 13


def bagging_masks_long(spark, d: int, members: int = BAGGING_MEMBERS, seed: int = BAGGING_SEED) -> DataFrame:
    """MDL-11 masks: member e keeps s_e = floor(d/2) + h(e) mod (d - floor(d/2))
    features (so floor(d/2) .. d-1), namely the s_e dimensions with the smallest
    hash h("e:i").  Long form (subspace_id, dim)."""
    from pyspark.sql import Window
    half = d // 2
    e = spark.range(members).select(F.col("id").cast("int").alias("subspace_id"))
    size = (F.lit(half) + F.pmod(h(F.col("subspace_id").cast("long"), seed), F.lit(d - half))).alias("k")
    dims = e.select("subspace_id", size, F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("dim"))
    w = Window.partitionBy("subspace_id").orderBy(
        h(F.concat_ws(":", F.col("subspace_id").cast("string"), F.col("dim").cast("string")), seed + 1), "dim")
    return dims.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= F.col("k")) \
        .select("subspace_id", F.col("dim").cast("int").alias("dim"))

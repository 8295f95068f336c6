"""AGG-14: distance of every row to its nearest subspace.

    dist(x) = min_j || t(x) - t(u_j * x) ||_2  (/ sqrt(d) when scaled)

The subspace table is cut into chunks of a bounded number of cells; each chunk is packed
into one row, attached to every data row by a broadcast join, and folded into a running
minimum.  So there is one plan for every size of that table, and the data is not shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2_dist, masked_residual_sq, soft_project
from .masks import MAX_BROADCAST_MASK_CELLS


def subspace_distance(df: DataFrame, masks: DataFrame, d: int, x_col: str = "x",
                      scale: bool = True, transform=None,
                      out_col: str = "distance", max_cells: int = MAX_BROADCAST_MASK_CELLS) -> DataFrame:
    """Adds ``out_col``; ``transform`` (UDF-02) maps an array column to an array
    column and is applied to both the point and its projection."""
    if not masks.columns or "mask" not in masks.columns:
        raise ValueError("masks must have a 'mask' column")
    n_masks = masks.count()
    if n_masks == 0:
        raise ValueError("no subspaces given")
    denom = math.sqrt(d) if scale else 1.0

    def one(x, m):
        if transform is None:
            return F.sqrt(masked_residual_sq(x, m))
        return l2_dist(transform(x), transform(soft_project(x, m)))

    chunks = max(1, math.ceil(n_masks * d / max_cells))
    numbered = masks.select("mask", F.pmod(F.xxhash64("subspace_id", "mask"), F.lit(chunks)).alias("_chunk"))
    out = df.withColumn(out_col, F.lit(None).cast("double"))
    for k in range(chunks):
        packed = numbered.where(F.col("_chunk") == k).agg(F.collect_list("mask").alias("_masks"))
        best = F.array_min(F.transform("_masks", lambda m: one(F.col(x_col), m))) / F.lit(denom)
        out = out.join(F.broadcast(packed), how="inner", on=F.lit(True)) \
            .withColumn(out_col, F.least(out_col, best)).drop("_masks")
    return out


def min_projected_distance(df: DataFrame, projections: DataFrame, x_col: str = "x",
                           out_col: str = "distance") -> DataFrame:
    """Word-variant helper (no scaling): minimum over given projection vectors
    p_j of ||x - p_j||, where projections are per-row arrays of arrays."""
    return df.withColumn(out_col, F.array_min(F.transform(projections, lambda p: l2_dist(F.col(x_col), p))))

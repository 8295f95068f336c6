"""Subspace (feature-mask) tables and their statistics.

A subspace table is ``subspace_id int, mask array<int>, proba double``; it holds
at most a few hundred masks, so it is the one kind of table this package
collects or broadcasts (callers check its size with ``mask_rows``).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import h
from ..functions.vectors import mask_text

# Fixed values of the deterministic mask table: bit i of mask j is
# (h("i:j", 7) div 65536) mod 2; mask j has weight 1/(j+1).
MASK_SEED = 7
MAX_BROADCAST_MASK_CELLS = 4_000_000


def _lcm_upto(m: int) -> int:
    return reduce(lambda a, b: a * b // math.gcd(a, b), range(1, m + 1), 1)


def fixed_masks(spark: SparkSession, d: int, m: int = 8, seed: int = MASK_SEED) -> DataFrame:
    """MDL-07: a fixed mask distribution (no learning).  ``weight`` is the
    integer lcm(1..m)/(j+1) so sampling can be done in exact integer arithmetic."""
    L = _lcm_upto(m)
    base = spark.range(m).select(F.col("id").cast("int").alias("subspace_id"))
    mask = F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                       lambda i: (F.floor(h(F.concat_ws(":", i.cast("string"), F.col("subspace_id").cast("string")), seed) / 65536)
                                  % 2).cast("int"))
    weight = (F.lit(L) / (F.col("subspace_id") + 1)).cast("long")
    total = sum(L // (j + 1) for j in range(m))
    return base.select("subspace_id", mask.alias("mask"), weight.alias("weight"),
                       (weight / F.lit(float(total))).alias("proba"))


def mask_rows(masks: DataFrame, max_cells: int = MAX_BROADCAST_MASK_CELLS):
    """Collect a subspace table after checking its size bound."""
    rows = masks.select("subspace_id", "mask", "proba").orderBy("subspace_id").collect()
    cells = sum(len(r["mask"]) for r in rows)
    if cells > max_cells:
        raise ValueError(f"subspace table has {cells} cells, above the broadcast bound {max_cells}")
    return rows


def sample_subspaces(rows: DataFrame, masks: DataFrame, seed: int = 11, id_col: str = "row_id") -> DataFrame:
    """MDL-05 with a fixed distribution: every data row draws one subspace with
    probability proportional to its integer weight (exact inverse-CDF on a hash)."""
    w = Window.orderBy("subspace_id").rowsBetween(Window.unboundedPreceding, 0)  # over the mask table only
    cum = masks.select("subspace_id", "mask", "weight",
                       (F.sum("weight").over(w) - F.col("weight")).alias("w_lo"),
                       F.sum("weight").over(w).alias("w_hi")).where("weight > 0")
    size = masks.agg(F.sum("weight").alias("w_total"), F.greatest(F.lit(1), F.count(F.lit(1))).alias("w_masks")).withColumn(
        "w_step", F.expr("greatest(1, w_total div w_masks)"))  # one row
    r = rows.select(id_col).join(F.broadcast(size), how="inner", on=F.lit(True)) \
        .select(id_col, F.pmod(h(id_col, seed), F.col("w_total")).alias("draw"), "w_step").withColumn("w_slot", F.expr("draw div w_step"))
    # Each mask's interval of weights touches some slots of equal width, two a mask on average, so the look-up is an
    # equi-join on the slot, for mask tables of any size.
    slots = cum.join(F.broadcast(size), how="inner", on=F.lit(True)).withColumn(
        "w_slot", F.explode(F.sequence(F.expr("w_lo div w_step"), F.expr("(w_hi - 1) div w_step")))).select("subspace_id", "mask", "w_lo", "w_hi", "w_slot")
    return r.join(slots, "w_slot").where("draw >= w_lo and draw < w_hi").select(id_col, "subspace_id", "mask")


def subspace_distribution(drawn: DataFrame, mask_col: str = "mask") -> DataFrame:
    """AGG-11 (+SRT-02): distinct masks and their relative frequency."""
    total = drawn.agg(F.count(F.lit(1)).alias("_n"))
    c = drawn.groupBy(mask_col).agg(F.count(F.lit(1)).alias("n_drawn"))
    return c.join(F.broadcast(total), how="inner", on=F.lit(True)) \
        .select(mask_col, "n_drawn", (F.col("n_drawn") / F.col("_n")).alias("proba"))


def top_subspaces(dist: DataFrame, k: int, mask_col: str = "mask") -> DataFrame:
    """SRT-01: k most probable masks, probabilities renormalised to 1.
    Ties on probability are broken by the mask text (deterministic)."""
    t = dist.withColumn("_key", mask_text(mask_col)).orderBy(F.desc("proba"), "_key").limit(k)
    s = t.agg(F.sum("proba").alias("_s"))
    return t.join(F.broadcast(s), how="inner", on=F.lit(True)) \
        .select(mask_col, (F.col("proba") / F.col("_s")).alias("proba"), "_key")


def drop_zero_masks(masks: DataFrame, mask_col: str = "mask") -> DataFrame:
    """PRJ-13: remove all-zero masks (probabilities are not renormalised); an error if none remain."""
    kept = masks.filter(F.exists(mask_col, lambda v: v != 0))
    if kept.isEmpty():
        raise ValueError("no subspace with a feature remains")
    return kept


def average_subspace(masks: DataFrame, mask_col: str = "mask", weight_col: str | None = None) -> DataFrame:
    """AGG-13: per-dimension selection rate (weighted by ``weight_col`` if given)."""
    e = masks.select(F.posexplode(mask_col).alias("dim", "u"),
                     *( [F.col(weight_col).alias("_w")] if weight_col else [F.lit(1.0).alias("_w")]))
    return e.groupBy("dim").agg((F.sum(F.col("u") * F.col("_w")) / F.sum("_w")).alias("rate"))


def with_leftover(dist: DataFrame, mask_col: str = "mask") -> DataFrame:
    """AGG-12: a distribution of masks with the leftover mask, if there is one, as one more of weight 1; all weights
    together are 1 again."""
    both = dist.select(mask_col, "proba").unionByName(leftover_mask(dist, mask_col).select(mask_col, F.lit(1.0).alias("proba")))
    total = both.agg(F.sum("proba").alias("_s"))  # one row
    return both.join(F.broadcast(total), how="inner", on=F.lit(True)).select(mask_col, (F.col("proba") / F.col("_s")).alias("proba"))


def leftover_mask(masks: DataFrame, mask_col: str = "mask") -> DataFrame:
    """AGG-12: dimensions used by no mask, as one extra mask (one row, or none
    when every dimension is covered)."""
    e = masks.select(F.posexplode(mask_col).alias("dim", "u"))
    used = e.groupBy("dim").agg(F.max("u").alias("used"))
    return used.agg(F.sort_array(F.collect_list(F.struct("dim", (1 - F.col("used")).alias("u")))).alias("s")) \
        .select(F.transform("s", lambda t: t["u"]).alias(mask_col)) \
        .filter(F.exists(mask_col, lambda v: v == 1))

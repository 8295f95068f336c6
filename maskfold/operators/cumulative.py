"""Running totals over an ordered key without one-task-per-group windows.

A plain ``sum() over (partition by g order by v)`` puts every row of a group
into a single task.  Here the caller passes one row per distinct ``(g, v)``
(after a map-side partial aggregation, so a value carried by a third of all rows
is one row), the rows are cut into ``n_buckets`` value ranges per group (by default
as many as the session has shuffle partitions) with approximate quantiles, bucket totals (groups x buckets rows) give each bucket
its offset, and the window runs per (group, bucket).  Exact: buckets only move
work between tasks, never change a sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def running_totals(df: DataFrame, keys, order_col: str, sum_cols, n_buckets: int | None = None,
                   accuracy: int = 10000) -> DataFrame:
    """For a frame with one row per (keys, order_col) add ``<c>_cum`` (sum of c
    over rows of the same keys with order value <= this one) and ``<c>_tot``
    (group total) for every c in ``sum_cols``."""
    keys = list(keys)
    drop_all = not keys
    if drop_all:
        df = df.withColumn("_all", F.lit(0))
        keys = ["_all"]
    sum_cols = list(sum_cols)
    n_buckets = max(2, n_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probs = [i / n_buckets for i in range(1, n_buckets)]
    splits = df.groupBy(*keys).agg(
        F.percentile_approx(F.col(order_col), probs, accuracy).alias("_splits"))

    # Side tables hold (#groups x n_buckets) rows.  Without group keys that is
    # one row (a proven bound): broadcast it.  With group keys the size is
    # only known at runtime, so the join is left to AQE, which turns it into a
    # broadcast join when the materialised table is below the threshold.
    def side(t):
        return F.broadcast(t) if drop_all else t

    b = df.join(side(splits), keys).withColumn(
        "_bucket", F.size(F.filter("_splits", lambda s: s < F.col(order_col)))).drop("_splits")
    tot = b.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_bt_{c}") for c in sum_cols])
    wk = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    wall = Window.partitionBy(*keys)
    off = tot.select(*keys, "_bucket", *[
        (F.sum(f"_bt_{c}").over(wk) - F.col(f"_bt_{c}")).alias(f"_off_{c}") for c in sum_cols],
        *[F.sum(f"_bt_{c}").over(wall).alias(f"{c}_tot") for c in sum_cols])
    j = b.join(side(off), keys + ["_bucket"])
    wb = Window.partitionBy(*keys, "_bucket").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    out = j.select(*[F.col(c) for c in b.columns if c != "_bucket"],
                   *[(F.sum(c).over(wb) + F.col(f"_off_{c}")).alias(f"{c}_cum") for c in sum_cols],
                   *[F.col(f"{c}_tot") for c in sum_cols])
    return out.drop("_all") if drop_all else out

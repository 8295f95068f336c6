"""Rank statistics over result tables: pooled average ranks, Kruskal-Wallis and Conover-Iman
statistics, significance symbols (AGG-30..32)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged


def pooled_average_ranks(df: DataFrame, keys, value_col: str) -> DataFrame:
    """Average (mid) ranks of ``value_col`` pooled within ``keys``: values
    below + (ties + 1) / 2, by one window over the distinct values of a cohort.  Cohorts are result tables: a row
    per method, dataset and run."""
    keys = list(keys)
    cnt = df.groupBy(*keys, value_col).agg(F.count(F.lit(1)).alias("t"))
    upto = Window.partitionBy(*keys).orderBy(value_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = cnt.select(*keys, value_col, "t", (F.sum("t").over(upto) - F.col("t") + (F.col("t") + 1) / 2.0).alias("prank"))
    return df.join(ranks, keys + [value_col])


def kruskal_conover(ranked: DataFrame, keys, group_col: str, value_col: str):
    """Kruskal-Wallis H (tie-corrected) and the Conover-Iman pairwise t statistic.

    ``ranked`` holds one row per observation (group_col, value_col) within the
    cohort ``keys``.  Returns (h_table, pairs_table) DataFrames:
    h_table: keys..., n, k, h, h_cor;  pairs: keys..., a, b, t_stat, df, mean_rank_a, mean_rank_b.
    """
    keys = list(keys)
    r = staged(pooled_average_ranks(staged(ranked, "cohort"), keys, value_col), "cohort-ranks")  # read by several branches
    per = r.groupBy(*keys, group_col).agg(F.count(F.lit(1)).alias("ni"), F.sum("prank").alias("ri"),
                                          F.avg("prank").alias("mean_rank"))
    ties = r.select(*keys, value_col, "t").distinct().groupBy(*keys).agg(
        F.sum(F.pow(F.col("t"), 3) - F.col("t")).alias("tie"))
    sq = r.groupBy(*keys).agg(F.sum(F.col("prank") * F.col("prank")).alias("r2"), F.count(F.lit(1)).alias("n"))
    hs = per.groupBy(*keys).agg(F.sum(F.col("ri") * F.col("ri") / F.col("ni")).alias("sr"),
                                F.count(F.lit(1)).alias("k"))
    n = F.col("n").cast("double")
    h = hs.join(sq, keys).join(ties, keys).select(
        *keys, "n", "k", "r2",
        (12.0 / (n * (n + 1)) * F.col("sr") - 3 * (n + 1)).alias("h"),
        (1 - F.col("tie") / (n * n * n - n)).alias("ties_factor"))
    h = h.withColumn("h_cor", F.col("h") / F.col("ties_factor"))
    a = per.select(*keys, F.col(group_col).alias("a"), F.col("ni").alias("na"), F.col("mean_rank").alias("mean_rank_a"))
    b = per.select(*keys, F.col(group_col).alias("b"), F.col("ni").alias("nb"), F.col("mean_rank").alias("mean_rank_b"))
    s2 = (F.col("r2") - n * (n + 1) * (n + 1) / 4.0) / (n - 1)
    pairs = a.join(b, keys).filter(F.col("a") != F.col("b")).join(h, keys).select(
        *keys, "a", "b", "mean_rank_a", "mean_rank_b",
        (F.abs(F.col("mean_rank_a") - F.col("mean_rank_b"))
         / F.sqrt(s2 * (1.0 / F.col("na") + 1.0 / F.col("nb")) * (n - 1 - F.col("h_cor")) / (n - F.col("k"))))
        .alias("t_stat"),
        (n - F.col("k")).alias("df"))
    return h, pairs


def significance_symbol(p, mean_a, mean_b, same) -> "F.Column":
    """AGG-32: '=' on the diagonal; '++'/'+' when a ranks better (lower mean
    rank) at p <= .05 / .10; '- -'/'-' when worse; '' otherwise."""
    return (F.when(same, F.lit("="))
            .when((p <= 0.10) & (mean_a < mean_b), F.when(p <= 0.05, F.lit("++")).otherwise(F.lit("+")))
            .when((p <= 0.10) & (mean_a > mean_b), F.when(p <= 0.05, F.lit("- -")).otherwise(F.lit("-")))
            .otherwise(F.lit("")))

"""Connected components of an undirected graph given as edges (large-star, small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stage_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie the neighbours of each node to its smallest neighbour: the larger ones (large),
    or the smaller ones and the node itself (small).  ``edges`` holds u > v once."""
    if large:
        around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("m", "u").alias("m"))
    # written, so that AQE may split the edges of a hot node
    joined = around.join(stage_table(least, "least"), F.col("u") == F.col("of"))
    if large:
        pairs = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        pairs = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            joined.select("u", F.col("m").alias("v")))
    return pairs.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b): the smallest node it is linked with.

    Null ends are ignored; repeated edges and loops do no harm; no edges give no rows."""
    now = stage_table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                      "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not state[0] or state == seen:
            break
        seen = state
        now = stage_table(_star(stage_table(_star(now, True), "large"), False), "small")
    # now a forest of stars: each node other than a root has its root
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

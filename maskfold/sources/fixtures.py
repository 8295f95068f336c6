"""Fixture generators (SRC-07..10) for tests; registered queries never use them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replicated_samples(spark: SparkSession, samples, n: int) -> DataFrame:
    """SRC-07: row i holds samples[i mod k], label 0."""
    k = len(samples)
    arr = F.array(*[F.lit(s) for s in samples])
    return spark.range(n).select(F.col("id").alias("row_id"), F.get(arr, (F.col("id") % k).cast("int")).alias("x"),
                                 F.lit(0).alias("y"))


def shifted_patterns(spark: SparkSession, patterns, n_per: int, pad: str = "_") -> DataFrame:
    """SRC-08: population i is prefixed by i blank blocks of the pattern length."""
    rows = []
    for i, p in enumerate(patterns):
        toks = p.split(" ")
        rows += [(i * n_per + j, " ".join([pad] * (i * len(toks)) + toks)) for j in range(n_per)]
    return spark.createDataFrame(rows, "row_id long, x string").withColumn("y", F.lit(0))


def correlated_gaussian(spark: SparkSession, n: int = 1000, seed: int = 42, noise: float = 0.1) -> DataFrame:
    """SRC-09: 10 columns; 0-2 share one latent, 3-4 another, 5-9 noise."""
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=n)
    cols = [a + noise * rng.normal(size=n) for _ in range(3)] + [b + noise * rng.normal(size=n) for _ in range(2)] \
        + [rng.normal(size=n) for _ in range(5)]
    X = np.stack(cols, 1)
    return spark.createDataFrame([(i, list(map(float, X[i]))) for i in range(n)], "row_id long, x array<double>")


def plane_axis_mixture(spark: SparkSession, n: int = 600, frac: float = 0.5, seed: int = 0) -> DataFrame:
    """SRC-10: a fraction on the (x, y, 0) plane, the rest on the z axis."""
    rng = np.random.default_rng(seed)
    k = int(n * frac)
    X = np.zeros((n, 3))
    X[:k, :2] = rng.normal(size=(k, 2))
    X[k:, 2] = rng.normal(size=n - k)
    return spark.createDataFrame([(i, list(map(float, X[i]))) for i in range(n)], "row_id long, x array<double>")

"""Array<double> column expressions: norms, projections, distances.

All of these are higher-order SQL functions evaluated on the JVM; none of them
moves data between executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once a row: an expression inside a lambda is evaluated again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def as_double_array(col) -> Column:
    """float32 embeddings are widened before any arithmetic."""
    return _c(col).cast("array<double>")


def vsum(arr) -> Column:
    return F.aggregate(_c(arr), F.lit(0.0), lambda acc, v: acc + v)


def sq_norm(arr) -> Column:
    return F.aggregate(_c(arr), F.lit(0.0), lambda acc, v: acc + v * v)


def l2_norm(arr) -> Column:
    return F.sqrt(sq_norm(arr))


def dot(a, b) -> Column:
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def sq_dist(a, b) -> Column:
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def l2_dist(a, b) -> Column:
    return F.sqrt(sq_dist(a, b))


def l1_mean_dist(a, b) -> Column:
    """FN-20: mean absolute difference."""
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y))) / F.size(_c(a))


def cosine(a, b) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b))  # no lambda: each part is evaluated once


def row_l2_normalize(arr, eps: float = 1e-12) -> Column:
    """PRJ-11: x / max(||x||, eps)."""
    return let(_c(arr), lambda a: let(F.greatest(l2_norm(a), F.lit(eps)), lambda n: F.transform(a, lambda v: v / n)))


def row_standardize(arr) -> Column:
    """PRJ-12 (first half): (x - mean) / std with ddof=1 across the row."""
    def scaled(a, mean):
        squares = F.aggregate(a, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean))
        return let(F.sqrt(squares / (F.size(a) - 1)), lambda sd: F.transform(a, lambda v: (v - mean) / sd))

    return let(_c(arr), lambda a: let(vsum(a) / F.size(a), lambda mean: scaled(a, mean)))


def soft_project(arr, mask) -> Column:
    """PRJ-08: u * x, same width."""
    return F.zip_with(_c(arr), _c(mask), lambda v, m: v * m)


def hard_project(arr, mask) -> Column:
    """PRJ-07: keep positions whose mask is 1."""
    m = _c(mask)
    return F.filter(_c(arr), lambda v, i: F.get(m, i) == 1)


def impute_project(arr, mask, means) -> Column:
    """PRJ-09: u*x + (1-u)*mean."""
    a, m, mu = _c(arr), _c(mask), _c(means)
    return F.transform(a, lambda v, i: F.get(m, i) * v + (1 - F.get(m, i)) * F.get(mu, i))


def masked_residual_sq(arr, mask) -> Column:
    """||x - u*x||^2 = sum x_i^2 (1-u_i)^2."""
    return vsum(F.zip_with(_c(arr), _c(mask), lambda v, m: v * v * (1 - m) * (1 - m)))


def binarize(arr, threshold: float = 0.5, strict: bool = False) -> Column:
    """FN-14: soft mask -> 0/1 (>= t, or > t when strict)."""
    if strict:
        return F.transform(_c(arr), lambda v: F.when(v > threshold, 1).otherwise(0))
    return F.transform(_c(arr), lambda v: F.when(v >= threshold, 1).otherwise(0))


def round_array(arr, digits: int = 1) -> Column:
    """FN-15: round soft masks for grouping."""
    return F.transform(_c(arr), lambda v: F.round(v, digits))


def mask_text(arr) -> Column:
    """Canonical string key of a 0/1 mask, e.g. '1011'."""
    return F.concat_ws("", F.transform(_c(arr), lambda v: v.cast("string")))

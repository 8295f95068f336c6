"""Deterministic pseudo-random numbers shared by Spark and plain SQL engines.

Every random draw of the package (train/test split, samples, random scores,
feature-bagging masks, fixed mask tables) is a function of a key and a seed,
so results do not depend on partitioning and an SQL oracle can reproduce them.

The draw is 31 bits of the md5 of "key|seed": any 64-bit id (or text key) works
without overflow, and draws of different seeds are independent.  A null key
counts as an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2147483648  # 2**31


def _draw(key: Column, seed: Column) -> Column:
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), seed.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.lit(MODULUS)


def h(id_col, seed: int) -> Column:
    """h(key, s) in [0, 2^31) (BIGINT)."""
    return _draw(F.col(id_col) if isinstance(id_col, str) else id_col, F.lit(seed))


def h_col(id_col, seed_col) -> Column:
    """h with a per-row seed column (e.g. one seed per experiment run)."""
    return _draw(F.col(id_col) if isinstance(id_col, str) else id_col,
                 F.col(seed_col) if isinstance(seed_col, str) else seed_col)


def h_sql_seed(id_expr: str, seed_expr: str) -> str:
    """The same draw as DuckDB SQL text."""
    return (f"(CAST('0x' || substr(md5(COALESCE(CAST(({id_expr}) AS VARCHAR), '') || '|' || CAST(({seed_expr}) AS VARCHAR)), 1, 8) "
            f"AS BIGINT) % {MODULUS})")


def h_sql(id_expr: str, seed: int) -> str:
    return h_sql_seed(id_expr, str(seed))


def uniform(id_col, seed: int) -> Column:
    """Uniform [0, 1) draw per id."""
    return h(id_col, seed) / F.lit(float(MODULUS))

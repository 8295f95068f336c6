"""SQL fragments shared by the oracle queries (plain SQL that DuckDB runs on the
same parquet tables).  They restate, in SQL, what the DataFrame operators
compute, so each registered query can be checked against an independent engine."""

from __future__ import annotations

from ..functions.hashing import h_sql
from ..operators.masks import MASK_SEED, _lcm_upto


def split_sql(id_expr: str, seed: int = 42, test_mod: int = 5) -> str:
    return f"CASE WHEN {h_sql(id_expr, seed)} % {test_mod} = 0 THEN 'test' ELSE 'train' END"


def emb_dataset_sql(inlier: int = 0, seed: int = 42) -> str:
    """CTE body: row_id, split, label, outlier for the embeddings one-class dataset."""
    return f"""SELECT * FROM (
        SELECT vec_id AS row_id, {split_sql('vec_id', seed)} AS split, CAST(label AS INTEGER) AS label,
               CAST(label <> {inlier} AS INTEGER) AS outlier, embedding
        FROM embeddings) WHERE split = 'test' OR label = {inlier}"""


def emb_long_sql(src: str = "embeddings", id_col: str = "vec_id") -> str:
    """CTE body: (row_id, dim, v) long form of the embedding vectors."""
    return f"""SELECT {id_col} AS row_id, UNNEST(range(len(embedding))) AS dim,
                      CAST(UNNEST(embedding) AS DOUBLE) AS v FROM {src}"""


# the width of the embeddings, as the queries take it from the table
WIDTH_SQL = "(SELECT MAX(len(embedding)) FROM embeddings)"


def fixed_masks_long_sql(d: int | str = WIDTH_SQL, m: int = 8, seed: int = MASK_SEED) -> str:
    """CTE body: (subspace_id, dim, u) of the fixed mask table."""
    return f"""SELECT CAST(j AS INTEGER) AS subspace_id, CAST(i AS INTEGER) AS dim,
               CAST(({h_sql("i || ':' || j", seed)} // 65536) % 2 AS INTEGER) AS u
               FROM range({m}) AS tj(j), (SELECT UNNEST(range(CAST({d} AS BIGINT))) AS i) AS ti"""


def fixed_mask_weights_sql(m: int = 8) -> str:
    L = _lcm_upto(m)
    total = sum(L // (j + 1) for j in range(m))
    return f"""SELECT CAST(j AS INTEGER) AS subspace_id, CAST({L} // (j + 1) AS BIGINT) AS weight,
               CAST({L} // (j + 1) AS BIGINT) / {float(total)} AS proba FROM range({m}) AS tj(j)"""

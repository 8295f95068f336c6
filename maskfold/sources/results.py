"""Result tables: sinks, result-tree scans, upserts (SRC-14..17, JN-07)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache import RowCache

def write_results_csv_tree(df: DataFrame, root: str) -> None:
    """Write the reference's folder layout dataset/model/run_k/results.csv."""
    out = df.withColumn("run_dir", F.concat(F.lit("run_"), F.col("run").cast("string")))
    out.drop("run").write.mode("append").option("header", True).partitionBy("dataset", "emb_model", "run_dir").csv(root)


def scan_result_tree(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """SRC-14: recursive CSV read; folder names become columns."""
    df = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(root)
    f = F.input_file_name()
    return df.withColumn("dataset", F.regexp_extract(f, r"dataset=([^/]+)/", 1)) \
        .withColumn("emb_model", F.regexp_extract(f, r"emb_model=([^/]+)/", 1)) \
        .withColumn("run", F.regexp_extract(f, r"run_dir=run_(\d+)/", 1).cast("int"))


def gated_scan(results: DataFrame, criteria: DataFrame, keys=("dataset", "emb_model", "run")) -> DataFrame:
    """SRC-15: keep only folders that also have a criteria row (inner join
    replaces the gate); the folders without one are the bad-folder report."""
    return results.join(criteria.select(*keys).distinct(), list(keys), "inner")


def select_rows(results: DataFrame, include: dict[str, list] | None = None, exclude: dict[str, list] | None = None) -> DataFrame:
    """PRJ-15: rows whose columns hold one of the values to include and none of those to exclude; a null holds no value, so it
    is in no list."""
    for column, values in (include or {}).items():
        results = results.where(F.col(column).isin(list(values)))
    for column, values in (exclude or {}).items():
        results = results.where(~F.coalesce(F.col(column).isin(list(values)), F.lit(False)))
    return results


def upsert(existing: DataFrame, new: DataFrame, keys) -> DataFrame:
    """SRC-17: rows of ``new`` replace rows of ``existing`` with the same keys."""
    return existing.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def pending(spec: DataFrame, done: DataFrame, keys) -> DataFrame:
    """JN-07: work in the spec that has no finished row yet (null-safe keys)."""
    s = spec.fillna("no_prompt", subset=[k for k in keys if dict(spec.dtypes).get(k) == "string"])
    d = done.fillna("no_prompt", subset=[k for k in keys if dict(done.dtypes).get(k) == "string"])
    return s.join(d.select(*keys), list(keys), "left_anti")


def incremental_append(spark: SparkSession, source: DataFrame, cache_path: str, key: str, transform) -> DataFrame:
    """SRC-12/13 without an early stop: transform and append the rows that the cache lacks; the full cache."""
    return RowCache(spark, cache_path, key, transform).fill(source)

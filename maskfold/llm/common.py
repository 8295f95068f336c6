"""Helpers shared by the operators of this sub-package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from maskfold.session import scratch_path

# ASCII white space: space and the characters 9 to 13
WS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_LONG = 2**63 - 1


def text_of(col: str = "text") -> Column:
    """The text, a null as the empty string."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def id_of(col: str = "doc_id") -> Column:
    """A working id that orders a null after every other id."""
    return F.coalesce(F.col(col).cast("long"), F.lit(MAX_LONG))


def lower_ascii(col: Column) -> Column:
    """A-Z lower-cased, other letters as they are (``lower`` does just that to pure ASCII, faster)."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def without_spaces(col: Column) -> Column:
    for c in WS:
        col = F.replace(col, F.lit(c), F.lit(""))
    return col


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the cluster's shared folder and read it back.

    It cuts the lineage: a lost executor costs a re-read and not a recomputation,
    and a plan with several consumers runs its input once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``, the rank from 1 in a total order, without a single-task sort.

    Rows are range-partitioned by the order and numbered inside each range; the
    ranges' offsets come from one count per range (as many rows as partitions)."""
    part = "__range"
    ranged = stage_table(
        df.repartitionByRange(n_partitions(df.sparkSession), *order).withColumn(part, F.spark_partition_id()), "rank")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(part).agg(F.count("*").alias("__n")).select(
        part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    # one row per partition, so the broadcast is bounded by the partition count
    return (ranged.withColumn("__local", F.row_number().over(Window.partitionBy(part).orderBy(*order)))
            .join(F.broadcast(offsets), part)
            .withColumn(name, F.col("__local") + F.col("__offset"))
            .drop(part, "__local", "__offset"))

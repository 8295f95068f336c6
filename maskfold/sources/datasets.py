"""One-class datasets built from the input tables (SRC-0x, PRJ-01..06).

Shape of every prepared dataset::

    row_id long, split string ('train'|'test'), x array<double> | text string,
    label int, outlier int (0 iff label == inlier)

Training rows are the inlier class only; test rows keep every class.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import h
from ..functions.vectors import as_double_array, row_l2_normalize, row_standardize
from .tables import table

SPLIT_SEED = 42
TEST_MOD = 5  # h(row_id, seed) % 5 == 0 -> test (an 80/20 split)


def split_column(id_col: str = "row_id", seed: int = SPLIT_SEED, test_mod: int = TEST_MOD):
    """PRJ-03: deterministic 80/20 split on the row id (stable under repartition)."""
    return F.when(F.pmod(h(id_col, seed), F.lit(test_mod)) == 0, F.lit("test")).otherwise(F.lit("train"))


def outlier_column(inlier, label_col: str = "label"):
    """PRJ-04: 0 iff label == inlier."""
    return (F.col(label_col) != F.lit(inlier)).cast("int")


def filter_labels(df: DataFrame, labels, domain=None, label_col: str = "label") -> DataFrame:
    """PRJ-01: keep the given labels; one outside the domain, asked for or found in the data, is an error."""
    labels = list(labels)
    label = F.col(label_col)
    if domain is not None:
        unknown = sorted(set(labels) - set(domain))
        if unknown:
            raise ValueError(f"labels {unknown} not in the label domain {sorted(domain)}")
        label = F.when(label.isin(list(domain)), label).otherwise(F.raise_error(F.concat(
            F.lit("a label is not in the label domain: "), F.coalesce(label.cast("string"), F.lit("null")))))
    return df.filter(label.isin(labels))


def one_class(df: DataFrame, inlier, seed: int = SPLIT_SEED, test_mod: int = TEST_MOD,
              label_col: str = "label") -> DataFrame:
    """Tag split + outlier flag; train keeps only the inlier class (PRJ-02)."""
    t = (df.withColumn("split", split_column("row_id", seed, test_mod))
           .withColumn("outlier", outlier_column(inlier, label_col)))
    return t.filter((F.col("split") == "test") | (F.col(label_col) == F.lit(inlier)))


def embedding_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-06: numeric matrix X from the embeddings table."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"),
                    as_double_array("embedding").alias("x"),
                    F.col("label").cast("int").alias("label"))


def width(x: DataFrame, x_col: str = "x") -> int:
    """The number of components of the longest vector (one number)."""
    return x.agg(F.max(F.size(x_col))).first()[0] or 0


def embedding_dataset(spark: SparkSession, sf_dir: str, inlier: int = 0,
                      seed: int = SPLIT_SEED) -> DataFrame:
    return one_class(embedding_matrix(spark, sf_dir), inlier, seed)


def document_dataset(spark: SparkSession, sf_dir: str, inlier: int = 1,
                     seed: int = SPLIT_SEED, label: str = "quality") -> DataFrame:
    """Text one-class dataset: documents joined to their labels (inner join:
    unlabelled documents are not part of the dataset)."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id").select(F.col("doc_id").alias("row_id"), "text", "lang",
                                     F.col(label).cast("int").alias("label"))
    return one_class(j, inlier, seed)


def first_n(df: DataFrame, n: int, order_col: str = "row_id") -> DataFrame:
    """PRJ-05: first n rows by row id; n = -1 keeps every row (quirk fixed)."""
    if n is None or n < 0:
        return df
    return df.orderBy(order_col).limit(n)


def validate_prepared(df: DataFrame, inlier, x_col: str = "x") -> dict:
    """PRJ-06: one aggregate pass; raise on NaN, ragged rows or foreign train labels."""
    r = df.agg(
        F.sum(F.when(F.exists(x_col, lambda v: F.isnan(v)), 1).otherwise(0)).alias("nan_rows"),
        F.min(F.size(x_col)).alias("min_dim"), F.max(F.size(x_col)).alias("max_dim"),
        F.sum(F.when((F.col("split") == "train") & (F.col("label") != F.lit(inlier)), 1)
              .otherwise(0)).alias("foreign_train"),
        F.count(F.lit(1)).alias("rows"),
    ).first().asDict()
    if r["rows"] == 0:
        raise ValueError("empty dataset")
    if (r["nan_rows"] or 0) > 0:
        raise ValueError(f"{r['nan_rows']} rows contain NaN")
    if r["min_dim"] != r["max_dim"]:
        raise ValueError(f"ragged rows: dims {r['min_dim']}..{r['max_dim']}")
    if (r["foreign_train"] or 0) > 0:
        raise ValueError("training rows contain labels other than the inlier label")
    return r


@dataclass(frozen=True)
class DatasetSpec:
    """UDF-06: a dataset as data instead of a subclass; ``read_dataset`` is driven by it alone."""
    name: str
    path: str
    x_col: str                           # the text or vector column
    id_col: str = "row_id"
    label_col: str | None = None
    fmt: str = "parquet"
    schema: str | None = None            # needed for csv
    positive: str | None = None          # SRC-03: the label is 1 for this word, else 0
    constant_label: int | None = None    # SRC-05
    labels: tuple = ()                   # PRJ-01: every label that may occur; none: any
    keep: tuple = ()                     # PRJ-01: the labels kept; none: all
    where: tuple = ()                    # (column, value) pairs that select the source's rows
    split: str | None = None             # all rows of one split, or none: by the id's draw (PRJ-03)
    standardize: bool = False            # PRJ-12, vectors only
    first: int = -1                      # PRJ-05


def read_dataset(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """(dataset, row_id, x, label, split) of a spec."""
    reader = spark.read.schema(spec.schema) if spec.schema else spark.read
    if spec.fmt == "csv":
        if not spec.schema:
            raise ValueError(f"{spec.name}: a csv source needs a schema")
        df = reader.option("header", True).option("multiLine", True).option("escape", '"').csv(spec.path)
    else:
        df = reader.format(spec.fmt).load(spec.path)
    for column, value in spec.where:
        df = df.where(F.col(column) == F.lit(value))
    if spec.constant_label is not None:
        label = F.lit(spec.constant_label)
    elif spec.label_col is None:
        raise ValueError(f"{spec.name}: neither a label column nor a constant label")
    elif spec.positive is not None:
        label = F.when(F.col(spec.label_col) == spec.positive, 1).otherwise(0)
    else:
        label = F.col(spec.label_col)
    x = F.col(spec.x_col)
    if spec.standardize:
        x = row_l2_normalize(row_standardize(as_double_array(x)))
    rows = df.select(F.lit(spec.name).alias("dataset"), F.col(spec.id_col).cast("long").alias("row_id"), x.alias("x"),
                     label.cast("int").alias("label"))
    rows = rows.withColumn("split", split_column("row_id") if spec.split is None else F.lit(spec.split))
    if spec.keep or spec.labels:
        kept = spec.keep or spec.labels
        rows = filter_labels(rows, kept, spec.labels or kept)
    return first_n(rows, spec.first)


def read_datasets(spark: SparkSession, specs: list[DatasetSpec]) -> DataFrame:
    """The rows of all specs, one below the other."""
    out = read_dataset(spark, specs[0])
    for s in specs[1:]:
        out = out.unionByName(read_dataset(spark, s))
    return out

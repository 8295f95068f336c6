"""The corpus pipeline: documents in, packed token sequences out.

STAGES lists its stages; each takes (spark, docs, sf_dir) and returns a DataFrame, all but the
last with the columns of documents.  ``run`` writes each stage's result to the shared folder and reads it
again as the next one's documents, so a lost executor costs part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from maskfold.llm.common import MAX_LONG, id_of, stage_table, text_of
from maskfold.llm.jaccard_join import hash_of, jaccard_classes
from maskfold.llm.line_dedup import line_dedup
from maskfold.llm.mixing import WORD, mix
from maskfold.llm.queries import packed_pieces
from maskfold.llm.toxicity import fit_toxicity, toxicity_score
from maskfold.session import ship_package
from maskfold.sources.tables import table


def with_text(docs: DataFrame, names: list[str]) -> list:
    """The columns ``names``, n_chars anew."""
    return [F.char_length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in names]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go.  The model learns from the labels of these documents."""
    ship_package(spark)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity_score(docs, model) < 0.5)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; documents stay, if need be with an empty text."""
    kept = line_dedup(docs)
    return kept.select(*with_text(docs, docs.columns))


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents connected by links, the one with the smallest id stays.  Documents without words
    have no links and stay; rows that repeat an id are one document and stay, unless their own text links to
    a smaller id.  Each row without an id is a document of its own: where only such rows link, the one of
    the smallest text hash stays."""
    ship_package(spark)
    rows = stage_table(jaccard_classes(docs).where("n > 0 and (component < id or id is null)").select(
        id_of("id").alias("__gone"), F.col("text_hash").alias("__hash"), "part", "component"), "linked-rows")
    kept = docs.join(rows.select("__gone", "__hash").distinct(), (id_of() == F.col("__gone")) & (hash_of() == F.col("__hash")),
                     "left_anti")
    firsts = stage_table(rows.where("component is null").groupBy("part").agg(F.min("__hash").alias("__hash")), "first-texts")
    unnamed = docs.where(F.col("doc_id").isNull() | (F.col("doc_id") == MAX_LONG)).withColumn("__text_hash", hash_of())
    one = (unnamed.join(firsts, F.col("__text_hash") == F.col("__hash"), "left_semi")
           .groupBy("__text_hash").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*"))
    return kept.unionByName(one)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per use of a document: its whole text as often as its source's quota passes it, and
    the first words once more where a quota ends inside it.  Documents that no quota reaches go.  Rows equal in id, text and
    source are uses of one of them, as many as their quotas together give."""
    def source(column: str):
        return F.concat(F.col(column).isNull().cast("string"), F.coalesce(column, F.lit(""))).alias("__source")

    places = mix(docs, payload=True).where("taken > 0").withColumn(
        "whole", F.col("passes") + (F.col("to_word") == F.col("size")).cast("long"))
    part_of = F.when((F.col("to_word") > 0) & (F.col("to_word") < F.col("size")), F.array("to_word"))
    uses = places.select(id_of().alias("__id"), F.col("text_hash").alias("__hash"), source("source"), F.explode(F.concat(
        F.array_repeat(F.lit(-1).cast("long"), F.col("whole").cast("int")),
        F.coalesce(part_of, F.array().cast("array<bigint>")))).alias("__words"))
    one = docs.select(id_of().alias("__id"), F.md5(text_of()).alias("__hash"), source("source"), F.struct(*docs.columns).alias("__row")) \
        .groupBy("__id", "__hash", "__source").agg(F.first("__row").alias("__row"))
    joined = one.join(uses, ["__id", "__hash", "__source"]).select("__row.*", "__words")
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), F.lit(1), F.col("__words").cast("int")), " ")
    return joined.withColumn("text", F.when(F.col("__words") < 0, F.col("text")).otherwise(part)).select(
        *with_text(docs, docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packed_pieces(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", dedup_lines), ("jaccard_join", jaccard), ("mixing", mixing), ("packing", packing)]

# A learned score and tokens are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

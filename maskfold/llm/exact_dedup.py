"""Exact deduplication by a 128-bit content hash, with bytes compared inside groups.

The content is the text without ASCII white space (null counts as empty).

1. Small rows ``(hash, sha256, length, id)`` are written once and aggregated per hash to the
   group size and the row that stays: most code points in the original text, then the
   smallest id, then the smallest number that the row got when it was written.  The partial aggregation folds a
   hot group before the shuffle.
2. The contents themselves are grouped by ``(hash, bytes)``.  Equal contents fold
   map-side, so one copy per task moves, and Spark compares the bytes.  Different
   contents under one 128-bit hash become different classes, told apart by their
   sha256; a class that held two contents even so stops the job.
3. Each row looks its class up in the written classes.  They have one row per key, so AQE may
   split a hot key of the row side.

Edge cases: a null id sorts after every other id; rows that repeat an id are each
returned, and one row of a group stays even if rows repeat in full; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import MAX_LONG, id_of, stage_table, text_of, without_spaces


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = text_of(text_col)
    return (docs.select(id_of(id_col).alias("id"), F.char_length(text).alias("chars"), without_spaces(text).alias("content"))
            .withColumns({"h": F.md5("content"), "sha": F.sha2("content", 256)}))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, sha (of the content)."""
    full = signatures(docs, id_col, text_col)
    sig = stage_table(full.drop("content").withColumn("row", F.monotonically_increasing_id()), "signatures")
    groups = sig.groupBy("h", "sha").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("chars")).alias("neg"), F.col("id"), F.col("row"))).alias("best"))
    contents = (full.groupBy("h", "content").agg(F.count("*").alias("rows"))
                .groupBy("h", F.sha2("content", 256).alias("sha"))
                .agg(F.count("*").alias("contents")))
    classes = (groups.join(contents, ["h", "sha"])
               .select("h", "sha", "best", F.when(F.col("contents") == 1, F.col("group_size")).otherwise(
                   F.raise_error(F.lit("two contents share both hashes")).cast("long")).alias("group_size")))
    return (sig.join(stage_table(classes, "classes"), ["h", "sha"])
            .select(F.nullif("id", F.lit(MAX_LONG)).alias("id"),
                    F.nullif("best.id", F.lit(MAX_LONG)).alias("keep_id"),
                    "group_size",
                    (F.col("row") == F.col("best.row")).alias("kept"),
                    "sha"))

"""Line deduplication across documents.

Texts are split at line feeds.  A line's key is the line without ASCII white space
at both ends and with A-Z lower-cased; keys of fewer than ``min_chars`` code points
never drop a line.  A key that is found in ``min_docs`` or more documents loses its lines in
all documents but the one with the smallest id, where all of them stay.

1. Explode the normalised lines and hash each key to 128 bits.
2. Per hash, the smallest and the largest id (fixed-size, combined map-side, so a line
   that a third of all documents share is folded before the shuffle).  For two documents
   it is enough that these differ; for a higher threshold distinct (hash, id) pairs are
   counted.
3. Lines of repeated keys outside the smallest document give one array of dropped
   positions per document, and the kept lines are joined again by position.

Edge cases: null and empty texts are one empty line; a null id counts as one document
that sorts last; rows that repeat an id and text are each returned, and texts that share
an id count as one document; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import WS, id_of, lower_ascii, stage_table, text_of


def split_lines(text):
    return F.split(text, "\n", -1)


def dropped_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                      min_docs: int = 2) -> DataFrame:
    """(id, text_hash, dropped array<int>) of the documents that lose lines."""
    text = text_of(text_col)
    # the columns beside the lines come first, else they are made anew for each line
    split = docs.select(id_of(id_col).alias("id"), F.unhex(F.md5(text)).alias("text_hash"),
                        split_lines(lower_ascii(text)).alias("lines"))
    lines = split.select("id", "text_hash", F.posexplode("lines").alias("pos", "line"))
    keys = stage_table(lines.withColumn("key", F.btrim("line", F.lit(WS))).where(F.char_length("key") >= min_chars)
                       .select("id", "text_hash", "pos", F.unhex(F.md5("key")).alias("h")), "line-keys")
    if min_docs <= 2:
        repeated = (keys.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last"))
                    .where("first < last").select("h", "first"))
    else:
        repeated = (keys.select("h", "id").distinct().groupBy("h").agg(F.min("id").alias("first"), F.count("*").alias("n"))
                    .where(F.col("n") >= min_docs).select("h", "first"))
    # written, so that the join reads two plain exchanges and AQE may split a hot line
    return (keys.join(stage_table(repeated, "repeated-lines"), "h").where("id <> first")
            .groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("dropped")))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
               min_docs: int = 2) -> DataFrame:
    """The rows of ``docs`` with the kept lines as text and, at the end,
    ``__n_lines`` and ``__n_dropped``."""
    drops = dropped_positions(docs, id_col, text_col, min_chars, min_docs).select(
        F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("dropped").alias("__dropped"))
    text = text_of(text_col)
    joined = docs.join(drops, (id_of(id_col) == F.col("__id")) & (F.unhex(F.md5(text)) == F.col("__hash")), "left")
    lines = split_lines(text)
    # positions are integers, so array_except works with a hash set
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__dropped")
    kept = F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n")
    cols = [F.when(F.col("__dropped").isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col(c)
            for c in docs.columns]
    return joined.select(*cols, F.size(lines).cast("long").alias("__n_lines"),
                         F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("__n_dropped"))

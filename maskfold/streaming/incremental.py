"""STR-01: incremental, exactly-once document features with Structured Streaming.

``readStream`` over the parquet source -> per-document features (whole texts)
-> ``writeStream`` parquet with a checkpoint in the shared checkpoint folder,
``trigger(availableNow=True)``: every file that arrived since the last run is
processed once.  The batch result of ``document_features`` must be identical.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..session import checkpoint_dir, files_of, path_kind

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def document_features(df: DataFrame, *keep: str) -> DataFrame:
    """Stateless per-row features: word count and the mean character profile."""
    ws = df.select("doc_id", "lang", *keep, TX.words(TX.clean(F.coalesce("text", F.lit("")))).alias("ws"))
    n = F.greatest(F.size("ws"), F.lit(1))
    joined = ws.select("doc_id", "lang", *keep, F.size("ws").alias("n_words"), n.alias("n"), F.array_join("ws", "").alias("all"))
    return joined.select("doc_id", "lang", "n_words", F.round(F.length("all") / F.col("n"), 6).alias("mean_word_len"),
                         F.round(TX.count_chars("all", "eE") / F.col("n"), 6).alias("mean_e"), *keep)


def run_incremental(spark: SparkSession, source: str, sink_path: str, checkpoint: str) -> None:
    """``source``: a table's folder of part files, or a single Parquet file."""
    stream = spark.readStream.schema(DOC_SCHEMA).option("maxFilesPerTrigger", 16)
    if path_kind(spark, source) == "file":
        folder, name = source.rstrip("/").rsplit("/", 1)
        stream = stream.option("pathGlobFilter", name).parquet(folder)
    else:
        stream = stream.parquet(source)
    meta = F.col("_metadata")
    stream = stream.select("*", meta["file_name"].alias("_file"), meta["file_size"].alias("_size"), meta["file_modification_time"].alias("_changed"))
    q = (document_features(stream, "_file", "_size", "_changed").writeStream.format("parquet").option("path", sink_path)
         .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def incremental_document_features(spark: SparkSession, source_dir: str) -> DataFrame:
    """The sink and its checkpoint have a fixed place per source, so a second call
    reads only files that arrived since the first.  Once a file that was read is gone or has changed (the table
    was written anew), a new generation of sink and checkpoint starts, and the old one isn't read any more."""
    source = f"{source_dir.rstrip('/')}/documents.parquet"
    base = f"{checkpoint_dir(spark).rstrip('/')}/doc-features-{hashlib.md5(source.encode()).hexdigest()[:12]}"
    generation, there = 0, files_of(spark, source)
    while path_kind(spark, f"{base}-{generation + 1}") == "folder":
        generation += 1
    sink = f"{base}-{generation}"
    if path_kind(spark, f"{sink}/_spark_metadata") == "folder":
        ms = F.unix_millis("_changed")
        # one row a file that gave rows
        read = spark.read.parquet(sink).select("_file", "_size", ms.alias("ms")).distinct().collect()
        if any(there.get(r["_file"]) != (r["_size"], r["ms"]) for r in read):
            sink = f"{base}-{generation + 1}"
    run_incremental(spark, source, sink, sink + ".checkpoint")
    return spark.read.parquet(sink).drop("_file", "_size", "_changed")

"""Mixing of sources to target weights by Sainte-Lague apportionment of equal word blocks.

1. Sizes: words per document, summed per source.
2. Targets: each source's share by weight of ``share`` of all words; no target exceeds
   ``max_epochs`` times its source, and the excess is shared again by weight until none
   does.  Each round is one aggregate over the sources; two sums reach the driver.
3. Shards: every source is split by a seeded hash of id and text into shards of bounded size, so a hot source
   is many shards, and so are its rows without an id.  Rows equal in id, text and source are counted first
   and split into pieces of bounded size, which have draws of their own.  Within a shard the pieces lie one after the
   other in seeded order, cut into blocks of equal words; a shard's stream may be passed several times.
4. Quotas: all blocks go to the shards by the highest quotients ``target / (2k + 1)``.
   Only quotients near each shard's ideal quota can be contested, so the ranking covers a few
   rows per shard, and it is range-partitioned.
5. A shard takes its quota of blocks from the start of its seeded order.  How many words of a document
   that is follows from its place in the stream, so no block becomes a row.

Results: a document is taken at most ``max_epochs`` times its size.  Reruns agree.

Edge cases: null texts have size 0; documents without words have taken 0; a null source is
a source of its own, last in order; rows without an id and rows that repeat an id, or id and text, each count;
a table without words gives targets of 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import global_rank, stage_table, text_of

WORD = r"[^\x20\x09-\x0D]+"


def seeded(seed: int, *cols: str) -> Column:
    """A 60-bit draw per row (md5-based, so any SQL engine can repeat it)."""
    key = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, share: float, max_epochs: int) -> DataFrame:
    """Add ``target`` to (source, source_size, weight)."""
    cap = F.col("source_size") * max_epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    capped_words, weight_left = 0, sources.agg(F.sum("weight")).first()[0] or 0
    level = share * total / weight_left if weight_left else 0.0
    while True:
        over = cap < F.lit(level) * F.col("weight")
        words, left = sources.agg(F.sum(F.when(over, cap)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if (words or 0) == capped_words or not left:
            break
        capped_words = words
        level = (share * total - capped_words) / left
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight")))


def apportion(shards: DataFrame, blocks: int, votes: str = "target", keys: tuple[str, ...] = ("source", "shard")) -> DataFrame:
    """Sainte-Lague: (keys, quota) for ``blocks`` seats."""
    n, total = shards.agg(F.count("*"), F.sum(votes)).first()
    if not total or blocks <= 0:
        return shards.select(*keys, F.lit(0).cast("long").alias("quota"))
    # At these two divisors the quotas sum to at most, and to more than, the seats.
    sure = F.greatest(F.lit(0), F.floor(F.col(votes) * max(0.0, blocks - n / 2) / total + 0.5) - 1).cast("long")
    most = F.floor(F.col(votes) * (blocks + n / 2 + 1) / total + 0.5).cast("long") + 1
    bounds = shards.select(*keys, votes, sure.alias("sure"), most.alias("most"))
    open_seats = blocks - (bounds.agg(F.sum("sure")).first()[0] or 0)
    contested = bounds.select(*keys, F.explode(F.sequence(F.col("sure"), F.col("most") - 1)).alias("k"), votes) \
        .select(*keys, (F.col(votes) / (2 * F.col("k") + 1)).alias("quotient"))
    ranked = global_rank(contested, [F.col("quotient").desc(), *(F.col(k).asc_nulls_last() for k in keys)], "place")
    won = ranked.where(F.col("place") <= open_seats).groupBy(*keys).agg(F.count("*").alias("won")) \
        .select(*(F.col(k).alias(f"won_{k}") for k in keys), "won")
    same = [F.col(k).eqNullSafe(F.col(f"won_{k}")) for k in keys]
    return bounds.join(won, same, "left").select(*keys, (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_epochs: int = 3, seed: int = 17,
        block_words: int = 1024, shard_words: int = 250_000, shard_rows: int = 5_000, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", payload: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken and its place:
    ``passes`` whole uses and then the words ``[from_word, to_word)`` once more.

    ``weights`` repeat over the sources in code point order, null last.  Blocks have
    ``block_words`` words, or fewer where the corpus has under 1000 such blocks per shard."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.md5(text_of(text_col)).alias("text_hash"),
                       F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"))
    sized = stage_table(rows.groupBy("doc_id", "source", "text_hash", "size").agg(F.count("*").alias("copies")), "sizes")
    sizes = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("source_rows"))
    ranked = global_rank(sizes, [F.col("source").asc_nulls_last()], "nth")
    cycle = F.array(*map(F.lit, weights))
    weighted = ranked.withColumn("weight", F.get(cycle, (F.col("nth") - 1) % len(weights)).cast("long"))
    sources = stage_table(targets(stage_table(weighted, "weights"), share, max_epochs).withColumn(
        "shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("source_rows") / shard_rows))),
        "targets").select(F.col("source").alias("of"), "source_size", "target", "shards")

    at_most = F.greatest(F.lit(1).cast("long"), F.least(F.lit(shard_rows).cast("long"), F.expr(f"{shard_words} div greatest(size, 1)")))
    pieces = sized.withColumn("per", at_most).select(
        "doc_id", "source", "text_hash", "size", "copies", "per", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(copies - 1) div per"))).alias("piece"))
    pieces = pieces.select("doc_id", "source", "text_hash", "size", "piece",
                           F.least("per", F.col("copies") - F.col("piece") * F.col("per")).alias("held"))
    placed = (pieces.join(sources, F.col("source").eqNullSafe(F.col("of")))
              .withColumn("draw", seeded(seed, "doc_id", "text_hash", "piece")).withColumn("shard", F.col("draw") % F.col("shards")))
    stream = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "text_hash", "piece").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    words_of = F.col("size") * F.col("held")
    streams = placed.withColumn("before", F.sum(words_of).over(stream) - words_of)
    shards = stage_table(
        placed.groupBy("source", "shard").agg(F.sum(words_of).alias("shard_size"), F.first("target").alias("source_target"),
                                              F.first("source_size").alias("source_size"))
        .withColumn("target", F.when(F.col("source_size") > 0, F.col("source_target") * F.col("shard_size") / F.col("source_size"))
                    .otherwise(F.lit(0.0))), "shards")
    n, total = shards.agg(F.count("*"), F.sum("shard_size")).first()
    block = max(1, min(block_words, int((total or 0) // (1000 * n)))) if n else 1
    quotas = apportion(shards, int(share * (total or 0)) // block).select(
        F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "quota")
    taken = (shards.join(quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
             .select("q_source", "q_shard", "shard_size",
                     F.least(F.col("quota") * block, F.col("shard_size") * max_epochs).alias("words")))
    whole = F.when(F.col("shard_size") > 0, F.expr("words div shard_size")).otherwise(F.lit(0))
    once_more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - F.col("passes") * F.col("shard_size")
                                             - F.col("before")))
    return (streams.join(taken, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
            .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("held") - 1)))
            .withColumn("before", F.col("before") + F.col("copy") * F.col("size"))
            .withColumn("passes", whole).withColumn("more", once_more)
            .select("doc_id", "source", *(["text_hash"] if payload else []), "size", "source_size", "target",
                    (F.col("passes") * F.col("size") + F.col("more")).alias("taken"),
                    "passes", F.lit(0).cast("long").alias("from_word"), F.col("more").alias("to_word")))

"""Preference formatting of chosen and rejected conversations, in DataFrame expressions only.

For a pair, the prompt is the longest common prefix of the two turn sequences (role and text
equal), rendered once; the completions are the remaining turns of either side.  Each completion
is a list of segments with a mask: 1 for the text of assistant turns (and their end mark), which
a loss may use, 0 for role marks and other turns.

Turns are aggregated per conversation (one row of at most the conversation's length) and joined to
the pairs, so a first turn that a third of all conversations share is no join key anywhere.

Edge cases: null roles and texts count as empty; turns are ordered by their number, nulls first, then role and
text, and a repeated row is one turn; a pair with equal conversations has empty completions;
a pair with an unknown conversation gives no row; rows without a conversation id belong to none; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|{}|>\n", "\n<|end|>\n"


def conversations_of(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns array<struct<turn, role, text>>) in order."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                   F.coalesce("text", F.lit("")).alias("text"))
    return (turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
            .agg(F.sort_array(F.collect_set(one)).alias("turns")))


def neighbour_pairs(conversations: DataFrame) -> DataFrame:
    """(chosen, rejected): conversation 2i against 2i + 1, the longer one chosen, the smaller id at ties."""
    halves = conversations.groupBy(F.floor(F.col("id") / 2).alias("pair")).agg(
        F.min("id").alias("x"), F.max("id").alias("y"),
        F.min_by(F.size("turns"), "id").alias("n_x"), F.max_by(F.size("turns"), "id").alias("n_y")).where("x <> y")
    longer = F.col("n_y") > F.col("n_x")
    return halves.select(F.when(longer, F.col("y")).otherwise(F.col("x")).alias("chosen"),
                         F.when(longer, F.col("x")).otherwise(F.col("y")).alias("rejected"))


def render(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(
        F.format_string("<|%s|>\n", t["role"]), t["text"], F.lit(END))))


def segments(turns: Column) -> Column:
    """array<struct<text, mask>>: the role mark, then the turn's text with its end mark."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(F.format_string("<|%s|>\n", t["role"]).alias("text"), F.lit(0).alias("mask")),
        F.struct(F.concat(t["text"], F.lit(END)).alias("text"), (t["role"] == "assistant").cast("int").alias("mask")))))


def preference_format(turns: DataFrame, pairs: DataFrame | None = None, id_col: str = "conv_id") -> DataFrame:
    """One row per pair: chosen, rejected, n_common, prompt, and per side the completion's text and segments."""
    conversations = conversations_of(turns, id_col)
    pairs = neighbour_pairs(conversations) if pairs is None else pairs
    chosen = conversations.select(F.col("id").alias("chosen"), F.col("turns").alias("c"))
    rejected = conversations.select(F.col("id").alias("rejected"), F.col("turns").alias("r"))
    both = pairs.select("chosen", "rejected").join(chosen, "chosen").join(rejected, "rejected")
    same = F.zip_with("c", "r", lambda a, b: a.isNotNull() & b.isNotNull() & (a["role"] == b["role"]) & (a["text"] == b["text"]))
    first_other = F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), False)
    both = both.withColumn("n_common", F.when(first_other > 0, first_other - 1).otherwise(F.size(same)).cast("int"))

    def rest(side: str) -> Column:
        return F.slice(side, F.col("n_common") + 1, F.size(side))

    return both.select(
        "chosen", "rejected", "n_common", render(F.slice("c", F.lit(1), F.col("n_common"))).alias("prompt"),
        render(rest("c")).alias("chosen_text"), segments(rest("c")).alias("chosen_segments"),
        render(rest("r")).alias("rejected_text"), segments(rest("r")).alias("rejected_segments"))


def with_altered_answers(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Turns of twice as many conversations: 2c is conversation c, and 2c + 1 the same with its last answer taken
    from the conversation that has the number c with its last bit flipped (an empty text, if there is none).  So
    ``neighbour_pairs`` gives preference pairs that share a prompt, for tables without rejected answers."""
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("c"), F.col("turn").cast("long").alias("turn"),
                                                         F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    answers = rows.where("role = 'assistant' and turn is not null").groupBy("c").agg(F.max(F.struct("turn", "text")).alias("a"))
    last = answers.select("c", F.col("a.turn").alias("last"))
    other = answers.select(F.col("c").bitwiseXOR(F.lit(1).cast("long")).alias("c"), F.col("a.text").alias("other"))
    changed = rows.join(last, "c", "left").join(other, "c", "left")
    here = (F.col("role") == "assistant") & (F.col("turn") == F.col("last"))
    changed = changed.select((2 * F.col("c") + 1).alias(id_col), "turn", "role", F.when(here, F.coalesce("other", F.lit(""))).otherwise(F.col("text")).alias("text"))
    return rows.select((2 * F.col("c")).alias(id_col), "turn", "role", "text").unionByName(changed)

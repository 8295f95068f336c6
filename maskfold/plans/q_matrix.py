"""Rows that are matrices: conversations as turns x features, their nearest ones by two distances (JN-03, JN-04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators.knn import knn
from ..sources.tables import table
from .catalog import register
from .q_text import _sql_clean, _sql_profile, _sql_words

K, FEATURES = 3, len(TX.PROFILE_FEATURES)


def conversation_matrices(spark, sf_dir):
    """(row_id, x) with a slice per turn number: the mean profile of its words, zeros for a turn that isn't there; and
    the number of slices, taken from the table."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    ws = c.select("conv_id", "turn", TX.words(TX.clean(F.coalesce("text", F.lit("")))).alias("ws"))
    total = TX.char_profile(F.array_join("ws", ""))
    turns = ws.select("conv_id", "turn", F.transform(total, lambda v: v / F.greatest(F.size("ws"), F.lit(1))).alias("f"))
    slices = 1 + (turns.agg(F.max("turn")).first()[0] or 0)
    # rows that repeat a turn are averaged
    per = turns.select("conv_id", "turn", *[F.get("f", F.lit(k)).alias(f"f{k}") for k in range(FEATURES)]) \
        .groupBy("conv_id", "turn").agg(*[F.avg(f"f{k}").alias(f"f{k}") for k in range(FEATURES)])
    held = per.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(
        F.struct("turn", F.array(*[f"f{k}" for k in range(FEATURES)])))).alias("m"))
    empty = F.array(*[F.lit(0.0)] * FEATURES)
    x = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda t: F.coalesce(F.try_element_at("m", t.cast("long")), empty)))
    return held.select(F.col("conv_id").alias("row_id"), x.alias("x")), slices


_MATRIX_SQL = f"""t AS (SELECT conv_id, turn, {_sql_words(_sql_clean("coalesce(text, '')"))} AS ws FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (SELECT conv_id, turn, GREATEST(len(ws), 1) AS n, {_sql_profile("array_to_string(ws, '')")} AS f FROM t),
l AS (SELECT conv_id, turn, k, AVG(v) AS v FROM (SELECT conv_id, turn, UNNEST(range({FEATURES})) AS k, UNNEST(f) / n AS v FROM p) GROUP BY ALL),
g AS (SELECT c.conv_id, tt.turn, kk.k, coalesce(l.v, 0.0) AS v
      FROM (SELECT DISTINCT conv_id FROM p) c, (SELECT UNNEST(range((SELECT MAX(turn) FROM p) + 1)) AS turn) tt, range({FEATURES}) AS kk(k)
      LEFT JOIN l ON l.conv_id = c.conv_id AND l.turn = tt.turn AND l.k = kk.k),
s AS (SELECT a.conv_id AS conv_id, b.conv_id AS other, a.turn, SUM((a.v - b.v) * (a.v - b.v)) AS d2
      FROM g a JOIN g b ON a.turn = b.turn AND a.k = b.k AND a.conv_id <> b.conv_id GROUP BY ALL),
d AS (SELECT conv_id, other, {{distance}} AS distance FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY distance, other) AS r FROM d)
SELECT conv_id, CAST(r AS INTEGER) AS place, other, ROUND(distance, 6) AS distance FROM r WHERE r <= {K}"""


def _nearest(spark, sf_dir, by_slice: bool):
    x, slices = conversation_matrices(spark, sf_dir)
    n = knn(x, x, K, exclude_self=True, slices=slices if by_slice else 1)
    return n.select(F.col("qid").alias("conv_id"), F.col("nn_rank").alias("place"), F.col("rid").alias("other"),
                    F.round("dist", 6).alias("distance"))


@register("nearest_conversations_frobenius", "WITH " + _MATRIX_SQL.replace("{distance}", "SQRT(SUM(d2))"))
def q_nearest_conversations_frobenius(spark, sf_dir):
    """JN-03: the three nearest conversations by the Frobenius distance of their matrices."""
    return _nearest(spark, sf_dir, False)


@register("nearest_conversations_average", "WITH " + _MATRIX_SQL.replace("{distance}", "AVG(SQRT(d2))"))
def q_nearest_conversations_average(spark, sf_dir):
    """JN-04: the three nearest conversations by the mean distance of their turns."""
    return _nearest(spark, sf_dir, True)

"""Word-vector queries: nearest vocabulary entries, static vectors pooled over documents, lookups both ways
(JN-09, MDL-21, FN-22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.vectors import l2_norm
from ..operators.words import fitted_vectors, nearest_entries, pooled_vectors, word_counts
from ..sources.tables import table
from .catalog import register
from .q_text import _sql_profile, _sql_vocab_clean, _sql_words

# Words that no query may get, whatever its vector (besides itself).
NEVER = ["the", "of", "and", "to", "in"]


def _text(df, col="text"):
    return F.coalesce(F.col(col), F.lit(""))


def vocabulary_vectors(spark, sf_dir):
    """FN-22: every word of the documents with its profile, one row a word."""
    d = table(spark, sf_dir, "documents")
    words = d.select(F.explode(TX.words(TX.vocab_clean(_text(d)))).alias("word")).distinct()
    return words.select("word", TX.char_profile("word").alias("v"))


def benchmark_words(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.explode(TX.words(TX.vocab_clean(_text(b)))).alias("query")).distinct()


_VOCAB_SQL = f"""voc AS (SELECT word, {_sql_profile('word')} AS v FROM (
  SELECT DISTINCT unnest({_sql_words(_sql_vocab_clean("coalesce(text, '')"))}) AS word FROM documents))"""
_ASKED_SQL = f"""asked AS (SELECT query, {_sql_profile('query')} AS v FROM (
  SELECT DISTINCT unnest({_sql_words(_sql_vocab_clean("coalesce(text, '')"))}) AS query FROM benchmark))"""
_NEVER_SQL = ", ".join(f"'{w}'" for w in NEVER)


@register("nearest_vocabulary_words", f"""WITH {_VOCAB_SQL}, {_ASKED_SQL},
vk AS (SELECT v, list_sort(list(word))[1:{len(NEVER) + 2}] AS ws FROM voc GROUP BY v),
qk AS (SELECT DISTINCT v FROM asked),
c AS (SELECT qk.v AS qv, vk.ws, ROUND(list_dot_product(qk.v, vk.v)
        / (SQRT(list_dot_product(qk.v, qk.v)) * SQRT(list_dot_product(vk.v, vk.v))), 9) AS cosine FROM qk, vk),
k AS (SELECT qv, ws, cosine, dense_rank() OVER (PARTITION BY qv ORDER BY cosine DESC) AS r FROM c),
w AS (SELECT qv, cosine, unnest(ws) AS word FROM k WHERE r <= {len(NEVER) + 2}),
f AS (SELECT a.query, w.word, w.cosine, row_number() OVER (PARTITION BY a.query ORDER BY w.cosine DESC, w.word) AS r
      FROM asked a JOIN w ON w.qv = a.v WHERE w.word <> a.query AND w.word NOT IN ({_NEVER_SQL}))
SELECT a.query, f.word, f.cosine FROM asked a LEFT JOIN f ON f.query = a.query AND f.r = 1""")
def q_nearest_vocabulary_words(spark, sf_dir):
    """JN-09: the vector of every benchmark word decoded to the document vocabulary's entry of largest cosine,
    other than itself and a list of excluded words."""
    asked = benchmark_words(spark, sf_dir)
    never = F.explode(F.array(F.col("query"), *map(F.lit, NEVER)))
    return nearest_entries(asked.select("query", TX.char_profile("query").alias("v")), vocabulary_vectors(spark, sf_dir),
                           asked.select("query", never.alias("word")))


@register("pooled_word_vectors", f"""WITH {_VOCAB_SQL},
bench AS (SELECT DISTINCT unnest({_sql_words(_sql_vocab_clean("coalesce(text, '')"))}) AS word FROM benchmark),
unit AS (SELECT word, list_transform(v, lambda x: x / GREATEST(SQRT(list_dot_product(v, v)), 1e-12)) AS v FROM voc),
w AS (SELECT doc_id, word, COUNT(*) AS n FROM (
        SELECT doc_id, unnest({_sql_words(_sql_vocab_clean("coalesce(text, '')"))}) AS word FROM documents) GROUP BY ALL),
k AS (SELECT w.doc_id, w.n, unit.v FROM w LEFT JOIN unit ON unit.word = w.word AND unit.word NOT IN (SELECT word FROM bench)),
g AS (SELECT doc_id, CAST(SUM(n) AS BIGINT) AS n_words, CAST(SUM(CASE WHEN v IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS n_known,
        {', '.join(f'SUM(v[{i + 1}] * n) AS s{i}' for i in range(8))} FROM k GROUP BY doc_id)
SELECT doc_id, n_words, n_known, ROUND(s0 / n_known, 6) AS mean_length, ROUND(s2 / n_known, 6) AS mean_e,
       ROUND(SQRT({' + '.join(f'POW(s{i} / n_known, 2)' for i in range(8))}), 6) AS norm
FROM g WHERE n_known > 0""")
def q_pooled_word_vectors(spark, sf_dir):
    """MDL-21 over given vectors: whole documents as the mean of their words' unit vectors.  The given table has no
    vectors for the benchmark's words, so documents have unknown words too."""
    d = table(spark, sf_dir, "documents")
    known = vocabulary_vectors(spark, sf_dir).join(benchmark_words(spark, sf_dir).withColumnRenamed("query", "word"), "word", "left_anti")
    counts = word_counts(d, TX.words(TX.vocab_clean(_text(d))))
    p = pooled_vectors(counts, known, len(TX.PROFILE_FEATURES))
    return p.select("doc_id", "n_words", "n_known", F.round(F.get("x", 0), 6).alias("mean_length"),
                    F.round(F.get("x", 2), 6).alias("mean_e"), F.round(l2_norm("x"), 6).alias("norm"))


@register("vocabulary_lookup", f"""WITH {_VOCAB_SQL}, {_ASKED_SQL},
back AS (SELECT v, MIN(word) AS word, COUNT(*) AS n FROM voc GROUP BY v)
SELECT a.query, voc.word IS NOT NULL AS known, back.word AS of_vector, CAST(coalesce(back.n, 0) AS BIGINT) AS words_of_vector,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM voc) AS vocabulary_size
FROM asked a LEFT JOIN voc ON voc.word = a.query LEFT JOIN back ON back.v = a.v""")
def q_vocabulary_lookup(spark, sf_dir):
    """FN-22: membership of a word, the entry that a vector stands for (the smallest word of that vector), and the size."""
    voc = vocabulary_vectors(spark, sf_dir)
    asked = benchmark_words(spark, sf_dir).withColumn("v", TX.char_profile("query"))
    back = voc.groupBy("v").agg(F.min("word").alias("of_vector"), F.count("*").alias("n"))
    size = voc.agg(F.count("*").alias("vocabulary_size"))  # one row
    return asked.join(voc.select("word"), F.col("query") == F.col("word"), "left").join(back, "v", "left") \
        .join(F.broadcast(size), how="inner", on=F.lit(True)) \
        .select("query", F.col("word").isNotNull().alias("known"), "of_vector",
                F.coalesce("n", F.lit(0)).cast("long").alias("words_of_vector"), "vocabulary_size")


@register("fitted_document_vectors")
def q_fitted_document_vectors(spark, sf_dir):
    """MDL-21 without given vectors: word vectors from the co-occurrences of all documents, pooled over whole documents.  Their
    lengths are returned, since the basis is free."""
    d = table(spark, sf_dir, "documents")
    words = TX.words(TX.vocab_clean(_text(d)))
    vectors = fitted_vectors(d, words, d=16)
    p = pooled_vectors(word_counts(d, words), vectors, 16)
    return p.select("doc_id", "n_words", "n_known", F.round(l2_norm("x"), 4).alias("norm"))

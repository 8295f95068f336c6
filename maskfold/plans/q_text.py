"""Text queries over documents / labels / events / conversations
(SRC-03, SRC-11, AGG-28/29, SRT-04, FN-01..12, 16, 18, FN-22, PRJ-16, MDL-16/18)."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.hashing import h, h_sql
from ..functions.vectors import row_l2_normalize
from ..operators.ecod import ecod_scores
from ..operators.masks import MASK_SEED
from ..operators.metrics import binary_metrics, metrics_sql
from ..sources.datasets import document_dataset
from ..session import materialize, staged
from ..sources.tables import table
from .catalog import register
from .sqlparts import split_sql

# The few-shot prompt used by the prompt-wrapping query.
PROMPT = dict(sample_prefix="Text :", label_prefix="Quality :",
              samples=["a clear and useful text", "spam spam spam"], labels=["good", "bad"])
TOKEN_CAP = 512
TRUNCATE_TOKENS = 256  # the truncation feature's length

def _quoted(s):
    """A SQL string of characters, the unprintable ones by their code."""
    runs = ("".join(g) for _, g in groupby(s, key=lambda c: c if c < " " else ""))
    return " || ".join(f"chr({ord(r)})" if r < " " else "'" + r.replace("'", "''") + "'" for r in runs)


def _sql_clean(t):
    return f"replace(translate({t}, {_quoted(TX.CLEAN_DELETE)}, ''), '-', ' ')"


def _sql_words(t):
    return f"list_filter(string_split({t}, ' '), lambda w: w <> '')"


def _sql_vocab_clean(t):
    deleted = f"replace(translate({t}, {_quoted(TX.VOCAB_DELETE_1)}, ''), {_quoted(TX.VOCAB_DELETE_PAIR)}, '')"
    return f"translate({deleted}, {_quoted(TX.VOCAB_DELETE_2)}, '')"


def _sql_count(s, chars):
    return f"(length({s}) - length(translate({s}, '{chars}', '')))"


def _sql_profile(s):
    return (f"[CAST(length({s}) AS DOUBLE), {_sql_count(s, 'aA')}, {_sql_count(s, 'eE')}, {_sql_count(s, 'iI')}, "
            f"{_sql_count(s, 'oO')}, {_sql_count(s, 'uU')}, "
            f"length({s}) - length(regexp_replace({s}, '[A-Z]', '', 'g')), "
            f"length({s}) - length(regexp_replace({s}, '[0-9]', '', 'g'))]")


def _sql_list(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


_DOC_DS = f"""SELECT * FROM (SELECT d.doc_id AS row_id, d.text, d.lang, CAST(l.quality AS INTEGER) AS label,
        CAST(l.quality <> 1 AS INTEGER) AS outlier, {split_sql('d.doc_id')} AS split
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id) WHERE split = 'test' OR label = 1"""


def _docs(spark, sf_dir):
    return document_dataset(spark, sf_dir, inlier=1)


@register("text_profile", f"""WITH ds AS ({_DOC_DS}),
w AS (SELECT lang, split, length(text) AS n_chars, len({_sql_words('text')}) AS n_words FROM ds),
g AS (SELECT lang, split, CAST(COUNT(*) AS BIGINT) AS n_docs, AVG(n_chars) AS mc, AVG(n_words) AS mw,
             CAST(MAX(n_words) AS BIGINT) AS max_words FROM w GROUP BY lang, split)
SELECT lang, split, n_docs, ROUND(mc, 6) AS mean_chars, ROUND(mw, 6) AS mean_words, max_words,
       CAST(TRUNC(mw) AS BIGINT) AS mean_words_int,
       ROUND(SUM(mw * n_docs) OVER (PARTITION BY split) / SUM(n_docs) OVER (PARTITION BY split), 6) AS split_mean_words,
       CAST(RANK() OVER (ORDER BY mw, lang, split) AS INTEGER) AS length_rank
FROM g""")
def q_text_profile(spark, sf_dir):
    """AGG-28 + SRT-04: text-length profile by language and split, weighted
    split mean, groups ordered by mean word count."""
    ds = _docs(spark, sf_dir)
    w = ds.select("lang", "split", F.length("text").alias("n_chars"), F.size(TX.words("text")).alias("n_words"))
    g = w.groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_chars").alias("mc"),
                                       F.avg("n_words").alias("mw"), F.max("n_words").cast("long").alias("max_words"))
    ws = Window.partitionBy("split")
    # g holds one row per (lang, split): the unpartitioned rank runs on that tiny table
    return g.select("lang", "split", "n_docs", F.round("mc", 6).alias("mean_chars"),
                    F.round("mw", 6).alias("mean_words"), "max_words",
                    F.col("mw").cast("long").alias("mean_words_int"),
                    F.round(F.sum(F.col("mw") * F.col("n_docs")).over(ws) / F.sum("n_docs").over(ws), 6)
                    .alias("split_mean_words"),
                    F.rank().over(Window.orderBy("mw", "lang", "split")).cast("int").alias("length_rank"))


@register("label_coverage", """WITH f AS (SELECT * FROM labels ORDER BY doc_id LIMIT 1000)
SELECT CAST((SELECT COUNT(DISTINCT quality) FROM labels) AS BIGINT) AS n_labels_all,
       CAST((SELECT COUNT(DISTINCT quality) FROM f) AS BIGINT) AS n_labels_first_1000,
       CAST((SELECT COUNT(*) FROM labels) AS BIGINT) AS n_rows,
       CAST((SELECT SUM(quality) FROM labels) AS BIGINT) AS n_positive""")
def q_label_coverage(spark, sf_dir):
    """AGG-29: both classes present overall and among the first 1000 rows (by id)."""
    lab = table(spark, sf_dir, "labels")
    first = lab.orderBy("doc_id").limit(1000).agg(F.countDistinct("quality").alias("n_labels_first_1000"))
    allr = lab.agg(F.countDistinct("quality").alias("n_labels_all"), F.count(F.lit(1)).alias("n_rows"),
                   F.sum("quality").cast("long").alias("n_positive"))
    return allr.join(first, how="inner", on=F.lit(True)).select(
        "n_labels_all", F.col("n_labels_first_1000").cast("long"), "n_rows", "n_positive")


@register("word_stats", f"""SELECT doc_id, CAST(len({_sql_words('text')}) AS INTEGER) AS n_words,
       CAST(len({_sql_words(_sql_clean('text'))}) AS INTEGER) AS n_clean_words,
       CAST(len(list_distinct({_sql_words(_sql_clean('text'))})) AS INTEGER) AS n_distinct_clean,
       CAST(length({_sql_clean('text')}) AS INTEGER) AS n_clean_chars
FROM documents""")
def q_word_stats(spark, sf_dir):
    """FN-01 + FN-02 per document (whole texts)."""
    d = table(spark, sf_dir, "documents")
    cw = TX.words(TX.clean("text"))
    return d.select("doc_id", F.size(TX.words("text")).alias("n_words"), F.size(cw).alias("n_clean_words"),
                    F.size(F.array_distinct(cw)).alias("n_distinct_clean"),
                    F.length(TX.clean("text")).alias("n_clean_chars"))


@register("vocabulary", f"""WITH w AS (SELECT doc_id, UNNEST({_sql_words(_sql_vocab_clean('text'))}) AS word FROM documents)
SELECT word, CAST(COUNT(DISTINCT doc_id) AS BIGINT) AS doc_freq, CAST(COUNT(*) AS BIGINT) AS n_occurrences
FROM w GROUP BY word""")
def q_vocabulary(spark, sf_dir):
    """FN-22: vocabulary of cleaned words with document and term frequency."""
    d = table(spark, sf_dir, "documents")
    w = d.select("doc_id", F.explode(TX.words(TX.vocab_clean("text"))).alias("word"))
    # two plain aggregations instead of a distinct aggregate: (word, doc)
    # counts combine map-side, then one row per (word, doc) is summed per word
    per_doc = w.groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("word").agg(F.count(F.lit(1)).alias("doc_freq"),
                                       F.sum("n").alias("n_occurrences"))


_PREFIX, _SUFFIX, _FULL, _PLEN = TX.build_prompt(**PROMPT)


@register("prompt_wrap", f"""WITH w AS (SELECT doc_id, {_sql_words('text')} AS ws FROM documents)
SELECT doc_id, CAST(len(list_concat({_sql_list(_PREFIX)}, ws, {_sql_list(_SUFFIX)})) AS INTEGER) AS n_wrapped,
       CAST(len(ws[1:{TX.word_cap(TOKEN_CAP)}]) AS INTEGER) AS n_capped,
       md5(array_to_string(ws[1:{TX.word_cap(TOKEN_CAP)}], ' ')) AS capped_words,
       CAST({_PLEN} AS INTEGER) AS prompt_length, {len(_FULL)} AS full_prompt_chars,
       list_concat({_sql_list(_PREFIX)}, ws, {_sql_list(_SUFFIX)})[-1] AS last_word
FROM w""")
def q_prompt_wrap(spark, sf_dir):
    """FN-03 + FN-05: few-shot prompt around every document, word cap int(512/1.5)."""
    d = table(spark, sf_dir, "documents")
    ws = TX.words("text")
    wrapped = TX.wrap_prompt(ws, _PREFIX, _SUFFIX)
    return d.select("doc_id", F.size(wrapped).alias("n_wrapped"),
                    F.size(F.slice(ws, 1, TX.word_cap(TOKEN_CAP))).alias("n_capped"),
                    F.md5(F.array_join(F.slice(ws, 1, TX.word_cap(TOKEN_CAP)), " ")).alias("capped_words"),
                    F.lit(_PLEN).alias("prompt_length"), F.lit(len(_FULL)).alias("full_prompt_chars"),
                    F.element_at(wrapped, -1).alias("last_word"))


# Mask j over word positions keeps the positions whose draw has bit 8 + j set (one draw per position).
def _bit_sql(pos, j):
    return f"CAST(({h_sql(pos, MASK_SEED)} >> (8 + {j})) % 2 AS INTEGER)"


def _draws(ws):
    """One draw per word position."""
    return F.transform(ws, lambda w, i: h(i, MASK_SEED).cast("int"))


def _bit(draw, j):
    return F.shiftright(draw, 8 + j).bitwiseAND(1)


@register("word_token_masks", f"""WITH w AS (SELECT doc_id, UNNEST({_sql_words(_sql_clean('text'))}) AS word,
        UNNEST(range(len({_sql_words(_sql_clean('text'))}))) AS pos FROM documents),
t AS (SELECT doc_id, pos, GREATEST(1, CEIL(length(word) / 4)) AS n_tok, {_bit_sql('pos', 0)} AS m FROM w)
SELECT d.doc_id, CAST(coalesce(SUM(n_tok), 0) AS INTEGER) AS n_tokens, CAST(coalesce(SUM(n_tok * m), 0) AS INTEGER) AS n_masked_tokens,
       CAST(coalesce(SUM(m), 0) AS INTEGER) AS n_words_kept FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY d.doc_id""")
def q_word_token_masks(spark, sf_dir):
    """FN-04 + FN-06: a word-position mask (fixed mask 0, as long as the text)
    expanded to token positions by each word's token count.  A document without words has 0, 0, 0."""
    d = table(spark, sf_dir, "documents").select("doc_id", TX.words(TX.clean(F.coalesce("text", F.lit("")))).alias("ws"))
    mask = F.transform(_draws(F.col("ws")), lambda d: _bit(d, 0))
    counts = F.transform("ws", lambda w: TX.token_count(w))
    ws, m = TX.align_words_mask(F.col("ws"), mask)
    tm = TX.expand_mask(m, counts)
    return d.select("doc_id", F.size(tm).alias("n_tokens"),
                    F.aggregate(tm, F.lit(0), lambda a, v: a + v).alias("n_masked_tokens"),
                    F.aggregate(m, F.lit(0), lambda a, v: a + v).alias("n_words_kept"))


def _joined(ws):
    """All words as one string.  Every feature of the character profile is a sum over words, so the
    profile of the joined words is the sum of the words' profiles, without a row or lambda per word."""
    return F.array_join(ws, "")


@register("text_pooling", f"""WITH w AS (SELECT doc_id, UNNEST({_sql_words(_sql_clean('text'))}) AS word,
        UNNEST(range(len({_sql_words(_sql_clean('text'))}))) AS pos FROM documents),
v AS (SELECT doc_id, pos, {_sql_profile('word')} AS f FROM w),
vl AS (SELECT doc_id, pos, UNNEST(range(8)) AS k, UNNEST(f) AS x FROM v),
avgv AS (SELECT doc_id, k, AVG(x) AS a FROM vl GROUP BY doc_id, k),
an AS (SELECT doc_id, SQRT(SUM(a * a)) AS nrm FROM avgv GROUP BY doc_id),
lastp AS (SELECT doc_id, MAX(pos) AS p FROM v GROUP BY doc_id),
lv AS (SELECT v.doc_id, v.f FROM v JOIN lastp ON v.doc_id = lastp.doc_id AND v.pos = lastp.p)
SELECT d.doc_id, COALESCE(avg_len, 0.0) AS avg_len, COALESCE(avg_e, 0.0) AS avg_e, COALESCE(avg_norm, 0.0) AS avg_norm,
       COALESCE(last_len, 0.0) AS last_len FROM documents d LEFT JOIN (
SELECT an.doc_id,
       ROUND(MAX(CASE WHEN avgv.k = 0 THEN avgv.a END) / GREATEST(an.nrm, 1e-12), 6) AS avg_len,
       ROUND(MAX(CASE WHEN avgv.k = 2 THEN avgv.a END) / GREATEST(an.nrm, 1e-12), 6) AS avg_e,
       ROUND(an.nrm, 6) AS avg_norm,
       ROUND(MAX(lv.f[1]) / GREATEST(SQRT(list_sum(list_transform(MAX(lv.f), lambda z: z * z))), 1e-12), 6) AS last_len
FROM an JOIN avgv ON an.doc_id = avgv.doc_id JOIN lv ON lv.doc_id = an.doc_id GROUP BY an.doc_id, an.nrm) q ON q.doc_id = d.doc_id""")
def q_text_pooling(spark, sf_dir):
    """FN-11 (avg and last pooling) + PRJ-11 row L2 normalisation over the default word embedder.
    A document without words has the zero vector."""
    from ..functions.vectors import l2_norm
    d = table(spark, sf_dir, "documents").select("doc_id", TX.words(TX.clean(F.coalesce("text", F.lit("")))).alias("ws"))
    d = d.select("doc_id", F.size("ws").alias("n"), _joined("ws").alias("all"),
                 F.coalesce(F.try_element_at("ws", F.lit(-1)), F.lit("")).alias("end"))
    d = d.select("doc_id", "n", TX.char_profile("all").alias("total"), TX.char_profile("end").alias("last"))
    d = d.withColumn("avg", F.transform("total", lambda x: x / F.greatest("n", F.lit(1))))
    na, nl = row_l2_normalize("avg"), row_l2_normalize("last")
    return d.select("doc_id", F.round(F.get(na, 0), 6).alias("avg_len"), F.round(F.get(na, 2), 6).alias("avg_e"),
                    F.round(l2_norm("avg"), 6).alias("avg_norm"), F.round(F.get(nl, 0), 6).alias("last_len"))


@register("token_padding", f"""WITH w AS (SELECT doc_id, UNNEST({_sql_words(_sql_clean('text'))}) AS word,
        UNNEST(range(len({_sql_words(_sql_clean('text'))}))) AS pos FROM documents),
p AS (SELECT doc_id, pos, UNNEST(range(CAST(GREATEST(1, CEIL(length(word) / 4)) AS BIGINT))) AS i, word FROM w),
t AS (SELECT doc_id, pos, i, substr(word, CAST(i * 4 + 1 AS INTEGER), 4) AS piece FROM p),
ids AS (SELECT doc_id, CAST(1 + length(piece) + 5 * {_sql_count('piece', 'aeiouAEIOU')} AS INTEGER) AS tid,
               pos, i FROM t),
toks AS (SELECT d.doc_id, COALESCE(list(tid ORDER BY pos, i) FILTER (WHERE tid IS NOT NULL), []) AS tokens
         FROM documents d LEFT JOIN ids ON d.doc_id = ids.doc_id GROUP BY d.doc_id),
mx AS (SELECT MAX(len(tokens)) AS L FROM toks)
SELECT doc_id, CAST(L AS INTEGER) AS padded_len, CAST(len(tokens) AS INTEGER) AS effective_len,
       CAST(len(tokens) AS INTEGER) AS n_nonpad,
       CAST(LEAST(len(tokens), {TRUNCATE_TOKENS}) AS INTEGER) AS truncated_len,
       CAST(list_sum(tokens) AS BIGINT) AS token_sum
FROM toks, mx""")
def q_token_padding(spark, sf_dir):
    """FN-08/09/10 + PRJ-16: default tokenizer, pad to the global max length
    (one scalar aggregate), effective length, padding removal, truncation to 256."""
    d = table(spark, sf_dir, "documents")
    toks = d.select("doc_id", F.transform(TX.pieces_of(TX.words(TX.clean(F.coalesce("text", F.lit(""))))), TX.token_id).alias("tokens"))
    L = toks.agg(F.max(F.size("tokens")).alias("L"))
    # Padding only adds pad ids at the end: lengths are taken from the tokens, and no array is padded
    # to the longest document here.  L is one aggregate row.
    j = toks.join(F.broadcast(L), how="inner", on=F.lit(True))
    return j.select("doc_id", F.greatest(F.col("L"), F.size("tokens")).cast("int").alias("padded_len"),
                    TX.effective_length("tokens").cast("int").alias("effective_len"),
                    F.when(F.size("tokens") == 0, 0).otherwise(F.size(TX.remove_padding("tokens"))).cast("int")
                    .alias("n_nonpad"),
                    F.size(F.slice(F.col("tokens"), 1, TRUNCATE_TOKENS)).cast("int").alias("truncated_len"),
                    F.aggregate("tokens", F.lit(0).cast("long"), lambda a, v: a + v).alias("token_sum"))


@register("event_props_json", """WITH e AS (SELECT event_type, TRY_CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_type, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(CASE WHEN k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_malformed,
       ROUND(AVG(k), 6) AS mean_k FROM e GROUP BY event_type""")
def q_event_props_json(spark, sf_dir):
    """SRC-11: JSON text parsed with an explicit schema (PERMISSIVE); malformed
    rows counted as a side output instead of silently dropped."""
    e = table(spark, sf_dir, "events")
    p = e.select("event_type", F.from_json("props", "k int").alias("j"))
    return p.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"),
                                       F.sum(F.when(F.col("j.k").isNull(), 1).otherwise(0)).cast("long").alias("n_malformed"),
                                       F.round(F.avg("j.k"), 6).alias("mean_k"))


@register("csv_safe_text", """SELECT conv_id, turn, role,
       replace(replace(COALESCE(text, 'None'), ',', '[comma]'), chr(10), '\\n') AS safe_text FROM conversations""")
def q_csv_safe_text(spark, sf_dir):
    """FN-18: CSV-safe text for every conversation turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", TX.csv_safe("text").alias("safe_text"))


# ---------------------------------------------------------------- word-level subspace detector
N_TEXT_MASKS = 8


SPACES = ("word", "token")


def _units(ws, space: str):
    """MDL-17/18: the positions that masks cover, words or the pieces of the default tokenizer."""
    return ws if space == "word" else TX.pieces_of(ws)


def position_draws(spark, n: int):
    """The draws of the first ``n`` positions as one constant array: they depend on the position only, so they are made once
    and not per document.  As long as the longest text of the table."""
    draws = spark.range(n).select(F.sort_array(F.collect_list(F.struct("id", h("id", MASK_SEED).cast("int").alias("d")))).alias("s")) \
        .select(F.transform("s", lambda t: t["d"]).alias("d")).first()["d"]
    return F.from_json(F.lit(str(draws)), "array<int>")  # folded to a literal of the plan


def _text_views(spark, sf_dir, space="word"):
    ds = _docs(spark, sf_dir)
    w = staged(ds.select("row_id", _units(TX.words(TX.clean(F.coalesce("text", F.lit("")))), space).alias("ws")), "units")
    draws = position_draws(spark, w.agg(F.max(F.size("ws"))).first()[0] or 0)
    # Masked sums over rows of words fold before the shuffle.  The divisor is the number of all words; a document without words
    # has zero views.
    u = w.select("row_id", F.posexplode_outer("ws").alias("pos", "word"))
    u = u.select("row_id", "word", F.coalesce(F.get(draws, F.col("pos")), F.lit(0)).alias("draw"), TX.char_profile(F.coalesce("word", F.lit(""))).alias("f"))
    d = len(TX.PROFILE_FEATURES)
    fs = [F.get("f", F.lit(k)).cast("long") for k in range(d)]
    sums = [F.sum(f).alias(f"a{k}") for k, f in enumerate(fs)]
    sums += [F.sum(F.when(_bit(F.col("draw"), j) == 1, f).otherwise(0)).alias(f"m{j}_{k}") for j in range(N_TEXT_MASKS) for k, f in enumerate(fs)]
    s = u.groupBy("row_id").agg(F.count("word").alias("nw"), *sums)
    n = F.greatest("nw", F.lit(1))
    mean = lambda cols: F.array(*[F.col(c) / n for c in cols])
    views = F.array(*[F.struct(F.lit(j).alias("subspace_id"), mean([f"m{j}_{k}" for k in range(d)]).alias("x")) for j in range(N_TEXT_MASKS)])
    # one row per document, read by two branches (per-view ECOD and the distance)
    return ds, materialize(s.select("row_id", mean([f"a{k}" for k in range(d)]).alias("full"), views.alias("views")))


def text_subspace_scores(spark, sf_dir, space="word"):
    ds, v = _text_views(spark, sf_dir, space)
    from ..functions.vectors import l2_dist
    long = v.select("row_id", F.explode("views").alias("vw")).select(
        "row_id", F.col("vw.subspace_id").alias("subspace_id"), F.col("vw.x").alias("x"))
    per = ecod_scores(long, ["row_id"], group_cols=["subspace_id"])
    # probabilities of the 8 fixed masks: weight lcm(1..8)/(j+1) normalised
    w = [840 // (j + 1) for j in range(N_TEXT_MASKS)]
    probs = spark.createDataFrame([(j, w[j] / float(sum(w))) for j in range(N_TEXT_MASKS)], "subspace_id int, proba double")
    ens = per.join(F.broadcast(probs), "subspace_id").groupBy("row_id").agg(
        (F.sum(F.col("score") * F.col("proba")) / F.count(F.lit(1))).alias("ensemble"))
    dist = v.select("row_id", F.array_min(F.transform("views", lambda t: l2_dist(F.col("full"), t["x"])))
                    .alias("distance"))
    test = ds.filter("split = 'test'").select("row_id", "label", "outlier")
    return test.join(ens, "row_id").join(dist, "row_id").select(
        "row_id", "label", "outlier", F.round("ensemble", 6).alias("ensemble"),
        F.round("distance", 6).alias("distance"),
        F.round(F.col("ensemble") + F.col("distance"), 6).alias("score"))


def _units_sql(t, space):
    """The words or tokens; one empty one for a text without any, whose profile is zero."""
    words = _sql_words(_sql_clean(t))
    words = f"(CASE WHEN len({words}) > 0 THEN {words} ELSE [''] END)"
    if space == "word":
        return words
    return (f"flatten(list_transform({words}, lambda w: list_transform(range(CAST(GREATEST(1, CEIL(length(w) / 4)) AS BIGINT)), "
            f"lambda i: substr(w, CAST(i * 4 + 1 AS INTEGER), 4))))")


def _text_sql(space="word"):
    w = [840 // (j + 1) for j in range(N_TEXT_MASKS)]
    probs = " UNION ALL ".join(f"SELECT {j} AS subspace_id, {w[j] / float(sum(w))!r} AS proba" for j in range(N_TEXT_MASKS))
    return f"""ds AS ({_DOC_DS}),
w AS (SELECT row_id, UNNEST(units) AS word, UNNEST(range(len(units))) AS pos FROM (
        SELECT row_id, {_units_sql("coalesce(text, '')", space)} AS units FROM ds)),
v AS (SELECT row_id, pos, {_sql_profile('word')} AS f FROM w),
vl AS (SELECT row_id, pos, UNNEST(range(8)) AS k, UNNEST(f) AS x FROM v),
nw AS (SELECT row_id, COUNT(*) AS n FROM v GROUP BY row_id),
mj AS (SELECT CAST(j AS INTEGER) AS subspace_id FROM range({N_TEXT_MASKS}) t(j)),
full_ AS (SELECT vl.row_id, vl.k, SUM(vl.x) / MAX(nw.n) AS x FROM vl JOIN nw ON vl.row_id = nw.row_id GROUP BY vl.row_id, vl.k),
view_ AS (SELECT vl.row_id, mj.subspace_id, vl.k,
                 SUM(vl.x * {_bit_sql('vl.pos', 'mj.subspace_id')}) / MAX(nw.n) AS x
          FROM vl JOIN nw ON vl.row_id = nw.row_id, mj GROUP BY vl.row_id, mj.subspace_id, vl.k),
cnt AS (SELECT subspace_id, k, x, COUNT(*) AS c FROM view_ GROUP BY subspace_id, k, x),
cum AS (SELECT *, SUM(c) OVER (PARTITION BY subspace_id, k ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c_cum,
               SUM(c) OVER (PARTITION BY subspace_id, k) AS c_tot FROM cnt),
sk AS (SELECT subspace_id, k, SUM(c * x * x * x) / SUM(c) - 3 * (SUM(c * x) / SUM(c)) * SUM(c * x * x) / SUM(c) + 2 * POW(SUM(c * x) / SUM(c), 3) AS m3 FROM cnt GROUP BY subspace_id, k),
tab AS (SELECT cum.subspace_id, cum.k, x, -LN(c_cum / c_tot) AS o_l, -LN((c_tot - c_cum + c) / c_tot) AS o_r, m3 < 0 AS neg
        FROM cum JOIN sk ON cum.subspace_id = sk.subspace_id AND cum.k = sk.k),
o AS (SELECT v.row_id, v.subspace_id, t.o_l, t.o_r, CASE WHEN t.neg THEN t.o_l ELSE t.o_r END AS o_a
      FROM view_ v JOIN tab t ON v.subspace_id = t.subspace_id AND v.k = t.k AND v.x = t.x),
per AS (SELECT row_id, subspace_id, GREATEST(SUM(o_l), SUM(o_r), SUM(o_a)) AS s FROM o GROUP BY row_id, subspace_id),
pr AS ({probs}),
ens AS (SELECT per.row_id, SUM(per.s * pr.proba) / COUNT(*) AS ensemble FROM per JOIN pr ON per.subspace_id = pr.subspace_id
        GROUP BY per.row_id),
dd AS (SELECT f.row_id, v.subspace_id, SQRT(SUM((f.x - v.x) * (f.x - v.x))) AS d
       FROM full_ f JOIN view_ v ON f.row_id = v.row_id AND f.k = v.k GROUP BY f.row_id, v.subspace_id),
dist AS (SELECT row_id, MIN(d) AS distance FROM dd GROUP BY row_id),
res AS (SELECT ds.row_id, ds.label, ds.outlier, ROUND(ens.ensemble, 6) AS ensemble, ROUND(dist.distance, 6) AS distance,
               ROUND(ens.ensemble + dist.distance, 6) AS score
        FROM ds JOIN ens ON ds.row_id = ens.row_id JOIN dist ON ds.row_id = dist.row_id WHERE ds.split = 'test')"""


@register("text_subspace_scores", f"WITH {_text_sql()} SELECT * FROM res")
def q_text_subspace_scores(spark, sf_dir):
    """MDL-16 / MDL-18 word space: masks over word positions (as long as the
    longest text), masked mean pooling (FN-12), ECOD per view (MDL-19), the /m
    text ensemble (AGG-17), the unscaled word distance (AGG-14) and their sum (AGG-18)."""
    return text_subspace_scores(spark, sf_dir)


@register("text_subspace_metrics", f"WITH {_text_sql()}, scored AS (SELECT score, outlier FROM res), "
                                   f"{metrics_sql('scored')} SELECT * FROM _metrics")
def q_text_subspace_metrics(spark, sf_dir):
    return binary_metrics(text_subspace_scores(spark, sf_dir).select("score", "outlier"))


@register("token_subspace_metrics", f"WITH {_text_sql('token')}, scored AS (SELECT score, outlier FROM res), "
                                    f"{metrics_sql('scored')} SELECT * FROM _metrics")
def q_token_subspace_metrics(spark, sf_dir):
    """MDL-17 / MDL-18 token space: masks over token positions."""
    return binary_metrics(text_subspace_scores(spark, sf_dir, "token").select("score", "outlier"))


@register("stream_document_features", f"""WITH w AS (SELECT doc_id, lang, {_sql_words(_sql_clean('text'))} AS ws FROM documents)
SELECT doc_id, lang, CAST(len(ws) AS INTEGER) AS n_words,
       ROUND(COALESCE(list_sum(list_transform(ws, lambda x: CAST(length(x) AS DOUBLE))), 0.0) / GREATEST(len(ws), 1), 6) AS mean_word_len,
       ROUND(COALESCE(list_sum(list_transform(ws, lambda x: CAST({_sql_count('x', 'eE')} AS DOUBLE))), 0.0) / GREATEST(len(ws), 1), 6) AS mean_e
FROM w""")
def q_stream_document_features(spark, sf_dir):
    """STR-01: the document features computed by an availableNow Structured
    Streaming query (file source -> parquet sink with checkpoint), read back;
    equals the batch computation."""
    from ..streaming.incremental import incremental_document_features
    return incremental_document_features(spark, sf_dir)

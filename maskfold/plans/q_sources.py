"""Dataset sources, the result store's scans, classification reports and small tables
(SRC-01..05, SRC-12..17, PRJ-01/05/06, MDL-20, AGG-27, AGG-36, FN-19, FN-21, JN-06)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.hashing import h
from ..operators.masks import MASK_SEED
from ..operators.metrics import classification_report
from ..session import checkpoint_dir, path_kind, scratch_path
from ..sources.cache import RowCache
from ..sources.datasets import DatasetSpec, embedding_dataset, read_dataset, read_datasets, split_column, validate_prepared
from ..sources.results import gated_scan, scan_result_tree, select_rows, upsert, write_results_csv_tree
from ..sources.tables import table
from .catalog import register
from .experiment import results_grid, results_grid_sql
from .q_text import _bit, _bit_sql, _sql_clean, _sql_count, _sql_profile, _sql_words
from .sqlparts import emb_dataset_sql, split_sql

_R = results_grid_sql()
TEXT_SCHEMA = "doc_id long, text string, sentiment string"
POSITIVE = "positive"


def _labelled(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select("doc_id", "text", "lang", "quality", "toxic")


# ---------------------------------------------------------------- CSV and task sources
def write_csv(df: DataFrame, path: str) -> None:
    """Texts keep their line feeds and quotes."""
    df.write.option("header", True).option("escape", '"').csv(path)


_CSV_SQL = f"""s AS (SELECT d.doc_id, coalesce(d.text, '') AS text, CAST(l.quality = 1 AS INTEGER) AS label,
       {split_sql('d.doc_id')} AS split FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


@register("csv_text_source", f"""WITH {_CSV_SQL}
SELECT split, label, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(length(text)) AS BIGINT) AS chars, MIN(doc_id) AS first_id,
       CAST(SUM(len(string_split(text, chr(10))) - 1) AS BIGINT) AS line_feeds
FROM s GROUP BY split, label""")
def q_csv_text_source(spark, sf_dir):
    """SRC-01/03 + PRJ-01 + UDF-06: train and test files written to the shared folder and read by two specs: schema, a label
    derived from a word and the split; every row of both files, unknown labels are errors."""
    src = _labelled(spark, sf_dir).select(
        "doc_id", "text", F.when(F.col("quality") == 1, POSITIVE).otherwise("negative").alias("sentiment"),
        split_column("doc_id").alias("split"))
    root = scratch_path(spark, "csv-source")
    for split in ("train", "test"):
        write_csv(src.where(F.col("split") == split).drop("split"), f"{root}/{split}")
    common = dict(x_col="text", id_col="doc_id", label_col="sentiment", fmt="csv", schema=TEXT_SCHEMA, positive=POSITIVE, labels=(0, 1))
    both = read_datasets(spark, [DatasetSpec("train", f"{root}/train", split="train", **common),
                                 DatasetSpec("test", f"{root}/test", split="test", **common)])
    text = F.coalesce("x", F.lit(""))
    return both.groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).cast("long").alias("chars"), F.min("row_id").alias("first_id"),
        F.sum(F.size(F.split(text, "\n", -1)) - 1).cast("long").alias("line_feeds"))


TITLES = {"en": "english prose", "de": "german prose", "fr": "french prose", "es": "spanish prose"}  # other codes are their own title
TASK_ROWS = 25
_TITLE_SQL = "CASE " + " ".join(f"WHEN lang = '{k}' THEN '{v}'" for k, v in TITLES.items()) + " ELSE coalesce(lang, 'none') END"


def task_specs(spark, sf_dir, first: int = -1) -> list[DatasetSpec]:
    """One spec per task that occurs, over documents cached once as Parquet by task; each is read through a partition filter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("lang", F.lit("none")).alias("original_task"))
    key = docs.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "text", "original_task").cast("decimal(38,0)"))).first()
    path = f"{checkpoint_dir(spark).rstrip('/')}/tasks-{key[0]}-{key[1]}"
    if path_kind(spark, f"{path}/_SUCCESS") == "none":
        docs.write.mode("overwrite").partitionBy("original_task").parquet(path)
    # one row a task
    tasks = [r[0] for r in spark.read.parquet(path).select("original_task").distinct().orderBy("original_task").collect()]
    return [DatasetSpec(TITLES.get(t, t), path, "text", "doc_id", constant_label=0, where=(("original_task", t),), first=first) for t in tasks]


@register("task_source", f"""SELECT doc_id, {_TITLE_SQL} AS task, 0 AS label, CAST(length(coalesce(text, '')) AS INTEGER) AS chars FROM documents""")
def q_task_source(spark, sf_dir):
    """SRC-02/04/05 + UDF-06: every row of every task, with its constant label."""
    rows = read_datasets(spark, task_specs(spark, sf_dir))
    return rows.select(F.col("row_id").alias("doc_id"), F.col("dataset").alias("task"), "label",
                       F.length(F.coalesce("x", F.lit(""))).alias("chars"))


@register("task_source_first_rows", f"""WITH s AS (SELECT doc_id, {_TITLE_SQL} AS task, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents)
SELECT doc_id, task, 0 AS label FROM s WHERE r <= {TASK_ROWS}""")
def q_task_source_first_rows(spark, sf_dir):
    """PRJ-05: the first rows of every task by id."""
    rows = read_datasets(spark, task_specs(spark, sf_dir, TASK_ROWS))
    return rows.select(F.col("row_id").alias("doc_id"), F.col("dataset").alias("task"), "label")


@register("prepared_data_checks", f"""WITH ds AS ({emb_dataset_sql(0)})
SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, 0 AS nan_rows, MIN(len(embedding)) AS min_dim, MAX(len(embedding)) AS max_dim,
       CAST(SUM(CAST(split = 'train' AND label <> 0 AS INTEGER)) AS BIGINT) AS foreign_train FROM ds""")
def q_prepared_data_checks(spark, sf_dir):
    """PRJ-06: the checks of a prepared one-class matrix, in one pass; a failed one stops the query."""
    r = validate_prepared(embedding_dataset(spark, sf_dir, 0), 0)
    row = (r["rows"], int(r["nan_rows"] or 0), r["min_dim"], r["max_dim"], int(r["foreign_train"] or 0))
    return spark.createDataFrame([row], "n_rows long, nan_rows int, min_dim long, max_dim long, foreign_train long")


@register("standardized_specs", f"""WITH xl AS (SELECT vec_id AS row_id, label, UNNEST(range(len(embedding))) AS dim, CAST(UNNEST(embedding) AS DOUBLE) AS v
  FROM embeddings WHERE label IN (0, 1, 2)),
m AS (SELECT row_id, AVG(v) AS mu, STDDEV_SAMP(v) AS sd FROM xl GROUP BY row_id),
z AS (SELECT xl.row_id, label, dim, (v - mu) / sd AS z FROM xl JOIN m ON m.row_id = xl.row_id),
n AS (SELECT row_id, CAST(ANY_VALUE(label) AS INTEGER) AS label, SQRT(SUM(z * z)) AS nrm, MAX(z) AS hi FROM z GROUP BY row_id)
SELECT row_id, label, {split_sql('row_id')} AS split, ROUND(hi / nrm, 6) AS largest FROM n""")
def q_standardized_specs(spark, sf_dir):
    """UDF-06 + PRJ-12: a vector table read by a spec that keeps three labels and standardises its rows."""
    domain = tuple(r[0] for r in table(spark, sf_dir, "embeddings").select("label").distinct().collect())  # one row a label
    spec = DatasetSpec("vectors", f"{sf_dir.rstrip('/')}/embeddings.parquet", "embedding", "vec_id", "label", labels=domain,
                       keep=tuple(c for c in domain if c in (0, 1, 2)), standardize=True)
    rows = read_dataset(spark, spec)
    return rows.select("row_id", "label", "split", F.round(F.array_max("x"), 6).alias("largest"))


# ---------------------------------------------------------------- incremental caches
def _tokens(df: DataFrame) -> DataFrame:
    words = TX.words(TX.clean(F.coalesce("text", F.lit(""))))
    return df.select("doc_id", "label", F.transform(TX.pieces_of(words), TX.token_id).alias("tokens"))


@register("token_cache", f"""WITH d AS (SELECT d.doc_id, {_sql_words(_sql_clean("coalesce(d.text, '')"))} AS ws
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1),
k AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () // 2 AS wanted FROM d),
p AS (SELECT doc_id, flatten(list_transform(ws, lambda w: list_transform(range(CAST(GREATEST(1, CEIL(length(w) / 4)) AS BIGINT)),
        lambda i: substr(w, CAST(i * 4 + 1 AS INTEGER), 4)))) AS pieces FROM k WHERE r <= wanted)
SELECT doc_id, CAST(len(pieces) AS BIGINT) AS n_tokens,
       CAST(coalesce(list_sum(list_transform(pieces, lambda t: 1 + length(t) + 5 * {_sql_count('t', 'aeiouAEIOU')})), 0) AS BIGINT) AS token_sum
FROM p""")
def q_token_cache(spark, sf_dir):
    """SRC-12: token ids of labelled documents cached batch by batch until half of the inliers are stored; the
    inliers with the smallest ids are read back.  The second call finds them in the cache."""
    docs = _labelled(spark, sf_dir).select("doc_id", "text", F.col("quality").cast("int").alias("label"))
    wanted = docs.where("label = 1").count() // 2
    cache = RowCache(spark, scratch_path(spark, "token-cache"), "doc_id", _tokens, F.col("label") == 1, batch_rows=100)
    cache.fill(docs, wanted)
    got = cache.fill(docs, wanted)
    return got.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"),
                      F.aggregate("tokens", F.lit(0).cast("long"), lambda a, v: a + v).alias("token_sum"))


@register("vector_cache", f"""WITH d AS (SELECT doc_id, {_sql_words(_sql_clean("coalesce(text, '')"))} AS ws FROM documents),
p AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, {_sql_profile("array_to_string(ws, '')")} AS total FROM d)
SELECT doc_id, n_words, ROUND(total[1] / GREATEST(n_words, 1), 6) AS mean_length, ROUND(total[3] / GREATEST(n_words, 1), 6) AS mean_e FROM p""")
def q_vector_cache(spark, sf_dir):
    """SRC-13: pooled vectors of all documents cached in two arrivals; rows that arrive later in a finished batch are added."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")

    def pooled(df):
        ws = df.select("doc_id", TX.words(TX.clean(F.coalesce("text", F.lit("")))).alias("ws"))
        total = ws.select("doc_id", F.size("ws").cast("long").alias("n_words"), TX.char_profile(F.array_join("ws", "")).alias("total"))
        return total.select("doc_id", "n_words", F.transform("total", lambda x: x / F.greatest("n_words", F.lit(1))).alias("x"))

    cache = RowCache(spark, scratch_path(spark, "vector-cache"), "doc_id", pooled, batch_rows=1000)
    cache.fill(docs.where("lang = 'en'"))
    return cache.fill(docs).select("doc_id", "n_words", F.round(F.get("x", 0), 6).alias("mean_length"),
                                   F.round(F.get("x", 2), 6).alias("mean_e"))


# ---------------------------------------------------------------- result store
KEYS = ["dataset", "emb_model", "run"]
TREE_SCHEMA = "method string, space string, base string, auc double, prauc double, f1 double"


def _tree(spark, sf_dir):
    """The grid's rows as a folder tree of CSV files, and the folders with a criteria row (all but run 2)."""
    r, root = results_grid(spark, sf_dir), scratch_path(spark, "result-tree")
    write_results_csv_tree(r.select(*KEYS, *(c.split()[0] for c in TREE_SCHEMA.split(", "))), root)
    return scan_result_tree(spark, root, TREE_SCHEMA), r.where("run <> 2").select(*KEYS).distinct()


@register("result_store_scan", f"""WITH {_R}
SELECT method, dataset, run, ROUND(auc, 6) AS auc, ROUND(f1, 6) AS f1 FROM results WHERE run <> 2""")
def q_result_store_scan(spark, sf_dir):
    """SRC-14/15/16: rows written as a folder tree, scanned back, only folders that have a criteria row."""
    rows, criteria = _tree(spark, sf_dir)
    return gated_scan(rows, criteria).select("method", "dataset", "run", F.round("auc", 6).alias("auc"), F.round("f1", 6).alias("f1"))


@register("result_store_bad_folders", f"""WITH {_R}
SELECT dataset, emb_model, run, CAST(COUNT(*) AS BIGINT) AS n_rows FROM results WHERE run = 2 GROUP BY ALL""")
def q_result_store_bad_folders(spark, sf_dir):
    """SRC-15: the folders that the gate leaves out."""
    rows, criteria = _tree(spark, sf_dir)
    return rows.join(criteria, KEYS, "left_anti").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"))


@register("result_store_upsert", f"""WITH {_R}
SELECT method, dataset, run, ROUND(CASE WHEN run = 0 THEN auc / 2 ELSE auc END, 6) AS auc FROM results""")
def q_result_store_upsert(spark, sf_dir):
    """SRC-17: new rows of run 0 replace the stored ones; the others stay."""
    r = results_grid(spark, sf_dir).select("method", "dataset", "run", "auc")
    new = r.where("run = 0").withColumn("auc", F.col("auc") / 2)
    return upsert(r, new, ["method", "dataset", "run"]).withColumn("auc", F.round("auc", 6))


@register("selected_results", f"""WITH {_R}
SELECT method, dataset, run, ROUND(auc, 6) AS auc FROM results
WHERE base IN ('ECOD') AND space IN ('Embedding', 'Token') AND method NOT IN ('FullSpace + Embedding') AND run NOT IN (1, 7)""")
def q_selected_results(spark, sf_dir):
    """PRJ-15: result rows by lists of values to include and to exclude."""
    r = select_rows(results_grid(spark, sf_dir), {"base": ["ECOD"], "space": ["Embedding", "Token"]},
                    {"method": ["FullSpace + Embedding"], "run": [1, 7]})
    return r.select("method", "dataset", "run", F.round("auc", 6).alias("auc"))


@register("filled_from_base_rows", f"""WITH {_R},
a AS (SELECT dataset, method, AVG(CASE WHEN method LIKE 'FullSpace%' OR hash_even THEN auc END) AS auc
      FROM (SELECT *, run % 2 = 0 AND method LIKE 'SubspaceD%' AS hash_even FROM results) GROUP BY ALL),
b AS (SELECT dataset, auc AS base_auc FROM a WHERE method LIKE 'FullSpace%')
SELECT a.dataset, a.method, ROUND(coalesce(a.auc, b.base_auc), 6) AS auc, a.auc IS NULL AS filled
FROM a JOIN b ON a.dataset = b.dataset WHERE a.method NOT LIKE 'FullSpace%'""")
def q_filled_from_base_rows(spark, sf_dir):
    """JN-06: missing values of a method's row are filled from its dataset's one base row."""
    r = results_grid(spark, sf_dir)
    known = F.col("method").startswith("FullSpace") | (F.col("method").startswith("SubspaceD") & (F.col("run") % 2 == 0))
    a = r.groupBy("dataset", "method").agg(F.avg(F.when(known, F.col("auc"))).alias("auc"))
    base = a.where(F.col("method").startswith("FullSpace")).groupBy("dataset").agg(
        F.when(F.count(F.lit(1)) == 1, F.first("auc")).otherwise(
            F.raise_error(F.lit("a dataset has several base rows")).cast("double")).alias("base_auc"))
    return a.where(~F.col("method").startswith("FullSpace")).join(base, "dataset", "left").select(
        "dataset", "method", F.round(F.coalesce("auc", "base_auc"), 6).alias("auc"), F.col("auc").isNull().alias("filled"))


# ---------------------------------------------------------------- classification
LONG_TEXT = 1500

_REPORT_SQL = """c AS (SELECT y AS cls FROM p UNION SELECT pred FROM p),
per AS (SELECT cls, (SELECT COUNT(*) FROM p WHERE y = cls) AS support, (SELECT COUNT(*) FROM p WHERE pred = cls) AS predicted,
               (SELECT COUNT(*) FROM p WHERE y = cls AND pred = cls) AS tp FROM c),
pr AS (SELECT cls, support, tp, coalesce(tp / nullif(predicted, 0), 0) AS pc, coalesce(tp / nullif(support, 0), 0) AS rc FROM per),
f AS (SELECT *, coalesce(2 * pc * rc / nullif(pc + rc, 0), 0) AS f FROM pr)
SELECT CAST(cls AS VARCHAR) AS class, ROUND(pc, 6) AS precision, ROUND(rc, 6) AS recall, ROUND(f, 6) AS f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', ROUND(SUM(tp) / SUM(support), 6), ROUND(SUM(tp) / SUM(support), 6), ROUND(SUM(tp) / SUM(support), 6), CAST(SUM(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', ROUND(AVG(pc), 6), ROUND(AVG(rc), 6), ROUND(AVG(f), 6), CAST(SUM(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', ROUND(SUM(pc * support) / SUM(support), 6), ROUND(SUM(rc * support) / SUM(support), 6),
       ROUND(SUM(f * support) / SUM(support), 6), CAST(SUM(support) AS BIGINT) FROM f"""


@register("quality_rule_report", f"""WITH p AS (SELECT CAST(l.quality AS INTEGER) AS y, CAST(length(d.text) > {LONG_TEXT} AS INTEGER) AS pred
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL), {_REPORT_SQL}""")
def q_quality_rule_report(spark, sf_dir):
    """AGG-36: report of a fixed rule (long texts are good) against the quality labels."""
    p = _labelled(spark, sf_dir).where("quality is not null").select(
        F.col("quality").cast("int").alias("label"),
        (F.length(F.coalesce("text", F.lit(""))) > LONG_TEXT).cast("int").alias("pred"))
    return classification_report(p)


def fit_tfidf_classifier(train: DataFrame, vocabulary: int = 10_000, max_iter: int = 200):
    """MDL-20: TF-IDF of words and word pairs without English stop words, unit length, logistic regression.
    ``vocabulary`` bounds the terms kept (the feature's own parameter); all training rows are read."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import (CountVectorizer, IDF, NGram, Normalizer, RegexTokenizer, SQLTransformer,
                                    StopWordsRemover)
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\w\w+", gaps=False),
        StopWordsRemover(inputCol="words", outputCol="kept"),
        NGram(n=2, inputCol="kept", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(kept, pairs) AS terms FROM __THIS__"),
        CountVectorizer(inputCol="terms", outputCol="counts", vocabSize=vocabulary),
        IDF(inputCol="counts", outputCol="weighted"), Normalizer(inputCol="weighted", outputCol="features"),
        LogisticRegression(maxIter=max_iter)]).fit(train)


@register("tfidf_classifier_report")
def q_tfidf_classifier_report(spark, sf_dir):
    """MDL-20 with AGG-36 on the test split of the quality labels, whole texts."""
    rows = _labelled(spark, sf_dir).where("quality is not null").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("quality").cast("int").alias("label"),
        split_column("doc_id").alias("split"))
    model = fit_tfidf_classifier(rows.where("split = 'train'"))
    p = model.transform(rows.where("split = 'test'"))
    return classification_report(p.select("label", F.col("prediction").cast("int").alias("pred")))


# ---------------------------------------------------------------- small tables
@register("event_epoch_means", """SELECT CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INTEGER) AS epoch, CAST(COUNT(*) AS BIGINT) AS n,
       ROUND(AVG(value), 6) AS mean_value FROM events GROUP BY 1""")
def q_event_epoch_means(spark, sf_dir):
    """AGG-27: means per epoch of a step-level log (a day of events is an epoch)."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return e.groupBy(day.alias("epoch")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


MAX_BATCH, LATENT_FACTOR = 3000, 16


@register("size_rules", f"""SELECT kind, n, d, greatest(d // {LATENT_FACTOR}, 1) AS latent, least({MAX_BATCH}, n) AS batch,
       CAST(floor(pow(10, 6.7) / n + 400) * 4 AS BIGINT) AS rounds, CAST(floor(pow(10, 7.5) / n + 7000) * 2 AS BIGINT) AS long_rounds,
       CAST(floor(floor(pow(10, 6.7) / n + 400) * 4 * 1.5) AS BIGINT) AS token_rounds
FROM (SELECT label AS kind, CAST(COUNT(*) AS BIGINT) AS n, CAST(MAX(len(embedding)) AS BIGINT) AS d FROM embeddings GROUP BY label)""")
def q_size_rules(spark, sf_dir):
    """FN-21: latent size, batch size and numbers of rounds from a table's size, per label."""
    x = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).cast("long").alias("d"))
    n, rounds = F.col("n"), F.floor(F.lit(10.0 ** 6.7) / F.col("n") + 400) * 4
    return x.select("kind", "n", "d", F.greatest(F.floor(F.col("d") / LATENT_FACTOR), F.lit(1)).cast("long").alias("latent"),
                    F.least(F.lit(MAX_BATCH).cast("long"), n).alias("batch"), rounds.cast("long").alias("rounds"),
                    (F.floor(F.lit(10.0 ** 7.5) / n + 7000) * 2).cast("long").alias("long_rounds"),
                    F.floor(rounds * 1.5).cast("long").alias("token_rounds"))


@register("token_importance", f"""WITH w AS (SELECT item_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos
  FROM (SELECT item_id, {_sql_words(_sql_clean('text'))} AS ws FROM benchmark)),
v AS (SELECT item_id, pos, word, ({_bit_sql('pos', 0)} + {_bit_sql('pos', 1)} + {_bit_sql('pos', 2)}) / 3.0 AS v FROM w),
m AS (SELECT item_id, MIN(v) AS lo, MAX(v) AS hi FROM v GROUP BY item_id)
SELECT v.item_id, CAST(pos AS INTEGER) AS pos, word, ROUND(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE v END, 6) AS importance
FROM v JOIN m ON v.item_id = m.item_id""")
def q_token_importance(spark, sf_dir):
    """FN-19: the mean of three word masks per word, scaled to [0, 1] per text unless all are equal."""
    b = table(spark, sf_dir, "benchmark").select("item_id", TX.words(TX.clean(F.coalesce("text", F.lit("")))).alias("ws"))
    b = b.withColumn("v", F.transform("ws", lambda w, i: _mean_bits(h(i, MASK_SEED).cast("int"))))
    b = b.withColumns({"lo": F.array_min("v"), "hi": F.array_max("v")})
    scaled = F.transform("v", lambda x: F.when(F.col("hi") > F.col("lo"), (x - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(x))
    return b.select("item_id", F.posexplode(F.arrays_zip("ws", scaled.alias("x"))).alias("pos", "t")).select(
        "item_id", "pos", F.col("t.ws").alias("word"), F.round(F.col("t.x"), 6).alias("importance"))


def _mean_bits(draw):
    return (_bit(draw, 0) + _bit(draw, 1) + _bit(draw, 2)) / 3.0

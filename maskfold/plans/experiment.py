"""Experiment grid (MDL-22/23): methods x datasets x runs in one Spark job.

Datasets are the one-class problems "inlier class c" of the embedding table, one
per label that occurs in it; runs use different split seeds.  Every (dataset, run) cell is a
group column, so each scorer runs once over all cells (ids and labels are replicated
per cell with ``explode`` of a literal array, not a join; vectors are ranked once for all cells).  Result rows are written
once to the shared result store, under a fingerprint of the table's files and of the grid's
parameters; every report scans that store.  Layout: method, space, base, dataset, emb_model, run,
auc, prauc, f1, n_test, n_outlier, pct_outlier, pct_inlier.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
from pyspark.sql import functions as F

from ..functions.hashing import h_col, h_sql_seed
from ..session import checkpoint_dir, failure_text, files_of, staged
from ..operators.distance import subspace_distance
from ..operators.ecod import TERMS, ecod_cells, ecod_view_scores
from ..operators.ensemble import weighted_average
from ..operators.masks import fixed_masks, mask_rows
from ..operators.metrics import binary_metrics, metrics_sql
from ..sources.datasets import embedding_matrix, width
from ..sources.models import ModelStore
from .sqlparts import WIDTH_SQL, fixed_mask_weights_sql, fixed_masks_long_sql

# The grid of the registered experiment.
N_RUNS = 3
BASE_SEED = 42
METHODS = {
    "distance": ("SubspaceDistance + Embedding", "ECOD"),
    "ensemble": ("SubspaceEnsemble + Embedding", "ECOD"),
    "ecod": ("FullSpace + Embedding", "ECOD"),
    "trivial": ("Random", "Random"),
}
UNAVAILABLE = {"learned": ("Learned + Embedding", "LUNAR")}  # in the grid, as error rows
SPACE = "Embedding"
EMB_MODEL = "embeddings"


def _is_test(run):
    return F.pmod(h_col("row_id", run + BASE_SEED), F.lit(5)) == 0


def grid_dataset(spark, sf_dir, n_runs=N_RUNS):
    x = embedding_matrix(spark, sf_dir)
    # one number per class reaches the driver
    classes = [r[0] for r in x.where("label is not null").select("label").distinct().orderBy("label").collect()]
    cells = F.array(*[F.struct(F.lit(c).alias("inlier"), F.lit(r).alias("run")) for c in classes for r in range(n_runs)])
    g = x.withColumn("cell", F.explode(cells)).select(
        "row_id", "x", "label", F.col("cell.inlier").alias("inlier"), F.col("cell.run").alias("run"))
    g = g.withColumn("dataset", F.concat(F.lit("class_"), F.col("inlier").cast("string"))) \
        .withColumn("split", F.when(_is_test(F.col("run")), "test").otherwise("train")) \
        .withColumn("outlier", (F.col("label") != F.col("inlier")).cast("int"))
    return x, g.filter((F.col("split") == "test") | (F.col("label") == F.col("inlier")))


COLUMNS = ["method", "space", "base", "dataset", "emb_model", "run", "auc", "prauc", "f1", "n_test", "n_outlier",
           "pct_outlier", "pct_inlier"]


def store_path(spark, sf_dir, n_runs=N_RUNS) -> str:
    """Where the result rows of this table (its files, their lengths and times of change) and these parameters lie."""
    source = f"{sf_dir.rstrip('/')}/embeddings.parquet"
    key = repr((source, sorted(files_of(spark, source).items()), n_runs, BASE_SEED, METHODS, UNAVAILABLE, SPACE, EMB_MODEL))
    return f"{checkpoint_dir(spark).rstrip('/')}/results-{hashlib.md5(key.encode()).hexdigest()}"


def _failures(tables) -> list[str]:
    """What methods that this package has failed with; a row a method."""
    names = [name for name, _ in METHODS.values()]
    failed = tables["errors"].where(F.col("method").isin(names)).groupBy("method").agg(F.min("error").alias("error"))
    return sorted(f"{r['method']}: {r['error']}" for r in failed.collect())


def _stored(spark, sf_dir, n_runs, whole):
    """The tables of the store's latest version.  If ``whole``, one with failed methods is computed anew."""
    store = ModelStore(spark, store_path(spark, sf_dir, n_runs))
    if not store.versions() or whole and _failures(store.load()[1]):
        results, errors = compute(spark, sf_dir, n_runs)
        store.save({"results": results, "errors": errors}, partition_by=("dataset", "run"))
    return store.load()[1]


def results_grid(spark, sf_dir, n_runs=N_RUNS):
    """The stored result rows; they are computed and written if the store lacks them.  Sessions that start at once
    each write a version of their own, of which readers take a complete one.  Rows of a grid that lacks a method's are no
    result: its failure is raised, and the next call runs the grid again."""
    tables = _stored(spark, sf_dir, n_runs, whole=True)
    if failed := _failures(tables):
        raise RuntimeError(f"the grid's results are not whole: {'; '.join(failed)}")
    return tables["results"].select(*COLUMNS)


def error_rows(spark, sf_dir, n_runs=N_RUNS):
    """MDL-23: (method, dataset, run, error) of the grid's cells that failed."""
    return _stored(spark, sf_dir, n_runs, whole=False)["errors"].select("method", "dataset", F.col("run").cast("int").alias("run"), "error")


def cell_terms(x, g):
    """The ECOD terms of the test rows of every cell.  A row's label and the runs that test it decide its cells, so its values
    are ranked once and not once per cell."""
    cells = g.select("inlier", "run").distinct().collect()  # one row a cell
    classes, runs = (sorted({c[k] for c in cells}) for k in (0, 1))
    tested = sum((F.when(_is_test(F.lit(r)), 1 << i).otherwise(0) for i, r in enumerate(runs)), F.lit(0))
    label = F.coalesce(F.array_position(F.array(*map(F.lit, classes)), F.col("label")), F.lit(0))
    pattern = label * (1 << len(runs)) + tested
    bits = np.arange(1 << len(runs))[:, None] >> np.arange(len(runs)) & 1  # tests x runs
    shown = np.tile(bits == 1, (len(classes) + 1, 1))
    own = np.repeat(np.eye(len(classes) + 1, dtype=bool)[:, 1:], len(bits), axis=0)  # patterns x classes
    wide = ecod_cells(x, pattern, shown[:, :, None] | own[:, None, :], shown)
    return wide.select(F.get(F.array(*[F.lit(f"class_{c}") for c in classes]), F.col("member")).alias("dataset"),
                       F.get(F.array(*map(F.lit, runs)), F.col("family")).alias("run"), "row_id", *TERMS)


def scorers(spark, x, g):
    """Method -> a function that plans its scored rows (dataset, run, row_id, outlier, score) over all cells of the grid."""
    keys = ["dataset", "run"]
    test = staged(g.filter("split = 'test'").select(*keys, "row_id", "outlier"), "grid-test")
    d = width(x)
    masks = fixed_masks(spark, d, 8)
    # ECOD terms feed both the full-space and the per-subspace scores; written once so the two branches
    # do not recompute the ranks
    terms = cache(lambda: staged(cell_terms(x, g), "grid-terms"))

    def distance():
        dist = subspace_distance(x, masks, d).select("row_id", F.col("distance").alias("score"))
        return test.join(dist, "row_id")

    def ecod():
        full = ecod_view_scores(terms(), [(0, [1] * d)], ["row_id"], group_cols=keys).drop("subspace_id")
        return test.join(full, keys + ["row_id"])

    def ensemble():
        views = [(r["subspace_id"], r["mask"]) for r in mask_rows(masks)]
        per = ecod_view_scores(terms(), views, ["row_id"], group_cols=keys)
        return test.join(weighted_average(per, masks, ["row_id"], group_cols=keys, out_col="score"), keys + ["row_id"])

    def trivial():
        return test.withColumn("score", h_col("row_id", F.col("run") + 100) / F.lit(2147483648.0))

    def learned():
        raise NotImplementedError("scorers that train a network are not part of this package")

    return {"distance": distance, "ensemble": ensemble, "ecod": ecod, "trivial": trivial, "learned": learned}


def evaluated(frames: dict):
    """The metrics of planned methods, in one job."""
    scored = None
    for key, frame in frames.items():
        name, base = METHODS[key]
        part = frame.select(F.lit(name).alias("method"), F.lit(base).alias("base"), "dataset", "run", "outlier", F.round("score", 6).alias("score"))
        scored = part if scored is None else scored.unionByName(part)
    m = binary_metrics(scored, ["method", "base", "dataset", "run"])
    return staged(m.select("method", F.lit(SPACE).alias("space"), "base", "dataset", F.lit(EMB_MODEL).alias("emb_model"),
                           F.col("run").cast("int").alias("run"), "auc", "prauc", "f1", "n_test", "n_outlier",
                           "pct_outlier", "pct_inlier"), "grid-results")


def compute(spark, sf_dir, n_runs=N_RUNS, make=scorers):
    """(results, errors).  All methods that can be planned run in one job; if that fails, each runs in a job of its own, and
    the cells of those that fail are error rows.  The results lack those cells, so no report may take them for the whole."""
    x, g = grid_dataset(spark, sf_dir, n_runs)
    frames, failed = {}, {}

    def attempt(key, run):
        try:
            return run()
        except Exception as e:  # the method's own failure, reported as rows
            failed[key] = failure_text(e)

    for key, plan in make(spark, x, g).items():
        frame = attempt(key, plan)
        if frame is not None:
            frames[key] = frame
    try:
        results = evaluated(frames)
    except Exception:
        results = None
        for key, frame in frames.items():
            one = attempt(key, lambda f={key: frame}: evaluated(f))
            results = one if results is None else results if one is None else results.unionByName(one)
        if results is None:
            raise
    cells = g.select("dataset", "run").distinct()
    said = spark.createDataFrame([((METHODS | UNAVAILABLE)[k][0], e) for k, e in failed.items()], "method string, error string")
    return results, cells.join(F.broadcast(said), how="inner", on=F.lit(True)).select("method", "dataset", "run", "error")


def results_grid_sql() -> str:
    """CTE text defining ``results`` with the same rows as ``results_grid``."""
    cells = f"SELECT c AS inlier, CAST(r AS INTEGER) AS run FROM (SELECT DISTINCT CAST(label AS INTEGER) AS c FROM embeddings) t, range({N_RUNS}) u(r)"
    m = {k: v for k, v in METHODS.items()}
    return f"""
cells AS ({cells}),
g0 AS (SELECT e.vec_id AS row_id, CAST(e.embedding AS DOUBLE[]) AS emb, e.label, c.inlier, c.run,
              'class_' || CAST(c.inlier AS VARCHAR) AS dataset,
              CASE WHEN {h_sql_seed('e.vec_id', 'c.run + ' + str(BASE_SEED))} % 5 = 0 THEN 'test' ELSE 'train' END AS split,
              CAST(e.label <> c.inlier AS INTEGER) AS outlier
       FROM embeddings e, cells c),
g AS (SELECT * FROM g0 WHERE split = 'test' OR label = inlier),
test AS (SELECT dataset, run, row_id, outlier FROM g WHERE split = 'test'),
xl AS (SELECT dataset, run, row_id, UNNEST(range(len(emb))) AS dim, UNNEST(emb) AS v FROM g),
cnt AS (SELECT dataset, run, dim, v, COUNT(*) AS c FROM xl GROUP BY ALL),
cum AS (SELECT *, SUM(c) OVER (PARTITION BY dataset, run, dim ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c_cum,
               SUM(c) OVER (PARTITION BY dataset, run, dim) AS c_tot FROM cnt),
sk AS (SELECT dataset, run, dim, SUM(c * v * v * v) / SUM(c) - 3 * (SUM(c * v) / SUM(c)) * SUM(c * v * v) / SUM(c) + 2 * POW(SUM(c * v) / SUM(c), 3) AS m3 FROM cnt GROUP BY ALL),
tab AS (SELECT cum.dataset, cum.run, cum.dim, v, -LN(c_cum / c_tot) AS o_l, -LN((c_tot - c_cum + c) / c_tot) AS o_r,
               m3 < 0 AS neg FROM cum JOIN sk USING (dataset, run, dim)),
o AS (SELECT x.dataset, x.run, x.row_id, x.dim, t.o_l, t.o_r, CASE WHEN t.neg THEN t.o_l ELSE t.o_r END AS o_a
      FROM xl x JOIN tab t USING (dataset, run, dim, v)),
full_ AS (SELECT dataset, run, row_id, GREATEST(SUM(o_l), SUM(o_r), SUM(o_a)) AS score FROM o GROUP BY ALL),
ml AS ({fixed_masks_long_sql()}),
mw AS ({fixed_mask_weights_sql(8)}),
per AS (SELECT o.dataset, o.run, o.row_id, ml.subspace_id, GREATEST(SUM(o_l), SUM(o_r), SUM(o_a)) AS s
        FROM o JOIN ml ON o.dim = ml.dim AND ml.u = 1 GROUP BY ALL),
ens AS (SELECT per.dataset, per.run, per.row_id, SUM(per.s * mw.proba) / SUM(mw.proba) AS score
        FROM per JOIN mw USING (subspace_id) GROUP BY ALL),
xa AS (SELECT vec_id AS row_id, UNNEST(range(len(embedding))) AS dim, CAST(UNNEST(embedding) AS DOUBLE) AS v FROM embeddings),
dd AS (SELECT xa.row_id, ml.subspace_id, SQRT(SUM(xa.v * xa.v * (1 - ml.u) * (1 - ml.u))) AS d
       FROM xa JOIN ml ON xa.dim = ml.dim GROUP BY ALL),
dist AS (SELECT row_id, MIN(d) / SQRT({WIDTH_SQL}) AS score FROM dd GROUP BY row_id),
scored AS (
  SELECT '{m['distance'][0]}' AS method, '{m['distance'][1]}' AS base, t.dataset, t.run, t.outlier, ROUND(d.score, 6) AS score
    FROM test t JOIN dist d USING (row_id)
  UNION ALL SELECT '{m['ensemble'][0]}', '{m['ensemble'][1]}', t.dataset, t.run, t.outlier, ROUND(e.score, 6)
    FROM test t JOIN ens e USING (dataset, run, row_id)
  UNION ALL SELECT '{m['ecod'][0]}', '{m['ecod'][1]}', t.dataset, t.run, t.outlier, ROUND(f.score, 6)
    FROM test t JOIN full_ f USING (dataset, run, row_id)
  UNION ALL SELECT '{m['trivial'][0]}', '{m['trivial'][1]}', t.dataset, t.run, t.outlier,
         ROUND({h_sql_seed('t.row_id', 't.run + 100')} / 2147483648.0, 6) FROM test t),
{metrics_sql('scored', ['method', 'base', 'dataset', 'run'])},
results AS (SELECT method, '{SPACE}' AS space, base, dataset, '{EMB_MODEL}' AS emb_model, CAST(run AS INTEGER) AS run,
                   auc, prauc, f1, n_test, n_outlier, pct_outlier, pct_inlier FROM _metrics)"""

"""Result sinks, scans, upsert, result store; streaming arrivals; entry contract."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from maskfold.plans.experiment import results_grid, store_path
from maskfold.sources.fixtures import replicated_samples
from maskfold.sources.results import (incremental_append, pending, scan_result_tree, upsert,
                                      write_results_csv_tree)


def test_result_tree_roundtrip_and_upsert(spark):
    root = tempfile.mkdtemp(prefix="maskfold-test-")
    rows = [("m1", "Embedding", "ECOD", "d1", "e", 0, 0.5), ("m2", "Embedding", "ECOD", "d1", "e", 1, 0.7)]
    df = spark.createDataFrame(rows, "method string, space string, base string, dataset string, emb_model string, run int, auc double")
    write_results_csv_tree(df, os.path.join(root, "tree"))
    back = scan_result_tree(spark, os.path.join(root, "tree"), "method string, space string, base string, auc double")
    got = sorted((r["method"], r["dataset"], r["emb_model"], r["run"], r["auc"]) for r in back.collect())
    assert got == [("m1", "d1", "e", 0, 0.5), ("m2", "d1", "e", 1, 0.7)]
    new = spark.createDataFrame([("m2", "Embedding", "ECOD", "d1", "e", 1, 0.9)], df.schema)
    up = {(r["method"], r["run"]): r["auc"] for r in upsert(df, new, ["method", "dataset", "run"]).collect()}
    assert up == {("m1", 0): 0.5, ("m2", 1): 0.9}
    spec = spark.createDataFrame([("m1", "d1", 0), ("m1", "d1", 1)], "method string, dataset string, run int")
    assert [tuple(r) for r in pending(spec, df, ["method", "dataset", "run"]).collect()] == [("m1", "d1", 1)]


def test_incremental_cache_processes_only_new_rows(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="maskfold-cache-"), "c")
    src = replicated_samples(spark, ["a", "bb", "ccc"], 10)
    calls = []

    def tf(df):
        calls.append(df.count())
        return df.withColumn("n", F.length("x"))
    incremental_append(spark, src.filter("row_id < 4"), path, "row_id", tf)
    out = incremental_append(spark, src, path, "row_id", tf)
    assert calls == [4, 6]
    assert out.count() == 10 and out.select("row_id").distinct().count() == 10


def test_entry_contract(spark):
    import __spark_entry__ as E
    r = E.entry(spark).collect()
    assert len(r) == 1 and 0 <= r[0]["auc"] <= 1
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert all(callable(f) for f in q.values()) and all(isinstance(x, str) for x in s.values())


def test_results_are_written_once_and_classes_come_from_the_table(spark, tmp_path):
    rows = [(i, [float((i * 7 + d * 3) % 11) + 0.1 * d for d in range(64)], 10 + i % 2) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    one = results_grid(spark, str(tmp_path))
    assert {r[0] for r in one.select("dataset").distinct().collect()} == {"class_10", "class_11"}
    files = sorted(one.inputFiles())
    again = results_grid(spark, str(tmp_path))
    assert sorted(again.inputFiles()) == files and again.count() == one.count() == 2 * 3 * 4
    assert store_path(spark, str(tmp_path)) != store_path(spark, str(tmp_path), n_runs=4)


def test_stream_reads_each_file_once(spark, tmp_path):
    from maskfold.streaming.incremental import document_features, incremental_document_features
    folder = f"{tmp_path}/documents.parquet"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    first = [(1, "Some words here", "en", "a", 1), (2, None, "en", "a", 0), (3, "", "en", "a", 0)]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(folder)
    assert incremental_document_features(spark, str(tmp_path)).count() == 3
    assert incremental_document_features(spark, str(tmp_path)).count() == 3  # a restart adds nothing
    spark.createDataFrame([(4, "one more", "en", "b", 1)], schema).write.mode("append").parquet(folder)
    got = incremental_document_features(spark, str(tmp_path))
    want = document_features(spark.read.parquet(folder))
    assert sorted(got.collect(), key=lambda r: r.doc_id) == sorted(want.collect(), key=lambda r: r.doc_id)


def test_a_table_written_anew_starts_a_new_sink(spark, tmp_path):
    from maskfold.streaming.incremental import incremental_document_features
    folder = f"{tmp_path}/documents.parquet"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    write = lambda rows, mode: spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).parquet(folder)
    write([(1, "Some words here", "en", "a", 1), (2, "x", "en", "a", 0)], "overwrite")
    assert incremental_document_features(spark, str(tmp_path)).count() == 2
    write([(3, "other words", "en", "a", 1)], "overwrite")
    assert [r.doc_id for r in incremental_document_features(spark, str(tmp_path)).collect()] == [3]
    write([(4, "more", "en", "a", 1)], "append")
    assert sorted(r.doc_id for r in incremental_document_features(spark, str(tmp_path)).collect()) == [3, 4]


def test_a_file_of_the_same_name_written_anew(spark, tmp_path):
    import time

    import pyarrow as pa
    import pyarrow.parquet as pq
    from maskfold.streaming.incremental import incremental_document_features
    for ids in ([1, 2], [5, 6, 7]):
        pq.write_table(pa.table({"doc_id": pa.array(ids), "text": ["a b"] * len(ids), "lang": ["en"] * len(ids),
                                 "source": ["s"] * len(ids), "n_chars": pa.array([3] * len(ids))}), f"{tmp_path}/documents.parquet")
        assert sorted(r.doc_id for r in incremental_document_features(spark, str(tmp_path)).collect()) == ids
        time.sleep(1.1)


def test_scratch_scope_deletes_its_own_tables_only(spark):
    from maskfold.session import path_kind, scratch_path, scratch_scope, staged
    outside = scratch_path(spark, "outside")
    spark.range(3).write.parquet(outside)
    with scratch_scope(spark):
        inside = staged(spark.range(5), "inside")
        folder = inside.inputFiles()[0].rsplit("/", 1)[0]
        assert inside.count() == 5
        with scratch_scope(spark):
            inner = staged(spark.range(2), "inner").inputFiles()[0].rsplit("/", 1)[0]
        assert path_kind(spark, inner) == "none" and path_kind(spark, folder) == "folder"
    assert path_kind(spark, folder) == "none" and path_kind(spark, outside) == "folder"


def test_rows_by_lists_of_values(spark):
    from maskfold.sources.results import select_rows
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("c", None)], "k string, n int")
    keys = lambda d: sorted(str(r.k) for r in d.collect())
    assert keys(select_rows(df)) == ["None", "a", "b", "c"]
    assert keys(select_rows(df, {"k": ["a", "c"]})) == ["a", "c"]
    assert keys(select_rows(df, None, {"k": ["a"], "n": [2]})) == ["None", "c"]
    assert keys(select_rows(df, {"k": []})) == []


def test_dataset_specs(spark, tmp_path):
    from maskfold.sources.datasets import DatasetSpec, read_dataset, read_datasets, validate_prepared
    spark.createDataFrame([(i, f"t{i}", i % 3, "en" if i < 6 else "de") for i in range(9)], "id long, t string, y int, lang string") \
        .write.parquet(f"{tmp_path}/p")
    spec = lambda name="d", **more: DatasetSpec(name, f"{tmp_path}/p", "t", "id", **({"label_col": "y"} | more))
    assert read_dataset(spark, spec()).count() == 9
    assert {r.label for r in read_dataset(spark, spec(labels=(0, 1, 2), keep=(1, 2))).collect()} == {1, 2}
    assert [r.row_id for r in read_dataset(spark, spec(where=(("lang", "de"),), first=2)).collect()] == [6, 7]
    assert {(r.label, r.split) for r in read_dataset(spark, spec(constant_label=0, split="test")).collect()} == {(0, "test")}
    with pytest.raises(ValueError, match="domain"):
        read_dataset(spark, spec(labels=(0, 1), keep=(7,)))
    with pytest.raises(Exception, match="label domain"):  # label 2 occurs
        read_dataset(spark, spec(labels=(0, 1))).collect()
    with pytest.raises(ValueError):
        read_dataset(spark, spec(label_col=None))
    both = read_datasets(spark, [spec("a", constant_label=1), spec("b", positive="x", label_col="lang")])
    assert both.groupBy("dataset").count().count() == 2
    rows = spark.createDataFrame([("train", 0, [1.0, 2.0]), ("train", 1, [1.0, 2.0])], "split string, label int, x array<double>")
    with pytest.raises(ValueError, match="inlier"):
        validate_prepared(rows, 0)
    with pytest.raises(ValueError, match="NaN"):
        validate_prepared(rows.selectExpr("split", "0 AS label", "array(double('nan')) AS x"), 0)
    with pytest.raises(ValueError, match="ragged"):
        validate_prepared(rows.selectExpr("split", "0 AS label", "slice(x, 1, label + 1) AS x"), 0)


def test_checkpoint_folder_is_needed_on_a_cluster():
    from maskfold.session import checkpoint_dir

    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        checkpoint_dir(Cluster)


def test_a_method_that_fails_is_error_rows(spark, tmp_path):
    """Failing while it is planned or while it runs; the other methods' rows are those of a grid without it."""
    from maskfold.plans.experiment import compute, scorers
    rows = [(i, [float((i * 7 + d * 3) % 11) + 0.1 * d for d in range(8)], i % 2) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")

    def broken(spark, x, g):
        made = scorers(spark, x, g)
        plan = made["ecod"]
        made["ecod"] = lambda: plan().withColumn("score", F.raise_error(F.lit("broken while running")).cast("double"))
        return {k: made[k] for k in ("distance", "ecod", "learned")}

    results, errors = compute(spark, str(tmp_path), 2, broken)
    plain, _ = compute(spark, str(tmp_path), 2, lambda *a: {"distance": scorers(*a)["distance"]})
    assert sorted(map(tuple, results.collect())) == sorted(map(tuple, plain.collect()))
    got = errors.collect()
    assert len(got) == 2 * 2 * 2 and {r.method for r in got} == {"FullSpace + Embedding", "Learned + Embedding"}
    assert any("broken while running" in r.error for r in got) and any(r.error.startswith("NotImplementedError") for r in got)


def test_a_local_session_without_the_setting_gets_one_folder():
    from maskfold.session import checkpoint_dir

    class Context:
        master = "local[2]"
        made = None

        def getCheckpointDir(self):
            return self.made

        def setCheckpointDir(self, d):
            self.made = d

    class Local:
        class conf:
            get = staticmethod(lambda *_: None)

        sparkContext = Context()

    first = checkpoint_dir(Local)
    assert os.path.isdir(first) and checkpoint_dir(Local) == first == Local.sparkContext.made

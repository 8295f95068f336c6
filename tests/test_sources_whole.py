from maskfold.plans.q_sources import q_csv_text_source


def test_csv_source_keeps_every_training_row(spark, tmp_path):
    """Both labels of the training file are there, not only label 1."""
    n = 60
    spark.createDataFrame([(i, f"text {i}\nmore", "en") for i in range(n)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(n)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r["split"], r["label"]): (r["n"], r["line_feeds"]) for r in q_csv_text_source(spark, str(tmp_path)).collect()}
    assert set(got) == {("train", 0), ("train", 1), ("test", 0), ("test", 1)}
    assert sum(k for k, _ in got.values()) == n == sum(f for _, f in got.values())
    assert got["train", 0][0] + got["test", 0][0] == n // 2

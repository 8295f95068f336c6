"""Documents without words keep their row in word_token_masks."""
from maskfold.plans.catalog import load_all


def test_word_token_masks_keeps_documents_without_words(spark, tmp_path):
    rows = [(1, "some words here"), (2, ""), (3, None), (4, ".,:;!? ()"), (5, "  "), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.n_masked_tokens, r.n_words_kept) for r in load_all()["word_token_masks"][0](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None} and got[1][0] == 4
    assert all(got[i] == (0, 0, 0) for i in (2, 3, 4, 5, None))

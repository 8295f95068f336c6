"""The pipeline's stages, each held against a plain computation on its own input."""
import random

import pytest

import corpus_pipeline
from test_dedup import brute_lines
from test_jaccard import brute as brute_classes


@pytest.fixture(scope="module")
def corpus(make_docs, spark, tmp_path_factory):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("bcdfg") + draw.choice("aeiou") for _ in range(draw.randint(1, 3)))
    rows, labels = [], []
    for i in range(300):
        words = [word() for _ in range(draw.choice([0, 4, 40, 120]))]
        bad = i % 4 == 0 and len(words) > 4
        if bad:
            for _ in range(4):
                words.insert(draw.randrange(len(words)), draw.choice(["vile", "nasty"]))
        rows.append((i, " ".join(words) + ("\na line that many documents share" if i % 3 == 0 else ""), f"s{i % 7 % 4}"))
        labels.append((i, int(bad)))
    for i in range(300, 330):
        rows.append((i, rows[i - 299][1].replace(" ", "  ", 1), "s9"))
    rows += [(400, None, None), (None, "a null id with words", "s1")]
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = make_docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, labels


def test_stages(spark, corpus, tmp_path):
    folder, labels = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        after = out.collect()
        if name != "packing":
            assert out.columns == columns
        if name == "toxicity":
            toxic = {i for i, t, _ in before if {"vile", "nasty"} & set((t or "").split())}  # unlabelled copies too
            gone = {i for i, _, _ in before} - {r.doc_id for r in after}
            assert len(gone & toxic) >= 0.95 * len(toxic) and len(gone - toxic) <= 3
        elif name == "line_dedup":
            assert sorted((2**63 - 1 if r.doc_id is None else r.doc_id, r.text) for r in after) == [x[:2] for x in brute_lines(before)]
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "jaccard_join":
            want = sorted(i for i, _, c in brute_classes(before) if i == c)
            assert sorted(2**63 - 1 if r.doc_id is None else r.doc_id for r in after) == want
        elif name == "mixing":
            text = {i: t for i, t, _ in before}
            whole = [r for r in after if r.text == text[r.doc_id]]
            assert len(whole) >= len(after) - 8 and all(text[r.doc_id].split()[: len(r.text.split())] == r.text.split() for r in after)
            uses = {}
            for r in after:
                uses[r.doc_id] = uses.get(r.doc_id, 0) + 1
            assert max(uses.values()) <= 3
        else:
            assert sum(r.length for r in after if r.start == 0) > 0
            assert sum(r.length for r in after) == sum(r.doc_tokens for r in after if r.start == 0)
        docs = out
    assert corpus_pipeline.run(spark, folder).count() > 0

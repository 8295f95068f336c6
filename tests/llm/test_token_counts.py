"""Token counts against the library that the vocabulary file belongs to."""
import random

import pytest
from pyspark.sql import functions as F

from maskfold.llm.token_counts import CACHE_LENGTH, WordCounts, counts_of, merge_count, token_count

P = pytest.importorskip("public_tokenizers")
FILE = P.path("piece_bpe_32k.model")
PARTS = ["ab", " ", "c.", "\n", "é", "1", "  ", "'s", "\t", "▁", "<s>", "</s>", "<unk>", "<0x0A>", "ﬁ", "日本", "😀", "\x00", " " * 8, "the ",
         "http://", "　", "\xa0", "ŉ", "é", "\r\n", "नमस्ते", "x" * 40, "Ünï", "\x1c", " ", "﻿"]
ODD = ["", " ", "▁", "\n", "  a  b  ", "x" * 30_000, " " * 20_000, "ab" * 20_000, "日" * 500, "y" * (CACHE_LENGTH + 1), "word " * 30_000]


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=FILE)
    return lambda t: len(model.encode(t))


def test_counts_are_the_librarys(library):
    draw = random.Random(5)
    texts = ODD + ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 40))) for _ in range(4000)]
    counts = counts_of(FILE)
    assert [counts.text(t) for t in texts] == [library(t) for t in texts]
    assert [counts.text(t) for t in texts[:500]] == [library(t) for t in texts[:500]]  # from the kept words


def test_merges_by_rank_then_from_the_left():
    ranks = {"ab": 1, "bc": 0, "abc": 2, "aa": 3, "aaa": 3, "aaaa": 3}
    assert merge_count("abc", ranks) == 2  # bc, then a and bc
    assert merge_count("abab", {"ab": 0}) == 2
    assert merge_count("aaaa", ranks) == 3  # equal ranks: the grown left pair goes on
    assert merge_count("aaaaa", {"aa": 0}) == 2
    assert merge_count("", ranks) == merge_count("a", ranks) == 0


def test_a_full_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr("maskfold.llm.token_counts.CACHE_WORDS", 3)
    counts = WordCounts(counts_of(FILE).ranks, counts_of(FILE).alphabet)
    for t in ("one two three four five one two", "one six seven eight nine ten one"):
        assert counts.text(t) == library(t) and len(counts) <= 3


def test_query_columns(edge, empty, library):
    rows, docs = edge
    got = docs.select("doc_id", "text", token_count(FILE).alias("n")).collect()
    assert sorted((str(r.doc_id), r.n) for r in got) == sorted((str(i), library(t or "")) for i, t, _ in rows)
    assert empty.select(token_count(FILE)).count() == 0
    assert docs.select(F.col("key"), token_count(FILE, "size").alias("n")).where(F.col("n") != library("z")).count() == 0  # any text column

"""Near copies among rows whose ids are null or repeat."""
import random

import corpus_pipeline
from test_jaccard import LAST, brute, run


def corpus():
    draw = random.Random(11)
    text = lambda: [("".join(draw.choice("abcdefgh") for _ in range(5))) for _ in range(60)]
    near = lambda words: " ".join(words[:-1] + ["other"])
    a, b, c, d, e, f = (text() for _ in range(6))
    stay = [(1, " ".join(a)), (2, " ".join(b)), (2, " ".join(c)), (3, " ".join(d)), (None, " ".join(e)), (None, " ".join(f)),
            (None, ""), (None, None), (None, "few words"), (9, "row that repeats"), (9, "row that repeats")]
    gone = [(None, near(a)), (3, near(b)), (7, " ".join(c)), (7, near(c))]
    some = [(None, near(e)), (None, " ".join(e)), (None, " ".join(f))]  # of each text of null ids only, one row stays
    return stay, gone, some


def test_null_and_repeated_ids(spark, make_docs):
    stay, gone, some = corpus()
    rows = [(i, t, "a") for i, t in stay + gone + some]
    docs = make_docs(rows)
    assert run(docs) == brute(rows)
    out = corpus_pipeline.jaccard(spark, docs, "")
    assert out.columns == docs.columns
    key = lambda x: (LAST if x[0] is None else x[0], x[1] or "", x[1] is None)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=key)
    e, e2 = stay[4][1], some[0][1]
    assert sum(t in (e, e2) for _, t in got) == 1  # near copies without ids: either one
    same = lambda x: (x[0], e) if x[1] == e2 else x
    assert sorted(map(same, got), key=key) == sorted(stay, key=key)

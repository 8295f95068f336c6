"""The Jaccard classes against all pairs."""
import random

import numpy as np
import pyarrow as pa

from maskfold.llm.components import components
from maskfold.llm.jaccard_join import jaccard_classes
from maskfold.llm.words import shingle_sets

LAST = 2**63 - 1


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k=5, a=3, b=4):
    ids = [LAST if i is None else i for i, _, _ in rows]
    sets = [shingles(t, k) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and b * both >= a * (len(sets[x]) + len(sets[y]) - both):
                root[find(x)] = find(y)
    least = {}
    for x in range(len(rows)):
        least[find(x)] = min(least.get(find(x), LAST), ids[x])
    return sorted((ids[x], len(sets[x]), least[find(x)]) for x in range(len(rows)))


def run(docs, **more):
    return sorted((LAST if r.id is None else r.id, r.n, LAST if r.component is None else r.component)
                  for r in jaccard_classes(docs, **more).collect())


def test_edges(edge, empty):
    rows, docs = edge
    assert run(docs) == brute(rows)
    assert run(empty) == []


def test_near_copies_chains_and_passages(make_docs):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 4)))
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(60):  # near copies of one text: some link with it, some only with each other, some with none
        copy = list(base)
        for _ in range(draw.choice([0, 1, 2, 4, 6])):
            copy[draw.randrange(len(copy))] = word()
        rows.append((1000 - i, " ".join(copy), "a"))
    chain = [word() for _ in range(100)]
    for i in range(15):  # each is near the next, the ends aren't near each other
        rows.append((i, " ".join(chain[i * 4:i * 4 + 40]), "a"))
    for i in range(30):  # a long common passage with own words
        own = [word() for _ in range(draw.choice([2, 10, 14, 18, 40]))]
        rows.append((2000 + i, " ".join(passage + own), "b"))
    for i in range(40):
        rows.append((3000 + i, " ".join(word() for _ in range(draw.randint(1, 50))), "b"))
    docs = make_docs(rows)
    assert run(docs) == brute(rows)
    assert run(docs, k=2, threshold=(1, 2)) == brute(rows, 2, 1, 2)


def test_word_hashes_follow_words():
    texts = ["", "  ", "A b", "a B", "one two three four five", "ONE two three four fIve", "x\x0by z", "a" * 200000 + " b", "é É e"]
    sets = shingle_sets(pa.array(texts, pa.large_string()))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert (sets[2] == sets[3]).all() and (sets[4] == sets[5]).all() and len(np.unique(np.concatenate(sets))) == 5


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (5, 4), (9, 9), (7, 8), (8, 10), (10, 11), (11, 12), (12, 6), (4, 5), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, **{i: 6 for i in (6, 7, 8, 10, 11, 12)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_small_chunks_many_ranges_and_a_hot_shingle(make_docs, monkeypatch):
    """A shingle in a third of all texts goes to its range once a chunk, with the number of its holders."""
    import maskfold.llm.jaccard_join as J
    monkeypatch.setattr(J, "LEAST_TOKENS", 200)
    draw = random.Random(8)
    hot = "this very line stands everywhere"
    rows = []
    for i in range(120):
        own = " ".join(f"w{draw.randrange(400)}" for _ in range(draw.choice([6, 20, 60])))
        rows.append((i, f"{hot} {own}" if i % 3 == 0 else own, "a"))
        if i % 7 == 0:
            rows += [(1000 + i, rows[-1][1] + " end", "b"), (2000 + i, rows[-1][1].upper(), "b")]
    docs = make_docs(rows)
    assert run(docs) == brute(rows)

    hash_ = shingle_sets(pa.array([hot], pa.large_string()))[0][0]
    texts = docs.selectExpr("doc_id AS node", "text").repartition(2)
    dealt = J.deal(texts, 5, 40, 300).collect()
    where = ((int(hash_) >> 32) * 40) >> 32
    entries, holders, chunks = 0, 0, set()
    for r in dealt:
        chunks.add(r.chunk)
        if r.to == where and r.nodes is None:
            low = int(hash_) & int(J.LOW)
            one, many, counts = J.numbers([r.tokens], 6), J.numbers([r.many], 6), J.numbers([r.counts], 4)
            entries += int((one == low).sum() + (many == low).sum())
            holders += int((one == low).sum() + counts[many == low].sum())
    assert holders == sum(1 for _, t, _ in rows if (t or "").lower().startswith(hot)) and 1 < entries <= len(chunks) < holders

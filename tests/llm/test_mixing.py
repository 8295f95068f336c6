"""Targets, apportionment and takes against direct computation."""
import random
from fractions import Fraction

from maskfold.llm.mixing import apportion, mix, targets


def brute_targets(sizes, weights, cap=3):
    total, over = sum(sizes.values()), set()
    while True:
        left = Fraction(total - sum(cap * sizes[s] for s in over))
        weight = sum(weights[s] for s in sizes if s not in over)
        level = left / weight if weight else 0
        more = {s for s in sizes if s not in over and cap * sizes[s] < level * weights[s]}
        if not more:
            return {s: float(cap * sizes[s] if s in over else level * weights[s]) for s in sizes}
        over |= more


def test_targets_cap_and_reshare(spark):
    rows = [("a", 10, 1), ("b", 5, 2), ("c", 1000, 3), ("d", 200, 1), ("e", 0, 2), (None, 40, 3)]
    got = {r.source: r.target for r in targets(spark.createDataFrame(rows, "source string, source_size long, weight long"), 1.0, 3).collect()}
    want = brute_targets({s: n for s, n, _ in rows}, {s: w for s, _, w in rows})
    assert all(abs(got[s] - want[s]) < 1e-9 * (1 + want[s]) for s in want)


def test_apportion_is_sainte_lague(spark):
    draw = random.Random(5)
    for votes, seats in (([53, 24, 23], 7), ([1] * 5, 3), ([1000, 1, 1, 1], 50), ([draw.random() ** 3 for _ in range(40)], 333), ([7, 0, 0], 4)):
        quotas = [0] * len(votes)
        for _ in range(seats):
            best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * quotas[i] + 1), -i))
            quotas[best] += 1
        rows = [(f"s{i:02}", 0, float(v)) for i, v in enumerate(votes)]
        got = {r.source: r.quota for r in apportion(spark.createDataFrame(rows, "source string, shard long, target double"), seats).collect()}
        assert [got[f"s{i:02}"] for i in range(len(votes))] == quotas


def test_mix(edge, empty, make_docs):
    rows, docs = edge
    got = mix(docs).collect()
    by_id = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r["size"]) for r in got), key=by_id) == sorted(((i, len((t or "").encode().split())) for i, t, _ in rows), key=by_id)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert mix(empty).count() == 0
    assert [r.taken for r in mix(make_docs([(1, "", "a"), (2, None, None)])).collect()] == [0, 0]

    draw = random.Random(1)
    rows = [(i, "w " * draw.choice([1, 5, 30, 200]), draw.choice("aaaabcd")) for i in range(400)]
    docs = make_docs(rows)
    one = {r.doc_id: r.asDict() for r in mix(docs, shard_words=3000, shard_rows=40).collect()}
    again = {r.doc_id: r.asDict() for r in mix(docs.repartition(7), shard_words=3000, shard_rows=40).collect()}
    assert one == again
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute_targets(sizes, {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))})
    for s in sizes:
        mine = [r for r in one.values() if r["source"] == s]
        assert abs(mine[0]["target"] - want[s]) < 1e-6 and abs(sum(r["taken"] for r in mine) - want[s]) <= 0.01 * want[s] + 30
    assert all(r["taken"] <= 3 * r["size"] for r in one.values())


def test_rows_without_ids_and_repeated_rows_are_many_shards(make_docs):
    """A third of the rows have no id, a third are one row again and again; no shard holds them all, and reruns agree."""
    rows = [(i, f"own text {i} " * 10, "a") for i in range(100)] + [(None, f"text {i} " * 10, "a") for i in range(100)] \
        + [(7, "the same row " * 10, "a")] * 100 + [(500, "other " * 40, "b")] * 3
    docs = make_docs(rows)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r["size"], r.taken)
    got = sorted(mix(docs, shard_words=500, shard_rows=20).collect(), key=key)
    again = sorted(mix(make_docs(rows[::-1]).repartition(5), shard_words=500, shard_rows=20).collect(), key=key)
    assert len(got) == len(rows) and list(map(key, got)) == list(map(key, again))
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    for source, some in (("a", [r for r in got if r.source == "a"]), ("b", [r for r in got if r.source == "b"])):
        assert abs(sum(r.taken for r in some) - some[0].target) <= 0.02 * some[0].target + 60
    assert sum(r.doc_id is None for r in got) == 100 and sum(r.doc_id == 7 for r in got) == 101

"""Toxicity, page content and neighbours: brute force, held-out accuracy, edge cases."""
import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from maskfold.llm.hnsw import build_index, nearest
from maskfold.llm.html_content import Model, Page, features, main_text, train
from maskfold.llm.labelled_pages import PAGES
from maskfold.llm.toxicity import BITS, Model as Model0, Rates, fit_toxicity, ftrl, toxicity_score


def test_toxicity_learns_and_keeps_rows(make_docs, spark, empty):
    draw = random.Random(4)
    words = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        text = [draw.choice(words) for _ in range(draw.choice([5, 60, 300]))]
        bad = draw.random() < 0.3
        if bad:
            for _ in range(3):
                text.insert(draw.randrange(len(text)), draw.choice(["vile", "awful", "nasty"]))
        rows.append((i, " ".join(text) if i % 50 else None, "a"))
        labels.append((i, 1 if bad and i % 50 else 0, None))
    labels += [(10**6, 1, 5), (None, 1, 5), (3, None, 5)]
    docs, labels = make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int, label int")
    model = fit_toxicity(docs, labels.where(F.col("doc_id") % 5 != 0))
    assert len(model.slots) < 5000
    got = docs.withColumn("score", toxicity_score(docs, model)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {i: t for i, t, _ in labels.collect()}
    held = [(r.score >= 0.5) == (truth[r.doc_id] == 1) for r in got if r.doc_id % 5 == 0]
    assert sum(held) / len(held) > 0.95
    # the same text has the same score wherever it stands, and a long text counts whole
    more = make_docs([(1, "vile " + "word1 " * 50000, None), (None, "word1 " * 50000 + "vile", None), (2, "", "b"), (3, None, "b")])
    scores = [r.score for r in more.withColumn("score", toxicity_score(more, model)).orderBy(F.col("text").desc_nulls_last()).collect()]
    assert scores[0] > 0.5 and scores[1] > 0.5 and scores[2] == scores[3] < 0.5
    again = fit_toxicity(docs.repartition(5), labels.where(F.col("doc_id") % 5 != 0).repartition(2))
    assert np.array_equal(model.slots, again.slots) and np.allclose(model.weights, again.weights)
    none = fit_toxicity(docs, labels.where("false"))
    assert max(r[0] for r in docs.select(toxicity_score(docs, none)).collect()) < 1e-9
    assert empty.select(toxicity_score(empty, model)).count() == 0


def test_ftrl_equals_a_plain_loop():
    """FTRL-proximal, coordinate by coordinate in dictionaries."""
    rates, draw = Rates(l1=0.4, epochs=3), np.random.default_rng(3)
    rows = [np.unique(draw.integers(0, 40, draw.integers(0, 12))).astype(np.int32) for _ in range(60)]
    labels = [int(7 in r) for r in rows]
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= rates.l1:
            return 0.0
        return -(z[i] - math.copysign(rates.l1, z[i])) / ((rates.beta + math.sqrt(n[i])) / rates.alpha + rates.l2)

    order = np.random.default_rng(5)
    for _ in range(rates.epochs):
        for k in order.permutation(len(rows)):
            seen = [*rows[k].tolist(), 1 << BITS]
            w = {i: weight(i) for i in seen}
            p = 1 / (1 + math.exp(-sum(w.values())))
            g = (p - labels[k]) * (rates.toxic_weight if labels[k] else 1.0)
            for i in seen:
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / rates.alpha * w[i]
                n[i] = before + g * g
    want = {i: weight(i) for i in z if weight(i)}
    slots, weights = ftrl(rows, labels, rates, 5)
    assert slots.tolist() == sorted(want) and np.allclose(weights, [want[i] for i in sorted(want)])
    assert 7 in want and 0 < len(want) < 41  # the L1 term leaves most slots at zero


def test_rows_that_repeat_an_id_stay_within_the_bound(make_docs, spark):
    rows = [(1, f"nasty text number {i}", "a") for i in range(300)] + [(2, f"plain words number {i % 250}", "a") for i in range(400)] + [(3, "vile one", "a")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    docs = make_docs(rows)
    model, again = (fit_toxicity(d, labels, max_rows=50) for d in (docs, docs.repartition(7)))
    assert np.array_equal(model.slots, again.slots) and np.allclose(model.weights, again.weights)
    scores = {r.text: r.s for r in docs.withColumn("s", toxicity_score(docs, model)).collect()}
    assert scores["plain words number 3"] < 0.5 and scores["nasty text number 7"] >= 0.5
    half = make_docs([(1, "", "a")])
    assert half.select(toxicity_score(half, Model0(np.zeros(0, np.int64), np.zeros(0), 0.0))).first()[0] == 0.5  # a tie


def test_marginals_equal_enumeration():
    page = Page("<body><nav><a href=x>Home</a></nav><div class=ad>Buy</div><article><p>Text</p></article></body>")
    nodes, draw = page.nodes, random.Random(0)
    model = Model({x: draw.uniform(-2, 2) for n in nodes for x in features(n)},
                  {(k, p, c): draw.uniform(-2, 2) for k in ("text", "element") for p in (0, 1) for c in (0, 1)})
    content, _ = model.marginals(nodes)
    total, mass = 0.0, [0.0] * len(nodes)
    for y in itertools.product((0, 1), repeat=len(nodes)):
        score = sum(y[i] * sum(model.unary[x] for x in features(n)) for i, n in enumerate(nodes))
        score += sum(model.edge[(features(n)[0], y[n.parent], y[i])] for i, n in enumerate(nodes) if i)
        w = math.exp(score)
        total += w
        for i, v in enumerate(y):
            mass[i] += v * w
    assert np.allclose(content, [m / total for m in mass])


CASES = [
    ("<article><h1>T &amp; U</h1><p><b>One<br>two<p>Three&nbsp; four</p></article>", "T & U\nOne two\nThree four"),
    ("<body><nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav><article><p>Body</p><aside><p>Side</p></aside><p>End</p></article>"
     "<footer>&copy; x</footer>", "Body\nEnd"),
    ("<body><header><h1>Site</h1></header><div class='cookie-banner'>We use cookies</div><main><h1>T</h1><p>Body</p></main>"
     "<section id=comments><h3>2 comments</h3><p>Nice</p></section></body>", "T\nBody"),
    ("<body><article><p>A</p><script>var x='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><form><p>Mail</p><input></form><p>B &lt; C</p></article>"
     "<div class=advert><p>Buy</p></div>", "A\nB < C"),
    ("", ""), (None, ""), ("plain words", "plain words"), ("<p>un<b>closed <i>tags", "unclosed tags"), ("<<<>>> < a <", None),
]


def test_main_text(spark):
    model = train(PAGES)
    for source, want in CASES:
        assert want is None or model.text(source) == want, source
    rows = [(i, s, f"u{i}", "x") for i, (s, _) in enumerate(CASES)]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    got = {r.page_id: r.content for r in pages.withColumn("content", main_text(pages)).collect()}
    assert all(want is None or got[i] == want for i, (_, want) in enumerate(CASES))
    assert pages.where("false").select(main_text(pages)).count() == 0


def test_training_pages_are_fitted():
    model = train(PAGES)
    wrong = total = 0
    for source in PAGES:
        page = Page(source)
        content, _ = model.marginals(page.nodes)
        for i, _ in page.blocks():
            total += 1
            wrong += (content[i] >= 0.5) != page.nodes[i].label
    assert wrong <= 0.02 * total


def test_nearest(spark):
    draw = np.random.default_rng(1)
    v = draw.normal(size=(900, 12))
    v[100:400] = v[7]  # a hot vector
    rows = [(i, [float(x) for x in v[i]], "q", 1) for i in range(900)]
    rows += [(1000, None, "q", 1), (1001, [0.0] * 12, "q", 1), (1002, [float("nan")] + [1.0] * 11, "q", 1), (1003, [None] + [1.0] * 11, "q", 1),
             (1004, [float("inf")] + [1.0] * 11, "q", 1), (1005, [1.0], "q", 1), (None, [1.0] * 12, "q", 1), (5, [float(x) for x in v[5]], "q", 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, shard int")
    wanted = table.where("vec_id % 20 = 0 or vec_id = 7")
    got = {}
    for r in nearest(table, wanted, shard_rows=200).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    hit = total = 0
    for q in [i for i in range(900) if i % 20 == 0] + [7]:
        distance = np.sqrt(((v - v[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(900), distance)) if i != q][:10]
        found = sorted(got.pop(q))
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert np.allclose([s for _, _, s in found], [distance[i] for _, i, _ in found])
        hit += len({i for _, i, _ in found} & set(want))
        total += 10
        if q in (7, 100):
            assert [i for _, i, _ in found] == want
    assert not got and hit / total >= 0.9
    assert build_index(table.where("vec_id is null")).count() == 0 and nearest(table.where("false"), wanted).count() == 0
    few = nearest(table.where("vec_id < 3"), table.where("vec_id = 0")).collect()
    assert sorted(r.id for r in few) == [1, 2]

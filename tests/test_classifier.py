"""The TF-IDF classifier: features against a plain computation, and a problem that it must solve."""
import math

from pyspark.sql import functions as F

from maskfold.operators.metrics import classification_report
from maskfold.plans.q_sources import fit_tfidf_classifier

GOOD, BAD = ["bright sunny morning garden", "sunny garden flowers bloom", "bright flowers morning walk"], \
    ["dark stormy night engine", "stormy engine smoke broken", "dark smoke night crash"]


def rows(spark):
    data = [(t + f" extra{i % 5}", 1) for i in range(10) for t in GOOD] + [(t + f" extra{i % 5}", 0) for i in range(10) for t in BAD]
    return spark.createDataFrame(data + [("", 1), ("the and of", 0)], "text string, label int").repartition(3)


def test_features_and_predictions(spark):
    train = rows(spark)
    model = fit_tfidf_classifier(train)
    out = model.transform(train)
    docs = [[w for w in r.text.split() if len(w) > 1 and w not in ("the", "and", "of")] for r in train.collect()]
    terms = [ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])] for ws in docs]
    df = {}
    for ts in terms:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    n = len(docs)
    vocabulary = model.stages[4].vocabulary
    assert sorted(vocabulary) == sorted(df)
    for r in out.select("text", "features").collect():
        ws = [w for w in r.text.split() if len(w) > 1 and w not in ("the", "and", "of")]
        ts = ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]
        want = {t: ts.count(t) * math.log((n + 1) / (df[t] + 1)) for t in set(ts)}
        norm = math.sqrt(sum(x * x for x in want.values())) or 1.0
        got = {vocabulary[i]: x for i, x in zip(r.features.indices.tolist(), r.features.values.tolist())} if len(ts) else {}
        assert set(got) <= set(want) and all(abs(got.get(t, 0.0) - x / norm) < 1e-9 for t, x in want.items())
    held = spark.createDataFrame([("sunny flowers bloom", 1), ("stormy night crash", 0), ("bright garden", 1), ("broken engine", 0)], "text string, label int")
    report = {r["class"]: r for r in classification_report(model.transform(held).select("label", F.col("prediction").cast("int").alias("pred"))).collect()}
    assert report["accuracy"]["f1"] == 1.0 and report["1"]["support"] == 2

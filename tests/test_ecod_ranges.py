"""ECOD by ranges: hot values, few and many ranges, fitted tables and later rows; widths other than 64."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from maskfold.operators.ecod import TERMS, ecod_columns, fit_ecdf, fitted_terms, with_terms
from maskfold.sources.models import ModelStore


def terms(fit, v):
    """(o_l, o_r) of the values v among the fitted ones."""
    le = np.array([(fit <= x).sum() for x in v])
    lt = np.array([(fit < x).sum() for x in v])
    return -np.log(np.maximum(le, 1) / len(fit)), -np.log((len(fit) - np.minimum(lt, len(fit) - 1)) / len(fit))


def data(kind, n=400):
    draw = np.random.default_rng(len(kind))
    return {"flat": draw.normal(size=n), "hot": np.where(draw.random(n) < 0.4, 1.5, draw.normal(size=n)),
            "few": draw.integers(0, 4, n).astype(float), "one": np.full(n, 2.0), "zeros": draw.choice([-0.0, 0.0, 1.0], n)}[kind]


@pytest.mark.parametrize("kind", ["flat", "hot", "few", "one", "zeros"])
@pytest.mark.parametrize("ranges", [2, 16, 200])
def test_terms(spark, kind, ranges):
    v = data(kind)
    long = spark.createDataFrame([(i, 0, float(x)) for i, x in enumerate(v)] + [(1000, 0, None)], "row_id long, dim int, v double").repartition(3)
    got = {r.row_id: r for r in with_terms(long, ["dim"], ranges).collect()}
    left, right = terms(v, v)
    assert len(got) == len(v) + 1 and tuple(got[1000][c] for c in TERMS) == (0.0, 0.0, 0.0)
    assert np.allclose([got[i].o_l for i in range(len(v))], left, atol=1e-12)
    assert np.allclose([got[i].o_r for i in range(len(v))], right, atol=1e-12)


@pytest.mark.parametrize("kind", ["flat", "hot", "few"])
def test_fitted_tables_rank_later_rows(spark, tmp_path, kind):
    fit = np.stack([data(kind), data("flat") * 3], 1)
    new = np.concatenate([fit[:50], np.random.default_rng(1).normal(size=(60, 2)) * 4, [[-99, 99], [99, -99], [1.5, 0]]])
    frame = lambda x: spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "row_id long, x array<double>").repartition(2)
    store = ModelStore(spark, str(tmp_path / "model"))
    ranges, values = fit_ecdf(frame(fit))
    assert store.save({"ranges": ranges, "values": values}, note="one") == 1
    parameters, tables = ModelStore(spark, str(tmp_path / "model")).load()
    assert parameters == {"note": "one"}
    got = fitted_terms(frame(new), tables["ranges"], tables["values"]).orderBy("dim", "row_id").collect()
    for d in (0, 1):
        left, right = terms(fit[:, d], new[:, d])
        own = [r for r in got if r.dim == d]
        assert [r.row_id for r in own] == list(range(len(new)))
        assert np.allclose([r.o_l for r in own], left, atol=1e-12) and np.allclose([r.o_r for r in own], right, atol=1e-12)
        skew = ((fit[:, d] - fit[:, d].mean()) ** 3).mean()
        assert np.allclose([r.o_a for r in own], left if skew < 0 else right, atol=1e-12)


def test_columns_keep_rows_that_repeat(spark):
    rows = [(1.0, 2.0, "a")] * 3 + [(5.0, -1.0, "b"), (0.5, 0.0, None)]
    got = ecod_columns(spark.createDataFrame(rows, "p double, q double, name string").repartition(2), ["p", "q"], keep=["name"]).collect()
    assert sorted((r.p, r.q, str(r.name)) for r in got) == sorted((p, q, str(n)) for p, q, n in rows)


def test_versions(spark, tmp_path):
    store = ModelStore(spark, str(tmp_path / "m"))
    with pytest.raises(FileNotFoundError):
        store.load()
    one, two = spark.range(3), spark.range(5)
    assert store.save({"t": one}, a=1) == 1 and store.save({"t": two}, a=2) == 2
    spark.range(9).write.parquet(str(tmp_path / "m" / "v000003-half" / "t"))  # a crash before the parameters
    assert sorted(store.versions()) == [1, 2]
    assert store.load()[0] == {"a": 2} and store.load(1)[1]["t"].count() == 3
    assert store.save({"t": one}) == 3


def test_every_component_counts_whatever_the_width(spark, tmp_path):
    from maskfold.plans.catalog import load_all
    draw = np.random.default_rng(2)
    x = draw.normal(size=(60, 80))
    x[:, :64] = 0  # all the information is beyond the 64th component
    rows = [(i, [float(c) for c in r], i % 2) for i, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    q = load_all()
    for name in ("subspace_distance_scores", "subspace_ecod_ensemble", "subspace_ensemble_final_metrics", "feature_bagging_ecod_metrics",
                 "mmd_rbf_masks", "fitted_model_scores"):
        got = q[name][0](spark, str(tmp_path)).toPandas()
        assert len(got) and not got.isna().any().any()
    d = q["subspace_distance_scores"][0](spark, str(tmp_path)).toPandas()
    assert (d.score > 0.05).all()
    assert q["average_subspace"][0](spark, str(tmp_path)).agg(F.max("dim")).first()[0] == 79


@pytest.mark.parametrize("kinds", [("few", "one"), ("few", "flat"), ("flat", "hot", "few"), ("hot",)])
def test_columns_with_and_without_spread_values(spark, kinds):
    """No column, one and several columns with values outside the hot ones; missing values add nothing."""
    x = np.stack([data(k) for k in kinds], 1)
    x[5, 0] = np.nan
    rows = [(i, *[None if i == 7 and j == 0 else float(c) for j, c in enumerate(r)]) for i, r in enumerate(x)]
    names = [f"c{j}" for j in range(len(kinds))]
    df = spark.createDataFrame(rows, "row_id long, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {r.row_id: r.score for r in ecod_columns(df, names, keep=["row_id"], nulls="neutral").collect()}
    sums = np.zeros((len(x), 3))
    for j in range(len(kinds)):
        known = np.array([i not in ((5, 7) if j == 0 else ()) for i in range(len(x))])
        v = x[known, j]
        left, right = terms(v, v)
        m3 = (v ** 3).mean() - 3 * v.mean() * (v ** 2).mean() + 2 * v.mean() ** 3
        sums[known] += np.stack([left, right, left if m3 < 0 else right], 1)
    assert len(got) == len(x) and np.allclose([got[i] for i in range(len(x))], sums.max(1), atol=1e-9)

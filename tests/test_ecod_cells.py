import numpy as np
import pytest
from pyspark.sql import functions as F

from maskfold.operators import ecod
from maskfold.operators.ecod import ecod_cells, ecod_long, ecod_scores, ecod_subspace_scores, ecod_view_scores

SCHEMA = "row_id long, x array<double>, label int, t0 boolean, t1 boolean"


def _table(spark, n=400):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(n, 4)).round(2)
    x[:, 1] = np.where(draw.random(n) < 0.7, 0.0, x[:, 1])  # a hot value
    rows = [(i, x[i].tolist(), int(draw.integers(3)), bool(draw.random() < 0.3), bool(draw.random() < 0.3)) for i in range(n)]
    rows += [rows[5], rows[6], (None, [1.0] * 4, 0, False, False), (n, None, 1, True, True)]  # repeated rows, no id, no vector
    return spark.createDataFrame(rows, SCHEMA)


def _cells(df, id_col="row_id"):
    """Families are two tests, members three labels: a population is all of the test and the label's other rows."""
    bits = np.array([[False, False], [True, False], [False, True], [True, True]])
    shown = np.tile(bits, (3, 1))
    own = np.repeat(np.eye(3, dtype=bool), 4, axis=0)
    pattern = F.col("label") * 4 + F.col("t0").cast("int") + 2 * F.col("t1").cast("int")
    return ecod_cells(df, pattern, shown[:, :, None] | own[:, None, :], shown, id_col)


@pytest.mark.parametrize("rows", [30, 20_000])
def test_cells_agree_with_one_ecod_per_population(spark, monkeypatch, rows):
    monkeypatch.setattr(ecod, "RANGE_ROWS", rows)
    df = _table(spark)
    wide = _cells(df)
    views = [(7, [1, 1, 1, 1]), (3, [1, 0, 1, 0]), (9, [0, 0, 0, 0])]
    got = {(r["family"], r["member"], r["subspace_id"], r["row_id"]): r["score"]
           for r in ecod_view_scores(wide, views, ["row_id"], ["family", "member"]).collect()}
    want = {}
    masks = spark.createDataFrame([(7, d) for d in range(4)] + [(3, 0), (3, 2)], "subspace_id int, dim int")
    for f in range(2):
        for c in range(3):
            part = df.where(F.col(f"t{f}") | (F.col("label") == c))
            shown = {r[0] for r in part.where(f"t{f}").select("row_id").collect()}
            for r in ecod_subspace_scores(ecod_long(part), masks).collect():
                if r["row_id"] in shown:
                    want[f, c, r["subspace_id"], r["row_id"]] = r["score"]
    assert got.keys() == want.keys() and len(got) > 300
    assert max(abs(got[k] - want[k]) for k in got) < 1e-9


def test_cells_move_each_value_once(spark):
    """The values of a row are not repeated for every population: six populations, one rank."""
    df = _table(spark).where("x is not null")
    plan = _cells(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


def test_cells_stop_at_a_missing_component(spark):
    df = spark.createDataFrame([(1, [1.0, None], 0, True, False), (2, [1.0, 2.0], 0, True, False)], SCHEMA)
    with pytest.raises(Exception, match="a component is missing"):
        _cells(df).collect()


def test_one_population_is_plain_ecod(spark):
    df = _table(spark).where("x is not null and row_id is not null")
    wide = ecod_cells(df, F.lit(0), np.ones((1, 1, 1), bool), np.ones((1, 1), bool))
    got = {r["row_id"]: r["score"] for r in ecod_view_scores(wide, [(0, [1] * 4)]).collect()}
    want = {r["row_id"]: r["score"] for r in ecod_scores(df).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-9

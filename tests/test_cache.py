"""The incremental cache: crashes, arrivals, early stop."""
import pytest
from pyspark.sql import functions as F

from maskfold.sources.cache import RowCache


@pytest.fixture
def make(spark, tmp_path):
    def build(**more):
        return RowCache(spark, str(tmp_path / "cache"), "row_id",
                        lambda df: df.select("row_id", F.length("text").alias("n"), "label"), F.col("label") == 1,
                        **({"batch_rows": 10} | more))
    return build


def source(spark, ids):
    return spark.createDataFrame([(i, "x" * (i % 7), int(i % 3 == 0)) for i in ids], "row_id long, text string, label int").repartition(3)


def ids(df):
    return sorted(r.row_id for r in df.collect())


def test_all_rows_then_arrivals(spark, make):
    assert ids(make().fill(source(spark, range(45)))) == list(range(45))
    more = [*range(60), 200, 1000]  # 45..49 belong to a batch that is finished already
    got = make().fill(source(spark, more))
    assert ids(got) == more and {r.row_id: r.n for r in got.collect()} == {i: i % 7 for i in more}
    before = len(make().ledger())
    assert ids(make().fill(source(spark, more))) == more and len(make().ledger()) == before  # nothing to do


def test_stops_once_enough_inliers_are_there(spark, make):
    rows = source(spark, range(1000))
    assert ids(make().fill(rows, wanted=9)) == [i for i in range(1000) if i % 3 == 0][:9]
    stored = make().stored().count()
    assert stored < 100  # waves of 1, 2, 4 batches at most
    assert ids(make().fill(rows, wanted=5)) == [0, 3, 6, 9, 12] and make().stored().count() == stored
    assert ids(make().fill(rows, wanted=50)) == [3 * i for i in range(50)]  # resumes
    assert ids(make().fill(rows, wanted=10_000)) == [i for i in range(1000) if i % 3 == 0]
    assert make().stored().count() == 1000


@pytest.mark.parametrize("where", ["transform", "commit"])
def test_a_crash_neither_loses_nor_doubles_rows(spark, make, where):
    rows = source(spark, range(300))
    cache = make()
    calls = {"n": 0}

    def failing(real):
        def run(*args):
            calls["n"] += 1
            if calls["n"] == 3:
                if where == "transform":
                    return real(*args).withColumn("n", F.raise_error(F.lit("lost")).cast("int"))
                raise RuntimeError("lost")  # rows are written, the ledger doesn't know them
            return real(*args)
        return run

    setattr(cache, where, failing(getattr(cache, where)))
    with pytest.raises(Exception, match="lost"):
        cache.fill(rows, wanted=1000)
    assert ids(make().stored()) == list(range(30))  # waves of 1 and 2 batches are there
    assert ids(make().fill(rows, wanted=1000)) == [i for i in range(300) if i % 3 == 0]
    assert ids(make().stored()) == list(range(300))


def test_empty_source(spark, make):
    assert make().fill(source(spark, [1]).limit(0)).count() == 0
    assert make().stored() is None

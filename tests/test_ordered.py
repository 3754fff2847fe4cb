"""Block-wise operators against plain windows, with blocks far smaller than a key."""

import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.ordered import block_of, dense_number, first_rows, neighbours, running


@pytest.fixture(scope="module")
def data(spark):
    # One key holds most rows.
    rows = [("hot" if i % 10 else f"k{i % 7}", i, (i * 7919) % 13, None if i % 3 else f"v{i}") for i in range(500)]
    return spark.createDataFrame(rows, "k string, pos long, n long, s string").repartition(5)


def same(a, b, keys):
    def tidy(df):
        p = df.toPandas()
        return p.sort_values(keys).reset_index(drop=True)[sorted(p.columns)]
    pd.testing.assert_frame_equal(tidy(a), tidy(b), check_dtype=False)


@pytest.mark.parametrize("size", [1, 3, 64, 10_000])
def test_running(data, size):
    w = W.partitionBy("k").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    want = data.withColumns({"total": F.sum("n").over(w), "seen": F.last("s", ignorenulls=True).over(w),
                             "top": F.max("n").over(w)})
    got = running(data, ["k"], "pos", sums={"total": F.col("n")}, lasts={"seen": F.col("s")},
                  maxes={"top": F.col("n")}, size=size)
    same(got, want, ["k", "pos"])


@pytest.mark.parametrize("size", [1, 2, 7, 10_000])
def test_dense_number_and_neighbours(data, size):
    w = W.partitionBy("k").orderBy("pos")
    want = data.withColumns({"no": F.row_number().over(w) - 1, "before": F.lag("n").over(w), "after": F.lead("n").over(w)})
    got = dense_number(data, ["k"], block_of("pos", size), [F.col("pos")], "no")
    got = neighbours(got, ["k"], "no", {"before": F.col("n")}, {"after": F.col("n")}, size=size)
    same(got, want, ["k", "pos"])


def test_first_rows_limits_before_the_shuffle(data):
    out = first_rows(data, ["k"], [F.col("pos").desc()], 3)
    assert out.groupBy("k").count().agg(F.max("count")).first()[0] == 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_null_keys_keep_their_rows(spark):
    from pyspark.sql import functions as F

    from quire.operators.memory import trailing_hour_limit
    from quire.operators.ordered import dense_number, running

    rows = spark.createDataFrame([(None, 0, 1), (None, 1, 1), (None, 2, 1), ("a", 0, 1)], "k string, pos long, v long")
    got = dense_number(rows, ["k"], F.floor(F.col("pos") / 2).cast("long"), [F.col("pos")], "n", start=1)
    assert sorted((r.k or "", r.n) for r in got.collect()) == [("", 1), ("", 2), ("", 3), ("a", 1)]
    got = running(rows, ["k"], "pos", sums={"s": F.col("v")}, size=2)
    assert sorted((r.k or "", r.s) for r in got.collect()) == [("", 1), ("", 2), ("", 3), ("a", 1)]
    events = spark.sql("select id as event_id, if(id = 0, 7, null) as user_id, timestamp'2024-01-01 10:00:00' as ts from range(3)")
    assert sorted(r.recent for r in trailing_hour_limit(events).collect()) == [0, 1, 1]


def test_rows_move_once(spark):
    """What earlier blocks add comes as a row of the block, so no join moves the rows again."""
    df = spark.createDataFrame([("a", i, "text") for i in range(50)], "k string, pos long, text string")
    for out in (running(df, ["k"], "pos", sums={"s": F.lit(1)}, size=7), dense_number(df, ["k"], block_of("pos", 7), [F.col("pos")], "n")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan
        assert out.count() == 50

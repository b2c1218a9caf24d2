"""Range-wise windows against brute force: many ranges, short ranges, one very long group."""

import datetime as dt
import decimal
import math
import random

import pandas as pd
import pytest
from plans import plan_of
from pyspark.sql import functions as F

from weft.operators.ordered import OrderedRows, trailing_sum

BUCKETS = [1, 4, 16, 64]


def frame(spark, n=300, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        # one key holds a third of the rows, one time a third of them
        k = 0 if r.random() < 0.34 else None if r.random() < 0.05 else r.randrange(1, 40)
        t = 500 if r.random() < 0.34 else r.randrange(1000)
        x = None if r.random() < 0.1 else float(r.randrange(100))
        rows.append((i, k, t, x))
    df = spark.createDataFrame(rows, "id long, k long, t long, x double").repartition(8)
    pdf = pd.DataFrame(rows, columns=["id", "k", "t", "x"])
    pdf["k"] = pdf.k.fillna(-1)
    pdf["x"] = pdf.x.astype(float)
    return df, pdf.sort_values(["t", "id"])


def same(df, column, series, default=None):
    got = {r["id"]: r[column] for r in df.select("id", column).collect()}
    want = {i: (default if v != v else v) for i, v in series.items()}
    assert len(got) == len(want)
    for i, v in want.items():
        assert got[i] == (pytest.approx(v) if v is not None else None), (i, got[i], v)


@pytest.mark.parametrize("buckets", BUCKETS)
@pytest.mark.parametrize("grouped", [False, True])
def test_differences(spark, buckets, grouped):
    df, pdf = frame(spark)
    rows = OrderedRows(df, ["k"] if grouped else [], ["t", "id"], buckets)
    out = rows.differences(["x"], (1, 2, 7))
    s = pdf.set_index("id").x
    for k in (1, 2, 7):
        lag = pdf.groupby("k").x.shift(k) if grouped else pdf.x.shift(k)
        want = pd.Series((pdf.x - lag).fillna(0.0).values, index=pdf.id)
        same(out, f"x_diff_{k}", want)
    assert out.count() == len(s)


@pytest.mark.parametrize("buckets", BUCKETS)
@pytest.mark.parametrize("grouped", [False, True])
def test_rolling(spark, buckets, grouped):
    df, pdf = frame(spark, seed=2)
    out = OrderedRows(df, ["k"] if grouped else [], ["t", "id"], buckets).rolling(["x"], 10)
    for s in ("mean", "max", "min"):
        if grouped:
            want = pdf.groupby("k").x.transform(lambda v, s=s: getattr(v.rolling(10, min_periods=1), s)())
        else:
            want = getattr(pdf.x.rolling(10, min_periods=1), s)()
        same(out, f"x_roll_{s}", pd.Series(want.values, index=pdf.id))


@pytest.mark.parametrize("buckets", BUCKETS)
@pytest.mark.parametrize("grouped", [False, True])
def test_running_values(spark, buckets, grouped):
    df, pdf = frame(spark, seed=3)
    rows = OrderedRows(df, ["k"] if grouped else [], ["t", "id"], buckets)
    g = pdf.groupby("k") if grouped else pdf.assign(one=1).groupby("one")
    same(rows.row_number(), "row_number", pd.Series((g.cumcount() + 1).values, index=pdf.id))
    filled = pdf.assign(x=pdf.x.fillna(0.0))
    g0 = filled.groupby("k") if grouped else filled.assign(one=1).groupby("one")
    same(rows.running_sum(["x"]), "x_cum", pd.Series(g0.x.cumsum().values, index=pdf.id))
    same(rows.forward_fill(["x"]), "x", pd.Series(g.x.ffill().values, index=pdf.id))


def test_no_range_holds_a_long_group(spark):
    df, pdf = frame(spark, n=2000, seed=4)
    rows = OrderedRows(df, ["k"], ["t", "id"], 16)
    sizes = [r["count"] for r in rows.rows.groupBy("_bucket").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 0.2 * len(pdf)


def test_windows_are_partitioned_and_stay_in_the_jvm(spark):
    df, _ = frame(spark)
    plan = plan_of(OrderedRows(df, [], ["t", "id"], 8).differences(["x"]))
    assert "Window" in plan and "Python" not in plan
    assert "windowspecdefinition(_bucket" in plan


def test_trailing_sum(spark):
    df, pdf = frame(spark, seed=5)
    df = df.withColumn("ts", F.timestamp_add("SECOND", F.col("t"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))))
    out = trailing_sum(df, "ts", ["x"], 120, spread=["id"])
    want = pd.Series({r.id: pdf[(pdf.t <= r.t) & (pdf.t >= r.t - 120)].x.sum() for r in pdf.itertuples()})
    same(out, "x_sum_120s", want)


def test_empty_and_single(spark):
    df, _ = frame(spark)
    empty = OrderedRows(df.where("id < 0"), ["k"], ["t", "id"], 4)
    assert empty.differences(["x"]).count() == 0 and empty.row_number().count() == 0
    one = OrderedRows(df.where("id = 1"), ["k"], ["t", "id"], 4)
    assert one.differences(["x"]).first()["x_diff_1"] == 0.0 and one.row_number().first()["row_number"] == 1


@pytest.mark.parametrize("seconds", [1, 120, 10**6])
def test_trailing_sum_of_a_crowded_time(spark, seconds):
    """All instants within one window, then windows of any length, against plain sums."""
    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    data = [(i, start + dt.timedelta(milliseconds=rng.randrange(0, 100_000)), rng.choice([0.01, 1e9 + 0.25, -1e9, None]),
             rng.choice([3, -2**40, None]), decimal.Decimal(rng.randrange(1000)).scaleb(-2)) for i in range(1500)]
    data += [(5000 + i, start, 1.0, 1, decimal.Decimal(0)) for i in range(300)] + [(6000, None, 5.0, 5, decimal.Decimal(1))]
    df = spark.createDataFrame(data, "id long, ts timestamp_ntz, x double, n long, m decimal(10,2)").repartition(6)
    got = {r["id"]: r for r in trailing_sum(df, "ts", ["x", "n", "m"], seconds, spread=["id"], buckets=7).collect()}
    assert len(got) == len(data)
    for i, ts, *_ in data[::7] + data[-1:]:
        own = [] if ts is None else [r for r in data if r[1] is not None and ts - dt.timedelta(seconds=seconds) <= r[1] <= ts]
        for at, c in ((2, "x"), (3, "n"), (4, "m")):
            values = [r[at] for r in own if r[at] is not None]
            mine = got[i][f"{c}_sum_{seconds}s"]
            assert (mine is None) == (not values)
            if values:
                assert mine == (pytest.approx(math.fsum(values), abs=1e-6) if c == "x" else sum(values))


def test_trailing_sum_keeps_small_values_beside_large_ones(spark):
    start = dt.datetime(2024, 1, 1)
    data = [(0, start, 1e15), (1, start + dt.timedelta(seconds=500), 0.125), (2, start + dt.timedelta(seconds=501), 0.25),
            (3, start + dt.timedelta(seconds=900), float("inf")), (4, start + dt.timedelta(seconds=2000), 2.0),
            (5, start + dt.timedelta(seconds=3000), float("nan")), (6, start + dt.timedelta(seconds=4000), 7.0)]
    df = spark.createDataFrame(data, "id long, ts timestamp_ntz, x double")
    got = {r["id"]: r["x_sum_120s"] for r in trailing_sum(df, "ts", ["x"], 120, spread=["id"]).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 4, 6)] == [1e15, 0.125, 0.375, float("inf"), 2.0, 7.0] and got[5] != got[5]
    assert trailing_sum(df.where("id < 0"), "ts", ["x"]).count() == 0


def test_no_task_of_a_trailing_sum_has_a_large_share(spark):
    """8,000 instants within one window over 8 ranges: every range written has about an eighth of them."""
    start = dt.datetime(2024, 1, 1)
    df = spark.range(8000).select("id", (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(
        secs=F.col("id") / 100)).alias("ts"), F.lit(1.0).alias("x"))
    made = []
    keep = OrderedRows.__init__

    def noted(self, *args, **kwargs):
        keep(self, *args, **kwargs)
        made.append(self)

    OrderedRows.__init__ = noted
    try:
        out = trailing_sum(df, "ts", ["x"], 120, spread=["id"], buckets=8)
        assert out.agg(F.sum("x_sum_120s")).first()[0] == sum(range(1, 8001))
    finally:
        OrderedRows.__init__ = keep
    assert len(made) == 2
    for ranges in made:
        sizes = [r["count"] for r in ranges.rows.groupBy("_bucket").count().collect()]
        assert len(sizes) == 8 and max(sizes) < 0.2 * sum(sizes)

"""Joins and group features where one key holds a third of the rows, on every path."""

import pandas as pd
import pytest
from plans import plan_of
from pyspark.sql import functions as F

from weft.operators.grouped import GroupFeature, add_group_features, count_of, mode_of, nunique_of, stats_of
from weft.operators.merge import join_to_one
from weft.operators.skew import KeyProfile, attach, is_small, key_profiles
from weft.sources.tables import CAT, NUM, TableSpec, tag_table

PATHS = {
    "broadcast": {},
    "shuffle": {"broadcast_keys": 0, "hot_rows": 10**9},
    "hot": {"broadcast_keys": 0, "hot_rows": 20},
}


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, 0 if i % 3 == 0 else None if i % 50 == 1 else i % 97, ["a", "b", "c", None][(i * 7) % 4],
             float((i * 13) % 31)) for i in range(900)]
    df = spark.createDataFrame(data, "id long, k long, c string, x double")
    pdf = pd.DataFrame(data, columns=["id", "k", "c", "x"])
    return df.repartition(8), pdf


FEATURES = [count_of("k"), count_of("k", "c"), nunique_of("k", "c"), mode_of("k", "c"), *stats_of("k", "x")]


def expected(pdf: pd.DataFrame) -> dict[int, tuple]:
    p = pdf.assign(k=pdf.k.fillna(-7), c2=pdf.c.fillna("?"))
    out = p[["id"]].copy()
    g = p.groupby("k")
    out["n"] = g["id"].transform("count")
    out["nc"] = p.groupby(["k", "c2"])["id"].transform("count")
    out["nu"] = g["c"].transform("nunique")
    out["mode"] = p.k.map(g["c"].agg(lambda s: s.value_counts().sort_index().idxmax() if s.notna().any() else None))
    for s in ("sum", "mean", "var", "max", "min"):
        out[s] = g["x"].transform(s)
    return {r[0]: r[1:] for r in out.itertuples(index=False)}


@pytest.mark.parametrize("path", PATHS)
def test_group_features_on_every_path(rows, path):
    df, pdf = rows
    out = add_group_features(df, FEATURES, ["id"], **PATHS[path])
    want = expected(pdf)
    got = out.select("id", *[f.name for f in FEATURES]).collect()
    assert len(got) == len(pdf)
    for r in got:
        for mine, theirs in zip(r[1:], want[r["id"]], strict=True):
            if isinstance(theirs, float) and theirs != theirs:
                assert mine is None
            elif isinstance(mine, float):
                assert mine == pytest.approx(theirs)
            else:
                assert mine == theirs


def test_hot_rows_spread_over_tasks(rows):
    """With salting no task of the join holds the whole hot key."""
    df, _ = rows
    stats = df.groupBy(F.col("k").alias("kk")).agg(F.sum("x").alias("s"))
    profile = KeyProfile(10**6, key_profiles(df, [("k",)], hot_rows=20)[("k",)].hot)
    assert len(profile.hot) == 1
    conf = df.sparkSession.conf
    conf.set("spark.sql.adaptive.enabled", "false")
    conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = attach(df, stats, ["k"], profile, table_keys=["kk"], spread=["id"])
        sizes = {r["p"]: (r["n"], r["hot"]) for r in out.groupBy(F.spark_partition_id().alias("p")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") == 0).alias("hot")).collect()}
    finally:
        conf.unset("spark.sql.adaptive.enabled")
        conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) == 8
    assert max(h for _, h in sizes.values()) < 0.3 * sum(h for _, h in sizes.values())


@pytest.mark.parametrize("path", [{}, {"broadcast_keys": 0}, {"broadcast_keys": 0, "hot_rows": 10}])
def test_to_one_keeps_rows_and_matches(spark, rows, path):
    df, pdf = rows
    side = spark.range(1, 90).select(F.col("id").alias("kk"), (F.col("id") * 2.0).alias("v"))
    side = tag_table(side, "side", TableSpec({"v": NUM, "kk": CAT}))
    out = join_to_one(df, side, ["k"], ["kk"], "side", spread=["id"], **path)
    got = {r["id"]: r["side__v"] for r in out.collect()}
    assert got == {i: (2.0 * k if k == k and 1 <= k < 90 else None) for i, k in zip(pdf.id, pdf.k, strict=True)}


def test_statistics_from_other_rows(rows):
    df, _ = rows
    out = add_group_features(df, [count_of("c", name="n")], ["id"], over=df.where("id < 4"))
    found = {(r["c"], r["n"]) for r in out.collect()}
    assert found == {("a", 1), ("b", 1), ("c", 1), (None, 1)}


def test_profiles_and_size_check(spark, rows):
    df, pdf = rows
    found = key_profiles(df, [("k",), ("k", "c"), ("k",)], hot_rows=100)
    assert set(found) == {("k",), ("k", "c")}
    assert abs(found[("k",)].distinct - pdf.k.nunique(dropna=False)) <= 10
    zero = spark.range(1).select(F.xxhash64(F.col("id")).alias("h")).first()["h"]
    assert found[("k",)].hot == (zero,)
    assert key_profiles(df.where("id < 0"), [("k",)]) == {("k",): KeyProfile(0)}
    assert is_small(df, 900) and not is_small(df, 899)


def test_hot_keys_of_two_types_meet(spark, rows):
    df, pdf = rows
    table = df.groupBy(F.col("k").cast("int").alias("kk")).agg(F.count(F.lit(1)).alias("n"))
    zero = spark.range(1).select(F.xxhash64(F.col("id")).alias("h")).first()["h"]
    got = attach(df, table, ["k"], KeyProfile(10**6, (zero,)), table_keys=["kk"])
    assert got.count() == len(pdf)
    counts = pdf.k.value_counts(dropna=False)
    assert {(r["k"], r["n"]) for r in got.select("k", "n").distinct().collect() if r["k"] is not None} == {
        (int(k), int(n)) for k, n in counts.items() if k == k}


def test_one_aggregation_and_one_join_per_key_set(rows):
    df, _ = rows
    plan = plan_of(add_group_features(df, stats_of("c", "x") + [count_of("c")], ["id"]))
    assert plan.count("BroadcastHashJoin") == 1
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_bad_feature_is_refused():
    with pytest.raises(ValueError):
        GroupFeature("x", ("k",), "median", "v")
    with pytest.raises(ValueError):
        GroupFeature("x", ("k",), "sum")

"""Statistics of many key sets from one table of frequencies."""

import datetime as dt
import random

import pytest
from plans import plan_of
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.grouped import (
    _AGGS,
    add_group_features,
    count_of,
    fit_group_features,
    load_group_features,
    mode_of,
    nunique_of,
    stats_of,
)
from weft.operators.lattice import Lattice, Statistic
from weft.operators.pairs import PairFeature, PairState

PATHS = {"broadcast": {}, "mixed": {"broadcast_keys": 8}, "joined": {"broadcast_keys": 0, "hot_rows": 10**9},
         "hot": {"broadcast_keys": 0, "hot_rows": 5}}
COLUMNS = ("k", "s", "d", "w", "b")


@pytest.fixture(scope="module")
def typed(spark):
    rng = random.Random(2)
    rows = []
    for i in range(700):
        rows.append((i, rng.choice([None, 0, 0, 0, 7, 11, 100, 2**60 + 1, 2**60 + 2]), rng.choice(["a", "b:", "1|n", "", None]),
                     rng.choice([0.0, -0.0, 2.5, 10.0, float("nan"), None]),
                     rng.choice([dt.datetime(2024, 1, 1, 0, 0, 1), dt.datetime(1999, 5, 5), None]), rng.choice([True, False, None]),
                     rng.choice([1.5, -3.0, None, 8.0])))
    schema = "id long, k long, s string, d double, w timestamp_ntz, b boolean, x double"
    return spark.createDataFrame(rows, schema).repartition(5), rows


def plain(rows, keys, fn, value=None):
    """The statistic of every row's group, null keys in a group of their own."""
    at = {c: i for i, c in enumerate(("id", "k", "s", "d", "w", "b", "x"))}

    def same(v):
        return None if v is None else "nan" if v != v else v + 0 if isinstance(v, float) else v

    groups = {}
    for r in rows:
        groups.setdefault(tuple(same(r[at[k]]) for k in keys), []).append(r)
    out = {}
    for r in rows:
        group = groups[tuple(same(r[at[k]]) for k in keys)]
        if fn == "count":
            out[r[0]] = len(group)
            continue
        values = [same(g[at[value]]) for g in group if g[at[value]] is not None]
        if fn == "nunique":
            out[r[0]] = len(set(values))
        elif fn == "mode":
            order = sorted(set(values), key=lambda v: (-values.count(v), v == "nan", v if v != "nan" else 0))
            out[r[0]] = order[0] if order else None
        else:
            out[r[0]] = {"sum": sum, "max": max, "min": min}[fn](values) if values else None
    return out


@pytest.mark.parametrize("path", PATHS)
def test_every_statistic_on_every_path(typed, path):
    df, rows = typed
    features = [count_of("k"), count_of("k", "s"), count_of("s", "k", name="again"), count_of("d", "w", "b"), count_of("d"),
                nunique_of("k", "s"), nunique_of("s", "k"), nunique_of("b", "d"), nunique_of(("k", "b"), "w")]
    features += [mode_of(a, b) for a in COLUMNS for b in COLUMNS if a != b]
    features += stats_of("k", "x", ("sum", "max")) + stats_of("s", "x", ("min",))
    out = add_group_features(df, features, ["id"], **PATHS[path])
    assert out.columns == [*df.columns, *[f.name for f in features]]
    for f in features:
        want = {"count": T.LongType(), "nunique": T.LongType(), "mode": df.schema[f.value or "id"].dataType}
        assert f.fn not in want or out.schema[f.name].dataType == want[f.fn]
    got = out.collect()
    assert len(got) == len(rows)
    for f in features:
        expected = plain(rows, f.keys, f.fn, f.value)
        for r in got:
            mine = r[f.name]
            assert ("nan" if isinstance(mine, float) and mine != mine else mine) == expected[r["id"]], f


def test_more_columns_than_a_grouping_id_has_bits(typed, monkeypatch):
    from weft.operators import lattice

    df, _ = typed
    features = [f for a in COLUMNS for b in COLUMNS if a != b for f in (count_of(a, b, name=f"n{a}{b}"), nunique_of(a, b))]
    names = ["id", *[f.name for f in features]]
    whole = sorted(add_group_features(df, features, ["id"]).select(names).collect())
    monkeypatch.setattr(lattice, "MASK_COLUMNS", 3)
    assert sorted(add_group_features(df, features, ["id"]).select(names).collect()) == whole


@pytest.mark.parametrize("path", PATHS)
def test_statistics_of_some_rows_on_all(typed, path):
    df, rows = typed
    some = [r for r in rows if r[0] < 40]
    out = add_group_features(df, [count_of("s"), nunique_of("s", "k"), mode_of("k", "s"), *stats_of("b", "x", ("sum",))], ["id"],
                             over=df.where("id < 40"), **PATHS[path])
    known = {r[2]: n for r, n in ((r, plain(some, ("s",), "count")[r[0]]) for r in some)}
    for r in out.collect():
        assert r["cnt__s"] == known.get(r["s"])


def test_no_rows(typed):
    df, _ = typed
    features = [count_of("k"), mode_of("k", "w"), nunique_of("s", "k"), *stats_of("k", "x")]
    assert add_group_features(df.where("id < 0"), features, ["id"]).count() == 0
    out = add_group_features(df, features, ["id"], over=df.where("id < 0"))
    assert out.count() == 700 and out.where("cnt__k is not null or mode__k__w is not null or sum__k__x is not null").count() == 0


def test_scans_and_exchanges_do_not_grow_with_the_pairs(spark):
    def plan(keys, cats):
        names = [*[f"k{i}" for i in range(keys)], *[f"c{i}" for i in range(cats)]]
        df = spark.range(50).select(*[(F.col("id") % (i + 2)).alias(n) for i, n in enumerate(names)], F.rand(1).alias("x"))
        stats = [Statistic(f"s{fn}{k}{c}", (k,) if fn != "count" else (k, c), fn, None if fn == "count" else c)
                 for k in names[:keys] for c in names[keys:] for fn in ("count", "nunique", "mode")]
        stats += [Statistic(f"m{k}", (k,), "sum", "x") for k in names[:keys]]
        return plan_of(Lattice(df, stats, _AGGS).table())

    few, many = plan(1, 2), plan(5, 20)
    for node in ("Exchange", "Scan", "Range ("):
        assert few.count(node) == many.count(node), node
    # the frequencies are exchanged once and read for the modes and for the rest
    assert many.count("Range (") == 3 and many.count("Exchange") <= 7


def test_one_broadcast_for_all_key_sets(typed, capsys):
    df, _ = typed
    out = add_group_features(df, [count_of(a, b) for a in COLUMNS for b in COLUMNS if a < b], ["id"])
    out.write.format("noop").mode("overwrite").save()
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count("BroadcastHashJoin") == 10
    assert final.count("ReusedExchange") == 9
    assert "Exchange hashpartitioning" not in final


def test_saved_statistics_do_not_depend_on_the_batch(typed, spark, tmp_path):
    df, _ = typed
    features = [count_of("k"), count_of("d", "s"), nunique_of("b", "w"), mode_of("s", "d"), *stats_of("k", "x", ("sum", "mean"))]
    names = ["id", *[f.name for f in features]]
    fit_group_features(df.where("id < 300"), features).save(str(tmp_path / "state"))
    state = load_group_features(spark, str(tmp_path / "state"))
    whole = state.put_on(df).select(names)
    assert whole.schema.simpleString() == add_group_features(
        df, features, over=df.where("id < 300")).select(names).schema.simpleString()
    batches = [state.put_on(df.where(f"id % 3 = {i}"), broadcast_keys=b).select(names) for i, b in ((0, 10**5), (1, 0), (2, 5))]
    joined = batches[0].unionByName(batches[1]).unionByName(batches[2])
    rows = lambda d: sorted(map(repr, d.collect()))
    assert rows(joined) == rows(whole) == rows(add_group_features(df, features, over=df.where("id < 300")).select(names))
    # rows of another type meet the values of the fit
    narrow = df.where("k < 1000").withColumn("k", F.col("k").cast("int"))
    assert rows(state.put_on(narrow).select(names)) == rows(state.put_on(df.where("k < 1000")).select(names))
    wide = df.where("s = 'a'").withColumn("s", F.lit("a").cast("string")).withColumn("k", F.col("k").cast("string"))
    assert rows(state.put_on(wide).select(names)) == rows(state.put_on(df.where("s = 'a'")).select(names))


def test_pair_state_counts_unseen_values_as_none(typed, spark, tmp_path):
    df, rows = typed
    features = [PairFeature("count", "s"), PairFeature("ratio", "s", "b"), PairFeature("nunique", "k", "s"),
                PairFeature("per_nunique", "k", "b")]
    PairState.fit(df.where("id < 20"), features).save(str(tmp_path / "pairs"))
    state = PairState.load(spark, str(tmp_path / "pairs"))
    assert state.features == tuple(features)
    early = ["0" if r[2] is None else r[2] for r in rows[:20]]
    for r in state.transform(df).collect():
        own = "0" if r["s"] is None else r["s"]
        assert r["fe_count__s"] == early.count(own)
    assert state.transform(df.where("id < 0")).count() == 0
    PairState.fit(df, []).save(str(tmp_path / "none"))
    assert PairState.load(spark, str(tmp_path / "none")).transform(df).columns == df.columns

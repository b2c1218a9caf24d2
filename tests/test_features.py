"""Encodings, scores, pair features, samples, profiles and models on small frames."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weft.functions import expressions as E
from weft.operators import model as M
from weft.operators import profile as P
from weft.operators import sampling as S
from weft.operators import selection as SEL
from weft.operators.encode import apply_codes, cat_to_long, code_table, combination_codes, encode, encode_prefixes
from weft.operators.gated import gated_counts, gated_pair_counts, search_pair_counts
from weft.operators.model import auc_of_label_file
from weft.operators.pairs import PairFeature, PairFeatureModel, add_pair_features
from weft.operators.scoring import hellinger_scores, mutual_info
from weft.sources.tables import read_label_column


def test_time_signs(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 06:30:00' AS a, TIMESTAMP_NTZ '2024-01-02 08:00:00' AS b")
    r = E.with_exprs(df, E.time_differences(["a", "b"])).first()
    assert (r["a_minus_b_d"], r["a_minus_b_h"], r["b_minus_a_d"], r["b_minus_a_h"]) == (-2, -25, 1, 25)
    p = E.with_exprs(df, E.time_parts("a")).first()
    assert p["a_day_of_week"] == 0 and p["a_day_and_hour"] == 16 and p["a_day_hour"] == 106


def test_list_functions(spark):
    df = spark.createDataFrame([("3,1,2,9",), ("7",), ("0",), ("",)], "m string")
    got = df.select(*[E.list_prefix("m", k) for k in (1, 2, 3)], E.list_length("m"), E.list_size("m")).collect()
    assert [tuple(r) for r in got] == [("3", "3,1", "3,1,2", 7, 4), ("7", "7", "7", 1, 1), ("0", "0", "0", 1, 1),
                                       ("", "", "", 0, 1)]


def test_scaling_keeps_the_fitted_range(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0)], "x double, c double")
    r = E.column_ranges(df, ["x", "c"])
    new = spark.createDataFrame([(20.0, 6.0)], "x double, c double")
    assert new.select(E.minmax_scale("x", *r["x"]), E.minmax_scale("c", *r["c"])).first() == (200.0, 0.0)


def test_codes_and_unknown_values(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(["b", "a", "c", "a", None])], "id long, c string")
    codes = code_table(df, ["c"], buckets=3)
    out = apply_codes(df.union(spark.createDataFrame([(9, "zz")], "id long, c string")), codes, {"c": "code"}, ["id"])
    assert {r["id"]: r["code"] for r in out.collect()} == {0: 2, 1: 1, 2: 3, 3: 1, 4: -1, 9: -1}
    numbers = spark.createDataFrame([("12",), ("x",), (None,)], "c string").select(cat_to_long("c")).collect()
    assert [r[0] for r in numbers] == [12, None, None]
    both = encode(df, {}, ["id"], counts={"c": "n"}, scope=F.col("id") > 1)
    assert {r["id"]: r["n"] for r in both.collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: None}
    pairs = combination_codes(df, ["c", "id"], "code", ["id"], buckets=3)
    assert [r["code"] for r in pairs.orderBy("code").collect()] == [1, 2, 3, 4, 5]


def test_prefix_codes(spark):
    df = spark.createDataFrame([(1, "a,b,c,d"), (2, "a,b,x"), (3, "a")], "id long, m string")
    r = {x["id"]: tuple(x)[2:] for x in encode_prefixes(df, ["m"], spread=["id"]).collect()}
    assert r == {1: (1, 2, 2), 2: (1, 2, 3), 3: (1, 1, 1)}


def numpy_hellinger(x, y, bins=64):
    lo, hi = x.min(), x.max()
    p = np.histogram(x[y == 1], bins, (lo, hi))[0] / (y == 1).sum()
    q = np.histogram(x[y == 0], bins, (lo, hi))[0] / (y == 0).sum()
    return math.sqrt(((np.sqrt(p) - np.sqrt(q)) ** 2).sum()) / math.sqrt(2)


def test_hellinger_agrees_with_histograms(spark):
    r = np.random.default_rng(1)
    y = r.integers(0, 2, 500)
    a, b = r.normal(size=500) + y, r.integers(0, 5, 500).astype(float)
    rows = [(float(i), float(j), int(k), 1.0) for i, j, k in zip(a, b, y, strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, label int, c double")
    got = {x["feature"]: x["score"] for x in hellinger_scores(df, ["a", "b", "c"], "label").collect()}
    assert got["a"] == pytest.approx(numpy_hellinger(a, y), abs=1e-8)
    assert got["b"] == pytest.approx(numpy_hellinger(b, y), abs=1e-8) and got["c"] == 0.0
    holes = df.union(spark.createDataFrame([(float("nan"), None, 1, float("inf"))] * 3, df.schema))
    assert {x["feature"]: x["score"] for x in hellinger_scores(holes, ["a", "b", "c"], "label").collect()} == got
    one = {x["score"] for x in hellinger_scores(df.withColumn("label", F.lit(0)), ["a"], "label").collect()}
    assert one == {-1.0}
    mi = {x["feature"]: x["mi"] for x in mutual_info(df, ["a", "b", "c"], "label").collect()}
    assert mi["a"] > mi["b"] > mi["c"] == 0.0
    perfect = mutual_info(df.withColumn("z", F.col("label")), ["z"], "label").first()["mi"]
    share = y.mean()
    assert perfect == pytest.approx(-(share * math.log(share) + (1 - share) * math.log(1 - share)), abs=1e-8)


@pytest.fixture(scope="module")
def planted(spark):
    """The label depends on how often the pair (a, b) occurs, not on a or b alone."""
    r = random.Random(7)
    rows, i = [], 0
    for a in range(12):
        for b in range(12):
            often = (a + b) % 2 == 0
            for _ in range(12 if often else 3):
                rows.append((i, f"a{a}", f"b{b}", f"c{r.randrange(6)}", int(r.random() < (0.9 if often else 0.1))))
                i += 1
    df = spark.createDataFrame(rows, "id long, a string, b string, c string, label int").repartition(4)
    for c in "abc":
        df = df.withColumn(f"{c}_code", F.expr(f"cast(substr({c}, 2) as double)"))
    return df.cache()


def test_planted_pair_ranks_first(planted):
    model = PairFeatureModel.fit(planted, ["a", "b", "c"], "label", codes=["a_code", "b_code", "c_code"],
                                 pairs_per_job=2)
    assert {model.features[0].a, model.features[0].b} == {"a", "b"}
    assert model.features[0].kind in ("count", "ratio") and len(model.features) <= 9
    assert all(s > model.threshold for s in model.scores) and list(model.scores) == sorted(model.scores, reverse=True)
    out = model.transform(planted, ["id"])
    assert out.count() == planted.count() and set(out.columns) == {*planted.columns, *(f.name for f in model.features)}


def test_candidate_scores_equal_scores_on_rows(planted):
    """Scoring from frequencies gives what scoring the feature on the rows gives."""
    model = PairFeatureModel.fit(planted, ["a", "b", "c"], "label", codes=["a_code", "b_code", "c_code"])
    names = [f.name for f in model.features]
    on_rows = {r["feature"]: r["score"]
               for r in hellinger_scores(model.transform(planted, ["id"]), names, "label").collect()}
    for f, s in zip(model.features, model.scores, strict=True):
        assert on_rows[f.name] == pytest.approx(s, abs=1e-8)


def test_null_counts_as_zero_in_pair_features(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "0", "x"), (3, "1", None)], "id long, a string, b string")
    out = add_pair_features(df, [PairFeature("count", "a"), PairFeature("nunique", "b", "a")], ["id"])
    assert sorted((r["id"], r["fe_count__a"], r["fe_nunique__b__a"]) for r in out.collect()) == [
        (1, 2.0, 1.0), (2, 2.0, 1.0), (3, 1.0, 1.0)]


def test_best_first_search_of_pairs(planted):
    columns, codes = ["a", "b", "c"], ["a_code", "b_code", "c_code"]
    model, trials = search_pair_counts(planted, columns, codes, "label", threshold=0.0, batch=2)
    assert [t.turn for t in trials] == [1, 2, 3] and [t.batch for t in trials] == [1, 1, 2]
    assert [t.expected for t in trials] == sorted((t.expected for t in trials), reverse=True)
    alone = gated_pair_counts(planted, columns, codes, "label", threshold=0.0)
    assert {t.feature: t.mi for t in trials if t.accepted} == dict(zip(alone.features, alone.mi, strict=True))
    assert set(model.features) == set(alone.features)
    _, few = search_pair_counts(planted, columns, codes, "label", threshold=0.0, batch=2, budget=1)
    assert few == trials[:1]
    none, idle = search_pair_counts(planted, columns, codes, "label", threshold=9.0, batch=1, patience=2)
    assert none.features == () and len(idle) == 2 and not any(t.accepted for t in idle)


def test_gated_counts_scale_by_the_fitted_range(planted):
    model = gated_pair_counts(planted, ["a", "b", "c"], ["a_code", "b_code", "c_code"], "label")
    assert [f.keys for f in model.features][0] == ("a", "b")
    lo, hi = planted.groupBy("a", "b").count().agg(F.min("count"), F.max("count")).first()
    assert model.ranges["cnt__a__b"] == (lo, hi)
    out = model.transform(planted, ["id"]).agg(F.min("cnt__a__b"), F.max("cnt__a__b")).first()
    assert tuple(out) == (0.0, 100.0)
    assert gated_counts(planted, ["c"], "label", threshold=10.0).features == ()


@pytest.mark.parametrize("pos,neg,rows", [(5, 100, 50), (0, 10, 5), (10, 0, 5), (50, 60, 30), (1, 5000, 500),
                                          (300, 20, 100)])
def test_sizes_never_exceed_the_classes(pos, neg, rows):
    for sizes in (S.balanced_sizes(pos, neg, rows), S.skew_sizes(pos, neg, rows), S.tuning_sizes(pos, neg, rows),
                  S.ensemble_sizes(pos, neg)):
        assert 0 <= sizes[1] <= pos and 0 <= sizes[0] <= neg


def test_size_rules():
    assert S.skew_sizes(1, 5000, 500) == {1: 1, 0: 1250}
    assert S.skew_sizes(50, 900, 500) == {1: 50, 0: 500} and S.skew_sizes(400, 900, 500) == {1: 400, 0: 400}
    assert S.tuning_sizes(5, 900, 500) == {1: 5, 0: 150} and S.tuning_sizes(50, 900, 500) == {1: 50, 0: 900}
    assert S.ensemble_sizes(10, 100) == {1: 10, 0: 20} and S.ensemble_sizes(100, 10) == {1: 20, 0: 10}
    assert S.ensemble_sizes(10, 15) == {1: 10, 0: 10}


def test_samples_are_exact_and_repeatable(spark):
    df = spark.range(5000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    one = S.take_per_class(df, "id", "label", {1: 37, 0: 411}, seed=3)
    two = S.take_per_class(df.repartition(13), "id", "label", {1: 37, 0: 411}, seed=3)
    a, b = sorted(r["id"] for r in one.collect()), sorted(r["id"] for r in two.collect())
    assert a == b and len(a) == len(set(a)) == 448
    assert one.where("label = 1").count() == 37
    other = {r["id"] for r in S.take_per_class(df, "id", "label", {1: 37, 0: 411}, seed=4).collect()}
    assert other != set(a)
    assert S.take_per_class(df, "id", "label", {1: 10**6, 0: 0}, seed=1).count() == 500
    assert S.row_sample(df, "id", 123).count() == 123
    train, val = S.train_val_split(df, "id", 0.2)
    assert train.count() + val.count() == 5000 and 850 < val.count() < 1150
    used = S.balanced_sample(df, "id", "label", 100).where("label = 0")
    fresh = S.negatives_excluding(df, "id", "label", used)
    assert fresh.join(used, "id", "left_semi").count() == 0
    assert fresh.where("label = 0").count() == 1250 and fresh.where("label = 1").count() == 500


def test_profiles(spark):
    df = spark.createDataFrame([(1.0, 1.0, "a", 2.0), (2.0, None, "b", 4.0), (3.0, None, "a", 6.0)],
                               "x double, y double, c string, z double")
    assert dict(P.missing_above(df, ["x", "y"], 0.5).collect()) == {"y": pytest.approx(2 / 3)}
    assert dict(P.single_unique(df, ["x", "y", "c"]).collect()) == {"x": False, "y": True, "c": False}
    assert [tuple(r)[:2] for r in P.collinear(df, ["x", "z"], 0.9).collect()] == [("x", "z")]
    hot, names = P.one_hot(df, ["c"])
    assert names == ["c_a", "c_b"] and [tuple(r) for r in hot.select(*names).collect()] == [(1, 0), (0, 1), (1, 0)]
    with pytest.raises(ValueError):
        P.one_hot(df, ["c"], max_levels=1)
    report = SEL.feature_report(df, ["x", "y", "z"], ["x", "z"], missing_threshold=0.5, correlation_threshold=0.9)
    assert set(map(tuple, report.collect())) == {("y", "missing"), ("y", "single_unique"), ("z", "collinear")}
    assert SEL.drop_reported(df, report).columns == ["x", "c"]
    assert SEL.drop_reported(df, report, ["collinear"]).columns == ["x", "y", "c"]


def test_many_columns_use_one_matrix(spark):
    r = np.random.default_rng(3)
    data = r.normal(size=(200, 30))
    data[:, 29] = data[:, 0] * 2
    cols = [f"x{i}" for i in range(30)]
    df = spark.createDataFrame([tuple(map(float, row)) for row in data], cols)
    assert [tuple(x)[:2] for x in P.collinear(df, cols, 0.99).collect()] == [("x0", "x29")]


def test_exact_auc(spark):
    r = random.Random(5)
    rows = [(float(r.randrange(20)), r.randrange(2)) for _ in range(300)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "s double, label int")
    for buckets in (1, 5):
        assert M.auc(df, "s", "label", buckets).first()["auc"] == pytest.approx(want)
    assert M.auc(df.where("label = 1"), "s", "label").first()["auc"] is None


def test_training_finds_the_signal_and_repeats(planted):
    wide = PairFeatureModel.fit(planted, ["a", "b"], "label", codes=["a_code", "b_code"]).transform(planted, ["id"])
    cols = [c for c in wide.columns if c.startswith("fe_")]
    models = M.train_ensemble(wide, cols, "id", "label", n_models=2, rounds=3, trials=0)
    vectors = M.assemble(wide, cols, ["id"])
    scores = M.ensemble_score(vectors, models, "id")
    assert scores.where("score < 0 or score > 1").count() == 0 and scores.count() == planted.count()
    joined = scores.join(planted.select("id", "label"), "id")
    assert M.auc(joined, "score", "label").first()["auc"] > 0.8
    again = M.ensemble_score(vectors, M.train_ensemble(wide, cols, "id", "label", n_models=2, rounds=3, trials=0), "id")
    assert scores.exceptAll(again).count() == 0
    kept, table = SEL.importance_select(wide.withColumn("noise", F.lit(1.0)), [*cols, "noise"], "id", "label",
                                        rounds=3, trials=0, max_features=3)
    assert kept and "noise" not in kept and len(kept) <= 3
    cut = SEL.importance_cut(M.importance_table(models[0], cols, wide))
    assert cut.agg(F.max("cumulative")).first()[0] == pytest.approx(1.0)


def test_selection_fits_on_all_rows(planted, monkeypatch):
    seen, fit = [], SEL.train
    monkeypatch.setattr(SEL, "train", lambda vectors, *rest: seen.append(vectors.count()) or fit(vectors, *rest))
    SEL.importance_select(planted, ["a_code", "b_code"], "id", "label", rounds=2, trials=0)
    assert seen and set(seen) == {planted.count()}


def test_search_space_and_draws():
    draws = M.draw_params(50, 3)
    assert draws == M.draw_params(50, 3) and draws != M.draw_params(50, 4)
    assert all(0.01 <= d.stepSize <= 0.2 and d.maxDepth in (5, 6, 7) and 1 <= d.minInstancesPerNode <= 10
               for d in draws)


def test_correlations_do_not_depend_on_the_number_of_columns(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 30))
    x[:, 1] = x[:, 0] + 0.1 * x[:, 1]
    x[rng.random(x.shape) < 0.3] = np.nan
    names = [f"c{i}" for i in range(30)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    want = pd.DataFrame(x, columns=names).corr()
    got = P.correlations(df, names).collect()
    assert len(got) == 435
    for r in got:
        assert abs(r["corr_value"] - want.loc[r["corr_feature"], r["drop_feature"]]) < 1e-9


@pytest.mark.parametrize("share", [0.0, 1e-6, 0.2, 1.0])
def test_split_shares(spark, share):
    df = spark.range(20_000)
    train, val = S.train_val_split(df, "id", share)
    assert train.count() + val.count() == 20_000
    assert abs(val.count() - 20_000 * share) <= (0 if share in (0.0, 1.0) else 300)


@pytest.mark.parametrize("split", ["10b", "128m"])
def test_labels_by_position_of_their_lines(spark, tmp_path, split):
    """Two files in splits of any size, some of them without a line's beginning."""
    labels = [(i * 7) % 3 % 2 for i in range(101)]
    folder = tmp_path / "labels"
    folder.mkdir()
    (folder / "part-0.csv").write_text("name of label\n" + "".join(f"{v}\n" for v in labels[:64]))
    (folder / "part-1.csv").write_text("\n".join(str(v) for v in labels[64:]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = read_label_column(spark, str(folder))  # the lines are read and written here
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [tuple(r) for r in sorted(got.collect())] == list(enumerate(labels))
    scores = spark.createDataFrame([(1000 - i, (i * 13) % 17 / 17) for i in range(101)], "id long, score double")
    mine = auc_of_label_file(scores, "id", got).first()["auc"]
    known = scores.orderBy("id").collect()
    pos, neg = ([r["score"] for r, v in zip(known, labels, strict=True) if v == k] for k in (1, 0))
    assert mine == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)))
    with pytest.raises(Exception, match="as many labels"):
        auc_of_label_file(scores.where("id < 990"), "id", got).collect()

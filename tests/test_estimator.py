"""From related tables to scores."""

import datetime as dt
import random

import pytest

from weft.operators.merge import merge_graph
from weft.operators.model import FEATURES, TreeParams, assemble, auc, train, train_until
from weft.operators.sampling import in_validation
from weft.plans.estimator import RelationalModel
from weft.plans.features import engineer
from weft.sources.tables import CAT, MULTI_CAT, NUM, TIME, Relation, TableSet, TableSpec
from weft.sources.workspace import materialize


@pytest.fixture(scope="module")
def tables(spark):
    """The label depends on the mean of the side table and on the main number."""
    r = random.Random(11)
    main, side = [], []
    for i in range(600):
        level, n = r.random(), r.random()
        main.append((i, f"u{i % 40}", r.choice("abc"), n, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i),
                     int(level + n > 1.0)))
        side += [(i, j, level + r.random() / 5, r.choice(["x,y", "z", "x,q,w"])) for j in range(3)]
    tables = {"main": spark.createDataFrame(main, "id long, u string, c string, n double, t timestamp_ntz, label int"),
              "side": spark.createDataFrame(side, "id long, o int, v double, m string")}
    specs = {"main": TableSpec({"u": CAT, "c": CAT, "n": NUM, "t": TIME}, keys=("u",)),
             "side": TableSpec({"v": NUM, "m": MULTI_CAT}, order=("o",))}
    return TableSet(tables, specs, (Relation("main", "side", ("id",), ("id",), "one_to_many"),), main="main",
                    row_id="id", time_col="t", label="label")


def test_scores_find_the_signal(spark, tables):
    main = tables.tables["main"]
    model = RelationalModel(n_models=1, rounds=5, trials=0, fit_scope="train").fit(
        tables.with_table("main", main.where("id < 450")))
    test = main.where("id >= 450")
    scores = model.predict(test).cache()
    assert scores.count() == 150 and scores.columns == ["id", "score"]
    assert auc(scores.join(test, "id"), "score", "label").first()["auc"] > 0.75
    assert any("v" in c for c in model.selected)


def test_selected_features_alone_equal_all_features(spark, tables):
    """Computing only the chosen features gives the values that computing everything gives."""
    base = materialize(merge_graph(tables), "merged")
    full = engineer(base, tables, ["id", "label"], label="label")
    some = [c for i, c in enumerate(full.features) if i % 5 == 0]
    part = engineer(base, tables, ["id", "label"], pairs=full.pairs, selected=set(some))
    assert sorted(part.features) == sorted(some)
    assert part.df.select("id", *some).exceptAll(full.df.select("id", *some)).count() == 0
    assert full.df.count() == 600


def test_key_categories_take_part_in_pair_screening(tables, monkeypatch):
    from weft.operators.pairs import PairFeatureModel

    seen, fit = [], PairFeatureModel.fit
    monkeypatch.setattr(PairFeatureModel, "fit", lambda df, columns, *rest, **more: seen.extend(columns) or fit(
        df, columns, *rest, **more))
    engineer(materialize(merge_graph(tables), "merged"), tables, ["id", "label"], label="label")
    assert {"u", "c"} <= set(seen)


def test_boosting_stops_by_the_validation_rows(spark):
    """A step in one column, with labels flipped at random: the rounds after the first few only fit the noise."""
    r = random.Random(5)
    rows = [(i, x, r.random(), int((x > 0.5) != (r.random() < 0.3))) for i, x in ((i, r.random()) for i in range(1500))]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    vectors = materialize(assemble(df, ["a", "b"], ["id", "label"]), "vectors")
    fit = train_until(vectors, "id", "label", TreeParams(stepSize=0.5), rounds=40, share=0.3)
    assert fit.stopped and 1 <= fit.rounds < 40 and fit.model.getNumTrees == fit.rounds == len(fit.losses)
    assert fit.losses[-1] == min(fit.losses)
    # the same rounds without a stop: the next one is no better on the rows held out
    part = in_validation("id", 0.3, 1)
    longer = train(vectors.where(~part), "label", TreeParams(stepSize=0.5), rounds=fit.rounds + 1)
    losses = longer.evaluateEachIteration(vectors.where(part).select(vectors.label.cast("double").alias("label"), FEATURES))
    assert losses[-1] >= losses[-2] - 1e-9
    whole = train_until(vectors, "id", "label", rounds=3, share=0.0)
    assert whole.rounds == 3 and not whole.stopped and whole.losses == ()


def test_misuse_is_refused(tables):
    with pytest.raises(ValueError):
        RelationalModel().predict(tables.tables["main"])
    with pytest.raises(ValueError):
        RelationalModel(fit_scope="some").fit(tables)


def test_what_fits_move_does_not_grow_with_partitions(spark, monkeypatch):
    """Each partition of a fit sends statistics for every level of every tree: there are no more of them than cores."""
    from weft.operators import model

    rows = spark.createDataFrame([(i, i % 2, float(i % 7), float(i % 2)) for i in range(400)], "id long, label int, a double, b double")
    vectors = assemble(rows.repartition(60, "id"), ["a", "b"], ["id", "label"])
    seen, fit = [], model.GBTClassifier.fit
    monkeypatch.setattr(model.GBTClassifier, "fit", lambda self, df, params=None: seen.append(df.rdd.getNumPartitions()) or fit(self, df, params))
    train(vectors, "label", rounds=2)
    train_until(vectors, "id", "label", rounds=2)
    train_until(vectors, "id", "label", rounds=2, share=0)
    assert len(seen) == 3 and max(seen) <= spark.sparkContext.defaultParallelism < 60


def test_only_columns_of_wanted_features_are_written(tables, monkeypatch):
    """With chosen features no other column of the rows goes through the ranges or the rows that are written."""
    from weft.operators import ordered
    from weft.plans import features

    base = materialize(merge_graph(tables), "merged")
    full = engineer(base, tables, ["id", "label"], label="label")
    written = {}

    def kept(df, name="table"):
        written.setdefault(name, set(df.columns))
        return materialize(df, name)

    monkeypatch.setattr(features, "materialize", kept)
    monkeypatch.setattr(ordered, "materialize", kept)
    part = engineer(base, tables, ["id", "label"], pairs=full.pairs, selected={"n_diff_1", "t_hour"} & set(full.features))
    assert "n_diff_1" in part.features
    assert written["ranges"] == {"id", "label", "n", "t", ordered.BUCKET}
    assert written["rows"] == {"id", "label", *part.features}


def test_models_and_selection_write_no_second_copy(spark, tables, monkeypatch):
    """Rows that are written already are read as they are."""
    from weft.operators import model, selection

    rows = materialize(spark.createDataFrame([(i, i % 2, float(i % 7), float(i % 2)) for i in range(400)],
                                             "id long, label int, a double, b double"), "rows")
    written = []
    for module in (model, selection):
        monkeypatch.setattr(module, "materialize", lambda df, name="table": written.append(name) or materialize(df, name), raising=False)
    assert len(model.train_ensemble(rows, ["a", "b"], "id", "label", n_models=1, rounds=2, trials=0)) == 1
    assert selection.importance_select(rows, ["a", "b"], "id", "label", rounds=2, trials=0)[0] == ["b"]
    assert not written


@pytest.fixture
def few(spark, monkeypatch):
    """The model queries over a small table of two features instead of the merged orders."""
    from weft.queries import models

    rows = [(i, i % 7 / 7, i * 13 % 11 / 11, int(i % 7 > 3)) for i in range(60)]
    made = spark.createDataFrame(rows, "o_orderkey long, a double, b double, label int")
    monkeypatch.setattr(models, "_table", lambda *_: (made, ["a", "b"]))
    return models


def test_query_trains_all_rounds(spark, few, monkeypatch):
    seen, fit = [], few.M.train

    def trained(vectors, label, *rest, **more):
        seen.append(more.get("rounds", few.M.ROUNDS))
        return fit(vectors, label, rounds=2)

    monkeypatch.setattr(few.M, "train", trained)
    assert few.gbt_train(spark, "").count() == 60
    assert seen == [few.M.ROUNDS] == [150]


def test_query_searches_with_all_trials_and_rounds(spark, few, monkeypatch):
    seen, search = [], few.M.tune

    def searched(vectors, label, trials, rounds):
        seen.append((trials, rounds))
        return search(vectors, label, 2, 2)

    monkeypatch.setattr(few.M, "tune", searched)
    assert few.tune(spark, "").count() == 2
    assert seen == [(few.M.TRIALS, few.M.ROUNDS)] == [(10, 150)]


def test_search_agrees_with_spark_and_holds_nothing_in_memory(spark, monkeypatch):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import TrainValidationSplit
    from weft.operators import model as M

    r = random.Random(5)
    rows = [(r.random(), r.random(), int(r.random() < 0.5)) for _ in range(300)]
    rows = [(a, b, int(a + b > 1) if r.random() < 0.9 else y) for a, b, y in rows]
    df = materialize(spark.createDataFrame(rows, "a double, b double, label int").repartition(3, "a"), "rows")
    vectors = assemble(df, ["a", "b"], ["label"])
    draws = M.draw_params(3, 1)
    gbt = M._classifier("label", 3, 1)
    maps = [{gbt.getParam(n): v for n, v in vars(p).items()} for p in draws]
    want = TrainValidationSplit(estimator=gbt, estimatorParamMaps=maps, trainRatio=0.5, seed=1, parallelism=2,
                                evaluator=BinaryClassificationEvaluator(labelCol="label")).fit(vectors).validationMetrics
    held, fit = [], M.GBTClassifier.fit
    monkeypatch.setattr(M.GBTClassifier, "fit", lambda self, rows: held.append(rows.storageLevel.useMemory) or fit(self, rows))
    best, trials = M.tune(vectors, "label", 3, 3)
    assert [a for _, a in trials] == pytest.approx(want) and [p for p, _ in trials] == draws
    assert best == draws[max(range(3), key=lambda i: want[i])]
    assert held == [False] * 3

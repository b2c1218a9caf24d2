"""Cleaning, aggregation and merging on small hand-made frames."""

import datetime as dt
import re

import pytest
from plans import plan_of
from pyspark.sql import functions as F

from weft.operators import aggregate as A
from weft.operators import skew
from weft.operators.asof import asof_join, asof_rolling
from weft.operators.clean import clean_fill, project, take_split, union_split
from weft.operators.merge import (
    branches,
    depths,
    join_to_many,
    join_to_one,
    join_with_unions,
    merge_graph,
    merge_with_unions,
    require_unique,
)
from weft.sources.tables import (
    CAT,
    MULTI_CAT,
    NUM,
    TIME,
    Relation,
    TableSet,
    TableSpec,
    columns_of,
    read_csv_table,
    read_labels,
    table_of,
    tag_table,
    write_scores,
)

MAIN = "id long, k string, n double, t timestamp_ntz, label int"
SIDE = "k string, o int, c string, m string, x double"


def graph(spark, main=None, side=None, name="table_1"):
    main = main or [(1, "a", 1.0, dt.datetime(2024, 1, 1), 1), (2, "b", None, None, 0), (3, None, 3.0, None, 0),
                    (4, "z", 4.0, None, 1)]
    side = side or [("a", 2, "y", "3,1,2,9", 1.0), ("a", 1, "x", "7", None), ("a", 3, None, "5,5", 5.0),
                    ("b", 1, None, "0", None), (None, 1, "q", "8,8", 7.0)]
    return TableSet(
        {"main": spark.createDataFrame(main, MAIN), name: spark.createDataFrame(side, SIDE)},
        {"main": TableSpec({"k": CAT, "n": NUM, "t": TIME}, keys=("k",)),
         name: TableSpec({"k": CAT, "c": CAT, "m": MULTI_CAT, "x": NUM}, keys=("k",), order=("o",))},
        (Relation("main", name, ("k",), ("k",), "one_to_many"),), main="main", row_id="id", time_col="t", label="label")


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_fill_by_type(spark):
    df = spark.createDataFrame([(None, None, None, None, None)], "n double, c string, t timestamp_ntz, m string, u int")
    r = clean_fill(df, {"n": NUM, "c": CAT, "t": TIME, "m": MULTI_CAT}).first()
    assert r == (-1.0, "0", dt.datetime(1970, 1, 1), "0", None)


def test_fill_after_aggregation(spark):
    r = by_id(merge_graph(graph(spark), unions="text"))
    assert r[1]["table_1__mean__x"] == 3.0 and r[1]["table_1__sum__x"] == 6.0
    assert r[1]["table_1__last__c"] == "y" and r[1]["table_1__union__c"] == "x,y"
    assert r[1]["table_1__last__m"] == "5,5" and r[1]["table_1__union__m"] == "3,1,2,9,5,5"
    assert r[2]["table_1__mean__x"] == -1.0 and r[2]["table_1__last__c"] == "0" and r[2]["table_1__union__m"] == "0"
    assert r[2]["n"] == -1.0 and r[2]["t"] == dt.datetime(1970, 1, 1)
    assert r[3]["table_1__sum__x"] == -1.0 and r[3]["k"] == "0"
    assert r[4]["table_1__union__c"] == "0" and len(r) == 4


def test_fill_before_aggregation(spark):
    r = by_id(merge_graph(graph(spark), fill="before", unions="text"))
    assert r[1]["table_1__mean__x"] == pytest.approx(5 / 3) and r[1]["table_1__sum__x"] == 5.0
    assert r[1]["table_1__last__c"] == "0" and r[1]["table_1__union__c"] == "0,x,y"
    # null keys become the same category and meet
    assert r[3]["table_1__sum__x"] == 7.0 and r[3]["table_1__last__m"] == "8,8"


def test_union_lengths_equal_the_texts(spark):
    text = by_id(merge_graph(graph(spark), unions="text"))
    length = by_id(merge_graph(graph(spark)))
    for i in (1, 2):
        for c in ("c", "m"):
            assert length[i][f"table_1__union_length__{c}"] == len(text[i][f"table_1__union__{c}"])


def test_similar_table_names_do_not_mix(spark):
    one, ten = graph(spark), graph(spark, name="table_10")
    both = TableSet({**one.tables, "table_10": ten.tables["table_10"]},
                    {**one.specs, "table_10": ten.specs["table_10"]}, one.relations + ten.relations, main="main", row_id="id", time_col="t")
    m = merge_graph(both)
    assert set(columns_of(m, NUM, table="table_1")) == {f"table_1__{s}__x" for s in ("mean", "sum")} | {
        f"table_1__union_length__{c}" for c in ("c", "m")}
    assert all(table_of(m, c) == "table_10" for c in m.columns if c.startswith("table_10__"))


def test_empty_side_table(spark):
    g = graph(spark)
    r = by_id(merge_graph(g.with_table("table_1", g.tables["table_1"].limit(0))))
    assert len(r) == 4 and all(x["table_1__sum__x"] == -1.0 for x in r.values())


def test_side_with_a_clock_its_parent_lacks_is_left_out(spark):
    a = spark.createDataFrame([(1, "p")], "id long, k string")
    b = spark.createDataFrame([("p", dt.datetime(2024, 1, 1), 1.0)], "k string, t timestamp_ntz, x double")
    g = TableSet({"main": a, "b": b}, {"main": TableSpec({"k": CAT}), "b": TableSpec({"x": NUM, "t": TIME})},
                 (Relation("main", "b", ("k",), ("k",), "one_to_many"),), main="main", row_id="id", time_col="t")
    assert merge_graph(g).columns == ["id", "k"]


def test_repeated_to_one_key_is_reported(spark):
    side = tag_table(spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, x double"), "s", TableSpec({"x": NUM}))
    with pytest.raises(ValueError, match="repeats"):
        require_unique(side, ["k"], "s")
    left = spark.createDataFrame([("a",)], "k string")
    with pytest.raises(ValueError):
        join_to_one(left, side, ["k"], ["k"], "s", check_unique=True)


def diamond(spark):
    main = spark.createDataFrame([(1, "a", "p"), (2, "b", None), (3, "c", "q")], "id long, ka string, kb string")
    a = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0)], "ka string, kc string, va double")
    b = spark.createDataFrame([("p", "y", 3.0), ("q", "z", 4.0)], "kb string, kc string, vb double")
    c = spark.createDataFrame([("x", 10.0, "d1"), ("y", 20.0, "d2")], "kc string, vc double, kd string")
    d = spark.createDataFrame([("d1", "one"), ("d2", "two")], "kd string, vd string")
    return TableSet(
        {"main": main, "a": a, "b": b, "c": c, "d": d},
        {"main": TableSpec({"ka": CAT, "kb": CAT}, keys=("ka", "kb")), "a": TableSpec({"va": NUM}), "b": TableSpec({"vb": NUM}),
         "c": TableSpec({"vc": NUM}), "d": TableSpec({"vd": CAT})},
        (Relation("main", "a", ("ka",), ("ka",), "many_to_one"), Relation("main", "b", ("kb",), ("kb",), "many_to_one"),
         Relation("a", "c", ("kc",), ("kc",), "many_to_one"), Relation("b", "c", ("kc",), ("kc",), "many_to_one"),
         Relation("c", "d", ("kd",), ("kd",), "many_to_one")), main="main", row_id="id")


def test_a_diamond_names_columns_by_their_paths(spark):
    m = merge_graph(diamond(spark), fill="none")
    assert m.columns == ["id", "ka", "kb", "a__va", "a__c__vc", "a__c__d__vd", "b__vb", "b__c__vc", "b__c__d__vd"]
    assert set(columns_of(m, NUM, table="c")) == {"a__c__vc", "b__c__vc"}
    got = {r["id"]: tuple(r)[3:] for r in m.collect()}
    assert got == {1: (1.0, 10.0, "one", 3.0, 20.0, "two"), 2: (2.0, 20.0, "two", None, None, None),
                   3: (None, None, None, 4.0, None, None)}


def test_a_table_met_twice_is_computed_once(spark, monkeypatch):
    from weft.operators import merge

    written = []
    keep = merge.materialize
    monkeypatch.setattr(merge, "materialize", lambda df, name="table": written.append(name) or keep(df, name))
    merge_graph(diamond(spark)).collect()
    assert written == ["c"]


def test_paths_to_tables_that_are_as_near(spark):
    g = diamond(spark)
    more = (*g.relations, Relation("a", "b", ("ka",), ("kb",), "many_to_one"))
    steps = lambda branch: {(s, steps(c)) if c.joined else s for _, s, c in branch.joined} and tuple(
        (s, steps(c)) if c.joined else s for _, s, c in branch.joined)
    assert steps(branches(more, "main")) == (("a", (("c", ("d",)),)), ("b", (("c", ("d",)),)))
    assert steps(branches(more, "main", "all")) == (("a", (("c", ("d",)), ("b", (("c", ("d",)),)))), ("b", (("c", ("d",)),)))
    with pytest.raises(ValueError):
        branches(more, "main", "some")


def test_unions_of_any_length_ride_with_the_rows(spark):
    """Lists of tags of visits of people of a town: unions of unions, found from the main rows over a to-one relation."""
    homes = spark.createDataFrame([(1, "t1"), (2, "t2"), (3, None)], "id long, town string")
    towns = spark.createDataFrame([("t1", 1.0), ("t2", 2.0)], "town string, size double")
    people = spark.createDataFrame([("t1", "ann", 1), ("t1", "bob", 2), ("t2", "cat", 1)], "town string, who string, o int")
    visits = spark.createDataFrame([("ann", i, f"a{i},x", f"c{i % 3}") for i in range(5)] + [("bob", 1, "0", "c9"), ("cat", 1, "z,z", None)]
                                   + [("bob", 0, "b0,y", "c8")], "who string, o int, tags string, c string")
    g = TableSet(
        {"homes": homes, "towns": towns, "people": people, "visits": visits},
        {"homes": TableSpec({}), "towns": TableSpec({"size": NUM}), "people": TableSpec({}, order=("o",)),
         "visits": TableSpec({"tags": MULTI_CAT, "c": CAT}, order=("o",))},
        (Relation("homes", "towns", ("town",), ("town",), "many_to_one"), Relation("towns", "people", ("town",), ("town",), "one_to_many"),
         Relation("people", "visits", ("who",), ("who",), "one_to_many")), main="homes", row_id="id")
    for piece_rows in (2, 10_000):
        m = merge_with_unions(g, piece_rows=piece_rows)

        def whole(name, m=m):
            out = {}
            for r in sorted(m.unions[name].of(m.rows, "id").collect()):
                out.setdefault(r["id"], []).append(r["text"])
            return {i: ",".join(t) for i, t in out.items()}, max(len(t) for t in out.values())

        texts, most = whole("visits__union__union__tags")
        assert texts == {1: "a0,x,a1,x,a2,x,a3,x,a4,x,b0,y", 2: "z,z"}
        assert (most > 1) == (piece_rows == 2)
        assert whole("visits__union__union__c")[0] == {1: "c0,c1,c2,c8,c9", 2: "0"}
        assert whole("visits__last__union__tags")[0] == {1: "b0,y", 2: "z,z"}
        assert whole("visits__union__last__tags")[0] == {1: "a4,x,b0,y", 2: "z,z"}
        assert {r["id"]: r["visits__union_pieces__union__tags"] for r in m.rows.collect()} == {1: most, 2: 1, 3: -1}
    flat = merge_graph(g, unions="pieces")
    assert not [c for c in flat.columns if c.startswith("_")] and flat.count() == 3


def test_reverse_relations_and_depths(spark):
    r = Relation("orders", "lines", ("a",), ("b",), "one_to_many")
    assert r.flipped() == Relation("lines", "orders", ("b",), ("a",), "many_to_one") and r.to_many
    assert depths((r, Relation("parts", "lines", ("p",), ("p",), "one_to_many")), "orders") == {
        "orders": 0, "lines": 1, "parts": 2}


@pytest.mark.parametrize("bad", [
    lambda s: Relation("a", "b", ("k",), ("k",), "one_to_lots"),
    lambda s: Relation("a", "b", ("k",), (), "one_to_many"),
    lambda s: TableSet({"a": s.range(1)}, {}, (), main="b", row_id="id"),
    lambda s: TableSet({"a": s.range(1)}, {"a": TableSpec({"x": NUM})}, (), main="a", row_id="id"),
    lambda s: TableSet({"a": s.range(1)}, {"a": TableSpec({"id": "number"})}, (), main="a", row_id="id"),
])
def test_bad_configurations_are_refused(spark, bad):
    with pytest.raises(ValueError):
        bad(spark)


def test_pieces_of_a_long_union(spark):
    rows = [("h", i, "ab", 1) for i in range(100)] + [("h", 200, "cd", 1)] * 37 + [("s", 1, "x", 1), ("s", 2, "yz", 1)]
    df = spark.createDataFrame(rows, "k string, o int, m string, z int").repartition(8)
    got = {(r["k"], r["piece"]): r["text"] for r in A.list_union_pieces(df, ["k"], "m", ["o"], 10, buckets=8).collect()}
    whole = ",".join(got["h", i] for i in range(14))
    assert whole == ",".join(["ab"] * 100 + ["cd"] * 37) and len(got) == 15
    assert all(len(got["h", i].split(",")) == 10 for i in range(13)) and got["s", 0] == "yz"
    with pytest.raises(Exception, match="more than one piece"):
        A.whole_text(A.list_union_pieces(df, ["k"], "m", ["o"], 10), ["k"], "u").collect()


def test_pieces_of_distinct_values(spark):
    df = spark.createDataFrame([("h", f"{i % 25:02d}") for i in range(200)] + [("n", None)], "k string, c string")
    got = {(r["k"], r["piece"]): r["text"] for r in A.cat_union_pieces(df, ["k"], "c", 10, buckets=4).collect()}
    assert ",".join(got["h", i] for i in range(3)) == ",".join(f"{i:02d}" for i in range(25))
    assert got["n", 0] == "0"


def test_last_with_equal_order_takes_the_largest_value(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", 1, None)], "k string, o int, c string")
    got = dict(df.groupBy("k").agg(A.cat_last("c", ["o"])).collect())
    assert got == {"a": "y", "b": "0"}


def test_asof_fills_each_column_and_prefers_the_same_time(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, "a", 7)], "id long, k string, t int")
    right = spark.createDataFrame([(9, "a", 5, 1.0, None), (8, "a", 3, 2.0, 20.0), (7, "a", 6, None, 30.0)],
                                  "id long, k string, t int, x double, y double")
    for buckets in (1, 3, 7):
        got = {r["id"]: (r["asof__x"], r["asof__y"])
               for r in asof_join(left, right, "k", "t", "id", ["x", "y"], right_id="id", buckets=buckets).collect()}
        assert got == {1: (1.0, 20.0), 2: (None, None), 3: (None, None), 4: (1.0, 30.0)}
        twice = right.drop("id").union(right.drop("id"))
        assert got == {r["id"]: (r["asof__x"], r["asof__y"])
                       for r in asof_join(left, twice, "k", "t", "id", ["x", "y"], buckets=buckets).collect()}
        roll = {r["id"]: r["roll5__sum__x"]
                for r in asof_rolling(left, right, "k", "t", "id", ["x"], right_id="id", buckets=buckets).collect()}
        assert roll == {1: 3.0, 2: None, 3: None, 4: 3.0}


def test_merging_as_of_sees_no_later_rows(spark):
    main = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 2)), (2, "a", dt.datetime(2024, 1, 5)),
                                  (3, "b", dt.datetime(2024, 1, 5))], "id long, k string, t timestamp_ntz")
    side = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1.0, "x"), ("a", dt.datetime(2024, 1, 3), 9.0, "y"),
                                  ("a", dt.datetime(2024, 1, 9), 99.0, "z")],
                                 "k string, t timestamp_ntz, v double, c string")
    g = TableSet({"main": main, "log": side}, {"main": TableSpec({"k": CAT, "t": TIME}, keys=("k",)),
                                               "log": TableSpec({"v": NUM, "c": CAT, "t": TIME}, order=("t",))},
                 (Relation("main", "log", ("k",), ("k",), "one_to_many"),), main="main", row_id="id", time_col="t")
    r = by_id(merge_graph(g, as_of=True))
    assert [(r[i]["log__asof__v"], r[i]["log__asof__c"]) for i in (1, 2, 3)] == [(1.0, "x"), (9.0, "y"), (-1.0, "0")]
    m = merge_graph(g, times=True)
    assert by_id(m)[1]["log__latest__t"] == dt.datetime(2024, 1, 9) and by_id(m)[1]["log__sum__v"] == 109.0
    assert columns_of(m, TIME) == ["t", "log__first__t", "log__latest__t"]


def test_split_union_and_projection(spark):
    g = graph(spark)
    main = g.tables["main"]
    both = union_split(main.where("id < 3"), main.where("id >= 3").drop("label"))
    assert both.where("split = 'test' and label is not null").count() == 0
    assert take_split(both, "train").count() == 2 and both.count() == 4
    plan = plan_of(project(merge_graph(g, unions="none"), ["table_1__sum__x"], ["id"]))
    assert "last" not in plan and "Python" not in plan


def test_csv_sources_and_score_sink(spark, tmp_path):
    path = str(tmp_path / "labels")
    spark.createDataFrame([(1, 0), (2, 1)], "row_id long, label int").write.csv(path, header=True)
    assert sorted(read_labels(spark, path).collect()) == [(1, 0), (2, 1)]
    assert read_csv_table(spark, path, "row_id bigint, label int").schema.simpleString() == (
        "struct<row_id:bigint,label:int>")
    out = str(tmp_path / "scores")
    write_scores(spark.range(5).select("id", (F.col("id") / 5).alias("score"), F.lit(1).alias("x")), out, "id")
    back = spark.read.parquet(out)
    assert back.columns == ["id", "score"] and back.count() == 5


def _sides(spark):
    left = spark.createDataFrame([(i, i % 7 if i % 5 else None) for i in range(60)], "id long, k long")
    rows = [(i % 9 if i % 11 else None, i, None if i % 4 == 0 else f"c{i % 3}", i % 5 if i % 6 else None,
             ("0", None, f"a{i % 4},b", "q,r")[i % 4]) for i in range(300)]
    right = tag_table(spark.createDataFrame(rows, "rk long, at int, c string, n long, l string"), "side",
                      TableSpec({"c": CAT, "n": CAT, "l": MULTI_CAT, "at": NUM}))
    return left, right


@pytest.mark.parametrize("unions", ["length", "pieces"])
def test_hot_keys_in_steps_give_what_the_others_give_at_once(spark, unions):
    left, right = _sides(spark)
    out = [join_with_unions(left, right, ["k"], ["rk"], "side", ["at"], unions, broadcast_keys=0, hot_rows=n, piece_rows=2)
           for n in (10**9, 33, 1)]
    rows = [sorted(m.rows.collect(), key=lambda r: r["id"]) for m in out]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 60
    for c in out[0].unions:
        texts = [sorted(map(tuple, m.unions[c].of(m.rows, "id").collect())) for m in out]
        assert texts[0] == texts[1] == texts[2] and texts[0]


def test_side_rows_move_once(spark):
    left, right = _sides(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan_of(join_to_many(left, right, ["k"], ["rk"], "side", ["at"], broadcast_keys=0)).count("Exchange ") == 2
        table = right.dropna(subset=["rk"]).groupBy("rk").agg(F.max("at").alias("top"))
        table = tag_table(table, "t", TableSpec({"top": NUM}))
        placed = left.repartition("k")
        one = join_to_one(placed, table, ["k"], ["rk"], "t", broadcast_keys=0, measured=left)
        assert plan_of(one).count("Exchange ") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tasks_of_union_pieces_grow_in_number_with_the_rows(spark, monkeypatch):
    _, right = _sides(spark)

    def pieces(n_rows):
        return A.pieces_by_key(right, ["rk"], ["c", "n"], ["l"], ["at"], 2, n_rows)

    monkeypatch.setattr(skew, "TASK_VALUES", 60)
    many = re.findall(r"hashpartitioning\(rk#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan_of(pieces(300)))
    assert many and int(many[0]) >= 300 * 3 // 60 and "REPARTITION_BY_NUM" not in plan_of(pieces(30))
    rows = [sorted(map(tuple, pieces(n).collect()), key=str) for n in (0, 300)]
    assert rows[0] == rows[1] and rows[0]


def test_to_one_null_key_still_meets_null(spark):
    left, right = _sides(spark)
    table = tag_table(right.groupBy("rk").agg({"at": "max"}).withColumnRenamed("max(at)", "top"), "t", TableSpec({"top": NUM}))
    got = {r["k"]: r["t__top"] for r in join_to_one(left, table, ["k"], ["rk"], "t", broadcast_keys=0).collect()}
    assert got == {r["rk"]: r["top"] for r in table.collect() if r["rk"] in got} and None in got

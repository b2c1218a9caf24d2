"""Counts, distinct counts, modes and group statistics on the rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.expressions import legacy_pair_value, time_parts, with_exprs
from weft.operators import candidates as C
from weft.operators.encode import encode_prefixes
from weft.operators.grouped import add_group_features, group_mean_deviation
from weft.operators.merge import join_to_one, merge_graph
from weft.operators.ordered import OrderedRows
from weft.operators.pairs import PairFeature, PairState, add_pair_features
from weft.queries import fixtures as X
from weft.sources.tables import CAT, columns_of, tag_table
from weft.sources.workspace import shared_folder

ROW = ["o_orderkey"]


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    return merge_graph(X.customer_graph(spark, sf))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with their part."""
    spec = X.ORDER_SPECS
    return join_to_one(tag_table(X.lineitem(spark, sf), "lineitem", spec["lineitem"]),
                       tag_table(X.part(spark, sf), "part", spec["part"]), ["l_partkey"], ["p_partkey"], "part",
                       spread=["l_orderkey", "l_linenumber", "l_shipdate"])


_LINES_SQL = f"""SELECT l.*, p_brand AS part__p_brand, p_type AS part__p_type, p_names AS part__p_names,
 p_size AS part__p_size, p_retailprice AS part__p_retailprice
 FROM ({X.LINEITEM_SQL}) l LEFT JOIN ({X.PART_SQL}) p ON l_partkey = p_partkey"""

LINE_ROW = ["l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice"]


def group_num_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Sum, mean, variance, maximum and minimum of every numeric column per customer, on every order."""
    m = _merged(spark, sf)
    stats = C.key_num_stats(m, X.customer_graph(spark, sf).relations)
    out = add_group_features(m, stats, ROW)
    # variances in units of 10^6, so that rounding is finer than the values and coarser than the noise
    names = {f.name: F.coalesce(F.round(F.col(f.name) / 1e6, 3) if f.fn == "var" else F.col(f.name), F.lit(-1.0))
             for f in stats}
    return out.select("o_orderkey", *[e.alias(n) for n, e in names.items()])


def _stats_sql(key: str, cols: Sequence[str]) -> str:
    out = []
    for c in cols:
        for s, fn in (("sum", "sum"), ("mean", "avg"), ("max", "max"), ("min", "min")):
            out.append(f"{fn}({c}) OVER (PARTITION BY {key}) AS {s}__{key}__{c}")
        out.append(f"coalesce(round(var_samp({c}) OVER (PARTITION BY {key}) / 1e6, 3), -1) AS var__{key}__{c}")
    return ", ".join(out)


def group_mean_dev(spark: SparkSession, sf: str) -> DataFrame:
    o = X.orders(spark, sf).select("o_orderkey", "o_orderpriority", "o_totalprice")
    return group_mean_deviation(o, "o_orderpriority", ["o_totalprice"], ROW)


def count_enc(spark: SparkSession, sf: str) -> DataFrame:
    """Frequency of each order's time parts and categories."""
    m = _merged(spark, sf)
    parts = time_parts("o_orderdate")
    wide = with_exprs(m, parts)
    feats = C.count_encodings([*parts, *columns_of(m, CAT)])
    return add_group_features(wide, feats, ROW).select("o_orderkey", *[f.name for f in feats])


def count_enc_mv(spark: SparkSession, sf: str) -> DataFrame:
    """Frequency of each part's encoded tag prefixes."""
    coded = encode_prefixes(X.tags(spark, sf), ["p_tags"], spread=["p_partkey"])
    feats = C.count_encodings(["p_tags_code1", "p_tags_code2", "p_tags_code3"])
    return add_group_features(coded, feats, ["p_partkey"]).select("p_partkey", *[f.name for f in feats])


def pair_count_key(spark: SparkSession, sf: str) -> DataFrame:
    m = _merged(spark, sf)
    feats = C.pair_counts(C.key_column_pairs(m, X.customer_graph(spark, sf).relations))
    return add_group_features(m, feats, ROW).select("o_orderkey", *[f.name for f in feats])


def pair_nunique_key(spark: SparkSession, sf: str) -> DataFrame:
    m = _merged(spark, sf)
    feats = C.pair_nuniques(C.key_column_pairs(m, X.customer_graph(spark, sf).relations))
    return add_group_features(m, feats, ROW).select("o_orderkey", *[f.name for f in feats])


def group_mode_key(spark: SparkSession, sf: str) -> DataFrame:
    m = _merged(spark, sf)
    feats = C.pair_modes(C.key_column_pairs(m, X.customer_graph(spark, sf).relations))
    return add_group_features(m, feats, ROW).select("o_orderkey", *[f.name for f in feats])


def pair_count_all(spark: SparkSession, sf: str) -> DataFrame:
    m = _merged(spark, sf)
    feats = C.pair_counts(C.all_pairs(m))
    return add_group_features(m, feats, ROW).select("o_orderkey", *[f.name for f in feats])


def pair_count_table(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf)
    feats = C.pair_counts(C.same_table_pairs(lines))
    return add_group_features(lines, feats, LINE_ROW).select("l_orderkey", "l_linenumber", *[f.name for f in feats])


def pair_count_main(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf)
    feats = C.pair_counts(C.main_pairs(lines, "lineitem"))
    return add_group_features(lines, feats, LINE_ROW).select("l_orderkey", "l_linenumber", *[f.name for f in feats])


def pair_count_cross(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf)
    feats = C.pair_counts(C.cross_table_pairs(lines, X.ORDER_RELATIONS, "lineitem"))
    return add_group_features(lines, feats, LINE_ROW).select("l_orderkey", "l_linenumber", *[f.name for f in feats])


def pair_count_mv(spark: SparkSession, sf: str) -> DataFrame:
    """Pair counts of two encoded multi-category columns."""
    tags = X.tags(spark, sf).join(X.part(spark, sf).select("p_partkey", "p_names"), "p_partkey")
    coded = encode_prefixes(tags, ["p_tags", "p_names"], (3,), ["p_partkey"])
    feats = C.pair_counts([("p_tags_code3", "p_names_code3")])
    return add_group_features(coded, feats, ["p_partkey"]).select("p_partkey", *[f.name for f in feats])


def triple_count(spark: SparkSession, sf: str) -> DataFrame:
    e = X.events(spark, sf)
    parts = {n: p for n, p in time_parts("ts").items() if "hour" in n}
    feats = C.time_key_counts(list(parts), ["user_id", "event_type"])
    return add_group_features(with_exprs(e, parts), feats, ["event_id"]).select(
        "event_id", *[f.name for f in feats])


def fe_pair_key(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per exact pair, beside the one-number form of the pair."""
    lines = X.lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice",
                                         "l_quantity", "l_tax")
    out = add_group_features(lines, C.pair_counts([("l_quantity", "l_tax")]), LINE_ROW)
    return out.select("l_orderkey", "l_linenumber", "cnt__l_quantity__l_tax",
                      F.round(legacy_pair_value(F.col("l_tax"), F.col("l_quantity")), 9).alias("pair_value"))


def _pairs(spark: SparkSession, sf: str, features: Sequence[PairFeature]) -> DataFrame:
    return add_pair_features(_merged(spark, sf), features, ROW).select("o_orderkey", *[f.name for f in features])


_A, _B, _C = "o_orderpriority", "customer__c_mktsegment", "customer__c_nationkey"


def fe_count(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf, [PairFeature("count", _A), PairFeature("count", _A, _C)])


def fe_nunique(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf, [PairFeature("nunique", _C, _B), PairFeature("nunique", "o_custkey", _A)])


def fe_count_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf, [PairFeature("ratio", _A, _B), PairFeature("ratio", _B, _A)])


def fe_count_per_nunique(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf, [PairFeature("per_nunique", _C, _B), PairFeature("per_nunique", "o_custkey", _A)])


FE_LIST = (PairFeature("count", _A, _B), PairFeature("ratio", _B, _C), PairFeature("per_nunique", _C, _A),
           PairFeature("nunique", _C, "o_custkey"))


def fe_transform(spark: SparkSession, sf: str) -> DataFrame:
    """One accepted list with a feature of every kind, recomputed on the rows."""
    return _pairs(spark, sf, FE_LIST)


#: Orders before this date are what the state is fitted on.
REPLAY_CUT = "1999-01-01"


def fe_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Features fitted on the early orders, saved, loaded, and put on all orders in two batches."""
    m = _merged(spark, sf)
    path = f"{shared_folder(spark)}/weft/pair-state-{uuid.uuid4().hex}"
    PairState.fit(m.where(F.col("o_orderdate") < F.lit(REPLAY_CUT)), FE_LIST).save(path)
    state = PairState.load(spark, path)
    odd, even = (state.transform(m.where(F.col("o_orderkey") % 2 == part)) for part in (1, 0))
    return odd.unionByName(even).select("o_orderkey", *[f.name for f in FE_LIST])


def _replay_sql() -> str:
    """Counts over the early orders, 0 for values that they do not have."""
    early = f"e AS (SELECT * FROM m WHERE o_orderdate < TIMESTAMP '{REPLAY_CUT} 00:00:00')"
    ctes, joins, cols = [_M, early], "", ["m.o_orderkey"]
    for i, f in enumerate(FE_LIST):
        a, b = f.a, f.b
        if f.kind in ("nunique", "per_nunique"):
            ctes.append(f"t{i} AS (SELECT {a}, count(*) AS n, count(DISTINCT {b}) AS u FROM e GROUP BY {a})")
            joins += f" LEFT JOIN t{i} ON m.{a} IS NOT DISTINCT FROM t{i}.{a}"
            value = f"coalesce(t{i}.u, 0)"
            cols.append((f"CAST({value} AS DOUBLE)" if f.kind == "nunique"
                         else f"coalesce(t{i}.n, 0) / ({value} + CAST(0.01 AS DOUBLE))") + f" AS {f.name}")
            continue
        ctes.append(f"t{i} AS (SELECT {a}, count(*) AS n FROM e GROUP BY {a})")
        joins += f" LEFT JOIN t{i} ON m.{a} IS NOT DISTINCT FROM t{i}.{a}"
        if b is None:
            cols.append(f"CAST(coalesce(t{i}.n, 0) AS DOUBLE) AS {f.name}")
            continue
        ctes.append(f"p{i} AS (SELECT {a}, {b}, count(*) AS n FROM e GROUP BY {a}, {b})")
        joins += f" LEFT JOIN p{i} ON m.{a} IS NOT DISTINCT FROM p{i}.{a} AND m.{b} IS NOT DISTINCT FROM p{i}.{b}"
        pair = f"coalesce(p{i}.n, 0)"
        cols.append((f"CAST({pair} AS DOUBLE)" if f.kind == "count"
                     else f"{pair} / (coalesce(t{i}.n, 0) + CAST(0.01 AS DOUBLE))") + f" AS {f.name}")
    return f"WITH {', '.join(ctes)} SELECT {', '.join(cols)} FROM m{joins}"


def fe_cumcount(spark: SparkSession, sf: str) -> DataFrame:
    """Position of each order among those of its priority, by row id: five long groups."""
    o = X.orders(spark, sf).select("o_orderkey", "o_orderpriority")
    return OrderedRows(o, ["o_orderpriority"], ["o_orderkey"]).row_number("cumcount").withColumn(
        "cumcount", F.col("cumcount").cast("double"))


_M = f"m AS ({X.CUSTOMER_MERGED_SQL})"
_L = f"l AS ({_LINES_SQL})"
_CATS = ("o_custkey", "o_orderpriority", "customer__c_nationkey", "customer__c_mktsegment", "nation__n_name")


def _cnt(*keys: str) -> str:
    return f"count(*) OVER (PARTITION BY {', '.join(keys)}) AS cnt__{'__'.join(keys)}"


def _nunique(k: str, c: str) -> str:
    """Join-back of a distinct count; DuckDB allows it as a window."""
    return f"count(DISTINCT {c}) OVER (PARTITION BY {k})"


_KEY_PAIRS = [("o_custkey", c) for c in ("o_orderpriority", "customer__c_nationkey", "customer__c_mktsegment")]
_PLAIN = [c for c in _CATS if c not in ("o_custkey", "customer__c_nationkey")]


def _sql_of(f: PairFeature) -> str:
    a, b = f.a, f.b
    n_a = f"count(*) OVER (PARTITION BY {a})"
    n_ab = f"count(*) OVER (PARTITION BY {a}, {b})"
    e = {"count": f"CAST({n_ab if b else n_a} AS DOUBLE)", "ratio": f"{n_ab} / ({n_a} + CAST(0.01 AS DOUBLE))",
         "per_nunique": f"{n_a} / ({_nunique(a, b)} + CAST(0.01 AS DOUBLE))",
         "nunique": f"CAST({_nunique(a, b)} AS DOUBLE)"}[f.kind]
    return f"{e} AS {f.name}"


def _fe_sql(features: Sequence[PairFeature]) -> str:
    return f"WITH {_M} SELECT o_orderkey, {', '.join(map(_sql_of, features))} FROM m"


def _mode_sql() -> str:
    ctes, joins, cols = [_M], "", ["m.o_orderkey"]
    for i, (k, c) in enumerate(_KEY_PAIRS):
        ctes.append(f"f{i} AS (SELECT {k}, {c}, row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, {c}) AS r"
                    f" FROM m GROUP BY {k}, {c})")
        joins += f" LEFT JOIN f{i} ON m.{k} = f{i}.{k} AND f{i}.r = 1"
        cols.append(f"f{i}.{c} AS mode__{k}__{c}")
    return f"WITH {', '.join(ctes)} SELECT {', '.join(cols)} FROM m{joins}"


def _prefix_sql(c: str, k: int) -> str:
    return f"array_to_string(list_slice(string_split({c}, ','), 1, {k}), ',')"


_HOURS = {
    "ts_hour": "hour(ts)",
    "ts_day_and_hour": "CAST(CAST(day(ts) AS VARCHAR) || CAST(hour(ts) AS VARCHAR) AS INTEGER)",
    "ts_day_of_week_and_hour": "CAST(CAST(isodow(ts) - 1 AS VARCHAR) || CAST(hour(ts) AS VARCHAR) AS INTEGER)",
    "ts_day_hour": "day(ts) * 100 + hour(ts)",
}

_ORDER_PARTS = {"o_orderdate_day": "day(o_orderdate)", "o_orderdate_day_of_week": "isodow(o_orderdate) - 1"} | {
    n.replace("ts_", "o_orderdate_", 1): e.replace("(ts)", "(o_orderdate)") for n, e in _HOURS.items()}

QUERIES = {
    "group_num_stats": (group_num_stats, f"WITH {_M} SELECT o_orderkey, "
                        + _stats_sql("o_custkey", ["o_totalprice", "customer__c_acctbal"]) + " FROM m"),
    "group_mean_dev": (group_mean_dev, f"""SELECT o_orderkey, o_orderpriority, o_totalprice,
 avg(o_totalprice) OVER w AS mean__o_orderpriority__o_totalprice,
 o_totalprice - avg(o_totalprice) OVER w AS dev__o_orderpriority__o_totalprice
 FROM ({X.ORDERS_SQL}) o WINDOW w AS (PARTITION BY o_orderpriority)"""),
    "count_enc": (count_enc, f"WITH {_M}, t AS (SELECT *, " + ", ".join(
        f"{e} AS {n}" for n, e in _ORDER_PARTS.items()) + " FROM m) SELECT o_orderkey, " + ", ".join(
        _cnt(c) for c in (*_ORDER_PARTS, *_CATS)) + " FROM t"),
    "count_enc_mv": (count_enc_mv, f"WITH t AS ({X.TAGS_SQL}) SELECT p_partkey, " + ", ".join(
        f"count(*) OVER (PARTITION BY {_prefix_sql('p_tags', k)}) AS cnt__p_tags_code{k}" for k in (1, 2, 3))
        + " FROM t"),
    "pair_count_key": (pair_count_key, f"WITH {_M} SELECT o_orderkey, "
                       + ", ".join(_cnt(k, c) for k, c in _KEY_PAIRS) + " FROM m"),
    "pair_nunique_key": (pair_nunique_key, f"WITH {_M} SELECT o_orderkey, " + ", ".join(
        f"{_nunique(k, c)} AS nunique__{k}__{c}" for k, c in _KEY_PAIRS) + " FROM m"),
    "group_mode_key": (group_mode_key, _mode_sql()),
    "pair_count_all": (pair_count_all, f"WITH {_M} SELECT o_orderkey, " + ", ".join(
        _cnt(a, b) for i, a in enumerate(_PLAIN) for b in _PLAIN[i + 1:]) + " FROM m"),
    "pair_count_table": (pair_count_table, f"""WITH {_L} SELECT l_orderkey, l_linenumber,
 {_cnt('l_returnflag', 'l_linestatus')}, {_cnt('part__p_brand', 'part__p_type')} FROM l"""),
    "pair_count_main": (pair_count_main, f"""WITH {_L} SELECT l_orderkey, l_linenumber,
 {_cnt('l_returnflag', 'l_linestatus')} FROM l"""),
    "pair_count_cross": (pair_count_cross, f"WITH {_L} SELECT l_orderkey, l_linenumber, " + ", ".join(
        _cnt(a, b) for a in ("l_returnflag", "l_linestatus") for b in ("part__p_brand", "part__p_type")) + " FROM l"),
    "pair_count_mv": (pair_count_mv, f"""WITH t AS ({X.TAGS_SQL}), p AS ({X.PART_SQL})
 SELECT p_partkey, count(*) OVER (PARTITION BY {_prefix_sql('p_tags', 3)}, {_prefix_sql('p_names', 3)})
 AS cnt__p_tags_code3__p_names_code3 FROM t JOIN p USING (p_partkey)"""),
    "triple_count": (triple_count, f"WITH e AS ({X.EVENTS_SQL}) SELECT event_id, " + ", ".join(
        f"count(*) OVER (PARTITION BY {e}, user_id, event_type) AS cnt__{n}__user_id__event_type"
        for n, e in _HOURS.items()) + " FROM e"),
    "fe_pair_key": (fe_pair_key, f"""WITH l AS ({X.LINEITEM_SQL}) SELECT l_orderkey, l_linenumber,
 {_cnt('l_quantity', 'l_tax')},
 round(((l_tax % l_quantity) + l_quantity) % l_quantity + l_tax * l_quantity + l_tax / l_quantity, 9) AS pair_value
 FROM l"""),
    "fe_count": (fe_count, _fe_sql([PairFeature("count", _A), PairFeature("count", _A, _C)])),
    "fe_nunique": (fe_nunique, _fe_sql([PairFeature("nunique", _C, _B), PairFeature("nunique", "o_custkey", _A)])),
    "fe_count_ratio": (fe_count_ratio, _fe_sql([PairFeature("ratio", _A, _B), PairFeature("ratio", _B, _A)])),
    "fe_count_per_nunique": (fe_count_per_nunique, _fe_sql(
        [PairFeature("per_nunique", _C, _B), PairFeature("per_nunique", "o_custkey", _A)])),
    "fe_transform": (fe_transform, _fe_sql(FE_LIST)),
    "fe_replay": (fe_replay, _replay_sql()),
    "fe_cumcount": (fe_cumcount, """SELECT o_orderkey, o_orderpriority, CAST(row_number() OVER
 (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS DOUBLE) AS cumcount FROM orders"""),
}

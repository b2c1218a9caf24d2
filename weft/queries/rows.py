"""Row-level features, codes and operators along an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import expressions as E
from weft.operators.encode import apply_codes, code_table, combination_codes, encode_prefixes
from weft.operators.merge import join_to_one, merge_graph
from weft.operators.ordered import OrderedRows, trailing_sum
from weft.queries import fixtures as X
from weft.sources.tables import MULTI_CAT, NUM, TIME, TableSpec, columns_of, table_of, tag_table

EVENT_COLUMNS = ("event_id", "ts", "user_id", "value", "k")


def time_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of the event time."""
    e = X.events(spark, sf).select("event_id", "ts")
    return E.with_exprs(e, E.time_parts("ts")).drop("ts")


def _lines_with_order(spark: SparkSession, sf: str) -> DataFrame:
    o = tag_table(X.orders(spark, sf), "orders", TableSpec({"o_orderdate": TIME}))
    return join_to_one(X.lineitem(spark, sf), o, ["l_orderkey"], ["o_orderkey"], "orders",
                       spread=["l_partkey", "l_linenumber", "l_shipdate"])


def time_diff(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines_with_order(spark, sf).select("l_orderkey", "l_linenumber", "l_shipdate", "orders__o_orderdate")
    return E.with_exprs(lines, E.time_differences(["l_shipdate", "orders__o_orderdate"]))


def time_diff_events(spark: SparkSession, sf: str) -> DataFrame:
    """Differences with a time of day in them, of both signs."""
    e = X.events(spark, sf).select("event_id", "ts", F.to_timestamp_ntz(F.lit("2024-01-15 08:30:00")).alias("noon"))
    return E.with_exprs(e, E.time_differences(["ts", "noon"])).drop("ts", "noon")


def rate_by_days(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines_with_order(spark, sf)
    days = E.days_between(F.col("l_shipdate"), F.col("orders__o_orderdate"))
    return lines.select("l_orderkey", "l_linenumber", *[e.alias(n) for n, e in E.rates(
        {"l_quantity": F.col("l_quantity"), "l_extendedprice": F.col("l_extendedprice")}, days).items()])


def rate_by_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """All numbers and list sizes of two tables with two times each, per day between the times."""
    lines = X.lineitem(spark, sf)
    o = X.orders(spark, sf).select("o_orderkey", "o_totalprice", F.col("o_orderdate").alias("ordered"),
                                   F.timestamp_add("DAY", F.col("o_orderkey") % 3, F.col("o_orderdate")).alias("confirmed"))
    p = X.part(spark, sf).select("p_partkey", "p_names", "p_size")
    wide = lines.join(p, lines.l_partkey == p.p_partkey, "left").join(
        o.select(F.col("o_orderkey").alias("k"), "ordered"), F.col("l_orderkey") == F.col("k"), "left")
    sent = tag_table(wide.select("l_orderkey", "l_linenumber", "l_shipdate", "ordered", "l_quantity", "l_extendedprice", "l_discount",
                                 "l_tax", "p_size", "p_names"), "sent", TableSpec(
        {"l_shipdate": TIME, "ordered": TIME, "p_names": MULTI_CAT} | {c: NUM for c in (
            "l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size")}))
    right = tag_table(o, "orders", TableSpec({"ordered": TIME, "confirmed": TIME, "o_totalprice": NUM}))
    both = join_to_one(sent, right, ["l_orderkey"], ["o_orderkey"], "orders", spread=["l_linenumber", "l_shipdate"],
                       measured=lines)
    return both.select("l_orderkey", "l_linenumber", *[e.alias(n) for n, e in E.rates_by_lineage(both).items()])


def row_sum(spark: SparkSession, sf: str) -> DataFrame:
    m = merge_graph(X.order_graph(spark, sf), unions="none")
    nums = columns_of(m, NUM)
    exprs = {f"sum__{t}": E.row_sum([c for c in nums if table_of(m, c) == t])
             for t in dict.fromkeys(table_of(m, c) for c in nums)}
    return m.select("o_orderkey", *[F.round(e, 6).alias(n) for n, e in exprs.items()])


def mean_center(spark: SparkSession, sf: str) -> DataFrame:
    o = X.orders(spark, sf)
    means = E.column_means(o, ["o_totalprice"])
    return o.select("o_orderkey", E.centered("o_totalprice", means["o_totalprice"]).alias("o_totalprice_centered"))


def minmax_scale(spark: SparkSession, sf: str) -> DataFrame:
    o = X.orders(spark, sf)
    lo, hi = E.column_ranges(o, ["o_totalprice"])["o_totalprice"]
    return o.select("o_orderkey", E.minmax_scale("o_totalprice", lo, hi).alias("o_totalprice_scaled"))


def mv_length(spark: SparkSession, sf: str) -> DataFrame:
    p = X.tags(spark, sf).join(X.part(spark, sf).select("p_partkey", "p_names"), "p_partkey")
    return E.with_exprs(p, E.list_lengths(["p_tags", "p_names"])).drop("p_tags", "p_names")


def mv_size(spark: SparkSession, sf: str) -> DataFrame:
    return X.tags(spark, sf).select("p_partkey", E.list_size("p_tags").alias("p_tags_size"))


def mv_prefix_code(spark: SparkSession, sf: str) -> DataFrame:
    return encode_prefixes(X.tags(spark, sf), ["p_tags"], spread=["p_partkey"])


def code_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Customer codes fitted on the training period; customers first seen later get -1."""
    o = X.orders(spark, sf).select("o_orderkey", "o_custkey", "o_orderdate")
    codes = code_table(o.where(F.col("o_orderdate") < F.lit("1993-01-01")), ["o_custkey"])
    return apply_codes(o, codes, {"o_custkey": "cust_code"}, ["o_orderkey"]).drop("o_orderdate")


def pair_code(spark: SparkSession, sf: str) -> DataFrame:
    o = X.orders(spark, sf).select("o_orderkey", "o_custkey", "o_orderpriority")
    return combination_codes(o, ["o_custkey", "o_orderpriority"], "pair_code", ["o_orderkey"])


def triple_code(spark: SparkSession, sf: str) -> DataFrame:
    e = X.events(spark, sf).select("event_id", "user_id", "event_type", F.hour("ts").alias("ts_hour"))
    return combination_codes(e, ["ts_hour", "user_id", "event_type"], "triple_code", ["event_id"])


def diff_global(spark: SparkSession, sf: str) -> DataFrame:
    e = X.events(spark, sf).select(*EVENT_COLUMNS)
    return OrderedRows(e, [], ["ts", "event_id"]).differences(["value", "k"]).drop("ts", "user_id")


def diff_by_key(spark: SparkSession, sf: str) -> DataFrame:
    e = X.events(spark, sf).select(*EVENT_COLUMNS)
    return OrderedRows(e, ["user_id"], ["ts", "event_id"]).differences(["value", "k"]).drop("ts", "user_id")


def rolling10(spark: SparkSession, sf: str) -> DataFrame:
    e = X.events(spark, sf).select(*EVENT_COLUMNS)
    return OrderedRows(e, [], ["ts", "event_id"]).rolling(["value", "k"], 10).drop("ts", "user_id")


def range_sum(spark: SparkSession, sf: str) -> DataFrame:
    e = X.events(spark, sf).select(*EVENT_COLUMNS)
    return trailing_sum(e, "ts", ["value", "k"], 120, spread=["event_id"]).drop("ts", "user_id")


def _days_sql(a: str, b: str) -> str:
    return f"CAST(floor((epoch_us({a}) - epoch_us({b})) / 8.64e10) AS BIGINT)"


def _hours_sql(a: str, b: str) -> str:
    return f"CAST(trunc((epoch_us({a}) - epoch_us({b})) / 3.6e9) AS BIGINT)"


def _diffs_sql(a: str, b: str) -> str:
    return ", ".join(f"{_days_sql(x, y)} AS {x}_minus_{y}_d, {_hours_sql(x, y)} AS {x}_minus_{y}_h"
                     for x, y in ((a, b), (b, a)))


_LO = f"""l AS (SELECT l.*, o_orderdate AS orders__o_orderdate FROM ({X.LINEITEM_SQL}) l
 LEFT JOIN orders ON l_orderkey = o_orderkey)"""


def _lag_sql(partition: str) -> str:
    cols = ", ".join(f"coalesce({c} - lag({c}, {k}) OVER w, 0) AS {c}_diff_{k}" for c in ("value", "k") for k in (1, 2))
    return f"""WITH e AS ({X.EVENTS_SQL}) SELECT event_id, value, k, {cols} FROM e
 WINDOW w AS ({partition} ORDER BY ts, event_id)"""


_P = "array_to_string(list_slice(string_split(p_tags, ','), 1, {k}), ',')"

QUERIES = {
    "time_parts": (time_parts, """SELECT event_id, CAST(day(ts) AS INTEGER) AS ts_day,
 CAST(isodow(ts) - 1 AS INTEGER) AS ts_day_of_week, CAST(hour(ts) AS INTEGER) AS ts_hour,
 CAST(CAST(day(ts) AS VARCHAR) || CAST(hour(ts) AS VARCHAR) AS INTEGER) AS ts_day_and_hour,
 CAST(CAST(isodow(ts) - 1 AS VARCHAR) || CAST(hour(ts) AS VARCHAR) AS INTEGER) AS ts_day_of_week_and_hour,
 CAST(day(ts) * 100 + hour(ts) AS INTEGER) AS ts_day_hour FROM events"""),
    "time_diff": (time_diff, f"""WITH {_LO} SELECT l_orderkey, l_linenumber, l_shipdate, orders__o_orderdate,
 {_diffs_sql('l_shipdate', 'orders__o_orderdate')} FROM l"""),
    "time_diff_events": (time_diff_events, f"""WITH e AS (SELECT event_id, ts,
 TIMESTAMP '2024-01-15 08:30:00' AS noon FROM events) SELECT event_id, {_diffs_sql('ts', 'noon')} FROM e"""),
    "rate_by_days": (rate_by_days, f"""WITH {_LO}, d AS (SELECT *,
 nullif({_days_sql('l_shipdate', 'orders__o_orderdate')}, 0) AS days FROM l)
 SELECT l_orderkey, l_linenumber, l_quantity / days AS l_quantity_per_day,
 l_extendedprice / days AS l_extendedprice_per_day FROM d"""),
    "rate_by_lineage": (rate_by_lineage, f"""WITH o AS (SELECT o_orderkey AS k, o_totalprice, o_orderdate AS ordered,
 o_orderdate + to_days(CAST(o_orderkey % 3 AS INTEGER)) AS confirmed FROM ({X.ORDERS_SQL})),
 w AS (SELECT l.*, p_size, p_names, o_totalprice, nullif({_days_sql('l_shipdate', 'ordered')}, 0) AS d,
  nullif({_days_sql('ordered', 'confirmed')}, 0) AS e FROM ({X.LINEITEM_SQL}) l
  LEFT JOIN ({X.PART_SQL}) ON l_partkey = p_partkey LEFT JOIN o ON l_orderkey = k)
 SELECT l_orderkey, l_linenumber, """ + ", ".join(
        f"{c} / d AS {c}_per_day_l_shipdate_minus_ordered" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size"))
        + """, len(string_split(p_names, ',')) / d AS p_names_size_per_day_l_shipdate_minus_ordered,
 o_totalprice / e AS orders__o_totalprice_per_day_orders__ordered_minus_orders__confirmed FROM w"""),
    "row_sum": (row_sum, f"WITH m AS ({X.MERGED_SQL}) SELECT o_orderkey, o_totalprice AS sum__orders, "
                "customer__c_acctbal AS sum__customer, " + ", ".join(f"round({' + '.join(
                    f'{t}__{fn}__{c}' for fn in ('mean', 'sum') for own, c in X._NUMS if own == t)}, 6) AS sum__{t}"
                    for t in ("lineitem", "part")) + " FROM m"),
    "mean_center": (mean_center, f"""SELECT o_orderkey, o_totalprice - avg(o_totalprice) OVER ()
 AS o_totalprice_centered FROM ({X.ORDERS_SQL}) o"""),
    "minmax_scale": (minmax_scale, f"""SELECT o_orderkey, (o_totalprice - min(o_totalprice) OVER ())
 / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()) * 100 AS o_totalprice_scaled FROM ({X.ORDERS_SQL}) o"""),
    "mv_length": (mv_length, f"""WITH t AS ({X.TAGS_SQL}), p AS ({X.PART_SQL}) SELECT p_partkey,
 CAST(length(p_tags) AS INTEGER) AS p_tags_length, CAST(length(p_names) AS INTEGER) AS p_names_length,
 CAST(length(p_tags) + length(p_names) AS INTEGER) AS mv_len_sum FROM t JOIN p USING (p_partkey)"""),
    "mv_size": (mv_size, f"""SELECT p_partkey, CAST(len(string_split(p_tags, ',')) AS INTEGER) AS p_tags_size
 FROM ({X.TAGS_SQL}) t"""),
    "mv_prefix_code": (mv_prefix_code, f"WITH t AS ({X.TAGS_SQL}) SELECT p_partkey, p_tags, " + ", ".join(
        f"dense_rank() OVER (ORDER BY {_P.format(k=k)}) AS p_tags_code{k}" for k in (1, 2, 3)) + " FROM t"),
    "code_apply": (code_apply, """WITH c AS (SELECT v, row_number() OVER (ORDER BY v) AS code FROM
 (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01 00:00:00'))
 SELECT o_orderkey, o_custkey, coalesce(code, -1) AS cust_code FROM orders LEFT JOIN c
 ON CAST(o_custkey AS VARCHAR) = v"""),
    "pair_code": (pair_code, """SELECT o_orderkey, o_custkey, o_orderpriority,
 dense_rank() OVER (ORDER BY o_custkey, o_orderpriority) AS pair_code FROM orders"""),
    "triple_code": (triple_code, """SELECT event_id, user_id, event_type, CAST(hour(ts) AS INTEGER) AS ts_hour,
 dense_rank() OVER (ORDER BY hour(ts), user_id, event_type) AS triple_code FROM events"""),
    "diff_global": (diff_global, _lag_sql("")),
    "diff_by_key": (diff_by_key, _lag_sql("PARTITION BY user_id")),
    "rolling10": (rolling10, f"WITH e AS ({X.EVENTS_SQL}) SELECT event_id, value, k, " + ", ".join(
        f"{fn}({c}) OVER w AS {c}_roll_{s}" for c in ("value", "k")
        for s, fn in (("mean", "avg"), ("max", "max"), ("min", "min")))
        + " FROM e WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"),
    "range_sum": (range_sum, f"WITH e AS ({X.EVENTS_SQL}) SELECT event_id, value, k, " + ", ".join(
        f"sum({c}) OVER w AS {c}_sum_120s" for c in ("value", "k"))
        + " FROM e WINDOW w AS (ORDER BY epoch_us(ts) RANGE BETWEEN 120000000 PRECEDING AND CURRENT ROW)"),
}

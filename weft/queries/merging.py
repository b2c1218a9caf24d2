"""Sources, cleaning, splits, joins and per-key aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import aggregate as A
from weft.operators.asof import asof_join, asof_rolling
from weft.operators.clean import clean_fill, project, take_split, union_split
from weft.operators.encode import encode
from weft.operators.merge import join_to_many, join_to_one, merge_graph, merge_with_unions
from weft.queries import fixtures as X
from weft.sources.tables import CAT, NUM, TIME, read_tables, tag_table, write_scores
from weft.sources.workspace import shared_folder

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Orders before this date are the training rows, the others the rows to score.
CUTOFF = "1999-01-01"


def scan_tables(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, df in read_tables(spark, sf, TABLES).items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return out


def _columns_sql() -> str:
    widths = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11,
              "events": 6}
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, {n} AS n_columns FROM {t}"
                              for t, n in widths.items())


def score_table(spark: SparkSession, sf: str) -> DataFrame:
    """Write scores and read them back."""
    import uuid

    path = f"{shared_folder(spark)}/weft/scores-{uuid.uuid4().hex}"
    scores = X.orders(spark, sf).select("o_orderkey", (F.col("o_totalprice") / F.lit(1e9)).alias("score"))
    write_scores(scores, path, "o_orderkey")
    return spark.read.schema(scores.schema).parquet(path)


def clean_fill_query(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without orders leave nulls of every kind."""
    kinds = {"o_totalprice": NUM, "o_orderpriority": CAT, "o_orderdate": TIME}
    c = X.read(spark, sf, "customer").select("c_custkey")
    o = X.orders(spark, sf)
    wide = c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", *kinds)
    return clean_fill(wide, kinds)


def union_split_query(spark: SparkSession, sf: str) -> DataFrame:
    o = X.orders(spark, sf)
    train = o.where(F.col("o_orderdate") < F.lit(CUTOFF))
    test = o.where(F.col("o_orderdate") >= F.lit(CUTOFF)).drop("label")
    return union_split(train, test)


def split_filter(spark: SparkSession, sf: str) -> DataFrame:
    return take_split(union_split_query(spark, sf), "train").drop("split")


def feature_project(spark: SparkSession, sf: str) -> DataFrame:
    """Two features out of the merged table; what feeds only the other columns is pruned."""
    return project(merge_graph(X.order_graph(spark, sf)), ["customer__c_acctbal", "lineitem__mean__l_quantity"],
                   ["o_orderkey"])


def join_to_one_query(spark: SparkSession, sf: str) -> DataFrame:
    right = tag_table(X.customer(spark, sf), "customer", X.ORDER_SPECS["customer"])
    return join_to_one(X.orders(spark, sf), right, ["o_custkey"], ["c_custkey"], "customer", spread=["o_orderkey"])


def join_to_many_query(spark: SparkSession, sf: str) -> DataFrame:
    spec = X.ORDER_SPECS["lineitem"]
    left = tag_table(X.orders(spark, sf), "orders", X.ORDER_SPECS["orders"])
    right = tag_table(X.lineitem(spark, sf), "lineitem", spec)
    return clean_fill(join_to_many(left, right, ["o_orderkey"], ["l_orderkey"], "lineitem", spec.order))


def merge_graph_query(spark: SparkSession, sf: str) -> DataFrame:
    return merge_graph(X.order_graph(spark, sf))


def merge_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with all that is related to them: two ways lead to nation and region, one of them by a table as near."""
    return merge_graph(X.line_graph(spark, sf), paths="all")


def merge_two_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Two relations to one table, which has one itself."""
    return merge_graph(X.trade_graph(spark, sf))


_UNIONS = ("lineitem__union__l_partkey", "lineitem__union__l_returnflag", "lineitem__union__l_linestatus",
           "part__union__p_brand", "part__union__p_type", "part__union__p_names")


def join_to_many_unions(spark: SparkSession, sf: str) -> DataFrame:
    """The unions of the merged orders with all their pieces, two elements each."""
    merged = merge_with_unions(X.order_graph(spark, sf), piece_rows=2)
    out = None
    for c in _UNIONS:
        one = merged.unions[c].of(merged.rows, "o_orderkey").withColumn("name", F.lit(c))
        out = one if out is None else out.unionByName(one)
    return out


def join_to_many_first_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The merged rows themselves: the first piece of each union and how many there are."""
    rows = merge_with_unions(X.order_graph(spark, sf), piece_rows=2).rows
    return rows.select("o_orderkey", *_UNIONS, *[c.replace("__union__", "__union_pieces__") for c in _UNIONS])


def _piece_sql(column: str) -> str:
    """Pieces of one union as SQL: distinct values in their order, lists in the order of the lines."""
    table, _, c = column.split("__")
    if c == "p_names":
        inner = f"SELECT l_orderkey AS k, {c} AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, {c}) AS r FROM l"
    else:
        inner = f"SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) AS r FROM (SELECT DISTINCT l_orderkey AS k, {c} AS v FROM l)"
    return (f"SELECT k AS o_orderkey, CAST((r - 1) // 2 AS INTEGER) AS piece, '{column}' AS name, "
            f"string_agg(CAST(v AS VARCHAR), ',' ORDER BY r) AS text FROM ({inner}) GROUP BY k, (r - 1) // 2")


_PIECES_SQL = f"""l AS (SELECT * FROM ({X.LINEITEM_SQL}) LEFT JOIN ({X.PART_SQL}) ON l_partkey = p_partkey),
 p AS ({' UNION ALL '.join(_piece_sql(c) for c in _UNIONS)})"""


def merge_fill_before(spark: SparkSession, sf: str) -> DataFrame:
    """Nulls filled before aggregation: the fills count in means and sums."""
    o = X.orders(spark, sf)
    g = X.order_graph(spark, sf)
    # cheap lines have no recorded quantity
    lines = X.lineitem(spark, sf).withColumn("l_quantity", F.when(F.col("l_quantity") >= 10, F.col("l_quantity")))
    wide = merge_graph(g.with_table("orders", o).with_table("lineitem", lines), fill="before")
    return wide.select("o_orderkey", "lineitem__mean__l_quantity", "lineitem__sum__l_quantity")


def asof_join_query(spark: SparkSession, sf: str) -> DataFrame:
    e = X.events(spark, sf)
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    views = e.where("event_type = 'view'").select("event_id", "user_id", "ts", "value", "k")
    return asof_join(clicks, views, "user_id", "ts", "event_id", ["value", "k"], right_id="event_id")


def asof_rolling5(spark: SparkSession, sf: str) -> DataFrame:
    e = X.events(spark, sf)
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    views = e.where("event_type = 'view'").select("event_id", "user_id", "ts", "value")
    return asof_rolling(clicks, views, "user_id", "ts", "event_id", ["value"], right_id="event_id")


def agg_num(spark: SparkSession, sf: str) -> DataFrame:
    return X.lineitem(spark, sf).groupBy("l_orderkey").agg(
        *A.num_aggs(["l_quantity", "l_extendedprice", "l_discount"]))


def agg_cat_last(spark: SparkSession, sf: str) -> DataFrame:
    return X.lineitem(spark, sf).groupBy("l_orderkey").agg(
        A.cat_last("l_returnflag", ["l_shipdate", "l_linenumber"]).alias("last__l_returnflag"),
        A.cat_last("l_partkey", ["l_shipdate", "l_linenumber"]).alias("last__l_partkey"))


def agg_cat_union(spark: SparkSession, sf: str) -> DataFrame:
    return A.cat_union_pieces(X.orders(spark, sf), ["o_custkey"], "o_orderpriority")


def _lines_with_names(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with the names of their part, rare cheap parts having the one-character list that is skipped."""
    parts = X.part(spark, sf).withColumn(
        "p_names", F.when(F.col("p_size") < 10, F.lit("0")).otherwise(F.col("p_names")))
    spec = X.ORDER_SPECS["part"]
    return join_to_one(X.lineitem(spark, sf), tag_table(parts, "part", spec), ["l_partkey"], ["p_partkey"], "part",
                       spread=["l_orderkey", "l_linenumber", "l_shipdate"])


_NAMES_SQL = f"""SELECT l.*, CASE WHEN p_size < 10 THEN '0' ELSE p_names END AS part__p_names
 FROM ({X.LINEITEM_SQL}) l LEFT JOIN ({X.PART_SQL}) p ON l.l_partkey = p.p_partkey"""


def agg_mv_last(spark: SparkSession, sf: str) -> DataFrame:
    return _lines_with_names(spark, sf).groupBy("l_orderkey").agg(
        A.list_last("part__p_names", ["l_shipdate", "l_linenumber"]).alias("last__p_names"))


def agg_mv_union(spark: SparkSession, sf: str) -> DataFrame:
    """Three groups of many rows each: the texts come in pieces."""
    return A.list_union_pieces(_lines_with_names(spark, sf), ["l_returnflag"], "part__p_names",
                               ["l_shipdate", "l_orderkey", "l_linenumber"], piece_rows=1_000)


def agg_union_length(spark: SparkSession, sf: str) -> DataFrame:
    return _lines_with_names(spark, sf).groupBy("l_orderkey").agg(
        A.list_union_length("part__p_names").alias("union_length__p_names"))


def agg_nunique(spark: SparkSession, sf: str) -> DataFrame:
    return X.lineitem(spark, sf).groupBy("l_orderkey").agg(
        *A.num_aggs(["l_partkey", "l_returnflag"], ["nunique"]))


def agg_std(spark: SparkSession, sf: str) -> DataFrame:
    d = X.lineitem(spark, sf).groupBy("l_orderkey").agg(*A.num_aggs(["l_quantity", "l_tax"], ["std", "mean"]))
    return d.select("l_orderkey", "mean__l_quantity", "mean__l_tax",
                    *[F.round(c, 6).alias(c) for c in ("std__l_quantity", "std__l_tax")])


def cat_code(spark: SparkSession, sf: str) -> DataFrame:
    o = X.orders(spark, sf).select("o_orderkey", "o_custkey", "o_orderpriority")
    return encode(o, {"o_orderpriority": "priority_code", "o_custkey": "cust_code"}, ["o_orderkey"])


QUERIES = {
    "scan_tables": (scan_tables, _columns_sql()),
    "score_table": (score_table, "SELECT o_orderkey, round(o_totalprice * 100) / 1e9 AS score FROM orders"),
    "clean_fill": (clean_fill_query, f"""SELECT c_custkey, coalesce(o_totalprice, -1) AS o_totalprice,
 coalesce(o_orderpriority, '0') AS o_orderpriority,
 coalesce(o_orderdate, TIMESTAMP '1970-01-01 00:00:00') AS o_orderdate
 FROM customer LEFT JOIN ({X.ORDERS_SQL}) o ON c_custkey = o_custkey"""),
    "union_split": (union_split_query, f"""SELECT *, 'train' AS split FROM ({X.ORDERS_SQL}) o
 WHERE o_orderdate < TIMESTAMP '{CUTOFF} 00:00:00' UNION ALL
 SELECT * REPLACE (CAST(NULL AS INTEGER) AS label), 'test' AS split FROM ({X.ORDERS_SQL}) o
 WHERE o_orderdate >= TIMESTAMP '{CUTOFF} 00:00:00'"""),
    "split_filter": (split_filter, f"""SELECT * FROM ({X.ORDERS_SQL}) o
 WHERE o_orderdate < TIMESTAMP '{CUTOFF} 00:00:00'"""),
    "feature_project": (feature_project, f"""WITH m AS ({X.MERGED_SQL})
 SELECT o_orderkey, customer__c_acctbal, lineitem__mean__l_quantity FROM m"""),
    "join_to_one": (join_to_one_query, f"""SELECT o.*, c_nationkey AS customer__c_nationkey,
 c_mktsegment AS customer__c_mktsegment, c_acctbal AS customer__c_acctbal
 FROM ({X.ORDERS_SQL}) o LEFT JOIN ({X.CUSTOMER_SQL}) c ON o_custkey = c_custkey"""),
    "join_to_many": (join_to_many_query, X.TO_MANY_SQL),
    "merge_graph": (merge_graph_query, X.MERGED_SQL),
    "merge_paths": (merge_paths, f"""SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_quantity,
 coalesce(o_orderpriority, '0') AS orders__o_orderpriority, coalesce(o_totalprice, -1) AS orders__o_totalprice,
 coalesce(o_orderdate, TIMESTAMP '1970-01-01 00:00:00') AS orders__o_orderdate,
 coalesce(c_nationkey, 0) AS customer__c_nationkey, coalesce(c_mktsegment, '0') AS customer__c_mktsegment,
 coalesce(c_acctbal, -1) AS customer__c_acctbal, coalesce(s_nationkey, 0) AS supplier__s_nationkey,
 coalesce(round(s_acctbal * 100), -1) AS supplier__s_acctbal,
 coalesce(n1.n_name, '0') AS orders__customer__nation__n_name, coalesce(r1.r_name, '0') AS orders__customer__nation__region__r_name,
 coalesce(n2.n_name, '0') AS supplier__nation__n_name, coalesce(r2.r_name, '0') AS supplier__nation__region__r_name
 FROM lineitem LEFT JOIN ({X.ORDERS_SQL}) ON l_orderkey = o_orderkey LEFT JOIN ({X.CUSTOMER_SQL}) ON o_custkey = c_custkey
 LEFT JOIN nation n1 ON c_nationkey = n1.n_nationkey LEFT JOIN region r1 ON n1.n_regionkey = r1.r_regionkey
 LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation n2 ON s_nationkey = n2.n_nationkey
 LEFT JOIN region r2 ON n2.n_regionkey = r2.r_regionkey"""),
    "merge_two_relations": (merge_two_relations, f"""WITH s AS (SELECT l_orderkey, s_nationkey FROM
 (SELECT l_orderkey, min(l_suppkey) AS k FROM lineitem GROUP BY l_orderkey) JOIN supplier ON k = s_suppkey),
 t AS (SELECT o_orderkey, CASE WHEN o_totalprice >= 1000000 THEN s_nationkey END AS origin, c_nationkey AS target, o_totalprice
  FROM ({X.ORDERS_SQL}) LEFT JOIN s ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey)
 SELECT o_orderkey, origin, target, o_totalprice, coalesce(n1.n_name, '0') AS origin__nation__n_name,
 coalesce(r1.r_name, '0') AS origin__nation__region__r_name, coalesce(n2.n_name, '0') AS target__nation__n_name,
 coalesce(r2.r_name, '0') AS target__nation__region__r_name FROM t
 LEFT JOIN nation n1 ON origin = n1.n_nationkey LEFT JOIN region r1 ON n1.n_regionkey = r1.r_regionkey
 LEFT JOIN nation n2 ON target = n2.n_nationkey LEFT JOIN region r2 ON n2.n_regionkey = r2.r_regionkey"""),
    "join_to_many_unions": (join_to_many_unions, f"WITH {_PIECES_SQL} SELECT o_orderkey, piece, text, name FROM p "
                            "WHERE o_orderkey IN (SELECT o_orderkey FROM orders)"),
    "join_to_many_first_pieces": (join_to_many_first_pieces, f"WITH {_PIECES_SQL} SELECT o.o_orderkey, " + ", ".join(
        f"coalesce(max(text) FILTER (name = '{c}' AND piece = 0), '0') AS {c}, "
        f"CAST(coalesce(max(piece) FILTER (name = '{c}') + 1, -1) AS BIGINT) AS {c.replace('__union__', '__union_pieces__')}"
        for c in _UNIONS) + " FROM orders o LEFT JOIN p ON o.o_orderkey = p.o_orderkey GROUP BY o.o_orderkey"),
    "merge_fill_before": (merge_fill_before, """WITH a AS (SELECT l_orderkey,
 avg(CASE WHEN l_quantity >= 10 THEN l_quantity ELSE -1 END) AS m,
 sum(CASE WHEN l_quantity >= 10 THEN l_quantity ELSE -1 END) AS s FROM lineitem GROUP BY l_orderkey)
 SELECT o_orderkey, coalesce(m, -1) AS lineitem__mean__l_quantity, coalesce(s, -1) AS lineitem__sum__l_quantity
 FROM orders LEFT JOIN a ON o_orderkey = l_orderkey"""),
    "asof_join": (asof_join_query, f"""WITH e AS ({X.EVENTS_SQL}),
 c AS (SELECT event_id, user_id, ts FROM e WHERE event_type = 'click'),
 v AS (SELECT user_id, ts, value, k FROM e WHERE event_type = 'view')
 SELECT c.event_id, c.user_id, c.ts, v.value AS asof__value, v.k AS asof__k
 FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts"""),
    "asof_rolling5": (asof_rolling5, f"""WITH e AS ({X.EVENTS_SQL}),
 t AS (SELECT event_id, user_id, ts, 0 AS side, value FROM e WHERE event_type = 'view'
  UNION ALL SELECT event_id, user_id, ts, 1, NULL FROM e WHERE event_type = 'click'),
 w AS (SELECT event_id, user_id, ts, side, avg(value) OVER r AS roll5__mean__value, sum(value) OVER r
  AS roll5__sum__value FROM t WINDOW r AS (PARTITION BY user_id ORDER BY ts, side, event_id
  ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
 SELECT event_id, user_id, ts, roll5__mean__value, roll5__sum__value FROM w WHERE side = 1"""),
    "agg_num": (agg_num, f"""SELECT l_orderkey, avg(l_quantity) AS mean__l_quantity,
 avg(l_extendedprice) AS mean__l_extendedprice, avg(l_discount) AS mean__l_discount,
 sum(l_quantity) AS sum__l_quantity, sum(l_extendedprice) AS sum__l_extendedprice,
 sum(l_discount) AS sum__l_discount FROM ({X.LINEITEM_SQL}) l GROUP BY l_orderkey"""),
    "agg_cat_last": (agg_cat_last, """SELECT l_orderkey,
 arg_max(l_returnflag, row(l_shipdate, l_linenumber, l_returnflag)) AS last__l_returnflag,
 CAST(arg_max(l_partkey, row(l_shipdate, l_linenumber, l_partkey)) AS VARCHAR) AS last__l_partkey
 FROM lineitem GROUP BY l_orderkey"""),
    "agg_cat_union": (agg_cat_union, """SELECT o_custkey, 0 AS piece,
 string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS text FROM orders GROUP BY o_custkey"""),
    "agg_mv_last": (agg_mv_last, f"""WITH l AS ({_NAMES_SQL}) SELECT l_orderkey,
 coalesce(arg_max(part__p_names, row(l_shipdate, l_linenumber, part__p_names))
  FILTER (WHERE length(part__p_names) <> 1), '0') AS last__p_names FROM l GROUP BY l_orderkey"""),
    "agg_mv_union": (agg_mv_union, f"""WITH l AS ({_NAMES_SQL}), p AS (SELECT l_returnflag, part__p_names AS t,
 row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, part__p_names) AS r
 FROM l WHERE length(part__p_names) <> 1)
 SELECT l_returnflag, CAST((r - 1) // 1000 AS INTEGER) AS piece, string_agg(t, ',' ORDER BY r) AS text
 FROM p GROUP BY l_returnflag, (r - 1) // 1000"""),
    "agg_union_length": (agg_union_length, f"""WITH l AS ({_NAMES_SQL}) SELECT l_orderkey,
 coalesce(length(string_agg(part__p_names, ',') FILTER (WHERE length(part__p_names) <> 1)), 1)
 AS union_length__p_names FROM l GROUP BY l_orderkey"""),
    "agg_nunique": (agg_nunique, """SELECT l_orderkey, count(DISTINCT l_partkey) AS nunique__l_partkey,
 count(DISTINCT l_returnflag) AS nunique__l_returnflag FROM lineitem GROUP BY l_orderkey"""),
    "agg_std": (agg_std, f"""SELECT l_orderkey, avg(l_quantity) AS mean__l_quantity, avg(l_tax) AS mean__l_tax,
 round(stddev_samp(l_quantity), 6) AS std__l_quantity, round(stddev_samp(l_tax), 6) AS std__l_tax
 FROM ({X.LINEITEM_SQL}) l GROUP BY l_orderkey"""),
    "cat_code": (cat_code, """SELECT o_orderkey, o_custkey, o_orderpriority,
 dense_rank() OVER (ORDER BY o_orderpriority) AS priority_code,
 dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) AS cust_code FROM orders"""),
}

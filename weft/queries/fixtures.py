"""The test tables in the roles of the data model, and the same tables as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.sources.tables import CAT, MULTI_CAT, NUM, TIME, Relation, TableSet, TableSpec, read_tables

# Money and rates are taken in hundredths: their sums are then exact in any order of addition.
ORDERS_SQL = """SELECT o_orderkey, o_custkey, o_orderpriority, round(o_totalprice * 100) AS o_totalprice,
 o_orderdate, CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders"""

CUSTOMER_SQL = """SELECT c_custkey, c_nationkey, c_mktsegment, round(c_acctbal * 100) AS c_acctbal FROM customer"""

LINEITEM_SQL = """SELECT l_orderkey, l_partkey, l_returnflag, l_linestatus, l_linenumber, l_shipdate, l_quantity,
 round(l_extendedprice * 100) AS l_extendedprice, round(l_discount * 100) AS l_discount,
 round(l_tax * 100) AS l_tax FROM lineitem"""

PART_SQL = """SELECT p_partkey, p_brand, p_type, replace(p_name, ' ', ',') AS p_names,
 CAST(p_size AS DOUBLE) AS p_size, round(p_retailprice * 100) AS p_retailprice FROM part"""

EVENTS_SQL = """SELECT event_id, ts, user_id, event_type, round(value * 100) AS value,
 CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CAST(event_type = 'purchase' AS INTEGER) AS label FROM events"""

TAGS_SQL = """SELECT p_partkey, replace(p_name, ' ', ',') || ',' || p_type || ',' || p_brand AS p_tags FROM part"""


def hundredths(column: str) -> Column:
    return F.rint(F.col(column) * 100).alias(column)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_tables(spark, sf_dir, [name])[name]


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", hundredths("o_totalprice"), "o_orderdate",
        (F.col("o_orderstatus") == "F").cast("int").alias("label"))


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", hundredths("c_acctbal"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_shipdate", "l_quantity",
        hundredths("l_extendedprice"), hundredths("l_discount"), hundredths("l_tax"))


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", "p_type", F.replace("p_name", F.lit(" "), F.lit(",")).alias("p_names"),
        F.col("p_size").cast("double").alias("p_size"), hundredths("p_retailprice"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multi-category column with four elements per part."""
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", F.concat_ws(",", F.replace("p_name", F.lit(" "), F.lit(",")), "p_type",
                                             "p_brand").alias("p_tags"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", hundredths("value"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        (F.col("event_type") == "purchase").cast("int").alias("label"))


ORDER_RELATIONS = (
    Relation("orders", "customer", ("o_custkey",), ("c_custkey",), "many_to_one"),
    Relation("orders", "lineitem", ("o_orderkey",), ("l_orderkey",), "one_to_many"),
    Relation("lineitem", "part", ("l_partkey",), ("p_partkey",), "many_to_one"),
    Relation("customer", "nation", ("c_nationkey",), ("n_nationkey",), "many_to_one"),
)

ORDER_SPECS = {
    "orders": TableSpec({"o_custkey": CAT, "o_orderpriority": CAT, "o_totalprice": NUM, "o_orderdate": TIME},
                        keys=("o_custkey",), order=("o_orderdate", "o_orderkey")),
    "customer": TableSpec({"c_nationkey": CAT, "c_mktsegment": CAT, "c_acctbal": NUM}, keys=("c_nationkey",)),
    "lineitem": TableSpec({"l_partkey": CAT, "l_returnflag": CAT, "l_linestatus": CAT, "l_quantity": NUM,
                           "l_extendedprice": NUM, "l_discount": NUM, "l_tax": NUM, "l_shipdate": TIME},
                          keys=("l_partkey",), order=("l_shipdate", "l_linenumber")),
    "part": TableSpec({"p_brand": CAT, "p_type": CAT, "p_names": MULTI_CAT, "p_size": NUM, "p_retailprice": NUM}),
    "nation": TableSpec({"n_name": CAT}),
}


def order_graph(spark: SparkSession, sf_dir: str) -> TableSet:
    tables = {"orders": orders(spark, sf_dir), "customer": customer(spark, sf_dir),
              "lineitem": lineitem(spark, sf_dir), "part": part(spark, sf_dir),
              "nation": read(spark, sf_dir, "nation")}
    return TableSet(tables, ORDER_SPECS, ORDER_RELATIONS, main="orders", row_id="o_orderkey",
                    time_col="o_orderdate", label="label")


def customer_graph(spark: SparkSession, sf_dir: str) -> TableSet:
    """The part of the order graph without the to-many tables."""
    g = order_graph(spark, sf_dir)
    keep = ("orders", "customer", "nation")
    return TableSet({n: g.tables[n] for n in keep}, {n: g.specs[n] for n in keep},
                    tuple(r for r in g.relations if {r.left, r.right} <= set(keep)),
                    main="orders", row_id="o_orderkey", time_col="o_orderdate", label="label")


def line_graph(spark: SparkSession, sf_dir: str) -> TableSet:
    """Lines as the main table: nation and region are met by way of the customer and of the supplier."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity")
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", hundredths("s_acctbal"))
    tables = {"lineitem": lines, "orders": orders(spark, sf_dir).drop("label"), "customer": customer(spark, sf_dir),
              "supplier": supplier, "nation": read(spark, sf_dir, "nation"), "region": read(spark, sf_dir, "region")}
    specs = {"lineitem": TableSpec({"l_suppkey": CAT, "l_returnflag": CAT, "l_quantity": NUM}, keys=("l_suppkey",)),
             "orders": TableSpec({"o_orderpriority": CAT, "o_totalprice": NUM, "o_orderdate": TIME}),
             "customer": ORDER_SPECS["customer"],
             "supplier": TableSpec({"s_nationkey": CAT, "s_acctbal": NUM}, keys=("s_nationkey",)),
             "nation": TableSpec({"n_name": CAT}), "region": TableSpec({"r_name": CAT})}
    relations = (Relation("lineitem", "orders", ("l_orderkey",), ("o_orderkey",), "many_to_one"),
                 Relation("orders", "customer", ("o_custkey",), ("c_custkey",), "many_to_one"),
                 Relation("customer", "nation", ("c_nationkey",), ("n_nationkey",), "many_to_one"),
                 Relation("lineitem", "supplier", ("l_suppkey",), ("s_suppkey",), "many_to_one"),
                 Relation("supplier", "nation", ("s_nationkey",), ("n_nationkey",), "many_to_one"),
                 Relation("nation", "region", ("n_regionkey",), ("r_regionkey",), "many_to_one"))
    return TableSet(tables, specs, relations, main="lineitem", row_id="l_orderkey")


def trade_graph(spark: SparkSession, sf_dir: str) -> TableSet:
    """Orders with the nations they go from and to: two relations to one table. Small orders have no origin."""
    lines = read(spark, sf_dir, "lineitem")
    first = lines.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s_suppkey"))
    sent = first.join(read(spark, sf_dir, "supplier"), "s_suppkey").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("s_nationkey").alias("origin"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("target"))
    main = orders(spark, sf_dir).join(sent, "o_orderkey", "left").join(c, "o_custkey", "left").select(
        "o_orderkey", F.when(F.col("o_totalprice") >= 1_000_000, F.col("origin")).alias("origin"), "target", "o_totalprice")
    specs = {"trade": TableSpec({"o_totalprice": NUM}), "nation": TableSpec({"n_name": CAT}), "region": TableSpec({"r_name": CAT})}
    relations = (Relation("trade", "nation", ("origin",), ("n_nationkey",), "many_to_one", "origin"),
                 Relation("trade", "nation", ("target",), ("n_nationkey",), "many_to_one", "target"),
                 Relation("nation", "region", ("n_regionkey",), ("r_regionkey",), "many_to_one"))
    tables = {"trade": main, "nation": read(spark, sf_dir, "nation"), "region": read(spark, sf_dir, "region")}
    return TableSet(tables, specs, relations, main="trade", row_id="o_orderkey")


_NUMS = [("lineitem", c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")] + [
    ("part", c) for c in ("p_size", "p_retailprice")]
_CATS = [("lineitem", c) for c in ("l_partkey", "l_returnflag", "l_linestatus")] + [
    ("part", c) for c in ("p_brand", "p_type")]


def _side_sql(side: str) -> str:
    """Aggregates of the lines per order, as SQL."""
    tables = ("lineitem", "part") if side == "part" else ("lineitem",)
    out = []
    for t, c in _NUMS:
        if t in tables:
            out += [f"avg({c}) AS {t}__mean__{c}", f"sum({c}) AS {t}__sum__{c}"]
    for t, c in _CATS:
        if t in tables:
            out += [f"CAST(arg_max({c}, row(l_shipdate, l_linenumber, {c})) AS VARCHAR) AS {t}__last__{c}",
                    f"length(string_agg(DISTINCT CAST({c} AS VARCHAR), ',')) AS {t}__union_length__{c}"]
    if side == "part":
        out += ["arg_max(p_names, row(l_shipdate, l_linenumber, p_names)) AS part__last__p_names",
                "length(string_agg(p_names, ',')) AS part__union_length__p_names"]
    return ", ".join(out)


def _side_columns_sql(side: str) -> str:
    """The same aggregates on the order rows, with the fills of orders without lines."""
    tables = ("lineitem", "part") if side == "part" else ("lineitem",)
    out = []
    for t, c in _NUMS:
        if t in tables:
            out += [f"coalesce(a.{t}__{s}__{c}, -1) AS {t}__{s}__{c}" for s in ("mean", "sum")]
    for t, c in _CATS:
        if t in tables:
            out += [f"coalesce(a.{t}__last__{c}, '0') AS {t}__last__{c}",
                    f"coalesce(a.{t}__union_length__{c}, -1) AS {t}__union_length__{c}"]
    if side == "part":
        out += ["coalesce(a.part__last__p_names, '0') AS part__last__p_names",
                "coalesce(a.part__union_length__p_names, -1) AS part__union_length__p_names"]
    return ", ".join(out)


def side_sql(side: str = "lineitem") -> str:
    """CTEs ``o`` (orders) and ``a`` (aggregated lines)."""
    lines = f"({LINEITEM_SQL}) l"
    if side == "part":
        lines += f" LEFT JOIN ({PART_SQL}) p ON l.l_partkey = p.p_partkey"
    return f"o AS ({ORDERS_SQL}), a AS (SELECT l_orderkey, {_side_sql(side)} FROM {lines} GROUP BY l_orderkey)"


TO_MANY_SQL = f"""WITH {side_sql()} SELECT o.*, {_side_columns_sql('lineitem')}
FROM o LEFT JOIN a ON o.o_orderkey = a.l_orderkey"""

CUSTOMER_COLUMNS_SQL = """coalesce(c.c_nationkey, 0) AS customer__c_nationkey,
 coalesce(c.c_mktsegment, '0') AS customer__c_mktsegment, coalesce(c.c_acctbal, -1) AS customer__c_acctbal,
 coalesce(n.n_name, '0') AS nation__n_name"""

CUSTOMER_JOIN_SQL = f"""LEFT JOIN ({CUSTOMER_SQL}) c ON o.o_custkey = c.c_custkey
 LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey"""

MERGED_SQL = f"""WITH {side_sql('part')} SELECT o.*, {CUSTOMER_COLUMNS_SQL}, {_side_columns_sql('part')}
FROM o {CUSTOMER_JOIN_SQL} LEFT JOIN a ON o.o_orderkey = a.l_orderkey"""

CUSTOMER_MERGED_SQL = f"""SELECT o.*, {CUSTOMER_COLUMNS_SQL} FROM ({ORDERS_SQL}) o {CUSTOMER_JOIN_SQL}"""

"""Joins and graph steps that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.workers import ship
from weft.sources.workspace import materialize

#: Keys that hold more than this part of all rows are joined by broadcast: there are fewer than this many of them.
HOT_PARTS = 2000
_SALTS = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's; the workers get the library first."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Left join of a table with one row per key, however many rows share a key.

    ``weight`` is the number of rows that hold the key. The fewer than ``HOT_PARTS`` keys with more than one part in
    ``HOT_PARTS`` of all rows go by broadcast, their rows stay where they are spread; the others are shuffled. Null
    keys meet null keys. ``table`` is read three times, so it should be written.
    """
    value = [c for c in table.columns if c not in keys]
    total = table.agg(F.sum(weight)).first()[0] or 0

    def renamed(part: DataFrame, tag: str) -> DataFrame:
        return part.select(*[F.col(c).alias(f"{tag}k_{c}") for c in keys],
                           F.struct(*[F.col(c) for c in value]).alias(f"{tag}v"))

    hot = renamed(table.where(F.col(weight) * HOT_PARTS > total), "_h")
    rest = renamed(table.where(F.col(weight) * HOT_PARTS <= total), "_r")
    out = rows.join(F.broadcast(hot), same([F.col(c) for c in keys], [F.col(f"_hk_{c}") for c in keys]), "left")
    # a row that is served already goes anywhere: its salt matches nothing
    salt = F.when(F.col("_hv").isNotNull(), 1 + F.floor(F.rand(7) * _SALTS)).otherwise(F.lit(0))
    out = out.withColumn("_salt", salt.cast("long"))
    rest = rest.withColumn("_rsalt", F.lit(0).cast("long"))
    out = out.join(rest, same([F.col(c) for c in keys], [F.col(f"_rk_{c}") for c in keys])
                   & (F.col("_salt") == F.col("_rsalt")), "left")
    return out.select(*rows.columns, *[F.coalesce(F.col("_hv")[c], F.col("_rv")[c]).alias(c) for c in value])


def same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    on = F.lit(True)
    for a, b in zip(left, right, strict=True):
        on = on & a.eqNullSafe(b)
    return on


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of a graph given by its links: (node, root), root being the smallest node.

    Alternating large-star and small-star steps: every step points nodes at a smaller neighbour, so a node never
    gathers more links than it has neighbours and long chains shrink by half. Each step is written, and the loop ends
    when a step changes nothing. Nodes of any ordered type; nodes without a link are not in the result.
    """
    edges = materialize(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "links")
    before = None
    while True:
        # large star: link the larger neighbours to the smallest of all
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        least = materialize(least.select("a", F.least("m", "a").alias("m"), "n"), "least")
        large = attach(both, least, ["a"], "n").where("b > a")
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: link the smaller neighbours, and the node itself, to the smallest
        large = materialize(large, "large")
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        down = materialize(down, "down")
        small = attach(large, down, ["a"], "n")
        edges = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(
            down.select("a", F.col("m").alias("b"))).distinct()
        edges = materialize(edges, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before is not None and tuple(now) == tuple(before):
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return materialize(roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct(), "roots")


"""Putting one-row-per-key tables onto rows without a hot key ending up in one task."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A table of at most this many keys is broadcast; the number of keys is measured first.
BROADCAST_KEYS = 100_000
# A key with this many rows is hot and is salted. The heaviest keys are found with a frequent-items sketch
# of HOT_KEYS counters, which misses no key that holds more than a few times 1 / HOT_KEYS of the rows.
HOT_ROWS = 1_000_000
HOT_KEYS = 10_000
# Shares a hot key is split into; its table row is repeated that often.
SALTS = 4_096
# Values that a task is to hold when rows are dealt by key and taken apart there. Spark joins shuffled partitions by their packed
# size, and what is made of them in the task is many times larger.
TASK_VALUES = 2_000_000


@dataclass(frozen=True)
class KeyProfile:
    """Estimated number of distinct keys, the hashes of the hot ones, and the number of rows."""

    distinct: int
    hot: tuple[int, ...] = ()
    rows: int = 0


def same_keys(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Null-safe equality on every key."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right, strict=True)])


def key_profiles(rows: DataFrame, key_sets: Iterable[Sequence[str]],
                 hot_rows: int = HOT_ROWS) -> dict[tuple[str, ...], KeyProfile]:
    """The profile of each key set: one pass over the key columns, which moves only sketches.

    What the sketches miss or overrate changes how rows are spread, never the result.
    """
    sets = list(dict.fromkeys(tuple(k) for k in key_sets))
    if not sets:
        return {}
    aggs = []
    for i, ks in enumerate(sets):
        h = f"xxhash64({_names(ks)})"
        aggs += [F.expr(f"approx_count_distinct({h})").alias(f"n{i}"),
                 F.expr(f"transform(filter(approx_top_k({h}, {HOT_KEYS}, {HOT_KEYS}), x -> x.count >= {hot_rows}), "
                        f"x -> x.item)").alias(f"h{i}")]
    found = rows.agg(F.count(F.lit(1)).alias("rows"), *aggs).first()
    return {ks: KeyProfile(found[f"n{i}"], tuple(found[f"h{i}"] or ()), found["rows"]) for i, ks in enumerate(sets)}


def deal(rows: DataFrame, keys: Sequence[str], values: int) -> DataFrame:
    """Deal rows by key for tasks that make ``values`` values of them in all: with these the tasks grow in number, not in size."""
    spark = rows.sparkSession
    tasks = -(-values // TASK_VALUES)
    if tasks <= spark.sparkContext.defaultParallelism:
        return rows.repartition(*keys)
    # a number keeps the partitions apart; with fewer than the session's a join would deal the rows again
    return rows.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _names(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}`" for c in columns)


def is_small(df: DataFrame, limit: int = BROADCAST_KEYS) -> bool:
    """Whether ``df`` has at most ``limit`` rows; a scan stops as soon as the answer is known."""
    return df.select(F.lit(1)).limit(limit + 1).count() <= limit


def has_null_key(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether a row of ``df`` has a null among its keys."""
    return not df.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])).select(*keys).distinct().isEmpty()


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], profile: KeyProfile, *,
           table_keys: Sequence[str] | None = None, spread: Sequence[str] | None = None,
           broadcast_keys: int = BROADCAST_KEYS, null_keys: bool = True) -> DataFrame:
    """Left-join a table that has one row per key onto ``rows``; null keys match null keys.

    A table without null keys is joined by plain equality (``null_keys=False``): a side that is dealt by the keys
    already stays where it is then, which a null-safe join does not see.

    ``profile`` has the size of ``table`` and the hot keys of ``rows``. A small table is broadcast and the
    rows do not move. Otherwise both sides are shuffled. Rows of hot keys are salted by ``spread`` (columns
    that tell rows apart), so they reach every task, and the hot rows of the table are repeated for
    every salt.
    """
    table_keys = list(table_keys or keys)
    values = [c for c in table.columns if c not in table_keys]
    side_keys = [f"_ck{i}" for i in range(len(table_keys))]
    side = table.select(*[F.col(k).alias(s) for k, s in zip(table_keys, side_keys, strict=True)], *values)
    pairs = list(zip(keys, side_keys, strict=True))
    on = (same_keys([F.col(k) for k in keys], [F.col(s) for s in side_keys]) if null_keys
          else reduce(lambda a, b: a & b, [F.col(k) == F.col(s) for k, s in pairs]))
    if profile.distinct <= broadcast_keys:
        return rows.join(F.broadcast(side), on, "left").drop(*side_keys)
    if not profile.hot:
        return rows.join(side, on, "left").drop(*side_keys)

    # equal values have to hash alike: the table's keys are hashed in the rows' types, where one that does not
    # fit equals no row's key
    hashed = ", ".join(f"try_cast({s} AS {rows.schema[k].dataType.simpleString()})"
                       for k, s in zip(keys, side_keys, strict=True))
    hot = f"IN ({', '.join(f'{h}L' for h in profile.hot)})"
    salted = rows.withColumn("_salt", F.expr(
        f"CASE WHEN xxhash64({_names(keys)}) {hot} "
        f"THEN cast(pmod(xxhash64({_names(spread or rows.columns)}), {SALTS}) AS int) ELSE 0 END"))
    repeated = side.withColumn("_side_salt", F.expr(
        f"explode(CASE WHEN xxhash64({hashed}) {hot} THEN sequence(0, {SALTS - 1}) ELSE array(0) END)"))
    return salted.join(repeated, on & (F.col("_salt") == F.col("_side_salt")), "left").drop(
        "_salt", "_side_salt", *side_keys)

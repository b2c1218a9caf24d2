"""Exact, seeded samples and splits.

Rows are ordered by a hash of their id and the seed, and each class gives the first n of them. The hash
makes the draw repeatable whatever the partitioning; the cut is found from counts per hash prefix, so no
class is ever sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARE_DIGITS = 15  # hex digits of the hash that a share is compared with
PREFIX = 4  # hex digits of the hash that make a bin: 65,536 bins

# Fixed values of the size rules: caps, skew limits, shares and multiples.
BALANCED_CAP = 10_000
SKEW_LIMIT, SKEW_SHARE, SKEW_FEW = 0.001, 4, 5
TUNING_LIMIT, TUNING_SHARE, TUNING_FEW = 0.01, 6, 5
ENSEMBLE_MULTIPLE = 2
NEGATIVE_MULTIPLE = 2.5


def hash_order(row_id: str, seed: int) -> Column:
    """A repeatable pseudo-random position for each row id."""
    return F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f":{seed}")))


def class_counts(df: DataFrame, label: str) -> tuple[int, int]:
    """Number of positive and negative rows."""
    r = df.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).first()
    return r["pos"], r["neg"]


def _cuts(df: DataFrame, by: str, wanted: Mapping[object, int]) -> DataFrame:
    """(class, bin, left): the bin in which each class reaches its number, and how many it still takes."""
    bins = df.groupBy(F.col(by).alias("_class"), F.substring("_h", 1, PREFIX).alias("_bin")).count()
    before = Window.partitionBy("_class").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    want = F.coalesce(*[F.when(F.col("_class") == F.lit(k), F.lit(n)) for k, n in wanted.items()])
    found = bins.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).withColumn("_want", want)
    return found.where((F.col("_before") < F.col("_want")) & (F.col("_before") + F.col("count") >= F.col("_want"))
                       ).select("_class", "_bin", (F.col("_want") - F.col("_before")).alias("_left"))


def take_per_class(df: DataFrame, row_id: str, by: str, wanted: Mapping[object, int], seed: int) -> DataFrame:
    """Exactly ``wanted[c]`` rows of each class ``c`` (all of them if it has fewer)."""
    wanted = {k: n for k, n in wanted.items() if n > 0}
    if not wanted:
        return df.limit(0)
    rows = df.where(F.col(by).isin(list(wanted))).withColumn("_h", hash_order(row_id, seed))
    cuts = {r["_class"]: (r["_bin"], r["_left"]) for r in _cuts(rows, by, wanted).collect()}  # a row per class
    inside = edge = F.lit(False)
    left = F.lit(None).cast("long")
    for k in wanted:
        mine = F.col(by) == F.lit(k)
        if k not in cuts:  # fewer rows than wanted
            inside = inside | mine
            continue
        at, n = cuts[k]
        prefix = F.substring("_h", 1, PREFIX)
        inside = inside | (mine & (prefix < at))
        edge = edge | (mine & (prefix == at))
        left = F.when(mine, F.lit(n)).otherwise(left)
    order = Window.partitionBy(by).orderBy("_h", row_id)
    last = rows.where(edge).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= left)
    return rows.where(inside).unionByName(last.drop("_r")).drop("_h")


def balanced_sizes(pos: int, neg: int, cap: int = BALANCED_CAP) -> dict[int, int]:
    """The same number of each class: the smaller class, at most ``cap``."""
    n = min(pos, neg, cap)
    return {1: n, 0: n}


def _is_rare(pos: int, neg: int, limit: float) -> bool:
    return neg > 0 and pos / neg < limit


def skew_sizes(pos: int, neg: int, rows: int) -> dict[int, int]:
    """Sizes for the selection sample: rare positives meet a share of all negatives, few positives meet
    ``rows`` negatives, and otherwise the classes are equal."""
    n = min(pos, neg, rows)
    if _is_rare(pos, neg, SKEW_LIMIT):
        return {1: n, 0: neg // SKEW_SHARE}
    return {1: n, 0: min(rows, neg) if n < rows / SKEW_FEW else n}


def tuning_sizes(pos: int, neg: int, rows: int) -> dict[int, int]:
    """Sizes for the tuning sample: as above, with all negatives where positives are few."""
    n = min(pos, neg, rows)
    if _is_rare(pos, neg, TUNING_LIMIT):
        return {1: n, 0: neg // TUNING_SHARE}
    return {1: n, 0: neg if n < neg / TUNING_FEW else n}


def ensemble_sizes(pos: int, neg: int) -> dict[int, int]:
    """The smaller class in full and up to twice as many of the larger one."""
    n = min(pos, neg)
    double = ENSEMBLE_MULTIPLE * n
    if pos < neg and double < neg:
        return {1: n, 0: double}
    if pos > neg and double < pos:
        return {1: double, 0: n}
    return {1: n, 0: n}


def balanced_sample(df: DataFrame, row_id: str, label: str, cap: int = BALANCED_CAP, seed: int = 1) -> DataFrame:
    return take_per_class(df, row_id, label, balanced_sizes(*class_counts(df, label), cap), seed)


def skew_sample(df: DataFrame, row_id: str, label: str, rows: int, seed: int = 1) -> DataFrame:
    return take_per_class(df, row_id, label, skew_sizes(*class_counts(df, label), rows), seed)


def tuning_sample(df: DataFrame, row_id: str, label: str, rows: int, seed: int = 1) -> DataFrame:
    return take_per_class(df, row_id, label, tuning_sizes(*class_counts(df, label), rows), seed)


def ensemble_sample(df: DataFrame, row_id: str, label: str, seed: int) -> DataFrame:
    return take_per_class(df, row_id, label, ensemble_sizes(*class_counts(df, label)), seed)


def negatives_excluding(df: DataFrame, row_id: str, label: str, used: DataFrame, seed: int = 1) -> DataFrame:
    """All positives and 2.5 times as many negatives among those not used before."""
    fresh = df.join(used.select(row_id), row_id, "left_anti").where(F.col(label) == 0)
    pos = df.where(F.col(label) == 1)
    n = int(NEGATIVE_MULTIPLE * class_counts(df, label)[0])
    return pos.unionByName(take_per_class(fresh, row_id, label, {0: n}, seed).select(*pos.columns))


def row_sample(df: DataFrame, row_id: str, rows: int, seed: int = 1) -> DataFrame:
    """Exactly ``rows`` rows whatever their class."""
    return take_per_class(df.withColumn("_all", F.lit(1)), row_id, "_all", {1: rows}, seed).drop("_all")


def in_validation(row_id: str, share: float, seed: int = 1) -> Column:
    """Whether a row belongs to the validation part; the same row always gets the same answer.

    Shares count to one in 2**60; 0 takes no row and 1 takes all.
    """
    if share <= 0 or share >= 1:
        return F.lit(share >= 1)
    limit = f"{int(Fraction(share) * 16 ** SHARE_DIGITS):0{SHARE_DIGITS}x}"
    return F.substring(hash_order(row_id, seed), 1, SHARE_DIGITS) < F.lit(limit)


def train_val_split(df: DataFrame, row_id: str, share: float = 0.2, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    part = in_validation(row_id, share, seed)
    return df.where(~part), df.where(part)

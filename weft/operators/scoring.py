"""How well a column separates the two classes, from binned class counts.

Scores are computed from a long table of (feature, value, pos, neg) weights, so any number of columns
is scored by one plan: ranges per feature, counts per bin, then a row per feature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: equal-width bins of the score.
BINS = 64
# Fixed value: the score when a class has no rows.
NO_SCORE = -1.0

# Scores are sums of doubles, whose last digits depend on the order of addition; rounding makes ranks
# and threshold comparisons the same on every run.
DIGITS = 9


def long_values(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(feature, value, pos, neg) for every finite value of every row and column.

    Nothing is grouped here: ranges and bins combine inside each task, so a continuous column is never
    shuffled value by value.
    """
    wide = df.select((F.col(label) == 1).cast("long").alias("pos"), (F.col(label) == 0).cast("long").alias("neg"),
                     *[F.col(c).cast("double").alias(c) for c in columns])
    long = wide.unpivot(["pos", "neg"], list(columns), "feature", "value")
    return long.where(F.abs("value") < F.lit(float("inf")))


def bin_index(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin in [lo, hi]; the maximum belongs to the last bin, a constant to the first."""
    at = F.floor((value - lo) / (hi - lo) * bins).cast("int")
    return F.when(hi > lo, F.least(at, F.lit(bins - 1))).otherwise(F.lit(0))


def bin_counts(values: DataFrame, bins: int = BINS) -> DataFrame:
    """(feature, bin, pos, neg): at most ``bins`` rows per feature."""
    ranges = values.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # one row per feature
    placed = values.join(F.broadcast(ranges), "feature")
    return placed.groupBy("feature", bin_index(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _with_totals(counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("feature").agg(F.sum("pos").alias("p_all"), F.sum("neg").alias("n_all"))
    return counts.join(F.broadcast(totals), "feature")


def hellinger(counts: DataFrame) -> DataFrame:
    """(feature, score): distance between the class-conditional bin shares; -1 if a class is empty."""
    shares = _with_totals(counts).select("feature", "p_all", "n_all", "bin",
                                         F.sqrt(F.try_divide("pos", "p_all")).alias("p"),
                                         F.sqrt(F.try_divide("neg", "n_all")).alias("q"))
    gap = F.col("p") - F.col("q")
    score = F.sqrt(F.sum(gap * gap)) / F.sqrt(F.lit(2.0))
    empty = (F.first("p_all") == 0) | (F.first("n_all") == 0)
    return shares.groupBy("feature").agg(
        F.when(empty, F.lit(NO_SCORE)).otherwise(F.round(score, DIGITS)).alias("score"))


def mutual_information(counts: DataFrame) -> DataFrame:
    """(feature, mi) in nats, by plugging the bin shares into the definition."""
    rows = _with_totals(counts).withColumn("all", F.col("p_all") + F.col("n_all"))

    def term(n: str, n_all: str) -> Column:
        joint = F.col(n) / F.col("all")
        apart = (F.col("pos") + F.col("neg")) / F.col("all") * (F.col(n_all) / F.col("all"))
        return F.when(F.col(n) > 0, joint * F.log(joint / apart)).otherwise(F.lit(0.0))

    return rows.groupBy("feature").agg(
        F.round(F.sum(term("pos", "p_all") + term("neg", "n_all")), DIGITS).alias("mi"))


def hellinger_scores(df: DataFrame, columns: Sequence[str], label: str, bins: int = BINS) -> DataFrame:
    return hellinger(bin_counts(long_values(df, columns, label), bins))


def mutual_info(df: DataFrame, columns: Sequence[str], label: str, bins: int = BINS) -> DataFrame:
    return mutual_information(bin_counts(long_values(df, columns, label), bins))

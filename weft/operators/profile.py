"""Column profiles: missing share, single values, collinear pairs."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.skew import BROADCAST_KEYS

# Pairs of columns whose correlations share one pass over the rows.
PAIRS_PER_PASS = 300


def _long(df: DataFrame, columns: Sequence[str], value: str, fns) -> DataFrame:
    """One aggregate per column in a single pass, turned into a row per column."""
    one = df.agg(*[fns(c).alias(f"_c{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_c{i}").alias(value)) for i, c in enumerate(columns)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def missing_fractions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, missing_fraction)."""
    return _long(df, columns, "missing_fraction", lambda c: F.avg(F.col(c).isNull().cast("double")))


def missing_above(df: DataFrame, columns: Sequence[str], threshold: float) -> DataFrame:
    return missing_fractions(df, columns).where(F.col("missing_fraction") > threshold)


def single_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, single_unique): whether the column has exactly one value; nulls do not count as one."""
    return _long(df, columns, "single_unique",
                 lambda c: F.coalesce(F.min(c) == F.max(c), F.lit(False)))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(corr_feature, drop_feature, corr_value) for each pair of columns, the later one to be dropped.

    A pair's correlation is taken over the rows that hold both values, however many columns there are.
    """
    pairs = list(combinations(columns, 2))
    out = None
    for lo in range(0, len(pairs), PAIRS_PER_PASS):
        own = pairs[lo:lo + PAIRS_PER_PASS]
        one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_p{i}")
                       for i, (a, b) in enumerate(own)])
        rows = F.array(*[F.struct(F.lit(a).alias("corr_feature"), F.lit(b).alias("drop_feature"),
                                  F.col(f"_p{i}").alias("corr_value")) for i, (a, b) in enumerate(own)])
        part = one.select(F.explode(rows).alias("r")).select("r.*")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.sparkSession.createDataFrame(
        [], "corr_feature string, drop_feature string, corr_value double")


def collinear(df: DataFrame, columns: Sequence[str], threshold: float) -> DataFrame:
    """Pairs whose absolute correlation exceeds the threshold."""
    return correlations(df, columns).where(F.abs("corr_value") > threshold)


def one_hot(df: DataFrame, columns: Sequence[str], max_levels: int = 1_000) -> tuple[DataFrame, list[str]]:
    """A 0/1 column per value of each category. A column with more than ``max_levels`` values is refused."""
    if max_levels > BROADCAST_KEYS:
        raise ValueError("too many levels for columns")
    exprs, names = [], []
    for c in columns:
        levels = [r[0] for r in df.select(F.col(c).cast("string")).where(F.col(c).isNotNull()).distinct()
                  .limit(max_levels + 1).collect()]
        if len(levels) > max_levels:
            raise ValueError(f"{c!r} has more than {max_levels} values")
        for v in sorted(levels):
            names.append(f"{c}_{v}")
            exprs.append(F.coalesce(F.col(c).cast("string") == F.lit(v), F.lit(False)).cast("int").alias(names[-1]))
    return df.select("*", *exprs), names

"""Joins on the latest earlier row of the same key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.ordered import OrderedRows

# Fixed value: rows of the rolling join's window.
ROLLING_ROWS = 5


def _one_timeline(left: DataFrame, right: DataFrame, key: str, time_col: str, row_id: str,
                  values: Sequence[str]) -> DataFrame:
    """Left and right rows together; at the same time a right row comes first."""
    r = right.select(key, time_col, F.lit(0).alias("_side"), row_id, *values)
    l = left.withColumn("_side", F.lit(1))
    return r.unionByName(l, allowMissingColumns=True)


def asof_join(left: DataFrame, right: DataFrame, key: str, time_col: str, row_id: str,
              values: Sequence[str], *, right_id: str | None = None, prefix: str = "asof__",
              buckets: int | None = None) -> DataFrame:
    """Each left row with the latest value of every right column at or before its time, per key.

    Each column is filled on its own, so a null in the newest right row gives way to an older value.
    ``right_id`` orders right rows of the same time; without one the larger values come last, and equal
    rows count once.
    """
    names = [f"{prefix}{v}" for v in values]
    kind = left.schema[row_id].dataType
    own = F.lit(None) if right_id is None else F.col(right_id)
    side = right.select(key, time_col, own.cast(kind).alias(row_id),
                        *[F.col(v).alias(n) for v, n in zip(values, names, strict=True)])
    order = [time_col, "_side", row_id]
    if right_id is None:
        side, order = side.distinct(), [*order, *names]
    rows = OrderedRows(_one_timeline(left, side, key, time_col, row_id, names), [key], order, buckets)
    return rows.forward_fill(names).where(F.col("_side") == 1).select(*left.columns, *names)


def asof_rolling(left: DataFrame, right: DataFrame, key: str, time_col: str, row_id: str,
                 values: Sequence[str], *, right_id: str, size: int = ROLLING_ROWS,
                 stats: Sequence[str] = ("mean", "sum"), buckets: int | None = None) -> DataFrame:
    """Each left row with aggregates of the right values among the last ``size`` rows of the key's
    common timeline, its own row included."""
    names = [f"_v_{v}" for v in values]
    side = right.select(key, time_col, F.col(right_id).cast(left.schema[row_id].dataType).alias(row_id),
                        *[F.col(v).alias(n) for v, n in zip(values, names, strict=True)])
    line = _one_timeline(left, side, key, time_col, row_id, names)
    rows = OrderedRows(line, [key], [time_col, "_side", row_id], buckets)
    out = rows.rolling(names, size, stats).where(F.col("_side") == 1)
    return out.select(*left.columns, *[F.col(f"_v_{v}_roll_{s}").alias(f"roll{size}__{s}__{v}")
                                       for s in stats for v in values])

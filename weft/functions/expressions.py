"""Row-level expressions: times, multi-category lists, row sums, rates and scaling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.sources.tables import MULTI_CAT, NUM, TIME, columns_of, path_of, table_of

DELIMITER = ","
MICROS_PER_DAY = 86_400_000_000


def time_parts(column: str, prefix: str | None = None) -> dict[str, Column]:
    """Day, weekday (Monday = 0), hour, and the day and weekday joined with the hour.

    The joined parts are the digits written one after the other, so (1, 11) and (11, 1) coincide;
    ``_day_hour`` is the form that keeps them apart.
    """
    p = prefix or column
    t = F.col(column)
    day, dow, hour = F.day(t), F.weekday(t), F.hour(t)
    return {
        f"{p}_day": day,
        f"{p}_day_of_week": dow,
        f"{p}_hour": hour,
        f"{p}_day_and_hour": F.concat(day.cast("string"), hour.cast("string")).cast("int"),
        f"{p}_day_of_week_and_hour": F.concat(dow.cast("string"), hour.cast("string")).cast("int"),
        f"{p}_day_hour": day * 100 + hour,
    }


def micros_between(a: Column, b: Column) -> Column:
    """``a - b`` in microseconds."""
    return F.timestamp_diff("MICROSECOND", b, a)


def days_between(a: Column, b: Column) -> Column:
    """``a - b`` in whole days, rounded down."""
    us = micros_between(a, b)
    return ((us - F.pmod(us, F.lit(MICROS_PER_DAY))) / MICROS_PER_DAY).cast("long")


def hours_between(a: Column, b: Column) -> Column:
    """``a - b`` in whole hours, rounded toward zero."""
    return F.timestamp_diff("HOUR", b, a)


def time_differences(columns: Sequence[str]) -> dict[str, Column]:
    """Days and hours between every ordered pair of times."""
    out = {}
    for a, b in permutations(columns, 2):
        out[f"{a}_minus_{b}_d"] = days_between(F.col(a), F.col(b))
        out[f"{a}_minus_{b}_h"] = hours_between(F.col(a), F.col(b))
    return out


def rates(values: Mapping[str, Column], days: Column, suffix: str = "per_day") -> dict[str, Column]:
    """Each value per day; null where there is no whole day between."""
    return {f"{n}_{suffix}": F.try_divide(c.cast("double"), days.cast("double")) for n, c in values.items()}


def rates_by_lineage(df: DataFrame) -> dict[str, Column]:
    """Every number and list size of a table per day between every two times of the same table.

    Which columns belong together follows from their types and lineage: the table, and the path that leads to it.
    """
    def own(kind: str) -> dict[tuple[str | None, str], list[str]]:
        out: dict[tuple[str | None, str], list[str]] = {}
        for c in columns_of(df, kind):
            out.setdefault((table_of(df, c), path_of(df, c)), []).append(c)
        return out

    numbers, lists, out = own(NUM), own(MULTI_CAT), {}
    for at, times in own(TIME).items():
        values = {c: F.col(c) for c in numbers.get(at, ())} | {f"{c}_size": list_size(c) for c in lists.get(at, ())}
        for a, b in combinations(times, 2):
            out |= rates(values, days_between(F.col(a), F.col(b)), f"per_day_{a}_minus_{b}")
    return out


def row_sum(columns: Sequence[str]) -> Column:
    """Sum across columns, a missing value counting as nothing."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return total


def list_length(column: str) -> Column:
    """Characters of a multi-category text."""
    return F.length(column)


def list_size(column: str) -> Column:
    """Elements of a multi-category text."""
    return F.size(F.split(column, DELIMITER))


def list_lengths(columns: Sequence[str]) -> dict[str, Column]:
    """The length of each multi-category column and their sum."""
    out = {f"{c}_length": list_length(c) for c in columns}
    total = F.lit(0)
    for c in columns:
        total = total + list_length(c)
    return {**out, "mv_len_sum": total}


def list_prefix(column: str, k: int) -> Column:
    """The first ``k`` elements of a multi-category text."""
    return F.array_join(F.slice(F.split(column, DELIMITER), 1, k), DELIMITER)


def legacy_pair_value(a: Column, b: Column) -> Column:
    """One number for a numeric pair: ``a mod b + a * b + a / b``, the modulus taking the sign of ``b``.

    Different pairs can share a value; grouping by both columns does not have that defect.
    """
    a, b = a.cast("double"), b.cast("double")
    rest = F.try_mod(F.try_mod(a, b) + b, b)
    return rest + a * b + F.try_divide(a, b)


def column_ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Minimum and maximum of each column in one pass; keep the result to scale new data alike."""
    found = df.agg(*[F.min(c).cast("double").alias(f"lo_{c}") for c in columns],
                   *[F.max(c).cast("double").alias(f"hi_{c}") for c in columns]).first()
    return {c: (found[f"lo_{c}"], found[f"hi_{c}"]) for c in columns}


def minmax_scale(column: str, lo: float, hi: float, top: float = 100.0) -> Column:
    """Scale to 0..``top`` by a stored range; a constant column becomes 0."""
    if lo is None or hi is None or hi == lo:
        return F.when(F.col(column).isNotNull(), F.lit(0.0))
    return (F.col(column).cast("double") - F.lit(lo)) / F.lit(hi - lo) * F.lit(top)


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    found = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return {c: found[c] for c in columns}


def centered(column: str, mean: float) -> Column:
    """A numeric column minus its stored mean."""
    return F.col(column).cast("double") - F.lit(mean)


def with_exprs(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    """Add every expression in one projection."""
    return df.select("*", *[e.alias(n) for n, e in exprs.items()])

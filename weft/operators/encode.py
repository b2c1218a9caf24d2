"""Ordinal codes for categories, category pairs and multi-category prefixes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.expressions import list_prefix
from weft.operators.ordered import OrderedRows
from weft.operators.skew import BROADCAST_KEYS, KeyProfile, attach, key_profiles
from weft.sources.tables import CAT, NUM, tagged

UNKNOWN = -1


def cat_to_long(column: str) -> Column:
    """An integer-like category as a number; null where it is not one."""
    return F.expr(f"try_cast(`{column}` AS bigint)")


def code_table(df: DataFrame, columns: Sequence[str], buckets: int | None = None,
               scope: Column | None = None) -> DataFrame:
    """Codes 1, 2, ... of the sorted distinct values of several columns: (feature, value, n, code).

    ``n`` is the number of rows with the value, of those in ``scope`` if given. Only distinct values are
    ordered, never rows, and all columns share one pass.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
                      for c in columns])
    counted = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    values = df.select(counted.alias("_in"), F.explode(pairs).alias("p")).select("_in", "p.feature", "p.value")
    distinct = values.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count_if(F.col("_in")).alias("n"))
    return OrderedRows(distinct, ["feature"], ["value"], buckets).row_number("code").select(
        "feature", "value", "n", "code")


def apply_codes(df: DataFrame, codes: DataFrame, columns: Mapping[str, str], spread: Sequence[str] | None = None,
                *, counts: Mapping[str, str] | None = None) -> DataFrame:
    """Add the code of each column under a new name; a value the table does not know becomes -1.

    ``counts`` names columns whose value frequency is added as well, by the same join.
    """
    counts = counts or {}
    sizes = {r["feature"]: r["count"] for r in codes.groupBy("feature").count().collect()}  # a row per column
    texts = {c: f"_text{i}" for i, c in enumerate(dict.fromkeys((*columns, *counts)))}
    out = df.select("*", *[F.col(c).cast("string").alias(t) for c, t in texts.items()])
    large = [c for c in texts if sizes.get(c, 0) > BROADCAST_KEYS]
    hot = key_profiles(out, [(texts[c],) for c in large])
    for c, text in texts.items():
        found = []
        if c in columns:
            found.append(tagged(F.col("code"), columns[c], CAT, "", origin="code"))
        if c in counts:
            found.append(tagged(F.col("n"), counts[c], NUM, "", origin="count"))
        one = codes.where(F.col("feature") == c).select(F.col("value").alias("_value"), *found)
        profile = KeyProfile(sizes.get(c, 0), hot[(text,)].hot if c in large else ())
        out = attach(out, one, [text], profile, table_keys=["_value"], spread=spread)
    return out.drop(*texts.values()).fillna(UNKNOWN, list(columns.values()))


def encode(df: DataFrame, columns: Mapping[str, str], spread: Sequence[str] | None = None,
           buckets: int | None = None, *, counts: Mapping[str, str] | None = None,
           scope: Column | None = None) -> DataFrame:
    """Fit codes on ``df`` and add them to it, with the frequencies named in ``counts``."""
    used = list(dict.fromkeys((*columns, *(counts or {}))))
    return apply_codes(df, code_table(df, used, buckets, scope), columns, spread, counts=counts)


def with_list_prefixes(df: DataFrame, columns: Sequence[str], sizes: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """The first elements of each multi-category column as categories of their own."""
    return df.select("*", *[list_prefix(c, k).alias(f"{c}_{k}") for c in columns for k in sizes])


def encode_prefixes(df: DataFrame, columns: Sequence[str], sizes: Sequence[int] = (1, 2, 3),
                    spread: Sequence[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Ordinal codes of the first one, two and three elements of each multi-category column."""
    wide = with_list_prefixes(df, columns, sizes)
    names = {f"{c}_{k}": f"{c}_code{k}" for c in columns for k in sizes}
    return encode(wide, names, spread, buckets).drop(*names)


def combination_codes(df: DataFrame, keys: Sequence[str], name: str, spread: Sequence[str] | None = None,
                      buckets: int | None = None) -> DataFrame:
    """One code for each distinct combination of columns, numbered in their sort order."""
    distinct = df.select(*keys).distinct()
    codes = OrderedRows(distinct, [], list(keys), buckets).row_number("_code")
    codes = codes.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
                         tagged(F.col("_code"), name, CAT, "", origin="code"))
    profile = key_profiles(df, [tuple(keys)])[tuple(keys)]
    return attach(df, codes, list(keys), profile, table_keys=[f"_key{i}" for i in range(len(keys))], spread=spread)

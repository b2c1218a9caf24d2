"""Typed cleaning, row selection and set operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.sources.tables import CAT, MULTI_CAT, NUM, TIME

# What a missing value of each semantic type becomes.
FILL_NUM = -1
FILL_CAT = "0"
FILL_MULTI_CAT = "0"
FILL_TIME = "1970-01-01 00:00:00"


def fill_value(kind: str | None, data_type: str) -> str | None:
    """The SQL literal that replaces a null of the semantic type."""
    value = {NUM: str(FILL_NUM), CAT: f"'{FILL_CAT}'", MULTI_CAT: f"'{FILL_MULTI_CAT}'",
             TIME: f"TIMESTAMP_NTZ '{FILL_TIME}'"}.get(kind)
    return None if value is None else f"CAST({value} AS {data_type})"


def clean_fill(df: DataFrame, kinds: Mapping[str, str] | None = None) -> DataFrame:
    """Fill nulls by semantic type in one projection; the types come from the metadata or ``kinds``."""
    out = []
    for f in df.schema.fields:
        kind = kinds.get(f.name) if kinds is not None else (f.metadata or {}).get("weft.kind")
        value = fill_value(kind, f.dataType.simpleString())
        if value is None:
            out.append(f.name)
        else:
            out.append(F.expr(f"coalesce(`{f.name}`, {value})").alias(f.name, metadata=f.metadata or {}))
    return df.select(*out)


def union_split(train: DataFrame, test: DataFrame, split: str = "split") -> DataFrame:
    """Train and test rows in one table; a column only one side has (the label) is null on the other."""
    return train.withColumn(split, F.lit("train")).unionByName(
        test.withColumn(split, F.lit("test")), allowMissingColumns=True)


def take_split(df: DataFrame, which: str, split: str = "split") -> DataFrame:
    return df.where(F.col(split) == which)


def project(df: DataFrame, selected: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Keep the chosen features; everything feeding only the others is pruned from the plan."""
    return df.select(*dict.fromkeys((*keep, *selected)))

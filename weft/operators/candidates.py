"""Which columns to combine: feature candidates derived from types, lineage and relations."""

from __future__ import annotations

import random
from collections.abc import Sequence
from itertools import combinations, product

from pyspark.sql import DataFrame

from weft.operators.grouped import NUM_STATS, GroupFeature, count_of, mode_of, nunique_of, stats_of
from weft.sources.tables import CAT, NUM, Relation, columns_of, table_of



def key_column_pairs(df: DataFrame, relations: Sequence[Relation], kind: str = CAT,
                     skip: Sequence[str] = ()) -> list[tuple[str, str]]:
    """Each relation key present on the rows, with the columns of ``kind`` that came from its tables.

    ``skip`` leaves out keys that are different on every row, such as the row id.
    """
    pairs = [(k, c) for rel in relations for table in (rel.left, rel.right)
             for k in rel.left_keys if k in df.columns and k not in skip
             for c in columns_of(df, kind, table=table) if c != k]
    return list(dict.fromkeys(pairs))


def key_plain_pairs(df: DataFrame) -> list[tuple[str, str]]:
    """Every key category with every category that is not a key, whatever tables they came from."""
    return list(product(columns_of(df, CAT, key=True), columns_of(df, CAT, key=False)))


def same_table_pairs(df: DataFrame) -> list[tuple[str, str]]:
    """All pairs of non-key categories within one source table."""
    cats = columns_of(df, CAT, key=False)
    return [(a, b) for a, b in combinations(cats, 2) if table_of(df, a) == table_of(df, b)]


def all_pairs(df: DataFrame) -> list[tuple[str, str]]:
    """All pairs of non-key categories."""
    return list(combinations(columns_of(df, CAT, key=False), 2))


def main_pairs(df: DataFrame, main: str, max_pairs: int | None = None, seed: int = 1) -> list[tuple[str, str]]:
    """All pairs of the main table's own non-key categories, or a seeded draw of ``max_pairs``."""
    return draw(list(combinations(columns_of(df, CAT, table=main, key=False), 2)), max_pairs, seed)


def cross_table_pairs(df: DataFrame, relations: Sequence[Relation], main: str,
                      max_pairs: int | None = None, seed: int = 1) -> list[tuple[str, str]]:
    """Pairs of categories from two related tables, all or a seeded draw; to-many "last" columns are left out."""
    pairs = []
    for a, b in sorted({(r.left, r.right) for r in relations}):
        left = columns_of(df, CAT, table=a, key=False)
        right = columns_of(df, CAT, table=b, key=False)
        last = set(columns_of(df, CAT, origin="last"))
        if a != main:
            left = [c for c in left if c not in last]
        pairs += product(left, [c for c in right if c not in last])
    return draw(pairs, max_pairs, seed)


def draw(pairs: Sequence[tuple[str, str]], n: int | None, seed: int) -> list[tuple[str, str]]:
    """Up to ``n`` candidates, the same ones for the same seed; all without ``n``."""
    return list(pairs) if n is None or len(pairs) <= n else sorted(random.Random(seed).sample(list(pairs), n))


def count_encodings(columns: Sequence[str]) -> list[GroupFeature]:
    return [count_of(c) for c in columns]


def pair_counts(pairs: Sequence[tuple[str, str]]) -> list[GroupFeature]:
    return [count_of(a, b) for a, b in pairs]


def pair_nuniques(pairs: Sequence[tuple[str, str]]) -> list[GroupFeature]:
    return [nunique_of(a, b) for a, b in pairs]


def pair_modes(pairs: Sequence[tuple[str, str]]) -> list[GroupFeature]:
    return [mode_of(a, b) for a, b in pairs]


def key_num_stats(df: DataFrame, relations: Sequence[Relation], stats: Sequence[str] = NUM_STATS,
                  skip: Sequence[str] = ()) -> list[GroupFeature]:
    """Group statistics of each relation key over the numeric columns of its tables."""
    return [f for k, n in key_column_pairs(df, relations, NUM, skip) for f in stats_of(k, n, stats)]


def time_key_counts(time_parts: Sequence[str], keys: Sequence[str]) -> list[GroupFeature]:
    """How many rows share a time part and all the keys."""
    return [count_of(t, *keys) for t in time_parts]

"""The feature stage: every feature of a merged table, or only the selected ones."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.expressions import list_lengths, row_sum, time_differences, time_parts, with_exprs
from weft.operators.candidates import key_column_pairs, key_num_stats, pair_counts, pair_nuniques
from weft.operators.encode import encode, with_list_prefixes
from weft.operators.grouped import GroupFeature, add_group_features
from weft.operators.ordered import OrderedRows
from weft.operators.pairs import PairFeatureModel
from weft.sources.tables import CAT, MULTI_CAT, NUM, TIME, TableSet, columns_of, table_of
from weft.sources.workspace import materialize

# Fixed value: what a missing group statistic becomes.
STAT_FILL = -1

_SCOPE = "_scope"


@dataclass(frozen=True)
class FeatureFrame:
    """Rows with their engineered features and the pair features that were accepted."""

    df: DataFrame
    features: tuple[str, ...]
    pairs: PairFeatureModel


def _wanted(names: Collection[str], selected: Collection[str] | None) -> list[str]:
    return [n for n in names if selected is None or n in selected]


def _only(df: DataFrame, names: Collection[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c in names])


def engineer(base: DataFrame, tables: TableSet, keep: Collection[str], *, label: str | None = None,
             pairs: PairFeatureModel | None = None, selected: Collection[str] | None = None,
             aggregated_lists: bool = False, scope: Column | None = None) -> FeatureFrame:
    """Add the features to the merged and cleaned rows ``base``.

    Without ``pairs`` the pair features are screened against ``label`` on these rows; otherwise the
    accepted ones are recomputed. With ``selected`` only those features are computed. ``keep`` names
    columns to pass through (row id, label, split). Counts and statistics cover all rows, or those in
    ``scope``. ``base`` is read several times and should be a written table.
    """
    row_id = tables.row_id
    keep = list(dict.fromkeys(keep))
    usable = [c for c in base.columns if c not in keep]
    nums = [c for c in columns_of(base, NUM) if c in usable]
    times = [c for c in columns_of(base, TIME) if c in usable or c == tables.time_col]
    cats = [c for c in columns_of(base, CAT)]
    lists = [c for c in columns_of(base, MULTI_CAT) if c in usable]
    raw_lists = lists if aggregated_lists else [c for c in columns_of(base, MULTI_CAT, origin="raw") if c in usable]

    # Differences along the global time order.
    diffs = {f"{c}_diff_{k}": (c, k) for c in nums for k in (1, 2)}
    diff_names = _wanted(diffs, selected) if tables.time_col else []

    # Row-level features, and the columns that they are made of.
    exprs: dict[str, Column] = {}
    sources: dict[str, Collection[str]] = {}

    def add(made: dict[str, Column], of: Collection[str]) -> None:
        exprs.update(made)
        sources.update(dict.fromkeys(made, of))

    for table in dict.fromkeys(table_of(base, t) for t in times):
        own = [t for t in times if table_of(base, t) == table and t != tables.time_col]
        both = [*own, *[t for t in times if t == tables.time_col]]
        add(time_differences(both), both)
    part_names: list[str] = []
    for t in times:
        parts = time_parts(t)
        chosen = parts if t == tables.time_col else {f"{t}_day_of_week": parts[f"{t}_day_of_week"]}
        add(chosen, [t])
        part_names += chosen
    for table in dict.fromkeys(table_of(base, c) for c in nums):
        own = [c for c in nums if table_of(base, c) == table]
        add({f"sum__{table}": row_sum(own)}, own)
    if lists:
        add(list_lengths(lists), lists)
    row_names = _wanted(exprs, selected)

    # Codes and frequencies of categories, list prefixes and time parts: one table of values, one join each.
    prefixes = {f"{c}_{k}": c for c in raw_lists for k in (1, 2, 3)}
    codes = {c: f"{c}_code" for c in (*cats, *prefixes)}
    coded = {c: n for c, n in codes.items() if selected is None or n in selected}
    counts = {c: f"cnt__{c}" for c in (*part_names, *cats, *prefixes)}
    counts = {c: n for c, n in counts.items() if selected is None or n in selected}
    valued = {*coded, *counts}

    # Pair counts, distinct counts and group statistics.
    key_pairs = key_column_pairs(base, tables.relations, skip=[row_id])
    groups: list[GroupFeature] = pair_counts(key_pairs) + pair_nuniques(key_pairs)
    groups += [g for g in key_num_stats(base, tables.relations, skip=[row_id]) if g.value in nums]
    groups = [g for g in dict.fromkeys(groups) if selected is None or g.name in selected]

    # Only the columns of wanted features are moved and written.
    pair_features = [] if pairs is None else [f for f in pairs.features if selected is None or f.name in selected]
    last = {*keep, row_id, *(c for g in groups for c in (*g.keys, g.value)), *(c for f in pair_features for c in (f.a, f.b))}
    if pairs is None:
        last |= {*cats, *codes.values(), label}
    df = base
    if scope is not None:
        df, scope = base.withColumn(_SCOPE, F.coalesce(scope, F.lit(False))), F.col(_SCOPE)
        last.add(_SCOPE)
    row_exprs = list(dict.fromkeys((*row_names, *[n for n in part_names if n in counts])))
    if selected is not None:
        first = {*last, *_wanted(nums, selected), *(diffs[n][0] for n in diff_names), *(c for n in row_exprs for c in sources[n]),
                 *valued, *(prefixes[c] for c in valued if c in prefixes)}
        df = _only(df, first | ({tables.time_col} if diff_names else set()))

    features: list[str] = list(_wanted(nums, selected))
    if diff_names:
        need = sorted({diffs[n][0] for n in diff_names})
        df = OrderedRows(df, [], [tables.time_col, row_id]).differences(need)
        features += diff_names
    features += row_names
    df = with_exprs(df, {n: exprs[n] for n in row_exprs})
    df = with_list_prefixes(df, [c for c in raw_lists if any(prefixes[n] == c for n in valued if n in prefixes)])
    if valued:
        df = encode(df, coded, [row_id], counts=counts, scope=scope)
        features += [*coded.values(), *counts.values()]
    df = materialize(_only(df, last.union(features)), "rows")

    wide = add_group_features(df, groups, [row_id], over=None if scope is None else df.where(scope))
    wide = wide.fillna(STAT_FILL, [g.name for g in groups if g.fn not in ("count", "nunique")])
    features += [g.name for g in groups]

    # Pair features by score.
    if pairs is None:
        pairs = PairFeatureModel.fit(df, cats, label, codes=[codes[c] for c in cats])
    chosen = _wanted([f.name for f in pairs.features], selected)
    wide = pairs.transform(wide, [row_id], only=chosen, scope=scope)
    features += chosen
    features = list(dict.fromkeys(features))
    return FeatureFrame(materialize(wide.select(*keep, *features), "features"), tuple(features), pairs)

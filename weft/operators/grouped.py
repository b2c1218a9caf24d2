"""Group features: statistics of the rows that share a key, put back on each row.

Counts, distinct counts, modes and numeric statistics are all ``GroupFeature``s. Features of one key are
computed by one aggregation and put back by one join; those of several keys come from one table of frequencies (see
``lattice``). Everything is aggregated before it is shuffled, so a key holding a large part of the rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.lattice import FittedStatistics, Statistic, add_statistics
from weft.operators.skew import BROADCAST_KEYS, HOT_ROWS, KeyProfile, attach, key_profiles
from weft.sources.tables import NUM, tagged

ROWS = "_rows"

# The group statistics of a numeric column.
NUM_STATS = ("sum", "mean", "var", "max", "min")

_AGGS = {"sum": F.sum, "mean": F.avg, "var": F.var_samp,
         "std": F.stddev_samp, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class GroupFeature:
    """``fn`` of ``value`` over the rows sharing ``keys``; ``count`` needs no value."""

    name: str
    keys: tuple[str, ...]
    fn: str
    value: str | None = None

    def __post_init__(self) -> None:
        if self.fn not in ("count", "nunique", "mode") and self.fn not in _AGGS:
            raise ValueError(f"unknown group statistic {self.fn!r}")
        if (self.value is None) != (self.fn == "count"):
            raise ValueError(f"{self.fn} and value {self.value!r} do not go together")


def count_of(*keys: str, name: str | None = None) -> GroupFeature:
    return GroupFeature(name or "cnt__" + "__".join(keys), keys, "count")


def nunique_of(keys: str | Sequence[str], value: str, name: str | None = None) -> GroupFeature:
    ks = (keys,) if isinstance(keys, str) else tuple(keys)
    return GroupFeature(name or f"nunique__{'__'.join(ks)}__{value}", ks, "nunique", value)


def mode_of(key: str, value: str, name: str | None = None) -> GroupFeature:
    return GroupFeature(name or f"mode__{key}__{value}", (key,), "mode", value)


def stats_of(key: str, value: str, stats: Sequence[str] = NUM_STATS) -> list[GroupFeature]:
    return [GroupFeature(f"{s}__{key}__{value}", (key,), s, value) for s in stats]


def _stat_table(rows: DataFrame, keys: tuple[str, ...], features: Sequence[GroupFeature]) -> DataFrame:
    """One row per key with every count and numeric statistic of that key, the keys named ``_key0``, ``_key1``, ..."""
    names = [f"_key{i}" for i in range(len(keys))]
    named = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    table = rows.groupBy(*named).agg(F.count(F.lit(1)).alias(ROWS), *[
        _AGGS[f.fn](f.value).alias(f.name) for f in features if f.fn != "count"])
    return table.select(*names, *[
        tagged(F.col(ROWS if f.fn == "count" else f.name), f.name, NUM, "", origin=f.fn) for f in features])


def add_group_features(rows: DataFrame, features: Sequence[GroupFeature],
                       spread: Sequence[str] | None = None, *, over: DataFrame | None = None,
                       broadcast_keys: int = BROADCAST_KEYS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add each feature as a column of ``rows``.

    ``over`` is the table the statistics are taken from when it is not ``rows`` itself (training rows
    only, say). How many keys there are and which are hot decides between a broadcast and a shuffle;
    ``spread`` names columns that tell rows apart.
    """
    if not features:
        return rows
    by_keys: dict[tuple[str, ...], list[GroupFeature]] = {}
    for f in features:
        by_keys.setdefault(f.keys, []).append(f)
    plain = all(f.fn not in ("nunique", "mode") for f in features)
    if len(by_keys) > 1 or not plain:
        stats = [Statistic(f"_f{i}", f.keys, f.fn, f.value) for i, f in enumerate(features)]
        out = add_statistics(rows, stats, _AGGS, over=over, broadcast_keys=broadcast_keys, hot_rows=hot_rows)
        return out.select(*rows.columns, *[
            tagged(F.col(s.name), f.name, NUM, "", origin=f.fn) for s, f in zip(stats, features, strict=True)])
    keys = features[0].keys
    profile = key_profiles(rows, [keys], hot_rows)[keys]
    if over is not None:
        profile = KeyProfile(key_profiles(over, [keys], hot_rows)[keys].distinct, profile.hot)
    source = rows if over is None else over
    out = attach(rows, _stat_table(source, keys, features), keys, profile, spread=spread,
                 table_keys=[f"_key{i}" for i in range(len(keys))], broadcast_keys=broadcast_keys)
    return out.select(*rows.columns, *[f.name for f in features])


def fit_group_features(rows: DataFrame, features: Sequence[GroupFeature]) -> FittedStatistics:
    """The features' statistics on ``rows``, to be put on other rows; see ``FittedStatistics``."""
    return FittedStatistics.fit(rows, [Statistic(f.name, f.keys, f.fn, f.value) for f in features], _AGGS)


def load_group_features(spark: SparkSession, path: str) -> FittedStatistics:
    return FittedStatistics.load(spark, path, _AGGS)


def group_mean_deviation(rows: DataFrame, key: str, values: Sequence[str],
                         spread: Sequence[str] | None = None) -> DataFrame:
    """Group mean of each value and the row's deviation from it."""
    features = [GroupFeature(f"mean__{key}__{v}", (key,), "mean", v) for v in values]
    out = add_group_features(rows, features, spread)
    return out.select("*", *[(F.col(v) - F.col(f.name)).alias(f"dev__{key}__{v}")
                             for v, f in zip(values, features, strict=True)])

"""Pair features chosen by score.

A candidate is a count or distinct count over one category or a pair of categories. Its distribution by
class follows from the frequencies of the category values, so candidates are scored on aggregated tables
and never put on the rows; only the accepted ones are.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.grouped import GroupFeature, add_group_features, fit_group_features, load_group_features
from weft.operators.lattice import FittedStatistics
from weft.operators.scoring import BINS, bin_counts, hellinger, hellinger_scores, mutual_information
from weft.operators.skew import BROADCAST_KEYS
from weft.sources.tables import NUM, tagged
from weft.sources.workspace import materialize

# How many single columns are tried, how many of them are paired, which rank sets the
# threshold, how many features are kept per category, and the term that keeps ratios finite.
TOP_SINGLE = 100
TOP_PAIRED = 50
THRESHOLD_RANK = 30
KEEP_PER_CATEGORY = 3
SMOOTH = 0.01

# Pairs whose frequencies are computed by one job.
PAIRS_PER_JOB = 200


@dataclass(frozen=True)
class PairFeature:
    """``kind`` is count, ratio, per_nunique or nunique; ``b`` is None for a single-column count."""

    kind: str
    a: str
    b: str | None = None

    @property
    def name(self) -> str:
        return f"fe_{self.kind}__{self.a}" + (f"__{self.b}" if self.b else "")


def _zero_if_null(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("0"))


def count_ratio(n_pair: Column, n_a: Column) -> Column:
    """Frequency of the pair relative to its first value."""
    return n_pair / (n_a + F.lit(SMOOTH))


def count_per_nunique(n_a: Column, nunique: Column) -> Column:
    """Frequency of a value relative to the distinct partners it has."""
    return n_a / (nunique + F.lit(SMOOTH))


def pair_frequencies(df: DataFrame, pairs: Sequence[tuple[str, str]], label: str) -> DataFrame:
    """(pair, a, b, n, pos, neg) for every combination of values that occurs, for all pairs at once."""
    parts = F.array(*[F.struct(F.lit(i).alias("pair"), _zero_if_null(a).alias("a"), _zero_if_null(b).alias("b"))
                      for i, (a, b) in enumerate(pairs)])
    rows = df.select(F.col(label).alias("_label"), F.explode(parts).alias("x")).select("_label", "x.*")
    return rows.groupBy("pair", "a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_label") == 1).alias("pos"),
        F.count_if(F.col("_label") == 0).alias("neg"))


def _one_side(freq: DataFrame, side: str) -> DataFrame:
    return freq.groupBy("pair", side).agg(
        F.sum("n").alias("n_one"), F.count(F.lit(1)).alias("partners"),
        F.sum("pos").alias("pos_one"), F.sum("neg").alias("neg_one"))


def candidate_values(freq: DataFrame) -> DataFrame:
    """(feature, value, pos, neg) of every candidate; ``feature`` is ``kind:pair:side``."""
    def feature(kind: str, side: str) -> Column:
        return F.concat(F.lit(f"{kind}:"), F.col("pair").cast("string"), F.lit(f":{side}")).alias("feature")

    parts = [freq.select(feature("count", "a"), F.col("n").cast("double").alias("value"), "pos", "neg")]
    for side in ("a", "b"):
        one = _one_side(freq, side)
        both = freq.join(one, ["pair", side])
        parts += [
            both.select(feature("ratio", side), count_ratio(F.col("n"), F.col("n_one")).alias("value"),
                        "pos", "neg"),
            one.select(feature("per_nunique", side),
                       count_per_nunique(F.col("n_one"), F.col("partners")).alias("value"),
                       F.col("pos_one").alias("pos"), F.col("neg_one").alias("neg")),
            one.select(feature("nunique", side), F.col("partners").cast("double").alias("value"),
                       F.col("pos_one").alias("pos"), F.col("neg_one").alias("neg")),
        ]
    values = parts[0]
    for p in parts[1:]:
        values = values.unionByName(p)
    return values.groupBy("feature", "value").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def score_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], label: str, bins: int = BINS,
                pairs_per_job: int = PAIRS_PER_JOB, measure: str = "hellinger") -> dict[PairFeature, float]:
    """The score of each candidate of each pair: a handful of numbers per pair reaches the driver."""
    out: dict[PairFeature, float] = {}
    for start in range(0, len(pairs), pairs_per_job):
        batch = pairs[start:start + pairs_per_job]
        freq = materialize(pair_frequencies(df, batch, label), "pairs")
        counts = bin_counts(candidate_values(freq), bins)
        scored = hellinger(counts) if measure == "hellinger" else mutual_information(counts)
        for feature, score in scored.collect():
            kind, i, side = feature.split(":")
            a, b = sorted(batch[int(i)]) if kind == "count" else batch[int(i)]
            out[PairFeature(kind, *((a, b) if side == "a" else (b, a)))] = score
    return out


def score_singles(df: DataFrame, columns: Sequence[str], label: str, bins: int = BINS) -> dict[PairFeature, float]:
    """The score of each column's own count."""
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), _zero_if_null(c).alias("v")) for c in columns])
    rows = df.select(F.col(label).alias("_label"), F.explode(parts).alias("x")).select("_label", "x.*")
    freq = rows.groupBy("feature", "v").agg(
        F.count(F.lit(1)).cast("double").alias("value"), F.count_if(F.col("_label") == 1).alias("pos"),
        F.count_if(F.col("_label") == 0).alias("neg"))
    values = freq.groupBy("feature", "value").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return {PairFeature("count", f): s for f, s in hellinger(bin_counts(values, bins)).collect()}


def rank(scores: dict, n: int) -> list:
    """The ``n`` best keys, ties broken by name, so that every run agrees."""
    return sorted(scores, key=lambda k: (-scores[k], getattr(k, "name", k)))[:n]


@dataclass(frozen=True)
class PairFeatureModel:
    """Accepted pair features with their scores; ``transform`` computes them on any rows."""

    features: tuple[PairFeature, ...]
    scores: tuple[float, ...]
    threshold: float

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], label: str, *, codes: Sequence[str] | None = None,
            top_single: int = TOP_SINGLE, top_paired: int = TOP_PAIRED, max_keep: int | None = None,
            bins: int = BINS, pairs_per_job: int = PAIRS_PER_JOB) -> PairFeatureModel:
        """Screen candidates on ``df``.

        ``codes`` are numeric stand-ins for ``columns``, in the same order, by which the columns
        themselves are ranked; by default the columns are numbers already.
        """
        numeric = list(codes or columns)
        own = {r["feature"]: r["score"] for r in hellinger_scores(df, numeric, label, bins).collect()}
        by_column = {c: own[n] for c, n in zip(columns, numeric, strict=True) if n in own}
        singles = rank(by_column, top_single)
        paired = singles[:top_paired]
        ranked = sorted(by_column.values(), reverse=True)
        threshold = ranked[max(min(THRESHOLD_RANK, len(paired)) - 2, 0)] if ranked else 0.0
        scores = score_singles(df, singles, label, bins)
        scores |= score_pairs(df, list(combinations(paired, 2)), label, bins, pairs_per_job)
        better = {f: s for f, s in scores.items() if s is not None and s > threshold}
        kept = rank(better, max_keep if max_keep is not None else KEEP_PER_CATEGORY * len(columns))
        return cls(tuple(kept), tuple(better[f] for f in kept), threshold)

    def transform(self, df: DataFrame, spread: Sequence[str] | None = None, *, scope: Column | None = None,
                  only: Sequence[str] | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
        """Add the accepted features (or those named by ``only``), counted on ``df`` or its rows in ``scope``."""
        chosen = [f for f in self.features if only is None or f.name in only]
        return add_pair_features(df, chosen, spread, scope=scope, broadcast_keys=broadcast_keys)


class _Plan:
    """What pair features need: the columns as text, the group statistics of those, and an expression for each feature."""

    def __init__(self, features: Sequence[PairFeature]) -> None:
        self.text = {c: f"_fe{i}" for i, c in enumerate(sorted({c for f in features for c in (f.a, f.b) if c is not None}))}
        self.needed: dict[tuple, GroupFeature] = {}
        self.out: list[tuple[str, Column]] = []
        for f in features:
            if f.kind == "count":
                c = self._use("count", f.a, f.b) if f.b else self._use("count", f.a)
                self.out.append((f.name, c.cast("double")))
            elif f.kind == "ratio":
                self.out.append((f.name, count_ratio(self._use("count", f.a, f.b), self._use("count", f.a))))
            elif f.kind == "per_nunique":
                self.out.append((f.name, count_per_nunique(self._use("count", f.a), self._use("nunique", f.a, f.b))))
            elif f.kind == "nunique":
                self.out.append((f.name, self._use("nunique", f.a, f.b).cast("double")))
            else:
                raise ValueError(f"unknown pair feature {f.kind!r}")

    def _use(self, fn: str, *cols: str) -> Column:
        """The column of a group statistic, shared by the features that need it."""
        keys, value = (cols[:1], cols[1]) if fn == "nunique" else (tuple(sorted(cols)), None)
        f = self.needed.setdefault((fn, keys, value), GroupFeature(
            f"_g{len(self.needed)}", tuple(self.text[k] for k in keys), fn, self.text[value] if value else None))
        return F.col(f.name)

    def rows(self, df: DataFrame) -> DataFrame:
        return df.select("*", *[_zero_if_null(c).alias(t) for c, t in self.text.items()])

    def finish(self, wide: DataFrame, columns: Sequence[str]) -> DataFrame:
        return wide.select(*columns, *[tagged(c, n, NUM, "", origin="pair") for n, c in self.out])


def add_pair_features(df: DataFrame, features: Sequence[PairFeature], spread: Sequence[str] | None = None,
                      *, scope: Column | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Add pair features to the rows, counted on the rows in ``scope`` if given; null counts as the value 0."""
    plan = _Plan(features)
    rows = plan.rows(df)
    over = None if scope is None else rows.where(scope)
    wide = add_group_features(rows, list(plan.needed.values()), spread, over=over, broadcast_keys=broadcast_keys)
    return plan.finish(wide, df.columns)


@dataclass(frozen=True)
class PairState:
    """Pair features with the frequencies of the rows they were fitted on, in written tables.

    A row's features depend on that state and on the row alone: rows may come in any batches. A value that the fit has not
    seen has a count of 0.
    """

    features: tuple[PairFeature, ...]
    statistics: FittedStatistics | None

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[PairFeature]) -> PairState:
        plan = _Plan(features)
        return cls(tuple(features), fit_group_features(plan.rows(df), list(plan.needed.values())) if features else None)

    def save(self, path: str) -> None:
        spec = json.dumps([[f.kind, f.a, f.b] for f in self.features])
        SparkSession.active().createDataFrame([(spec,)], "value string").coalesce(1).write.text(f"{path}/features")
        if self.statistics is not None:
            self.statistics.save(f"{path}/statistics")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PairState:
        features = tuple(PairFeature(*f) for f in json.loads(spark.read.text(f"{path}/features").first()[0]))
        return cls(features, load_group_features(spark, f"{path}/statistics") if features else None)

    def transform(self, df: DataFrame, *, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
        """Add the features to the rows of a batch."""
        if self.statistics is None:
            return df
        plan = _Plan(self.features)
        wide = self.statistics.put_on(plan.rows(df), broadcast_keys=broadcast_keys)
        return plan.finish(wide.fillna(0, [f.name for f in plan.needed.values()]), df.columns)

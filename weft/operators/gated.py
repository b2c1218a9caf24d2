"""Count features accepted only if they carry information about the label, then scaled to 0..100."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.expressions import centered, column_means, column_ranges, minmax_scale
from weft.operators.grouped import GroupFeature, add_group_features, count_of, nunique_of
from weft.operators.pairs import pair_frequencies
from weft.operators.scoring import BINS, bin_counts, mutual_info, mutual_information
from weft.sources.tables import NUM, tagged
from weft.sources.workspace import materialize

# The information a feature has to exceed and the top of the scale.
THRESHOLD = 0.01
TOP = 100.0
# Fixed value: candidates of a search that are tried together.
SEARCH_BATCH = 8


@dataclass(frozen=True)
class GatedModel:
    """Accepted group features and the ranges they had when fitted; new data is scaled by those."""

    features: tuple[GroupFeature, ...]
    mi: tuple[float, ...]
    ranges: dict[str, tuple[float, float]] = field(hash=False)

    def transform(self, df: DataFrame, spread: Sequence[str] | None = None) -> DataFrame:
        wide = add_group_features(df, self.features, spread)
        return wide.select(*df.columns, *[
            tagged(minmax_scale(f.name, *self.ranges[f.name], TOP), f.name, NUM, "", origin="gated")
            for f in self.features])


def _fit(df: DataFrame, chosen: dict[GroupFeature, float]) -> GatedModel:
    features = sorted(chosen, key=lambda f: (-chosen[f], f.name))
    ranges = column_ranges(add_group_features(df, features), [f.name for f in features]) if features else {}
    return GatedModel(tuple(features), tuple(chosen[f] for f in features), ranges)


def _group_values(df: DataFrame, features: Sequence[GroupFeature], label: str) -> DataFrame:
    """(feature, value, pos, neg) of counts over single columns, from the frequencies alone."""
    parts = F.array(*[F.struct(F.lit(f.name).alias("feature"), F.col(f.keys[0]).cast("string").alias("v"))
                      for f in features])
    rows = df.select(F.col(label).alias("_label"), F.explode(parts).alias("x")).select("_label", "x.*")
    freq = rows.groupBy("feature", "v").agg(
        F.count(F.lit(1)).cast("double").alias("value"), F.count_if(F.col("_label") == 1).alias("pos"),
        F.count_if(F.col("_label") == 0).alias("neg"))
    return freq.groupBy("feature", "value").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def gated_counts(df: DataFrame, columns: Sequence[str], label: str, threshold: float = THRESHOLD,
                 bins: int = BINS) -> GatedModel:
    """Count encodings whose mutual information with the label exceeds the threshold."""
    features = [count_of(c) for c in columns]
    found = {r["feature"]: r["mi"] for r in mutual_information(
        bin_counts(_group_values(df, features, label), bins)).collect()}
    return _fit(df, {f: found[f.name] for f in features if found.get(f.name, 0.0) > threshold})


def best_pairs(df: DataFrame, columns: Sequence[str], codes: Sequence[str], label: str,
               max_pairs: int | None, bins: int = BINS) -> tuple[list[tuple[str, str]], dict[str, float]]:
    """Pairs by the summed information of their columns, best first, and each column's information."""
    by_code = {r["feature"]: r["mi"] for r in mutual_info(df, codes, label, bins).collect()}
    base = {c: by_code.get(k, 0.0) for c, k in zip(columns, codes, strict=True)}
    pairs = sorted(combinations(columns, 2), key=lambda p: (-(base[p[0]] + base[p[1]]), p))
    return pairs[:max_pairs] if max_pairs is not None else pairs, base


def gated_pair_counts(df: DataFrame, columns: Sequence[str], codes: Sequence[str], label: str,
                      threshold: float = THRESHOLD, max_pairs: int | None = None, bins: int = BINS) -> GatedModel:
    """Pair counts, tried best first, kept if their mutual information exceeds the threshold."""
    pairs, _ = best_pairs(df, columns, codes, label, max_pairs, bins)
    freq = pair_frequencies(df, pairs, label)
    values = freq.groupBy(F.col("pair").cast("string").alias("feature"), F.col("n").cast("double").alias("value")
                          ).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    found = mutual_information(bin_counts(values, bins)).collect()
    return _fit(df, {count_of(*sorted(pairs[int(i)])): mi for i, mi in found if mi > threshold})


@dataclass(frozen=True)
class Trial:
    """One candidate of a search: its turn and batch, the summed information of its columns, its own, and whether it was kept."""

    feature: GroupFeature
    turn: int
    batch: int
    expected: float
    mi: float
    accepted: bool


def search_pair_counts(df: DataFrame, columns: Sequence[str], codes: Sequence[str], label: str, *, threshold: float = THRESHOLD,
                       batch: int = SEARCH_BATCH, budget: int | None = None, patience: int | None = None,
                       bins: int = BINS) -> tuple[GatedModel, list[Trial]]:
    """Pair counts tried best first by the summed information of their columns, ``batch`` at a time.

    Each batch is one job over the frequencies of its pairs; what exceeds the threshold is kept before the next batch is
    chosen. The search ends with the candidates, after ``budget`` of them, or after ``patience`` batches in a row of which
    none was kept. Returns the model of the kept features and every trial in order.
    """
    pairs, base = best_pairs(df, columns, codes, label, None, bins)
    tried: list[Trial] = []
    idle = 0
    most = len(pairs) if budget is None else min(budget, len(pairs))
    for number, start in enumerate(range(0, most, batch), 1):
        own = pairs[start:min(start + batch, most)]
        found = _pair_information(df, own, label, bins)
        trials = [Trial(count_of(*sorted(p)), start + i + 1, number, base[p[0]] + base[p[1]], found[i], found[i] > threshold)
                  for i, p in enumerate(own)]
        tried += trials
        idle = 0 if any(t.accepted for t in trials) else idle + 1
        if patience is not None and idle >= patience:
            break
    return _fit(df, {t.feature: t.mi for t in tried if t.accepted}), tried


def _pair_information(df: DataFrame, pairs: Sequence[tuple[str, str]], label: str, bins: int) -> dict[int, float]:
    """Mutual information of each pair's count with the label, from the written frequencies; a number per pair."""
    freq = materialize(pair_frequencies(df, pairs, label), "pairs")
    values = freq.groupBy(F.col("pair").cast("string").alias("feature"), F.col("n").cast("double").alias("value")
                          ).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    found = {int(i): mi for i, mi in mutual_information(bin_counts(values, bins)).collect()}
    return {i: found.get(i, 0.0) for i in range(len(pairs))}


def gated_pair_nuniques(df: DataFrame, columns: Sequence[str], codes: Sequence[str], label: str,
                        threshold: float = THRESHOLD, max_pairs: int | None = None,
                        bins: int = BINS) -> GatedModel:
    """Distinct counts in the better of the two directions of each pair, kept if above the threshold."""
    pairs, _ = best_pairs(df, columns, codes, label, max_pairs, bins)
    freq = pair_frequencies(df, pairs, label)
    sides = None
    for side in ("a", "b"):
        one = freq.groupBy("pair", side).agg(F.count(F.lit(1)).cast("double").alias("value"),
                                             F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        one = one.select(F.concat(F.col("pair").cast("string"), F.lit(f":{side}")).alias("feature"),
                         "value", "pos", "neg")
        sides = one if sides is None else sides.unionByName(one)
    values = sides.groupBy("feature", "value").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    best: dict[tuple[str, str], tuple[float, GroupFeature]] = {}
    for feature, mi in mutual_information(bin_counts(values, bins)).collect():
        i, side = feature.split(":")
        a, b = pairs[int(i)]
        f = nunique_of(a, b) if side == "a" else nunique_of(b, a)
        # the better direction; on a tie the one first by name
        if (a, b) not in best or (-mi, f.name) < (-best[a, b][0], best[a, b][1].name):
            best[a, b] = (mi, f)
    chosen = {f: mi for mi, f in best.values() if mi > threshold}
    return _fit(df, chosen)


def centered_if_better(df: DataFrame, columns: Sequence[str], label: str, bins: int = BINS) -> dict[str, float]:
    """The columns whose mutual information with the label grows when their mean is taken off, with the mean.

    Equal-width bins move with the values, so with this estimate centering changes nothing beyond rounding.
    """
    means = column_means(df, columns)
    both = df.select(label, *columns, *[centered(c, means[c]).alias(f"{c}_centered") for c in columns])
    mi = {r["feature"]: r["mi"]
          for r in mutual_info(both, [*columns, *[f"{c}_centered" for c in columns]], label, bins).collect()}
    return {c: means[c] for c in columns if mi.get(f"{c}_centered", 0.0) > mi.get(c, 0.0)}

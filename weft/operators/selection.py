"""Feature selection by model importance, and the combined report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.model import ROUNDS, TRIALS, TreeParams, assemble, importance_table, train, train_until, tune
from weft.operators.ordered import OrderedRows
from weft.operators.profile import collinear, missing_fractions, single_unique
from weft.operators.sampling import tuning_sample
from weft.sources.workspace import materialize

# Rounds of selection, and the divisor of the tuning sample.
SELECTION_ROUNDS = 2
TUNING_PART = 6


def importance_select(df: DataFrame, columns: Sequence[str], row_id: str, label: str, *,
                      max_features: int | None = None, rounds: int = ROUNDS, trials: int = TRIALS,
                      seed: int = 1, stop_share: float | None = None) -> tuple[list[str], DataFrame]:
    """Keep columns of more than mean importance in a fit on all rows, then the same again among the rest.

    With ``stop_share`` that part of the rows is not fitted and ends each fit (see ``train_until``). Returns the kept columns, best round first, and the
    table (round, feature, importance, kept, rounds): ``rounds`` are the boosting rounds that the fit took. ``df`` is read
    several times and should be a written table.
    """
    base = df.select(row_id, label, *columns)
    params = TreeParams()
    if trials > 0:
        sample = tuning_sample(base, row_id, label, max(base.count() // TUNING_PART, 1), seed)
        params, _ = tune(assemble(sample, columns, [row_id, label]), label, trials, rounds, seed)
    left, kept, record = list(columns), [], []
    for i in range(SELECTION_ROUNDS):
        if not left:
            break
        vectors = assemble(base, left, [row_id, label])
        model = (train(vectors, label, params, rounds, seed) if stop_share is None
                 else train_until(vectors, row_id, label, params, rounds, stop_share, seed=seed).model)
        weight = dict(zip(left, map(float, model.featureImportances.toArray()), strict=True))
        mean = sum(weight.values()) / len(weight)
        best = sorted((c for c in left if weight[c] > mean), key=lambda c: (-weight[c], c))
        record += [(i + 1, c, weight[c], c in best, model.getNumTrees) for c in left]
        kept += best
        left = [c for c in left if c not in best]
    if max_features is not None:
        kept = kept[:max_features]
    table = df.sparkSession.createDataFrame(record, "round int, feature string, importance double, kept boolean, rounds int")
    return kept, table


def mean_importances(df: DataFrame, columns: Sequence[str], row_id: str, label: str, *, runs: int = 5,
                     rounds: int = 100, seed: int = 1) -> DataFrame:
    """(feature, importance) averaged over differently seeded fits."""
    vectors = materialize(assemble(df, columns, [row_id, label]), "vectors")
    tables = [importance_table(train(vectors, label, TreeParams(stepSize=0.05, subsamplingRate=0.85), rounds,
                                     seed + i), columns, df) for i in range(runs)]
    total = tables[0]
    for t in tables[1:]:
        total = total.unionByName(t)
    return total.groupBy("feature").agg(F.avg("importance").alias("importance"))


def importance_cut(importances: DataFrame, cumulative: float = 0.95) -> DataFrame:
    """Normalised and cumulative importance, with the zero and the low-importance columns marked.

    The running share goes from the most important column down, equal ones by name.
    """
    table = importances.select("feature", "importance", (-F.col("importance")).alias("_down"))
    run = OrderedRows(table, [], ["_down", "feature"]).running_sum(["importance"], "_run")
    scale = F.lit(float(table.agg(F.sum("importance")).first()[0] or 1.0))
    share = F.col("_run") / scale
    return run.select("feature", "importance", (F.col("importance") / scale).alias("normalized"), share.alias("cumulative"),
                      (F.col("importance") == 0).alias("zero_importance"), (share > cumulative).alias("low_importance"))


def feature_report(df: DataFrame, columns: Sequence[str], numeric: Sequence[str], *,
                   missing_threshold: float, correlation_threshold: float,
                   importances: DataFrame | None = None, cumulative: float = 0.95) -> DataFrame:
    """(feature, reason) for every column some method would drop."""
    parts = [
        missing_fractions(df, columns).where(F.col("missing_fraction") > missing_threshold).select(
            "feature", F.lit("missing").alias("reason")),
        single_unique(df, columns).where("single_unique").select("feature", F.lit("single_unique").alias("reason")),
        collinear(df, numeric, correlation_threshold).select(
            F.col("drop_feature").alias("feature"), F.lit("collinear").alias("reason")).distinct(),
    ]
    if importances is not None:
        cut = importance_cut(importances, cumulative)
        parts += [cut.where("zero_importance").select("feature", F.lit("zero_importance").alias("reason")),
                  cut.where("low_importance").select("feature", F.lit("low_importance").alias("reason"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drop_reported(df: DataFrame, report: DataFrame, reasons: Sequence[str] | None = None) -> DataFrame:
    """``df`` without the reported columns (those with one of ``reasons``, if given)."""
    hit = report if reasons is None else report.where(F.col("reason").isin(list(reasons)))
    return df.drop(*{r["feature"] for r in hit.select("feature").distinct().collect()})

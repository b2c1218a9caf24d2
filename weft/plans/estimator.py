"""From related tables to scores: merge, engineer, select, train, score."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.clean import take_split, union_split
from weft.operators.merge import merge_graph
from weft.operators.model import ROUNDS, STOP_SHARE, TRIALS, assemble, ensemble_score, train_ensemble
from weft.operators.sampling import class_counts, skew_sample
from weft.operators.selection import importance_select
from weft.plans.features import FeatureFrame, engineer
from weft.sources.tables import TableSet, retag
from weft.sources.workspace import materialize

# Fixed value: the share of the training rows the selection sample aims at, per class.
SELECTION_PART = 10


@dataclass
class RelationalModel:
    """Learn from a labelled table set, score new main rows.

    Features are selected on a sample of the training rows and then computed, selected ones only, on
    training and new rows together. With ``fit_scope`` "all" counts and statistics cover both, with
    "train" the training rows alone.
    """

    n_models: int = 3
    rounds: int = ROUNDS
    trials: int = TRIALS
    max_features: int | None = None
    fill: str = "before"
    fit_scope: str = "all"
    seed: int = 1
    stop_share: float = STOP_SHARE
    tables: TableSet | None = None
    models: list[GBTClassificationModel] = field(default_factory=list)
    selected: list[str] = field(default_factory=list)
    importances: DataFrame | None = None

    def fit(self, tables: TableSet) -> RelationalModel:
        """Take the tables in; the work happens when there are rows to score."""
        if tables.label is None:
            raise ValueError("the table set needs a label")
        if self.fit_scope not in ("all", "train"):
            raise ValueError(f"unknown fit scope {self.fit_scope!r}")
        self.tables = tables
        return self

    def _merged(self, test: DataFrame) -> DataFrame:
        t = self.tables
        main = t.tables[t.main]
        both = union_split(main, test.drop(t.label) if t.label in test.columns else test)
        merged = merge_graph(t.with_table(t.main, both), fill=self.fill)
        return materialize(merged, "merged")

    def predict(self, test: DataFrame) -> DataFrame:
        """(row id, score) for every row of ``test``."""
        if self.tables is None:
            raise ValueError("call fit first")
        t = self.tables
        keep = [t.row_id, t.label, "split"]
        merged = self._merged(test)
        train = take_split(merged, "train")
        n_rows = sum(class_counts(train, t.label))
        part = skew_sample(train, t.row_id, t.label, max(n_rows // SELECTION_PART, 1), self.seed)
        part = materialize(retag(part, merged), "sample")
        sampled: FeatureFrame = engineer(part, t, keep, label=t.label)
        self.selected, self.importances = importance_select(
            sampled.df, sampled.features, t.row_id, t.label, max_features=self.max_features,
            rounds=self.rounds, trials=self.trials, seed=self.seed, stop_share=self.stop_share)
        scope = F.col("split") == "train" if self.fit_scope == "train" else None
        full = engineer(merged, t, keep, pairs=sampled.pairs, selected=set(self.selected), scope=scope)
        chosen = [c for c in self.selected if c in full.features]
        rows = take_split(full.df, "train").withColumn(t.label, F.col(t.label).cast("int"))
        self.models = train_ensemble(rows, chosen, t.row_id, t.label, self.n_models, self.rounds, self.trials,
                                     self.seed, stop_share=self.stop_share)
        vectors = assemble(take_split(full.df, "test"), chosen, [t.row_id])
        return ensemble_score(vectors, self.models, t.row_id)

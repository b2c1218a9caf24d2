"""All registered queries with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.operators.candidates import key_column_pairs, key_num_stats, pair_counts
from weft.operators.grouped import add_group_features
from weft.operators.merge import merge_graph
from weft.queries import counting, merging, models, rows, sampling, scoring
from weft.queries.fixtures import order_graph
from weft.sources.workspace import materialize

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    **merging.QUERIES, **counting.QUERIES, **rows.QUERIES, **scoring.QUERIES, **sampling.QUERIES, **models.QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five tables merged into one, with pair counts and group statistics on every order."""
    graph = order_graph(spark, sf_dir)
    # written once: each statistic reads only its columns of it
    merged = materialize(merge_graph(graph), "merged")
    skip = [graph.row_id]
    features = pair_counts(key_column_pairs(merged, graph.relations, skip=skip)) + key_num_stats(
        merged, graph.relations, skip=skip)
    return add_group_features(merged, features, skip)

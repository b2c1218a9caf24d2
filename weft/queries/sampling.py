"""Samples and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import sampling as S
from weft.queries import fixtures as X


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return X.orders(spark, sf).select("o_orderkey", "label")


def _rare(spark: SparkSession, sf: str) -> DataFrame:
    """A rare label: orders of very high value."""
    o = X.orders(spark, sf)
    return o.select("o_orderkey", (F.col("o_totalprice") > 49_900_000).cast("int").alias("label"))


def balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    return S.balanced_sample(_rows(spark, sf), "o_orderkey", "label", cap=2_000)


def skew_sample(spark: SparkSession, sf: str) -> DataFrame:
    return S.skew_sample(_rare(spark, sf), "o_orderkey", "label", rows=1_000)


def tuning_sample(spark: SparkSession, sf: str) -> DataFrame:
    return S.tuning_sample(_rare(spark, sf), "o_orderkey", "label", rows=1_000)


def ensemble_sample(spark: SparkSession, sf: str) -> DataFrame:
    return S.ensemble_sample(_rows(spark, sf), "o_orderkey", "label", seed=7)


def neg_sample_excl(spark: SparkSession, sf: str) -> DataFrame:
    """Negatives that an earlier balanced draw of the rare label did not use."""
    rows = _rare(spark, sf)
    used = S.balanced_sample(rows, "o_orderkey", "label", seed=3).where("label = 0")
    return S.negatives_excluding(rows, "o_orderkey", "label", used, seed=4)


def row_sample(spark: SparkSession, sf: str) -> DataFrame:
    return S.row_sample(_rows(spark, sf), "o_orderkey", 5_000, seed=5)


def train_val_split(spark: SparkSession, sf: str) -> DataFrame:
    train, val = S.train_val_split(_rows(spark, sf), "o_orderkey", 0.2, seed=1)
    return train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))


_ROWS = f"SELECT o_orderkey, label FROM ({X.ORDERS_SQL}) o"
_RARE = f"SELECT o_orderkey, CAST(o_totalprice > 49900000 AS INTEGER) AS label FROM ({X.ORDERS_SQL}) o"


def _sample_sql(rows: str, sizes: str, seed: int) -> str:
    """``sizes`` gives want1 and want0 from the class counts p and n."""
    return f"""WITH b AS ({rows}), c AS (SELECT sum(label) AS p, sum(1 - label) AS n FROM b), z AS ({sizes}),
 r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(o_orderkey || ':{seed}'), o_orderkey) AS r FROM b)
 SELECT o_orderkey, label FROM r, z WHERE r <= CASE WHEN label = 1 THEN want1 ELSE want0 END"""


QUERIES = {
    "balanced_sample": (balanced_sample, _sample_sql(
        _ROWS, "SELECT least(p, n, 2000) AS want1, least(p, n, 2000) AS want0 FROM c", 1)),
    "skew_sample": (skew_sample, _sample_sql(_RARE, """SELECT least(p, n, 1000) AS want1,
 CASE WHEN p / n < 0.001 THEN n // 4 WHEN least(p, n, 1000) < 200 THEN least(1000, n) ELSE least(p, n, 1000) END
 AS want0 FROM c""", 1)),
    "tuning_sample": (tuning_sample, _sample_sql(_RARE, """SELECT least(p, n, 1000) AS want1,
 CASE WHEN p / n < 0.01 THEN n // 6 WHEN least(p, n, 1000) < n / 5 THEN n ELSE least(p, n, 1000) END
 AS want0 FROM c""", 1)),
    "ensemble_sample": (ensemble_sample, _sample_sql(_ROWS, """SELECT
 CASE WHEN p > n AND 2 * n < p THEN 2 * n ELSE least(p, n) END AS want1,
 CASE WHEN p < n AND 2 * p < n THEN 2 * p ELSE least(p, n) END AS want0 FROM c""", 7)),
    "neg_sample_excl": (neg_sample_excl, f"""WITH b AS ({_RARE}), c AS (SELECT sum(label) AS p, sum(1 - label) AS n
 FROM b), u AS (SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || ':3'),
 o_orderkey) AS r FROM b WHERE label = 0), c WHERE r <= least(p, n, 10000)),
 f AS (SELECT o_orderkey, label, row_number() OVER (ORDER BY md5(o_orderkey || ':4'), o_orderkey) AS r FROM b
 WHERE label = 0 AND o_orderkey NOT IN (SELECT o_orderkey FROM u))
 SELECT o_orderkey, label FROM f, c WHERE r <= floor(2.5 * p)
 UNION ALL SELECT o_orderkey, label FROM b WHERE label = 1"""),
    "row_sample": (row_sample, f"SELECT o_orderkey, label FROM ({_ROWS}) b"
                               " ORDER BY md5(o_orderkey || ':5'), o_orderkey LIMIT 5000"),
    "train_val_split": (train_val_split, f"""SELECT o_orderkey, label,
 CASE WHEN substr(md5(o_orderkey || ':1'), 1, 15) < '333333333333333' THEN 'val' ELSE 'train' END AS part FROM ({_ROWS}) b"""),
}

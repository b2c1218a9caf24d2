"""Written intermediate tables in the folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which every executor has to reach."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet and read it back.

    The lineage ends at the files, so a lost executor never replays the plan above them, later scans
    prune columns, and the optimizer sees real sizes when it chooses a join.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/weft/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Sums of small arrays over all rows: one array per task, added up by lanes of tasks, then lane by lane."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups that the tasks' arrays are added up in, so what comes to the driver is this many arrays at any size.
LANES = 64


def array_sum(rows: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None],
              dtype: type = np.float64) -> np.ndarray | None:
    """The sum of what ``task`` gives for each task's batches; None where no task gives one.

    The arrays are added in the order of the tasks, so a run on the same partitions repeats to the last bit.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = task(batches)
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              pa.array([made.astype(dtype).tobytes()], pa.binary())], ["task", "value"])

    def lane(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("task")
        total = None
        for value in group["value"]:
            part = np.frombuffer(value, dtype)
            total = part.copy() if total is None else np.add(total, part, out=total)
        return pd.DataFrame({"lane": [int(group["task"].iloc[0]) % LANES], "value": [total.tobytes()]})

    parts = rows.mapInArrow(own, "task long, value binary").groupBy(F.col("task") % LANES).applyInPandas(
        lane, "lane long, value binary")
    total = None
    for row in sorted(parts.collect(), key=lambda r: r["lane"]):  # LANES rows at most
        part = np.frombuffer(row["value"], dtype)
        total = part.copy() if total is None else total + part
    return total

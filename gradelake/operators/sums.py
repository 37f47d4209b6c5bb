"""Sums of arrays over many tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial sums that one task adds up, and levels of such sums.
FAN, LEVELS = 64, 3


def tree_sum(parts: DataFrame, keys: list[str], levels: int = LEVELS) -> DataFrame:
    """keys, v: the sums by position of the arrays v (of one length) of each key. parts: keys, _task (the task that gave a row), v. Summed as a tree: FAN rows of a key meet in a task. levels: one is enough for up to FAN tasks."""

    def add(t: pa.Table) -> pa.Table:
        v = t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1).sum(0)
        return pa.table({**{k: t.column(k).slice(0, 1) for k in (*keys, "_task")}, "v": pa.array([v], pa.list_(pa.float64()))})

    for level in range(1, levels + 1):
        at = F.lit(0).cast("long") if level == levels else F.floor(F.col("_task") / FAN)
        parts = parts.withColumn("_task", at).groupBy(*keys, "_task").applyInArrow(add, parts.schema)
    return parts.drop("_task")


def column_matrix(c: pa.Array) -> np.ndarray:
    """The rows of an array column, all of one length."""
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(c), -1)

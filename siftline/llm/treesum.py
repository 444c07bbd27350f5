"""Sums of large numpy vectors over all partitions, a bounded number at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut

FAN = 16
SCHEMA = "slot bigint, payload binary"


def payload(vector: np.ndarray) -> pa.RecordBatch:
    """One row that carries a float64 vector, in the slot of the running task."""
    slot = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([np.asarray(vector, np.float64).tobytes()], pa.binary())], names=["slot", "payload"])


def tree_sum(parts: DataFrame, length: int) -> np.ndarray:
    """Sum of the payloads of ``parts``, one per partition at most, through a tree of FAN-fold sums.

    Slots fix the order of additions, so a task that runs again gives the same
    bits. No task holds more than two vectors; only the total reaches the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(1):
                vector = np.frombuffer(raw.as_py(), np.float64)
                total = vector.copy() if total is None else total + vector
        if total is not None:
            yield payload(total)

    left = max(parts.rdd.getNumPartitions(), 1)
    parts = cut(parts)
    while left > 1:
        left = -(-left // FAN)
        parts = parts.withColumn("slot", F.floor(F.col("slot") / FAN)).repartitionByRange(left, "slot").sortWithinPartitions("slot").mapInArrow(add, SCHEMA)
        if left > 1:
            parts = cut(parts)
    total = np.zeros(length)
    for row in parts.collect():
        total += np.frombuffer(row["payload"], np.float64)
    return total

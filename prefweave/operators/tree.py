"""Large arrays, one from each task, added up in a tree of tasks.

No task holds more than a few blocks at once, and the driver gets the sum alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 16  #: elements in one row
FAN = 32  #: arrays added up in one task
SHAPE = "block int, part int, data binary"


def shipped(array: np.ndarray) -> pa.RecordBatch:
    """Rows of ``SHAPE`` of a task's flat array; blocks of zeros aren't sent, but for the first."""
    part = TaskContext.get().partitionId()
    rows = [(i // BLOCK, part, zlib.compress(b.tobytes(), 1)) for i in range(0, len(array), BLOCK) if (b := array[i : i + BLOCK]).any() or not i]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["block", "part", "data"])


def gathered(df: DataFrame, size: int, dtype: type, add: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add) -> np.ndarray:
    """The sum of all arrays of ``df``, which holds rows of ``shipped``; ``FAN`` of them meet in a task. Zeros for no rows."""

    def combine(table: pa.Table) -> pa.Table:
        total = None
        for c in table["data"]:
            x = np.frombuffer(zlib.decompress(c.as_py()), dtype)
            total = x if total is None else add(total, x)
        return pa.table({"block": table["block"][:1], "part": table["part"][:1], "data": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    most = df.agg(F.max("part")).first()[0]
    while most:
        df = df.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("block", "part").applyInArrow(combine, SHAPE)
        most //= FAN
    total = np.zeros(size, dtype)
    for r in df.toLocalIterator():
        x = np.frombuffer(zlib.decompress(r["data"]), dtype)
        at = slice(r["block"] * BLOCK, r["block"] * BLOCK + len(x))
        total[at] = add(total[at], x)
    return total

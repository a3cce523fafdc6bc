"""Fixed-size tables of counts, summed over all tasks in slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.textkernel import tidied

SLICE = 1 << 16
#: Tasks whose tables are added up together, before all are.
TASKS = 64
PART = "grp int, slice int, counts binary, width int"


def _part(group: int, k: int, counts: np.ndarray) -> pa.RecordBatch:
    high = int(counts.max(initial=0))
    kind = np.dtype(next(t for t in (np.uint16, np.uint32, np.uint64) if high <= np.iinfo(t).max))
    return pa.RecordBatch.from_pydict({"grp": pa.array([group], pa.int32()), "slice": pa.array([k], pa.int32()), "counts": pa.array([counts.astype(kind).tobytes()], pa.binary()), "width": pa.array([kind.itemsize], pa.int32())})


def sliced(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's table as rows of PART, slices of nothing but zeros left out."""
    group = TaskContext.get().partitionId() // TASKS
    for k in range(0, len(total), SLICE):
        if total[k : k + SLICE].any():
            yield _part(group, k // SLICE, total[k : k + SLICE])


def _add(batches):
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for g, k, blob, width in zip(*(batch.column(c).to_pylist() for c in ("grp", "slice", "counts", "width")), strict=True):
            got = np.frombuffer(blob, f"u{width}").astype(np.int64)
            total[g, k] = total[g, k] + got if (g, k) in total else got
    for (g, k), v in total.items():
        yield _part(g, k, v)


def added_up(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of the tasks' tables (rows of PART); only the sum reaches the driver.

    Tables are added up in groups of tasks first, so what one task reads grows by a
    table for each TASKS tasks only.
    """
    some = parts.select("grp", "slice", "counts", "width").repartition("grp", "slice").mapInArrow(_add, PART)
    out = np.zeros(size, np.int64)
    for _, k, blob, width in some.withColumn("grp", F.lit(0)).repartition("slice").mapInArrow(_add, PART).collect():
        out[k * SLICE : (k + 1) * SLICE] = np.frombuffer(blob, f"u{width}")
    return out


def summed_table(rows: DataFrame, count: Callable[[Iterator], np.ndarray], size: int) -> np.ndarray:
    """The sum over all tasks of ``count``'s array of ``size`` counts."""
    return added_up(rows.mapInArrow(tidied(lambda batches: sliced(count(batches))), PART), size)

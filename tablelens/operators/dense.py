"""Dense sums over the rows of a table: helpers of operators that work on blocks of a feature matrix.

A task turns its rows into numpy blocks of bounded size, keeps one small matrix,
and hands it on as one row.  Those rows meet in groups of ``FAN_IN``, level by
level, so no task and not the driver ever sees one matrix per task of a large job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.layout import materialize
from ..functions.typing_rules import qcol

FAN_IN = 32
BLOCK_CELLS = 1 << 18

_SCHEMA = "part long, cells array<double>"


def complete_rows(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """The features and the label as doubles x0, x1, ..., y, without rows that lack one (NaN counts as missing)."""
    columns = [qcol(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)] + [qcol(label).cast("double").alias("y")]
    rows = df.select(*columns)
    keep = F.lit(True)
    for c in rows.columns:
        keep = keep & F.col(c).isNotNull() & ~F.isnan(c)
    return rows.where(keep)


def fold(rows: DataFrame, add: Callable[[np.ndarray | None, np.ndarray], np.ndarray],
         merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """One array from all rows of doubles: ``add`` takes in blocks of rows, ``merge`` joins two results (flat arrays).

    A missing value arrives as NaN.  None without rows.
    """
    width = len(rows.columns)
    size = max(1, BLOCK_CELLS // width)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            block = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for at in range(0, len(block), size):
                state = add(state, block[at:at + size])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              pa.array([state.ravel().tolist()], pa.list_(pa.float64()))], ["part", "cells"])

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        state = None
        for cells in frame["cells"]:
            state = np.asarray(cells) if state is None else merge(state, np.asarray(cells))
        return pd.DataFrame({"part": [int(frame["part"].iloc[0]) // FAN_IN], "cells": [state.tolist()]})

    level = materialize(rows.mapInArrow(own, _SCHEMA))
    while (n := level.count()) > FAN_IN:
        # parts are partition numbers: neighbours meet, and each level has FAN_IN times fewer
        level = materialize(level.groupBy(F.floor(F.col("part") / FAN_IN).alias("group")).applyInPandas(together, _SCHEMA))
    state = None
    for r in level.orderBy("part").collect() if n else []:  # at most FAN_IN rows
        state = np.asarray(r["cells"]) if state is None else merge(state, np.asarray(r["cells"]))
    return state

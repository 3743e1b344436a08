"""Sums of short tables over all tasks: each task emits its own table in blocks, which other tasks add up."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Rows of a table that travel together.
BLOCK = 250
SCHEMA = "block int, sums binary"


def emitted(table: np.ndarray) -> pd.DataFrame:
    """What a task returns for its table."""
    starts = range(0, len(table), BLOCK)
    return pd.DataFrame({"block": list(starts), "sums": [np.ascontiguousarray(table[s : s + BLOCK], float).tobytes() for s in starts]})


def added(frame: pd.DataFrame, width: int) -> np.ndarray:
    """The tables of one block, added up."""
    return sum(np.frombuffer(b).reshape(-1, width) for b in frame["sums"])


def total(df: DataFrame, work, size: int, width: int) -> np.ndarray:
    """The sum of the ``size`` x ``width`` tables that ``work`` makes of the batches of every task."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": frame["block"][:1], "sums": [added(frame, width).tobytes()]})

    out = np.zeros((size, width))
    for row in df.mapInPandas(work, SCHEMA).groupBy("block").applyInPandas(add, SCHEMA).collect():
        out[row["block"] : row["block"] + BLOCK] = np.frombuffer(row["sums"]).reshape(-1, width)
    return out

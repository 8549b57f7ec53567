"""Meeting of equal hashes from all documents, without a hot key.

Each map task folds the rows of an Arrow batch first, so a hash leaves it once for each of its batches that hold it,
however many documents of the batch do; what meets in one reducer under one hash grows with the number of batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .store import partitions


def by_hash(df: DataFrame, keys: list[str], schema: str, work) -> DataFrame:
    """Rows shuffled by the hash columns; ``work(columns)`` gets a partition's columns as arrays and returns columns."""
    names = df.columns

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        columns = {n: np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in held]) for n in names}
        held.clear()
        for out in work(columns):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out.values()], names=list(out))

    return df.repartition(partitions(df.sparkSession), *keys).mapInArrow(run, schema)


def groups(*keys: np.ndarray, then: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """(order by the keys and then by others, begin of each run of equal keys in that order)."""
    order = np.lexsort((*keys, *then)[::-1])
    if not len(order):
        return order, np.zeros(0, np.int64)
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def run_of(begin: np.ndarray, n: int) -> np.ndarray:
    """The number of the run that each of n sorted rows is in."""
    out = np.zeros(n, np.int64)
    out[begin[1:]] = 1
    return np.cumsum(out)

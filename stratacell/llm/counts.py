"""Count vectors of a fixed length, summed over all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: A vector travels in so many strands, which are summed by as many tasks.
STRANDS = 16
SCHEMA = "k int, counts binary"


def strands(counts: np.ndarray, first: int = 0) -> Iterator[pa.RecordBatch]:
    """A task's vector, strand by strand; several vectors of a task differ in ``first``."""
    for k in range(STRANDS):
        part = np.ascontiguousarray(counts[k::STRANDS], dtype=np.int64)
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([first * STRANDS + k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["k", "counts"])


def _add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for pdf in batches:
        for k, blob in zip(pdf["k"], pdf["counts"]):
            part = np.frombuffer(blob, np.int64)
            total[k] = total[k] + part if k in total else part
    for k, x in total.items():
        yield pd.DataFrame({"k": [k], "counts": [x.tobytes()]})


def gather(partial: DataFrame, length: int, vectors: int = 1) -> list[np.ndarray]:
    """The sums; the driver gets ``vectors`` times ``length`` numbers, whatever the corpus."""
    out = [np.zeros(length, np.int64) for _ in range(vectors)]
    for r in partial.repartition(STRANDS * vectors, "k").mapInPandas(_add, SCHEMA).toLocalIterator():
        out[r.k // STRANDS][r.k % STRANDS :: STRANDS] = np.frombuffer(r["counts"], np.int64)
    return out

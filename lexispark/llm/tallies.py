"""Sums of fixed-size count vectors over all tasks, without one task or the driver seeing them all at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

CHUNK = 4096
ROW = "vector int, chunk int, counts binary"
KIND = pa.schema([("vector", pa.int32()), ("chunk", pa.int32()), ("counts", pa.binary())])


def chunks(vectors: np.ndarray):
    """A task's vectors as Arrow rows of ``CHUNK`` counts; all-zero chunks are left out."""
    for i, vector in enumerate(np.asarray(vectors, np.int64)):
        parts = vector.reshape(-1, CHUNK)
        full = np.flatnonzero(parts.any(1))
        if len(full):
            yield K.record(KIND, np.full(len(full), i), full, pa.array([parts[j].tobytes() for j in full], pa.binary()))


def _add(batches):
    key, sums = None, None
    for batch in batches:
        for vector, chunk, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != (vector, chunk):
                if key is not None:
                    yield K.record(KIND, [key[0]], [key[1]], pa.array([sums.tobytes()], pa.binary()))
                key, sums = (vector, chunk), np.zeros(CHUNK, np.int64)
            sums += np.frombuffer(counts, np.int64)
    if key is not None:
        yield K.record(KIND, [key[0]], [key[1]], pa.array([sums.tobytes()], pa.binary()))


def total(parts: DataFrame, vectors: int, size: int) -> np.ndarray:
    """The summed ``vectors`` x ``size`` counts (a fixed size, whatever the corpus holds)."""
    summed = parts
    for salt in (F.pmod(F.monotonically_increasing_id(), F.lit(16)), F.lit(0)):  # 16 partial sums, then one
        summed = summed.withColumn("salt", salt).repartition("vector", "chunk", "salt").sortWithinPartitions("vector", "chunk", "salt").drop("salt").mapInArrow(_add, ROW)
    out = np.zeros((vectors, size // CHUNK, CHUNK), np.int64)
    for row in summed.collect():
        out[row["vector"], row["chunk"]] += np.frombuffer(row["counts"], np.int64)
    return out.reshape(vectors, size)

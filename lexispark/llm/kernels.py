"""NumPy kernels over whole Arrow batches of UTF-8 text: no Python object is made per word or byte."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; a longer text is handled alone.
BLOCK = 1 << 22

# ASCII white space of the word definition [^\x20\x09-\x0D]+ .
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ROOT = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_ROOT_INVERSE = pow(_ROOT, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=8)
def byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 0x1234567) + np.uint64(seed))


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, BLOCK + 1)
            for name, root in (("up", _ROOT), ("down", _ROOT_INVERSE)):
                steps = np.full(size, root, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        if n <= BLOCK + 1 < len(cls.up):  # a very long text came by: let its tables go again
            cls.up, cls.down = cls.up[: BLOCK + 1].copy(), cls.down[: BLOCK + 1].copy()
        return cls.up, cls.down


class Spans:
    """Hashes of any byte range of ``data`` in constant time: differences of prefix sums, shifted back."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        up, self.down = _Powers.get(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_table(seed)[data] * up[: len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = self.sums[end] - self.sums[start]
        out *= self.down[start]
        out += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix(out)

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all ranges of ``size`` bytes."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = self.sums[size:] - self.sums[:n]
        out *= self.down[:n]
        return mix(out)


def text_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null text has no bytes."""
    col = batch.column(batch.schema.get_field_index(name))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def blocks(data: np.ndarray, offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most ``size`` bytes; one row at least."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that stay within a row: starts, ends, and where each row's runs begin."""
    before = np.empty_like(mask)
    before[1:] = mask[:-1]
    before[offsets[:-1][offsets[:-1] < len(mask)]] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty_like(mask)
    after[:-1] = mask[1:]
    ends = offsets[1:] - 1
    after[ends[ends >= 0]] = False
    if len(mask):
        after[-1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each row: starts, ends, and where each row's words begin."""
    return runs(~SPACE[data], offsets)


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each row (0 for an empty one)."""
    sums = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; far faster than hashing for the millions of integers of a block."""
    out = np.sort(values)
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    return out[fresh]


def row_index(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ids_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def record(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

"""Arrow kernels over list columns: whole batches at once, no shuffle, no Python object a word where Arrow has a kernel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sizes(lists: pa.Array) -> np.ndarray:
    """Items of each list; none of a null one."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def rebuilt(lists: pa.Array, counts: np.ndarray, values: pa.Array) -> pa.Array:
    """Lists of new sizes over new values; null where ``lists`` is."""
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=lists.is_null() if lists.null_count else None)


def coder(spark, keys: pa.Array, ids: np.ndarray, missing: int):
    """A column function from lists of words to lists of ids; ``keys`` is of bounded size."""
    held = spark.sparkContext.broadcast((keys, np.append(ids, missing).astype(np.int32)))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def code(words: pa.Array) -> pa.Array:
        known, table = held.value
        at = pc.fill_null(pc.index_in(words.flatten(), value_set=known), len(known))
        return rebuilt(words, sizes(words), pa.array(table[at.to_numpy(zero_copy_only=False)], pa.int32()))

    return code


def keeper(spark, keys: pa.Array):
    """A column function that drops from lists the words that are not among ``keys`` (of bounded size)."""
    held = spark.sparkContext.broadcast(keys)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def keep(words: pa.Array) -> pa.Array:
        flat = words.flatten()
        known = pc.is_in(flat, value_set=held.value)
        sums = np.concatenate([[0], np.cumsum(known.to_numpy(zero_copy_only=False))])
        ends = np.cumsum(sizes(words))
        return rebuilt(words, sums[ends] - sums[ends - sizes(words)], flat.filter(known))

    return keep


def gathered(batches, column: str, most: int = 1_000_000):
    """Tables of many batches each, cut where their lists in ``column`` hold ``most`` items together."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += int(sizes(batch.column(column)).sum())
        if n >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def whole(table: pa.Table, column: str) -> pa.Array:
    """A column as one array, in however many chunks it lies."""
    chunks = table.column(column).chunks
    return chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks) if chunks else pa.array([], table.schema.field(column).type)


def window_sums(spark, keys: pa.Array | None, window: int, weigh, least: int = 0):
    """For mapInArrow over one column of lists: (pair, x), the weights of words up to ``window`` apart, summed over many lists.

    Lists hold words, coded by their places among ``keys``, or ids; unknown words and ids below ``least`` go, and positions
    close up.  A pair is two ids, the smaller in the upper half of a long.  ``weigh`` gives the weight of each distance.
    """
    held = spark.sparkContext.broadcast(keys) if keys is not None else None
    weights = np.array([0.0, *(weigh(d) for d in range(1, window + 1))])

    def run(batches):
        for table in gathered(batches, "ws"):
            lists_ = whole(table, "ws")
            row, flat = np.repeat(np.arange(len(lists_)), sizes(lists_)), lists_.flatten()
            if held is not None:
                flat = pc.index_in(flat, value_set=held.value)
            ids = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = ids >= least
            ids, row = ids[known], row[known]
            keys_, sums = np.zeros(0, np.int64), np.zeros(0)
            for d in range(1, window + 1):
                same = row[:-d] == row[d:]
                a, b = ids[:-d][same], ids[d:][same]
                pair = np.sort(np.minimum(a, b) << 32 | np.maximum(a, b))
                first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
                keys_ = np.concatenate([keys_, pair[first]])
                sums = np.concatenate([sums, np.diff(np.append(first, len(pair))) * weights[d]])
            order = np.argsort(keys_, kind="stable")
            keys_, sums = keys_[order], sums[order]
            first = np.flatnonzero(np.concatenate([[True], keys_[1:] != keys_[:-1]])) if len(keys_) else np.zeros(0, np.int64)
            out = pa.table({"pair": keys_[first], "x": np.add.reduceat(sums, first) if len(first) else sums})
            yield from out.to_batches(100_000)

    return run


def reader(spark, names: list[str | None], unknown: str):
    """A column function from lists of ids to lists of their names; ``names`` is by id, and of bounded size."""
    held = spark.sparkContext.broadcast(pa.array([unknown if n is None else n for n in [*names, None]], pa.string()))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def read(ids: pa.Array) -> pa.Array:
        table = held.value
        at = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
        at = np.where((at < 0) | (at >= len(table)), len(table) - 1, at)
        return rebuilt(ids, sizes(ids), table.take(pa.array(at)))

    return read


def mapper(spark, one, model, size: int = 200_000):
    """A column function from lists of words to the joined lists that ``one(model, word)`` gives; a task keeps up to ``size`` of them."""
    held = spark.sparkContext.broadcast(model)
    cache: dict[str, np.ndarray] = {}

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def spread(words: pa.Array) -> pa.Array:
        if len(cache) > size:
            cache.clear()
        coded = words.flatten().dictionary_encode()
        found = []
        for word in coded.dictionary.to_pylist():
            if word not in cache:
                cache[word] = np.asarray(one(held.value, word), np.int32)
            found.append(cache[word])
        many = np.array([len(x) for x in found], np.int64)
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = many[at]
        start = (np.cumsum(many) - many)[at]
        ids = flat[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        sums, ends, own = np.concatenate([[0], np.cumsum(n)]), np.cumsum(sizes(words)), sizes(words)
        return rebuilt(words, sums[ends] - sums[ends - own], pa.array(ids, pa.int32()))

    return spread


def or_empty(lists: Column, kind: str = "array<int>") -> Column:
    return F.coalesce(lists, F.array().cast(kind))

"""Exact top-k by a bit-sliced index.

Vectors become integers; bit j of component d of all vectors of a block is one bitmap (a slice).  A
query's score is a weighted sum of components, so a block is scored for all its rows at once by
adding slices with bitmap arithmetic: per power of two, carry-save adders reduce three bitmaps to a
sum and a carry until two remain.  The lowest ``DROPPED`` bit of each component is left out of the
slices, which bounds the error of the sliced score by a known amount.  Going from the most
significant sum slice downward gives the k-th best sliced score; every row within the error bound of
it is a boundary row and is resolved by its exact inner product.

The index is a table with one row for each block: row numbers, vec_ids, vectors in the narrowest type
that holds them, and the slices, built once.  Blocks of queries meet it by key; each pair yields at
most k rows a query.

Edge cases: vectors that are null, empty, of another length than most (the shorter of a tie), or hold
a null or non-finite component take no part, neither as queries nor as candidates; nor do rows
without a vec_id.  Equal scores go to the smaller vec_id.  Rows that repeat a vec_id are rows of their
own, as queries (each with ranks of its own) and as candidates, also of each other; only the query's
own row is no candidate of it.  Components beyond 64 bits are held at their bounds and so are scores;
below that every score is exact.  With fewer than k candidates a query has as many rows; an empty
table gives none.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import work

SCALE = 64
TOP = 20
#: Rows of a candidate block; queries of one block at most and at least.
CANDIDATES = 16_384
QUERIES, FEWEST = 2048, 128
#: Low bits left out of the slices, made good exactly for boundary rows.
DROPPED = 1

_BLOCK = "rows binary, ids binary, kind string, values binary, maps binary, width int"


class Slices:
    """The bitmaps of one block of integer vectors; ``maps`` are taken as they are if the index has them."""

    def __init__(self, values: np.ndarray, maps: bytes | None = None):
        self.values = values
        self.n, self.width = values.shape
        self.words = -(-self.n // 64)
        self.largest = max(int(values.max(initial=0)), -int(values.min(initial=0)))
        self.all = np.packbits(np.arange(self.words * 64) < self.n, bitorder="little").view(np.uint64)
        if maps is not None:
            self.maps = np.frombuffer(maps, np.uint64).reshape(self.width, -1, self.words)
            self.bits = self.maps.shape[1]
            return
        low = values.min(0) if self.n else np.zeros(self.width, np.int64)
        coarse = (values.view(np.uint64) - low.view(np.uint64)) >> np.uint64(DROPPED)  # differences of 64 bits have no sign
        self.bits = max(1, int(coarse.max(initial=0)).bit_length())
        self.maps = np.zeros((self.width, self.bits, self.words), np.uint64)
        for j in range(self.bits):
            packed = np.zeros((self.width, self.words * 64), np.uint8)
            packed[:, : self.n] = (coarse.T >> np.uint64(j)) & np.uint64(1)
            self.maps[:, j] = np.packbits(packed, axis=1, bitorder="little").view(np.uint64)

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of sum(|q| * (coarse, or its complement where q is negative)), least significant first."""
        columns: list[list[np.ndarray]] = []
        size = np.abs(query).view(np.uint64)  # right for the least integer too
        for weight in range(int(size.max(initial=0)).bit_length()):
            use = np.flatnonzero((size >> np.uint64(weight)) & np.uint64(1))
            if len(use):
                flip = np.where(query[use] < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None]
                for j in range(self.bits):
                    while len(columns) <= weight + j:
                        columns.append([])
                    columns[weight + j].append(self.maps[use, j] ^ flip)
        out, carried = [], None
        level = 0
        while level < len(columns) or carried is not None:
            here = columns[level] if level < len(columns) else []
            if carried is not None:
                here = [*here, carried]
            stack = np.concatenate(here) if here else np.zeros((1, self.words), np.uint64)
            carries = []
            while len(stack) > 2:  # carry-save: three bitmaps become a sum here and a carry one level up
                third = len(stack) // 3
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                half = a ^ b
                carries.append((a & b) | (half & c))
                stack = np.concatenate([half ^ c, stack[3 * third :]])
            if len(stack) == 2:
                carries.append((stack[:1] & stack[1:]))
                stack = stack[:1] ^ stack[1:]
            out.append(stack[0])
            carried = np.concatenate(carries) if carries else None
            level += 1
        return out

    def top(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that can be among the k best: all whose sliced score is within the error bound of the k-th best."""
        if self.n <= 2 * k:
            return np.arange(self.n)
        slices = self.sums(query)
        sure, open_, need, value = np.zeros(self.words, np.uint64), self.all, k, 0
        for j in range(len(slices) - 1, -1, -1):
            ones = open_ & slices[j]
            many = int(np.bitwise_count(ones).sum())
            if many >= need:
                open_, value = ones, value | (1 << j)
            else:
                sure, open_, need = sure | ones, open_ & ~slices[j], need - many
        # Exact score = 2**DROPPED * sliced score + constant + error, 0 <= q * error <= |q| * (2**DROPPED - 1).
        slack = -(-sum(map(abs, query.tolist())) * ((1 << DROPPED) - 1) // (1 << DROPPED))
        floor = max(0, value - slack)
        above, equal = np.zeros(self.words, np.uint64), self.all
        for j in range(len(slices) - 1, -1, -1):
            if floor >> j & 1:
                equal = equal & slices[j]
            else:
                above, equal = above | (equal & slices[j]), equal & ~slices[j]
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little", count=self.n))


def best(slices: Slices, rows: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact (vec_id, score) of the k best rows other than row ``own``."""
    at = slices.top(query, k + 1)  # one more, in case the query itself is among them
    at = at[rows[at] != own]
    if slices.largest * sum(map(abs, query.tolist())) < 1 << 63:
        score = slices.values[at] @ query
    else:  # sums beyond 64 bits: exact integers decide, and what is told is held at the bounds
        exact = slices.values[at].astype(object) @ query.astype(object)
        order = sorted(range(len(at)), key=lambda i: (-exact[i], ids[at[i]]))[:k]
        return ids[at[order]], np.array([min(max(exact[i], -(1 << 63)), (1 << 63) - 1) for i in order], np.int64)
    order = np.lexsort((ids[at], -score))[:k]
    return ids[at[order]], score[order]


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, q): the usable vectors as integers."""
    number = F.transform("embedding", lambda x: x.cast("double"))
    usable = (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False))).select("vec_id", F.transform(number, lambda x: F.floor(F.lit(float(SCALE)) * x)).alias("q"))


def _packed(rows: DataFrame, blocks: int, name: str, index: bool) -> DataFrame:
    """The vectors in ``blocks`` rows; with their slices if they are to be searched."""

    def pack(key, table):
        order = np.argsort(table.column("row").to_numpy())
        number, ids = (table.column(c).to_numpy().astype(np.int64)[order] for c in ("row", "vec_id"))
        values = table.column("q").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(len(ids), -1)[order]
        kind = next(t for t in ("int8", "int16", "int32", "int64") if not len(values) or (values.min() >= np.iinfo(t).min and values.max() <= np.iinfo(t).max))
        maps = Slices(np.ascontiguousarray(values)).maps.tobytes() if index else b""
        data = [pa.array([x], pa.binary()) for x in (number.tobytes(), ids.tobytes(), values.astype(kind).tobytes(), maps)]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "rows": data[0], "ids": data[1], "kind": pa.array([kind]), "values": data[2], "maps": data[3], "width": pa.array([values.shape[1]], pa.int32())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row", F.lit(5)), F.lit(blocks)))
    return work.staged(dealt.groupBy("block").applyInArrow(pack, f"block long, {_BLOCK}"), name)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = np.frombuffer(row["values"], row["kind"]).astype(np.int64).reshape(-1, row["width"])
    return np.frombuffer(row["rows"], np.int64), np.frombuffer(row["ids"], np.int64), values


def top_k(vectors: DataFrame, every: int = 20, k: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    held = work.staged(quantised(vectors).withColumn("row", F.monotonically_increasing_id()), "slice-rows")
    widths = held.groupBy(F.size("q").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    result = "query_id long, rank int, vec_id long, score long"
    if not widths:
        return spark.createDataFrame([], result)
    rows = held.filter(F.size("q") == widths[0]["width"])
    asks = F.col("vec_id") % every == 0
    n, asked = rows.agg(F.count("*"), F.count(F.when(asks, 1))).first()
    work.short_batches(spark, 4)  # rows are blocks from here on
    n_blocks = work.parts_for(n, CANDIDATES, 1)
    # Large blocks of queries, but enough of them to keep all tasks at work.
    q_blocks = max(work.parts_for(asked, QUERIES, 1), min(work.parts_for(asked, FEWEST, 1), work.parts_for(2 * work.shuffle_width(spark), n_blocks, 1)))
    blocks = _packed(rows, n_blocks, "slice-index", True)
    queries = _packed(rows.filter(asks), q_blocks, "slice-queries", False)
    work.discard(held)
    # Every block of queries against every block of vectors, dealt by the pair.
    left = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).withColumn("side", F.lit(0))
    right = queries.withColumnRenamed("block", "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("side", F.lit(1))
    columns = ["block", "part", "side", "rows", "ids", "kind", "values", "maps", "width"]
    pairs = left.select(*columns).unionByName(right.select([F.col(c).cast(t) for c, t in left.select(*columns).dtypes]))
    kind = pa.schema([("asking", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def score(_key, table):
        by_side = {row["side"]: row for row in table.to_pylist()}
        if len(by_side) < 2:  # a block number that no query, or no vector, fell into
            return kind.empty_table()
        numbers, ids, values = _unpacked(by_side[0])
        slices, out = Slices(values, by_side[0]["maps"]), []
        for own, query_id, query in zip(*_unpacked(by_side[1]), strict=True):
            got, points = best(slices, numbers, ids, query, own, k)
            out.append((np.full(len(got), own), np.full(len(got), query_id), got, points))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=kind)

    found = pairs.groupBy("block", "part").applyInArrow(score, "asking long, query_id long, vec_id long, score long")
    order = Window.partitionBy("asking").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(work.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE = """
with v as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor(64.0 * cast(x as double)) as bigint)) as q from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.row as asking, a.vec_id as query_id, b.vec_id,
         cast(list_inner_product(cast(a.q as double[]), cast(b.q as double[])) as bigint) as score
  from v a join v b on a.row <> b.row where a.vec_id % 20 = 0),
r as (select *, row_number() over (partition by asking order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""

"""Mixing sources to target weights.

The words of each source form one stream, cut into blocks of a fixed number of words.  The output is
dealt in shards: each draws its source counts from a multinomial, and what the draws leave above or
below a source's share is handed from the sources with too many slots to those with too few, so that
the totals are exact.  A source's slots are numbered through all shards; slot j reads the block at
place j of a pseudorandom permutation of the source's blocks (a keyed Feistel network, a new one for
each pass), and blocks meet slots in a join on (source, block).

Every draw and permutation depends on a seed and on numbers only, and the streams are ordered by
(bucket of the id's hash, id, hash of the text), so reruns agree whatever the partitioning is.

Edge cases: a null source is one source of its own, the last.  Null and blank texts have size 0 and
nothing is taken of them.  Rows that repeat a doc_id are separate entries of the stream, also where
all their columns agree; a null doc_id comes first in its bucket.  A very long text is cut by blocks
like any other.  An empty table gives no rows.  Other columns are ignored by ``plan`` and carried along
by ``mix``.  The table of sources (name, size, target) is held by the driver and every task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import work

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 512
SEED = 20_240_229
#: Slots that one task puts out, more or less.
SLOTS = 1 << 20
#: Above this many sources their table is joined by key and no longer broadcast.
BROADCAST_SOURCES = 100_000


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Targets by weight that add up to ``share`` of all sizes, none above ``most`` times its size."""
    out = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), list(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


class Permutation:
    """A keyed permutation of 0..n-1: four Feistel rounds over a power of four, walked until back in range."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
        with np.errstate(over="ignore"):
            self.keys = K.mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % (1 << 64)))

    def _once(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        bits, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> bits, x & low
        for key in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (K.mix(left + key) & low), left
            else:
                left, right = right, left ^ (K.mix(right + key) & low)
        return (left << bits) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), self.keys, back)
        while (outside := np.flatnonzero(out >= np.uint64(self.n))).size:
            out[outside] = self._once(out[outside], self.keys, back)
        return out.astype(np.int64)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, False)

    def place(self, block: int) -> int:
        """Where ``forward`` puts this block."""
        return int(self._walk(np.array([block]), True)[0])


@dataclass
class Source:
    name: str | None
    size: int
    target: float
    key: int
    block: int

    @property
    def blocks(self) -> int:
        return -(-self.size // self.block)

    def permutation(self, turn: int) -> Permutation:
        return Permutation(self.blocks, self.key + 1_000_003 * turn)

    def slots(self) -> tuple[int, int]:
        """How many slots this source fills, and the words that the last of them takes."""
        if not self.size:
            return 0, 0
        turns, rest = divmod(math.floor(self.target), self.size)
        if not rest:
            return turns * self.blocks, self.block
        short = self.block * self.blocks - self.size  # words that the last block lacks
        place = self.permutation(turns).place(self.blocks - 1)
        taken = lambda j: j * self.block - short * (place < j)
        j = rest // self.block
        while taken(j) < rest:
            j += 1
        return turns * self.blocks + j, rest - taken(j - 1)


def _streams(docs: DataFrame) -> tuple[DataFrame, list[Source], int]:
    """(doc_id, size, mark, s, offset) of every row, staged; the sources in order."""
    spark = docs.sparkSession
    slim = work.staged(
        docs.select(
            "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("mark")
        ),
        "mix-sizes",
    )
    per_source = slim.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    order = sorted(per_source, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    goal = targets([r["size"] for r in order], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(order))])
    sources = [Source(r["source"], r["size"], t, SEED + 7_919 * i, BLOCK_WORDS) for i, (r, t) in enumerate(zip(order, goal, strict=True))]
    rows = sum(r["rows"] for r in order)
    names = spark.createDataFrame([(i, s.name, s.size, s.target) for i, s in enumerate(sources)], "s int, name string, source_size long, target double")
    if len(sources) <= BROADCAST_SOURCES:
        names = F.broadcast(names)
    # A source may hold a third of all rows: its stream is ordered by bucket, and buckets are summed first.
    buckets = max(1, math.ceil(rows / max(500, math.isqrt(rows))))
    slim2 = slim.join(names, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(buckets)))
    sums = slim2.groupBy("s", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("s", "bucket").orderBy("doc_id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim2.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, ["s", "bucket"])
    out = work.staged(placed.select("doc_id", "source", "size", "mark", "s", "source_size", "target", (F.col("base") + F.col("inner")).alias("offset")), "mix-streams")
    work.discard(slim)
    return out, sources, rows


def draw(spark: SparkSession, sources: list[Source], seed: int = SEED) -> DataFrame:
    """(s, block, turn, take, shard): one row for each slot of the output."""
    need, last = (np.array(x, np.int64) for x in zip(*[s.slots() for s in sources], strict=True)) if sources else (np.zeros(0, np.int64),) * 2
    kind = "s int, block long, turn int, take long, shard long"
    total = int(need.sum())
    if not total:
        return spark.createDataFrame([], kind)
    size = max(1024, math.isqrt(total))
    shards = -(-total // size)
    share = need / total

    def counts(batches):
        out = pa.schema([("shard", pa.int64()), ("s", pa.int32()), ("n", pa.int64())])
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                n = np.random.default_rng([seed, shard]).multinomial(min(size, total - shard * size), share)
                full = np.flatnonzero(n)
                yield K.record(out, np.full(len(full), shard), full, n[full])

    drawn = spark.range(0, shards, 1, min(shards, work.shuffle_width(spark))).mapInArrow(counts, "shard long, s int, n long")
    sums = {r["s"]: r["n"] for r in drawn.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    got = np.array([sums.get(i, 0) for i in range(len(sources))], np.int64)
    above, below = np.maximum(got - need, 0), np.maximum(need - got, 0)
    base, open_ = np.cumsum(above) - above, np.cumsum(below) - below
    before = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spans = drawn.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))

    def slots(batches):
        out = pa.schema([("s", pa.int32()), ("block", pa.int64()), ("turn", pa.int32()), ("take", pa.int64()), ("shard", pa.int64())])
        for batch in batches:
            for shard, s, n, start in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "s", "n", "start")], strict=True):
                parts = [(s, start, min(start + n, int(need[s])))]
                if start + n > need[s]:  # handed on to the sources that drew too few
                    a = base[s] + max(start, int(need[s])) - need[s]
                    b = base[s] + start + n - need[s]
                    for d in np.flatnonzero((open_ < b) & (open_ + below > a)):
                        lo, hi = max(a, open_[d]), min(b, open_[d] + below[d])
                        parts.append((int(d), int(got[d] + lo - open_[d]), int(got[d] + hi - open_[d])))
                for d, lo, hi in parts:
                    for at in range(lo, hi, 1 << 16):
                        yield from _blocks(out, sources[d], d, np.arange(at, min(hi, at + (1 << 16))), int(need[d]), int(last[d]), shard)

    # The window leaves all spans of a source in one task; dealt anew, with a number that adaptive execution keeps.
    width = max(work.shuffle_width(spark), -(-total // SLOTS))
    return spans.repartition(width, "shard", "s").mapInArrow(slots, kind)


def _blocks(out: pa.Schema, source: Source, s: int, slot: np.ndarray, need: int, last: int, shard: int):
    turn = slot // source.blocks
    for t in np.unique(turn):
        here = slot[turn == t]
        block = source.permutation(int(t)).forward(here % source.blocks)
        take = np.where(here == need - 1, last, source.block)
        yield K.record(out, np.full(len(here), s), block, np.full(len(here), t), take, np.full(len(here), shard))


def segments(streams: DataFrame, sources: list[Source]) -> DataFrame:
    """(s, offset, turn, first, words): the words of each row that each pass takes, ``first`` counted in the row."""
    b = F.lit(BLOCK_WORDS)
    pieces = streams.filter("size > 0").select(
        "s", "offset", "size", F.explode(F.sequence(F.floor(F.col("offset") / b), F.floor((F.col("offset") + F.col("size") - 1) / b))).alias("block")
    )
    # The slots grow with the corpus, whatever the planner takes the size of a drawn table to be: never broadcast.
    met = pieces.join(draw(streams.sparkSession, sources).hint("merge"), ["s", "block"])
    start = F.greatest(F.col("offset"), F.col("block") * b)
    end = F.least(F.col("offset") + F.col("size"), F.col("block") * b + F.col("take"))
    return met.select("s", "offset", "turn", (start - F.col("offset")).alias("first"), (end - start).alias("words")).filter("words > 0")


def plan(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every row."""
    streams, sources, _ = _streams(docs)
    taken = segments(streams, sources).groupBy("s", "offset").agg(F.sum("words").alias("taken"))
    key = F.when(F.col("size") > 0, F.col("offset"))  # rows of size 0 share their place with the next one
    return (
        streams.withColumn("key", key).join(taken.withColumnRenamed("offset", "key").hint("merge"), ["s", "key"], "left")
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """The mixture as documents: for each row and pass one row with the words taken, in order.

    A row taken whole keeps its exact text; one taken in part keeps the text from the first to the
    last word of each stretch, joined by blanks.  ``n_chars``, if there, follows the text; other
    columns stay as they are.
    """
    streams, sources, _ = _streams(docs)
    got = segments(streams, sources).groupBy("s", "offset", "turn").agg(
        F.array_sort(F.collect_list(F.struct("first", "words"))).alias("parts"), F.sum("words").alias("n")
    )  # parts of one row: at most its words / BLOCK_WORDS + 2
    got = got.hint("merge").join(streams.filter("size > 0"), ["s", "offset"]).select("doc_id", "source", "mark", "size", "turn", "parts", "n")
    whole = docs.withColumn("__mark", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).dropDuplicates(["doc_id", "source", "__mark"])  # equal in all columns
    same = [F.col("w.doc_id").eqNullSafe(F.col("g.doc_id")), F.col("w.source").eqNullSafe(F.col("g.source")), F.col("w.__mark") == F.col("g.mark")]
    joined = whole.alias("w").join(got.hint("merge").alias("g"), same[0] & same[1] & same[2])
    cut = F.when(F.col("g.n") == F.col("g.size"), F.col(f"w.{text}")).otherwise(_stretches(F.col(f"w.{text}"), F.col("g.parts")))
    out = joined.select(*[cut.alias(text) if c == text else F.col(f"w.`{c}`").alias(c) for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out


def _stretches(text: Column, parts: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.array_join(F.slice(tokens, p["first"].cast("int") + 1, p["words"].cast("int")), " ")), " ")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = work.columns(work.table(spark, sf_dir, "documents"), doc_id="long", source="string", text="string")
    work.short_batches(spark, 10_000)
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken", "source")

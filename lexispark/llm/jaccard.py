"""N-gram Jaccard join: documents whose sets of five-word shingles overlap by at least 75 %, and their components.

Texts with equal sets form a class; all further work is on classes.  Two sets can only be linked if
their prefixes (the rarest n - ceil(0.75 n) + 1 shingles under one global order) share a shingle,
so classes meet in the buckets of their prefix shingles.  Frequent shingles come last in that order,
which keeps them out of most prefixes.

1. Each class is compared with the leader of the bucket family that it shares most shingles with, so
   that a group of near copies costs one comparison a member.
2. Buckets with one leader are taken together; those that still hold more than one component are cut
   into tiles of bounded size.  Within a tile sets are banded by the width of their signatures, which
   follows their size; only sizes within 4:3 of each other are looked at, and hashed bitmap signatures
   bound the overlap from above: |A & B| <= |A| - bits(A without B).
3. Pairs that pass are intersected exactly, on the sorted shingle arrays, and linked.

Step 2 first takes a few pairs for each two components and then, once those are joined, all the
remaining ones, so no link between different texts is lost.  Shingles are compared by 64-bit hashes.

Edge cases: A-Z are lower-cased; a text with one to four words has its whole sequence as its only
shingle; a null text or one without words has an empty set, is linked with nothing and is its own
component.  Rows that repeat a doc_id are rows of their own with the same component if their sets
are linked.  A row with null doc_id joins its component but never names it.  A very long text is one
block of its own, whole, and its signature grows with its set up to 8 KB.  An empty table gives no rows.  Other
columns are ignored, whatever their names; ``one_of_each`` passes them through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph, work
from . import kernels as K

WORDS = 5
#: A link needs PARTS * intersection >= LEAST * union.
LEAST, PARTS = 75, 100
#: Shingles seen at least this often within one stretch of a task, and in all such stretches, come last in the order.
STRETCH = 3_000_000
OFTEN_HERE, OFTEN = 3, 24
#: Bound of the broadcast table of frequent shingles; those beyond it only cost time.
FREQUENT = 1 << 20
#: Rows of one tile side, and members compared with one leader in one task.
TILE = 4096
MEMBERS = 256
#: Bits of the widest signature: a class that meets many families is copied into a tile of each.
WIDEST = 1 << 16
#: Pairs that a task remembers, so as not to put them out again for another leader.
REMEMBERED = 1 << 18
#: Pairs taken for each two components of a tile before the rest is looked at.
FIRST_PAIRS = 4

_MULTIPLIERS = K.mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


class Sets:
    """The sorted shingle sets of a block of texts: ``hashes[at[i]:at[i + 1]]`` belongs to row i."""

    def __init__(self, block: np.ndarray, offsets: np.ndarray):
        lower = K.LOWER[block]
        starts, ends, first = K.words(lower, offsets)
        word = K.Spans(lower).hash(starts, ends)
        count = np.diff(first)
        whole = np.maximum(count - WORDS + 1, 0)
        single = (count > 0) & (count < WORDS)
        n = len(word) - WORDS + 1
        rows = len(count)
        if n > 0:
            grams = np.zeros(n, np.uint64)
            for j in range(WORDS):
                grams += word[j : j + n] * _MULTIPLIERS[j]
            inside = np.ones(n, bool)
            for j in range(1, WORDS):
                edge = first[1:] - j
                inside[edge[(edge >= 0) & (edge < n)]] = False
            grams = K.mix(grams[inside])
        else:
            grams = np.zeros(0, np.uint64)
        at = np.concatenate([[0], np.cumsum(np.where(single, 1, whole))])
        hashes = np.zeros(at[-1], np.uint64)
        long = np.repeat(~single, np.where(single, 1, whole))
        hashes[long] = grams
        for i in np.flatnonzero(single):
            own = word[first[i] : first[i + 1]]
            hashes[at[i]] = K.mix(np.array([(own * _MULTIPLIERS[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))]))[0] ^ np.uint64(0x5851F42D4C957F2D)
        for i in np.flatnonzero(np.diff(at) > 1):
            hashes[at[i] : at[i + 1]].sort()
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = hashes[1:] != hashes[:-1]
        fresh[at[:-1][at[:-1] < len(hashes)]] = True
        self.hashes = hashes[fresh]
        kept = np.concatenate([[0], np.cumsum(fresh)])
        self.at = kept[at]
        self.n = np.diff(self.at)
        self.rows = rows

    def keys(self) -> np.ndarray:
        """A 64-bit name of each set."""
        out = np.zeros(self.rows, np.uint64)
        full = np.flatnonzero(self.n)
        if len(full):
            out[full] = np.add.reduceat(K.mix(self.hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77)), self.at[full])
        return K.mix(out + self.n.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64)

    def signature(self, i: int) -> bytes:
        """A bitmap of a power of two bits, at least four times as many as the set has members but at most ``WIDEST``."""
        own = self.hashes[self.at[i] : self.at[i + 1]]
        wide = min(max(64, 4 << (len(own) - 1).bit_length()), WIDEST)
        bits = np.zeros(wide, bool)
        bits[(own >> np.uint64(20)).astype(np.int64) & (wide - 1)] = True
        return np.packbits(bits, bitorder="little").tobytes()


def prefix_size(n: np.ndarray) -> np.ndarray:
    return n - -(-LEAST * n // PARTS) + 1


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least intersection that links sets of these sizes."""
    return -(-LEAST * (a + b) // (PARTS + LEAST))


SEEN = "doc_id long, mark long, n int, k long, sig binary, token long, often long"


def _survey(batches):
    """A row for each document; a row for each shingle that a stretch of the task has often."""
    kind = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int32()), ("k", pa.int64()), ("sig", pa.binary()), ("token", pa.int64()), ("often", pa.int64())])
    met: set[int] = set()
    pool: list[np.ndarray] = []
    size = 0

    def flush():
        token, often = np.unique(np.concatenate(pool), return_counts=True)
        here = often >= OFTEN_HERE
        n = int(here.sum())
        if n:
            yield K.record(kind, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), token[here].view(np.int64), often[here])

    for batch in batches:
        data, offsets = K.text_of(batch, "text")
        for a, b, block, at in K.blocks(data, offsets):
            sets = Sets(block, at)
            keys = sets.keys()
            sigs: list[bytes | None] = [None] * sets.rows
            for i in range(sets.rows):
                if sets.n[i] and keys[i] not in met:
                    met.add(keys[i])
                    sigs[i] = sets.signature(i)
                    pool.append(sets.hashes[sets.at[i] : sets.at[i + 1]])
                    size += sets.n[i]
            none = pa.nulls(b - a, pa.int64())
            yield K.record(kind, K.ids_of(batch, "doc_id").slice(a, b - a), K.ids_of(batch, "mark").slice(a, b - a), sets.n, pa.array(keys, pa.int64(), mask=sets.n == 0), pa.array(sigs, pa.binary()), none, none)
            if size > STRETCH:
                yield from flush()
                pool, size = [], 0
    if pool:
        yield from flush()


class Order:
    """The global order: shingles not known to be frequent by hash, then the frequent ones, rarest first."""

    def __init__(self, token: np.ndarray, often: np.ndarray):
        by_hash = np.argsort(token)
        self.token = token[by_hash]
        rank = np.empty(len(token), np.int64)
        rank[np.lexsort((token, often))] = np.arange(len(token))
        self.rank = rank[by_hash]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.token & np.uint64(0xFFFFF)] = True

    def prefixes(self, sets: Sets, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix shingles of these rows, and the row of each."""
        size = prefix_size(sets.n)
        maybe = np.flatnonzero(self.filter[sets.hashes & np.uint64(0xFFFFF)]) if len(self.token) else np.zeros(0, np.int64)
        place = np.searchsorted(self.token, sets.hashes[maybe])
        hit = self.token[np.minimum(place, len(self.token) - 1)] == sets.hashes[maybe] if len(maybe) else np.zeros(0, bool)
        hot, rank = maybe[hit], self.rank[place[hit]] if len(maybe) else place
        hot_row = np.searchsorted(sets.at, hot, "right") - 1
        touched = np.zeros(sets.rows, bool)
        touched[hot_row] = True
        out, of = [], []
        plain = rows[~touched[rows]]
        if len(plain):
            take = size[plain]
            base = np.repeat(sets.at[plain] - np.concatenate([[0], np.cumsum(take)[:-1]]), take)
            out.append(sets.hashes[base + np.arange(take.sum())])
            of.append(np.repeat(plain, take))
        span = np.searchsorted(hot_row, np.arange(sets.rows + 1))
        for i in rows[touched[rows]]:
            own = sets.hashes[sets.at[i] : sets.at[i + 1]]
            here = hot[span[i] : span[i + 1]] - sets.at[i]
            cold = np.ones(len(own), bool)
            cold[here] = False
            ordered = np.concatenate([own[cold], own[here[np.argsort(rank[span[i] : span[i + 1]])]]])
            out.append(ordered[: size[i]])
            of.append(np.full(size[i], i))
        return (np.concatenate(out), np.concatenate(of)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _prefix_rows(order):
    kind = pa.schema([("token", pa.int64()), ("k", pa.int64()), ("n", pa.int32())])

    def run(batches):
        met: set[int] = set()
        for batch in batches:
            data, offsets = K.text_of(batch, "text")
            for _, _, block, at in K.blocks(data, offsets):
                sets = Sets(block, at)
                keys = sets.keys()
                rows = []
                for i in np.flatnonzero(sets.n):
                    if keys[i] not in met:  # copies within a task are one class already
                        met.add(keys[i])
                        rows.append(i)
                token, of = order.value.prefixes(sets, np.array(rows, np.int64))
                yield K.record(kind, token.view(np.int64), keys[of], sets.n[of])

    return run


MEMBER = "token long, k long, n int, leader long"


def _shared_buckets(batches):
    """Of rows ordered by (token, k): those of tokens with two classes at least, with the first class as leader."""
    kind = pa.schema([("token", pa.int64()), ("k", pa.int64()), ("n", pa.int32()), ("leader", pa.int64())])
    held = None  # the last run's (token, leader, leader's n, last k, whether the leader was put out)
    for batch in batches:
        token, k, n = (c.to_numpy() for c in batch.columns)
        if not len(token):
            continue
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (k[1:] != k[:-1])
        if held and token[0] == held[0] and k[0] == held[3]:
            fresh[0] = False
        token, k, n = token[fresh], k[fresh], n[fresh]
        if not len(token):
            continue
        begins = np.ones(len(token), bool)
        begins[1:] = token[1:] != token[:-1]
        goes_on = bool(held and token[0] == held[0])
        if goes_on and not held[4]:
            yield K.record(kind, [held[0]], [held[1]], [held[2]], [held[1]])
        if goes_on:
            begins[0] = False
        run = np.cumsum(begins) - 1  # -1: goes on with the held run
        at = np.flatnonzero(begins)
        lead = np.where(run >= 0, k[at[np.maximum(run, 0)]] if len(at) else 0, held[1] if goes_on else 0)
        size = np.bincount(run[run >= 0], minlength=len(at))
        multi = (run < 0) | (size[np.maximum(run, 0)] > 1) if len(at) else np.ones(len(token), bool)
        if multi.any():
            yield K.record(kind, token[multi], k[multi], n[multi], lead[multi])
        if run[-1] >= 0:
            first = at[-1]
            held = (token[-1], k[first], n[first], k[-1], bool(multi[-1]))
        else:
            held = (held[0], held[1], held[2], k[-1], True)


def _verify(batches):
    """Rows ordered by (a, salt, side): a leader's text, then its members'.  Puts out the linked pairs."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    leader, own = None, None
    for batch in batches:
        a, side, b = (K.ids_of(batch, c).to_numpy() for c in ("a", "side", "b"))
        data, offsets = K.text_of(batch, "text")
        out = []
        for lo, _, block, at in K.blocks(data, offsets):
            sets = Sets(block, at)
            for j in range(sets.rows):
                i = lo + j
                mine = sets.hashes[sets.at[j] : sets.at[j + 1]]
                if side[i] == 0:
                    leader, own = a[i], mine.copy()
                elif leader == a[i]:
                    both = len(own) + len(mine)
                    merged = np.concatenate([own, mine])
                    merged.sort(kind="stable")
                    common = int((merged[1:] == merged[:-1]).sum())
                    if PARTS * common >= LEAST * (both - common):
                        out.append((a[i], b[i]))
        if out:
            yield K.record(kind, *[list(c) for c in zip(*out, strict=True)])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are linked, by exact intersection; ``texts`` has (k, text) of each class once."""
    pairs = work.staged(pairs.select("a", "b"), "pairs")
    salts = work.staged(pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts")), "pair-leaders")
    lead = salts.join(texts, F.col("a") == F.col("k")).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"), F.col("a").alias("b"), "text")
    p, s = pairs.alias("p"), salts.alias("s")
    salted = p.join(s, F.col("p.a") == F.col("s.a")).select("p.a", F.pmod(F.xxhash64("p.b"), F.col("s.salts")).cast("int").alias("salt"), F.lit(1).alias("side"), "p.b")
    follow = salted.join(texts, F.col("b") == F.col("k")).select("a", "salt", "side", "b", "text")
    rows = lead.unionByName(follow).repartition("a", "salt").sortWithinPartitions("a", "salt", "side")
    out = work.staged(rows.mapInArrow(_verify, "a long, b long"), "links")
    work.discard(pairs, salts)
    return out


class Bitmaps:
    """Signatures of one width side by side; wider ones are folded."""

    def __init__(self, sigs: list[bytes]):
        self.wide = np.array([len(s) for s in sigs])
        self.sigs = sigs

    def matrix(self, rows: np.ndarray, wide: int) -> np.ndarray:
        out = np.zeros((len(rows), wide // 8), np.uint64)
        for i, r in enumerate(rows):
            bits = np.frombuffer(self.sigs[r], np.uint64)
            while len(bits) * 8 > wide:
                bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
            out[i] = bits
        return out


def survivors(n: np.ndarray, sigs: list[bytes], label: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> np.ndarray:
    """Pairs of rows (one of ``left`` and one of ``right``, or two of ``left``) that sizes and bitmaps cannot rule out."""
    maps, out = Bitmaps(sigs), []
    other = left if right is None else right
    for wide in np.unique(maps.wide):
        for near in (wide, 2 * wide, wide // 2):
            a, b = left[maps.wide[left] == wide], other[maps.wide[other] == near]
            if not len(a) or not len(b) or (right is None and near < wide):
                continue
            fold = min(wide, near)
            x, y = maps.matrix(a, fold), maps.matrix(b, fold)
            bx, by = np.bitwise_count(x).sum(1, dtype=np.int64), np.bitwise_count(y).sum(1, dtype=np.int64)
            step = max(1, (1 << 21) // max(1, len(b) * x.shape[1]))
            for i in range(0, len(a), step):
                c = slice(i, i + step)
                na, nb = n[a[c]][:, None], n[b][None, :]
                ok = (label[a[c]][:, None] != label[b][None, :]) & (PARTS * np.minimum(na, nb) >= LEAST * np.maximum(na, nb))
                if right is None and near == wide:
                    ok &= a[c][:, None] < b[None, :]
                if not ok.any():
                    continue
                both = np.bitwise_count(x[c][:, None, :] & y[None, :, :]).sum(2, dtype=np.int64)
                most = np.minimum(na - (bx[c][:, None] - both), nb - (by[None, :] - both))
                p, q = np.nonzero(ok & (most >= needed(na, nb)))
                out.append(np.stack([a[c][p], b[q], most[p, q]], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def _tiles(cap: int):
    """Rows ordered by (leader, i, j): puts out pairs of different labels that may be linked; most of those that share several leaders once."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    met: set[tuple[int, int]] = set()

    def one(rows: list[tuple]):
        k, n, label, part, sig, i_, j_ = zip(*rows, strict=True)
        i, j = i_[0], j_[0]
        k, n, label, part = np.array(k), np.array(n, np.int64), np.array(label), np.array(part)
        if (label == label[0]).all():
            return None
        found = survivors(n, list(sig), label, np.flatnonzero(part == i), None if i == j else np.flatnonzero(part == j))
        if cap and len(found):  # the likeliest few for each two labels
            two = np.sort(label[found[:, :2]], 1)
            order = np.lexsort((found[:, 1], found[:, 0], -found[:, 2], two[:, 1], two[:, 0]))
            found, two = found[order], two[order]
            new = np.ones(len(found), bool)
            new[1:] = (two[1:] != two[:-1]).any(1)
            start = np.maximum.accumulate(np.where(new, np.arange(len(found)), 0))
            found = found[np.arange(len(found)) - start < cap]
        ends = np.sort(k[found[:, :2]], 1)
        new = [pair for pair in map(tuple, ends.tolist()) if pair not in met]
        if len(met) + len(new) > REMEMBERED:
            met.clear()
        met.update(new[:REMEMBERED])
        return K.record(kind, *[list(c) for c in zip(*new, strict=True)]) if new else None

    def run(batches):
        key, rows = None, []
        for batch in batches:
            for leader, i, j, *rest in zip(*[K.ids_of(batch, c).to_pylist() for c in ("leader", "i", "j", "k", "n", "label", "part", "sig")], strict=True):
                if (leader, i, j) != key:
                    if len(rows) > 1 and (got := one(rows)) is not None:
                        yield got
                    key, rows = (leader, i, j), []
                rows.append((*rest, i, j))
        if len(rows) > 1 and (got := one(rows)) is not None:
            yield got

    return run


def residue(members: DataFrame, labels: DataFrame, sigs: DataFrame, cap: int) -> DataFrame:
    """Candidate pairs of classes that share a bucket but not yet a component.

    Buckets with one leader are taken together: their members meet once, however many shingles they share.
    """
    m = members.groupBy("leader", "k").agg(F.min("n").alias("n"))
    m = m.join(labels, F.col("k") == F.col("node"), "left").select("leader", "k", "n", F.coalesce("label", "k").alias("label"))
    m = work.staged(m, "tile-members")
    mixed = m.groupBy("leader").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).filter("lo < hi")
    mixed = work.staged(mixed.select("leader", F.ceil(F.col("size") / TILE).cast("int").alias("parts")), "tile-families")
    x, y = m.alias("x"), mixed.alias("y")
    part = F.pmod(F.xxhash64("x.k", F.lit(3)), F.col("y.parts")).cast("int").alias("part")
    rows = x.join(y, F.col("x.leader") == F.col("y.leader")).select("x.leader", "x.k", "x.n", "x.label", "y.parts", part)
    rows = rows.join(sigs.withColumnRenamed("k", "sig_k"), F.col("k") == F.col("sig_k")).drop("sig_k")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).select("leader", "i", "j", "k", "n", "label", "part", "sig")
    dealt = rows.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")
    out = work.staged(dealt.mapInArrow(_tiles(cap), "a long, b long").distinct(), "tile-pairs")
    work.discard(m, mixed)
    return out


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n, k) of every row of ``docs`` (k null for an empty set), and (node, label) of every class with a link."""
    spark = docs.sparkSession
    work.short_batches(spark, 2048)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    seen = work.staged(docs.mapInArrow(_survey, SEEN), "shingle-survey")
    often = seen.filter("token is not null").groupBy("token").agg(F.sum("often").alias("often")).filter(F.col("often") >= OFTEN).orderBy(F.desc("often"), "token").limit(FREQUENT).toPandas()  # FREQUENT rows at most
    order = spark.sparkContext.broadcast(Order(often["token"].to_numpy(np.int64).view(np.uint64), often["often"].to_numpy(np.int64)))  # a few megabytes at most
    rows = seen.filter("token is null").select("doc_id", "mark", "n", "k")
    sigs = work.staged(seen.filter("sig is not null").groupBy("k").agg(F.min("sig").alias("sig")), "shingle-signatures")
    tokens = docs.mapInArrow(_prefix_rows(order), "token long, k long, n int")
    tokens = tokens.repartition("token").sortWithinPartitions("token", "k")
    members = work.staged(tokens.mapInArrow(_shared_buckets, MEMBER), "shingle-buckets")
    # The texts of the classes that share a bucket, each once.
    wanted = members.select("k").distinct()
    owner = rows.filter("k is not null").groupBy("k").agg(F.min("doc_id").alias("doc_id"))
    wanted = work.staged(wanted.join(owner, "k"), "shingle-wanted")
    texts = docs.join(wanted.withColumnRenamed("doc_id", "wanted_id"), F.col("doc_id").eqNullSafe(F.col("wanted_id"))).select("k", "text")
    texts = work.staged(texts.mapInArrow(_own_texts, "k long, text string"), "shingle-texts")
    best = members.filter("k <> leader").groupBy("k", "leader").agg(F.count("*").alias("n")).groupBy("k").agg(F.max_by("leader", F.struct("n", "leader")).alias("a"))
    links = verified(best.select("a", F.col("k").alias("b")), texts)
    labels = graph.components(links)
    for cap in (FIRST_PAIRS, 0):
        pairs = residue(members, labels, sigs, cap)
        if pairs.isEmpty():  # no two components share a bucket and could be linked
            break
        found = verified(pairs, texts)
        if not found.isEmpty():
            links = work.staged(links.unionByName(found), "links")
            labels = graph.components(links)
        work.discard(pairs, found)
    work.discard(members, sigs, texts, wanted)
    return rows, labels


def _own_texts(batches):
    """Of texts fetched by doc_id, those whose set is the wanted one, each class once a task."""
    met: set[int] = set()
    kind = pa.schema([("k", pa.int64()), ("text", pa.string())])
    for batch in batches:
        k, text = K.ids_of(batch, "k"), K.ids_of(batch, "text")
        data, offsets = K.text_of(batch, "text")
        keep = []
        for lo, _, block, at in K.blocks(data, offsets):
            for j, key in enumerate(Sets(block, at).keys()):
                if k[lo + j].as_py() == key and key not in met:
                    met.add(key)
                    keep.append(lo + j)
        if keep:
            here = pa.array(keep, pa.int64())
            yield K.record(kind, k.take(here), text.take(here))


def components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; ``class_id`` names texts with equal sets, ``group_id`` linked classes, ``mark`` the text."""
    rows, labels = classes(docs)
    per_class = rows.filter("k is not null").groupBy("k").agg(F.min("doc_id").alias("least"))
    named = per_class.join(labels, F.col("k") == F.col("node"), "left").select("k", "least", F.coalesce("label", "k").alias("label"))
    named = work.staged(named, "class-labels")
    groups = work.staged(named.groupBy("label").agg(F.min("least").alias("component_id")), "component-names")
    c, g = named.alias("c"), groups.alias("g")
    final = work.staged(c.join(g, F.col("c.label") == F.col("g.label")).select("c.k", "c.label", "g.component_id"), "class-components")
    r, f = rows.alias("r"), final.alias("f")
    joined = r.join(f, F.col("r.k") == F.col("f.k"), "left")
    return joined.select("r.doc_id", F.col("r.n").cast("long").alias("n_shingles"), F.when(F.col("r.k").isNull(), F.col("r.doc_id")).otherwise(F.col("f.component_id")).alias("component_id"), F.col("r.k").alias("class_id"), F.col("f.label").alias("group_id"), "r.mark")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest (doc_id, hash of the text); rows with empty sets all stay."""
    found = work.staged(components(docs).select("doc_id", "mark", "group_id"), "near-groups")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "mark")
    chosen = found.filter("group_id is not null").groupBy("group_id").agg(F.min(place).alias("c")).select("c.doc_id", "c.mark", F.lit(True).alias("linked"))
    alone = found.filter("group_id is null").select("doc_id", "mark", F.lit(False).alias("linked")).distinct()
    keep = work.staged(chosen.unionByName(alone), "near-kept")
    work.discard(found)
    d, k = docs.withColumn("__mark", F.xxhash64("text")).alias("d"), keep.alias("k")
    met = d.join(k, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.__mark") == F.col("k.mark")))
    # Rows that repeat doc_id and text: one of them, unless their set is empty.
    copy = F.when(F.col("k.linked"), F.lit(0)).otherwise(F.monotonically_increasing_id())
    met = met.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col("d.__mark").alias("__mark"), copy.alias("__copy"))
    return met.dropDuplicates(["doc_id", "__mark", "__copy"]).drop("__mark", "__copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = work.columns(work.table(spark, sf_dir, "documents"), doc_id="long", text="string")
    return components(docs).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
with recursive l as materialized (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as materialized (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as g from l),
e as materialized (select doc_id, len(g) as n, unnest(g) as g from s),
links as materialized (select a.doc_id as a, b.doc_id as b from e a join e b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(a, b) as (select doc_id, doc_id from s union select r.a, l.b from reach r join links l on r.b = l.a)
select s.doc_id, cast(len(any_value(s.g)) as bigint) as n_shingles, min(r.b) as component_id from s join reach r on s.doc_id = r.a group by s.doc_id
"""

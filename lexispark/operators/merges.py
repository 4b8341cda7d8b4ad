"""Byte-pair merges learned where the words are: the tasks of one barrier stage hold the distinct words together.

Each task keeps its share of the words as arrays of symbol numbers, and the exact counts of those pairs that
fall to it by hash.  A round takes all merges that are certain from the present counts, in their order; every
task applies them to its own words and sends the changed counts to the tasks that keep them.  No word visits
the driver, none is left out, and a task holds a share of the words and of the pairs that shrinks with more tasks.
Tasks speak to each other by sockets, whose ports they tell through the barrier; a lost task repeats the stage.

A merge (a, b) changes no counts but those of pairs (x, a) and (b, y), which only fall, and makes pairs that are
at most as frequent as the (x, a) or (b, y) they come from.  So further pairs are certain as long as they are
neither, and come before all of these.  A pair of equal symbols, and a merge that spells a symbol that is known
already, end a round.
"""

from __future__ import annotations

import heapq
import secrets
from multiprocessing.connection import Client, Listener

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .. import staging

#: Words for which a further task is worth the messages.
WORDS = 50_000
#: Pairs that each task puts forward in a round.
FORWARD = 48
#: Positions counted at once at the start.
CHUNK = 1_000_000


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their weights, zeros left out.  Sums below 2^53 are exact."""
    places, distinct = pd.factorize(keys)
    total = np.rint(np.bincount(places, weights, len(distinct))).astype(np.int64)
    return distinct[total != 0], total[total != 0]


class Words:
    """Words as linked symbols: ``sym`` (0 where a merge left a hole), the places before and behind, and each word's frequency."""

    def __init__(self, sym: np.ndarray, sizes: np.ndarray, freq: np.ndarray):
        n = len(sym)
        self.sym, self.freq = sym, freq
        self.word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.next, self.prev = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(sizes)
        self.next[ends - 1], self.prev[ends - sizes] = -1, -1
        self.holes, self.marked = 0, np.zeros(n, bool)

    def _with(self, at: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """The places ``at`` and those of ``behind`` that are none of them."""
        behind = behind[behind >= 0]
        self.marked[at] = True
        out = np.concatenate([at, behind[~self.marked[behind]]])
        self.marked[at] = False
        return out

    def counts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that start at these places, as numbers, with the frequencies of their words."""
        at = at[self.next[at] >= 0]
        return (self.sym[at].astype(np.int64) << 32) | self.sym[self.next[at]], self.freq[self.word[at]]

    def all_counts(self) -> tuple[np.ndarray, np.ndarray]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i in range(0, len(self.sym), CHUNK):
            more = summed(*self.counts(np.arange(i, min(i + CHUNK, len(self.sym)))))
            keys, sums = summed(np.concatenate([keys, more[0]]), np.concatenate([sums, more[1]]))
        return keys, sums

    def merge(self, pairs: list[tuple[int, int, int]], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Replace independent pairs (left, right, new), of ``size`` symbols so far; how pair counts change."""
        left, right = np.zeros(size, bool), np.zeros(size, bool)
        left[[p[0] for p in pairs]], right[[p[1] for p in pairs]] = True, True
        known = np.array(sorted((a << 32 | b, new) for a, b, new in pairs), np.int64)
        at = np.flatnonzero(left[self.sym])
        at = at[self.next[at] >= 0]
        at = at[right[self.sym[self.next[at]]]]
        keys = (self.sym[at].astype(np.int64) << 32) | self.sym[self.next[at]]
        which = np.minimum(np.searchsorted(known[:, 0], keys), len(known) - 1)
        hit = known[which, 0] == keys
        at, which = at[hit], which[hit]
        if pairs[0][0] == pairs[0][1] and len(at):  # from the left and without overlap
            runs = np.concatenate([[True], self.next[at[:-1]] != at[1:]])
            place = np.arange(len(at))
            even = (place - np.maximum.accumulate(np.where(runs, place, 0))) % 2 == 0
            at, which = at[even], which[even]
        second = self.next[at]
        old = [self.counts(at), self.counts(self._with(second, self.prev[at]))]
        third = self.next[second]
        self.sym[at], self.sym[second] = known[which, 1], 0
        self.next[at], self.next[second] = third, -1
        self.prev[third[third >= 0]] = at[third >= 0]
        new = self.counts(self._with(at, self.prev[at]))
        self.holes += len(at)
        if self.holes > len(self.sym) // 4:
            self._close()
        return summed(np.concatenate([*(x[0] for x in old), new[0]]), np.concatenate([*(-x[1] for x in old), new[1]]))

    def _close(self) -> None:
        """Without the holes, and without words that have no pair left."""
        kept = (self.sym != 0) & ((self.next >= 0) | (self.prev >= 0))
        place = np.cumsum(kept, dtype=np.int32) - 1
        self.sym, self.word = self.sym[kept], self.word[kept]
        self.next, self.prev = (np.where(x[kept] >= 0, place[x[kept]], np.int32(-1)) for x in (self.next, self.prev))
        self.holes, self.marked = 0, np.zeros(len(self.sym), bool)


class Tally:
    """The counts of some pairs, and the first of them in the order of merging: most frequent, left, right."""

    def __init__(self, names: list[str]):
        self.names = names
        self.n: dict[int, int] = {}
        self.heap: list[tuple[int, str, str, int]] = []

    def _entry(self, key: int, n: int) -> tuple[int, str, str, int]:
        return -n, self.names[key >> 32], self.names[key & 0xFFFFFFFF], key

    def add(self, keys: np.ndarray, deltas: np.ndarray) -> None:
        for key, delta in zip(keys.tolist(), deltas.tolist(), strict=True):
            now = self.n.get(key, 0) + delta
            if now > 0:
                self.n[key] = now
                heapq.heappush(self.heap, self._entry(key, now))
            else:
                self.n.pop(key, None)
        if len(self.heap) > 2 * len(self.n) + 10_000:  # most are older counts
            self.heap = [self._entry(key, n) for key, n in self.n.items()]
            heapq.heapify(self.heap)

    def top(self, many: int) -> np.ndarray:
        """Rows of pair and count, in order; the last is the first of the others, or has no pair if there are none."""
        found: list[tuple[int, str, str, int]] = []
        while self.heap and len(found) <= many:
            entry = heapq.heappop(self.heap)
            if self.n.get(entry[3]) == -entry[0] and (not found or found[-1] != entry):
                found.append(entry)
        for entry in found:
            heapq.heappush(self.heap, entry)
        rows = [(e[3], -e[0]) for e in found]
        return np.array(rows + [(-1, 0)] * (len(rows) <= many), np.int64)


def choose(tops: list[np.ndarray], names: list[str], known: dict[str, int], most: int, min_freq: int) -> list[tuple[int, int]]:
    """The next merges, in order, as far as they are certain."""
    entry = lambda key, n: (-n, names[key >> 32], names[key & 0xFFFFFFFF], key)
    found = sorted(entry(key, n) for t in tops for key, n in t[:-1].tolist())
    hidden = min((entry(key, n) for t in tops for key, n in t[-1:].tolist() if key >= 0), default=None)
    level: dict[int, set[int]] = {}  # the left symbols of the pairs of each count
    for n, _, _, key in found:
        level.setdefault(n, set()).add(key >> 32)
    out: list[tuple[int, int]] = []
    firsts, seconds, made = set(), set(), set()
    least = None  # the first, in order, of the symbols made
    for n, left, right, key in found:
        a, b = key >> 32, key & 0xFFFFFFFF
        if len(out) == most or -n < min_freq or hidden is not None and (n, left, right, key) > hidden:
            break
        if out:
            tied = not level[n].isdisjoint(seconds) or hidden is not None and hidden[0] == n
            if a == b or b in firsts or a in seconds or tied and least <= left:
                break  # its count may have fallen, or a new pair of the same count may come before it
        out.append((a, b))
        whole = left + right
        if a == b or whole in known or whole in made:
            break
        firsts.add(a)
        seconds.add(b)
        made.add(whole)
        least = whole if least is None else min(least, whole)
    return out


class Ring:
    """Messages between the tasks of a barrier stage, each with each; a lost task ends them all."""

    def __init__(self, context, key: bytes):
        self.rank, infos = context.partitionId(), context.getTaskInfos()
        self.size = len(infos)
        self.peers: dict[int, object] = {}
        if self.size == 1:
            return
        with Listener(("", 0), backlog=self.size, authkey=key) as door:
            ports = context.allGather(str(door.address[1]))
            for i in range(self.rank):  # each calls those before it
                self.peers[i] = Client((infos[i].address.rpartition(":")[0].strip("[]"), int(ports[i])), authkey=key)
                self.peers[i].send(self.rank)
            for _ in range(self.rank + 1, self.size):
                peer = door.accept()
                self.peers[peer.recv()] = peer

    def exchange(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """Send ``parts[i]`` (two columns of whole numbers) to task i; what each has sent here, by task."""
        got = list(parts)
        for turn in range(self.size):  # in each turn two and two meet
            other = (turn - self.rank) % self.size
            if other == self.rank:
                continue
            if self.rank < other:
                self.peers[other].send_bytes(np.ascontiguousarray(parts[other]).tobytes())
            data = self.peers[other].recv_bytes()
            if self.rank > other:
                self.peers[other].send_bytes(np.ascontiguousarray(parts[other]).tobytes())
            got[other] = np.frombuffer(data, np.int64).reshape(-1, 2)
        return got

    def all(self, part: np.ndarray) -> list[np.ndarray]:
        return self.exchange([part] * self.size)

    def sums(self, keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sums, over all tasks, of the keys that fall to this one."""
        owner = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(self.size)
        both = np.stack([keys, weights], 1)
        got = np.concatenate(self.exchange([both[owner == i] for i in range(self.size)]))
        return summed(got[:, 0], got[:, 1])

    def close(self) -> None:
        for peer in self.peers.values():
            peer.close()


def read(batches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words, -1 after each for the end mark; the sizes with it; the frequencies."""
    codes, sizes, freq = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        words = batch.column(0)
        n = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.int32)
        codes.append(np.insert(flat, np.cumsum(n), -1))
        sizes.append(n + 1)
        freq.append(batch.column(1).to_numpy(zero_copy_only=False))
    return np.concatenate(codes), np.concatenate(sizes), np.concatenate(freq)


def learned(batches, ring: Ring, end: str, wanted: int | None, vocab_size: int, min_freq: int):
    """(symbols at the start, merges) of all words together; every task finds the same."""
    codes, sizes, freq = read(batches)
    own = np.unique(codes[codes >= 0]).astype(np.int64)
    chars = np.unique(np.concatenate([x[:, 0] for x in ring.all(np.stack([own, own], 1))]))
    names = ["", *map(chr, chars.tolist()), end]
    sym = np.where(codes < 0, len(names) - 1, np.searchsorted(chars, codes) + 1).astype(np.int32)
    del codes
    known = {name: i for i, name in enumerate(names)}
    base = names[1:] if sum(len(x) for x in ring.all(np.stack([sizes, sizes], 1)[:1])) else []
    words, tally = Words(sym, sizes, freq), Tally(names)
    del sym
    tally.add(*ring.sums(*words.all_counts()))
    wanted = max(0, vocab_size - len(base)) if wanted is None else wanted
    merges: list[tuple[str, str]] = []
    while len(merges) < wanted:
        batch = choose(ring.all(tally.top(FORWARD)), names, known, wanted - len(merges), min_freq)
        if not batch:
            break
        pairs = []
        for a, b in batch:
            merges.append((names[a], names[b]))
            whole = names[a] + names[b]
            if whole not in known:
                known[whole] = len(names)
                names.append(whole)
            pairs.append((a, b, known[whole]))
        tally.add(*ring.sums(*words.merge(pairs, len(names))))
    return base, merges


def slots(spark) -> int:
    """Tasks that can run at the same time; a barrier stage of more would never start."""
    context = spark.sparkContext._jsc.sc()
    return max(1, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


def learn(counts: DataFrame, end: str, n_merges: int | None, vocab_size: int, min_freq: int) -> tuple[list[str], list[tuple[str, str]]]:
    """The symbols that words (word, freq) start from, and ``n_merges`` merges, or as many as fill ``vocab_size`` with them."""
    spark = counts.sparkSession
    table = staging.staged(counts.select("word", "freq"), "bpe-words")
    tasks = max(1, min(slots(spark), -(-table.count() // WORDS)))
    key = secrets.token_bytes(32)

    def run(batches):
        from pyspark import BarrierTaskContext

        ring = Ring(BarrierTaskContext.get(), key)
        base, merges = learned(batches, ring, end, n_merges, vocab_size, min_freq)
        ring.close()
        if ring.rank == 0:
            left, right = [*base, *(a for a, _ in merges)], [*[None] * len(base), *(b for _, b in merges)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(left)), pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string())], ["i", "left", "right"])

    found = sorted(tuple(r) for r in table.repartition(tasks).mapInArrow(run, "i long, left string, right string", barrier=True).collect())
    return [a for _, a, b in found if b is None], [(a, b) for _, a, b in found if b is not None]

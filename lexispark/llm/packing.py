"""Lexical retrieval packing.

Documents are dealt to shards of bounded size by their own words, so that neighbours meet at any size
of the corpus: each word draws a lot (a hash, the same in every document) over its BM25 weight, and the
words with the least and second least draw name the shard, so two documents share a name as often as
they share weight.  Only where more text has one name than a shard takes, copies say, a hash of the row
decides.  Each shard tokenizes its texts, builds an inverted index over all their words with BM25
weights (document frequencies are counted over the whole corpus, in a hashed table of fixed size), and
fills windows.  A seed asks the index of its own shard, no other: a
neighbour that shares little weight with it may lie elsewhere (figures in README).  A seed document is followed by its best
unused neighbours until the window is full.  The last one is cut, and what is left of it seeds the
next window.  What remains at the end of a shard is laid out in sequences whose lengths are powers
of two, so nothing needs padding.

A word's ids do not depend on its neighbours: the pre-tokenizer of the tokenizer never joins text
across white space.  Ids are therefore looked up by word, and only new words are tokenized.

Edge cases: a null or empty text is the end id alone.  Rows that repeat a doc_id are packed as rows
of their own.  A null doc_id stays null.  An empty table gives no pieces.  Extra columns are left out,
whatever their names.  Equal scores go to the smaller doc_id.  A text longer than a shard is cut into
windows whole, by the one task that holds its shard.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import tallies, work

WINDOW = 2048
END_ID = 1
#: Text bytes of one shard.
SHARD_BYTES = 4_000_000
#: Buckets of the table of document frequencies.
BUCKETS = 1 << 18
K1, B = 1.2, 0.75
#: Words kept in a worker's table of ids, at about a hundred bytes each.
KNOWN_WORDS = 800_000
#: Bytes from which a piece is left to the tokenizer's own model.
LONG_PIECE = 64
#: A word in one of so many texts of a shard has its weights as a whole row.
DENSE = 8

ROW = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: See ``_odd_bytes``.  Python takes the separators 1C to 1F for white space, the tokenizer does not.
_ODD = np.isin(np.arange(256), [*range(0x1C, 0x20), *range(0xC9, 0x100)])


def tokenizer_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _byte_alphabet() -> list[str]:
    """The printable name of each byte in byte-level BPE: itself if it prints, else the next free code point from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


def _piece_pattern(spec: dict):
    """The pre-tokenizer's pattern, or a line feed between words, as a function, where the file has the kind of steps that ``WordIds`` can follow; else None."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers") or []]
    if [x["type"] for x in steps] != ["Split", "ByteLevel"] or normal != ["NFC", "Replace", "Lowercase"] or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
        return None
    if not steps[0]["invert"] or steps[0]["behavior"] != "Removed":
        return None
    return regex.compile("\n|" + steps[0]["pattern"]["Regex"]).findall


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return K.Spans(K.LOWER[data]).hash(starts, ends)


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(46)).astype(np.int64)


def row_terms(block: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of the words of each row, how often each comes, where each row's begin, and the words of each row."""
    starts, ends, first = K.words(block, at)
    code = np.sort(K.row_index(first) * BUCKETS + bucket_of(word_hashes(block, starts, ends)))
    fresh = np.flatnonzero(np.diff(code, prepend=-1))
    tf, code = np.diff(fresh, append=len(code)).astype(np.int32), code[fresh]
    return (code % BUCKETS).astype(np.int32), tf, np.searchsorted(code, np.arange(len(at)) * BUCKETS), np.diff(first)


def listed(docs: DataFrame) -> DataFrame:
    """(size, n_words, terms, tf) of every row of ``docs``, staged: bytes, words, distinct buckets, how often each comes."""

    def count(batches):
        kind = pa.schema([("size", pa.int64()), ("n_words", pa.int64()), ("terms", pa.binary()), ("tf", pa.binary())])
        for batch in batches:
            for _, _, block, at in K.blocks(*K.text_of(batch, "text")):
                terms, tf, cut, n_words = row_terms(block, at)
                yield K.record(kind, np.diff(at) + 8, n_words, _binary(terms, 4 * cut), _binary(tf, 4 * cut))

    return work.staged(docs.select("text").mapInArrow(count, "size long, n_words long, terms binary, tf binary"), "packing-words")


def _binary(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(values)])


def frequencies(rows: DataFrame) -> tuple[np.ndarray, int, int]:
    """Of the staged rows: documents with a word of each bucket; documents and words in all."""

    def count(batches):
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            data, _ = K.text_of(batch, "terms")
            sums[0] += np.bincount(data.view(np.int32), minlength=BUCKETS)
            sums[1, :2] += (batch.num_rows, K.ids_of(batch, "n_words").to_numpy().sum())
        yield from tallies.chunks(sums)

    df, totals = tallies.total(rows.select("terms", "n_words").mapInArrow(count, tallies.ROW), 2, BUCKETS)
    return df, *(int(x) for x in totals[:2])


def names(terms: np.ndarray, tf: np.ndarray, at: np.ndarray, n_words: np.ndarray, df: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    """The two words (buckets) that name each row, by least draw over weight; BUCKETS where no other document has a word of it.

    Row i has the buckets ``terms[at[i]:at[i + 1]]``.
    """
    out = np.full((len(at) - 1, 2), BUCKETS, np.int64)
    shared = df[terms] > 1
    row, term, tf = K.row_index(at)[shared], terms[shared].astype(np.int64), tf[shared]
    if not len(row):
        return out
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_words[row] / max(mean, 1.0)))
    lot = -np.log(((K.mix(term.astype(np.uint64) + np.uint64(77)) >> np.uint64(11)).astype(float) + 0.5) / 2**53)
    draw, fresh = lot / weight, np.flatnonzero(np.diff(row, prepend=-1))
    here, counts = row[fresh], np.diff(fresh, append=len(row))
    for i in range(2):  # the least of each row, then the next; the lower bucket of a tie
        least = np.minimum.reduceat(draw, fresh)
        hits = np.flatnonzero(draw == np.repeat(least, counts))
        hits = hits[np.diff(row[hits], prepend=-1) > 0]
        out[here[least < np.inf], i] = term[hits[least < np.inf]]
        draw[hits] = np.inf
    return out


class Dealer:
    """Shards by name: light names share one, a heavy name has several by second name, and what is still too heavy goes by a hash of the row."""

    def __init__(self, first: dict[int, int], limit: int):
        sizes = np.zeros(BUCKETS + 1, np.int64)
        sizes[list(first)] = list(first.values())
        heavy = sizes > limit
        self.parts = np.where(heavy, -(-2 * sizes // limit), 1)
        light = np.cumsum(np.where(heavy, 0, sizes)) // limit
        self.base = np.where(heavy, light[-1] + 1 + np.cumsum(np.where(heavy, self.parts, 0)) - self.parts, light)
        self.count = int(light[-1] + 1 + self.parts[heavy].sum())
        self.limit = limit
        self.spread = np.ones(self.count, np.int64)

    def cells(self, names_: np.ndarray) -> np.ndarray:
        one, two = names_[:, 0], names_[:, 1]
        return self.base[one] + (K.mix(two.astype(np.uint64)) % self.parts[one].astype(np.uint64)).astype(np.int64)

    def even(self, cells: dict[int, int]) -> None:
        """Take in the sizes of the cells: one over half again the limit is spread over several shards."""
        for cell, size in cells.items():
            if 2 * size > 3 * self.limit:
                self.spread[cell] = -(-size // self.limit)
        self.extra = np.concatenate([[0], np.cumsum(self.spread - 1)]) + self.count

    def shards(self, names_: np.ndarray, dice: np.ndarray) -> np.ndarray:
        cell = self.cells(names_)
        part = (K.mix(dice.astype(np.uint64)) % self.spread[cell].astype(np.uint64)).astype(np.int64)
        return np.where(part == 0, cell, self.extra[cell] + part - 1)


def deal(docs: DataFrame, rows: DataFrame, df: np.ndarray, idf: np.ndarray, mean: float) -> DataFrame:
    """``docs`` (doc_id, text) with a ``mark`` of the text and the ``shard`` of each row; ``rows`` is what ``listed`` gives."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((df, idf))  # BUCKETS numbers each

    def name(batches):
        kind = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("size", pa.int64())])
        for batch in batches:
            terms, at = K.text_of(batch, "terms")
            tf, _ = K.text_of(batch, "tf")
            found = names(terms.view(np.int32), tf.view(np.int32), at // 4, K.ids_of(batch, "n_words").to_numpy(), *shared.value, mean)
            yield K.record(kind, found[:, 0], found[:, 1], K.ids_of(batch, "size"))

    named = work.staged(rows.mapInArrow(name, "one long, two long, size long"), "packing-names")
    work.discard(rows)
    dealer = Dealer({r["one"]: r["size"] for r in named.groupBy("one").agg(F.sum("size").alias("size")).collect()}, SHARD_BYTES)  # BUCKETS + 1 rows at most

    def place(batches):
        kind = pa.schema([("cell", pa.int64()), ("size", pa.int64())])
        for batch in batches:
            yield K.record(kind, dealer.cells(np.stack([batch.column(i).to_numpy() for i in (0, 1)], 1)), batch.column(2))

    sizes = named.mapInArrow(place, "cell long, size long").groupBy("cell").agg(F.sum("size").alias("size")).filter(F.col("size") * 2 > 3 * dealer.limit)
    dealer.even({r["cell"]: r["size"] for r in sizes.collect()})  # one row for each shard and a half of text at most
    work.discard(named)
    told = spark.sparkContext.broadcast(dealer)

    def give(batches):
        kind = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("mark", pa.int64()), ("shard", pa.int64())])
        met: Counter[int] = Counter()  # of the rows of one task
        for batch in batches:
            dice = K.ids_of(batch, "dice").to_numpy()
            again = np.zeros(len(dice), np.uint64)  # rows that repeat doc_id and text throw dice of their own
            for i, key in enumerate(dice.tolist()):
                again[i] = met[key]
                met[key] += 1
            dice = K.mix(dice.view(np.uint64) + again * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            for a, b, block, at in K.blocks(*K.text_of(batch, "text")):
                shard = told.value.shards(names(*row_terms(block, at), *shared.value, mean), dice[a:b])
                yield K.record(kind, *[K.ids_of(batch, c).slice(a, b - a) for c in ("doc_id", "text", "mark")], shard)

    # Texts are read again instead of staged: that would take the size of the input on disk.
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"), F.xxhash64("doc_id", "text", F.lit(7)).alias("dice"))
    return marked.mapInArrow(give, "doc_id long, text string, mark long, shard long")


class Merges:
    """The tokenizer's byte-pair merges over many pieces at once: each round joins the leftmost pair of least rank of every piece.

    ``of`` gives None for a model that does anything but that.
    """

    @classmethod
    def of(cls, model: dict):
        odd = [model.get(c) for c in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")]
        end = model.get("end_of_word_suffix") or ""
        vocab, names_ = model.get("vocab"), _byte_alphabet()
        if model.get("type") != "BPE" or any(odd) or any(n + e not in vocab for n in names_ for e in {"", end}):
            return None
        return cls(model, end, names_)

    def __init__(self, model: dict, end: str, names_: list[str]):
        vocab = model["vocab"]
        self.inner, self.last = (np.array([vocab[n + e] for n in names_], np.int64) for e in ("", end))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs] or [0], np.int64)
        # An open-addressed table of pairs; NONE is both an empty slot and the rank of no pair.
        self.none = len(pairs)
        self.shift = np.uint64(64 - max(4, (4 * len(pairs)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.key, self.rank = np.full(size + 64, -1, np.int64), np.full(size + 64, self.none, np.int64)
        codes = (left << 32) | right
        slots = self._slots(codes)
        for rank, (code, slot) in enumerate(zip(codes.tolist(), slots.tolist(), strict=True)):
            while self.key[slot] not in (-1, code):
                slot += 1
            self.key[slot], self.rank[slot] = code, rank

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        codes = (left << 32) | right
        slots = self._slots(codes)
        found = self.key[slots]
        out = np.where(found == codes, self.rank[slots], self.none)
        open_ = np.flatnonzero((found != codes) & (found != -1))
        while len(open_):
            slots[open_] += 1
            found = self.key[slots[open_]]
            hit = found == codes[open_]
            out[open_[hit]] = self.rank[slots[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def ids(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that lie one after another in ``data``, none of them empty, and how many each piece has."""
        n = len(sizes)
        ends = np.cumsum(sizes)
        token = self.inner[data]
        token[ends - 1] = self.last[data[ends - 1]]
        count = sizes.copy()
        done_at, done = [], []
        piece, first = np.arange(n), ends - sizes  # of the pieces still at work
        rank = np.full(len(token), self.none, np.int64)  # of each token with the next one of its piece
        rank[:-1] = self.ranks(token[:-1], token[1:])
        rank[ends - 1] = self.none
        while len(piece):
            least = np.minimum.reduceat(rank, first)
            over = least == self.none
            if over.any():
                out = np.repeat(over, count[piece])
                done_at.append(np.repeat(piece[over], count[piece[over]]))
                done.append(token[out])
                token, rank, piece, least = token[~out], rank[~out], piece[~over], least[~over]
                if not len(piece):
                    break
                first = np.cumsum(count[piece]) - count[piece]
            hits = np.flatnonzero(rank == np.repeat(least, count[piece]))
            owner = np.searchsorted(first, hits, "right") - 1
            at = hits[np.diff(owner, prepend=-1) > 0]  # the leftmost of each piece
            token[at] = self.made[least]
            stays = np.ones(len(token), bool)
            stays[at + 1] = False
            rank[at] = rank[at + 1]
            token, rank = token[stays], rank[stays]
            at -= np.arange(len(at))  # one token is gone from each piece before
            count[piece] -= 1
            first = np.cumsum(count[piece]) - count[piece]
            inside = at > first
            rank[at[inside] - 1] = self.ranks(token[at[inside] - 1], token[at[inside]])
            inside = at < first + count[piece] - 1
            rank[at[inside]] = self.ranks(token[at[inside]], token[at[inside] + 1])
            rank[at[~inside]] = self.none
        if not done:
            return np.zeros(0, np.uint32), count
        order = np.argsort(np.concatenate(done_at), kind="stable")
        return np.concatenate(done)[order].astype(np.uint32), count


class WordIds:
    """Token ids of words, kept by a worker from shard to shard.

    Words are found by a 64-bit hash and then compared byte by byte with the table.  A word of plain
    Latin text is lower-cased (the tokenizer would do so), cut by the tokenizer's own pre-tokenizer
    pattern, and its pieces merged as the tokenizer's model would; any other word is encoded as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.cut, self.merges = _piece_pattern(spec), Merges.of(spec["model"])
        self.byte_names = str.maketrans(dict(enumerate(_byte_alphabet())))
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.hash, self.place = np.zeros(0, np.uint64), none
        self.bytes, self.byte_at, self.byte_len = np.zeros(0, np.uint8), none, none
        self.flat, self.starts, self.sizes, self.buckets = np.zeros(0, np.uint32), none, none, none

    def places(self, block: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of each row of a block as places in the table, and where each row's words begin."""
        if len(self.sizes) > KNOWN_WORDS:
            self.clear()
        starts, ends, first = K.words(block, at)
        hashes = word_hashes(block, starts, ends)
        buckets = bucket_of(hashes)
        key, odd = K.LOWER[block], _odd_bytes(block)
        if odd is not None:  # words that only the tokenizer itself judges rightly keep their case
            sums = np.concatenate([[0], np.cumsum(odd)])
            own = np.flatnonzero(sums[ends] > sums[starts])
            hashes[own] = K.mix(K.Spans(block).hash(starts[own], ends[own]) ^ np.uint64(0x5851F42D4C957F2D))
            whole = np.zeros(len(block) + 1, np.int64)
            whole[starts[own]] += 1
            whole[ends[own]] -= 1
            key = np.where(np.cumsum(whole)[:-1] > 0, block, key)
        order = np.argsort(hashes)
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.diff(hashes[order]) != 0
        example = order[fresh]
        distinct = hashes[example]
        spot = np.searchsorted(self.hash, distinct)
        known = self.hash[np.minimum(spot, len(self.hash) - 1)] == distinct if len(self.hash) else np.zeros(len(distinct), bool)
        found = np.empty(len(distinct), np.int64)
        found[known] = self.place[spot[known]]
        new = example[~known]
        if len(new):
            found[~known] = made = self._learn(key, starts[new], ends[new], buckets[new])
            self.hash, self.place = np.insert(self.hash, spot[~known], distinct[~known]), np.insert(self.place, spot[~known], made)
        out = np.empty(len(order), np.int64)
        out[order] = found[np.cumsum(fresh) - 1]
        wrong = self._unlike(key, starts, ends, out)
        if len(wrong):  # two words of one hash: these have places of their own, which nothing finds again
            out[wrong] = self._learn(key, starts[wrong], ends[wrong], buckets[wrong])
        return out, first

    def _unlike(self, key: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The words that are not, byte by byte, what the table holds at their places."""
        size = ends - starts
        long = self.byte_len[places] != size
        if long.any():
            return np.flatnonzero(long | np.array([self.bytes[a : a + n].tobytes() != key[s:e].tobytes() for a, n, s, e in zip(self.byte_at[places], self.byte_len[places], starts, ends, strict=True)], bool))
        steps = np.arange(int(size.sum()))
        shift = self.byte_at[places] - (np.cumsum(size) - size)
        own = np.repeat(shift, size) + steps
        differs = self.bytes[own] != key[~K.SPACE[key]]
        return np.unique(np.searchsorted(np.cumsum(size), np.flatnonzero(differs), "right"))

    def _learn(self, key: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        raw = key.tobytes()
        words = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        flat, sizes = self._encoded(words)
        made = len(self.sizes) + np.arange(len(words))
        length = ends - starts
        self.byte_at = np.concatenate([self.byte_at, len(self.bytes) + np.cumsum(length) - length])
        self.byte_len = np.concatenate([self.byte_len, length])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(words), np.uint8)])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat])
        self.buckets = np.concatenate([self.buckets, buckets])
        return made

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has."""
        text = b"\n".join(words).decode()
        if self.cut is None or self.merges is None or _odd_bytes(np.frombuffer(b"\n".join(words), np.uint8)) is not None:
            plain = [self.cut is not None and self.merges is not None and _odd_bytes(np.frombuffer(w, np.uint8)) is None for w in words]
            text = "\n".join(w.decode() for w, p in zip(words, plain, strict=True) if p)
        else:
            plain = [True] * len(words)
        n_plain = sum(plain)
        ids, sizes = np.zeros(0, np.uint32), np.zeros(n_plain, np.int64)
        if n_plain:
            found = self.cut(text.lower())
            breaks = np.fromiter(map("\n".__eq__, found), bool, len(found))
            of = np.cumsum(breaks)[~breaks]
            pieces = [p.encode() for p in found if p != "\n"]
            ids, counts = self._pieces(pieces)
            sizes = np.bincount(of, counts, n_plain).astype(np.int64)
        if n_plain == len(words):
            return ids, sizes
        plain = np.array(plain)
        rest = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w, p in zip(words, plain, strict=True) if not p], add_special_tokens=False)]
        own = np.split(ids, np.cumsum(sizes)[:-1]) if n_plain else []
        both, take = iter(own), iter(rest)
        lists = [np.asarray(next(both) if p else next(take), np.uint32) for p in plain]
        return np.concatenate(lists), np.array([len(x) for x in lists], np.int64)

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        long = np.flatnonzero(sizes > LONG_PIECE)
        if not len(long):
            return self.merges.ids(np.frombuffer(b"".join(pieces), np.uint8), sizes) if len(pieces) else (np.zeros(0, np.uint32), sizes)
        short = np.flatnonzero(sizes <= LONG_PIECE)
        ids, counts = self._pieces([pieces[i] for i in short])
        lists: list[np.ndarray] = [None] * len(pieces)
        for i, own in zip(short, np.split(ids, np.cumsum(counts)[:-1]), strict=False):
            lists[i] = own
        for i in long:
            named = pieces[i].decode("latin-1").translate(self.byte_names)
            lists[i] = np.array([t.id for t in self.tokenizer.model.tokenize(named)], np.uint32)
        return np.concatenate(lists), np.array([len(x) for x in lists], np.int64)

    def ids(self, places: np.ndarray) -> np.ndarray:
        sizes = self.sizes[places]
        base = np.repeat(self.starts[places] - (np.cumsum(sizes) - sizes), sizes)
        return self.flat[base + np.arange(len(base))]

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The words of each row as places, and its ids."""
        words, ids = [], []
        for _, _, block, at in K.blocks(data, offsets):
            places, first = self.places(block, at)
            words += np.split(places, first[1:-1])
            sums = np.concatenate([[0], np.cumsum(self.sizes[places])])
            here = np.split(self.ids(places), sums[first[1:-1]])
            raw = block.tobytes()
            if any(s in raw for s in self.special):  # their strings are tokens wherever they stand
                for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    if any(s in raw[a:b] for s in self.special):
                        here[i] = np.array(self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.uint32)
            ids += here
        return words, ids


def _odd_bytes(block: np.ndarray) -> np.ndarray | None:
    """Bytes that make a word one for the tokenizer itself: separators, U+0130 and the characters from U+0240 on; None if there are none.

    Below these, text is in composed form, and Python lower-cases it as the tokenizer does.
    """
    odd = _ODD[block]
    if len(block) > 1:
        odd[1:] |= (block[:-1] == 0xC4) & (block[1:] == 0xB0)
    return odd if odd.any() else None


class Index:
    """Inverted index of a shard: for each word that two documents share, its distinct texts and BM25 weights.

    Documents of the same words are one entry, so copies make no list longer.  Words of many texts have
    their weights as a whole row, the others as a list; a row or list is never cut.
    """

    def __init__(self, words: list[np.ndarray], idf: np.ndarray, mean: float):
        entries: dict[bytes, int] = {}
        self.of = np.array([entries.setdefault(w.astype(np.int64).tobytes(), len(entries)) for w in words], np.int64)
        texts = [np.frombuffer(w, np.int64) for w in entries]
        self.n = n = len(texts)
        sizes = np.array([len(w) for w in texts], np.int64)
        flat = np.concatenate(texts) if n else np.zeros(0, np.int64)
        wide = int(flat.max(initial=0)) + 1
        code = np.sort(np.repeat(np.arange(n), sizes) * wide + flat)
        fresh = np.flatnonzero(np.diff(code, prepend=-1))
        tf, code = np.diff(fresh, append=len(code)), code[fresh]
        doc, term = code // wide, code % wide
        # A word of one text links nothing but its copies.
        many = np.bincount(term, minlength=wide)
        keep = (many[term] > 1) | (np.bincount(self.of, minlength=n)[doc] > 1)
        doc, term, tf = doc[keep], term[keep], tf[keep]
        value = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / max(mean, 1.0)))
        self.asked, self.asked_at = term, np.searchsorted(doc, np.arange(n + 1))  # all words of each text
        self.row = np.where(DENSE * many >= n, np.cumsum(DENSE * many >= n) - 1, -1)
        whole = self.row[term] >= 0
        self.rows = np.zeros((int(self.row.max(initial=-1)) + 1, n))
        self.rows[self.row[term[whole]], doc[whole]] = value[whole]
        doc, term, value = doc[~whole], term[~whole], value[~whole]
        order = np.argsort(term, kind="stable")
        self.doc, self.value = doc[order], value[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=wide))])

    def scores(self, entry: int) -> np.ndarray:
        """BM25 of every entry for the words of this one."""
        terms = self.asked[self.asked_at[entry] : self.asked_at[entry + 1]]
        row = self.row[terms]
        score = np.zeros(self.n)
        whole = row[row >= 0]
        for i in range(0, len(whole), 512):
            score += self.rows[whole[i : i + 512]].sum(0)
        terms = terms[row < 0]
        start, size = self.first[terms], self.first[terms + 1] - self.first[terms]
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return score + np.bincount(self.doc[at], self.value[at], self.n)

    def neighbours(self, seed: int, left: np.ndarray) -> np.ndarray:
        """Documents with something ``left`` that share words with ``seed``, best first."""
        score = self.scores(self.of[seed])[self.of]
        score[seed] = 0
        found = np.flatnonzero((score > 0) & (left > 0))
        return found[np.argsort(-score[found], kind="stable")]


def fill(sizes: np.ndarray, neighbours, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; all sequences are full or a power of two long."""
    out, sequence = [], 0
    start = np.zeros(len(sizes), np.int64)
    for i, size in enumerate(sizes):  # whole windows of a long document stand alone
        for _ in range(int(size) // window):
            out.append((i, int(start[i]), window, sequence, 0))
            start[i] += window
            sequence += 1
    left = sizes - start
    waiting, seed, free, row = 0, -1, window, []
    todo = int(left.sum())
    offset = 0
    while todo:
        if seed < 0 or not left[seed]:
            while not left[waiting]:
                waiting += 1
            seed = waiting
        best, at, here = None, 0, seed
        while free and todo:
            take = int(min(left[here], free))
            row.append((here, int(start[here]), take))
            start[here] += take
            left[here] -= take
            free -= take
            todo -= take
            if not free or not todo:
                break
            if best is None:
                best = neighbours(seed, left)
            while at < len(best) and not left[best[at]]:
                at += 1
            if at < len(best):
                here = int(best[at])
            else:
                while not left[waiting]:
                    waiting += 1
                here = waiting
        if not free:
            offset = 0
            for i, s, n in row:
                out.append((i, s, n, sequence, offset))
                offset += n
            sequence, free, row, seed = sequence + 1, window, [], here
    room = offset = 0
    total = sum(n for _, _, n in row)
    for i, s, n in row:  # the last, partly filled window: one sequence for each binary digit of its length
        while n:
            if not room:
                room, offset = 1 << (total.bit_length() - 1), 0
                total -= room
            take = min(n, room)
            out.append((i, s, take, sequence, offset))
            s, n, room, offset = s + take, n - take, room - take, offset + take
            sequence += not room
    return out


_tables: dict[str, WordIds] = {}


def pack(docs: DataFrame, path: str | None = None, end_id: int = END_ID, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """The pieces of all rows of ``docs`` (doc_id, text), with their ids as a list if asked for."""
    work.short_batches(docs.sparkSession)
    rows = listed(docs)
    df, n_docs, n_words = frequencies(rows)
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # BUCKETS numbers
    mean = n_words / max(n_docs, 1)
    columns_ = [("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]]
    kind = pa.schema(columns_ + [("ids", pa.list_(pa.int32()))] * with_ids)

    def one(key, table):
        table = table.sort_by([("doc_id", "ascending"), ("mark", "ascending")]).combine_chunks()
        file = path or tokenizer_file()
        known = _tables.get(file) or _tables.setdefault(file, WordIds(file))
        words, ids = known.documents(*K.text_of(table, "text"))
        ids = [np.append(i, np.uint32(end_id)).astype("<u4") for i in ids]
        sizes = np.array([len(i) for i in ids], np.int64)
        index = Index(words, shared.value[known.buckets] if len(known.buckets) else np.zeros(1), mean)
        pieces = fill(sizes, index.neighbours, window)
        doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
        crc = [zlib.crc32(ids[d][s : s + n]) for d, s, n in zip(doc, start, length, strict=True)]
        columns = [table.column("doc_id").combine_chunks().take(pa.array(doc)), start, length, np.array(crc, np.int64), sizes[doc], sequence + (key[0].as_py() << 32), offset]
        if with_ids:
            columns.append(pa.array([ids[d][s : s + n].astype(np.int32) for d, s, n in zip(doc, start, length, strict=True)], pa.list_(pa.int32())))
        return pa.Table.from_batches([K.record(kind, *[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns])])

    return deal(docs, rows, df, idf, mean).groupBy("shard").applyInArrow(one, ROW + ", ids array<int>" * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(work.columns(work.table(spark, sf_dir, "documents"), doc_id="long", text="string"))

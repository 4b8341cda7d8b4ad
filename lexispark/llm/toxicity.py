"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

The features are rates over a whole text: density of a lexicon (learned as words whose document
frequency differs most between the labels), the same after undoing look-alike characters, how near
its hits stand to second-person words, capitals, punctuation, symbols, digits and obfuscated words.
Lexicon, trees and calibration are fitted on a bounded sample of labelled rows outside the held-out
part; every document is then scored in one pass without a shuffle.  A sampled row weighs as many rows as
it stands for, so that a score is a rate of the whole table whatever its size.

Edge cases: a null text counts as empty; an empty text gets the score of its (zero) features.
Without usable labels, or with one label only, every score is 0.  Labels that contradict each other
for a doc_id count as toxic.  Rows repeated in either table change nothing but their own row; of
different texts under one labelled doc_id the one with the least hash is learned from.  A score of
exactly 0.5 counts as toxic.  A very long text is one block of its own, whole.  An empty table gives
no rows.  Other columns are ignored, or passed through by ``rejected``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import work
from .boosting import Isotonic, Trees
from .langid import held_out

#: Bound of the labelled sample: rows of each label.
SAMPLE = 8000
#: Words that the lexicon may hold; a word needs this many toxic documents and this odds ratio.
LEXICON = 400
LEAST_DOCS = 8
ODDS = 20.0
#: Words between a lexicon hit and a second-person word that still count as near.
NEAR = 6

# Second-person words in the corpus languages, lower case.
SECOND_PERSON = (
    "you your yours yourself yourselves u ur thou thee "
    "du dich dir dein deine deinen deinem deiner euch euer eure ihr "
    "tu te toi ton ta tes vous votre vos "
    "ti tus tuyo tuya usted ustedes vosotros vuestro vuestra"
).split()
# Look-alike characters and the letters that they stand for.
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "*"}

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_ODD = np.zeros(256, bool)
_ODD[list(b"0134578@$*!#%&_")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PLAIN = K.LOWER.copy()
for _a, _b in LOOK_ALIKE.items():
    _PLAIN[ord(_a)] = ord(_b)

FEATURES = (
    "log_words", "hits_per_word", "log_hits", "top_density", "hit_kinds", "plain_hits_per_word", "plain_log_hits", "second_person", "near_hits", "nearest",
    "capitals", "capital_words", "marks", "punctuation", "digits", "odd_words", "tripled", "word_length", "hits_first_tenth",
)


def word_hashes(words_: list[str]) -> np.ndarray:
    data = [w.encode() for w in words_]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in data])]).astype(np.int64)
    block = np.frombuffer(b"".join(data), np.uint8)
    return K.Spans(block).hash(offsets[:-1], offsets[1:]) if len(data) else np.zeros(0, np.uint64)


class Members:
    """Which hashes belong to a small set: a bit filter first, then a search."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.filter = np.zeros(1 << 16, bool)
        self.filter[self.sorted & np.uint64(0xFFFF)] = True

    def which(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the members, and their places in the sorted set."""
        if not len(self.sorted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.filter[hashes & np.uint64(0xFFFF)])
        place = np.searchsorted(self.sorted, hashes[at])
        ok = self.sorted[np.minimum(place, len(self.sorted) - 1)] == hashes[at]
        return at[ok], place[ok]


def features(block: np.ndarray, at: np.ndarray, lexicon: Members, person: Members) -> np.ndarray:
    """The matrix of ``FEATURES``; a row for each text."""
    lower = K.LOWER[block]
    starts, ends, first = K.runs(_LETTER[block], at)
    n_docs, n = len(at) - 1, np.diff(first)
    per = np.maximum(n, 1)
    size = np.maximum(np.diff(at), 1)
    row = K.row_index(first)
    hashes = K.Spans(lower).hash(starts, ends)
    hit, kind = lexicon.which(hashes)
    you, _ = person.which(hashes)
    hits = np.bincount(row[hit], minlength=n_docs)
    out = np.zeros((n_docs, len(FEATURES)))
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(n), hits / per, np.log1p(hits)
    # Densest stretch: hits within 50 words of a hit, of the same text.
    if len(hit):
        far = np.searchsorted(hit, np.minimum(hit + 50, first[row[hit] + 1]))
        np.maximum.at(out[:, 3], row[hit], (far - np.arange(len(hit))).astype(float))
    pair = K.distinct(row[hit] * np.int64(len(lexicon.sorted) + 1) + kind)
    out[:, 4] = np.bincount((pair // (len(lexicon.sorted) + 1)).astype(np.int64), minlength=n_docs)
    # Words over letters and look-alikes, with these undone.
    mask = _LETTER[block] | _ODD[block]
    s2, e2, f2 = K.runs(mask, at)
    odd = np.concatenate([[0], np.cumsum(_ODD[block])])
    letters = np.concatenate([[0], np.cumsum(_LETTER[block])])
    inside = _ODD[block[np.minimum(s2, len(block) - 1)]] if len(block) else np.zeros(0, bool)
    mixed = (odd[e2] > odd[s2]) & (letters[e2] > letters[s2])
    ends_odd = _ODD[block[e2 - 1]] if len(block) else inside
    within = mixed & ((odd[e2] - odd[s2]) > (inside.astype(int) + ends_odd.astype(int)))
    row2 = K.row_index(f2)
    m = np.flatnonzero(within)
    undone, _ = lexicon.which(K.Spans(_PLAIN[block]).hash(s2[m], e2[m])) if len(m) else (np.zeros(0, np.int64), None)
    plain = hits + np.bincount(row2[m[undone]], minlength=n_docs)
    out[:, 5], out[:, 6] = plain / per, np.log1p(plain)
    out[:, 7] = np.bincount(row[you], minlength=n_docs) / per
    out[:, 9] = 50
    if len(hit) and len(you):
        right = np.searchsorted(you, hit)
        gap = np.full(len(hit), 50.0)
        for side in (right - 1, right):
            ok = (side >= 0) & (side < len(you))
            q = you[np.clip(side, 0, len(you) - 1)]
            ok &= row[q] == row[hit]
            gap = np.where(ok, np.minimum(gap, np.abs(q - hit)), gap)
        np.minimum.at(out[:, 9], row[hit], gap)
        out[:, 8] = np.bincount(row[hit[gap <= NEAR]], minlength=n_docs) / per
    caps = np.concatenate([[0], np.cumsum(_CAPITAL[block])])
    out[:, 10] = K.per_row(_CAPITAL[block], at) / size
    shout = (caps[ends] - caps[starts] == ends - starts) & (ends - starts > 1)
    out[:, 11] = np.bincount(row[shout], minlength=n_docs) / per
    out[:, 12] = K.per_row(_MARK[block], at) / size
    out[:, 13] = K.per_row(_PUNCT[block], at) / size
    out[:, 14] = K.per_row(_DIGIT[block], at) / size
    out[:, 15] = np.bincount(row2[within], minlength=n_docs) / per
    triple = np.zeros(len(block), bool)
    if len(block) > 2:
        triple[2:] = (lower[2:] == lower[1:-1]) & (lower[1:-1] == lower[:-2]) & _LETTER[block[2:]]
        for k in range(2):  # a text's first two bytes never go on with the text before it
            edge = at[:-1] + k
            triple[edge[edge < len(block)]] = False
    out[:, 16] = K.per_row(triple, at) / size
    out[:, 17] = K.per_row(_LETTER[block], at) / per
    early = hit - first[row[hit]] < np.maximum(n[row[hit]] // 10, 1)
    out[:, 18] = np.bincount(row[hit[early]], minlength=n_docs) / per
    return out


@dataclass
class Model:
    lexicon: Members
    person: Members
    trees: Trees | None
    curve: Isotonic | None

    def score(self, block: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(at) - 1)
        return self.curve.read(self.trees.raw(features(block, at, self.lexicon, self.person)))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic, weight) of at most ``rows`` documents of each label, none of them held out."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(parts=5, part=0))
    one = one.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") >= 1, 1).otherwise(0)).alias("toxic"))
    dice = F.xxhash64("doc_id", F.lit(17))
    ids = one.filter("toxic = 1").orderBy(dice).limit(rows).union(one.filter("toxic = 0").orderBy(dice).limit(rows))
    ids = staged = work.staged(ids, "toxic-ids")  # 2 * SAMPLE ids at most: a proven bound for the broadcast
    # Each row stands for the rows of its label that the bound left out.
    per = {r["toxic"]: max(1.0, r["count"] / rows) for r in one.groupBy("toxic").count().collect()}
    ids = ids.withColumn("weight", F.when(F.col("toxic") == 1, per.get(1, 1.0)).otherwise(per.get(0, 1.0)))
    sample = work.staged(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic", "weight").agg(F.min_by(F.struct("text"), F.xxhash64("text")).alias("t")).select("doc_id", "t.text", "toxic", "weight"), "toxic-sample")
    work.discard(staged)
    return sample


def _frequencies(batches):
    """(word, toxic documents, other documents) of each task."""
    sums: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(K.ids_of(batch, "text").to_pylist(), K.ids_of(batch, "toxic").to_pylist(), strict=True):
            data = np.frombuffer((text or "").encode(), np.uint8)
            lower = bytes(np.where(_LETTER[data], K.LOWER[data], 32).astype(np.uint8)).decode("utf-8", "ignore")
            for word in set(lower.split()):
                sums.setdefault(word, [0, 0])[1 - toxic] += 1
    rows = list(sums.items())
    kind = pa.schema([("word", pa.string()), ("bad", pa.int64()), ("good", pa.int64())])
    for i in range(0, len(rows), 50_000):
        part = rows[i : i + 50_000]
        yield K.record(kind, [w for w, _ in part], [c[0] for _, c in part], [c[1] for _, c in part])


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """Fit lexicon, trees and calibration; each part of the sample (by a hash of the id) serves one of them more than the others."""
    spark = docs.sparkSession
    sample = labelled_sample(docs.select("doc_id", "text"), labels, rows)
    # Copies of one text would make their accidental words look toxic: each distinct text counts once.
    counted = sample.groupBy("text").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in counted.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    person = Members(word_hashes(SECOND_PERSON))
    if sizes.get(1, 0) < 2 or sizes.get(0, 0) < 2:
        work.discard(sample)
        return Model(Members(np.zeros(0, np.uint64)), person, None, None)
    spread = counted.repartition(work.shuffle_width(spark))
    odds = ((F.col("bad") + 0.5) / sizes[1]) / ((F.col("good") + 0.5) / sizes[0])
    least = max(3, min(LEAST_DOCS, sizes[1] // 20))
    words = (
        spread.mapInArrow(_frequencies, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .filter((F.col("bad") >= least) & (odds >= ODDS)).orderBy(F.desc(F.col("bad") * F.log(odds)), "word").limit(LEXICON)
    ).collect()
    lexicon = Members(word_hashes([r["word"] for r in words]))
    many = len(FEATURES)

    def measure(batches):
        kind = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("weight", pa.float64()), ("x", pa.list_(pa.float64()))])
        for batch in batches:
            data, offsets = K.text_of(batch, "text")
            x = [features(block, at, lexicon, person) for _, _, block, at in K.blocks(data, offsets)]
            if x:
                x = np.concatenate(x)
                yield K.record(kind, K.ids_of(batch, "doc_id"), K.ids_of(batch, "toxic"), K.ids_of(batch, "weight"), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, many), pa.int32()), pa.array(x.ravel())))

    table = sample.select("doc_id", "toxic", "weight", "text").repartition(work.shuffle_width(spark)).mapInArrow(measure, "doc_id long, toxic int, weight double, x array<double>").orderBy("doc_id").toPandas()  # the bounded sample's features
    work.discard(sample)
    x, y = np.array(table["x"].tolist(), float).reshape(-1, many), table["toxic"].to_numpy(float)
    weight = table["weight"].to_numpy(float)
    weight = weight * (len(weight) / weight.sum())  # 1 in the mean, as the trees and the curve count rows
    # Cross-fitting: each third is scored by trees that never saw it; the curve is fitted on these scores.
    fold = K.mix(table["doc_id"].to_numpy(np.int64).astype(np.uint64)) % np.uint64(3)
    raw = np.zeros(len(y))
    for f in range(3):
        here = fold == np.uint64(f)
        if here.any() and 0 < y[~here].mean() < 1:
            raw[here] = Trees().fit(x[~here], y[~here], weight[~here]).raw(x[here])
    return Model(lexicon, person, Trees().fit(x, y, weight), Isotonic().fit(raw, y, weight))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    work.short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred kilobytes whatever the corpus holds
    kind = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for batch in batches:
            data, offsets = K.text_of(batch, "text")
            s = [shared.value.score(block, at) for _, _, block, at in K.blocks(data, offsets)]
            if s:
                s = np.concatenate(s)
                yield K.record(kind, K.ids_of(batch, "doc_id"), K.ids_of(batch, "held_out"), s, (s >= 0.5).astype(np.int32))

    return docs.select("doc_id", held_out(parts=5, part=0).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def rejected(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that the model calls toxic; all columns stay as they are."""
    work.short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        for batch in batches:
            data, offsets = K.text_of(batch, "text")
            s = [shared.value.score(block, at) for _, _, block, at in K.blocks(data, offsets)]
            if s:
                yield batch.filter(pa.array(np.concatenate(s) < 0.5)).select(names)

    return docs.mapInArrow(run, docs.schema)


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = work.columns(work.table(spark, sf_dir, "documents"), doc_id="long", text="string")
    return docs, work.columns(work.table(spark, sf_dir, "labels"), doc_id="long", toxic="int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = inputs(spark, sf_dir)
    work.short_batches(spark)
    return score(docs, learn(docs, labels))

"""Quality rules: hashed n-gram log-likelihood ratio between trusted target and raw corpus.

The byte four-grams of every text are hashed into a fixed number of buckets.  Two multinomials are
counted over the buckets: the raw corpus (every document) and the trusted target (every document
labelled as good).  A document's score is its mean log ratio per n-gram, and it is kept where the
score reaches a threshold that is fitted on the scores of all labelled documents once and then
compared with every document; nothing is drawn at random, and nothing comes from a sample.  Plain
counts over the words ``[^\\x20\\x09-\\x0D]+`` come first: documents that fail them are never kept.

Edge cases: a null text counts as empty; empty texts have no words and fail the base rules.  Without
good labels the threshold is minus infinity, so that the base rules alone decide.  A doc_id with several
labels is good where each of them is.  Rows that repeat a doc_id are each counted and judged on their own
text, with the label of the doc_id.  A score equal to the threshold is kept; equal texts score the same
wherever they lie.  A very long text is one block of its own, whole.  An empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import tallies, work

#: Buckets of the hashed n-grams; n; log ratios are kept in whole parts of this size, so that their sums are exact.
BUCKETS = 1 << 18
GRAM = 4
FINE = 1 << 24
#: Bits of the hashed set of good ids that spares other texts the shuffle; the join after it is exact.
MARK_BITS = 1 << 26
#: Different scores that one task puts in order, more or less.
STRETCH = 100_000
#: N-grams of neutral evidence added to each document, so that a short one is not judged on a few.
PRIOR = 40
#: Share of the trusted documents that the threshold must keep.
KEEP_TRUSTED = 0.998

MIN_WORDS = 50
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def gram_buckets(block: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram that lies within a text, and the row offsets of these n-grams."""
    n = len(block) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    code = np.zeros(n, np.uint32)
    for j in range(GRAM):
        code = (code << np.uint32(8)) | block[j : j + n]
    inside = np.ones(n, bool)
    for j in range(1, GRAM):
        edge = at[1:] - j
        inside[edge[(edge >= 0) & (edge < n)]] = False
    grams = np.maximum(np.diff(at) - GRAM + 1, 0)
    # A text shorter than n bytes lies wholly inside the strips that were masked.
    code = (code[inside] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 18)
    return code.astype(np.int64), np.concatenate([[0], np.cumsum(grams)])


def base_counts(block: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    starts, ends, first = K.words(block, at)
    out = np.zeros((len(at) - 1, 5), np.int64)
    out[:, 0] = np.diff(first)
    chars = ((block & 0xC0) != 0x80) & ~K.SPACE[block]
    out[:, 1] = K.per_row(chars, at)
    out[:, 2] = K.per_row(_SYMBOL[block], at)
    spans = K.Spans(block)
    out[:, 3] = _repeated_lines(block, at, spans)
    hashes = spans.hash(starts, ends)
    n = len(hashes) - 2
    if n > 0:
        row = K.row_index(first)
        triple = K.mix(hashes[:n] * np.uint64(3) + K.mix(hashes[1 : n + 1] * np.uint64(5) + K.mix(hashes[2:] + np.uint64(7))))
        ok = row[:n] == row[2:]
        where = np.flatnonzero(ok)
        key = K.mix(triple[where] + row[where].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        again = _more_than_once(key)
        hit = np.zeros(len(hashes), bool)
        twice = where[again]
        for j in range(3):
            hit[twice + j] = True
        out[:, 4] = K.per_row(hit, first)
    return out


def _more_than_once(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), bool)
    out[order] = same[1:] | same[:-1]
    return out


def _repeated_lines(block: np.ndarray, at: np.ndarray, spans: K.Spans) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    starts, ends, first = K.runs(block != 10, at)
    row = K.row_index(first)
    worded = np.concatenate([[0], np.cumsum(~K.SPACE[block])])
    keep = worded[ends] > worded[starts]
    starts, ends, row = starts[keep], ends[keep], row[keep]
    key = K.mix(spans.hash(starts, ends) + row.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    _, one = np.unique(key, return_index=True)
    fresh = np.zeros(len(key), bool)
    fresh[one] = True
    return np.bincount(row[~fresh], minlength=len(at) - 1)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > 50 * counts[:, 0])


class Model:
    """Log ratio of each bucket, and the threshold."""

    def __init__(self, ratio: np.ndarray, threshold: float = -np.inf):
        self.ratio, self.threshold = np.rint(ratio * FINE).astype(np.int32), threshold

    def scores(self, block: np.ndarray, at: np.ndarray) -> np.ndarray:
        code, first = gram_buckets(block, at)
        return K.per_row(self.ratio[code], first) / FINE / (np.diff(first) + PRIOR)


def marks(labels: DataFrame) -> DataFrame:
    """(doc_id, good) of every labelled doc_id."""
    return labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") >= 1).alias("good"))


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(text) of the rows of ``docs`` whose doc_id is in ``ids``.

    Most rows that are not wanted are left out by a hashed set of fixed size before the shuffle; the join decides.
    """
    place = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(MARK_BITS))
    wide = 1 << 15  # bits of one bitmap of ``bitmap_construct_agg``
    parts = ids.select(place.alias("at")).groupBy(F.floor(F.col("at") / wide).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % wide).alias("bits"))
    bits = np.zeros((MARK_BITS // wide, wide // 8), np.uint8)
    for row in parts.collect():  # MARK_BITS at most
        bits[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    def maybe(batches):
        for batch in batches:
            at = K.ids_of(batch, "at").to_numpy()
            keep = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield batch.select(["doc_id", "text"]).filter(pa.array(keep.astype(bool)))

    few = docs.filter("doc_id is not null").select("doc_id", "text", place.alias("at")).mapInArrow(maybe, "doc_id long, text string")
    return few.join(ids.select("doc_id").hint("merge"), "doc_id").select("text")  # the ids grow with the corpus


def gram_totals(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all ``texts``."""

    def count(batches):
        sums = np.zeros((1, BUCKETS), np.int64)
        for batch in batches:
            for _, _, block, at in K.blocks(*K.text_of(batch, "text")):
                sums[0] += np.bincount(gram_buckets(block, at)[0], minlength=BUCKETS)
        yield from tallies.chunks(sums)

    return tallies.total(texts.select("text").mapInArrow(count, tallies.ROW), 1, BUCKETS)[0]


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    model, rows = fitted(docs, labels)
    work.discard(rows)
    return model


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all of ``docs`` and ``labels``, and the staged rows of ``judge`` before there was a threshold."""
    known = work.staged(marks(labels), "quality-marks")
    raw, target = gram_totals(docs), gram_totals(texts_of(docs, known.filter("good")))
    model = Model(np.zeros(BUCKETS))
    if target.sum():
        # The raw share of a bucket is the prior of its target share: buckets never seen in the target weigh little.
        p = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
        smooth = 0.02 * target.sum()
        q = (target + smooth * p) / (target.sum() + smooth)
        model = Model(np.log(q / p))
    rows = work.staged(judge(docs, model), "quality-rows")  # a few numbers a document
    judged = rows.filter("not base_failed").select("doc_id", "score").join(known.hint("merge"), "doc_id")
    model.threshold = fit(judged.select("score", "good"))
    work.discard(known)
    return model, rows


def fit(judged: DataFrame) -> float:
    """``threshold`` of all rows (score, good) of a table, without a task or the driver seeing them all.

    Equal scores become one row with their counts; stretches of scores are summed up each on its own and
    shifted by the counts of those before.
    """
    scores = work.staged(judged.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("poor")), "quality-scores")
    n, good, poor = scores.agg(F.count("*"), F.sum("good"), F.sum("poor")).first()
    if not good:
        work.discard(scores)
        return -np.inf
    runs = work.staged(scores.repartitionByRange(work.parts_for(n, STRETCH, 1), "score").withColumn("stretch", F.spark_partition_id()), "quality-stretches")
    before = Window.partitionBy(F.lit(0)).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
    sizes = runs.groupBy("stretch").agg(F.sum("good").alias("g"), F.sum("poor").alias("p"))
    sizes = F.broadcast(sizes.select("stretch", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("g", "p")]))
    up = Window.partitionBy("stretch").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    runs_up = runs.join(sizes, "stretch").select("score", (F.sum("good").over(up) + F.col("g")).alias("lost"), (F.sum("poor").over(up) + F.col("p")).alias("caught"))

    def least(where) -> float | None:
        return runs_up.filter(where).agg(F.min("score")).first()[0]

    if not poor:
        place = (good - 1) * (1 - KEEP_TRUSTED)
        ends = [least(F.col("lost") > min(int(place) + j, good - 1)) for j in (0, 1)]
        cut = float(np.quantile(ends, place - int(place))) - 1.0
    else:
        lost = F.col("lost") / good
        gain = F.struct((F.col("caught") / poor - lost).alias("gain"), (-F.col("score")).alias("low"))
        best = runs_up.filter(lost <= 1 - KEEP_TRUSTED).agg(F.max(gain)).first()[0]
        if best is None:
            cut = least(F.lit(True))
        else:
            above = least(F.col("score") > -best["low"])
            cut = -best["low"] if above is None else (above - best["low"]) / 2
    work.discard(scores, runs)
    return float(cut)


def threshold(score: np.ndarray, good: np.ndarray) -> float:
    """The cut with the best balanced accuracy among those that keep ``KEEP_TRUSTED`` of the trusted rows; ``fit`` finds it over a table."""
    if not good.any():
        return -np.inf
    if good.all():
        return float(np.quantile(score, 1 - KEEP_TRUSTED)) - 1.0
    order = np.argsort(score, kind="stable")
    score, good = score[order], good[order]
    lost = np.cumsum(good) / good.sum()
    caught = np.cumsum(~good) / (~good).sum()
    cut = np.flatnonzero(np.append(score[1:] > score[:-1], True) & (lost <= 1 - KEEP_TRUSTED))
    if not len(cut):
        return float(score[0])
    best = cut[np.argmax((caught - lost)[cut])]
    return float((score[best] + score[min(best + 1, len(score) - 1)]) / 2)


ROW = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` with its base counts, the base verdict, the score and the final verdict."""
    work.short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])

    def run(batches):
        m = shared.value
        for batch in batches:
            data, offsets = K.text_of(batch, "text")
            counts, scores = [], []
            for _, _, block, at in K.blocks(data, offsets):
                counts.append(base_counts(block, at))
                scores.append(m.scores(block, at))
            if counts:
                c, s = np.concatenate(counts), np.concatenate(scores)
                bad = base_failed(c)
                yield K.record(kind, K.ids_of(batch, "doc_id"), *c.T, bad, ~bad & (s >= m.threshold), s)

    return docs.select("doc_id", "text").mapInArrow(run, ROW)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = work.columns(work.table(spark, sf_dir, "documents"), doc_id="long", text="string")
    labels = work.columns(work.table(spark, sf_dir, "labels"), doc_id="long", quality="int")
    work.short_batches(spark)
    model, rows = fitted(docs, labels)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= float(model.threshold)))

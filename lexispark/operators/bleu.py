"""Corpus BLEU as joins and sums over n-gram counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lists
from ..functions import text as X

TINY = 1e-10


def ngram_counts(rows: DataFrame, text: str, max_n: int = 4, key: str = "line_no") -> DataFrame:
    """(key, n, gram, count)."""
    words = rows.select(key, X.split_words(F.coalesce(text, F.lit(""))).alias("ws"))
    grams = [words.select(key, F.lit(n).alias("n"), F.explode(X.ngrams(F.col("ws"), n)).alias("gram")) for n in range(1, max_n + 1)]
    out = grams[0]
    for more in grams[1:]:
        out = out.unionByName(more)
    return out.groupBy(key, "n", "gram").agg(F.count("*").alias("count"))


def _longer(words: np.ndarray, n_prev: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Exact numbers of all runs of ``n`` words from those of n - 1 (-1: over the end of a row): no hash, so no two runs share one."""
    whole = row[: len(n_prev) - 1] == row[n - 1 :]
    code = n_prev[:-1][whole] * (int(words.max(initial=0)) + 1) + words[n - 1 :][whole]
    out = np.full(len(n_prev) - 1, -1, np.int64)
    out[whole] = np.unique(code, return_inverse=True)[1]
    return out


def _clipped(max_n: int):
    """Sums over a batch: for each order, clipped matches and n-grams; the words of both sides come with order 0."""

    def run(batches):
        for batch in batches:
            sides = [batch.column(i) for i in (0, 1)]
            sizes = [lists.sizes(x) for x in sides]
            coded = pa.concat_arrays([x.flatten() for x in sides]).dictionary_encode()
            words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            rows = len(sides[0])
            row = np.concatenate([np.repeat(np.arange(rows), sizes[0]), rows + np.repeat(np.arange(rows), sizes[1])])
            out = [(0, int(sizes[0].sum()), int(sizes[1].sum()))]
            gram = words
            for n in range(1, max_n + 1):
                if n > 1:
                    gram = _longer(words, gram, row, n) if len(gram) > 1 else gram[:0]
                here = gram >= 0
                of, own = row[: len(gram)][here], gram[here]
                wide = int(own.max(initial=0)) + 1
                pred, many = np.unique(of[of < rows] * wide + own[of < rows], return_counts=True)
                ref, most = np.unique((of[of >= rows] - rows) * wide + own[of >= rows], return_counts=True)
                _, a, b = np.intersect1d(pred, ref, assume_unique=True, return_indices=True)
                out.append((n, int(np.minimum(many[a], most[b]).sum()), int(many.sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["n", "a", "b"])

    return run


def components(rows: DataFrame, max_n: int = 4) -> DataFrame:
    """(n, matches, total, pred_len, ref_len): clipped matches and n-grams of each order over all sentences.

    Both texts of a sentence are in one row, so counts are clipped within Arrow batches, and only sums are shuffled.
    """
    words = rows.select(*[X.split_words(F.coalesce(c, F.lit(""))).alias(c) for c in ("pred", "ref")])
    sums = words.mapInArrow(_clipped(max_n), "n int, a long, b long").groupBy("n").agg(F.sum("a").alias("matches"), F.sum("b").alias("total"))
    orders = rows.sparkSession.range(0, max_n + 1).select(F.col("id").cast("int").alias("n"))
    all_ = orders.join(sums, "n", "left").na.fill(0, ["matches", "total"])
    lengths = all_.filter("n = 0").select(F.col("matches").alias("pred_len"), F.col("total").alias("ref_len"))
    return all_.filter("n > 0").crossJoin(lengths)  # one row


def bleu(rows: DataFrame, max_n: int = 4) -> DataFrame:
    """One row: bleu (0 to 100), brevity penalty, lengths.  Without rows 0."""
    parts = components(rows, max_n)
    precision = F.when(F.col("total") > 0, (F.col("matches") + TINY) / (F.col("total") + TINY)).otherwise(TINY)
    out = parts.groupBy("pred_len", "ref_len").agg(F.exp(F.avg(F.log(precision))).alias("mean"))
    penalty = F.when(F.col("pred_len") == 0, 0.0).when(F.col("pred_len") < F.col("ref_len"), F.exp(1 - F.col("ref_len") / F.col("pred_len"))).otherwise(1.0)
    return out.withColumn("brevity", penalty).select((100 * F.col("brevity") * F.col("mean")).alias("bleu"), "brevity", "pred_len", "ref_len")


def compute_bleu(spark, predictions: list[str], references: list[str], max_n: int = 4) -> float:
    """BLEU of two lists; ValueError if their lengths differ."""
    if len(predictions) != len(references):
        raise ValueError(f"{len(predictions)} predictions, {len(references)} references")
    if not predictions:
        return 0.0
    rows = spark.createDataFrame(list(zip(range(len(predictions)), predictions, references, strict=True)), "line_no long, pred string, ref string")
    return bleu(rows, max_n).first()["bleu"]

"""Language ID by prediction by partial matching.

One variable-order byte context tree per language is counted on a bounded sample of labelled rows,
then frozen: every (context, next symbol) pair gets its exact code length in bits under PPM method C
with exclusion (an escape costs q / (n + q) where q symbols followed the context n times).  Frozen
code lengths do not change while a text is read, so the length of a text in a language is a sum of
table entries, one per byte, and the whole corpus is scored in one pass without a shuffle.

Edge cases: a null text, an empty one and one without a letter get ``und`` and score 0.  Rows
whose language is null are never learned from.  Without any row to learn from, all are ``und``.
Equal code lengths go to the language that sorts first.  Rows that repeat are predicted each on its
own.  A very long text is one block of its own, whole.  An empty table gives no rows.  Columns beyond
those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import work

#: Bound of the labelled sample: documents per language, taken by the smallest hash of their id.
DOCS_PER_LANGUAGE = 1500
#: Longest context in bytes, and how many contexts of that order a tree may keep.
ORDER = 3
CONTEXTS = 8192
#: Byte values with a symbol of their own; the others share one, spelled out at 8 bits more.
SYMBOLS = 126


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # byte -> symbol
    size: int  # of the alphabet
    rows: np.ndarray  # last three symbols -> row of the longest context kept
    bits: np.ndarray  # (row, symbol) -> bits in each language


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2):
    """Whether crc32 of the id as text falls into the part that is never learned from; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == part


def training_sample(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """At most about ``per_language`` labelled documents of each language, chosen by a hash of the id."""
    labelled = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = labelled.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count("*")).alias("share"))
    # One row per language: tiny, and measured before it is broadcast.
    shares = {r["lang"]: r["share"] for r in shares.collect()}
    if not shares:
        return labelled.select("lang", "text").limit(0)
    dice = (F.xxhash64("doc_id", F.lit(11)).bitwiseAND((1 << 52) - 1)) / float(1 << 52)
    keep = F.lit(False)
    for lang, share in shares.items():
        keep = keep | ((F.col("lang") == lang) & (dice < share))
    return labelled.filter(keep).select("lang", "text")


def _count_grams(batches):
    """(language, four bytes, how often): each task sums its own share first."""
    sums: dict[str, dict] = {}
    kind = work_schema()
    for batch in batches:
        langs = np.array(K.ids_of(batch, "lang").to_pylist(), object)
        data, offsets = K.text_of(batch, "text")
        for a, b, block, at in K.blocks(data, offsets):
            padded = _history(block, at, np.arange(256, dtype=np.int64) + 1, 257)
            code = ((padded[2] * 257 + padded[1]) * 257 + padded[0]) * 256 + block
            row = K.row_index(at)
            for lang in set(langs[a:b]):
                mine = np.isin(row, np.flatnonzero(langs[a:b] == lang))
                codes, n = np.unique(code[mine], return_counts=True)
                kept = sums.setdefault(lang, {"code": [], "n": []})
                kept["code"].append(codes)
                kept["n"].append(n)
                if len(kept["code"]) > 32:
                    kept["code"], kept["n"] = ([x] for x in _merged(kept))
    for lang, kept in sums.items():
        codes, n = _merged(kept)
        for i in range(0, len(codes), 65536):
            part = codes[i : i + 65536]
            yield K.record(kind, pa.array([lang] * len(part), pa.string()), part, n[i : i + 65536])


def _merged(kept: dict) -> tuple[np.ndarray, np.ndarray]:
    codes, n = np.concatenate(kept["code"]), np.concatenate(kept["n"])
    codes, where = np.unique(codes, return_inverse=True)
    return codes, np.bincount(where, n, len(codes)).astype(np.int64)


def work_schema() -> pa.Schema:
    return pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])


def _history(block: np.ndarray, at: np.ndarray, symbol: np.ndarray, _size: int) -> list[np.ndarray]:
    """For each byte the symbols one, two and three before it; 0 beyond the start of its text."""
    now = symbol[block]
    starts = at[:-1][at[:-1] < len(block)]
    out = []
    for back in range(1, ORDER + 1):
        past = np.zeros_like(now)
        past[back:] = now[:-back] if back < len(now) else 0
        for k in range(back):
            edge = starts + k
            past[edge[edge < len(block)]] = 0
        out.append(past)
    return out


def learn(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> Model | None:
    """Count, prune and freeze the context trees of all languages; None if nothing is labelled."""
    counts = (
        training_sample(docs, per_language).mapInArrow(_count_grams, "lang string, code long, n long")
        .groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ).toPandas()  # bounded by the sample: four-byte strings of at most DOCS_PER_LANGUAGE texts a language
    return freeze(counts["lang"].to_numpy(object), counts["code"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)) if len(counts) else None


def freeze(lang: np.ndarray, code: np.ndarray, n: np.ndarray, contexts: int = CONTEXTS) -> Model:
    languages = sorted(set(lang))
    which = np.searchsorted(languages, lang)
    last, rest = code % 256, code // 256
    seen = np.bincount(last, n, 256)
    order = np.argsort(-seen, kind="stable")[:SYMBOLS]
    order = np.sort(order[seen[order] > 0])
    symbol = np.full(256, len(order) + 1, np.int64)  # 0: before the start; the last: any rarer byte
    symbol[order] = np.arange(len(order)) + 1
    size = len(order) + 2
    past = np.concatenate([[0], symbol])  # of the codes, which keep bytes plus one and 0 for the start
    back = [past[rest % 257], past[rest // 257 % 257], past[rest // 257 // 257]]
    now = symbol[last]
    many = len(languages)
    lower = np.full((1, size, many), 1.0 / size)
    tables, parent = [], np.zeros(1, np.int64)  # per order: probabilities; for each context of it, its row
    rows_at = np.zeros(1, np.int64)
    base, keys_before = 0, np.zeros(1, np.int64)
    lookup = np.zeros(1, np.int64)
    for k in range(ORDER + 1):
        key = np.zeros(len(now), np.int64)
        for j in range(k):
            key = key + back[j] * size**j
        full = np.bincount(key, n, size**k)
        kept = np.flatnonzero(full)
        if len(kept) > contexts:
            kept = np.sort(kept[np.argsort(-full[kept], kind="stable")[:contexts]])
        slot = np.full(size**k, -1, np.int64)
        slot[kept] = np.arange(len(kept))
        use = slot[key] >= 0
        got = np.zeros((len(kept), size, many))
        np.add.at(got, (slot[key[use]], now[use], which[use]), n[use])
        if k:
            short = lookup[kept % size ** (k - 1)]  # the row of the longest shorter context
            under = np.concatenate(tables)[short]
        else:
            under = np.repeat(lower, len(kept), 0)
        total, kinds = got.sum(1, keepdims=True), (got > 0).sum(1, keepdims=True)
        unseen = np.where(got > 0, 0.0, under)
        share = unseen.sum(1, keepdims=True)
        unseen = np.divide(unseen, share, out=np.zeros_like(unseen), where=share > 0)
        escape = np.where(share > 0, kinds, 0)
        made = np.where(total > 0, (got + escape * unseen) / np.maximum(total + escape, 1), under)
        wide = np.arange(size**k)
        rows = np.where(slot >= 0, slot + sum(map(len, tables)), lookup[wide % size ** (k - 1)] if k else 0)
        tables.append(made)
        lookup = rows
    bits = -np.log2(np.maximum(np.concatenate(tables), 1e-12))
    bits[:, size - 1, :] += 8
    return Model(languages, symbol.astype(np.int32), size, lookup.astype(np.int32), bits.reshape(-1, many).astype(np.float32))


def code_lengths(model: Model, block: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bits of each text in each language."""
    one, two, three = _history(block, at, model.symbol, model.size)
    row = model.rows[(three * model.size + two) * model.size + one]
    cost = model.bits[row * model.size + model.symbol[block]]
    out = np.zeros((len(at) - 1, len(model.languages)))
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.add.reduceat(cost, at[full], axis=0, dtype=np.float64)
    return out


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def has_letter(block: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = K.per_row(_LETTER[block], at) > 0
    for i in np.flatnonzero(~out & (K.per_row(block >= 0x80, at) > 0)):
        out[i] = any(c.isalpha() for c in block[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Columns ``doc_id, held_out, lang_pred, score`` and ``bits_per_byte`` of every row of ``docs``."""
    spark = docs.sparkSession
    work.short_batches(spark)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    shared = spark.sparkContext.broadcast(model)  # its size is fixed by CONTEXTS, SYMBOLS and the number of languages
    kind = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])

    def score(batches):
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            data, offsets = K.text_of(batch, "text")
            best, sure, rate = [], [], []
            for _, _, block, at in K.blocks(data, offsets):
                bits, size = code_lengths(m, block, at), np.maximum(np.diff(at), 1)
                least = bits.argmin(1)
                # Posterior of the best language; the square root keeps long texts from all reading 1.
                gap = (bits - bits.min(1, keepdims=True)) * np.log(2) / np.sqrt(size)[:, None]
                top = 1 / np.exp(-gap).sum(1)
                ok = has_letter(block, at)
                best.append(np.where(ok, least, len(m.languages)))
                sure.append(np.where(ok, top, 0.0))
                rate.append(np.where(ok, bits.min(1) / size, 0.0))
            if best:
                yield K.record(kind, K.ids_of(batch, "doc_id"), K.ids_of(batch, "held_out"), pa.array(names[np.concatenate(best)], pa.string()), np.concatenate(sure), np.concatenate(rate))

    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = work.columns(work.table(spark, sf_dir, "documents"), doc_id="long", text="string", lang="string")
    work.short_batches(spark)
    return identify(docs, learn(docs))

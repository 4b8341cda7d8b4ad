"""Line dedup by content-defined chunks of lines.

A chunk is the shortest stretch of lines from a worded line on, or back from one, that has at least
``LEAST_LINES`` worded lines and ``LEAST_WORDS`` words.  Its ends depend on its own bytes alone, so a
passage that moves up or down, or into another document, is cut at the same places, and chunks overlap,
so a passage loses nothing at its ends: every stretch of that many worded lines and words that an
earlier place of the corpus holds is made up of repeated chunks.  Chunks that occur more than once in
the corpus keep their first occurrence, by (doc_id, line); every other occurrence is compared byte by
byte with it and removed if equal.  The earliest occurrence of a line is in no such chunk, so it stays.

Keys are summed before they are shuffled.  Only repeated chunks carry their bytes, and these meet
in a sort-merge join of two tables, whose skewed keys adaptive execution splits.

Edge cases: lines end at ``\\n``; a null or empty text has no lines and stays as it is.  A null
doc_id sorts before all others; different texts of one doc_id go by line, then by a hash.  Rows that
repeat doc_id and text are one occurrence, so they keep or lose the same lines.  A very long text is
one block of its own, whole.  An empty table gives no rows.  Repeats of one line, or of fewer than ``LEAST_WORDS`` words, always stay, and
so do lines without words at the ends of a repeat.  A text all of whose lines go becomes empty; the row
remains.  Clashing extra columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import work

#: Worded lines and words that a chunk has at least.
LEAST_LINES = 2
LEAST_WORDS = 8

CHUNK = "doc_id long, mark long, line int, lines int, start long, size long, k1 long, k2 long"


def line_bounds(block: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines (without their line feed), and where each row's lines begin."""
    feeds = block == 10
    ends = np.sort(np.concatenate([at[1:], np.flatnonzero(feeds)]), kind="stable")
    first = np.concatenate([[0], np.cumsum(K.per_row(feeds, at) + 1)])
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1] + 1
    starts[first[:-1]] = at[:-1]
    return starts, ends, first


def chunk_bounds(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin and end, given the words of each worded line and where each row's worded lines begin."""
    n = len(words)
    at, row = np.arange(n), K.row_index(first)
    sums = np.concatenate([[0], np.cumsum(words)])
    stop = np.maximum(at + LEAST_LINES, np.searchsorted(sums, sums[:-1] + LEAST_WORDS))
    begin = np.minimum(at + 1 - LEAST_LINES, np.searchsorted(sums, sums[1:] - LEAST_WORDS, "right") - 1)
    ahead, back = stop <= first[row + 1], begin >= first[row]
    code = K.distinct(np.concatenate([at[ahead] * (n + 1) + stop[ahead], begin[back] * (n + 1) + at[back] + 1]))
    return code // (n + 1), code % (n + 1)


def chunks(block: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The chunks that may be removed: row, line, lines, byte range and a 128-bit key of their bytes."""
    starts, ends, first = line_bounds(block, at)
    one, two = K.Spans(block, 0), K.Spans(block, 1)
    words, _, _ = K.words(block, at)
    words = np.searchsorted(words, ends) - np.searchsorted(words, starts)
    worded = np.flatnonzero(words)
    begins, stops = chunk_bounds(words[worded], np.searchsorted(worded, first))
    begins, stops = worded[begins], worded[stops - 1] + 1
    lo, hi = starts[begins], ends[stops - 1]
    row = np.searchsorted(first, begins, "right") - 1
    return {"row": row, "line": begins - first[row], "lines": stops - begins, "start": lo - at[row], "size": hi - lo, "k1": one.hash(lo, hi).view(np.int64), "k2": two.hash(lo, hi).view(np.int64)}


def _list_chunks(batches):
    kind = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("line", pa.int32()), ("lines", pa.int32()), *[(c, pa.int64()) for c in ("start", "size", "k1", "k2")]])
    for batch in batches:
        data, offsets = K.text_of(batch, "text")
        for a, _, block, at in K.blocks(data, offsets):
            c = chunks(block, at)
            here = pa.array(c["row"] + a)
            yield K.record(kind, K.ids_of(batch, "doc_id").take(here), K.ids_of(batch, "mark").take(here), *[c[n] for n in ("line", "lines", "start", "size", "k1", "k2")])


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, gone): the (line, lines) ranges to remove from the text with this mark."""
    work.short_batches(docs.sparkSession)
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    found = work.staged(marked.mapInArrow(_list_chunks, CHUNK), "line-chunks")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "line", "mark")
    repeated = work.staged(
        found.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("k1", "k2", "first"), "line-keys"
    )
    f, r = found.alias("f"), repeated.alias("r")
    same = (F.col("f.k1") == F.col("r.k1")) & (F.col("f.k2") == F.col("r.k2"))
    original = F.col("f.doc_id").eqNullSafe(F.col("r.first.doc_id")) & (F.col("f.line") == F.col("r.first.line")) & (F.col("f.mark") == F.col("r.first.mark"))
    met = f.join(r, same).select("f.*", original.alias("original"))
    per_doc = work.staged(met.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("line", "lines", "start", "size", "k1", "k2", "original")).alias("parts")), "line-parts")  # no more than the document has chunks
    work.discard(found, repeated)
    m, p = marked.alias("m"), per_doc.alias("p")
    on = F.col("m.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("m.mark") == F.col("p.mark"))
    bytes_of = "transform(p.parts, c -> named_struct('line', c.line, 'lines', c.lines, 'k1', c.k1, 'k2', c.k2, 'original', c.original, 'data', substring(cast(m.text as binary), cast(c.start as int) + 1, cast(c.size as int))))"
    parts = m.join(p.hint("merge"), on).select("m.doc_id", "m.mark", F.explode(F.expr(bytes_of)).alias("c"))  # the lists grow with the corpus: never broadcast
    parts = work.staged(parts.select("doc_id", "mark", "c.*"), "line-bytes")
    work.discard(per_doc)
    later, early = parts.filter("not original").alias("l"), parts.filter("original").select("k1", "k2", "data").alias("e")
    equal = later.join(early.hint("merge"), (F.col("l.k1") == F.col("e.k1")) & (F.col("l.k2") == F.col("e.k2")) & (F.col("l.data") == F.col("e.data")))
    gone = work.staged(equal.groupBy("l.doc_id", "l.mark").agg(F.collect_set(F.struct("l.line", "l.lines")).alias("gone")), "line-gone")
    work.discard(parts)
    return gone


def without_lines(text: str, gone: list[dict]) -> tuple[str, int]:
    """The text without these ranges of lines, and how many lines that takes away."""
    lines = text.split("\n")
    for part in gone:
        lines[part["line"] : part["line"] + part["lines"]] = [None] * part["lines"]
    left = [x for x in lines if x is not None]
    return "\n".join(left), len(lines) - len(left)


def _joined(docs: DataFrame) -> DataFrame:
    d, g = docs.withColumn("__mark", F.xxhash64("text")).alias("d"), removals(docs.select("doc_id", "text")).alias("g")
    on = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.__mark") == F.col("g.mark"))
    return d.join(g.hint("merge"), on, "left").select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col("g.gone").alias("__gone"))


def dedupe(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks of lines taken out of ``text``; ``n_chars``, if there, follows it."""
    joined = _joined(docs)
    work.short_batches(docs.sparkSession)

    def cut(batches):
        for batch in batches:
            text, gone = K.ids_of(batch, "text").to_pylist(), K.ids_of(batch, "__gone").to_pylist()
            text = [without_lines(t, g)[0] if g else t for t, g in zip(text, gone, strict=True)]
            at = batch.schema.get_field_index("text")
            out = batch.set_column(at, batch.schema.field(at), pa.array(text, batch.schema.field(at).type))
            yield out.select(docs_columns)

    docs_columns = docs.columns
    out = joined.mapInArrow(cut, docs.schema)
    if "n_chars" in docs_columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed, n_bytes, n_bytes_removed, kept_sha256`` of every row."""
    joined = _joined(docs.select("doc_id", "text"))
    work.short_batches(docs.sparkSession)

    def tell(batches):
        kind = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_lines", "n_removed", "n_bytes", "n_bytes_removed")], ("kept_sha256", pa.string())])
        for batch in batches:
            rows = []
            for text, gone in zip(K.ids_of(batch, "text").to_pylist(), K.ids_of(batch, "__gone").to_pylist(), strict=True):
                text = text or ""
                kept, n = without_lines(text, gone) if gone else (text, 0)
                data, left = text.encode(), kept.encode()
                rows.append((text.count("\n") + 1 if text else 0, n, len(data), len(data) - len(left), hashlib.sha256(left).hexdigest()))
            if rows:
                yield K.record(kind, K.ids_of(batch, "doc_id"), *[list(c) for c in zip(*rows, strict=True)])

    return joined.mapInArrow(tell, "doc_id long, n_lines long, n_removed long, n_bytes long, n_bytes_removed long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(work.columns(work.table(spark, sf_dir, "documents"), doc_id="long", text="string"))

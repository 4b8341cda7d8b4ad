"""Suffix dedup: every byte covered by a 100-byte string that also starts earlier is removed.

Sorting all suffixes would exchange a hundred bytes for each byte of text, so the suffix array is a
sparse one.  Each 100-byte window names an anchor in itself, the leftmost of its 32-byte grams with
the least hash; equal windows name it at the same place.  A run of windows with one anchor is an item.

1. Items meet by the hash of their gram.  An item whose whole stretch of text was seen earlier is
   covered; equal stretches are merged within a task before anything is shuffled, so a group of
   copies sends one item a task.  Grams with a single stretch of text are done.
2. What remains are suffixes, starting at the anchors, around places where copies part.  Each task
   sorts its suffixes into runs and front-codes them; runs are exchanged by gram and combined with a
   loser tree that carries longest common prefixes (``lcpmerge``), so no known prefix is compared
   again.  The merge's own prefix lengths then say which suffixes share how much to the right of the
   anchor, and the bytes to the left decide the rest, window by window.
3. Grams with very many stretches (the edge of a passage that a large part of the corpus holds) go
   by 128-bit hashes of their windows instead, summed before they are shuffled.

Edge cases: a null text is empty; texts under 100 bytes keep all bytes.  Earlier means smaller
doc_id (null first), then, among rows of one doc_id with different texts, smaller hash of the text,
then earlier start.  Rows that repeat doc_id and text are one document.  A very long text is one block
of its own, whole.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import lcpmerge, work

LENGTH = 100
GRAM = 32
_SPREAD = LENGTH - GRAM + 1  # grams of a window
#: Items that a task holds before it merges equal ones.
HELD = 1_000_000
#: Stretches of text for one gram beyond which its windows are hashed.
WIDE = 2048
#: Suffixes of one exchanged part, and of one run.
PART_ITEMS = 60_000
RUN_ITEMS = 200_000

ITEM = "key long, f long, doc long, lo int, pack int"
_ITEM = pa.schema([("key", pa.int64()), ("f", pa.int64()), ("doc", pa.int64()), ("lo", pa.int32()), ("pack", pa.int32())])


def anchors(block: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Items of a block: row, anchor, first and last window start (all in the block), and hashes of gram and stretch."""
    spans = K.Spans(block)
    gram = spans.windows(GRAM)
    n = len(block) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    value, place = (gram >> np.uint64(32)).astype(np.uint32), np.arange(len(gram), dtype=np.int32)
    wide = 1
    while wide < _SPREAD:  # leftmost least gram of the next ``wide`` ones, doubled until it spans a window
        step = min(wide, _SPREAD - wide)
        left, right = value[: len(value) - step], value[step:]
        take = right < left
        value = np.where(take, right, left)
        place = np.where(take, place[step:], place[: len(place) - step])
        wide += step
    place = place[:n]
    inside = np.zeros(n + 1, np.int8)
    full = at[:-1][np.diff(at) >= LENGTH]
    stop = (at[1:] - LENGTH + 1)[np.diff(at) >= LENGTH]
    inside[full] += 1
    inside[stop] -= 1
    inside = np.cumsum(inside[:n]) > 0
    begins = inside.copy()
    begins[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    begins[full] = True
    lo = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= begins[1:] | ~inside[1:]
    hi = np.flatnonzero(ends)
    a = place[lo].astype(np.int64)
    row = np.searchsorted(at, lo, "right") - 1
    return row, a, lo, hi, gram[a], spans.hash(lo, hi + LENGTH)


def _items(batches):
    """Items of each document.  Equal stretches within the task are merged: all but the first leave as covered (pack < 0)."""
    held: list[list[np.ndarray]] = []
    size = 0

    def flush():
        key, f, doc, lo, pack = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((lo, doc, f))
        key, f, doc, lo, pack = key[order], f[order], doc[order], lo[order], pack[order]
        again = np.zeros(len(f), bool)
        again[1:] = (f[1:] == f[:-1]) & (key[1:] == key[:-1])
        pack = np.where(again, -1 - (pack & 0xFF), pack)
        key = np.where(again, K.mix(doc.view(np.uint64) * np.uint64(131) + lo.astype(np.uint64)).view(np.int64), key)
        for i in range(0, len(key), 1 << 16):
            s = slice(i, i + (1 << 16))
            yield K.record(_ITEM, key[s], f[s], doc[s], lo[s], pack[s])

    for batch in batches:
        uid = K.ids_of(batch, "uid").to_numpy()
        data, offsets = K.text_of(batch, "text")
        for first, _, block, at in K.blocks(data, offsets):
            row, a, lo, hi, gram, f = anchors(block, at)
            if len(row):
                held.append([gram.view(np.int64), f.view(np.int64), uid[first + row], lo - at[row], ((a - lo) << 8) | (hi - lo)])
                size += len(row)
        if size > HELD:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


FOUND = "doc long, lo int, hi int, anchor int, gram long"
_FOUND = pa.schema([("doc", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("anchor", pa.int32()), ("gram", pa.int64())])


def _meet(batches):
    """Rows ordered by (key, f, doc, lo): covered windows (anchor -1), and items whose gram has other stretches too."""
    last = None  # key, f of the last row
    first = None  # the first item of the current gram, while it is the only stretch
    for batch in batches:
        key, f, doc, lo, pack = (c.to_numpy() for c in batch.columns)
        done = pack < 0
        if done.any():
            yield K.record(_FOUND, doc[done], lo[done], lo[done] - 1 - pack[done], np.full(int(done.sum()), -1), np.zeros(int(done.sum()), np.int64))
            key, f, doc, lo, pack = (c[~done] for c in (key, f, doc, lo, pack))
        if not len(key):
            continue
        hi, anchor = lo + (pack & 0xFF), lo + (pack >> 8)
        old = np.array([*([last[0]] if last else [key[0] ^ 1]), *key[:-1]])
        new_gram = key != old
        older = np.array([*([last[1]] if last else [f[0] ^ 1]), *f[:-1]])
        again = ~new_gram & (f == older)
        if again.any():
            yield K.record(_FOUND, doc[again], lo[again], hi[again], np.full(int(again.sum()), -1), np.zeros(int(again.sum()), np.int64))
        last = (key[-1], f[-1])
        key, doc, lo, hi, anchor, new_gram = (c[~again] for c in (key, doc, lo, hi, anchor, new_gram))
        if not len(key):
            continue
        # A first stretch counts only once a second one of its gram turns up.
        follow = np.append(~new_gram[1:], False)
        use = ~new_gram | follow
        if not new_gram[0] and first is not None:
            yield K.record(_FOUND, *[[x] for x in first])
        if use.any():
            yield K.record(_FOUND, doc[use], lo[use], hi[use], anchor[use], key[use])
        if new_gram.any():
            first = (doc[-1], lo[-1], hi[-1], anchor[-1], key[-1]) if new_gram[-1] else None
        else:
            first = None


def _texts_with(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(uid, text, parts): the documents that these rows lie in, with the rows of each."""
    lists = found.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi", "anchor", "gram")).alias("parts"))  # no more than its text has anchors
    return docs.join(lists.hint("merge"), F.col("uid") == F.col("doc")).select("uid", "text", "parts")


def _parts_of(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    parts = K.ids_of(batch, "parts")
    flat = parts.flatten()
    row = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
    return row, {n: flat.field(n).to_numpy() for n in ("lo", "hi", "anchor", "gram")}


def _runs(parts: int):
    """Sorted, front-coded runs of the suffixes at anchors, one row for each run and part."""
    kind = pa.schema([("part", pa.int32()), ("run", pa.binary())])

    def run(batches):
        held: list[tuple] = []

        def flush():
            held.sort()
            by_part: dict[int, list[tuple]] = {}
            for item in held:
                by_part.setdefault(item[6] % parts, []).append(item)
            for part, items in by_part.items():
                yield K.record(kind, [part], pa.array([lcpmerge.encode([i[:6] for i in items])], pa.binary()))

        for batch in batches:
            uid = K.ids_of(batch, "uid").to_pylist()
            text = [t.encode() for t in K.ids_of(batch, "text").to_pylist()]
            row, p = _parts_of(batch)
            for r, lo, hi, a, g in zip(row.tolist(), *[p[n].tolist() for n in ("lo", "hi", "anchor", "gram")], strict=True):
                t = text[r]
                held.append((t[a : hi + LENGTH], t[lo:a][::-1], uid[r], a, lo, hi, g))
            if len(held) > RUN_ITEMS:
                yield from flush()
                held = []
        if held:
            yield from flush()

    return run


def _combine(batches):
    """Rows ordered by part: merges the runs of each part and puts out the windows that occur earlier."""
    part, runs = None, []
    for batch in batches:
        for p, run in zip(K.ids_of(batch, "part").to_pylist(), K.ids_of(batch, "run").to_pylist(), strict=True):
            if p != part and runs:
                yield from _covered(lcpmerge.merge(runs))
                runs = []
            part = p
            runs.append(run)
    if runs:
        yield from _covered(lcpmerge.merge(runs))


def _covered(merged):
    out: list[tuple[int, int, int]] = []
    group: list[tuple] = []
    for common, item in merged:
        if common < GRAM and group:
            out.extend(_earlier(group))
            group = []
        group.append((common, item))
        if len(out) > 50_000:
            yield _found(out)
            out = []
    out.extend(_earlier(group))
    if out:
        yield _found(out)


def _found(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    doc, lo, hi = zip(*rows, strict=True)
    return K.record(_FOUND, list(doc), list(lo), list(hi), [-1] * len(rows), [0] * len(rows))


def _earlier(group: list[tuple]) -> list[tuple[int, int, int]]:
    """(doc, lo, hi) of the windows in a group of suffixes with one gram that also start earlier."""
    if len(group) < 2:
        return []
    if len(group) > 64:
        return _earlier_by_window(group)
    n = len(group)
    doc = np.array([g[1][2] for g in group])
    a = np.array([g[1][3] for g in group])
    # To the right: the least common prefix of neighbours in between.
    right = np.full((n, n), LENGTH)
    steps = np.array([g[0] for g in group])
    for i in range(n - 1):
        right[i, i + 1 :] = right[i + 1 :, i] = np.minimum.accumulate(steps[i + 1 :])
    # To the left: equal bytes going away from the anchor.
    reach = np.array([len(g[1][1]) for g in group])
    wide = int(reach.max())
    left = np.zeros((n, n), np.int64)
    if wide:
        rows = np.zeros((n, wide), np.uint8)
        for i, g in enumerate(group):
            rows[i, : reach[i]] = np.frombuffer(g[1][1], np.uint8)
        left = np.minimum.accumulate(rows[:, None, :] == rows[None, :, :], axis=2).sum(2)
        left = np.minimum(left, np.minimum(reach[:, None], reach[None, :]))
    before = (doc[None, :] < doc[:, None]) | ((doc[None, :] == doc[:, None]) & (a[None, :] < a[:, None]))
    back = np.arange(_SPREAD)
    hit = (before[:, :, None] & (left[:, :, None] >= back) & (right[:, :, None] >= LENGTH - back)).any(1)
    out = []
    for i in np.flatnonzero(hit.any(1)):
        lo, hi = group[i][1][4], group[i][1][5]
        starts = np.sort(a[i] - np.flatnonzero(hit[i]))
        starts = starts[(starts >= lo) & (starts <= hi)]
        out.extend(_ranges(int(doc[i]), starts))
    return out


def _ranges(doc: int, starts: np.ndarray) -> list[tuple[int, int, int]]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return [(doc, int(s), int(e)) for s, e in zip(starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)], strict=True)]


def _earlier_by_window(group: list[tuple]) -> list[tuple[int, int, int]]:
    """The same for a large group: its windows are ordered as byte strings, and each is compared with the one before."""
    windows = []
    for _, (suffix, left, doc, a, lo, hi) in group:
        text = left[::-1] + suffix
        windows.extend((text[s - lo : s - lo + LENGTH], doc, s) for s in range(lo, hi + 1))
    windows.sort()
    hits: dict[int, list[int]] = {}
    for one, two in zip(windows, windows[1:], strict=False):
        if one[0] == two[0]:
            hits.setdefault(two[1], []).append(two[2])
    return [r for doc, starts in hits.items() for r in _ranges(doc, np.unique(starts))]


def _hashed_windows(batches):
    """Windows of items with very many stretches, as 128-bit hashes."""
    kind = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("start", pa.int32())])
    for batch in batches:
        uid = K.ids_of(batch, "uid").to_numpy()
        data, offsets = K.text_of(batch, "text")
        row, p = _parts_of(batch)
        for first, end, block, at in K.blocks(data, offsets):
            here = (row >= first) & (row < end)
            lo, hi, r = p["lo"][here].astype(np.int64), p["hi"][here].astype(np.int64), row[here]
            many = hi - lo + 1
            start = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
            s = start + np.repeat(at[r - first], many)
            yield K.record(kind, *[K.Spans(block, seed).hash(s, s + LENGTH).view(np.int64) for seed in (0, 1)], uid[np.repeat(r, many)], start)


def _wide(docs: DataFrame, found: DataFrame) -> DataFrame:
    windows = work.staged(_texts_with(docs, found).mapInArrow(_hashed_windows, "h1 long, h2 long, doc long, start int"), "suffix-windows")
    place = F.struct("doc", "start")
    first = work.staged(windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("h1", "h2", "first"), "suffix-firsts")
    w, f = windows.alias("w"), first.alias("f")
    met = w.join(f, (F.col("w.h1") == F.col("f.h1")) & (F.col("w.h2") == F.col("f.h2"))).filter(F.struct("w.doc", "w.start") != F.col("f.first"))
    out = work.staged(met.select("w.doc", F.col("w.start").alias("lo"), F.col("w.start").alias("hi")), "suffix-wide")
    work.discard(windows, first)
    return out


def _with_uid(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``uid``, a number in the order of (doc_id, hash of the text), equal for equal rows; and each uid once."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.filter("n > 1 or doc_id is null").isEmpty():
        docs = docs.withColumn("uid", F.col("doc_id"))
        return docs, docs
    marked = docs.withColumn("mark", F.xxhash64("text"))
    order = marked.select("doc_id", "mark").distinct().orderBy(F.col("doc_id").asc_nulls_first(), "mark")
    order = work.staged(order.withColumn("uid", F.monotonically_increasing_id()), "suffix-ids")  # rises with the sort, over all partitions
    m, o = marked.alias("m"), order.alias("o")
    joined = m.join(o, F.col("m.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("m.mark") == F.col("o.mark")))
    docs = work.staged(joined.select("m.doc_id", "m.text", "o.uid"), "suffix-docs")
    return docs, work.staged(docs.dropDuplicates(["uid"]), "suffix-once")


def removed_windows(docs: DataFrame) -> DataFrame:
    """(doc, spans): for each document with any, the (lo, hi) ranges of starts of windows that also start earlier; ``docs`` has uid and text."""
    spark = docs.sparkSession
    work.short_batches(spark, 2048)
    texts = docs.select("uid", "text").filter(F.col("text").isNotNull())
    items = texts.mapInArrow(_items, ITEM).repartition("key").sortWithinPartitions("key", "f", "doc", "lo")
    found = work.staged(items.mapInArrow(_meet, FOUND), "suffix-items")
    covered = found.filter("anchor < 0").select("doc", "lo", "hi")
    open_ = found.filter("anchor >= 0")
    sizes = open_.groupBy("gram").agg(F.count("*").alias("n"))
    sizes = work.staged(sizes, "suffix-grams")
    total = sizes.agg(F.sum(F.when(F.col("n") <= WIDE, F.col("n"))).alias("narrow"), F.count(F.when(F.col("n") > WIDE, 1)).alias("wide")).first()
    texts = texts.dropDuplicates(["uid"]) if "uid" not in docs.columns else texts
    if total["wide"]:
        wide = work.staged(sizes.filter(F.col("n") > WIDE).select("gram"), "suffix-wide-grams")
        o, w = open_.alias("o"), wide.alias("w")
        covered = covered.unionByName(_wide(texts, o.join(w, F.col("o.gram") == F.col("w.gram"), "left_semi")))
        open_ = o.join(w, F.col("o.gram") == F.col("w.gram"), "left_anti")
    if total["narrow"]:
        parts = work.parts_for(total["narrow"], PART_ITEMS, work.shuffle_width(spark))
        runs = _texts_with(texts, open_).mapInArrow(_runs(parts), "part int, run binary")
        runs = runs.repartition(parts, "part").sortWithinPartitions("part")
        merged = work.staged(runs.mapInArrow(_combine, FOUND), "suffix-merged")
        covered = covered.unionByName(merged.select("doc", "lo", "hi"))
    spans = covered.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # no more than its text has windows
    return work.staged(spans, "suffix-spans")


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The bytes that no window in ``spans`` covers; bytes removed, and maximal runs of them."""
    edge = np.zeros(len(text) + 1, np.int32)
    s = np.asarray(spans, np.int64).reshape(-1, 2)
    np.add.at(edge, s[:, 0], 1)
    np.add.at(edge, s[:, 1] + LENGTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return kept, int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())


def dedupe(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row; with ``kept`` (the remaining bytes) if asked for."""
    docs, once = _with_uid(docs.select("doc_id", "text"))
    spans = removed_windows(once)
    work.short_batches(docs.sparkSession)
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_text)

    def tell(batches):
        for batch in batches:
            rows = []
            parts = K.ids_of(batch, "spans")
            at, flat = parts.offsets.to_numpy(), parts.flatten()
            lo, hi = (flat.field(n).to_numpy() for n in ("lo", "hi"))
            at = at - at[0] if len(at) else at
            for i, text in enumerate(K.ids_of(batch, "text")):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                kept, gone, runs = (data, 0, 0) if at[i] == at[i + 1] else cut(data, np.stack([lo[at[i] : at[i + 1]], hi[at[i] : at[i + 1]]], 1))
                rows.append((len(data), gone, runs, hashlib.sha256(kept).hexdigest(), kept)[: 4 + with_text])
            if rows:
                yield K.record(kind, K.ids_of(batch, "doc_id"), *[list(c) for c in zip(*rows, strict=True)])

    joined = docs.join(spans.hint("merge"), F.col("uid") == F.col("doc"), "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int>>")).alias("spans"))
    return joined.mapInArrow(tell, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(work.columns(work.table(spark, sf_dir, "documents"), doc_id="long", text="string"))


#: Every window as hex text, ranked among equal ones; runs of removed bytes are islands of starts at most LENGTH apart.
ORACLE = """
with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h, cast(strlen(coalesce(text, '')) as bigint) as n from documents),
w as materialized (select doc_id, s, md5(substr(h, 2 * s + 1, 200)) as k from d, lateral (select unnest(range(0, n - 99)) as s)),
f as (select k, min((doc_id, s)) as first from w group by k having count(*) > 1),
g as (select w.doc_id, w.s from w join f on w.k = f.k where (w.doc_id, w.s) <> f.first),
i as (select doc_id, s, sum(case when p is null or s > p + 100 then 1 else 0 end) over (partition by doc_id order by s) as r
      from (select doc_id, s, lag(s) over (partition by doc_id order by s) as p from g)),
r as (select doc_id, r, min(s) as a, max(s) + 100 as b from i group by doc_id, r),
q as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as p from r),
t as (select d.doc_id, any_value(d.h) as h, count(q.a) as spans, coalesce(sum(q.b - q.a), 0) as gone, max(q.b) as stop,
             string_agg(substr(d.h, 2 * q.p + 1, 2 * (q.a - q.p)), '' order by q.a) as head
      from d left join q on d.doc_id = q.doc_id group by d.doc_id)
select t.doc_id, d.n as n_bytes, cast(gone as bigint) as n_removed, spans as n_spans,
       sha256(unhex(coalesce(head, '') || substr(t.h, 2 * coalesce(stop, 0) + 1))) as kept_sha256
from t join d on t.doc_id = d.doc_id
"""

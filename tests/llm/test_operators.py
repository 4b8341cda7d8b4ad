"""Operators and stages on a small table with nulls, empty and long texts, ties, repeats and clashing columns, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexispark.llm import bitslice, graph, jaccard, langid, linededup, mixing, packing, quality, suffixes, toxicity, warc, work

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(7)
    syllable = {"en": ["the", "and", "ing", "er", "th"], "fr": ["eau", "tion", "le", "ré", "ou"]}
    word = lambda lang: "".join(rng.choice(syllable[lang]) for _ in range(rng.randrange(1, 4)))
    line = lambda lang, n=12: " ".join(word(lang) for _ in range(n)).capitalize() + "."
    rows = []
    passage = "\n".join(line("en", 30) for _ in range(8))
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        text = "\n".join(line(lang) for _ in range(rng.randrange(4, 12)))
        if i % 10 == 4:
            text = text + "\n" + passage + "\n" + line(lang)
        if i % 7 == 3:
            text = "You idiot, you moron. " + text + " Stupid idiot."
        rows.append([i, text, lang, f"src{i % 4}" if i % 5 else None, len(text)])
    near = rows[1][1].split(" ")
    for k in range(6):  # near copies of a document
        w = near[:]
        w[(k * 11) % len(w)] = f"edit{k}"
        rows.append([100 + k, " ".join(w), "en", "src1", 1])
    for k in range(5):  # exact copies
        rows.append([200 + k, rows[2][1], "en", "src2", 1])
    rows += [[300, None, "en", "src1", None], [301, "", None, None, 0], [302, "  \n\t ", "en", "src9", 4], [303, "two words", "en", "src1", 9], [304, "two words", "fr", None, 9]]
    rows += [[305, "12 34 !!", "en", "src3", 8], [306, "\n".join(line("fr", 400) for _ in range(20)), "fr", "src0", 1], [None, "no id here at all, none whatever", "en", "src1", 5]]
    rows += [[307, "same row twice " * 20, "en", "src1", 7]] * 2 + [[308, "repeat " * 300, "en", "src2", 7]]
    return [tuple(r) for r in rows]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return work.staged(spark.createDataFrame(ROWS, COLUMNS).repartition(3), "docs")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(r[0], 0 if r[0] in (305, 308) else 1, int("idiot" in (r[1] or ""))) for r in ROWS if r[0] is not None]
    return spark.createDataFrame([*rows, (None, 1, 1), (5, None, None), (99999, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def crc(i, parts):
    return zlib.crc32(str(i).encode() if i is not None else b"") % parts


def test_language_id(docs, empty):
    model = langid.learn(docs)
    out = langid.identify(docs.withColumn("lang_pred", F.lit(1)), model).collect()
    assert len(out) == len(ROWS)
    truth = {r[0]: r for r in ROWS}
    for r in out:
        assert r["held_out"] == (crc(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1
        text = truth[r["doc_id"]][1]
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        elif r["doc_id"] is not None and r["doc_id"] < 60:
            assert r["lang_pred"] == truth[r["doc_id"]][2]
    assert langid.learn(empty) is None and langid.identify(docs, None).filter("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty, model).count() == 0


def test_language_id_never_reads_held_out_labels(docs):
    wrong = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert langid.learn(wrong).languages == ["en", "fr"]


def test_mixing(docs, empty):
    out = mixing.plan(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((r[0], size(r[1])) for r in ROWS)
    per = defaultdict(int)
    for r in ROWS:
        per[r[3]] += size(r[1])
    order = sorted(per, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([per[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))]), strict=True))
    taken = defaultdict(int)
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == per[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in order)
    again = mixing.plan(docs.repartition(5)).collect()
    key = lambda r: str((r["doc_id"], r["size"], r["source"], r["taken"]))
    assert sorted(map(key, again)) == sorted(map(key, out))
    assert mixing.plan(empty).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r["doc_id"]] += size(r["text"])
    want = defaultdict(int)
    for r in out:
        want[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in words.items() if k != 307} == {k: v for k, v in want.items() if v and k != 307}
    texts = {r[0]: r[1] for r in ROWS}
    for r in mixed.collect():
        if size(r["text"]) == size(texts[r["doc_id"]]):
            assert r["text"] == texts[r["doc_id"]] and r["n_chars"] == len(r["text"])


def plain_permutation(n, key):
    """The blocks 0..n-1 in the order of a keyed four-round Feistel network, by Python integers alone."""
    word = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & word
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & word
        return x ^ x >> 31

    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    keys = [mix((i * 0x9E3779B97F4A7C15 + key) & word) for i in range(1, 5)]

    def once(x):
        left, right = x >> half, x & (1 << half) - 1
        for k in keys:
            left, right = right, left ^ (mix(right + k & word) & (1 << half) - 1)
        return left << half | right

    out = []
    for x in range(n):
        x = once(x)
        while x >= n:
            x = once(x)
        out.append(x)
    return out


def test_mixing_against_brute_force(spark, docs):
    streams, sources, _ = mixing._streams(docs.select("doc_id", "source", "text"))
    rows = streams.collect()
    taken = Counter()
    for i, source in enumerate(sources):
        own = sorted((r["offset"], r["size"]) for r in rows if r["s"] == i)
        ends = [0, *(o + n for o, n in own)]
        assert [o for o, n in own if n] == [e for e, (_, n) in zip(ends, own, strict=False) if n] and ends[-1] == source.size
        times, left, blocks, turn = [0] * source.size, math.floor(source.target), -(-source.size // 512), 0
        while left and source.size:
            for block in plain_permutation(blocks, source.key + 1_000_003 * turn):
                take = min(left, 512, source.size - 512 * block)
                times[512 * block : 512 * block + take] = [n + 1 for n in times[512 * block : 512 * block + take]]
                left -= take
            turn += 1
        for r in rows:
            if r["s"] == i:
                taken[(r["doc_id"], r["source"], r["size"], sum(times[r["offset"] : r["offset"] + r["size"]]))] += 1
    assert Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in mixing.plan(docs).collect()) == taken


def test_mixing_draws_every_slot_once(spark):
    sources = [mixing.Source(f"s{i}", n, t, 17 * i, 4) for i, (n, t) in enumerate([(4003, 7000.5), (12_001, 12_001), (9, 4.0), (0, 0.0)])]
    drawn = mixing.draw(spark, sources)
    rows = drawn.collect()
    per, shards = Counter((r["s"], r["turn"], r["block"]) for r in rows), Counter(r["shard"] for r in rows)
    assert max(per.values()) == 1 and Counter(s for s, _, _ in per) == {i: s.slots()[0] for i, s in enumerate(sources) if s.size}
    assert [shards[i] for i in range(len(shards) - 1)] == [1024] * (len(shards) - 1) and len(shards) > 3
    counts = [[sum(r["s"] == i and r["shard"] == k for r in rows) for i in range(4)] for k in range(len(shards) - 1)]
    total = len(rows)
    assert all(abs(n - 1024 * sources[i].slots()[0] / total) < 160 for c in counts for i, n in enumerate(c))  # five deviations of a multinomial at most
    assert drawn.rdd.getNumPartitions() >= 4


def shingles(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute_components(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i in range(len(sets)):
        groups[root(i)].append(sets[i][0])
    name = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return Counter((sets[i][0], len(sets[i][1]), name[root(i)] if sets[i][1] else sets[i][0]) for i in range(len(sets)))


def test_jaccard(docs, empty):
    clash = docs.withColumns({"k": F.lit(1), "token": F.lit("x"), "mark": F.lit(0), "n": F.lit(2)})
    out = jaccard.components(clash).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_components(ROWS)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = {r[2] for r in brute_components(ROWS) if r[1]}
    ids = Counter(r["doc_id"] for r in kept.collect() if shingles(r["text"]))
    assert set(ids) == groups and max(ids.values()) == 1
    assert {r["doc_id"] for r in kept.collect() if not shingles(r["text"])} == {300, 301, 302}
    assert jaccard.components(empty).count() == 0 and jaccard.one_of_each(empty).count() == 0


@pytest.mark.parametrize(("seed", "tile"), [(1, jaccard.TILE), (2, 7)])
def test_jaccard_near_the_threshold(spark, seed, tile, monkeypatch):
    """Chains of edits around 75 %, frequent passages and hot groups, in one tile or many: nothing is lost and nothing invented."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = random.Random(seed)
    w = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, rows = w(30), []
    for g in range(4):
        base = w(60)
        for _ in range(14):
            t = base[:]
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(t)))
            base = t if rng.random() < 0.5 else base
    rows += [(len(rows) + i, " ".join(w(rng.randrange(5, 60)) + passage + w(5))) for i in range(30)]
    out = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_components(rows)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(-5, -9), (7, 7)]
    out = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(21)} | {100 + i: 100 for i in range(30)} | {-5: -9, -9: -9}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bit_sliced_search(spark):
    import numpy as np

    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, 0.0]) for _ in range(6)], i) for i in range(120)]
    rows += [(120, None, 0), (140, [0.1, None, 0.0, 0.0, 0.0, 0.0], 0), (160, [float("nan")] * 6, 0), (180, [float("inf")] * 6, 0), (200, [], 0), (41, rows[40][1], 9), (None, rows[40][1], 9), (220, [0.5] * 5, 0)]
    rows += [(40, rows[40][1], 1), (40, rows[41][1], 1), (60, [3e7, -3e7, 0.5, 1.0, 0.0, 3e6], 1), (61, [3e7, 3e7, 0.5, 1.0, 0.0, 3e6], 1), (62, [3e7, -3e7, 0.5, 1.0, 0.0, 3e6], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3)
    out = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in bitslice.top_k(df).collect())
    q = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v and len(v) == 6 and not any(x is None or not math.isfinite(x) for x in v)]
    want = []
    for at, (i, a) in enumerate(q):
        if i % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for other, (j, b) in enumerate(q) if other != at)[:20]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert out == sorted(want) and max(w[3] for w in want) > 1 << 62
    assert bitslice.top_k(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in bitslice.top_k(huge).orderBy("rank").collect()] == [(1, (1 << 63) - 1), (2, -(1 << 63))]


def test_warc(spark, tmp_path):
    big = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 20
    rows = [(3, "http://a/ b\r\nX: y", big, 0), (1, None, big, 0), (2, "http://c", "small", 0), (4, "http://d", "small", 0), (5, "http://e", None, 0), (6, "http://f", "", 0), (7, "http://g", "x" * 100, 0), (8, "http://h", "x" * 100, 0), (8, "http://h", "x" * 100, 0), (None, "u", "y" * 200, 0)]
    rows += [(20 + i, u, "z" * 150, 0) for i, u in enumerate(["a b", "a\nb", "a%20b", "a+b c\x7f\x00é", "none", "about:blank", "", "a\r\nX-Exact-URL: none"])]
    rows += [(None, "v", "y" * 200, 0), (40, "http://long", "w" * 70_000, 0), (41, "http://longer", "v" * (5 << 20), 0), (42, "http://longer", "v" * (5 << 20), 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(2)
    path = work.fresh_path(spark, "warc-test")
    warc.write_archive(pages, path)
    out = Counter(tuple(r) for r in warc.read_archive(spark, path).collect())
    want = Counter()
    for i, _, html, _ in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == data and r[0] is not None]
        first = min(same, default=None)
        again = len(data) >= 100 and i != first
        want[(i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None)] += 1
    assert out == want
    store = warc.stored_payloads(spark, path)
    assert sorted(r["digest"] for r in store.select("digest").collect()) == sorted({hashlib.sha256((r[2] or "").encode()).hexdigest() for r in rows})  # each once
    back = warc.reconstruct(spark, path).collect()
    assert Counter((r["page_id"], r["url"]) for r in back) == Counter((r[0], r[1]) for r in rows)
    for r in back:
        (head, block), = warc.records(bytes(r["record"]))
        http, payload = block.split(b"\r\n\r\n", 1)
        html, = {(x[2] or "").encode() for x in rows if x[:2] == (r["page_id"], r["url"])}
        assert payload == (html if r["record_type"] == "response" else b"") and f"Content-Length: {len(html)}".encode() in http
        assert head.count(b"\r\nWARC-Target-URI: ") == 1 and head.count(b"\r\n\r\n") == 1
    with pytest.raises(ValueError):
        list(warc.records(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\n\r\n"))
    none = work.fresh_path(spark, "warc-none")
    warc.write_archive(pages.limit(0), none)
    assert warc.read_archive(spark, none).count() == 0


def brute_suffixes(rows):
    ordered = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    seen, out = set(), {}
    for _, i, t in ordered:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[(i, t)] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("wide", [2, 2048])
def test_suffix_dedup(docs, empty, monkeypatch, wide):
    monkeypatch.setattr(suffixes, "WIDE", wide)
    rows = [r for r in ROWS if r[0] is not None]
    want = brute_suffixes(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for df in (docs.filter("doc_id is not null and doc_id <> 307"), docs.filter("doc_id is not null").withColumn("uid", F.lit(3))):
        out = suffixes.dedupe(df).collect()
        assert {(r["doc_id"]): tuple(r)[1:] for r in out} == {i: want[(i, texts[i])] for i in {r["doc_id"] for r in out}}
    if wide > 2:
        assert suffixes.dedupe(docs).count() == len(ROWS) and suffixes.dedupe(empty).count() == 0


def test_suffix_groups_of_many(spark):
    """One passage in many documents, with other text on both sides, and long repeats within a document."""
    rng = random.Random(9)
    w = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = w(170)
    rows = [(i, w(rng.randrange(0, 200)) + passage[rng.randrange(30) : 170 - rng.randrange(30)] + w(rng.randrange(0, 150))) for i in range(90)]
    rows += [(200, "ab" * 300), (201, "ab" * 150), (202, passage * 2)]
    out = suffixes.dedupe(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = brute_suffixes(rows)
    assert {r["doc_id"]: tuple(r)[1:] for r in out} == {i: want[(i, t)] for i, t in rows}


def test_packing(docs, empty):
    out = packing.pack(docs, with_ids=True).collect()
    tokenizer = packing.WordIds(packing.tokenizer_file()).tokenizer
    ids = defaultdict(list)
    for i, t, *_ in ROWS:
        ids[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    import numpy as np

    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        whole = ids[r["doc_id"]][0]
        assert r["doc_tokens"] == len(whole) and list(r["ids"]) == whole[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == {i: sum(map(len, v)) for i, v in ids.items()}
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
        total = sum(n for _, n in parts)
        assert total <= 2048 and total & (total - 1) == 0
    assert packing.pack(empty).count() == 0


def test_packing_puts_neighbours_together():
    import numpy as np

    words = [np.array(w) for w in ([1, 2, 3, 9], [4, 5, 6], [1, 2, 3], [4, 5, 6, 8])]
    index = packing.Index([*words, *[np.array([100 + i]) for i in range(20)]], np.ones(200), 4.0)
    left = np.ones(24)
    assert index.neighbours(0, left).tolist() == [2] and index.neighbours(1, left).tolist() == [3] and index.neighbours(5, left).tolist() == []
    left[2] = 0
    assert index.neighbours(0, left).tolist() == []


def test_packing_deals_near_copies_to_one_shard(spark, monkeypatch):
    rng = random.Random(9)
    texts = [[f"w{rng.randrange(3000)}" for _ in range(80)] for _ in range(200)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    for i, w in enumerate(texts):  # a near copy of each
        w[rng.randrange(80)] = "edited"
        rows.append((1000 + i, " ".join(w)))
    rows += [(5000 + i, "the very same text " * 20) for i in range(300)] + [(7000 + i, None) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(packing, "SHARD_BYTES", 10_000)
    out = packing.pack(docs).collect()
    shard = defaultdict(set)
    for r in out:
        shard[r["doc_id"]].add(r["sequence_id"] >> 32)
    assert set(shard) == {r[0] for r in rows} and all(len(x) == 1 for x in shard.values())
    assert sum(shard[i] == shard[1000 + i] for i in range(200)) > 170
    size = Counter()
    for i, t in rows:
        size[min(shard[i])] += len(t or "") + 8
    assert len(size) > 15 and max(size.values()) < 20_000  # one shard does not take all copies
    again = packing.pack(docs.repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))


def test_packing_asks_for_every_word():
    import numpy as np

    rng = np.random.default_rng(4)
    group = np.arange(40)
    words = [group] * 20 + [np.append(group[:30], 50 + i) for i in range(10)]  # copies and near copies: every word is in most documents
    words += [np.array([100 + i, 101 + i, *rng.choice(np.arange(200, 260), 30, replace=False)]) for i in range(8)]
    idf, mean = rng.uniform(0.1, 2, 400), 20.0

    def score(q, d):
        return sum(idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(q.tolist()) if (n := d.tolist().count(t)))

    index = packing.Index(words, idf, mean)
    for seed, q in enumerate(words):
        want = {i: score(q, d) for i, d in enumerate(words) if i != seed and set(q.tolist()) & set(d.tolist())}
        got = index.neighbours(seed, np.ones(len(words))).tolist()
        assert set(got) == set(want) and all(want[a] >= want[b] - 1e-9 for a, b in zip(got, got[1:], strict=False))


def brute_windows(rows, tokenizer, window=2048):
    """Greedy BM25 windows of one shard, from texts alone: {doc_id: [(start, length, sequence, offset)]}."""
    import numpy as np

    from lexispark.llm import kernels

    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    bags = [Counter(WORD.findall(lower(t or ""))) for _, t in rows]
    bucket = lambda w: int(packing.bucket_of(kernels.Spans(np.frombuffer(w.encode(), np.uint8)).hash(np.array([0]), np.array([len(w.encode())])))[0])
    hashed = {w: bucket(w) for b in bags for w in b}
    df = Counter(x for b in bags for x in {hashed[w] for w in b})
    mean, n = sum(sum(b.values()) for b in bags) / len(bags), len(bags)
    idf = {w: math.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) for w, x in hashed.items()}
    score = lambda q, d: sum(idf[w] * d[w] * 2.2 / (d[w] + 1.2 * (0.25 + 0.75 * sum(d.values()) / mean)) for w in q if w in d)
    left = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows]
    start, out, sequence = [0] * n, defaultdict(list), 0

    def put(i, length, offset):
        out[rows[i][0]].append((start[i], length, sequence, offset))
        start[i] += length
        left[i] -= length

    for i in range(n):
        while left[i] >= window:
            put(i, window, 0)
            sequence += 1
    seed = None
    while sum(left) >= window:
        seed = seed if seed is not None and left[seed] else next(i for i in range(n) if left[i])
        ranked = sorted((i for i in range(n) if i != seed and left[i] and score(bags[seed], bags[i]) > 0), key=lambda i: (-round(score(bags[seed], bags[i]), 9), i))
        free, last = window, seed
        for i in [seed, *ranked, *range(n)]:
            if free and left[i]:
                take, last = min(free, left[i]), i
                put(i, take, window - free)
                free -= take
        sequence, seed = sequence + 1, last
    return out


def test_packing_against_brute_force_windows(spark):
    import numpy as np

    rng = np.random.default_rng(12)
    common, rare = [f"common{i}" for i in range(60)], [f"topic{i}" for i in range(900)]
    texts = []
    for _ in range(160):
        topic = rng.integers(0, 850)
        texts.append(" ".join([*rng.choice(common, rng.integers(5, 120)), *rng.choice(rare[topic : topic + 50], rng.integers(5, 90))]))
    texts += [" ".join(rng.choice(rare, 2500)), None, "", texts[3], texts[3].upper()]
    rows = list(enumerate(texts))
    want = brute_windows(rows, packing.WordIds(packing.tokenizer_file()).tokenizer)
    got, last = defaultdict(list), max(q for p in want.values() for *_, q, _ in p)
    for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        if r["sequence_id"] <= last:  # the rest is the last, partly filled window
            got[r["doc_id"]].append((r["start"], r["length"], r["sequence_id"], r["offset"]))
    assert last > 10 and {i: sorted(p) for i, p in got.items()} == {i: sorted(p) for i, p in want.items()}


def test_toxicity(docs, labels, empty):
    model = toxicity.learn(docs, labels)
    out = toxicity.score(docs.withColumn("score", F.lit(5)), model).collect()
    assert len(out) == len(ROWS)
    bad = {r[0] for r in ROWS if "idiot" in (r[1] or "")}
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (crc(r["doc_id"], 5) == 0)
        if r["doc_id"] is not None and r["doc_id"] < 60:
            assert r["predicted"] == (r["doc_id"] in bad)
    left = toxicity.rejected(docs, model)
    assert left.columns == docs.columns and not {r["doc_id"] for r in left.collect()} & {i for i in bad if i < 60}
    none = toxicity.learn(docs, labels.filter("toxic = 0"))
    assert toxicity.score(docs, none).filter("score <> 0").count() == 0 and toxicity.score(empty, none).count() == 0
    assert toxicity.learn(empty, labels).trees is None


def test_quality(docs, labels, empty):
    model = quality.learn(docs, labels)
    out = quality.judge(docs.withColumn("kept", F.lit("x")), model).collect()
    assert len(out) == len(ROWS)
    truth = {r[0]: r[1] or "" for r in ROWS}
    for r in out:
        words = WORD.findall(truth[r["doc_id"]])
        assert r["n_words"] == len(words) and r["base_failed"] == (len(words) < 50 or 100 * r["n_repeat_words"] > 50 * len(words))
        assert r["kept"] == (not r["base_failed"] and r["score"] >= model.threshold)
    assert not next(r for r in out if r["doc_id"] == 308)["kept"] and sum(r["kept"] for r in out) > 40
    plain = quality.learn(docs, labels.limit(0))
    assert quality.judge(docs, plain).filter("kept = base_failed").count() == 0
    assert quality.judge(empty, plain).count() == 0 and quality.learn(empty, labels).threshold == -float("inf")


def test_toxicity_scores_are_rates_beyond_the_sample_bound(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(30))) for i in range(1500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1500)], "doc_id long, toxic int")  # one in ten, whatever the text
    mean = toxicity.score(docs, toxicity.learn(docs, labels, rows=80)).agg(F.avg("score")).first()[0]
    assert 0.03 < mean < 0.25


def brute_lines(rows):
    import numpy as np

    seen, out = {}, {}
    for i, t in sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = np.frombuffer(t.encode(), np.uint8)
        c = linededup.chunks(b, np.array([0, len(b)]))
        gone = []
        for line, n, s, z in zip(c["line"], c["lines"], c["start"], c["size"], strict=True):
            data = b[s : s + z].tobytes()
            assert data.decode() == "\n".join(t.split("\n")[line : line + n])
            if data in seen:
                gone.append({"line": int(line), "lines": int(n)})
            seen.setdefault(data, (i, line))
        out[i] = linededup.without_lines(t, gone)
    return out


def test_line_dedup(docs, empty):
    want = brute_lines(ROWS)
    out = linededup.report(docs.withColumns({"gone": F.lit(1), "line": F.lit(2)})).collect()
    assert len(out) == len(ROWS) and sum(r["n_removed"] for r in out) > 20
    for r in out:
        kept, n = want[r["doc_id"]]
        assert r["n_removed"] == n and r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    texts = {r[0]: r[1] for r in ROWS}
    left = linededup.dedupe(docs)
    assert left.columns == docs.columns
    for r in left.collect():
        assert r["text"] == (want[r["doc_id"]][0] if texts[r["doc_id"]] is not None else None)
        assert r["n_chars"] == (len(r["text"]) if r["text"] is not None else None)
    assert linededup.report(empty).count() == 0


def test_line_dedup_of_planted_passages(spark):
    rng = random.Random(3)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(rng.randrange(4, 12)))
    passages = [[line() for _ in range(n)] for n in (2, 3, 4, 7, 20) for _ in range(8)]
    rows, want = [], {}
    for i, p in enumerate(passages):
        rows.append((i, "\n".join([line(), *p, line()])))
        want[i] = rows[-1][1]
    for i, p in enumerate(passages):  # the passage elsewhere, and a copy of the whole text
        own = [line() for _ in range(1 + i % 3)]
        rows += [(100 + i, "\n".join([*own, *p, line()])), (300 + i, rows[i][1])]
        want |= {100 + i: "\n".join([*own, rows[-2][1].split("\n")[-1]]), 300 + i: ""}
    spaced = [line(), "", line(), "", line()]
    rows += [(500, "\n".join(spaced)), (501, "\n".join(["new here", *spaced, "and here"]))]
    want |= {500: rows[-2][1], 501: "new here\nand here"}
    rows += [(502, "x\ny\n" + line()), (503, "x\ny\n" + line()), (504, "short\nlist " * 2), (505, passages[0][0])]  # too few words or lines to be a chunk
    want |= {i: t for i, t in rows[-4:]}
    left = linededup.dedupe(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r["doc_id"]: r["text"] for r in left.collect()} == want


def test_line_dedup_of_texts_under_one_id(spark):
    passage = "\n".join(f"line {i} of a passage that two texts share" for i in range(4))
    rows = [(i, f"{passage}\nend {k} of {i}") for i in (None, 7) for k in (0, 1)]
    left = [r["text"] for r in linededup.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(passage in t for t in left) == [False, False, False, True] and sorted(t.split("\n")[-1] for t in left) == sorted(t.split("\n")[-1] for _, t in rows)


def test_pipeline_stages(spark, docs, labels, tmp_path):
    where = str(tmp_path)
    docs.withColumn("extra", F.lit(1)).write.parquet(f"{where}/documents.parquet")
    labels.write.parquet(f"{where}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "mixing", "packing"]
    now, columns = spark.read.parquet(f"{where}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now.select(columns).collect()
        now = work.staged(stage(spark, now, where), name)
        after = now.collect()
        assert now.columns == columns
        if name == "toxicity":
            bad = {r["doc_id"] for r in before if "idiot" in (r["text"] or "")}
            assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} <= bad and not {i for i in bad if i < 60} & {r["doc_id"] for r in after}
        if name == "line_dedup":
            want = brute_lines([(r["doc_id"], r["text"]) for r in before])
            assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in before)
            assert all((r["text"] or "") == want[r["doc_id"]][0] for r in after)
        if name == "near_duplicates":
            want = brute_components([(r["doc_id"], r["text"]) for r in before])
            assert {r["doc_id"] for r in after} == {c if n else i for i, n, c in want}
        if name == "mixing":
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} and sum(len(WORD.findall(r["text"])) for r in after) > 0
    last = corpus_pipeline.STAGES[-1][1](spark, now, where).collect()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in now.collect()}
    run = corpus_pipeline.run(spark, where).collect()
    key = lambda r: (str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, run)) == sorted(map(key, last))


def test_stages_take_an_empty_table(spark, empty, labels, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""Language ID, toxicity and quality against plain versions written from their definitions, without the engine's kernels."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.llm import langid, quality, toxicity
from lexispark.llm.boosting import Isotonic, Trees


def packed(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


# --- language ID -------------------------------------------------------------------------------------


class PlainPpm:
    """PPM method C with exclusion, one byte at a time; ``None`` stands before the start of a text."""

    def __init__(self, texts, alphabet):
        self.size = len(alphabet) + 2  # the start and any byte never seen
        self.counts = defaultdict(Counter)
        for t in texts:
            past = (None, None, None, *t)
            for i, b in enumerate(t):
                for k in range(4):
                    self.counts[past[i + 3 - k : i + 3]][b] += 1

    def probability(self, context, byte):
        seen = self.counts.get(context)
        if seen is None:
            return self.probability(context[1:], byte) if context else 1 / self.size
        n, q = sum(seen.values()), len(seen)
        if byte in seen:
            return seen[byte] / (n + q)
        lower = (lambda b: self.probability(context[1:], b)) if context else (lambda b: 1 / self.size)
        return q / (n + q) * lower(byte) / (1 - sum(lower(b) for b in seen))

    def bits(self, text):
        past = (None, None, None, *text)
        return -sum(math.log2(self.probability(past[i : i + 3], b)) for i, b in enumerate(text))


def test_code_lengths_are_those_of_plain_ppm():
    rng = random.Random(11)
    syllables = {"x": ["la", "mi", "so ", "ré"], "y": ["ka", "to", "shi ", "n"]}
    texts = {lang: ["".join(rng.choice(s) for _ in range(40)).encode() for _ in range(6)] for lang, s in syllables.items()}
    batch = pa.RecordBatch.from_arrays(
        [pa.array([lang for lang in texts for _ in texts[lang]]), pa.array([t.decode() for lang in texts for t in texts[lang]])], ["lang", "text"]
    )
    parts = list(langid._count_grams([batch]))
    lang, code, n = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in range(3))
    model = langid.freeze(lang.astype(object), code, n)
    alphabet = {b for own in texts.values() for t in own for b in t}
    plain = [PlainPpm(texts[name], alphabet) for name in model.languages]
    asked = ["la mi so ré", "katoshi n", "somiré toka", "l", "rérérérérérérérérérér"]
    got = langid.code_lengths(model, *packed(asked))
    want = [[p.bits(t.encode()) for p in plain] for t in asked]
    assert np.allclose(got, want, rtol=1e-4)


# --- toxicity ----------------------------------------------------------------------------------------

LEXICON, PERSON = ["idiot", "scum", "fool"], ["you", "tu"]
LETTERS, ODD = rb"[A-Za-z\x80-\xff]", rb"[0134578@$*!#%&_]"
UNDO = bytes.maketrans(b"013457@$!", b"oieastasi")


def plain_features(text):
    data = text.encode()
    lower = data.lower()  # of bytes: A-Z only
    found = list(re.finditer(LETTERS + rb"+", data))
    words = [lower[m.start() : m.end()].decode("utf-8", "replace") for m in found]
    raw = [m.group() for m in found]
    n, per, size = len(words), max(len(words), 1), max(len(data), 1)
    hits = [i for i, w in enumerate(words) if w in LEXICON]
    you = [i for i, w in enumerate(words) if w in PERSON]
    gaps = [min([50, *(abs(i - y) for y in you)]) for i in hits]
    odd = 0
    plain = len(hits)
    for m in re.finditer(rb"(?:" + LETTERS + rb"|" + ODD + rb")+", data):
        run = m.group()
        signs = len(re.findall(ODD, run))
        ends = bool(re.match(ODD, run)) + bool(re.match(ODD, run[-1:]))
        if signs and re.search(LETTERS, run) and signs > ends:
            odd += 1
            plain += run.lower().translate(UNDO).decode("utf-8", "replace") in LEXICON
    tripled = sum(lower[i] == lower[i - 1] == lower[i - 2] and bool(re.match(LETTERS, data[i : i + 1])) for i in range(2, len(data)))
    share = lambda pattern: len(re.findall(pattern, data)) / size
    return {
        "log_words": math.log1p(n), "hits_per_word": len(hits) / per, "log_hits": math.log1p(len(hits)),
        "top_density": max([sum(i <= h < i + 50 for h in hits) for i in hits], default=0), "hit_kinds": len({words[i] for i in hits}),
        "plain_hits_per_word": plain / per, "plain_log_hits": math.log1p(plain), "second_person": len(you) / per,
        "near_hits": sum(g <= 6 for g in gaps) / per, "nearest": min(gaps, default=50), "capitals": share(rb"[A-Z]"),
        "capital_words": sum(len(w) > 1 and bool(re.fullmatch(rb"[A-Z]+", w)) for w in raw) / per, "marks": share(rb"[!?]"),
        "punctuation": share(rb"[!-/:-@\[-`{-~]"), "digits": share(rb"[0-9]"), "odd_words": odd / per, "tripled": tripled / size,
        "word_length": len(re.findall(LETTERS, data)) / per, "hits_first_tenth": sum(i < max(n // 10, 1) for i in hits) / per,
    }


PIECES = ["you ", "IDIOT ", "1d1ot", "sc*m ", "fool", "the ", "é", "aaa", "!", "? ", "7", "$", "_", "\n", "tu ", "Fool. ", "scum ", "W0RD "]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=90).map("".join), min_size=1, max_size=5))
def test_features_by_hand(texts):
    got = toxicity.features(*packed(texts), toxicity.Members(toxicity.word_hashes(LEXICON)), toxicity.Members(toxicity.word_hashes(PERSON)))
    for row, t in zip(got, texts, strict=True):
        assert dict(zip(toxicity.FEATURES, row.tolist(), strict=True)) == pytest.approx(plain_features(t))


def test_every_split_has_the_greatest_gain():
    rng = np.random.default_rng(4)
    x, weight = rng.normal(size=(300, 3)).round(1), rng.uniform(0.5, 2, 300)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=300) * 0.3) > 0).astype(float)
    t = Trees(rounds=3, depth=2, bins=8).fit(x, y, weight)
    share = (weight * y).sum() / weight.sum()
    raw = np.full(300, math.log(share / (1 - share)))
    for r in range(3):
        p = 1 / (1 + np.exp(-raw))
        g, h = weight * (y - p), weight * p * (1 - p)
        gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        parts = {(): np.ones(300, bool)}
        for level in range(2):
            for path, here in [item for item in parts.items() if len(item[0]) == level]:
                at = 2**level - 1 + int("0" + "".join(map(str, path)), 2)
                tried = {}
                for j in range(3):
                    for c, cut in enumerate(t.cuts[j]):
                        left, right = here & (x[:, j] < cut), here & (x[:, j] >= cut)
                        if h[left].sum() >= 1 and h[right].sum() >= 1:
                            tried[j, c] = gain(left) + gain(right) - gain(here)
                chosen = (int(t.feature[r, at]), int(t.cut[r, at]))
                if max(tried.values(), default=0) > 1e-6:
                    assert tried[chosen] == pytest.approx(max(tried.values()))
                    beyond = x[:, chosen[0]] >= t.cuts[chosen[0]][chosen[1]]
                else:
                    beyond = np.zeros(300, bool)
                parts[(*path, 0)], parts[(*path, 1)] = here & ~beyond, here & beyond
        for path, here in parts.items():
            if len(path) == 2 and here.any():
                leaf = t.rate * g[here].sum() / (h[here].sum() + 1)
                assert t.leaf[r, path[0] * 2 + path[1]] == pytest.approx(leaf)
                raw[here] += leaf
    assert np.allclose(t.raw(x), raw)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(4, 9)), min_size=1, max_size=14))
def test_calibration_is_the_minimax_of_means(rows):
    y, weight = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    curve = Isotonic().fit(np.arange(len(y), dtype=float), y, weight)
    mean = lambda j, k: np.average(y[j:k], weights=weight[j:k])
    want = [max(min(mean(j, k) for k in range(i + 1, len(y) + 1)) for j in range(i + 1)) for i in range(len(y))]
    assert sorted(set(np.round(curve.y, 9))) == sorted(set(np.round(want, 9)))


# --- quality -----------------------------------------------------------------------------------------


def buckets(text):
    data = (text or "").encode()
    return [(int.from_bytes(data[i : i + 4], "big") * 0x9E3779B1 % 2**32) >> 14 for i in range(len(data) - 3)]


def test_quality_verdicts_by_hand(spark):
    rng = random.Random(9)
    good, poor = ["the river", "of stone", "runs along", "a quiet", "meadow and"], ["buy now", "cl1ck", "free $$$", "winner", "zzz qq"]
    text = lambda pool, n: " ".join(rng.choice(pool) + rng.choice("abcdefghij") for _ in range(n))
    rows = [(i, text(good if i % 4 else poor, rng.choice([10, 60, 90]))) for i in range(80)]
    rows += [(80, None), (81, ""), (82, "abc"), (None, text(good, 70)), (3, text(poor, 60)), rows[5]]
    marks = [(i, int(i % 4 != 0)) for i in range(0, 80, 2)] + [(4, 0), (None, 1), (6, None), (999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    model = quality.learn(docs, labels)

    verdict = defaultdict(list)
    for i, q in marks:
        if i is not None and q is not None:
            verdict[i].append(q)
    trusted = {i: min(q) >= 1 for i, q in verdict.items()}
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(buckets(t))
        if trusted.get(i):
            target.update(buckets(t))
    n, m, size = sum(raw.values()), sum(target.values()), 2**18

    def ratio(b):
        p = (raw[b] + 0.5) / (n + 0.5 * size)
        return math.log((target[b] + 0.02 * m * p) / (1.02 * m) / p)

    def points(t):
        b = buckets(t)
        return sum(map(ratio, b)) / (len(b) + 40)

    def failed(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        again = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
        return len(words) < 50 or 100 * len(again) > 50 * len(words)

    judged = sorted((points(t), trusted[i]) for i, t in {r for r in rows if r[0] in trusted} if not failed(t))
    assert sum(g for _, g in judged) > 5 and sum(not g for _, g in judged) > 5
    good_n, poor_n = sum(g for _, g in judged), sum(not g for _, g in judged)
    tries = []
    for k in range(len(judged) + 1):  # k of the lowest go
        lost, caught = sum(g for _, g in judged[:k]), sum(not g for _, g in judged[:k])
        if k and lost / good_n <= 1 - quality.KEEP_TRUSTED:
            tries.append((-(caught / poor_n - lost / good_n), k))
    k = min(tries)[1]
    cut = (judged[k - 1][0] + judged[min(k, len(judged) - 1)][0]) / 2
    assert model.threshold == pytest.approx(cut, abs=1e-5)

    out = quality.judge(docs, model).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 4), r["base_failed"], r["kept"]) for r in out)
    want = sorted((i is None, i or 0, round(points(t), 4), failed(t), not failed(t) and points(t) >= cut) for i, t in rows)
    assert [(g[:2], g[3:]) for g in got] == [(w[:2], w[3:]) for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-4)


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """Over 20 000 rows of each label, some doc_ids twice; far too few bits to tell good ids from others before the join."""
    monkeypatch.setattr(quality, "MARK_BITS", 1 << 15, raising=False)
    rng = np.random.default_rng(3)
    ids = np.concatenate([np.arange(47_000), np.arange(300)])
    known, good = ids < 44_000, ids % 2 == 0
    shift = np.where(good, 0, 1)[:, None]
    data = np.full((len(ids), 119), ord(" "), np.uint8)
    data[:, ::2] = ord("a") + shift + rng.integers(0, 20, (len(ids), 60))
    docs = spark.createDataFrame([(int(i), d.tobytes().decode()) for i, d in zip(ids, data, strict=True)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(44_000)], "doc_id long, quality int")
    model = quality.learn(docs, labels)

    wide = data.astype(np.uint32)
    code = (((wide[:, :-3] << 24 | wide[:, 1:-2] << 16 | wide[:, 2:-1] << 8 | wide[:, 3:]) * np.uint32(0x9E3779B1)) >> 14).astype(np.int64)
    raw, target = np.bincount(code.ravel(), minlength=2**18), np.bincount(code[known & good].ravel(), minlength=2**18)
    p = (raw + 0.5) / (raw.sum() + 0.5 * 2**18)
    score = np.log((target + 0.02 * target.sum() * p) / (1.02 * target.sum()) / p)[code].sum(1) / (116 + 40)
    got = sorted((r["doc_id"], r["score"]) for r in quality.judge(docs, model).filter("not base_failed").collect())
    assert len(got) == len(ids)
    assert [s for _, s in got] == pytest.approx([s for _, s in sorted(zip(ids.tolist(), score.tolist(), strict=True))], abs=1e-6)
    order = np.argsort(score[known])
    s, g = score[known][order], good[known][order]
    lost, caught = np.cumsum(g) / g.sum(), np.cumsum(~g) / (~g).sum()
    k = np.argmax(np.where(lost <= 1 - quality.KEEP_TRUSTED, caught - lost, -1))
    assert 0 < np.cumsum(g)[k] and model.threshold == pytest.approx((s[k] + s[k + 1]) / 2, abs=1e-7)


def test_quality_threshold_over_a_table(spark, monkeypatch):
    monkeypatch.setattr(quality, "STRETCH", 40)
    rng = np.random.default_rng(4)
    score, good = np.round(rng.normal(0, 1, 3000), 2), rng.random(3000) < 0.8
    score[good] += 2.5
    for s, g in [(score, good), (score, ~good), (score[good], good[good]), (score[~good], good[~good]), (score * 0 + 1.5, good), (score[:0], good[:0])]:
        judged = spark.createDataFrame(list(zip(s.tolist(), g.tolist(), strict=True)), "score double, good boolean")
        assert quality.fit(judged) == pytest.approx(quality.threshold(s, g), abs=1e-12)


def test_quality_query_gives_the_verdicts_of_learn_and_judge(spark, tmp_path):
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choice("abcdefgh" if i % 3 else "uvwxyz") * 2 for _ in range(rng.choice([10, 80])))) for i in range(150)] + [(7, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 150, 2)], "doc_id long, quality int")
    for name, marked in (("all", labels), ("none", labels.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        marked.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out, want = quality.query(spark, f"{tmp_path}/{name}"), quality.judge(docs, quality.learn(docs, marked))
        assert out.dtypes == want.dtypes
        key = lambda r: (r["doc_id"] is None, r["doc_id"], r["n_words"])
        got = sorted(out.collect(), key=key)
        assert got == sorted(want.collect(), key=key) and len(got) == len(rows)
        assert any(r["kept"] for r in got) and any(not r["kept"] and not r["base_failed"] for r in got) == (name == "all")

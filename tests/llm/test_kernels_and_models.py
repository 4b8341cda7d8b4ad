"""Kernels and models against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.llm import bitslice, jaccard, kernels, langid, lcpmerge, linededup, mixing, packing, quality, suffixes, toxicity
from lexispark.llm.boosting import Isotonic, Trees

TEXTS = ["", "a", "a b  c\td\n", "é è\nà", " lead", "x" * 300, "one two three one two three one two three", "# $ % <b> |", "日本 語"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def packed(texts):
    data = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


texts_strategy = st.lists(st.text(st.sampled_from("ab é\n\t#Ω"), max_size=40), min_size=1, max_size=6)


@settings(max_examples=80, deadline=None)
@given(texts_strategy)
def test_words_and_spans(texts):
    block, at = packed(texts)
    starts, ends, first = kernels.words(block, at)
    got = [[block[s:e].tobytes().decode() for s, e in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)] for i in range(len(texts))]
    assert got == [WORD.findall(t) for t in texts]
    spans = kernels.Spans(block)
    by_hash = {}
    for s, e in zip(starts, ends, strict=True):
        by_hash.setdefault(int(spans.hash(np.array([s]), np.array([e]))[0]), set()).add(block[s:e].tobytes())
    assert all(len(v) == 1 for v in by_hash.values())


def test_text_of_handles_nulls_and_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(["xx", None, "yé", ""])], ["text"]).slice(1)
    data, at = kernels.text_of(batch, "text")
    assert data.tobytes() == "yé".encode() and at.tolist() == [0, 0, 3, 3]
    empty = pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["text"])
    assert kernels.text_of(empty, "text")[1].tolist() == [0]


def base_by_hand(t):
    words = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)]


@settings(max_examples=80, deadline=None)
@given(texts_strategy)
def test_base_counts(texts):
    assert quality.base_counts(*packed(texts)).tolist() == [base_by_hand(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(texts_strategy)
def test_gram_buckets_stay_within_texts(texts):
    code, first = quality.gram_buckets(*packed(texts))
    alone = [quality.gram_buckets(*packed([t]))[0].tolist() for t in texts]
    assert [code[first[i] : first[i + 1]].tolist() for i in range(len(texts))] == alone
    assert [len(a) for a in alone] == [max(0, len(t.encode()) - 3) for t in texts]


def test_quality_threshold():
    good = np.array([True] * 1000 + [False] * 100)
    score = np.concatenate([np.linspace(0.1, 1, 1000), np.linspace(-2, -1, 100)])
    cut = quality.threshold(score, good)
    assert -1 < cut < 0.11
    assert quality.threshold(np.zeros(0), np.zeros(0, bool)) == -np.inf


def test_ppm_code_lengths_by_hand():
    """Frozen probabilities sum to one in every context, and a text's length is the sum over its bytes."""
    rng = random.Random(3)
    texts = {"x": ["".join(rng.choice("ab ") for _ in range(200))], "y": ["".join(rng.choice("cd ") for _ in range(200))]}
    parts = list(langid._count_grams([pa.RecordBatch.from_arrays([pa.array(list(texts)), pa.array([t[0] for t in texts.values()])], ["lang", "text"])]))
    lang, code, n = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in range(3))
    m = langid.freeze(lang.astype(object), code, n)
    p = 2.0 ** -m.bits.reshape(-1, m.size, len(m.languages)).astype(float)
    p[:, m.size - 1, :] *= 256
    assert np.allclose(p.sum(1), 1, atol=1e-3)
    whole = langid.code_lengths(m, *packed(["abba ab", "", "cddc"]))
    assert whole[0].argmin() == 0 and whole[2].argmin() == 1 and (whole[1] == 0).all()
    alone = langid.code_lengths(m, *packed(["abba ab"]))
    assert np.allclose(whole[0], alone[0])


def test_letters():
    assert langid.has_letter(*packed(["", "12 !", "é", "日", "x1", "€"])).tolist() == [False, False, True, True, True, False]


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    t = Trees(rounds=40).fit(x[:1500], y[:1500])
    assert ((t.raw(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.95
    curve = Isotonic().fit(np.arange(6.0), np.array([0, 1, 0, 1, 1, 1.0]))
    out = curve.read(np.linspace(-1, 7, 20))
    assert (np.diff(out) >= 0).all() and 0 <= out.min() and out.max() <= 1


def test_toxic_features_of_odd_texts():
    lexicon, person = toxicity.Members(toxicity.word_hashes(["idiot"])), toxicity.Members(toxicity.word_hashes(["you"]))
    x = toxicity.features(*packed(["", "You IDIOT", "1d1ot you", "the " * 50 + "idiot", "!!!"]), lexicon, person)
    name = toxicity.FEATURES.index
    assert x[:, name("log_hits")].round(3).tolist() == [0, 0.693, 0, 0.693, 0]
    assert x[1, name("nearest")] == 1 and x[3, name("nearest")] == 50 and x[2, name("plain_log_hits")] > 0
    assert np.isfinite(x).all()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    p = mixing.Permutation(n, 99)
    out = p.forward(np.arange(n))
    assert sorted(out.tolist()) == list(range(n)) and all(p.place(b) == out.tolist().index(b) for b in range(0, n, max(1, n // 7)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8))
def test_targets(sizes):
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    out = mixing.targets(sizes, weights)
    assert abs(sum(out) - 1.5 * sum(sizes)) < 1e-6 * max(1, sum(sizes))
    assert all(t <= 2 * s + 1e-9 for t, s in zip(out, sizes, strict=True))
    free = [(t, w) for t, s, w in zip(out, sizes, weights, strict=True) if t < 2 * s - 1e-9]
    assert not free or max(t / w for t, w in free) - min(t / w for t, w in free) < 1e-6 * max(1, sum(sizes))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.floats(0, 2))
def test_slots_take_the_target(size, share):
    s = mixing.Source("x", size, share * size, 5, 64)
    n, last = s.slots()
    taken = 0
    for slot in range(n):
        block = int(s.permutation(slot // s.blocks).forward(np.array([slot % s.blocks]))[0])
        length = min(64, size - 64 * block)
        taken += min(length, last) if slot == n - 1 else length
    assert taken == int(share * size)


def sets_by_hand(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abA "), max_size=60), min_size=1, max_size=6))
def test_shingle_sets(texts):
    sets = jaccard.Sets(*packed(texts))
    want = [sets_by_hand(t) for t in texts]
    assert sets.n.tolist() == [len(w) for w in want]
    mine = [set(sets.hashes[sets.at[i] : sets.at[i + 1]].tolist()) for i in range(len(texts))]
    keys = sets.keys()
    for i in range(len(texts)):
        for j in range(i):
            assert len(mine[i] & mine[j]) == len(want[i] & want[j])
            assert (keys[i] == keys[j]) == (want[i] == want[j])


@pytest.mark.parametrize("widest", [64, 256, jaccard.WIDEST])
def test_bitmaps_never_lose_a_link(widest, monkeypatch):
    monkeypatch.setattr(jaccard, "WIDEST", widest)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(40):
        w = base[:]
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(999)}"
        texts.append(" ".join(w[: rng.randrange(55, 81)]))
    sets = jaccard.Sets(*packed(texts))
    rows = np.arange(len(texts))
    found = {tuple(sorted(p[:2])) for p in jaccard.survivors(sets.n, [sets.signature(i) for i in rows], rows, rows, None).tolist()}
    split = {tuple(sorted(p[:2])) for p in jaccard.survivors(sets.n, [sets.signature(i) for i in rows], rows, rows[:20], rows[20:]).tolist()}
    want = [sets_by_hand(t) for t in texts]
    for i in rows:
        for j in rows[:i]:
            if 100 * len(want[i] & want[j]) >= 75 * len(want[i] | want[j]):
                assert (j, i) in found and (((j < 20) == (i < 20)) or (j, i) in split)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 300), st.integers(1, 6), st.integers(1, 25), st.sampled_from([40, 1 << 31, 1 << 40, (1 << 63) - 1]))
def test_bit_slices_give_the_exact_top(seed, n, width, k, most):
    rng = np.random.default_rng(seed)
    values = rng.integers(-most - 1, most, (n, width), endpoint=True)
    rows, ids = rng.permutation(n), rng.integers(0, 2 * n, n)
    query, own = values[0], int(rows[0])
    built = bitslice.Slices(values)
    exact = [sum(a * b for a, b in zip(v, query.tolist(), strict=True)) for v in values.tolist()]
    want = sorted((-s, int(i)) for s, i, r in zip(exact, ids, rows, strict=True) if r != own)[:k]
    for slices in (built, bitslice.Slices(values, built.maps.tobytes())):
        got, points = bitslice.best(slices, rows, ids, query, own, k)
        assert [(-s, i) for i, s in zip(got.tolist(), points.tolist(), strict=True)] == [(-min(max(-s, -(1 << 63)), (1 << 63) - 1), i) for s, i in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6), max_size=12), min_size=1, max_size=5))
def test_loser_tree(runs):
    coded = [lcpmerge.encode([(s, s[::-1], i, j, 0, 0) for j, s in enumerate(sorted(r))]) for i, r in enumerate(runs) if r]
    if not coded:
        return
    out = list(lcpmerge.merge(coded))
    strings = [item[0] for _, item in out]
    assert strings == sorted(s for r in runs for s in r)
    for (a, b), (shared, item) in zip(zip(strings, strings[1:], strict=False), out[1:], strict=True):
        assert shared == lcpmerge.common(a, b) and item[1] == item[0][::-1]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_anchors_cover_every_window(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 50, 99, 100, 101, 180, 400]))) for _ in range(4)]
    block, at = packed(texts)
    row, a, lo, hi, _, _ = suffixes.anchors(block, at)
    got = sorted((int(r), int(s) - int(at[r])) for r, x, y in zip(row, lo, hi, strict=True) for s in range(x, y + 1))
    assert got == [(i, s) for i, t in enumerate(texts) for s in range(len(t) - 99)]
    named = {}
    for x, p, y in zip(lo, a, hi, strict=True):
        for s in range(x, y + 1):  # equal windows name the same place
            assert named.setdefault(block[s : s + 100].tobytes(), int(p) - s) == int(p) - s


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab\n "), max_size=30), min_size=1, max_size=5))
def test_line_bounds(texts):
    block, at = packed(texts)
    starts, ends, first = linededup.line_bounds(block, at)
    got = [[block[s:e].tobytes().decode() for s, e in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)] for i in range(len(texts))]
    assert got == [t.split("\n") for t in texts]


def test_chunks_resist_shifts():
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice("abcdefgh") * 3 for _ in range(8))
    shared = [line() for _ in range(30)]
    docs = ["\n".join([*[line() for _ in range(k)], *shared]) for k in (0, 1, 5)]
    keys = []
    for d in docs:
        c = linededup.chunks(*packed([d]))
        keys.append(set(zip(c["k1"].tolist(), c["k2"].tolist(), strict=True)))
    assert len(keys[0] & keys[1] & keys[2]) >= len(keys[0]) - 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=30), st.integers(0, 99))
def test_fill_covers_everything(sizes, seed):
    rng = np.random.default_rng(seed)
    sizes = np.array(sizes)
    pieces = packing.fill(sizes, lambda i, left: (p := rng.permutation(len(sizes))[:4])[left[p] > 0])
    for i, n in enumerate(sizes):
        own = sorted((s, k) for d, s, k, _, _ in pieces if d == i)
        assert sum(k for _, k in own) == n and all(a + k == b for (a, k), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0
    rows = {}
    for _, _, k, q, o in pieces:
        rows.setdefault(q, []).append((o, k))
    for parts in rows.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(parts, parts[1:], strict=False))
        total = sum(k for _, k in parts)
        assert total <= 2048 and total & (total - 1) == 0


def test_word_ids_equal_the_tokenizer():
    known = packing.WordIds(packing.tokenizer_file())
    odd = ["", "Don't 'tis it'S we'LL x'd ÀÉÎ ß ŉ Ǆ İI ſ K", "a\x1cb \x85c\xa0d e　f", "<|endoftext|>x y", "ΑΣ ΣΑΣ.", "café ́x", "12 3a4 ___ foo_bar --- #$%", "日本語 テスト", "😀 a😀b", " \n\t ", "A" * 300]
    rng = np.random.default_rng(3)
    signs = list("abcdehst'.,;!? \n\t\x1c09éÈñß\u0130\u0250\u0301\u0331ΣσHK文🙂\u0085\xa0\u3000")
    odd += ["".join(rng.choice(signs, rng.integers(0, 120))) for _ in range(400)]
    odd += ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n)) for n in range(1, 150)]
    want = [known.tokenizer.encode(t, add_special_tokens=False).ids for t in odd]
    for _ in range(2):  # first all words are new, then none
        words, ids = known.documents(*packed(odd))
        assert [i.tolist() for i in ids] == want and len(words) == len(odd)


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(packing, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % 3)
    known = packing.WordIds(packing.tokenizer_file())
    texts = ["alpha beta gamma delta epsilon", "zeta eta theta iota beta", "alpha kappa"]
    for _ in range(2):
        assert [i.tolist() for i in known.documents(*packed(texts))[1]] == [known.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

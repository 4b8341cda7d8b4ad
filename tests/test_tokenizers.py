import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexispark import staging
from lexispark.operators import batching as G
from lexispark.operators import bpe as B
from lexispark.operators import merges
from lexispark.operators import vocabulary as V


def lines(spark, texts):
    return spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "doc_id long, line_no long, text string")


def test_ids_by_frequency_then_first_sight(spark):
    t = V.WordTokenizer(min_freq=1).train(lines(spark, ["b a b c", "a c d"]))
    assert {r["token"]: r["idx"] for r in t.vocabulary.collect()} == {"b": 4, "a": 5, "c": 6, "d": 7}
    capped = V.WordTokenizer(min_freq=1, max_size=6).train(lines(spark, ["b a b c", "a c d"]))
    assert {r["token"] for r in capped.vocabulary.collect()} == {"b", "a"}


def test_word_round_trip(spark, tmp_path):
    df = lines(spark, ["b a b", "", "zz a"])
    t = V.WordTokenizer(min_freq=2).train(lines(spark, ["b a b a"]))
    coded = {r["line_no"]: r["ids"] for r in t.encode(df, add_bos=True, add_eos=True).collect()}
    assert coded == {0: [2, 4, 5, 4, 3], 1: [2, 3], 2: [2, 1, 5, 3]}
    plain = t.decode(t.encode(df), ["line_no"])
    assert {r["line_no"]: r["text"] for r in plain.collect()} == {0: "b a b", 1: "", 2: "a"}
    kept = t.decode(t.encode(df), ["line_no"], remove_special=False)
    assert {r["line_no"]: r["text"] for r in kept.collect()}[2] == "<UNK> a"
    t.save(str(tmp_path / "w"))
    again = V.WordTokenizer.load(spark, str(tmp_path / "w"))
    assert again.min_freq == 2 and sorted(again.vocabulary.collect()) == sorted(t.vocabulary.collect())


def test_merge_is_left_to_right():
    assert B.merge_word(tuple("abab") + (B.END,), "a", "b") == ("ab", "ab", B.END)
    assert B.merge_word(tuple("aaa") + (B.END,), "a", "a") == ("aa", "a", B.END)
    assert B.encode_symbols([*"hello", B.END], {("h", "e"): 0, ("l", "l"): 1}) == ["he", "ll", "o", B.END]


def recount(table):
    out = {}
    for word, n in table.items():
        for pair in zip(word, word[1:], strict=False):
            out[pair] = out.get(pair, 0) + n
    return out


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=7), st.integers(1, 5), min_size=1, max_size=8))
def test_learned_merges_equal_a_full_recount(words):
    table = {tuple(w) + (B.END,): n for w, n in words.items()}
    merges, state = [], dict(table)
    for _ in range(6):
        counts = recount(state)
        if not counts:
            break
        pair, n = min(counts.items(), key=lambda x: (-x[1], x[0]))
        if n < 2:
            break
        merges.append(pair)
        new = {}
        for w, k in state.items():
            w = B.merge_word(w, *pair)
            new[w] = new.get(w, 0) + k
        state = new
    assert B.learn_merges(table, 6) == merges


def test_bpe_round_trip(spark, tmp_path):
    df = lines(spark, ["Low lower lowest", "", "newer  wider low"])
    t = B.BPETokenizer(vocab_size=40).train(df)
    text = t.decode(t.encode(df, add_bos=True, add_eos=True), ["line_no"])
    assert {r["line_no"]: r["text"] for r in text.collect()} == {0: "low lower lowest", 1: "", 2: "newer wider low"}
    t.save(str(tmp_path / "b"))
    again = B.BPETokenizer.load(spark, str(tmp_path / "b"))
    assert again.merges == t.merges and again.encode(df).orderBy("line_no").collect() == t.encode(df).orderBy("line_no").collect()


def test_exact_pair_counts(spark):
    counts = {(r["left"], r["right"]): r["freq"] for r in B.pair_counts(B.initial_symbols(lines(spark, ["abab"]))).collect()}
    assert counts == {("a", "b"): 2, ("b", "a"): 1, ("b", B.END): 1}


def test_batches_are_padded(spark):
    rows = spark.createDataFrame([(0, [2, 5, 3], [2, 3]), (1, [2, 3], [2, 6, 7, 3])], "line_no long, src_ids array<int>, tgt_ids array<int>")
    out = {r["line_no"]: r for r in G.batches(rows.repartition(2), 2).collect()}
    assert out[0]["batch_id"] == out[1]["batch_id"] == 0
    assert out[1]["src_ids"] == [2, 3, 0] and out[0]["tgt_ids"] == [2, 3, 0, 0]
    fixed = {r["line_no"]: r for r in G.numbered_batches(rows, 2).collect()}
    assert fixed[1]["src_ids"] == [2, 3, 0] and fixed[1]["src_len"] == 2 and fixed[0]["tgt_ids"] == [2, 3, 0, 0]
    given_, wanted = G.shifted(F.col("tgt_ids"))
    assert [tuple(r) for r in rows.filter("line_no = 1").select(given_, wanted).collect()] == [([2, 6, 7], [6, 7, 3])]
    assert rows.filter("line_no = 0").select(G.padding_mask(F.array(F.lit(0), F.lit(5)))).first()[0] == [True, False]


def test_batches_are_full_and_repeatable(spark, monkeypatch):
    monkeypatch.setattr(staging, "RANKED", 40)
    rows = spark.range(0, 1000, 3).select(F.col("id").alias("line_no"), F.array(F.lit(2)).alias("src_ids"), F.array(F.lit(3)).alias("tgt_ids")).repartition(5)
    plain = {r["line_no"]: r["batch_id"] for r in G.batches(rows, 16).collect()}
    assert plain == {n: i // 16 for i, n in enumerate(range(0, 1000, 3))}
    train, valid = G.loaders(rows, rows, 16, seed=4)
    one, two = ({r["line_no"]: r["batch_id"] for r in x.collect()} for x in (train, G.batches(rows.coalesce(2), 16, seed=4)))
    assert one == two != plain and {r["line_no"]: r["batch_id"] for r in valid.collect()} == plain
    sizes = sorted(list(one.values()).count(b) for b in set(one.values()))
    assert sizes == [334 % 16, *[16] * 20]


@pytest.mark.parametrize("bound", [1_000_000, 1])
def test_rows_with_equal_or_null_keys_keep_their_words(spark, monkeypatch, bound):
    texts = [("a b", 1), ("c d", 1), ("d", None), ("a", None), (None, 2), ("", 2), ("zzz b", 1)]
    df = spark.createDataFrame(texts, "text string, line_no long").repartition(3)
    vocab = spark.createDataFrame([("a", 4, 9), ("b", 5, 9), ("c", 6, 9), ("d", 7, 9)], "token string, idx int, freq long")
    monkeypatch.setattr(V, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(V.collected, "__defaults__", (bound,))
    t = V.WordTokenizer(vocabulary=vocab)
    out = t.encode(df)
    want = {"a b": [4, 5], "c d": [6, 7], "d": [7], "a": [4], None: [], "": [], "zzz b": [1, 5]}
    assert {r["text"]: r["ids"] for r in out.collect()} == want
    back = t.decode(out.withColumn("was", F.col("text")), ["line_no", "was"], remove_special=False)
    assert {r["was"]: r["text"] for r in back.collect()} == {k: (k or "").replace("zzz", "<UNK>") for k in want}


def test_vocabulary_ranks_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(staging, "RANKED", 7)
    rng = random.Random(2)
    texts = [" ".join(f"w{min(rng.randrange(200), rng.randrange(200))}" for _ in range(9)) for _ in range(120)]
    counts, seen = Counter(), {}
    for i, t in enumerate(texts):
        for j, w in enumerate(t.split()):
            counts[w] += 1
            seen.setdefault(w, (i, j))
    want = [w for w in sorted(counts, key=lambda w: (-counts[w], seen[w])) if counts[w] >= 2]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, line_no long, text string").repartition(4)
    got = {r["token"]: r["idx"] for r in V.WordTokenizer(min_freq=2).train(df).vocabulary.collect()}
    assert got == {w: i + 4 for i, w in enumerate(want)}


def test_byte_pairs_of_a_full_vocabulary(spark):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(12)) for _ in range(60)]
    t = B.BPETokenizer(vocab_size=150).train(lines(spark, texts))
    table, merges = Counter((*w, B.END) for x in texts for w in x.split()), []
    while len(merges) < 150 - 4 - 4:  # recount all pairs before every merge
        pairs = Counter()
        for word, n in table.items():
            for pair in zip(word, word[1:], strict=False):
                pairs[pair] += n
        best = min(pairs, key=lambda p: (-pairs[p], *p), default=None)
        if best is None or pairs[best] < 2:
            break
        merges.append(best)
        again = Counter()
        for word, n in table.items():
            again[B.merge_word(word, *best)] += n
        table = again
    assert t.merges == merges and len(merges) > 60
    steps = B.encode_steps(spark.createDataFrame([("abcab",), ("b",)], "word string"), t).collect()
    for word in ("abcab", "b"):
        own = sorted((r["step"], r["merged"], r["symbols"]) for r in steps if r["word"] == word)
        assert own[0][1:] == (None, [*word, B.END]) and own[-1][2] == B.encode_symbols([*word, B.END], t.ranks)
        assert all(len(a[2]) == len(b[2]) + 1 and b[1] in b[2] for a, b in zip(own, own[1:], strict=False))
    both = B.parallel_examples(spark.createDataFrame([(1, "abc ab", "b"), (2, "", "a")], "line_no long, src string, tgt string"), t)
    rows = {r["line_no"]: r for r in both.collect()}
    assert "".join(rows[1]["src_pieces"]) == "abc</w>ab</w>" and rows[1]["ratio"] == len(rows[1]["tgt_pieces"]) / len(rows[1]["src_pieces"]) and rows[2]["ratio"] is None


def test_merges_learned_over_tasks_equal_the_plain_ones(spark, monkeypatch):
    rng = random.Random(8)
    syllables = ["".join(rng.choice("abé<") for _ in range(rng.randrange(1, 4))) for _ in range(12)] + ["aaa", "</w>", "😀"]
    texts = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(12)) for _ in range(150)]
    table = {(*w, B.END): n for w, n in Counter(w for x in texts for w in x.split()).items()}
    monkeypatch.setattr(merges, "WORDS", 100)  # four tasks
    for forward in (3, 48):
        monkeypatch.setattr(merges, "FORWARD", forward)
        t = B.BPETokenizer(lowercase=False, min_freq=1).train(lines(spark, texts), 700)
        assert t.merges == B.learn_merges(table, 700, 1) and len(t.merges) > 300


def test_no_word_is_left_out_of_learning(spark, monkeypatch):
    # A bound on the words that visited the driver left the rare ones out.
    monkeypatch.setattr(B, "MAX_WORDS", 2, raising=False)
    t = B.BPETokenizer().train(lines(spark, ["aa aa bb bb xyq xyr xys xyt xyu"]), 1)
    assert t.merges == [("x", "y")] and {"q", "u"} <= {r["token"] for r in t.vocabulary.collect()}


def test_learning_from_nothing(spark):
    t = B.BPETokenizer().train(lines(spark, ["", " "]), 3)
    assert t.merges == [] and t.vocabulary.count() == 4

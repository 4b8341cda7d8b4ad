import numpy as np
import pytest

from lexispark.operators.nmt import models, training
from lexispark.operators.nmt.layers import Node, cross_entropy


@pytest.mark.parametrize("kind", ["rnn", "lstm", "attention"])
def test_gradients_by_differences(kind):
    extra = {"attention_dim": 3} if kind == "attention" else {}
    model = models.build(kind, vocab_size=9, embedding_dim=4, hidden_dim=5, num_layers=2, dropout=0.0, **extra)
    src, tgt = np.array([[4, 5, 6], [7, 8, 0]]), np.array([[2, 5, 6, 3], [2, 7, 3, 0]])
    loss, grads = training.gradient(model, src, tgt)
    rng = np.random.default_rng(1)
    for name in model.params:
        value = model.params[name].value
        at = tuple(rng.integers(0, n) for n in value.shape)
        old = value[at]
        ends = []
        for step in (1e-5, -1e-5):
            value[at] = old + step
            ends.append(float(cross_entropy(model.forward(src, tgt[:, :-1]), tgt[:, 1:]).value))
        value[at] = old
        assert abs((ends[0] - ends[1]) / 2e-5 - grads[name][at]) < 1e-6, name


@pytest.mark.parametrize("kind", ["rnn", "lstm", "attention"])
def test_padding_does_not_matter(kind):
    model = models.build(kind, vocab_size=9, embedding_dim=4, hidden_dim=5, num_layers=1, dropout=0.0)
    short, long = np.array([[4, 5]]), np.array([[4, 5, 0, 0]])
    tgt = np.array([[2, 6, 7]])
    assert np.allclose(model.forward(short, tgt).value, model.forward(long, tgt).value)


def test_lstm_by_hand():
    model = models.build("lstm", vocab_size=5, embedding_dim=2, hidden_dim=2, num_layers=1, dropout=0.0)
    p = {k: v.value for k, v in model.params.items()}
    x = p["encoder.embedding"][4]
    both = np.concatenate([np.zeros(2), x])
    gate = lambda g: both @ p[f"encoder.cell.0.{g}.weight"] + p[f"encoder.cell.0.{g}.bias"]
    s = lambda z: 1 / (1 + np.exp(-z))
    c = s(gate("i")) * np.tanh(gate("g"))
    state, _ = model.encode(np.array([[4]]))
    assert np.allclose(state[0][1].value, c) and np.allclose(state[0][0].value, s(gate("o")) * np.tanh(c))


def test_unknown_models():
    with pytest.raises(NotImplementedError):
        models.build("transformer", vocab_size=5)
    with pytest.raises(ValueError):
        models.build("other", vocab_size=5)


def test_train_translate_and_checkpoint(spark, tmp_path):
    rows = [(i, [4 + i % 3], [2, 4 + i % 3, 3]) for i in range(12)]
    pairs = spark.createDataFrame(rows, "line_no long, src_ids array<int>, tgt_ids array<int>").coalesce(2)
    model = models.build("lstm", vocab_size=8, embedding_dim=8, hidden_dim=12, num_layers=1, dropout=0.0)
    history = training.train(model, pairs, pairs, epochs=12, rounds=2, lr=0.05)
    assert history[-1]["val_loss"] < history[0]["val_loss"] / 2
    out = {r["line_no"]: r["pred_ids"] for r in training.translate(model, pairs, max_len=4).collect()}
    wide = {r["line_no"]: r["pred_ids"] for r in training.translate(model, pairs.limit(3), max_len=4, beam_width=3).collect()}
    assert sum(out[i] == [4 + i % 3] for i in range(12)) >= 8 and wide == {k: out[k] for k in wide}
    training.save_checkpoint(spark, model, str(tmp_path / "c"), epoch=3)
    again, facts = training.load_checkpoint(spark, str(tmp_path / "c"))
    assert facts["epoch"] == 3 and np.allclose(again.params["decoder.out.bias"].value, model.params["decoder.out.bias"].value)


def test_translate_query_reads_whole_turns(spark, tmp_path, monkeypatch):
    from lexispark.plans import registry

    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(80)]
    spark.createDataFrame([(1, "en", "\n".join([" ".join(words)] * 5))], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(1, 0, "user", " ".join(words)), (1, 1, "assistant", "yes"), (2, 0, "user", " ".join(words[:3])), (2, 1, "assistant", "no")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    seen = {}

    def translate(model, rows, max_len=100, **more):
        seen.update(ids=sorted((r["src_ids"] for r in rows.collect()), key=len), max_len=max_len, size=model.config["vocab_size"])
        return whole(model, rows, max_len, **more)

    whole = training.translate
    monkeypatch.setattr(training, "translate", translate)
    out = registry.QUERIES["translate_greedy"](spark, str(tmp_path)).collect()
    assert [len(i) for i in seen["ids"]] == [3, 80] and len(set(seen["ids"][1])) == 80
    assert seen["size"] == 84 and max(seen["ids"][1]) == 83 and seen["max_len"] == 100
    assert len(out) == 2 and all(r["n"] == len(r["pred_ids"]) <= 100 for r in out)


def test_clipping_and_norms():
    grads = {"encoder.x": np.array([3.0, 4.0]), "decoder.attention.W_encoder": np.array([12.0])}
    assert training.norms(grads) == {"total": 13.0, "encoder": 13.0, "decoder": 0.0}
    assert abs(training.norms(training.clip(grads))["total"] - 1) < 1e-4
    assert training.clip({"a": np.array([0.5])})["a"][0] == 0.5


def test_node_broadcast():
    a, b = Node(np.ones((2, 3))), Node(np.ones(3))
    (a + b).backward()
    assert a.grad.shape == (2, 3) and (b.grad == 2).all()


def test_training_goes_on_from_a_checkpoint(spark, tmp_path):
    rows = [(i, [2, 4 + i % 5, 5 + i % 3, 3], [2, 5 + i % 3, 4 + i % 5, 3]) for i in range(24)]
    pairs = spark.createDataFrame(rows, "line_no long, src_ids array<int>, tgt_ids array<int>").coalesce(2).persist()
    config = {"vocab_size": 10, "embedding_dim": 4, "hidden_dim": 4, "num_layers": 1, "dropout": 0.0}
    whole = training.train(models.build("lstm", **config), pairs, pairs, 3, 2)
    keep = lambda epoch, model, row, best, optimizer: training.save_checkpoint(spark, model, str(tmp_path / f"c{epoch}"), optimizer, epoch=epoch)
    training.train(models.build("lstm", **config), pairs, pairs, 1, 2, checkpoint=keep)
    model, optimizer, facts = training.load_training(spark, str(tmp_path / "c1"))
    rest = training.train(model, pairs, pairs, 3, 2, optimizer=optimizer, done=facts["epoch"])
    assert [r["epoch"] for r in rest] == [2, 3] and np.allclose([r["val_loss"] for r in rest], [r["val_loss"] for r in whole[1:]])


def test_layer_norms(spark):
    df = spark.createDataFrame([("encoder.cell.0.w", [3.0]), ("encoder.cell.0.b", [4.0]), ("bias", [2.0])], "name string, g array<double>")
    assert {r["layer"]: (r["norm"], r["n_params"]) for r in training.layer_norms(df).collect()} == {"encoder.cell.0": (5.0, 2), "bias": (2.0, 1)}


@pytest.mark.parametrize("kind, scale", [("attention", 1), ("rnn", 1), ("lstm", 6), ("attention", 25)])
def test_greedy_from_short_lists_equals_all_logits(kind, scale):
    more = {"attention_dim": 8} if kind == "attention" else {}
    model = models.build(kind, vocab_size=3000, embedding_dim=8, hidden_dim=8, num_layers=1, dropout=0.0, **more)
    for node in model.params.values():
        node *= scale
    rng = np.random.default_rng(3)
    src = np.array([[*rng.integers(4, 3000, n), *[0] * (12 - n)] for n in rng.integers(1, 13, 24)])
    likeliest = models.likeliest_of(model)
    got = models.greedy(model, src, 30, likeliest)
    state, memory = model.encode(src)
    token, want, done = np.full(len(src), 2), [[] for _ in src], np.zeros(len(src), bool)
    for _ in range(30):
        score, state = model.next(token, state, memory)
        token = score.argmax(1)
        done |= token == 3
        for i in np.flatnonzero(~done):
            want[i].append(int(token[i]))
    assert got == want
    if scale == 1:
        assert likeliest.far < 0.1 * likeliest.near  # before, every step of every row met the whole vocabulary

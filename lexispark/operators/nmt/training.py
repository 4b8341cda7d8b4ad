"""Training, evaluation and translation over DataFrames of encoded pairs.

Gradients are summed by partition in ``mapInArrow`` over batches and one Adam step is taken per round
on the driver; translation broadcasts the parameters and decodes each partition's rows in batches.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import bleu as B
from ..vocabulary import PAD
from . import models
from .layers import cross_entropy


def pad(rows: list[list[int]]) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows), default=0)), PAD, np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def norms(grads: dict[str, np.ndarray]) -> dict[str, float]:
    """Norms of all gradients, and of those of the encoder and the decoder; a name with ``encoder`` in it counts as encoder first."""
    square = {"total": 0.0, "encoder": 0.0, "decoder": 0.0}
    for name, g in grads.items():
        s = float((g**2).sum())
        square["total"] += s
        if "encoder" in name:
            square["encoder"] += s
        elif "decoder" in name:
            square["decoder"] += s
    return {k: v**0.5 for k, v in square.items()}


def gradient(model, src: np.ndarray, tgt: np.ndarray, rng=None) -> tuple[float, dict[str, np.ndarray]]:
    for k in model.params:
        model.params[k].grad = None
    loss = cross_entropy(model.forward(src, tgt[:, :-1], rng), tgt[:, 1:], PAD)
    loss.backward()
    return float(loss.value), {k: model.params[k].grad if model.params[k].grad is not None else np.zeros_like(model.params[k].value) for k in model.params}


class Adam:
    def __init__(self, lr: float = 0.001, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8):
        self.lr, self.b1, self.b2, self.eps, self.t = lr, b1, b2, eps, 0
        self.m: dict[str, np.ndarray] = {}
        self.v: dict[str, np.ndarray] = {}

    def step(self, model, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            m = self.m[k] = self.b1 * self.m.get(k, 0) + (1 - self.b1) * g
            v = self.v[k] = self.b2 * self.v.get(k, 0) + (1 - self.b2) * g * g
            model.params[k].value -= self.lr * (m / (1 - self.b1**self.t)) / (np.sqrt(v / (1 - self.b2**self.t)) + self.eps)

    def facts(self) -> dict:
        return {"lr": self.lr, "b1": self.b1, "b2": self.b2, "eps": self.eps, "t": self.t}


def clip(grads: dict[str, np.ndarray], most: float = 1.0) -> dict[str, np.ndarray]:
    total = norms(grads)["total"]
    return {k: g * (most / (total + 1e-6)) for k, g in grads.items()} if total > most else grads


def dumped(model) -> bytes:
    out = io.BytesIO()
    np.savez(out, **model.params.values())
    return out.getvalue()


def loaded(model, data: bytes):
    with np.load(io.BytesIO(data)) as saved:
        for k in model.params:
            model.params[k].value = saved[k]
    return model


def _batches(rows, size: int):
    held: list[tuple] = []
    for batch in rows:
        held.extend(zip(*[c.to_pylist() for c in batch.columns], strict=True))
        while len(held) >= size:
            yield held[:size]
            held = held[size:]
    if held:
        yield held


def train_epoch(model, pairs: DataFrame, optimizer: Adam, rounds: int, batch_size: int = 128, seed: int = 0, epoch: int = 0) -> tuple[float, dict[str, float]]:
    """Each round takes a slice of ``pairs`` (line_no, src_ids, tgt_ids), sums its gradients by partition and steps once.

    Returns the mean of batch losses and the gradient norms of the first round before clipping.
    """
    spark, first, losses = pairs.sparkSession, None, []
    kind, config = model.kind, model.config
    slot = F.pmod(F.xxhash64("line_no", F.lit(seed), F.lit(epoch)), F.lit(rounds))
    for r in range(rounds):
        weights = spark.sparkContext.broadcast(dumped(model))

        def run(batches, r=r, weights=weights):
            own = loaded(models.build(kind, **config), weights.value)
            rng = np.random.default_rng([seed, epoch, r])
            total, sums, n = 0.0, None, 0
            for rows in _batches(batches, batch_size):
                loss, grads = gradient(own, pad([x[0] for x in rows]), pad([x[1] for x in rows]), rng)
                total, n = total + loss, n + 1
                sums = grads if sums is None else {k: sums[k] + g for k, g in grads.items()}
            if n:
                out = io.BytesIO()
                np.savez(out, **sums)
                yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n], pa.int64()), pa.array([out.getvalue()], pa.binary())], ["loss", "n", "grads"])

        parts = pairs.filter(slot == r).select("src_ids", "tgt_ids").mapInArrow(run, "loss double, n long, grads binary").collect()  # one row a partition
        count = sum(p["n"] for p in parts)
        if not count:
            continue
        grads: dict[str, np.ndarray] = {}
        for p in parts:
            with np.load(io.BytesIO(p["grads"])) as saved:
                for k in saved.files:
                    grads[k] = grads.get(k, 0) + saved[k] / count
        first = first or norms(grads)
        losses.append(sum(p["loss"] for p in parts) / count)
        optimizer.step(model, clip(grads))
    return float(np.mean(losses)) if losses else 0.0, first or norms({})


def evaluate_loss(model, pairs: DataFrame, batch_size: int = 128) -> float:
    """Mean of batch losses without dropout."""
    kind, config, weights = model.kind, model.config, pairs.sparkSession.sparkContext.broadcast(dumped(model))

    def run(batches):
        own = loaded(models.build(kind, **config), weights.value)
        for rows in _batches(batches, batch_size):
            tgt = pad([x[1] for x in rows])
            loss = cross_entropy(own.forward(pad([x[0] for x in rows]), tgt[:, :-1]), tgt[:, 1:], PAD)
            yield pa.RecordBatch.from_arrays([pa.array([float(loss.value)])], ["loss"])

    return pairs.select("src_ids", "tgt_ids").mapInArrow(run, "loss double").agg(F.avg("loss")).first()[0] or 0.0


def train(model, pairs: DataFrame, valid: DataFrame, epochs: int = 10, rounds: int = 8, lr: float = 0.001, batch_size: int = 128, seed: int = 0, checkpoint=None, optimizer: Adam | None = None, done: int = 0, best: float = float("inf")) -> list[dict]:
    """History rows; ``checkpoint(epoch, model, row, best, optimizer)`` is called after each epoch.

    With the ``optimizer`` of a checkpoint, its epoch as ``done`` and its least loss as ``best``, training goes on from there.
    """
    optimizer, history = optimizer or Adam(lr), []
    for epoch in range(done + 1, epochs + 1):
        loss, grad = train_epoch(model, pairs, optimizer, rounds, batch_size, seed, epoch)
        row = {"epoch": epoch, "train_loss": loss, "val_loss": evaluate_loss(model, valid, batch_size), "learning_rate": optimizer.lr} | {f"grad_norm_{k}": v for k, v in grad.items()}
        history.append(row)
        if checkpoint:
            checkpoint(epoch, model, row, row["val_loss"] < best, optimizer)
        best = min(best, row["val_loss"])
    return history


def save_checkpoint(spark, model, path: str, optimizer: Adam | None = None, **facts) -> None:
    """Parameters, and the optimizer's moments if given, as rows (kind, name, shape, data); facts as JSON."""
    from ...sources import files

    kinds = {"value": model.params.values()} | ({"m": optimizer.m, "v": optimizer.v} if optimizer else {})
    rows = [(kind, k, list(v.shape), v.ravel().tolist()) for kind, arrays in kinds.items() for k, v in arrays.items()]
    table = spark.createDataFrame(rows, "kind string, name string, shape array<int>, data array<double>")
    files.save_model(spark, path, {"kind": model.kind, "config": model.config, "optimizer": optimizer.facts() if optimizer else None, **facts}, parameters=table)


def load_checkpoint(spark, path: str):
    """The model and the facts saved with it."""
    model, _, facts = load_training(spark, path)
    return model, facts


def load_training(spark, path: str):
    """The model, its optimizer as it was (None if it was not saved), and the facts."""
    from ...sources import files

    facts, tables = files.load_model(spark, path)
    model, state = models.build(facts.pop("kind"), **facts.pop("config")), facts.pop("optimizer")
    optimizer = Adam(**{k: v for k, v in state.items() if k != "t"}) if state else None
    for r in tables["parameters"].collect():
        data = np.array(r["data"], float).reshape(r["shape"])
        if r["kind"] == "value":
            model.params[r["name"]].value = data
        else:
            getattr(optimizer, r["kind"])[r["name"]] = data
    if optimizer:
        optimizer.t = state["t"]
    return model, optimizer, facts


def translate(model, rows: DataFrame, max_len: int = 100, batch_size: int = 32, beam_width: int = 1) -> DataFrame:
    """``rows`` (line_no, src_ids) with ``pred_ids``: greedy, or beam search for a width above 1."""
    context = rows.sparkSession.sparkContext
    kind, config, weights = model.kind, model.config | {"vocab_size": 1}, context.broadcast(model.params.values())

    def run(batches):
        own = models.build(kind, **config)  # takes the size of the weights that it is given
        for name, value in weights.value.items():
            own.params[name].value = value
        likeliest = models.likeliest_of(own)
        for part in _batches(batches, batch_size):
            src = pad([x[1] for x in part])
            pred = models.greedy(own, src, max_len, likeliest) if beam_width == 1 else models.beam(own, src, max_len, beam_width)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array(pred, pa.list_(pa.int32()))], ["line_no", "pred_ids"])

    # Rows are few bytes and much work: dealt out by number, or they would be put together by size.
    return rows.select("line_no", "src_ids").repartition(2 * context.defaultParallelism).mapInArrow(run, "line_no long, pred_ids array<int>")


def score(translated: DataFrame, decode, refs: DataFrame) -> DataFrame:
    """BLEU of decoded predictions against ``refs`` (line_no, ref)."""
    pred = decode(translated.withColumnRenamed("pred_ids", "ids"), ["line_no"]).withColumnRenamed("text", "pred")
    return B.bleu(pred.join(refs, "line_no"))


def gradient_report(grads: DataFrame) -> DataFrame:
    """(component, norm, share): norms of (name, g) rows, summed by component; names with ``encoder`` first."""
    kind = F.when(F.col("name").contains("encoder"), "encoder").when(F.col("name").contains("decoder"), "decoder").otherwise("other")
    square = F.aggregate("g", F.lit(0.0), lambda s, x: s + x * x)
    out = grads.groupBy(kind.alias("component")).agg(F.sqrt(F.sum(square)).alias("norm"), F.sum(F.sqrt(square)).alias("sum_of_norms"), F.count("*").alias("n_params"))
    return out.withColumn("share", F.col("sum_of_norms") / F.sum("sum_of_norms").over(Window.partitionBy(F.lit(0))))  # three rows at most


def layer_norms(grads: DataFrame) -> DataFrame:
    """(layer, norm, n_params) of (name, g) rows: a layer is a name without its last part, where it has several."""
    layer = F.when(F.col("name").contains("."), F.regexp_replace("name", r"\.[^.]*$", "")).otherwise(F.col("name"))
    square = F.aggregate("g", F.lit(0.0), lambda s, x: s + x * x)
    return grads.groupBy(layer.alias("layer")).agg(F.sqrt(F.sum(square)).alias("norm"), F.count("*").alias("n_params"))


def evaluate(spark, checkpoint: str, pairs: DataFrame, src_tokenizer, tgt_tokenizer, path: str | None = None, max_len: int = 100, beam_width: int = 1) -> float:
    """BLEU of a saved model on ``pairs`` (line_no, src, tgt); the translations go to ``path`` if given."""
    from ...sources import files

    model, _ = load_checkpoint(spark, checkpoint)
    coded = src_tokenizer.encode(pairs.select("line_no", F.col("src").alias("text")), add_bos=True, add_eos=True)
    pred = translate(model, coded.select("line_no", F.col("ids").alias("src_ids")), max_len, beam_width=beam_width)
    said = tgt_tokenizer.decode(pred.withColumnRenamed("pred_ids", "ids"), ["line_no"]).withColumnRenamed("text", "pred")
    rows = pairs.select("line_no", "src", F.col("tgt").alias("ref")).join(said, "line_no").persist()
    if path:
        files.write_translations(rows, path)
    out = B.bleu(rows).first()["bleu"]
    rows.unpersist()
    return out


def best_epochs(history: DataFrame) -> DataFrame:
    """``history`` with whether each epoch improves on all before it."""
    before = Window.partitionBy(F.lit(0)).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)  # one row an epoch
    return history.withColumn("is_best", F.col("val_loss") < F.coalesce(F.min("val_loss").over(before), F.lit(float("inf"))))


def parameter_counts(shapes: DataFrame) -> DataFrame:
    """Number of parameters of (name, shape) rows."""
    return shapes.agg(F.sum(F.aggregate("shape", F.lit(1).cast("long"), lambda p, n: p * n)).alias("n_parameters"))

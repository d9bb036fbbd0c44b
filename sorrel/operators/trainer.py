"""A text classifier trained data-parallel in a barrier stage.

The network: hashed character grams of a text, weighed and summed into a hidden layer, and from there into classes. Every task
of the barrier stage holds its share of the rows and the same weights. A step's batch is told by a hash of each row's key and
the epoch, so it doesn't depend on how rows are dealt: each task sums the gradient of its rows in the batch, all tasks
exchange the sums, and each makes the same AdamW step (linear warm-up and decay, clipped norm) with the batch's whole
gradient. The first task returns the losses and the weights. Losses are weighted cross-entropy or focal loss.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sorrel.functions import text
from sorrel.operators import classify, experiments
from sorrel.scratch import forget, ship, written

LOG = "epoch int, step int, loss double, rate double, norm double, model binary"


@dataclass(frozen=True)
class Network:
    """Places of hashed grams, sizes of grams, the hidden layer's width, classes, and the learning rate that suits it."""

    places: int = 4096
    low: int = 2
    high: int = 4
    hidden: int = 32
    classes: int = classify.CLASSES
    learning_rate: float = 0.01


#: AdamW's constants, as published.
BETA_1, BETA_2, EPSILON = 0.9, 0.999, 1e-8


def features(value: str | None, network: Network, max_length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) of a text: 1 + ln of the counts of its hashed grams, at unit length. max_length: words that are read, as fine-tuning cuts its input."""
    summed: dict[int, float] = {}
    if max_length is not None:
        value = " ".join((value or "").split()[:max_length])
    for gram, times in text._count_grams(value, network.low, network.high).items():
        at = crc32(gram.encode("utf-8", "surrogatepass")) % network.places
        summed[at] = summed.get(at, 0.0) + times
    places = np.array(sorted(summed), np.int64)
    weights = 1 + np.log(np.array([summed[p] for p in places.tolist()], np.float64))
    length = np.sqrt((weights**2).sum())
    return places, weights / length if length else weights


def first_weights(network: Network, seed: int) -> np.ndarray:
    """All weights in one array: grams to hidden, hidden's offsets, hidden to classes, classes' offsets."""
    draw = np.random.default_rng(seed)
    inner = draw.standard_normal((network.places, network.hidden)) * 0.5
    outer = draw.standard_normal((network.hidden, network.classes)) / np.sqrt(network.hidden)
    return np.concatenate([inner.ravel(), np.zeros(network.hidden), outer.ravel(), np.zeros(network.classes)])


def parts_of(flat: np.ndarray, network: Network) -> list[np.ndarray]:
    """Views of the four parts of a flat array of weights."""
    sizes = [(network.places, network.hidden), (network.hidden,), (network.hidden, network.classes), (network.classes,)]
    ends = np.cumsum([int(np.prod(s)) for s in sizes])
    return [flat[e - int(np.prod(s)) : e].reshape(s) for e, s in zip(ends, sizes, strict=True)]


def forward(rows: list[tuple[np.ndarray, np.ndarray]], flat: np.ndarray, network: Network) -> tuple[np.ndarray, np.ndarray]:
    """(hidden, probabilities) of rows of features."""
    inner, shift, outer, bias = parts_of(flat, network)
    hidden = np.stack([w @ inner[p] for p, w in rows]) + shift if rows else np.zeros((0, network.hidden))
    hidden = np.maximum(hidden, 0)
    logits = hidden @ outer + bias
    logits -= logits.max(axis=1, keepdims=True) if len(rows) else 0
    chances = np.exp(logits)
    return hidden, chances / chances.sum(axis=1, keepdims=True)


def loss_and_gradient(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, class_weights: np.ndarray, flat: np.ndarray, network: Network, settings: experiments.Training) -> tuple[float, float, np.ndarray]:
    """(sum of losses, what to divide by, sum of gradients): rows' weights for cross-entropy, their number for focal loss."""
    gradient = np.zeros_like(flat)
    if not rows:
        return 0.0, 0.0, gradient
    hidden, chances = forward(rows, flat, network)
    at = np.arange(len(rows))
    weight = class_weights[labels]
    entropy = -weight * np.log(np.maximum(chances[at, labels], 1e-300))
    if settings.loss == "focal":
        pt = np.exp(-entropy)
        miss = 1 - pt
        losses, divisor = miss**settings.gamma * entropy, float(len(rows))
        # By entropy: the entropy itself, and the factor, which falls with pt.
        by_entropy = miss**settings.gamma + (settings.gamma * np.power(miss, settings.gamma - 1, where=miss > 0, out=np.zeros_like(miss)) * pt * entropy if settings.gamma else 0.0)
    else:
        losses, divisor, by_entropy = entropy, float(weight.sum()), np.ones(len(rows))
    hot = np.zeros_like(chances)
    hot[at, labels] = 1
    by_logit = (by_entropy * weight)[:, None] * (chances - hot)
    inner_g, shift_g, outer_g, bias_g = parts_of(gradient, network)
    outer = parts_of(flat, network)[2]
    outer_g += hidden.T @ by_logit
    bias_g += by_logit.sum(axis=0)
    by_hidden = (by_logit @ outer.T) * (hidden > 0)
    shift_g += by_hidden.sum(axis=0)
    for (places, weights), g in zip(rows, by_hidden, strict=True):
        inner_g[places] += weights[:, None] * g[None, :]
    return float(losses.sum()), divisor, gradient


class AdamW:
    """Steps of AdamW with clipped gradients; offsets aren't decayed."""

    def __init__(self, flat: np.ndarray, network: Network, settings: experiments.Training, steps: int):
        self.flat, self.settings, self.steps, self.n = flat, settings, steps, 0
        self.first, self.second, self.decayed = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat)
        for k, part in enumerate(parts_of(self.decayed, network)):
            part[...] = k in (0, 2)

    def rate(self) -> float:
        """As experiments.warmed_rate, for the next step."""
        warm, s = int(self.steps * self.settings.warmup_share), self.n
        return self.settings.learning_rate * (s / max(warm, 1) if s < warm else max((self.steps - s) / max(self.steps - warm, 1), 0.0))

    def step(self, gradient: np.ndarray) -> tuple[float, float]:
        """One step in place; returns the rate and the gradient's norm before clipping."""
        rate, norm = self.rate(), float(np.sqrt((gradient**2).sum()))
        if norm > self.settings.clip_norm:
            gradient = gradient * (self.settings.clip_norm / norm)
        self.n += 1
        self.first += (1 - BETA_1) * (gradient - self.first)
        self.second += (1 - BETA_2) * (gradient**2 - self.second)
        self.flat -= rate * self.settings.weight_decay * self.decayed * self.flat
        self.flat -= rate * (self.first / (1 - BETA_1**self.n)) / (np.sqrt(self.second / (1 - BETA_2**self.n)) + EPSILON)
        return rate, norm


def batch_of(key: str, epoch: int, seed: int, batches: int) -> int:
    """The batch of an epoch that a row belongs to."""
    return crc32(f"{seed}:{epoch}:{key}".encode("utf-8", "surrogatepass")) % batches


def exchanged(values: np.ndarray, gather: Callable[[str], list[str]]) -> np.ndarray:
    """The sum of all tasks' arrays, added in the order of tasks."""
    return reduce(np.add, [np.frombuffer(base64.b64decode(m), np.float64) for m in gather(base64.b64encode(values.tobytes()).decode())])


def fit(rows: list[tuple[str, int, str | None]], count: int, class_weights: np.ndarray, network: Network, settings: experiments.Training, seed: int, gather: Callable[[str], list[str]]) -> tuple[list[tuple], np.ndarray]:
    """(log, weights): a task's part in training on its rows (key, label, text), of which all tasks have count."""
    own = [(k, label, features(t, network, settings.max_length)) for k, label, t in rows]
    batches = max(-(-count // settings.batch_size), 1)
    flat = first_weights(network, seed)
    optimiser, log = AdamW(flat, network, settings, settings.epochs * batches), []
    for epoch in range(settings.epochs):
        of = [batch_of(k, epoch, seed, batches) for k, _, _ in own]
        for batch in range(batches):
            mine = [own[k] for k, b in enumerate(of) if b == batch]
            loss, divisor, gradient = loss_and_gradient([f for _, _, f in mine], np.array([x for _, x, _ in mine], np.int64), class_weights, flat, network, settings)
            whole = exchanged(np.concatenate(([loss, divisor], gradient)), gather)
            if not whole[1]:
                continue  # no row's hash falls into this batch
            rate, norm = optimiser.step(whole[2:] / whole[1])
            log.append((epoch + 1, len(log) + 1, float(whole[0] / whole[1]), rate, norm))
    return log, flat


@dataclass(frozen=True)
class Trained:
    """log: (epoch, step, loss, rate, norm) of every step; flat: the weights; the network and the words of a text that it reads."""

    log: DataFrame
    flat: np.ndarray
    network: Network
    max_length: int


def train(rows: DataFrame, settings: experiments.Training, network: Network | None = None, seed: int = 42, tasks: int | None = None, custom: list[float] | None = None, key: str = "review_id") -> Trained:
    """Train on rows (key, label, content). tasks: how many train at once, no more than the cluster can run together.

    Rows of a task and the weights (places x hidden numbers) are held in its memory. A lost executor ends the barrier stage,
    which Spark then runs again from its start.
    """
    network, spark = network or Network(), rows.sparkSession
    tasks = tasks or max(min(spark.sparkContext.defaultParallelism, 8), 1)
    kept = written(rows.select(F.col(key).cast("string").alias("key"), F.col("label").cast("int").alias("label"), F.col("content").alias("content")), "training-rows")
    weights = {r["label"]: r["weight"] for r in classify.class_weights(kept, settings.class_weights, settings.beta, custom, network.classes).collect()}
    per_class, count = np.array([weights[c] for c in range(network.classes)]), kept.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        own = [row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("key", "label", "content")), strict=True)]
        log, flat = fit(own, count, per_class, network, settings, seed, context.allGather)
        if context.partitionId() == 0:
            columns = [*zip(*log, strict=True)] or [()] * 5
            last = [*[list(c) + [None] for c in columns], [None] * len(log) + [flat.tobytes()]]
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(last, kinds, strict=True)], ["epoch", "step", "loss", "rate", "norm", "model"])

    dealt = kept.repartition(tasks, "key")
    told = written(dealt.mapInArrow(run, LOG, barrier=True), "training-log")
    flat = np.frombuffer(told.where("model IS NOT NULL").first()["model"], np.float64)
    forget(kept)
    return Trained(told.where("model IS NULL").drop("model"), flat, network, settings.max_length)


def predict(rows: DataFrame, trained: Trained, key: str = "review_id") -> DataFrame:
    """(key, pred, probabilities) of rows (key, content); the lowest class wins ties."""
    shared = rows.sparkSession.sparkContext.broadcast((trained.flat, trained.network, trained.max_length))
    kept = rows.select(key, "content")
    schema = kept.drop("content").schema.add("pred", T.IntegerType()).add("probabilities", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, network, max_length = shared.value
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                _, chances = forward([features(t.as_py(), network, max_length) for t in batch.column("content")], flat, network)
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(chances.argmax(axis=1).astype(np.int32)), pa.array(chances.tolist(), pa.list_(pa.float64()))], schema.names)

    return kept.mapInArrow(run, schema)


def cross_validate(rows: DataFrame, settings: experiments.Training, folds: int = 5, seed: int = 42, network: Network | None = None, tasks: int | None = None, custom: list[float] | None = None, key: str = "review_id") -> tuple[DataFrame, DataFrame]:
    """((key, label, pred, probabilities, fold), (fold, epoch, step, loss, rate, norm)): every row predicted by the network that the other folds trained."""
    folded = written(classify.stratified_folds(rows, folds, seed, key).select(key, "label", "content", "fold"), "network-folds")
    said, logs = [], []
    for fold in range(1, folds + 1):
        trained = train(folded.where(F.col("fold") != fold), settings, network, seed, tasks, custom, key)
        mine = folded.where(F.col("fold") == fold)
        said.append(written(predict(mine, trained, key).join(mine.select(key, "label", "fold"), key).select(key, "label", "pred", "probabilities", "fold"), "network-predictions"))
        logs.append(trained.log.withColumn("fold", F.lit(fold)))
    return reduce(DataFrame.unionByName, said), reduce(DataFrame.unionByName, logs)


ship(__name__)

"""Candidate sweeps, saved-prediction ensembles, and slots for models that this library doesn't bring."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sorrel.operators import classify, learning
from sorrel.scratch import ship, written
from sorrel.sources import files

#: Names of the choices.
ENSEMBLES, LOSSES, WEIGHT_MODES = ("hard", "soft", "weighted_soft"), ("ce", "focal"), ("none", "inverse", "sqrt_inverse", "effective_number", "custom")


@dataclass(frozen=True)
class Training:
    """Hyper-parameters of a fine-tuning run, as a trainer slot gets them."""

    model: str
    epochs: int = 3
    batch_size: int = 16
    learning_rate: float = 2e-5
    max_length: int = 256
    warmup_share: float = 0.1
    weight_decay: float = 0.01
    clip_norm: float = 1.0
    loss: str = "ce"
    gamma: float = 2.0
    class_weights: str = "none"
    beta: float = 0.999

    def __post_init__(self):
        if self.loss not in LOSSES or self.class_weights not in WEIGHT_MODES:
            raise ValueError("unknown loss or class weights")
        if self.gamma < 0 or not 0 < self.beta < 1:
            raise ValueError("gamma must be 0 or more, beta between 0 and 1")

    def record(self) -> dict:
        return asdict(self)


Candidate = Callable[[DataFrame, int, int], DataFrame]


def distributed_trainer(settings: Training, train: Callable[[dict], None], processes: int = 1) -> None:
    """Run a torch training function on executors. Needs torch; without it this raises before anything runs."""
    if importlib.util.find_spec("torch") is None:
        raise ImportError("fine-tuning needs torch")
    from pyspark.ml.torch.distributor import TorchDistributor

    TorchDistributor(num_processes=processes, local_mode=False, use_gpu=True).run(train, settings.record())


def encoded(rows: DataFrame, definition: str, max_length: int = 256, key: str = "review_id", pad: int = 0) -> DataFrame:
    """(key, label, input_ids, attention_mask) of rows (key, label, content): ids of a tokenizers .json at the given path, cut and padded to max_length."""
    from pathlib import Path

    shared = rows.sparkSession.sparkContext.broadcast(Path(definition).read_text())
    kept = rows.select(key, "label", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are taken by other tasks
        from tokenizers import Tokenizer

        coder = Tokenizer.from_str(shared.value)
        coder.enable_truncation(max_length)
        coder.enable_padding(length=max_length, pad_id=pad)
        for batch in batches:
            coded = coder.encode_batch([t.as_py() or "" for t in batch.column("content")])
            ids, masks = ([getattr(e, n) for e in coded] for n in ("ids", "attention_mask"))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("label"), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int32()))], [key, "label", "input_ids", "attention_mask"])

    whole = T.ArrayType(T.IntegerType())
    return kept.mapInArrow(run, kept.drop("content").schema.add("input_ids", whole).add("attention_mask", whole))


def warmed_rate(step: Column, total: Column, peak: float, warmup_share: float = 0.1) -> Column:
    """The learning rate of a step, from 0: a linear rise over the first share of all steps, then a linear fall to 0."""
    warm = F.floor(total * F.lit(warmup_share))
    return F.lit(peak) * F.when(step < warm, step / F.greatest(warm, F.lit(1))).otherwise(F.greatest((total - step) / F.greatest(total - warm, F.lit(1)), F.lit(0.0)))


def epoch_losses(steps: DataFrame, *by: str) -> DataFrame:
    """epoch, train_loss: the mean loss of an epoch's steps, from a training log of (epoch, loss). by: further columns to tell apart."""
    return steps.groupBy(*by, "epoch").agg(F.avg("loss").alias("train_loss"))


def fold_scores(said: DataFrame) -> DataFrame:
    """fold, qwk, accuracy, macro_f1 of (fold, label, pred) rows, all folds in one aggregate."""
    return classify.metrics(said, ("fold",))


def out_of_fold(said: DataFrame) -> DataFrame:
    """The metrics of all folds' predictions taken together: one row."""
    return classify.metrics(said)


def sweep(rows: DataFrame, candidates: dict[str, Candidate], folder: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Cross-validate every candidate, save its predictions, and return the leaderboard."""
    boards = []
    for name, predict in candidates.items():
        files.save_predictions(predict(rows, folds, seed), folder, name, seed, folds)
        said = files.load_predictions(rows.sparkSession, folder, [name], seed, folds)
        boards.append(classify.fold_summary(fold_scores(said)).withColumn("model", F.lit(name)))
    return learning.leaderboard(reduce(DataFrame.unionByName, boards))


def tfidf_candidate(features: int = learning.CONFIG["max_features"], iterations: int = learning.CONFIG["max_iter"]) -> Candidate:
    return lambda rows, folds, seed: learning.cross_validate(rows, folds, seed, features, iterations)


def random_candidate() -> Candidate:
    """Classes by a hash, with certainty: what any model must beat."""

    def predict(rows: DataFrame, folds: int, seed: int) -> DataFrame:
        folded = classify.stratified_folds(rows, folds, seed).select("review_id", "label", "fold")
        said = folded.join(learning.random_baseline(rows, seed), "review_id")
        return said.withColumn("probabilities", F.transform(F.sequence(F.lit(0), F.lit(classify.CLASSES - 1)), lambda k: (k == F.col("pred")).cast("double")))

    return predict


def ensemble_saved(spark: SparkSession, folder: str, models: list[str], method: str = "soft", folds: int = 5, seed: int = 42, key: str = "review_id", weights: list[float] | None = None) -> DataFrame:
    """(key, label, pred, scores) of an ensemble of saved predictions. Rows that a member lacks are an error.

    weights: one for each model, in order; without any, weighted_soft takes the models' mean kappa over folds.
    """
    if method not in ENSEMBLES:
        raise ValueError("unknown ensemble method")
    if weights is not None and (len(weights) != len(models) or sum(weights) <= 0):
        raise ValueError("one weight for each model, and a sum of more than 0")
    said = files.load_predictions(spark, folder, models, seed, folds)
    if weights is not None:
        said = said.join(F.broadcast(spark.createDataFrame(list(zip(models, map(float, weights), strict=True)), "model string, weight double")), "model")
    elif method == "weighted_soft":
        means = reduce(DataFrame.unionByName, [classify.fold_summary(fold_scores(said.where(F.col("model") == m))).select(F.lit(m).alias("model"), F.coalesce("qwk_mean", F.lit(1.0)).alias("weight")) for m in models])
        said = said.join(F.broadcast(means), "model")
    else:
        said = said.withColumn("weight", F.lit(1.0))
    whole = said.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first("label").alias("label"))
    checked = whole.select(key, F.when(F.col("_n") != len(models), F.raise_error(F.lit("the members' ids differ")).cast("int")).otherwise(F.col("label")).alias("label"))
    voted = classify.hard_vote(said, key) if method == "hard" else classify.soft_vote(said, key)
    return checked.join(voted, key)


def ensemble_with_metrics(spark: SparkSession, folder: str, models: list[str], method: str = "soft", folds: int = 5, seed: int = 42, key: str = "review_id", weights: list[float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, metrics): ensemble_saved(), written, and its bundle of metrics as one row."""
    said = written(ensemble_saved(spark, folder, models, method, folds, seed, key, weights), "ensemble")
    return said, classify.metrics(said)


ship(__name__)

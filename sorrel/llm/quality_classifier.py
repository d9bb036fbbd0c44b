"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown on the driver from a bounded sample of labelled documents whose statistics the executors compute, then
flattened into arrays; a block of documents walks all trees at once by numpy indexing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_held_out, ship

#: Most labelled rows to learn from, and the shape of the model.
TRAIN_ROWS, TREES, DEPTH, BINS, RATE, RIDGE, LEAST_HESSIAN = 8192, 80, 4, 64, 0.15, 1.0, 1.0
GOOD_AT = 0.7
FEATURES = (
    "chars", "words", "word_mean", "word_std", "word_max", "short_words", "distinct_words", "top_word", "distinct_pairs", "lines", "line_mean",
    "repeated_lines", "ended_lines", "lower", "upper", "digits", "spaces", "non_ascii", "stops", "commas", "shouts", "symbols", "bars", "other_marks", "entropy", "same_as_before",
)


def statistics(text: str | None) -> list[float]:
    """The FEATURES of a whole text; all 0 for null or empty."""
    if not text:
        return [0.0] * len(FEATURES)
    words = text.split()
    lengths = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    tally = Counter(words)
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = raw.sum()
    share = raw[raw > 0] / size
    count = lambda marks: float(raw[np.frombuffer(marks, np.uint8)].sum())
    symbols, marks = count(b"#*$%&<>"), float(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
    cased = text.lower()
    upper = sum(a != b for a, b in zip(text, cased, strict=False)) if len(cased) == len(text) and not text.isascii() else float(raw[65:91].sum())
    return [
        np.log1p(len(text)), np.log1p(len(words)), float(lengths.mean()), float(lengths.std()), np.log1p(float(lengths.max())), float((lengths <= 3).mean()),
        len(tally) / n, max(tally.values(), default=0) / n, len(set(zip(words, words[1:], strict=False))) / n, np.log1p(len(lines)), n / max(len(lines), 1),
        1 - len(set(lines)) / max(len(lines), 1), sum(x.rstrip()[-1] in ".!?:" for x in lines) / max(len(lines), 1),
        float(raw[97:123].sum()) / size, upper / len(text), float(raw[48:58].sum()) / size, count(b" \t\n\r") / size, float(raw[128:].sum()) / size,
        count(b".?") / n, count(b",") / n, count(b"!") / n, symbols / n, count(b"|") / n, (marks - symbols) / n, float(-(share * np.log2(share)).sum()),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
    ]


@dataclass(frozen=True)
class FlatTrees:
    """Complete binary trees of one depth: feature and threshold by (tree, inner node), value by (tree, leaf)."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(self.feature.shape[0])[None, :]
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), trees.size), np.int64)
        for _ in range(int(np.log2(self.value.shape[1]))):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        odds = self.base + self.value[trees, node - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-odds))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> FlatTrees:
    """Boosted trees for log loss. Each level of a tree is split from one histogram over (node, feature, bin).

    Without rows, or with one class only, the model is a constant: the smoothed share of label 1.
    """
    inner, leaves = 2**depth - 1, 2**depth
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    if not 0 < y.sum() < len(y):
        return FlatTrees(np.zeros((1, inner), np.int64), np.zeros((1, inner)), np.zeros((1, leaves)), base)
    rows, width = x.shape
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0)
    bins = np.stack([np.searchsorted(edges[:, f], x[:, f], side="left") for f in range(width)], axis=1)
    features, thresholds, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    odds = np.full(rows, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-odds))
        gradient, hessian = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(rows, np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            cell = (((node - first)[:, None] * width + np.arange(width)) * BINS + bins).ravel()
            g, h = (np.bincount(cell, np.repeat(v, width), n * width * BINS).reshape(n, width, BINS).cumsum(axis=2) for v in (gradient, hessian))
            whole_g, whole_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (whole_g - g) ** 2 / (whole_h - h + RIDGE) - whole_g**2 / (whole_h + RIDGE)
            gain[(h < LEAST_HESSIAN) | (whole_h - h < LEAST_HESSIAN)] = 0
            best = gain[:, :, :-1].reshape(n, -1).argmax(axis=1)
            f, b = best // (BINS - 1), best % (BINS - 1)
            useful = gain[np.arange(n), f, b] > 1e-9
            features[t, first : first + n] = f
            thresholds[t, first : first + n] = np.where(useful, edges[b, f], np.inf)
            own = node - first
            node = 2 * node + 1 + (useful[own] & (bins[np.arange(rows), f[own]] > b[own]))
        leaf = node - inner
        sums = [np.bincount(leaf, v, leaves) for v in (gradient, hessian)]
        values[t] = -RATE * sums[0] / (sums[1] + RIDGE)
        odds += values[t][leaf]
    return FlatTrees(features, thresholds, values, base)


def with_statistics(docs: DataFrame, keep: list[Column], model: FlatTrees | None = None) -> DataFrame:
    """keep's columns and, for each row of docs, its statistics; or with a model, its score instead. Reads only text."""
    kept = docs.select(*keep, F.col("text").alias("quality_text"))
    names = [f.name for f in kept.schema.fields[:-1]]
    kind = T.ArrayType(T.FloatType()) if model is None else T.DoubleType()
    shared = docs.sparkSession.sparkContext.broadcast(model and astuple(model))  # plain values: workers need no class to read them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = FlatTrees(*shared.value) if shared.value else None
        for batch in batches:
            column, parts = batch.column("quality_text"), []
            for k in range(0, batch.num_rows, 1000):
                x = np.array([statistics(t) for t in column.slice(k, 1000).to_pylist()], np.float32).reshape(-1, len(FEATURES))
                parts += list(x) if trees is None else list(trees.probability(x))
            out = pa.array([p.tolist() for p in parts], pa.list_(pa.float32())) if trees is None else pa.array(parts, pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], out], [*names, "score"])

    return kept.mapInArrow(run, kept.drop("quality_text").schema.add("score", kind))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS) -> FlatTrees:
    """A model from up to most_rows rows of labels (doc_id, quality 0 or 1) and their documents.

    A hash of the label row thins the labels to nine tenths of the bound and orders them; only those ids are broadcast, so
    that no text is shuffled. Labels without a document, with null or other values count for nothing; repeated ones count
    again. Where ids of documents repeat there are more statistics than labels: up to twice the bound are learned from,
    chosen by their hash. Both choices depend on the rows only, not on their order.
    """
    usable = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("double").alias("quality_label"))
    spread = 1 << 30
    place = F.pmod(F.xxhash64("doc_id", "quality_label"), F.lit(spread))
    share = int(spread * min(1.0, 0.9 * most_rows / max(usable.count(), 1)))
    chosen = usable.where(place < share).orderBy(place, "doc_id", "quality_label").limit(most_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = with_statistics(texts, [F.col("quality_label")])
    rows = found.orderBy(F.xxhash64("score", "quality_label"), "score").limit(2 * most_rows).collect()
    rows = sorted((tuple(r["score"]), r["quality_label"]) for r in rows)
    return grow(np.array([r[0] for r in rows], np.float32).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows]))


def score_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 at GOOD_AT or more).

    Learns from labels of the folds that are not held out. Null texts are scored as empty ones, very long ones whole; ids
    may be null or repeat, and equal texts get equal scores (0.7 itself is predicted 1). Without labels every score is
    0.5; an empty table gives no rows. Only doc_id and text of docs are read, so other columns can't clash.
    """
    model = train(docs, labels.where(~fold_held_out(F.col("doc_id"))))
    scored = with_statistics(docs, [F.col("doc_id"), fold_held_out(F.col("doc_id")).alias("held_out")], model)
    return scored.withColumn("predicted", (F.col("score") >= GOOD_AT).cast("int"))


ship(__name__)

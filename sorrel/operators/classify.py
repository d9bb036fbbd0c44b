"""Ordinal classification: metrics, folds, class weights, losses and ensembles, as single-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sorrel.functions import arrays

CLASSES = 4


def kappa(label: str = "label", pred: str = "pred") -> Column:
    """Quadratic weighted kappa as one aggregate: the weights' scale cancels, so sums of products are enough. NaN if undefined."""
    t, p = F.col(label).cast("double"), F.col(pred).cast("double")
    expected = F.sum(t * t) + F.sum(p * p) - 2 * F.sum(t) * F.sum(p) / F.count(F.lit(1))
    return F.when(expected == 0, F.lit(float("nan"))).otherwise(1 - F.sum((t - p) * (t - p)) / expected)


def accuracy(label: str = "label", pred: str = "pred") -> Column:
    return F.avg((F.col(label) == F.col(pred)).cast("double"))


def align(predictions: DataFrame, labels: DataFrame, key: str = "review_id", order: str | None = None) -> DataFrame:
    """(key, label, pred), a row a key; raises where a key is on one side only. Of rows that repeat a key the last counts: by the named column, else as they are read."""

    def last(rows: DataFrame, value: str) -> DataFrame:
        place = F.monotonically_increasing_id() if order is None else F.col(order)
        return rows.select(key, F.col(value).alias("_value"), place.alias("_at")).groupBy(key).agg(F.max_by(F.struct("_value"), "_at")["_value"].alias(value), F.lit(1).alias(f"_{value}"))

    both = last(predictions, "pred").join(last(labels, "label"), key, "full_outer")
    checked = F.when(F.col("_pred").isNull() | F.col("_label").isNull(), F.raise_error(F.lit("predictions and labels have different ids")).cast("int")).otherwise(F.col("label"))
    return both.select(key, checked.alias("label"), "pred")


def confusion_matrix(rows: DataFrame, classes: int = CLASSES, by: list[str] | None = None) -> DataFrame:
    """One row for each label, zero-filled, with a column pred_k for each class."""
    cells = [F.sum((F.col("pred") == k).cast("long")).alias(f"pred_{k}") for k in range(classes)]
    counted = rows.groupBy(*(by or []), "label").agg(*cells)
    every = rows.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    if by:
        every = counted.select(*by).distinct().join(every)
    return every.join(counted, [*(by or []), "label"], "left").na.fill(0)


def per_class(rows: DataFrame, classes: int = CLASSES) -> DataFrame:
    """label, precision, recall, f1, support, predicted. 0 / 0 counts as 0."""
    hit = F.array(*[F.sum(((F.col("label") == k) & (F.col("pred") == k)).cast("long")) for k in range(classes)])
    had = F.array(*[F.sum((F.col("label") == k).cast("long")) for k in range(classes)])
    said = F.array(*[F.sum((F.col("pred") == k).cast("long")) for k in range(classes)])
    flat = rows.agg(F.arrays_zip(hit.alias("hit"), had.alias("support"), said.alias("predicted")).alias("z")).select(F.posexplode("z").alias("label", "z")).select(F.col("label"), "z.*")
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    flat = flat.withColumns({"precision": part("hit", "predicted"), "recall": part("hit", "support")})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return flat.withColumn("f1", f1).drop("hit")


def macro_f1(rows: DataFrame, classes: int = CLASSES) -> DataFrame:
    """The mean F1 of the classes that stand among labels or predictions."""
    return per_class(rows, classes).where("support + predicted > 0").agg(F.avg("f1").alias("macro_f1"))


def macro_f1_of(classes: int = CLASSES) -> Column:
    """macro_f1() as an aggregate, for grouped rows."""
    count = lambda test: F.sum(test.cast("long"))
    hit = [count((F.col("label") == k) & (F.col("pred") == k)) for k in range(classes)]
    both = [count(F.col("label") == k) + count(F.col("pred") == k) for k in range(classes)]
    f1 = F.filter(F.array(*[F.when(b > 0, 2.0 * h / b) for h, b in zip(hit, both, strict=True)]), lambda x: x.isNotNull())
    return F.aggregate(f1, F.lit(0.0), lambda a, x: a + x) / F.size(f1)


def metrics(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """qwk, accuracy and macro_f1: one row, or one for each group."""
    return rows.groupBy(*by).agg(kappa().alias("qwk"), accuracy().alias("accuracy"), macro_f1_of().alias("macro_f1"))


def distribution(rows: DataFrame, column: str = "label", classes: int = CLASSES) -> DataFrame:
    every = rows.sparkSession.range(classes).select(F.col("id").cast("int").alias(column))
    return every.join(rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").na.fill(0)


def shuffle_key(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))


def in_turn(rows: DataFrame, seed: int, key: str) -> DataFrame:
    """rows with _turn, from 1 in each label in shuffled order, and _n, the rows of the label.

    A label's rows are numbered in 256 parts by the first digits of the shuffle key, offset by the parts' counts, of which
    there are few enough to broadcast; so a label with most of the rows is not one task's work.
    """
    dealt = rows.withColumn("_key", shuffle_key(key, seed)).withColumn("_part", F.substring("_key", 1, 2))
    counts = dealt.groupBy("label", "_part").agg(F.count(F.lit(1)).alias("_in_part"))
    of_label = Window.partitionBy("label")
    ahead = of_label.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("label").alias("_label"), "_part", F.coalesce(F.sum("_in_part").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_in_part").over(of_label).alias("_n"))
    numbered = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy("label", "_part").orderBy("_key", key)))
    placed = numbered.join(F.broadcast(offsets), F.col("label").eqNullSafe(F.col("_label")) & (numbered["_part"] == offsets["_part"]))
    return placed.withColumn("_turn", F.col("_nth") + F.col("_ahead")).select(*rows.columns, "_turn", "_n")


def stratified_folds(rows: DataFrame, folds: int, seed: int, key: str = "review_id") -> DataFrame:
    """rows with fold, from 1: rows of a label in shuffled order, dealt in turn. A class smaller than folds is an error."""
    if folds < 2:
        raise ValueError("at least two folds are needed")
    fold = F.when(F.col("_n") < folds, F.raise_error(F.lit("a class has fewer rows than folds")).cast("int")).otherwise((F.col("_turn") - 1) % folds + 1)
    return in_turn(rows, seed, key).withColumn("fold", fold.cast("int")).drop("_turn", "_n")


def stratified_holdout(rows: DataFrame, share: float, seed: int, key: str = "review_id") -> DataFrame:
    """rows with held_out: the first of each label in shuffled order."""
    if not 0 < share < 1:
        raise ValueError("the held-out share must lie between 0 and 1")
    return in_turn(rows, seed, key).withColumn("held_out", F.col("_turn") <= arrays.holdout_size(F.col("_n"), share)).drop("_turn", "_n")


def fold_metadata(folded: DataFrame, classes: int = CLASSES) -> DataFrame:
    """By fold: rows in it and in the others, and rows of each label in it and in the others."""
    count = lambda k: F.sum((F.col("label") == k).cast("long"))
    own = folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n_validation"), *[count(k).alias(f"label_{k}") for k in range(classes)])
    whole = folded.agg(F.count(F.lit(1)).alias("_all"), *[count(k).alias(f"_all_{k}") for k in range(classes)])
    train = {"n_train": F.col("_all") - F.col("n_validation")} | {f"train_label_{k}": F.col(f"_all_{k}") - F.col(f"label_{k}") for k in range(classes)}
    return own.join(F.broadcast(whole)).withColumns(train).select("fold", "n_validation", *[f"label_{k}" for k in range(classes)], *train)


def fold_members(folded: DataFrame, key: str = "review_id") -> DataFrame:
    """(fold, part, key): every row as validation row of its fold and as training row of each other, as rows and not as one list a fold."""
    folds = folded.select(F.col("fold").alias("_fold")).distinct()
    part = F.when(F.col("fold") == F.col("_fold"), "validation").otherwise("train")
    return folded.join(F.broadcast(folds)).select(F.col("_fold").alias("fold"), part.alias("part"), key)


def fold_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation over folds."""
    return scores.agg(*[f(c).alias(f"{c}_{n}") for c in ("qwk", "accuracy", "macro_f1") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def class_weights(rows: DataFrame, mode: str, beta: float = 0.999, custom: list[float] | None = None, classes: int = CLASSES) -> DataFrame:
    """label, weight with mean 1. Modes: none, inverse, sqrt_inverse, effective_number, custom. Absent classes count as one row."""
    counted = distribution(rows, classes=classes).withColumn("n", F.greatest("n", F.lit(1)))
    n, total = F.col("n").cast("double"), F.sum("n").over(Window.partitionBy(F.lit(0)))
    if mode == "custom" and (custom is None or len(custom) != classes):
        raise ValueError("custom weights must name each class")
    if mode == "effective_number" and not 0 < beta < 1:
        raise ValueError("beta must lie between 0 and 1")
    raw = {
        "none": lambda: F.lit(1.0), "inverse": lambda: total / (classes * n), "sqrt_inverse": lambda: F.sqrt(total / (classes * n)),
        "effective_number": lambda: (1 - beta) / (1 - F.pow(F.lit(beta), n)), "custom": lambda: F.element_at(F.array(*[F.lit(float(w)) for w in custom]), F.col("label") + 1),
    }[mode]()
    weighed = counted.withColumn("raw", raw)
    if mode == "none":
        return weighed.select("label", F.col("raw").alias("weight"))
    return weighed.select("label", (F.col("raw") / F.avg("raw").over(Window.partitionBy(F.lit(0)))).alias("weight"))


def cross_entropy(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """loss: weighted mean of -ln p of the label."""
    chance = F.element_at("probabilities", F.col("label") + 1)
    return rows.join(F.broadcast(weights), "label").agg((F.sum(-F.col("weight") * F.ln(chance)) / F.sum("weight")).alias("loss"))


def focal_loss(rows: DataFrame, weights: DataFrame, gamma: float = 2.0) -> DataFrame:
    """loss: plain mean of (1 - pt) ** gamma times the weighted cross entropy, of which pt is the exponential."""
    entropy = -F.col("weight") * F.ln(F.element_at("probabilities", F.col("label") + 1))
    return rows.join(F.broadcast(weights), "label").agg(F.avg(F.pow(1 - F.exp(-entropy), F.lit(gamma)) * entropy).alias("loss"))


def hard_vote(members: DataFrame, key: str = "review_id", classes: int = CLASSES) -> DataFrame:
    """key, pred, scores by weighted votes of members (key, model, pred, weight); the lowest class wins ties."""
    scores = F.array(*[F.sum(F.when(F.col("pred") == k, F.col("weight")).otherwise(0.0)) for k in range(classes)])
    voted = members.groupBy(key).agg(scores.alias("scores"))
    return voted.select(key, arrays.first_argmax(F.col("scores")).alias("pred"), "scores")


def soft_vote(members: DataFrame, key: str = "review_id", classes: int = CLASSES) -> DataFrame:
    """key, pred, scores by weighted sums of members' probabilities, the weights made to sum to 1; a sum of 0 or less raises."""
    total = F.when(F.sum("weight") > 0, F.sum("weight")).otherwise(F.raise_error(F.lit("weights must sum to more than 0")).cast("double"))
    scores = F.array(*[F.sum(F.col("weight") * F.element_at("probabilities", k + 1)) / total for k in range(classes)])
    summed = members.groupBy(key).agg(scores.alias("scores"))
    return summed.select(key, arrays.first_argmax(F.col("scores")).alias("pred"), "scores")

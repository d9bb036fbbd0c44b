"""Queries over labels, documents and embeddings: metrics, folds, weights, losses, ensembles, learning.

Label: 2 * quality + (1 - toxic). Prediction: n_chars modulo 4.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sorrel.operators import classify, experiments, learning
from sorrel.scratch import scratch_path
from sorrel.sources import files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SEED, FOLDS = 42, 5

_ROWS = "r AS (SELECT doc_id AS review_id, (2 * quality + 1 - toxic)::INT AS label, (n_chars % 4)::INT AS pred, text AS content FROM labels JOIN documents USING (doc_id))"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rows(spark, d):
    """(review_id, label, pred, content), joined with the ids checked by an equi join."""
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("review_id"), (2 * F.col("quality") + 1 - F.col("toxic")).cast("int").alias("label"))
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("review_id"), (F.col("n_chars") % 4).cast("int").alias("pred"), F.col("text").alias("content"))
    return labels.join(docs, "review_id")


def scored(spark, d):
    return rows(spark, d).drop("content")


_KAPPA = "1 - sum((label - pred) * (label - pred)) / (sum(label * label) + sum(pred * pred) - 2.0 * sum(label) * sum(pred) / count(*))"


@query(f"WITH {_ROWS} SELECT round({_KAPPA}, 6) AS qwk FROM r")
def qwk(spark, d):
    return scored(spark, d).agg(F.round(classify.kappa(), 6).alias("qwk"))


@query(f"WITH {_ROWS} SELECT v.label, {', '.join(f'count(*) FILTER (pred = {k})::BIGINT AS pred_{k}' for k in range(4))} FROM (VALUES (0), (1), (2), (3)) v(label) LEFT JOIN r USING (label) GROUP BY v.label")
def confusion_matrix(spark, d):
    return classify.confusion_matrix(scored(spark, d))


_CLASS = f"""{_ROWS}, k AS (SELECT v.label, (SELECT count(*) FROM r WHERE r.label = v.label) AS support, (SELECT count(*) FROM r WHERE r.pred = v.label) AS predicted,
(SELECT count(*) FROM r WHERE r.label = v.label AND r.pred = v.label) AS hit FROM (VALUES (0), (1), (2), (3)) v(label)),
p AS (SELECT label, support, predicted, coalesce(hit / nullif(predicted, 0), 0) AS pr, coalesce(hit / nullif(support, 0), 0) AS re FROM k),
f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM p)"""


@query(f"WITH {_CLASS} SELECT label::INT AS label, support::BIGINT AS support, predicted::BIGINT AS predicted, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1 FROM f")
def per_class_metrics(spark, d):
    return classify.per_class(scored(spark, d)).select("label", "support", "predicted", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_CLASS} SELECT round((SELECT avg((label = pred)::INT) FROM r), 6) AS accuracy, round((SELECT avg(f1) FROM f WHERE support + predicted > 0), 6) AS macro_f1")
def accuracy_macro_f1(spark, d):
    return classify.metrics(scored(spark, d)).select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query(f"WITH {_ROWS} SELECT v.label, count(r.label)::BIGINT AS n FROM (VALUES (0), (1), (2), (3)) v(label) LEFT JOIN r USING (label) GROUP BY v.label")
def label_distribution(spark, d):
    return classify.distribution(scored(spark, d))


@query(f"WITH {_ROWS} SELECT count(*)::BIGINT AS n, round({_KAPPA}, 6) AS qwk FROM r")
def eval_alignment(spark, d):
    """Every prediction stands twice, first as another class: the last counts."""
    r = scored(spark, d)
    twice = r.select("review_id", ((F.col("pred") + 1) % 4).alias("pred"), F.lit(1).alias("at")).unionByName(r.select("review_id", "pred", F.lit(2).alias("at")))
    both = classify.align(twice, r.select("review_id", "label", F.lit(1).alias("at")), order="at")
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(classify.kappa(), 6).alias("qwk"))


_FOLDED = f"""{_ROWS}, f AS (SELECT review_id, label, pred, ((row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', review_id::VARCHAR, '{SEED}')), review_id) - 1) % {FOLDS} + 1)::INT AS fold FROM r)"""


@query(f"WITH {_FOLDED} SELECT review_id, fold FROM f")
def stratified_kfold(spark, d):
    return classify.stratified_folds(scored(spark, d), FOLDS, SEED).select("review_id", "fold")


@query(f"WITH {_FOLDED} SELECT fold, count(*)::BIGINT AS n_validation, {', '.join(f'count(*) FILTER (label = {k})::BIGINT AS label_{k}, ((SELECT count(*) FROM f WHERE label = {k}) - count(*) FILTER (label = {k}))::BIGINT AS train_label_{k}' for k in range(4))}, ((SELECT count(*) FROM f) - count(*))::BIGINT AS n_train FROM f GROUP BY fold")
def fold_metadata(spark, d):
    return classify.fold_metadata(classify.stratified_folds(scored(spark, d), FOLDS, SEED))


@query(f"WITH {_ROWS}, h AS (SELECT review_id, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', review_id::VARCHAR, '{SEED}')), review_id) AS turn, count(*) OVER (PARTITION BY label) AS n FROM r) SELECT review_id, turn <= greatest(1, round_even(n * 0.2, 0)) AS held_out FROM h")
def holdout_split(spark, d):
    return classify.stratified_holdout(scored(spark, d), 0.2, SEED).select("review_id", "held_out")


def _weights(mode, raw, **options):
    sql = f"WITH {_ROWS}, n AS (SELECT v.label, greatest(count(r.label), 1)::DOUBLE AS n FROM (VALUES (0), (1), (2), (3)) v(label) LEFT JOIN r USING (label) GROUP BY v.label), w AS (SELECT label, {raw} AS w FROM n) SELECT label, round(w / avg(w) OVER (), 6) AS weight FROM w"

    def run(spark, d):
        return classify.class_weights(scored(spark, d), mode, **options).select("label", F.round("weight", 6).alias("weight"))

    run.__name__ = f"class_weights_{mode}"
    query(sql)(run)


_weights("inverse", "1 / n")
_weights("sqrt_inverse", "1 / sqrt(n)")
_weights("effective_number", "(1 - 0.999) / (1 - pow(0.999, n))", beta=0.999)
_weights("custom", "(label + 1)::DOUBLE", custom=[1, 2, 3, 4])
_weights("none", "1.0")

@query(f"WITH {_FOLDED} SELECT g.fold, CASE WHEN f.fold = g.fold THEN 'validation' ELSE 'train' END AS part, review_id FROM f, (SELECT DISTINCT fold FROM f) g")
def fold_members(spark, d):
    return classify.fold_members(classify.stratified_folds(scored(spark, d), FOLDS, SEED))


_FOLD_SCORES = f"""k AS (SELECT g.fold, v.label, (SELECT count(*) FROM f WHERE f.fold = g.fold AND f.label = v.label) AS had, (SELECT count(*) FROM f WHERE f.fold = g.fold AND f.pred = v.label) AS said,
(SELECT count(*) FROM f WHERE f.fold = g.fold AND f.label = v.label AND f.pred = v.label) AS hit FROM (SELECT DISTINCT fold FROM f) g, (VALUES (0), (1), (2), (3)) v(label)),
m AS (SELECT fold, avg(2 * hit / (had + said)) AS macro_f1 FROM k WHERE had + said > 0 GROUP BY fold), s AS (SELECT fold, {_KAPPA} AS qwk, avg((label = pred)::INT) AS accuracy, max(macro_f1) AS macro_f1 FROM f JOIN m USING (fold) GROUP BY fold)"""
_METRICS = ("qwk", "accuracy", "macro_f1")


@query(f"WITH {_FOLDED}, {_FOLD_SCORES} SELECT fold, {', '.join(f'round({c}, 6) AS {c}' for c in _METRICS)} FROM s")
def fold_scores(spark, d):
    scores = experiments.fold_scores(classify.stratified_folds(scored(spark, d), FOLDS, SEED))
    return scores.select("fold", *[F.round(c, 6).alias(c) for c in _METRICS])


@query(f"WITH {_FOLDED}, {_FOLD_SCORES} SELECT {', '.join(f'round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std' for c in _METRICS)} FROM s")
def fold_summary(spark, d):
    summary = classify.fold_summary(experiments.fold_scores(classify.stratified_folds(scored(spark, d), FOLDS, SEED)))
    return summary.select(*[F.round(c, 6).alias(c) for c in summary.columns])


@query(f"WITH {_CLASS} SELECT round((SELECT {_KAPPA} FROM r), 6) AS qwk, round((SELECT avg((label = pred)::INT) FROM r), 6) AS accuracy, round((SELECT avg(f1) FROM f WHERE support + predicted > 0), 6) AS macro_f1")
def out_of_fold(spark, d):
    """All folds' predictions taken together, after a round through the saved predictions of a run."""
    folder = scratch_path(spark, "predictions")
    files.save_predictions(classify.stratified_folds(scored(spark, d), FOLDS, SEED), folder, "m", SEED, FOLDS)
    said = files.load_predictions(spark, folder, ["m"], SEED, FOLDS)
    return experiments.out_of_fold(said).select(*[F.round(c, 6).alias(c) for c in _METRICS])


_RANDOM = f"('0x' || substring(md5(concat_ws(':', review_id::VARCHAR, '{SEED}')), 1, 8))::BIGINT % 4"


@query(f"WITH {_ROWS} SELECT review_id, ({_RANDOM})::INT AS pred FROM r")
def random_baseline(spark, d):
    return learning.random_baseline(scored(spark, d), SEED)


#: Three made-up members: probabilities from the text's length, and the class of the highest, first on ties.
_MEMBERS = f"""{_ROWS}, m AS (SELECT review_id, label, model, weight, [((review_id + model * k * 7) % 5 + 1)::DOUBLE / 15 FOR k IN [0, 1, 2, 3]] AS raw FROM r, (VALUES (1, 0.7::DOUBLE), (2, 0.5::DOUBLE), (3, 0.9::DOUBLE)) v(model, weight)),
p AS (SELECT review_id, label, model, weight, [x / list_sum(raw) FOR x IN raw] AS prob FROM m), q AS (SELECT *, list_position(prob, list_max(prob)) - 1 AS pred FROM p)"""


def members(spark, d, weighted=True):
    models = spark.createDataFrame([(1, 0.7), (2, 0.5), (3, 0.9)], "model int, weight double")
    raw = F.array(*[((F.col("review_id") + F.col("model") * k * 7) % 5 + 1).cast("double") / 15 for k in range(4)])
    made = scored(spark, d).drop("pred").join(F.broadcast(models)).withColumn("raw", raw)
    total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)
    made = made.withColumn("probabilities", F.transform("raw", lambda x: x / total)).drop("raw")
    made = made.withColumn("pred", (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int"))
    return made if weighted else made.withColumn("weight", F.lit(1.0))


def _rounded(voted):
    return voted.select("review_id", "pred", *[F.round(F.element_at("scores", k + 1), 6).alias(f"score_{k}") for k in range(4)])


_HARD = ", ".join(f"round(sum(CASE WHEN pred = {k} THEN weight ELSE 0 END), 6) AS score_{k}" for k in range(4))
_SOFT = ", ".join(f"round(sum({{w}} * prob[{k + 1}]) / sum({{w}}), 6) AS score_{k}" for k in range(4))


def _voted(scores: str) -> str:
    """Votes with the class of the highest, first on ties."""
    return f"WITH {_MEMBERS}, v AS (SELECT review_id, {scores} FROM q GROUP BY review_id) SELECT *, (list_position([score_0, score_1, score_2, score_3], greatest(score_0, score_1, score_2, score_3)) - 1)::INT AS pred FROM v"


@query(_voted(_HARD))
def ensemble_hard(spark, d):
    return _rounded(classify.hard_vote(members(spark, d)))


@query(_voted(_SOFT.format(w="1")))
def ensemble_soft(spark, d):
    return _rounded(classify.soft_vote(members(spark, d, weighted=False)))


@query(_voted(_SOFT.format(w="weight")))
def ensemble_weighted(spark, d):
    return _rounded(classify.soft_vote(members(spark, d)))


_LOSS = f"""{_MEMBERS}, c AS (SELECT label, 1 / count(*)::DOUBLE AS w FROM r GROUP BY label), a AS (SELECT v.label, coalesce(c.w, 1) AS w FROM (VALUES (0), (1), (2), (3)) v(label) LEFT JOIN c USING (label)),
n AS (SELECT label, w / avg(w) OVER () AS w FROM a), e AS (SELECT n.w, -n.w * ln(prob[label + 1]) AS ce FROM q JOIN n USING (label) WHERE model = 1)"""


@query(f"WITH {_LOSS} SELECT round(sum(ce) / sum(w), 6) AS loss FROM e")
def ce_loss_eval(spark, d):
    one = members(spark, d).where("model = 1").drop("weight")
    return classify.cross_entropy(one, classify.class_weights(scored(spark, d), "inverse")).select(F.round("loss", 6).alias("loss"))


@query(f"WITH {_LOSS} SELECT round(avg(pow(1 - exp(-ce), 2) * ce), 6) AS loss FROM e")
def focal_loss_eval(spark, d):
    one = members(spark, d).where("model = 1").drop("weight")
    return classify.focal_loss(one, classify.class_weights(scored(spark, d), "inverse")).select(F.round("loss", 6).alias("loss"))


@query()
def tfidf_logreg_cv(spark, d):
    """Cross-validated metrics by fold; the optimiser is iterative, so there is no SQL."""
    said = learning.cross_validate(rows(spark, d).drop("pred"))
    return said.groupBy("fold").agg(classify.kappa().alias("qwk"), classify.accuracy().alias("accuracy"))


@query("SELECT event_id, round(0.00002 * CASE WHEN event_id < w THEN event_id / greatest(w, 1) ELSE greatest((n - event_id) / greatest(n - w, 1), 0) END * 1e9, 6) AS rate FROM events, (SELECT count(*) AS n, floor(count(*) * 0.1)::BIGINT AS w FROM events)")
def warmup_schedule(spark, d):
    """The learning rate, in billionths, of as many steps as there are events."""
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id")
    total = events.agg(F.count(F.lit(1)).alias("n"))
    rate = experiments.warmed_rate(F.col("event_id"), F.col("n"), 2e-5)
    return events.join(F.broadcast(total)).select("event_id", F.round(rate * 1e9, 6).alias("rate"))


@query("SELECT (event_id % 3)::INT AS epoch, round(avg(value), 6) AS train_loss FROM events GROUP BY 1")
def epoch_losses(spark, d):
    steps = spark.read.parquet(f"{d}/events.parquet").select((F.col("event_id") % 3).cast("int").alias("epoch"), F.col("value").alias("loss"))
    return experiments.epoch_losses(steps).select("epoch", F.round("train_loss", 6).alias("train_loss"))

"""The barrier-mode trainer against its plain parts and numeric gradients."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sorrel import cli
from sorrel.operators import classify, experiments, trainer

SMALL = trainer.Network(places=64, low=2, high=3, hidden=5)


def labelled(n=60, seed=1):
    draw = random.Random(seed)
    kinds = ["bad awful broken", "poor weak dull", "fine good nice", "great superb best"]
    return [(f"r{k}", k % 4, " ".join(draw.choices(kinds[k % 4].split(), k=6) + draw.choices(["the", "thing", "was"], k=3))) for k in range(n)]


@pytest.mark.parametrize("settings", [{}, {"loss": "focal", "gamma": 2.0}, {"loss": "focal", "gamma": 0.0}, {"loss": "focal", "gamma": 1.0}])
def test_gradients_are_those_of_differences(settings):
    settings = experiments.Training("", **settings)
    rows = labelled(9)
    own = [trainer.features(t, SMALL) for _, _, t in rows]
    labels, weights = np.array([x for _, x, _ in rows]), np.array([0.5, 2.0, 1.0, 0.7])
    flat = trainer.first_weights(SMALL, 3)
    total, divisor, gradient = trainer.loss_and_gradient(own, labels, weights, flat, SMALL, settings)
    draw = random.Random(2)
    for k in [draw.randrange(len(flat)) for _ in range(60)] + list(range(len(flat) - 24, len(flat))):
        moved = []
        for by in (1e-6, -1e-6):
            other = flat.copy()
            other[k] += by
            moved.append(trainer.loss_and_gradient(own, labels, weights, other, SMALL, settings)[0])
        assert (moved[0] - moved[1]) / 2e-6 == pytest.approx(gradient[k], abs=2e-5)
    assert divisor == (len(rows) if settings.loss == "focal" else pytest.approx(weights[labels].sum()))


def test_losses_are_the_library_s(spark):
    rows = labelled(12)
    own = [trainer.features(t, SMALL) for _, _, t in rows]
    flat, labels, weights = trainer.first_weights(SMALL, 3), np.array([x for _, x, _ in rows]), np.array([0.5, 2.0, 1.0, 0.7])
    _, chances = trainer.forward(own, flat, SMALL)
    table = spark.createDataFrame([(int(x), c.tolist()) for x, c in zip(labels, chances, strict=True)], "label int, probabilities array<double>")
    by_class = spark.createDataFrame(list(enumerate(weights.tolist())), "label int, weight double")
    for settings, wanted in ((experiments.Training(""), classify.cross_entropy(table, by_class)), (experiments.Training("", loss="focal", gamma=1.5), classify.focal_loss(table, by_class, 1.5))):
        total, divisor, _ = trainer.loss_and_gradient(own, labels, weights, flat, SMALL, settings)
        assert total / divisor == pytest.approx(wanted.first()[0])


def test_steps_are_adamw():
    settings = experiments.Training("", learning_rate=0.1, weight_decay=0.5, warmup_share=0.5, clip_norm=1.0)
    flat = trainer.first_weights(SMALL, 1)
    optimiser, plain = trainer.AdamW(flat, SMALL, settings, 4), flat.copy()
    m, v, mask = np.zeros_like(flat), np.zeros_like(flat), np.ones_like(flat)
    trainer.parts_of(mask, SMALL)[1][...] = trainer.parts_of(mask, SMALL)[3][...] = 0
    rates = []
    for k in range(4):
        g = np.random.default_rng(k).standard_normal(len(flat))
        rate, norm = optimiser.step(g)
        rates.append(rate)
        g = g / max(1, np.linalg.norm(g))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        plain = plain - rate * 0.5 * mask * plain - rate * (m / (1 - 0.9 ** (k + 1))) / (np.sqrt(v / (1 - 0.999 ** (k + 1))) + 1e-8)
        assert norm > 1 and np.allclose(flat, plain)
    assert rates == pytest.approx([0, 0.05, 0.1, 0.05])


def test_rates_are_the_schedule_s(spark):
    settings = experiments.Training("", learning_rate=0.3, warmup_share=0.25)
    optimiser = trainer.AdamW(trainer.first_weights(SMALL, 1), SMALL, settings, 11)
    wanted = [r.rate for r in spark.range(11).select("id", experiments.warmed_rate(F.col("id"), F.lit(11), 0.3, 0.25).alias("rate")).sort("id").collect()]
    for rate in wanted:
        assert optimiser.rate() == pytest.approx(rate)
        optimiser.n += 1


def test_any_number_of_tasks_trains_the_same_network(spark):
    rows = labelled(50) + [("n", 2, None), ("e", 1, "")]
    table = spark.createDataFrame(rows, "review_id string, label int, content string")
    settings = experiments.Training("", epochs=3, batch_size=8, learning_rate=0.05, class_weights="inverse")
    one, three = (trainer.train(table, settings, SMALL, seed=5, tasks=n) for n in (1, 3))
    assert np.allclose(one.flat, three.flat, atol=1e-9) and not np.allclose(one.flat, trainer.first_weights(SMALL, 5))
    a, b = ([(r.epoch, r.step, round(r.loss, 8), round(r.rate, 10)) for r in t.log.sort("step").collect()] for t in (one, three))
    assert a == b and [x[1] for x in a] == list(range(1, len(a) + 1)) and {x[0] for x in a} == {1, 2, 3}
    weights = {r.label: r.weight for r in classify.class_weights(table, "inverse").collect()}
    plain = trainer.fit([(k, x, t) for k, x, t in rows], len(rows), np.array([weights[c] for c in range(4)]), SMALL, settings, 5, lambda m: [m])
    assert np.allclose(plain[1], one.flat, atol=1e-9)
    losses = {r.epoch: r.train_loss for r in experiments.epoch_losses(one.log).collect()}
    assert losses[3] < losses[1]


def test_folds_are_predicted_by_the_others(spark):
    table = spark.createDataFrame(labelled(80), "review_id string, label int, content string")
    said, log = trainer.cross_validate(table, experiments.Training("", epochs=12, batch_size=16, learning_rate=0.05), 4, network=SMALL, tasks=2)
    rows = said.collect()
    assert len({r.review_id for r in rows}) == len(rows) == 80 and all(abs(sum(r.probabilities) - 1) < 1e-9 for r in rows)
    assert sum(r.pred == r.label for r in rows) > 72 and {r.fold for r in log.select("fold").distinct().collect()} == {1, 2, 3, 4}


def test_the_command_line_s_settings_take_effect(spark, tmp_path):
    data = [{"review_id": k, "label": x, "content": f"{t} words enough", "product_name": "p"} for k, x, t in labelled(40)]
    (tmp_path / "data.json").write_text(json.dumps(data))
    common = ["classify", "--data-path", str(tmp_path / "data.json"), "--cv-folds", "2", "--models", "network", "--transformer-batch-size", "16"]
    found = []
    for k, more in enumerate((["--transformer-epochs", "2"], ["--transformer-epochs", "3"], ["--transformer-epochs", "2", "--loss", "focal", "--focal-gamma", "2"], ["--transformer-epochs", "2", "--class-weight-mode", "custom", "--custom-class-weights", "9", "1", "1", "1"])):
        found.append(cli.run(spark, [*common, "--output-dir", str(tmp_path / f"out{k}"), *more])["models"]["network"]["losses"])
    assert [len(x) for x in found] == [4, 6, 4, 4] and found[0] != found[2] != found[3] != found[0]

import pytest
from pyspark.sql import functions as F

from sorrel.operators import classify, experiments, search
from sorrel.sources import files


def candidate(shift):
    def predict(rows, folds, seed):
        folded = classify.stratified_folds(rows, folds, seed)
        pred = ((F.col("label") + F.when(F.col("review_id") % 3 == 0, shift).otherwise(0)) % 4).cast("int")
        return folded.select("review_id", "label", pred.alias("pred"), F.array(*[(pred == k).cast("double") for k in range(4)]).alias("probabilities"), "fold")

    return predict


def test_sweep_and_ensembles(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("review_id"), (F.col("id") % 4).cast("int").alias("label"))
    board = experiments.sweep(rows, {"good": candidate(0), "worse": candidate(1), "worst": candidate(2)}, str(tmp_path), folds=2).collect()
    assert [r.model for r in board] == ["good", "worse", "worst"] and board[0].qwk_mean == 1 and board[0].macro_f1_mean == 1
    for method in experiments.ENSEMBLES:
        got = experiments.ensemble_saved(spark, str(tmp_path), ["good", "worse", "worst"], method, folds=2).collect()
        assert len(got) == 40 and all(r.pred == r.label for r in got if r.review_id % 3)
    with pytest.raises(FileNotFoundError):
        files.load_predictions(spark, str(tmp_path), ["none"], 42, 2)
    with pytest.raises(ValueError):
        experiments.ensemble_saved(spark, str(tmp_path), ["good"], "odd")


def test_settings_and_tags():
    assert experiments.Training("m").record()["epochs"] == 3
    with pytest.raises(ValueError):
        experiments.Training("m", gamma=-1)
    assert files.experiment_tag("m", 42, 5, "focal", "inverse", 1.5) == "m_focal_g1p5_inverse_seed42_k5"
    with pytest.raises(ImportError):
        experiments.distributed_trainer(experiments.Training("m"), print)


def test_approximate_search_finds_most(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    queries = table.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    exact, near = ({(r.query_id, r.doc_id) for r in f(table, queries, 10).collect()} for f in (search.dense_leg, search.dense_leg_approximate))
    assert len(exact & near) >= 0.9 * len(exact)


def test_encoded_rows_equal_the_library(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = spark.createDataFrame([(1, 0, "one two three four five six seven"), (2, 1, None), (3, 2, "short")], "review_id int, label int, content string")
    coder = Tokenizer.from_file(path)
    for r in experiments.encoded(rows, path, 5).collect():
        wanted = coder.encode({1: "one two three four five six seven", 2: "", 3: "short"}[r.review_id]).ids[:5]
        assert r.input_ids == wanted + [0] * (5 - len(wanted)) and r.attention_mask == [1] * len(wanted) + [0] * (5 - len(wanted))

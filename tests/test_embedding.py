"""The learned embedding against numpy's singular value decomposition."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sorrel.operators import embedding, enrich, search

TOPICS = ["battery charge power plug", "camera photo lens light", "parcel box van door", "screen bright glass pixel", "price cheap cost sale"]


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(7)
    rows = [(k, " ".join(draw.choices(TOPICS[k % 5].split(), k=5) + draw.choices(TOPICS[(k + 1) % 5].split(), k=k % 3))) for k in range(150)]
    return spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string").repartition(4)


def test_basis_spans_numpy_s(spark, table):
    model = embedding.learn(table, "text", dimensions=6, places=128, spare=10, iterations=6)
    texts = [r.text for r in table.collect()]
    df = sum(np.bincount(list(embedding.grams(t, 128)), minlength=128) for t in texts)
    idf = np.log((1 + len(texts)) / (1 + df)) + 1
    assert np.allclose(model.idf, idf)
    _, values, vectors = np.linalg.svd(embedding.matrix(texts, idf), full_matrices=False)
    assert np.allclose(model.values, values[:6], rtol=1e-4)
    assert np.linalg.norm(vectors[:4] @ model.basis[:, :4], 2) == pytest.approx(1, abs=1e-3)
    cosines = np.linalg.svd(vectors[:4] @ model.basis, compute_uv=False)
    assert cosines.min() > 0.999 and np.allclose(model.basis.T @ model.basis, np.eye(6), atol=1e-8)
    again = embedding.learn(table.repartition(1), "text", dimensions=6, places=128, spare=10, iterations=6)
    assert np.allclose(again.basis[:, :4], model.basis[:, :4], atol=1e-6)


def test_vectors(spark, table, tmp_path):
    model = embedding.learn(table, "text", dimensions=8, places=256)
    embedding.save(spark, model, str(tmp_path / "model"))
    embed = embedding.embedder(spark, embedding.load(spark, str(tmp_path / "model")))
    got = {r.doc_id: np.array(r.v) for r in table.select("doc_id", embed(F.col("text")).alias("v")).collect()}
    assert not got[900].any() and not got[901].any() and np.linalg.norm(got[3]) == pytest.approx(1)
    same = np.mean([got[k] @ got[k + 15] for k in range(0, 60)])
    other = np.mean([got[k] @ got[k + 17] for k in range(0, 60)])
    assert same > 0.8 > 0.4 > other
    empty = embedding.learn(table.limit(0), "text", dimensions=4, places=32)
    assert not empty.values.any()


def test_search_with_the_learned_embedding(spark):
    rows = [(f"r{k}", "p", "배터리 오래 가서 만족 " + TOPICS[k % 5]) for k in range(40)]
    docs = enrich.enrich(spark.createDataFrame(rows, "review_id string, product_name string, content string").withColumns({"title": F.lit(""), "item_name": F.lit(""), "review_survey_answers": F.lit(None).cast("array<struct<question:string,answer:string>>")}))
    embed = embedding.embedder(spark, embedding.learn(docs, "content", dimensions=8, places=512))
    expanded = search.expand(spark.createDataFrame([(0, "배터리 만족 camera photo")], "query_id int, query string"))
    found = search.search_batch(docs.withColumn("vector", embed(F.col("content"))), expanded, embedder=embed)
    best = found.dense.where(F.col("rank") <= 8).collect()
    assert {int(r.doc_id[1:]) % 5 for r in best} == {1} and found.final.count() == 10


def test_grams_are_hashed_once(spark, table, monkeypatch):
    values = [None, "", " ", "a", "ab é 가 İ ß Σ", "x y 😀 😀a", "가나다라 마바 " * 3, *[f"wörd{k} the The" for k in range(30)]]
    for places, characters in ((37, 5), (4096, 1 << 17), (100_000, 40)):
        monkeypatch.setattr(embedding, "CHARACTERS", characters)
        got = [{int(k): int(row[k]) for k in np.flatnonzero(row)} for row in embedding.counted(values, places)]
        assert got == [embedding.grams(v, places) for v in values]
    passes = spark.sparkContext.accumulator(0)
    plain = embedding.counted

    def spied(texts, places):
        passes.add(len(texts))
        return plain(texts, places)

    monkeypatch.setattr(embedding, "counted", spied)
    rows = table.withColumn("grams", embedding.hashed(128)(F.col("text"))).localCheckpoint()
    model = embedding.learn_hashed(rows, "grams", dimensions=6, places=128)
    vectors = embedding.embedder_of_hashed(spark, model)(F.col("grams"))
    got = {r.doc_id: r.v for r in rows.select("doc_id", vectors.alias("v")).collect()}
    assert passes.value == len(got) == 152
    assert np.allclose(model.basis, embedding.learn(table, "text", dimensions=6, places=128).basis, atol=1e-6)
    texts = {r.doc_id: r.text for r in table.collect()}
    for k in (0, 1, 77, 900, 901):
        wanted = embedding.matrix([texts[k]], model.idf)[0] @ model.basis
        assert np.allclose(got[k], wanted / (np.linalg.norm(wanted) or 1))

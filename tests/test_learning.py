import math
import random
from collections import Counter

import pytest

from sorrel.functions import text
from sorrel.operators import classify, learning
from sorrel.plans import metric_queries, registry


def plain_grams(value):
    """Grams as scikit-learn's char_wb counts them."""
    found = Counter()
    for word in (value or "").lower().split():
        word = f" {word} "
        for n in range(2, 6):
            found.update([word[k : k + n] for k in range(max(1, len(word) - n + 1))])
            if n >= len(word):
                break
    return found


@pytest.fixture
def corpus(spark, tmp_path):
    """48 labelled documents, every text twice: far more grams in two documents than 5,000."""
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    texts = [" ".join(word() for _ in range(60)) for _ in range(24)] * 2
    rows = [(i, t, (i // 2) % 2, i % 2) for i, t in enumerate(texts)]
    spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t, _, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), dict(enumerate(texts))


def test_logreg_cv_is_not_reduced(spark, corpus, monkeypatch):
    folder, texts = corpus
    steps, sizes, learner = [], [], learning.LogisticRegression

    class Spy(learner):
        def __init__(self, **options):
            steps.append(options["maxIter"])
            super().__init__(**options | {"maxIter": 1})

        def fit(self, data, *rest):
            model = super().fit(data, *rest)
            sizes.append(model.numFeatures)
            return model

    monkeypatch.setattr(learning, "LogisticRegression", Spy)
    said = registry.QUERIES["tfidf_logreg_cv"](spark, folder).collect()
    assert {r.fold for r in said} == {1, 2, 3, 4, 5} and steps == [3000] * 5
    labels = spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id AS review_id", "2 * quality + 1 - toxic AS label")
    fold_of = {r.review_id: r.fold for r in classify.stratified_folds(labels, 5, 42).collect()}
    wanted = [sum(df >= 2 for df in Counter(g for i, t in texts.items() if fold_of[i] != k for g in plain_grams(t)).values()) for k in range(1, 6)]
    assert sizes == wanted and min(wanted) > 5000


def test_counts_and_vocabulary(spark):
    values = ["ab  AB a", "", None, "long-word 가나다라마바", "x y"]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", text.char_wb_counts(learning.F.col("t")).alias("g")).collect()
    assert {r.i: dict(zip(r.g.terms, r.g.tfs, strict=True)) for r in got} == {i: dict(plain_grams(v)) for i, v in enumerate(values)}
    stats = spark.createDataFrame([("a", [1, 2, 3, 6], [1, 1, 1, 3]), ("b", [1, 1, 9, 11], [1, 1, 1, 3]), ("c", [4, 0, 4, 8], [1, 0, 1, 2]), ("d", [0, 9, 0, 9], [0, 1, 0, 1])], "term string, tfs array<long>, dfs array<long>")
    assert [list(learning._vocabulary(stats, k, 2, 2)) for k in (1, 2, 3)] == [["b", "a"], ["b", "c"], ["a", "b"]]


def test_grams_and_weights_cover_the_documents(spark, tmp_path):
    values = ["Red fox ran ran", "red  foxes", "", None, "fox"]
    spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tf = {(i, g): n for i, v in enumerate(values) for g, n in plain_grams(v).items()}
    got = registry.QUERIES["char_wb_ngrams_documents"](spark, str(tmp_path)).collect()
    assert len(got) == len(tf) and {(r.doc_id, r.term): r.n for r in got} == tf
    df = Counter(g for _, g in tf)
    raw = {(i, g): (1 + math.log(n)) * (math.log(6 / (1 + df[g])) + 1) for (i, g), n in tf.items() if df[g] >= 2}
    wanted = {(i, g): x / math.sqrt(sum(y * y for (j, _), y in raw.items() if j == i)) for (i, g), x in raw.items()}
    assert {(r.doc_id, r.term): r.weight for r in registry.QUERIES["tfidf_weights_documents"](spark, str(tmp_path)).collect()} == pytest.approx(wanted, abs=1e-6)


def test_weights_by_blocks_equal_weights_of_grams(spark, monkeypatch):
    monkeypatch.setattr(learning, "BLOCK_CHARACTERS", 400)
    monkeypatch.setattr(learning, "ROWS_SENT", 50)
    values = [" ".join(f"wörd{k % m} The the" for m in (2, 3, 5, 7)) for k in range(60)] + ["", None, "only-here", "a"]
    table = spark.createDataFrame(list(enumerate(values)), "i long, t string").repartition(3)
    wanted = {(r.i, r.term): r.weight for r in learning.tfidf(table, "i", text.char_wb_ngrams(learning.F.coalesce("t", learning.F.lit("")))).collect()}
    weighed = learning.weights_of_texts(table, "i", "t")
    assert {(r.i, r.term): r.weight for r in weighed.collect()} == pytest.approx(wanted, abs=1e-12)
    assert learning.weights_of_texts(table.limit(0), "i", "t").collect() == []


def test_weights_of_documents_shuffle_no_document(spark, tmp_path):
    spark.createDataFrame([(k, f"red fox {k}") for k in range(9)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    weighed = registry.QUERIES["tfidf_weights_documents"](spark, str(tmp_path))
    assert "hashpartitioning(doc_id" not in weighed._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id for r in weighed.collect()} == set(range(9))


def test_grams_of_a_block_equal_counts_of_each_text(monkeypatch):
    draw = random.Random(3)
    values = ["ab  AB a", "", None, " ", "x y 😀 😀😀 ΑΣ İ ß", "abc abcd abcde abc", *[" ".join("".join(draw.choices("abcé가", k=draw.randrange(1, 9))) for _ in range(draw.randrange(0, 40))) for _ in range(30)]]
    for sent in (1, 100, 1 << 17):
        monkeypatch.setattr(learning, "ROWS_SENT", sent)
        block = learning._Grams(values)
        got = [{block.grams[k]: n for k, n in zip(at.tolist(), tf.tolist(), strict=True)} for at, tf in block.rows()]
        assert got == [dict(text._count_grams(v, 2, 5)) for v in values] and len(set(block.grams)) == len(block.grams)


def test_vectors_of_folds_are_made_in_arrays(spark, corpus, monkeypatch):
    folder, texts = corpus
    fitted, plans, learner = [], [], learning.LogisticRegression

    class Spy(learner):
        def __init__(self, **options):
            super().__init__(**options | {"maxIter": 1})

        def fit(self, data, *rest):
            plans.append(data._jdf.queryExecution().executedPlan().toString())
            fitted.append({r.review_id: dict(zip(r.features.indices.tolist(), r.features.values.tolist(), strict=True)) for r in data.select("review_id", "features").collect()})
            return super().fit(data, *rest)

    monkeypatch.setattr(learning, "LogisticRegression", Spy)
    monkeypatch.setattr(learning, "BLOCK_CHARACTERS", 2000)
    monkeypatch.setattr(learning, "VECTORS_MADE", 5)
    said = learning.cross_validate(metric_queries.rows(spark, folder).drop("pred"), folds=2, features=4000).collect()
    assert len({r.review_id for r in said}) == len(said) == len(texts)
    tf = {i: plain_grams(t) for i, t in texts.items()}
    for got, plan in zip(fitted, plans, strict=True):
        df, total = Counter(g for i in got for g in tf[i]), sum((tf[i] for i in got), Counter())
        top = sorted(sorted((g for g in df if df[g] >= 2), key=lambda g: (-total[g], g))[:4000])
        for i, vector in got.items():
            raw = {k: (1 + math.log(tf[i][g])) * (math.log((1 + len(got)) / (1 + df[g])) + 1) for k, g in enumerate(top) if g in tf[i]}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            assert vector == pytest.approx({k: x / norm for k, x in raw.items()}, abs=1e-12)
        assert "BatchEvalPython" not in plan and "MapInArrow" in plan

import math
import random

import pytest
from pyspark.sql import functions as F

from sorrel.functions import arrays
from sorrel.operators import classify, documents, enrich, lexical, ranking, search
from sorrel.sources import files
from sorrel.streaming import ingest


@pytest.mark.parametrize(("rows", "kept"), [([("A", "x"), ("B", "x"), ("B", "y")], [0, 2]), ([("A", "x"), ("A", "y"), ("B", "y")], [0, 2]), ([], [])])
def test_greedy_dedupe(spark, rows, kept):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos int, id string, print string")
    assert sorted(r.pos for r in documents.dedupe_greedy(df, "id", "print", "pos").collect()) == kept


def test_greedy_dedupe_equals_the_loop(spark):
    draw = random.Random(3)
    rows = [(i, draw.randrange(12), draw.randrange(12)) for i in range(60)]
    ids, prints, kept = set(), set(), []
    for pos, a, b in rows:
        if a not in ids and b not in prints:
            ids.add(a), prints.add(b), kept.append(pos)
    df = spark.createDataFrame(rows, "pos int, id int, print int")
    assert sorted(r.pos for r in documents.dedupe_greedy(df, "id", "print", "pos").collect()) == kept


def test_kappa(spark):
    assert spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 2)], "label int, pred int").agg(classify.kappa()).first()[0] == pytest.approx(0.875)
    assert math.isnan(spark.createDataFrame([(1, 1), (1, 1)], "label int, pred int").agg(classify.kappa()).first()[0])


def test_kappa_by_its_definition(spark):
    draw = random.Random(5)
    pairs = [(draw.randrange(4), draw.randrange(4)) for _ in range(200)]
    seen = [[sum(p == (i, j) for p in pairs) for j in range(4)] for i in range(4)]
    rows, cols = [sum(r) for r in seen], [sum(c) for c in zip(*seen, strict=True)]
    weight = lambda i, j: (i - j) ** 2 / 9
    cells = [(i, j) for i in range(4) for j in range(4)]
    wanted = 1 - sum(weight(i, j) * seen[i][j] for i, j in cells) / sum(weight(i, j) * rows[i] * cols[j] / 200 for i, j in cells)
    assert spark.createDataFrame(pairs, "label int, pred int").agg(classify.kappa()).first()[0] == pytest.approx(wanted)


def test_alignment_demands_equal_ids(spark):
    a, b = spark.createDataFrame([("x", 1)], "review_id string, pred int"), spark.createDataFrame([("y", 1)], "review_id string, label int")
    with pytest.raises(Exception, match="different ids"):
        classify.align(a, b).collect()


def test_folds(spark):
    rows = spark.createDataFrame([(i, 0) for i in range(7)] + [(i + 7, 1) for i in range(9)], "review_id int, label int")
    folded = classify.stratified_folds(rows, 3, 42).collect()
    sizes = sorted([sum(r.fold == k and r.label == 0 for r in folded) for k in (1, 2, 3)], reverse=True)
    assert sizes == [3, 2, 2] and len(folded) == 16
    with pytest.raises(ValueError):
        classify.stratified_folds(rows, 1, 42)
    with pytest.raises(Exception, match="fewer rows"):
        classify.stratified_folds(rows, 8, 42).collect()


def test_weights_and_argmax(spark):
    rows = spark.createDataFrame([(0,), (1,), (2,), (2,), (3,), (3,), (3,), (3,)], "label int")
    got = {r.label: r.weight for r in classify.class_weights(rows, "inverse").collect()}
    assert got == pytest.approx({0: 1 / 0.6875, 1: 1 / 0.6875, 2: 0.5 / 0.6875, 3: 0.25 / 0.6875})
    assert spark.range(1).select(arrays.first_argmax(F.array(*map(F.lit, (0.1, 0.45, 0.45, 0.0))))).first()[0] == 1
    assert spark.range(1).select(arrays.holdout_size(F.lit(10), 0.25)).first()[0] == 2


def test_average_precision_and_recall(spark):
    runs = spark.createDataFrame([(0, "a", 1), (0, "x", 2), (0, "a", 3), (0, "b", 4)], "query_id int, doc_id string, rank int")
    gold = spark.createDataFrame([(0, "a"), (0, "b")], "query_id int, doc_id string")
    assert ranking.average_precision(runs, gold, 10).first().ap == pytest.approx(0.75)
    queries = spark.createDataFrame([(0, "c"), (1, "c")], "query_id int, category string")
    assert {r.query_id: r.recall for r in ranking.evaluate(queries, runs, gold).collect()} == {0: 1.0, 1: 0.0}


def test_fusion(spark):
    schema = "query_id int, doc_id string, score double, rank int"
    fused = search.fuse(spark.createDataFrame([(0, "a", 5.0, 1), (0, "b", 4.0, 2)], schema), spark.createDataFrame([(0, "c", 0.9, 1), (0, "a", 0.8, 2)], schema)).collect()
    assert {r.doc_id: r.rank for r in fused} == {"a": 1, "c": 2, "b": 3}
    assert next(r.rrf_score for r in fused if r.doc_id == "a") == pytest.approx(1 / 61 + 1 / 62)


def test_expansion(spark):
    queries = spark.createDataFrame([(0, "뽁뽁이 포장 상태에 만족한 리뷰"), (1, "비추천"), (2, "배터리 파손")], "query_id int, query string")
    got = {r.query_id: r for r in search.expand(queries).collect()}
    assert (got[0].target_aspect, got[0].target_sentiment, len(got[0].bm25_terms), got[0].bm25_terms[0], got[0].bm25_terms[-1]) == ("배송/포장", "positive", 26, "뾱뾱이", "감싸")
    assert got[1].target_sentiment == "unknown" and got[2].target_aspect == "배송/포장"
    answer = F.when(F.col("query_id") == 1, F.lit('{"bm25_terms":[" x ",""],"dense_query":"y"}')).otherwise("{bad")
    over = {r.query_id: r for r in search.overlay_model(search.expand(queries), answer).collect()}
    assert over[1].bm25_terms == ["x"] and over[1].dense_queries == ["비추천", "y"] and over[0].bm25_terms == got[0].bm25_terms


def test_metadata(spark):
    answer = '{"issue_category":["카메라","x","카메라"],"aspect_keywords":[" a ",""],"issue_sentiments":[{"issue_category":"?","sentiment":"POSITIVE","evidence":"e"}],"short_summary":" s "}'
    got = spark.range(1).select(arrays.parsed_metadata(F.lit(answer)).alias("m")).first().m
    assert got.issue_category == ["카메라", "기타", "기타"] and got.aspect_keywords == ["a"] + ["기타"] * 4
    assert got.issue_sentiments[0].asDict() == {"issue_category": "카메라", "sentiment": "positive", "evidence": "e"} and got.short_summary == "s"
    failed = spark.range(1).select(arrays.parsed_metadata(F.lit("{nope")).alias("m")).first().m
    assert failed.issue_category == ["기타"] and failed.aspect_keywords == []


def raw(spark, rows):
    schema = spark.createDataFrame([], files.REVIEW_SCHEMA).schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


REVIEWS = [
    {"reviewId": "1", "product_name": "폰", "content": "배터리가 오래가서 정말 만족합니다 추천", "rating": "5", "reviewAt": "2024-01-02T03:04:05"},
    {"review_id": "2", "product_name": "폰", "content": "포장이 파손되어 왔고 정말 실망했습니다", "rating": "1", "reviewAt": "1700000000000", "attachments": ["a"]},
    {"reviewId": "3", "product_name": "폰", "content": "포장이 파손되어 왔고 정말 실망했습니다!", "rating": None},
    {"reviewId": "4", "product_name": "폰", "content": "ok"},
    {"reviewId": "5", "product_name": "폰", "content": "화면이 선명하고 부드러워서 아주 좋아요", "rating": "much"},
]


def test_documents(spark):
    got = {r.review_id: r for r in documents.to_documents(raw(spark, REVIEWS)).collect()}
    assert set(got) == {"1", "2", "3", "5"} and got["2"].has_image and not got["1"].has_image
    assert got["3"].rating == 0 and got["5"].error and got["1"].review_at.year == 2024 and got["2"].review_at.year == 2023 and got["3"].review_at.year == 1970


def test_search_end_to_end(spark, tmp_path):
    docs = enrich.enrich(documents.build_documents(raw(spark, REVIEWS[:3]))).withColumn("vector", search.embed(F.col("dense_text")))
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got = search.search(spark, docs, "포장 파손 불만")
    row = got.first().output
    assert [r.review_id for r in row.results] == ["2"] and got.select(search.valid_output(F.col("output"))).first()[0]


def test_stored_and_restricted_indexes_score_alike(spark, tmp_path):
    from sorrel.functions.text import tokens

    docs = spark.createDataFrame([(1, "red fox"), (2, "red red hen"), (3, ""), (4, None)], "id int, t string")
    queries = spark.createDataFrame([(0, "red hen"), (1, "none")], "query_id int, query string")
    index = lexical.build_index(docs, "id", lexical.standard_fields(["t"]))
    lexical.store_index(index, str(tmp_path), 2)
    some = lexical.build_index(docs, "id", lexical.standard_fields(["t"]), spark.createDataFrame([("red",), ("hen",)], "term string"))
    scores = [sorted((r.doc_id, round(r.score, 9)) for r in lexical.match(i, queries, tokens(F.col("query")), {"t": 1.0}).collect()) for i in (index, lexical.load_index(spark, str(tmp_path)), some)]
    assert scores[0] == scores[1] == scores[2] and [d for d, _ in scores[0]] == [1, 2]


def test_phrase_and_wildcard(spark):
    docs = spark.createDataFrame([(1, "the red fox ran"), (2, "red the fox"), (3, "fox")], "id int, t string")
    index = lexical.build_index(docs, "id", lexical.standard_fields(["t"]))
    from sorrel.functions.text import tokens

    queries = spark.createDataFrame([(0, "red fox")], "query_id int, query string")
    assert [r.doc_id for r in lexical.phrase(index, queries, tokens(F.col("query")), {"t": 1.0}).collect()] == [1]
    assert sorted(r.doc_id for r in lexical.wildcard(docs, "id", F.col("t"), "*re? fox*").collect()) == [1]


def test_upsert(spark):
    old, new = (spark.createDataFrame(r, "k int, v string, n int") for r in ([(1, "a", 1), (2, "b", 2)], [(2, "c", 3), (2, "d", 4), (3, "e", 5)]))
    assert sorted((r.k, r.v) for r in files.upsert(old, new, "k", "n").collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_json_sources(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    assert sorted(r.a for r in files.read_lines(spark, str(tmp_path / "lines.json"), "a int").collect()) == [1, 2]
    with pytest.raises(Exception):
        files.read_lines_strict(spark, str(tmp_path / "lines.json"), "a int").collect()
    (tmp_path / "eval.json").write_text('{"q1": {"query": "x", "category": "c", "reviews_to_evaluate": [{"reviewId": "1"}, {"review_id": "2"}, {"reviewId": ""}]}}')
    assert files.load_evaluation(spark, str(tmp_path / "eval.json")).first().gold == ["1", "2"]


def test_ingest_resumes_and_is_idempotent(spark, tmp_path):
    folder, failures = str(tmp_path / "docs"), str(tmp_path / "bad")
    counts = [ingest.ingest_batch(raw(spark, rows), batch_id, folder, failures) for batch_id, rows in ((0, REVIEWS[:2]), (1, REVIEWS[1:]), (1, REVIEWS[1:]))]
    assert counts[0] == {"processed": 2, "resumed": 0, "failed": 0, "kept": 2, "indexed": 0}
    assert counts[1] == counts[2] == {"processed": 4, "resumed": 1, "failed": 1, "kept": 0, "indexed": 0}
    stored = ingest.stored(spark, folder)
    assert sorted(r.review_id for r in stored.collect()) == ["1", "2"]
    assert [(r.stage, r.review_id, r.batch_id) for r in ingest.dead_letters(spark, failures).collect()] == [("preprocess", "5", 1)]
    assert ingest.reindex(spark, folder, str(tmp_path / "index")).fields.where("field = 'content'").first().n == 2


def test_ingest_logs_all_stages_and_keeps_the_first_to_arrive(spark, tmp_path):
    folder, failures = str(tmp_path / "docs"), str(tmp_path / "bad")
    again = [dict(REVIEWS[0], reviewId="9"), dict(REVIEWS[0], reviewId="0"), REVIEWS[1], REVIEWS[4]]
    mark = lambda i, e: F.when(F.col("review_id") == i, F.lit(e))
    steps = ingest.Steps(enrich=lambda docs: enrich.enrich(docs).withColumn("error", mark("2", "no answer")), index=lambda docs, batch: docs.where("review_id = '9'").select("review_id", F.lit("refused").alias("error")))
    counts = ingest.ingest_batch(raw(spark, again).coalesce(1), 0, folder, failures, steps)
    assert counts == {"processed": 4, "resumed": 0, "failed": 2, "kept": 1, "indexed": 0}
    assert [r.review_id for r in ingest.stored(spark, folder).collect()] == ["9"]
    assert sorted((r.stage, r.review_id) for r in ingest.dead_letters(spark, failures).collect()) == [("index", "9"), ("llm_enrich", "2"), ("preprocess", "5")]
    assert ingest.index_count(spark, folder) == 1 and ingest.index_count(spark, str(tmp_path / "none")) == 0


def test_documents_of_repeated_ids(spark):
    rows = [dict(REVIEWS[0]), dict(REVIEWS[1], review_id="1"), dict(REVIEWS[1]), dict(REVIEWS[4], reviewId="7", rating="5")]
    assert [r.review_id for r in documents.build_documents(raw(spark, rows).coalesce(1)).orderBy("review_id").collect()] == ["1", "2", "7"]


def test_reranker_failure_keeps_the_fusion_order(spark):
    rows = spark.createDataFrame([(0, "a", "q", "x", None, 0.5), (0, "b", "q", "yy", "yy", 0.4), (1, "c", "bad", "z", "z", 0.3)], "query_id int, doc_id string, query string, content string, dense_text string, rrf_score double")

    def score(queries, texts):
        if "bad" in set(queries):
            raise RuntimeError("no model")
        return texts.str.len()

    got = {r.doc_id: (r.final_score, r.rerank_error) for r in search.rerank(rows.repartition(2, "query_id"), score).collect()}
    whole = {r.doc_id: r.final_score for r in search.rerank(rows.where("query_id = 0"), score).collect()}
    assert whole["b"] == 2.0 and whole["a"] > 2.0 and got["c"][0] == 0.3 and "no model" in got["c"][1]


def test_dense_leg_falls_back_and_filters(spark):
    vectors = spark.createDataFrame([(k, [float(k == j) + 0.1 * k for j in range(4)], k % 2) for k in range(8)], "doc_id int, vector array<double>, kind int")
    queries = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0], 0), (1, [0.0] * 4, 1)], "query_id int, vector array<double>, kind int")

    def broken(*_):
        raise RuntimeError("no index")

    scan = {(r.query_id, r.doc_id): r.score for r in search.dense_leg_or_scan(vectors, queries, 8, broken).collect()}
    leg = {(r.query_id, r.doc_id): r.score for r in search.dense_leg_or_scan(vectors, queries, 8).collect()}
    assert len(scan) == len(leg) == 16 and all(scan[k] == pytest.approx(2 * leg[k]) for k in leg) and scan[1, 3] == 1.0
    assert {(r.query_id, r.doc_id % 2) for r in search.dense_leg(vectors, queries, 8, "kind").collect()} == {(0, 0), (1, 1)}
    some = {(r.query_id, r.doc_id) for r in search.nearest(vectors, queries, 3, block=1).collect()}
    assert some == {(r.query_id, r.doc_id) for r in search.nearest(vectors, queries, 3).collect()}


def test_last_prediction_counts(spark):
    said = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "review_id string, pred int").coalesce(1)
    labels = spark.createDataFrame([("x", 3), ("y", 2)], "review_id string, label int")
    assert {(r.review_id, r.label, r.pred) for r in classify.align(said, labels).collect()} == {("x", 3, 3), ("y", 2, 2)}


def test_weights_must_be_positive(spark):
    rows = spark.createDataFrame([(1, 0.0, [0.5, 0.5, 0.0, 0.0])], "review_id int, weight double, probabilities array<double>")
    with pytest.raises(Exception, match="more than 0"):
        classify.soft_vote(rows).collect()


def test_numbers_in_order_of_reading(spark):
    got = files.numbered(spark.range(0, 20, 1, 4)).collect()
    assert all(r.ordinal == r.id + 1 for r in got)
    assert [[r.id for r in b.collect()] for b in ingest.in_batches(spark.range(0, 5, 1, 2), 2)] == [[0, 1], [2, 3], [4]]


def test_sentiment_analysis_runs_from_file_to_kappa(spark, tmp_path):
    from sorrel import api, config

    (tmp_path / "in.json").write_text('[{"review_id": "1", "content": "good!!!!", "label": 1}, {"review_id": "2", "content": "bad", "label": 0}]')
    assert api.run_sentiment_analysis(spark, str(tmp_path / "in.json"), str(tmp_path / "out"), lambda t: int(t == "good!!!")) == 1.0
    assert config.load_config({"SORREL_INDEX": "x"}).index == "x" and not config.load_config({}).model_expansion
